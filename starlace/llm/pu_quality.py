"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled as good; the web text is unlabelled. First a plain
classifier tells positives from unlabelled text; the class prior is read from its scores over
*all* documents and all positives: a share of the top scores that holds p of the positives and
u of the corpus bounds the prior by u / p, and the least such bound (with its confidence
margin) is taken. Then the non-negative unbiased risk

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

is minimised with the logistic loss, by Newton's steps; a step that would bring the second term
below zero is turned back by halves. A document is kept when its score, the probability of being
good, is at least ``KEEP``.

The features are counts over whole texts. Means, gradients and curvatures are sums over all
documents and all trusted positives, a job each; nothing is sampled, and the driver holds numbers
of features alone.

Defined results: null and empty texts have a row of zero features and are scored like others;
a null id is scored but never trusted; a document labelled both good and bad isn't
trusted; repeated labels count once, repeated documents are scored each; without any trusted
positives every score is null and every document is kept; other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import kept_names, own, picked, quoted, written
from .textops import Words, bounded, lazily

#: Production parameters: looks at the risk, its least decrease, weight decay, and the least score kept.
STEPS, ENOUGH, DECAY, KEEP = 40, 1e-4, 1e-4, 0.5
#: Weights tried in the search for that of the term that must not be negative.
LOOKS = 8
#: Bins of the score histogram from which the prior is read, and its confidence level.
BINS, DELTA = 1000, 0.1
_BLOCK = 1_000_000
NAMES = ("log_chars", "letters", "digits", "upper", "spaces", "stops", "symbols", "newlines", "bang", "pipe", "log_words", "word_length", "short_words", "long_words", "all_upper", "distinct", "repeated_runs", "words_per_stop", "line_length", "after_symbol", "same_in_row", "symbol_kinds")


def _classes() -> np.ndarray:
    """Per code point, a bit for each class."""
    out = np.zeros(0x110000, np.uint16)
    for c in range(0x110000):
        if 0xD800 <= c <= 0xDFFF:
            continue
        s = chr(c)
        out[c] = s.isalpha() | s.isdigit() << 1 | s.isupper() << 2 | s.isspace() << 3 | (s in ".,;:?") << 4 | (s == "\n") << 6 | (s == "!") << 7 | (s == "|") << 8
        if not (s.isalnum() or s.isspace() or s in ".,;:?!|'’\"-()_"):
            out[c] |= 1 << 5
    return out


_CACHE: dict = {}


def features(texts: list[str]) -> np.ndarray:
    """Texts x features."""
    table = _CACHE.setdefault("classes", None)
    if table is None:
        table = _CACHE["classes"] = _classes()
    w = Words(texts)
    n = np.maximum(1, np.diff(w.base)).astype(np.float64)
    bits = table[w.cp]

    def per_text(x: np.ndarray) -> np.ndarray:
        c = np.append(0, np.cumsum(x, dtype=np.int64))
        return c[w.base[1:]] - c[w.base[:-1]]

    def per_words(x: np.ndarray) -> np.ndarray:
        c = np.append(0, np.cumsum(x, dtype=np.int64))
        return c[w.first[1:]] - c[w.first[:-1]]

    share = [per_text((bits >> k) & 1) for k in range(9)]
    words = np.maximum(1, np.diff(w.first)).astype(np.float64)
    size = w.end - w.start
    upper = np.append(0, np.cumsum((bits >> 2) & 1, dtype=np.int64))
    loud = (upper[w.end] - upper[w.start] == size) & (size > 1)

    def distinct(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
        if not len(h):
            return np.zeros(len(texts), np.int64)
        order = np.lexsort((h, doc)) if len(texts) > 1 << 20 else np.argsort((doc.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
        a, b = h[order], doc[order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        return np.bincount(b[new], minlength=len(texts))

    run = np.empty(0, np.uint64)
    if len(w.hash) > 2:
        with np.errstate(over="ignore"):
            run = w.hash[:-2] * np.uint64(3) + w.hash[1:-1] * np.uint64(5) + w.hash[2:] * np.uint64(7)
        at = w.doc[:-2] == w.doc[2:]
        run, of = run[at], w.doc[:-2][at]
    runs = np.bincount(of, minlength=len(texts)) if len(run) else np.zeros(len(texts))
    again = (runs - distinct(run, of)) / np.maximum(1, runs) if len(run) else np.zeros(len(texts))
    symbol = (bits >> 5) & 1
    both = np.zeros(len(w.cp), bool)
    same = np.zeros(len(w.cp), bool)
    if len(w.cp) > 1:
        both[1:] = symbol[1:].astype(bool) & ((bits[:-1] & 1) > 0)
        same[1:] = (w.cp[1:] == w.cp[:-1]) & (symbol[1:] > 0)
        begin = w.base[:-1][w.base[:-1] < len(w.cp)]
        both[begin] = same[begin] = False  # what stands before a text isn't its own
    cols = [
        np.log1p(np.diff(w.base)), share[0] / n, share[1] / n, share[2] / n, share[3] / n, share[4] / n, share[5] / n, share[6] / n, share[7] / n, share[8] / n,
        np.log1p(np.diff(w.first)), per_words(size) / words, per_words(size <= 3) / words, per_words(size >= 15) / words, per_words(loud) / words,
        distinct(w.hash, w.doc) / words, again, np.log1p(words / (1 + share[4])), np.log1p(n / (1 + share[6])), per_text(both) / words, per_text(same) / n, (share[5] > 0) + 0.0,
    ]
    return np.stack(cols, 1)


def _features(text: Column) -> Column:
    def make(texts: pa.Array) -> pa.Array:
        rows = [features(some) for _, some in bounded(range(len(texts)), lazily(texts), _BLOCK)]
        x = np.concatenate(rows) if rows else np.empty((0, len(NAMES)))
        return pa.ListArray.from_arrays(np.arange(0, x.size + 1, len(NAMES), dtype=np.int32), x.astype(np.float32).ravel())

    return F.arrow_udf(make, T.ArrayType(T.FloatType())).asNondeterministic()(text)


def _expand(x: np.ndarray) -> np.ndarray:
    """Features and their squares."""
    return np.concatenate([x, x * x], 1)


@dataclass
class Linear:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    def inputs(self, x: np.ndarray) -> np.ndarray:
        """What weights are multiplied with; the last is 1."""
        return np.pad(np.clip((_expand(x.astype(np.float64)) - self.mean) / self.scale, -8, 8), ((0, 0), (0, 1)), constant_values=1.0)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.inputs(x) @ np.append(self.weight, self.bias)

    def weighted(self, w: np.ndarray) -> Linear:
        return Linear(self.mean, self.scale, w[:-1], float(w[-1]))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Sums:
    """Over rows, at some weights: their number, losses as bad and as good, sums of features, of
    scores times features and of curvatures. The last feature is 1."""

    n: float
    bad: float
    good: float
    x: np.ndarray
    score: np.ndarray
    curve: np.ndarray

    @staticmethod
    def flat(x: np.ndarray, w: np.ndarray) -> np.ndarray:
        z = x @ w
        p = _sigmoid(z)
        return np.concatenate([[len(x), np.logaddexp(0, z).sum(), np.logaddexp(0, -z).sum()], x.sum(0), p @ x, ((x * (p * (1 - p))[:, None]).T @ x).ravel()])

    @staticmethod
    def of(flat: np.ndarray, d: int) -> Sums:
        n, bad, good = flat[:3].tolist()
        return Sums(n, bad / n, good / n, flat[3 : 3 + d] / n, flat[3 + d : 3 + 2 * d] / n, flat[3 + 2 * d :].reshape(d, d) / n)


def _newton(w: np.ndarray, look, risk, steps: int) -> tuple[np.ndarray, tuple]:
    """Minimises a convex risk. look(w): sums of positives and of unlabelled rows; risk of them: value,
    gradient and curvature. Weights, and the sums at them."""
    decay = DECAY * np.append(np.ones(len(w) - 1), 0.0)
    sums = look(w)
    value, gradient, curve = risk(*sums)
    value += (decay * w * w).sum() / 2
    step = None
    for _ in range(steps):
        if step is None:
            step = np.linalg.solve(curve + np.diag(decay + 1e-6), gradient + decay * w)
        there = look(w - step)
        new, gradient, curve = risk(*there)
        new += (decay * (w - step) ** 2).sum() / 2
        if new > value + 1e-12:
            step = step / 2
            if np.abs(step).max() < 1e-6:
                break
            continue
        w, sums, done, value, step = w - step, there, value - new < ENOUGH, new, None
        if done:
            break
    return w, sums


def plain(look, d: int, steps: int = STEPS) -> np.ndarray:
    """Positives from unlabelled text, by balanced logistic loss."""
    return _newton(np.zeros(d), look, lambda p, u: ((p.good + u.bad) / 2, (p.score - p.x + u.score) / 2, (p.curve + u.curve) / 2), steps)[0]


def non_negative(look, d: int, prior: float, steps: int = STEPS) -> np.ndarray:
    """Minimises the non-negative risk. With the second term weighed by some share of 1 the risk is
    convex, as the losses of a positive as good and as bad differ by its margin alone. Where the
    whole weight takes that term below zero, the least of the non-negative risk is where the term
    is zero, at the weight that brings it there."""

    def rest(p: Sums, u: Sums) -> float:
        return u.bad - prior * p.bad

    def solved(w: np.ndarray, share: float) -> tuple[np.ndarray, tuple]:
        return _newton(w, look, lambda p, u: (prior * p.good + share * rest(p, u), prior * (p.score - p.x) + share * (u.score - prior * p.score), prior * (1 - share) * p.curve + share * u.curve), steps)

    w, sums = solved(np.zeros(d), 1.0)
    if rest(*sums) >= 0:
        return w
    # the term falls as its weight grows; false position, with the stale end halved
    low, high, over, under, best, side = 0.0, 1.0, None, rest(*sums), None, 0
    for _ in range(LOOKS):
        share = (low + high) / 2 if over is None else (low * under - high * over) / (under - over)
        w, sums = solved(w, share)
        left = rest(*sums)
        if left >= 0:
            low, over, best, under, side = share, left, w, under / 2 if side == 1 else under, 1
            if left < ENOUGH:
                break
        else:
            high, under, over, side = share, left, over / 2 if side == -1 and over is not None else over, -1
    return w if best is None else best


def prior_of(positives: np.ndarray, corpus: np.ndarray, delta: float = DELTA) -> float:
    """The class prior from two histograms of scores over the same bins, lowest first."""
    p, u = positives[::-1].cumsum(), corpus[::-1].cumsum()
    np_, nu = p[-1], u[-1]
    if not np_ or not nu:
        return 0.5
    margin = np.sqrt(np.log(4 / delta) / 2 / nu) + np.sqrt(np.log(4 / delta) / 2 / np_)
    share, all_ = p / np_, u / nu
    some = share > margin * 1.01
    if not some.any():
        return 0.5
    upper = np.where(some, (all_ + margin) / np.maximum(share, 1e-12), np.inf)
    k = int(upper.argmin())
    return float(np.clip(all_[k] / share[k], 0.01, 0.99))


def _summed(x: DataFrame, each, size: int) -> np.ndarray:
    """The sum of each(rows of features), a vector, over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            rows = _rows(batch.column(0))
            for k in range(0, len(rows), 20_000):
                total += each(rows[k : k + 20_000])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    got = x.select("x").mapInArrow(count, "at bigint, n double").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size)
    out[got["at"].to_numpy()] = got["n"].to_numpy()
    return out


def _histogram(x: DataFrame, model) -> np.ndarray:
    """How many rows' scores fall into each bin."""
    return _summed(x, lambda rows: np.bincount(np.minimum((_sigmoid(model.value.margin(rows)) * BINS).astype(int), BINS - 1), minlength=BINS), BINS)


def _rows(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES)) if len(column) else np.empty((0, len(NAMES)), np.float32)


def _margins(column, model: Linear) -> np.ndarray:
    return model.margin(_rows(column))


@dataclass
class Quality:
    prior: float
    model: Linear


def fit(x: DataFrame, labels: DataFrame, id: str = "doc_id", label: str = "quality", steps: int = STEPS) -> Quality | None:
    """x: (id, x) of all documents."""
    sc, d = x.sparkSession.sparkContext, 2 * len(NAMES)
    labels = picked(labels, id, label)
    trusted = labels.where(F.col(quoted(id)).isNotNull() & F.col(quoted(label)).isNotNull()).groupBy(F.col(quoted(id)).cast("bigint").alias("id")).agg(F.min(quoted(label)).alias("low")).where("low = 1").select("id")
    good = written(x.where("id is not null").join(trusted, "id", "left_semi"), "trusted")
    if not good.count():
        return None

    def powers(rows: np.ndarray) -> np.ndarray:
        e = _expand(rows.astype(np.float64))
        return np.concatenate([[len(e)], e.sum(0), (e * e).sum(0)])

    sums = _summed(x, powers, 1 + 2 * d)
    mean = sums[1 : 1 + d] / sums[0]
    blank = Linear(mean, np.sqrt(np.maximum(0.0, sums[1 + d :] / sums[0] - mean**2)) + 1e-6, np.zeros(d), 0.0)

    def look(w: np.ndarray) -> tuple[Sums, Sums]:
        each = lambda rows: Sums.flat(blank.inputs(rows), w)
        return tuple(Sums.of(_summed(some, each, 3 + 2 * (d + 1) + (d + 1) ** 2), d + 1) for some in (good, x))

    first = sc.broadcast(blank.weighted(plain(look, d + 1, steps)))
    prior = prior_of(_histogram(good, first), _histogram(x, first))
    return Quality(prior, blank.weighted(non_negative(look, d + 1, prior, steps)))


@kept_names
def classify(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", keep: float = KEEP, into: str = "quality_score", into_keep: str = "keep", **how) -> DataFrame:
    """docs with two more columns: the score, and whether it is enough."""
    made = written(docs.select(F.col(quoted(id)).cast("bigint").alias("id"), _features(F.coalesce(F.col(quoted(text)), F.lit(""))).alias("x")), "features")
    got = fit(made, labels, id, **how)
    if got is None:
        return docs.select(*own(docs, into, into_keep), F.lit(None).cast("double").alias(into), F.lit(True).alias(into_keep))
    model = docs.sparkSession.sparkContext.broadcast(got.model)

    def rate(texts: pa.Array) -> pa.Array:
        z = [model.value.margin(features(some)) for _, some in bounded(range(len(texts)), lazily(texts), _BLOCK)]
        return pa.array(np.round(_sigmoid(np.concatenate(z) if z else np.empty(0)), 6))

    s = F.arrow_udf(rate, T.DoubleType()).asNondeterministic()(F.coalesce(F.col(quoted(text)), F.lit("")))
    return docs.select(*own(docs, into, into_keep), s.alias(into)).withColumn(into_keep, F.col(quoted(into)) >= keep)


@kept_names
def scored(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", keep: float = KEEP, **how) -> DataFrame:
    """(id, score, keep) only: features are made once and serve the fit and the scores."""
    made = written(docs.select(F.col(quoted(id)).cast("bigint").alias("id"), _features(F.coalesce(F.col(quoted(text)), F.lit(""))).alias("x")), "features")
    got = fit(made, labels, id, **how)
    if got is None:
        return made.select(F.col("id").alias(id), F.lit(None).cast("double").alias("score"), F.lit(True).alias("keep"))
    model = docs.sparkSession.sparkContext.broadcast(got.model)

    def rate(x: pa.Array) -> pa.Array:
        return pa.array(np.round(_sigmoid(_margins(x, model.value)), 6))

    return made.select(F.col("id").alias(id), F.arrow_udf(rate, T.DoubleType()).asNondeterministic()("x").alias("score")).withColumn("keep", F.col("score") >= keep)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scored(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
