"""MinHash near-deduplication with sequential Bayesian verification.

A document is its set of word 3-shingles. Banded MinHash proposes candidates. A candidate's
signatures are compared a batch of hashes at a time: with a uniform prior and m matches among
n hashes the posterior of the Jaccard similarity is Beta(m + 1, n - m + 1), and the candidate
is dropped as soon as the posterior chance of reaching the threshold is below ``miss``.
Survivors are verified on the shingle sets themselves.

Groups are the connected components of the verified pairs. Within a bucket of n documents not
all n^2 pairs need looking at: two documents that both verify against documents of one group
are in that group already. So buckets are compared with their least member first, and only
the members that this leaves apart are compared with all the others. No bucket is capped, so the
work is the square of the number of documents in a bucket that are near none of its others.

Defined results: the id says which document a row is, so rows that share an id are one
document: it is near another if any of its texts is, and one row (that with the least text) stays. A null id is no id: such rows
are never grouped and stay. A text without words is never grouped and stays. A text of one
or two words has itself as its one shingle. Ties: the least id of a group stays. Texts are
taken whole. Other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .frames import checked_broadcast, cleared, fresh, kept_names, own, quoted, written
from .textops import Words, bounded, lazily, mix, windows

#: Production parameters: words a shingle; Jaccard similarity; bands and hashes a band.
SHINGLE, THRESHOLD, BANDS, ROWS = 3, 0.5, 40, 4
#: Hashes compared at a time, and the chance at which a truly similar pair may be dropped.
BATCH, MISS = 32, 0.001
#: Ids in a broadcast; beyond that the join shuffles.
BROADCAST_ROWS = 2_000_000
_BLOCK = 400_000


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240229)
    return r.integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1), r.integers(0, 2**63, n, dtype=np.uint64)


def shingles(texts: list[str], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, by text, and where each text's begin."""
    w = Words(texts)
    h, at = windows(w, k)
    doc = w.doc[at]
    counts = np.diff(w.first)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        with np.errstate(over="ignore"):
            extra = w.hash[w.first[short]].copy()
            two = counts[short] > 1
            for j in range(1, k - 1):
                two = counts[short] > j
                extra[two] = extra[two] * np.uint64(0x100000001B3) + w.hash[w.first[short[two]] + j]
        h, doc = np.concatenate([h, mix(extra)]), np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    if len(h):
        new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))
        h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(texts) + 1))


def _signatures(h: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """Texts x n minima, 16 bits of each; texts must not be empty."""
    a, b = _multipliers(n)
    out = np.empty((len(first) - 1, n), np.uint16)
    step = 1 << 15
    lo = 0
    with np.errstate(over="ignore"):
        while lo < len(first) - 1:
            hi = max(lo + 1, int(np.searchsorted(first, first[lo] + step, "right")) - 1)
            x, cuts = h[first[lo] : first[hi]], first[lo:hi] - first[lo]
            y = np.empty_like(x)
            for j in range(n):
                np.multiply(x, a[j], out=y)
                np.add(y, b[j], out=y)
                np.right_shift(y, np.uint64(20), out=y)
                low = np.minimum.reduceat(y, cuts)
                out[lo:hi, j] = mix(low).astype(np.uint16)
            lo = hi
    return out


_SKETCH = T.StructType([T.StructField("n", T.LongType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("sig", T.BinaryType())])


def sketch(text: Column, k: int = SHINGLE, hashes: int = BANDS * ROWS) -> Column:
    """Number of shingles, a 128-bit hash of their set, and the MinHash signature; null without words."""

    def make(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows: list = []
            for _, some in bounded(range(len(texts)), lazily(texts), _BLOCK):
                h, first = shingles(some, k)
                n = np.diff(first)
                full = np.flatnonzero(n)
                got: list = [None] * len(some)
                if len(full):
                    cuts = np.append(first[full], len(h))
                    sig = _signatures(h, cuts, hashes)
                    with np.errstate(over="ignore"):
                        h1 = np.add.reduceat(mix(h), cuts[:-1]).view(np.int64)
                        h2 = np.add.reduceat(mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), cuts[:-1]).view(np.int64)
                    for d, m, x, y, s in zip(full.tolist(), n[full].tolist(), h1.tolist(), h2.tolist(), sig):
                        got[d] = {"n": m, "h1": x, "h2": y, "sig": s.tobytes()}
                rows += got
            yield pa.array(rows, pa.struct([("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("sig", pa.binary())]))

    return F.arrow_udf(make, _SKETCH).asNondeterministic()(text)


def _matrix(column: pa.Array, kind) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    if not n:
        return np.empty((0, 0), kind)
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]].view(kind).reshape(n, -1)


def band_keys(sig: Column, rows: int = ROWS) -> Column:
    """One bigint for each band of a signature."""

    def make(sig: pa.Array) -> pa.Array:
        m = _matrix(sig, np.uint64 if rows == 4 else np.uint16)
        if not m.size:
            return pa.array([], pa.list_(pa.int64()))
        if rows != 4:
            m = np.ascontiguousarray(m.reshape(len(m), -1, rows)).astype(np.uint64)
            with np.errstate(over="ignore"):
                m = (m * np.uint64(65537) ** np.arange(rows, dtype=np.uint64)).sum(2, dtype=np.uint64)
        with np.errstate(over="ignore"):
            keys = mix((m ^ mix(np.arange(m.shape[1], dtype=np.uint64) + np.uint64(1))).ravel()).view(np.int64)
        return pa.ListArray.from_arrays(np.arange(0, len(keys) + 1, m.shape[1], dtype=np.int32), keys)

    return F.arrow_udf(make, T.ArrayType(T.LongType()))(sig)


def least_matches(hashes: int, threshold: float, batch: int, miss: float) -> list[tuple[int, int]]:
    """(n, the fewest matches among n hashes that keep a pair) after each batch.

    P(J >= t | m of n) = 1 - I_t(m + 1, n - m + 1) = P(Bin(n + 1, t) <= m).
    """
    out = []
    for n in range(batch, hashes + 1, batch):
        chance, m = 0.0, -1
        while chance < miss:
            m += 1
            chance += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def plausible(a: Column, b: Column, threshold: float, batch: int = BATCH, miss: float = MISS, hashes: int = BANDS * ROWS) -> Column:
    """Whether two signatures pass every batch of the sequential test."""
    steps = least_matches(hashes, threshold, batch, miss)

    def test(a: pa.Array, b: pa.Array) -> pa.Array:
        x, y = _matrix(a, np.uint16), _matrix(b, np.uint16)
        alive, matches, seen = np.arange(len(x)), np.zeros(len(x), np.int64), 0
        for n, least in steps:
            matches[alive] += (x[alive, seen:n] == y[alive, seen:n]).sum(1)
            alive, seen = alive[matches[alive] >= least], n
        keep = np.zeros(len(x), bool)
        keep[alive] = True
        return pa.array(keep)

    return F.arrow_udf(test, T.BooleanType()).asNondeterministic()(a, b)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays of distinct hashes."""
    if not len(a) or not len(b):
        return 0.0
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return both / (len(a) + len(b) - both)


def _exact_pairs(pairs: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """Of the pairs (a, b) those whose shingle sets reach the threshold."""

    def test(a: pa.Array, b: pa.Array) -> pa.Array:
        keep = []
        for x, y in zip(a.to_pylist(), b.to_pylist()):
            h, f = shingles([x or "", y or ""], k)
            keep.append(jaccard(h[: f[1]], h[f[1] :]) >= threshold)
        return pa.array(keep, pa.bool_())

    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return both.where(F.arrow_udf(test, T.BooleanType()).asNondeterministic()("ta", "tb")).select("a", "b")


def _exact_stars(labelled: DataFrame, k: int, threshold: float) -> DataFrame:
    """Of (id, group, text) the pairs (group, id) whose shingle sets reach the threshold.

    A group's texts come together, that of its least id first, so each text is moved once."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, its = None, []  # a group's least id, and the sets of its texts
        for batch in batches:
            ids, groups, texts = batch.column("id").to_pylist(), batch.column("group").to_pylist(), lazily(batch.column("text"))
            a, b = [], []
            done = 0
            for _, some in bounded(ids, texts, _BLOCK):
                h, f = shingles(some, k)
                for d in range(len(some)):
                    i, g, mine = ids[done + d], groups[done + d], h[f[d] : f[d + 1]]
                    if i == g:
                        centre, its = g, [*(its if centre == g else []), mine.copy()]
                    elif g == centre and any(jaccard(x, mine) >= threshold for x in its):
                        a.append(g)
                        b.append(i)
                done += len(some)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    together = labelled.repartition("group").sortWithinPartitions("group", F.col("id") != F.col("group"), "id")
    return together.select("id", "group", "text").mapInArrow(test, "a bigint, b bigint")


@kept_names
def near_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, batch: int = BATCH, miss: float = MISS) -> DataFrame:
    """(id, group) of every document that has a near copy; group is the least id of its group."""
    spark = docs.sparkSession
    hashes = bands * rows
    plain = docs.select(F.col(quoted(id)).cast("bigint").alias("id"), F.col(quoted(text)).alias("text")).where(F.col("id").isNotNull())
    made = written(plain.select("id", sketch(F.col("text"), k, hashes).alias("s")).where("s is not null").select("id", "s.*"), "sketches")

    # rows that share an id: each of its texts once
    again = written(made.groupBy("id").count().where("count > 1").select("id"), "again")
    if shared := again.count():
        few = checked_broadcast(again, shared, BROADCAST_ROWS)
        made = made.join(few, "id", "left_anti").unionByName(made.join(few, "id", "left_semi").dropDuplicates(["id", "n", "h1", "h2"]))
        plain = plain.join(few, "id", "left_anti").unionByName(plain.join(few, "id", "left_semi").distinct())

    # copies of a whole set are one representative
    same = ["h1", "h2", "n"]
    reps = made.groupBy(*same).agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    copies = written(made.select("id", *same).join(reps.where("copies > 1"), same).where("id != rep").select(F.col("rep").alias("a"), F.col("id").alias("b")), "copies")
    distinct = made.join(reps.select(F.col("rep").alias("id"), *same), ["id", *same], "left_semi").select("id", "sig") if shared else made.join(copies.select(F.col("b").alias("id")), "id", "left_anti").select("id", "sig")

    keyed = distinct.select("id", F.explode(band_keys(F.col("sig"), rows)).alias("key")).repartition("key")
    lead = keyed.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead != last").select("key", "lead")
    members = written(keyed.join(lead.hint("shuffle_hash"), "key"), "members")
    sigs = made.select("id", "sig")

    def plausible_pairs(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
        got = both.where(plausible(F.col("sa"), F.col("sb"), threshold, batch, miss, hashes)).select("a", "b")
        return got.distinct() if shared else got

    stars = members.where("id != lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    stars = written(plausible_pairs(stars), "stars")
    guess = written(components(stars), "guess")
    some = guess.count()
    texts = plain.join(checked_broadcast(guess, some, BROADCAST_ROWS), "id")
    first = written(_exact_stars(texts, k, threshold), "verified")

    def apart(pairs: DataFrame, label: DataFrame, *keep: str) -> DataFrame:
        """Pairs whose ends aren't in one group yet."""
        la, lb = label.select(F.col("id").alias("a"), F.col("group").alias("ga")), label.select(F.col("id").alias("b"), F.col("group").alias("gb"))
        got = pairs.join(la, "a", "left").join(lb, "b", "left")
        return got.where("coalesce(ga, a) != coalesce(gb, b)").select("a", "b", *keep)

    def verified(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
        return _exact_pairs(pairs, plain.join(checked_broadcast(ids, ids.count(), BROADCAST_ROWS), "id"), k, threshold)

    label = first.select(F.col("b").alias("id"), F.col("a").alias("group"))
    rest = written(apart(stars, label), "rest")
    second = written(verified(rest), "verified")
    label = written(components(first.union(second)), "labels")

    loose = written(apart(members.where("id != lead").select(F.col("lead").alias("a"), F.col("id").alias("b"), "key"), label, "key").select("key", F.col("b").alias("c")), "loose")
    others = members.select("key", F.col("id").alias("x")).join(loose, "key").where("x != c").select(F.least("x", "c").alias("a"), F.greatest("x", "c").alias("b")).distinct()
    late = written(plausible_pairs(apart(others, label)), "late")
    third = written(verified(late), "verified")
    cleared(spark, made, members, stars, guess, rest, label, loose, late)
    return components(first.union(second).union(third).union(copies))


@kept_names
def drop_near_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs with one document of each group, that with the least id."""
    groups = near_groups(docs, id, text, **how)
    lost, twice, rank = fresh(docs, "lost"), fresh(docs, "twice"), fresh(docs, "rank")
    key, cols = F.col(quoted(id)).cast("bigint"), own(docs)
    gone = written(groups.where("id != group").select(F.col("id").alias(lost)), "gone")
    kept = docs.join(checked_broadcast(gone, gone.count(), BROADCAST_ROWS), key == F.col(lost), "left_anti")
    # rows that share an id; the rest of the table isn't moved
    again = written(docs.groupBy(key.alias(twice)).count().where((F.col("count") > 1) & F.col(twice).isNotNull()).select(twice), "again")
    if not (n := again.count()):
        return kept.select(*cols)
    few, at = checked_broadcast(again, n, BROADCAST_ROWS), key == F.col(twice)
    first = F.row_number().over(Window.partitionBy(quoted(id)).orderBy(F.col(quoted(text)).asc_nulls_last()))
    one = kept.join(few, at, "left_semi").withColumn(rank, first).where(F.col(rank) == 1).select(*cols)
    return kept.join(few, at, "left_anti").select(*cols).unionByName(one)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_groups(docs).select(F.col("id").alias("doc_id"), F.col("group").alias("group_id"))
