"""Benchmark decontamination with an FM-index of each training shard.

A shard is a run of whole documents of about ``SHARD`` characters, indexed where it is read:
nothing is shuffled. Its words are numbered, the suffixes of the shard are sorted, and the
Burrows-Wheeler transform goes into a wavelet matrix. All test phrases are searched backward
in step through its ranks; occurrences are located by walking to sampled suffix positions.
The spans of occurrences in a document are merged where they touch, and are what is removed.

A test phrase is any run of ``words`` words of a benchmark item (letters, digits and
underscores, lower-cased, so that case, punctuation and line breaks don't hide it). An item of
fewer words is a phrase as a whole if it has at least ``least``, and else none.

Defined results: null and empty texts have no spans and stay as they are; null or repeated
benchmark items count once or not at all; an empty benchmark leaves all texts as they are;
a document is indexed whole, however long; repeated rows are each cleaned; other columns are
carried along. A document that is nothing but a passage stays with what is left of its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import fresh, kept_names, own, quoted
from .textops import Words, bounded, lazily, suffix_ranks

#: Production parameters: words a phrase, and the fewest words of a shorter item.
WORDS, LEAST = 8, 5
#: Characters a shard; text positions for each sampled one.
SHARD, SAMPLE = 2_000_000, 32
#: Phrases searched in one pass over the shards (64 bytes each); more are searched in several.
PHRASES = 1_000_000


class WaveletMatrix:
    """Rank and access over a sequence of small non-negative integers."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.n, self.bits, self.level, self.before, self.zeros = len(seq), bits, [], [], []
        for b in range(bits - 1, -1, -1):
            bit = ((seq >> seq.dtype.type(b)) & seq.dtype.type(1)).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(len(seq) // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            before = np.zeros(len(words) + 1, np.int32)
            np.cumsum(np.bitwise_count(words), out=before[1:])
            self.level.append(words)
            self.before.append(before)
            seq = np.concatenate([seq[~bit], seq[bit]])
            self.zeros.append(len(bit) - int(before[-1]))

    def _ones(self, k: int, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[k][word] + np.bitwise_count(self.level[k][word] & low).astype(np.int64)

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c stands before place i."""
        start = np.zeros(len(i), np.int64)
        for k in range(self.bits):
            one = ((c >> (self.bits - 1 - k)) & 1).astype(bool)
            a, b = self._ones(k, start), self._ones(k, i)
            start = np.where(one, self.zeros[k] + a, start - a)
            i = np.where(one, self.zeros[k] + b, i - b)
        return i - start

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What stands at place i, and how often it stands before."""
        c, start = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        for k in range(self.bits):
            one = (self.level[k][i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            c = (c << 1) | one
            a, b = self._ones(k, start), self._ones(k, i)
            start = np.where(one, self.zeros[k] + a, start - a)
            i = np.where(one, self.zeros[k] + b, i - b)
        return c, i - start


class FMIndex:
    """Of the words of many texts; no match goes over the end of a text."""

    def __init__(self, words: Words, sample: int = SAMPLE):
        n, texts = len(words.hash), len(words.first) - 1
        self.alphabet, symbol = np.unique(words.hash, return_inverse=True)
        symbol = symbol.astype(np.int32) + 1  # 0 ends a text
        ends = words.first[1:][words.doc]
        order = np.empty(0, np.int64)
        for _, _, order, _ in suffix_ranks(symbol, words.doc, ends, separate=False):
            pass
        # the ends come first, one for each text, then the suffixes
        bwt = np.zeros(texts + n, np.int32)
        some = np.flatnonzero(np.diff(words.first))
        bwt[some] = symbol[words.first[some + 1] - 1]
        begins = np.zeros(n + 1, bool)
        begins[words.first] = True
        begins = begins[:n]
        prev = np.zeros(n, np.int32)
        prev[1:] = symbol[:-1]
        prev[begins] = 0
        bwt[texts:] = prev[order]
        counts = np.bincount(symbol, minlength=len(self.alphabet) + 2)
        counts[0] = texts
        self.less = np.concatenate([[0], np.cumsum(counts)])
        self.tree = WaveletMatrix(bwt, max(1, int(len(self.alphabet)).bit_length()))
        at = np.flatnonzero(begins[order] | (order % sample == 0))
        self.marks = np.zeros(texts + n, bool)
        self.marks[texts + at] = True
        self.sampled = order[at]
        self.mark_rank = np.cumsum(self.marks) - 1

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """phrases: rows of word hashes of one length. (phrase, row of the index) of each match."""
        if not len(self.alphabet) or not len(phrases):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.searchsorted(self.alphabet, phrases)
        at = np.minimum(at, len(self.alphabet) - 1)
        known = (self.alphabet[at] == phrases).all(1)
        which, code = np.flatnonzero(known), at[known].astype(np.int64) + 1
        if not len(which):
            return which, which
        lo, hi = self.less[code[:, -1]], self.less[code[:, -1] + 1]
        for j in range(phrases.shape[1] - 2, -1, -1):
            c = code[:, j]
            lo, hi = self.less[c] + self.tree.rank(c, lo), self.less[c] + self.tree.rank(c, hi)
            alive = lo < hi
            which, code, lo, hi = which[alive], code[alive], lo[alive], hi[alive]
            if not len(which):
                break
        times = hi - lo
        rows = np.repeat(lo - np.cumsum(times) + times, times) + np.arange(int(times.sum()))
        return np.repeat(which, times), rows

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Word positions of rows, by walking back to a sampled one."""
        found = np.full(len(rows), -1, np.int64)
        at, where, steps = rows.copy(), np.arange(len(rows)), 0
        while len(where):
            hit = self.marks[at]
            found[where[hit]] = self.sampled[self.mark_rank[at[hit]]] + steps
            at, where = at[~hit], where[~hit]
            if len(where):
                c, r = self.tree.access_rank(at)
                at = self.less[c] + r
            steps += 1
        return found


def phrases_of(items: list[tuple[int, str | None]], words: int = WORDS, least: int = LEAST) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: rows of word hashes, and the item of each."""
    w = Words([t or "" for _, t in items])
    rows: dict[int, list] = {}
    for d, (item, _) in enumerate(items):
        h = w.hash[w.first[d] : w.first[d + 1]]
        if len(h) >= words:
            rows.setdefault(words, []).append((np.lib.stride_tricks.sliding_window_view(h, words), item))
        elif len(h) >= least:
            rows.setdefault(len(h), []).append((h[None, :], item))
    return {k: (np.concatenate([a for a, _ in v]), np.concatenate([np.full(len(a), i, np.int64) for a, i in v])) for k, v in rows.items()}


def shard_spans(texts: list[str], phrases: dict[int, tuple[np.ndarray, np.ndarray]], sample: int = SAMPLE) -> list[list[tuple[int, int, int, int, list[int]]]]:
    """For each text its removal spans: (first word, words, first character, end, items)."""
    out: list[list] = [[] for _ in texts]
    w = Words(texts)
    if not len(w.hash) or not phrases:
        return out
    index = FMIndex(w, sample)
    begin, stop, item = [], [], []
    for k, (rows, of) in phrases.items():
        which, row = index.search(rows)
        if len(which):
            at = index.locate(row)
            begin.append(at)
            stop.append(at + k)
            item.append(of[which])
    if not begin:
        return out
    begin, stop, item = map(np.concatenate, (begin, stop, item))
    order = np.argsort(begin, kind="stable")
    begin, stop, item = begin[order], stop[order], item[order]
    doc = w.doc[begin]
    reach = np.maximum.accumulate(stop)
    new = np.append(True, (begin[1:] > reach[:-1]) | (doc[1:] != doc[:-1]))
    cuts = np.flatnonzero(new)
    for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(begin)).tolist()):
        d, s, e = int(doc[a]), int(begin[a]), int(stop[a:b].max())
        base = int(w.base[d])
        out[d].append((s - int(w.first[d]), e - s, int(w.start[s]) - base, int(w.end[e - 1]) - base, sorted(set(item[a:b].tolist()))))
    return out


_SPAN = T.ArrayType(T.StructType([T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("items", T.ArrayType(T.LongType()))]))
_PA_SPAN = pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("items", pa.list_(pa.int64()))]))


def _spans(text: Column, phrases: dict) -> Column:
    names = ("first_word", "n_words", "start", "stop", "items")

    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows: list = []
            for _, some in bounded(range(len(texts)), lazily(texts), SHARD):
                rows += [[dict(zip(names, s)) for s in spans] or None for spans in shard_spans(some, phrases)]
            yield pa.array(rows, _PA_SPAN)

    return F.arrow_udf(find, _SPAN).asNondeterministic()(text)


@kept_names
def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", words: int = WORDS, least: int = LEAST, item: str = "item_id", item_text: str = "text", into: str = "spans") -> DataFrame:
    """docs with one more column: the merged removal spans, null where there are none."""
    pieces = benchmark.select(F.col(quoted(item)).cast("bigint"), F.col(quoted(item_text))).where(F.col(quoted(item_text)).isNotNull() & F.col(quoted(item)).isNotNull())
    parts: list[dict] = []
    some: list = []
    size = 0
    for i, t in pieces.toLocalIterator():  # a part at a time, however large the benchmark is
        n = len(t) // 2
        if some and size + n > PHRASES:
            parts.append(phrases_of(some, words, least))
            some, size = [], 0
        some.append((i, t))
        size += n
    if some:
        parts.append(phrases_of(some, words, least))
    found = [fresh(docs, f"spans{k}") for k in range(len(parts))]
    got = docs
    for name, part in zip(found, parts):
        got = got.withColumn(name, _spans(F.col(quoted(text)), part))
    if not found:
        spans = F.lit(None).cast(_SPAN)
    elif len(found) == 1:
        spans = F.col(found[0])
    else:
        spans = F.arrow_udf(_merge, _SPAN)(*map(F.col, found))
    return got.select(*own(docs, into), spans.alias(into))


def _merge(*parts: pa.Array) -> pa.Array:
    rows = []
    for lists in zip(*(p.to_pylist() for p in parts)):
        spans = sorted((s for x in lists if x for s in x), key=lambda s: s["first_word"])
        out: list[dict] = []
        for s in spans:
            if out and s["first_word"] <= out[-1]["first_word"] + out[-1]["n_words"]:
                last = out[-1]
                end = max(last["first_word"] + last["n_words"], s["first_word"] + s["n_words"])
                last |= {"n_words": end - last["first_word"], "stop": max(last["stop"], s["stop"]), "items": sorted({*last["items"], *s["items"]})}
            else:
                out.append(dict(s))
        rows.append(out or None)
    return pa.array(rows, _PA_SPAN)


def without(text: Column, spans: Column) -> Column:
    """text with the spans cut out."""
    n = F.size(spans)
    before = F.transform(F.sequence(F.lit(0), n), lambda k: F.substr(text, F.when(k == 0, 1).otherwise(F.get(spans, k - 1)["stop"] + 1).cast("int"), (F.when(k == n, F.length(text)).otherwise(F.get(spans, k)["start"]) - F.when(k == 0, 0).otherwise(F.get(spans, k - 1)["stop"])).cast("int")))
    return F.when(spans.isNull(), text).otherwise(F.array_join(before, ""))


@kept_names
def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", **how) -> DataFrame:
    """docs without the passages; their own columns."""
    name = fresh(docs, "spans")
    got = leaks(docs, benchmark, text, into=name, **how)
    return got.withColumn(text, without(F.col(quoted(text)), F.col(name))).select(*own(docs))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("spans is not null")
    return got.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.first_word", "s.n_words", "s.start", "s.stop", F.array_join("s.items", ",").alias("items"))


ORACLE = r"""
WITH b AS (
  SELECT DISTINCT item_id, [lower(x) FOR x IN regexp_extract_all(text, '[\p{L}\p{N}_]+')] AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), phrases AS (
  SELECT DISTINCT item_id, w[i:i + 7] AS p FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS i FROM b WHERE len(w) >= 8)
  UNION SELECT item_id, w FROM b WHERE len(w) BETWEEN 5 AND 7
), pieces AS (
  SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS k
  FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+') AS p FROM documents WHERE text IS NOT NULL)
), placed AS (
  SELECT doc_id, k, piece, (sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k))::BIGINT AS upto FROM pieces
), words AS (
  SELECT doc_id, lower(piece) AS word, upto - length(piece) AS start, upto AS stop, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS i
  FROM placed WHERE regexp_matches(piece, '^[\p{L}\p{N}_]')
), runs AS (
  SELECT doc_id, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS w8 FROM words
), hits AS (
  SELECT r.doc_id, r.i, r.i + len(p.p) AS e, p.item_id FROM runs r JOIN phrases p ON r.w8 = p.p
  UNION SELECT r.doc_id, r.i, r.i + len(p.p) AS e, p.item_id FROM runs r JOIN phrases p ON len(p.p) < 8 AND len(r.w8) >= len(p.p) AND r.w8[1:len(p.p)] = p.p
), marked AS (
  SELECT *, coalesce(i > max(e) OVER (PARTITION BY doc_id ORDER BY i, e, item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS fresh FROM hits
), grouped AS (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i, e, item_id) AS g FROM marked
), spans AS (
  SELECT doc_id, g, min(i) AS i, max(e) AS e, list_sort(list(DISTINCT item_id)) AS items FROM grouped GROUP BY doc_id, g
)
SELECT s.doc_id, s.i::BIGINT AS first_word, (s.e - s.i)::BIGINT AS n_words, a.start::BIGINT AS start, z.stop::BIGINT AS stop, array_to_string(items, ',') AS items
FROM spans s JOIN words a ON a.doc_id = s.doc_id AND a.i = s.i JOIN words z ON z.doc_id = s.doc_id AND z.i = s.e - 1
"""
