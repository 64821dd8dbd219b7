"""Quality rules: repetition within a document, from suffix arrays.

For each text the longest-common-prefix intervals of its suffix array give the maximal
repeated substrings. Those of at least ``min_repeat`` characters are laid over the text,
their spans are united, and a document is kept when the united spans cover at most
``max_fraction`` of it and no single repeat is longer than ``max_longest``.

Defined results: a null or empty text has fraction 0, longest repeat 0 and is kept; a text
is never cut, however long; repeated rows are judged one by one and stay; an empty table
gives an empty table; other columns are carried along untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import fresh, kept_names, own, quoted
from .textops import bounded, codepoints, lazily, suffix_ranks

#: Production parameters: characters.
MIN_REPEAT, MAX_FRACTION, MAX_LONGEST = 50, 0.3, 1000
#: Characters whose suffixes are sorted together; a longer text is sorted alone.
BLOCK = 500_000


def repeats(texts: list[str], min_repeat: int = MIN_REPEAT) -> tuple[np.ndarray, np.ndarray]:
    """For each text: characters under repeats of at least min_repeat, and the longest repeat
    (0 if it is shorter than min_repeat)."""
    covered, longest = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    cp, base = codepoints(texts)
    if not len(cp):
        return covered, longest
    _, symbols = np.unique(cp, return_inverse=True) if cp.max() > 0x2FF else (None, cp)
    doc = np.repeat(np.arange(len(texts)), np.diff(base))
    ends = base[1:][doc]
    levels: list[tuple[int, np.ndarray]] = []
    tied = None
    order = None
    for depth, rank, order, _ in suffix_ranks(symbols, doc, ends, separate=True):
        levels.append((depth, rank))
        if depth <= min_repeat or tied is None:
            tied = rank if depth <= min_repeat else None
    if tied is None:  # even the first depth is beyond min_repeat
        tied = doc
    pairs = np.flatnonzero(tied[order[1:]] == tied[order[:-1]])
    if not len(pairs):
        return covered, longest
    i, j = order[pairs], order[pairs + 1]
    lcp = np.zeros(len(pairs), np.int64)
    for depth, rank in reversed(levels):
        a, b = i + lcp, j + lcp
        ok = (a < ends[i]) & (b < ends[j])
        ok[ok] = rank[a[ok]] == rank[b[ok]]
        lcp += depth * ok
    more = np.ones(len(pairs), bool)
    while more.any():
        a, b = i + lcp, j + lcp
        more &= (a < ends[i]) & (b < ends[j])
        more[more] = symbols[a[more]] == symbols[b[more]]
        lcp += more
    keep = lcp >= min_repeat
    i, j, lcp = i[keep], j[keep], lcp[keep]
    if not len(i):
        return covered, longest
    # the deepest interval that holds a suffix is the larger of the two beside it
    reach = np.zeros(len(cp) + 1, np.int64)
    np.maximum.at(reach, i, lcp)
    np.maximum.at(reach, j, lcp)
    at = np.flatnonzero(reach)
    # left-maximal ones only: the others lie inside the span of their predecessor
    inner = (at > 0) & (reach[at - 1] == reach[at] + 1)
    inner &= doc[at] == doc[np.maximum(at - 1, 0)]
    at = at[~inner]
    stop = at + reach[at]
    np.maximum.at(longest, doc[at], reach[at])
    upto = np.maximum.accumulate(np.append(0, stop)[:-1])
    np.add.at(covered, doc[at], np.maximum(0, stop - np.maximum(at, upto)))
    return covered, longest


def _judge(min_repeat: int):
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            c, g = [], []
            for _, some in bounded(range(len(texts)), lazily(texts), BLOCK):
                covered, longest = repeats(some, min_repeat)
                c.append(covered)
                g.append(longest)
            cat = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
            yield pa.StructArray.from_arrays([pa.array(cat(c)), pa.array(cat(g))], ["covered", "longest"])

    kind = T.StructType([T.StructField("covered", T.LongType()), T.StructField("longest", T.LongType())])
    return F.arrow_udf(judge, kind).asNondeterministic()  # else a filter on it would run it twice


@kept_names
def repetition(docs: DataFrame, text: str = "text", min_repeat: int = MIN_REPEAT, max_fraction: float = MAX_FRACTION, max_longest: int = MAX_LONGEST, into: str = "rule") -> DataFrame:
    """docs with one more struct column, ``into``: covered, longest, fraction, keep."""
    raw = fresh(docs, "repeats")
    got = docs.withColumn(raw, _judge(min_repeat)(F.col(quoted(text))))
    n = F.greatest(F.coalesce(F.length(F.col(quoted(text))), F.lit(0)), F.lit(1))
    covered, longest = F.col(f"{raw}.covered"), F.col(f"{raw}.longest")
    fraction = F.round(covered / n, 6)
    keep = (fraction <= max_fraction) & (longest <= max_longest)
    return got.select(*own(docs, into), F.struct(covered.alias("covered"), longest.alias("longest"), fraction.alias("fraction"), keep.alias("keep")).alias(into))


@kept_names
def filter_repetitive(docs: DataFrame, text: str = "text", **rules) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    rule = fresh(docs, "rule")
    return repetition(docs, text, into=rule, **rules).where(F.col(f"{rule}.keep")).select(*own(docs))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = repetition(docs)
    return got.select("doc_id", *[F.col(f"rule.{c}").alias(c) for c in ("covered", "longest", "fraction", "keep")])
