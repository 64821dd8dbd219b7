"""Pair relations: which pairs of data vertices two adjacent pattern vertices can have.

A match maps vertices, and edges are existence tests, so a pair relation is a set: duplicates
are gone before the first join.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import to_column
from ..plans.pattern import Pattern
from ..sources.graph import Graph


def u(n: int) -> str:
    return f"u{n}"


def all_of(some: list[Column]) -> Column:
    return reduce(and_, some) if some else F.lit(True)


def vertex_scan(g: Graph, p: Pattern, n: int, compat: bool = False) -> DataFrame:
    """(u<n>): vertices with the label, the self-loops and the constraints of n."""
    got = g.with_label(p.labels[n]).select(F.col("vid").alias(u(n)))
    for k in sorted(p.loops.get(n, ())):
        got = got.join(_loop(g, p, n, k), u(n), "left_semi")
    return got.where(all_of([to_column(e) for e in p.on_vertex(n)]))


def _loop(g: Graph, p: Pattern, n: int, k: int) -> DataFrame:
    return g.labelled.where((F.col("elabel") == k) & (F.col("src") == F.col("dst")) & (F.col("slabel") == p.labels[n])).select(F.col("src").alias(u(n)))


def pair(g: Graph, p: Pattern, a: int, b: int, single: bool = False, by: int | tuple[int, ...] | None = None, tasks: int | None = None) -> DataFrame:
    """(u<a>, u<b>), distinct, with all that concerns the two alone. single: as the single layout
    tests it, seen from a. by: partitioned by that vertex, or those, from the start, so that what is
    grouped or joined by it later isn't moved again; in g.tasks partitions or as many as told, so that
    none grows with the graph. A saved graph has each edge once, as others have those of some labels, so that the
    pairs of one arc are a set already and nothing is moved for that."""
    want, la, lb = p.pairs[a, b], p.labels[a], p.labels[b]
    e = g.counted
    labels = sorted(want.labels())
    out = lambda some: e.where((F.col("slabel") == la) & (F.col("dlabel") == lb) & F.col("elabel").isin(some)).select(F.col("src").alias(u(a)), F.col("dst").alias(u(b)), F.lit(True).alias("out"), "elabel", "times")
    back = lambda some: e.where((F.col("slabel") == lb) & (F.col("dlabel") == la) & F.col("elabel").isin(some)).select(F.col("dst").alias(u(a)), F.col("src").alias(u(b)), F.lit(False).alias("out"), "elabel", "times")
    keys = [u(a), u(b)]
    at = keys if by is None else [u(by)] if isinstance(by, int) else [u(n) for n in by]
    moved = lambda df: df.repartition(tasks or g.tasks, *at)
    if single:
        some = out(sorted(want.outgoing)).unionByName(back(sorted(want.incoming | want.either)))
        has = lambda way, of: F.coalesce(F.max(F.when(F.col("out") == F.lit(way), F.col("elabel").isin(sorted(of)).cast("int"))), F.lit(0)) if of else F.lit(0)
        score = has(False, want.incoming) + has(True, want.outgoing) + has(False, want.either)
        got = moved(some).groupBy(*keys).agg(score.alias("score")).where(F.col("score") == want.size()).select(*keys)
    elif want.size() == 1:
        if not want.either:
            got = (out if want.outgoing else back)(labels).select(*keys)
            got = (got if by is None else moved(got)) if g.once or g.sets.issuperset(labels) else moved(got).distinct()
        else:
            got = moved(out(labels).unionByName(back(labels)).select(*keys)).distinct()
    else:
        # one pass over the labels in question; an edge for either way must not be one that an arc needs
        some = moved(out(sorted(want.outgoing | want.either)).unionByName(back(sorted(want.incoming | want.either))))
        times = lambda way, k: F.coalesce(F.sum(F.when((F.col("out") == F.lit(way)) & (F.col("elabel") == k), F.col("times"))), F.lit(0))
        tests = [(times(False, k) >= 1) for k in sorted(want.incoming)] + [(times(True, k) >= 1) for k in sorted(want.outgoing)]
        tests += [(times(False, k) + times(True, k) - int(k in want.incoming) - int(k in want.outgoing)) >= 1 for k in sorted(want.either)]
        got = some.groupBy(*keys).agg(all_of(tests).alias("ok")).where("ok").select(*keys)
    for n in (a, b):
        for k in sorted(p.loops.get(n, ())):
            got = got.join(_loop(g, p, n, k), u(n), "left_semi")
    own = p.on_vertex(a) + p.on_vertex(b) + p.on_pair(a, b)
    return got.where(all_of([to_column(x) for x in own])) if own else got
