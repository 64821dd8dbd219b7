"""Flat matching: a chain of equi-joins of pair relations, one row for each match."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.exprs import to_column
from ..plans.ast import Expr
from ..plans.pattern import Pattern
from ..plans.planner import Sizes, join_order
from ..sources.graph import Graph
from . import triangle
from .pairs import all_of, pair, u, vertex_scan

#: Edges from which on a relation isn't left to be broadcast; the most edges of a partition.
SMALL, A_PARTITION = 500_000, 1_000_000


class Pending:
    """Constraints that wait for their vertices."""

    def __init__(self, some: list[Expr]):
        self.left = list(some)

    def apply(self, df: DataFrame, bound: set[int]) -> DataFrame:
        ready = [e for e in self.left if e.vertices() <= bound]
        self.left = [e for e in self.left if e not in ready]
        return df.where(all_of([to_column(e) for e in ready])) if ready else df


def order_of_pairs(g: Graph, p: Pattern, some: set[int]) -> list[tuple[int, int]]:
    """The pairs among the given vertices in the order in which they are joined."""
    pairs = [(a, b) for a, b in sorted(p.pairs) if a < b and a in some and b in some]
    if len(pairs) < 2:
        return pairs
    return join_order(p, pairs, g.sizes(p.elabels()))[1]


class Chain:
    """A join that pair relations are added to one by one. What a relation of some size meets is
    moved by name into as many partitions as the graph asks for, which adaptive execution doesn't
    merge. A relation that both ends are bound of has each key once: a hash table of it serves, and
    the rows that it tests needn't be sorted."""

    def __init__(self, g: Graph, p: Pattern, sizes: Sizes | None, hint: str | None, single: bool = False):
        self.g, self.p, self.sizes, self.hint, self.single = g, p, sizes, hint, single
        most = max((sizes.pair(p, *k) for k in p.pairs), default=0) if sizes else 0
        self.tasks = max(g.tasks, -int(-most // A_PARTITION))

    def pair(self, a: int, b: int, by: tuple[int, ...] | None) -> DataFrame:
        return pair(self.g, self.p, a, b, self.single, by, self.tasks)

    def add(self, df: DataFrame, at: tuple[int, ...] | None, a: int, b: int, keys: tuple[int, ...]) -> tuple[DataFrame, tuple[int, ...] | None]:
        """df, partitioned by at, joined with the relation of a and b by the keys; and what it is partitioned by."""
        large = self.sizes is not None and self.sizes.pair(self.p, a, b) >= SMALL
        step = self.pair(a, b, keys if large or len(keys) == 1 else None)
        if large and at != keys:
            df, at = df.repartition(self.tasks, *[u(n) for n in keys]), keys
        if self.hint or large and len(keys) == 2:
            step = step.hint(self.hint or "shuffle_hash")
        return df.join(step, [u(n) for n in keys]), at if at == keys else None


def component(g: Graph, p: Pattern, hint: str | None = None) -> DataFrame:
    """All matches of a connected pattern: u-columns by id."""
    pending = Pending([e for e in p.constraints if len(e.vertices()) > 1 and not (len(e.vertices()) == 2 and tuple(e.vertices()) in p.pairs)])
    if not p.pairs:
        (n,) = p.labels
        return vertex_scan(g, p, n)
    df = joined(g, p, set(p.labels), pending, hint)
    return df.select(*[u(n) for n in sorted(p.labels)])


def joined(g: Graph, p: Pattern, some: set[int], pending: Pending, hint: str | None = None) -> DataFrame:
    """The pair relations among the given vertices, joined; constraints as soon as they can be. A
    relation that is joined by one vertex is partitioned by it before it is made a set. A triangle
    at the start whose paths are many is found by cells."""
    df, bound, at = None, set(), None
    order = order_of_pairs(g, p, some)
    sizes = g.sizes(p.elabels()) if len(order) > 1 else None
    if not hint and len(order) > 2 and (corners := triangle.corners(p, order, sizes)):
        df, bound, order = pending.apply(triangle.triangles(g, p, *corners, sizes), set(corners)), set(corners), order[3:]
    chain = Chain(g, p, sizes, hint)
    for a, b in order:
        if df is None:
            by = tuple(n for n in (a, b) if len(order) > 1 and n in order[1])
            at = by if len(by) == 1 else None
            df = chain.pair(a, b, at)
        else:
            df, at = chain.add(df, at, a, b, tuple(n for n in (a, b) if n in bound))
        bound |= {a, b}
        df = pending.apply(df, bound)
    return df
