"""Factorized matching: root tuples with a sorted array of images, or just their number, for each class of leaves.

Roots are joined flat (there are few of them); a leaf hangs on its roots. A leaf of one root
needs no array to be counted, only a grouped count. The first leaf of several roots is joined with
them in whatever order is cheapest, so that roots that only it ties together don't multiply; another
is met from the root with the fewest leaves and checked against the others. Both are grouped again. The
count is the sum, over root tuples, of the product of class sizes, each to the power of the
class's number of leaves: nothing is enumerated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import to_column
from ..plans.ast import Expr
from ..plans.pattern import Pattern
from ..plans.planner import leaf, leaf_classes
from ..sources.graph import Graph
from .flat import Chain, Pending, joined
from .pairs import all_of, pair, u, vertex_scan

#: Counts of matches: far beyond 64 bits before they overflow.
COUNT = "decimal(38,0)"


def images(g: Graph, p: Pattern, root: int, n: int, name: str, single: bool = False) -> DataFrame:
    """(u<root>, name): the sorted images of n at each image of the root."""
    return pair(g, p, root, n, single, root).groupBy(u(root)).agg(F.array_sort(F.collect_set(u(n))).alias(name))


def star(g: Graph, pattern, root: int, semantics: str = "homomorphism") -> DataFrame:
    """(root, img_1, img_2, ...): an array for each class of leaves, in the order of their least leaves."""
    from ..plans.pattern import as_pattern
    from .match import prepared

    g, p, single = prepared(g, as_pattern(pattern), semantics)
    df = roots_scan(g, p, root, semantics == "compat", single)
    for k, (n, *_) in enumerate(star_classes(p, root)):
        df = df.join(images(g, p, root, n, f"img_{k + 1}", single), u(root))
    return df.withColumnRenamed(u(root), "root")


def star_classes(p: Pattern, root: int) -> list[list[int]]:
    by: dict = {}
    for n in p.neighbors(root):
        by.setdefault(leaf(p, root, n), []).append(n)
    return sorted(by.values())


def roots_scan(g: Graph, p: Pattern, root: int, compat: bool, single: bool = False) -> DataFrame:
    """(u<root>): candidates; under compat those with enough edges either way."""
    df = vertex_scan(g, p, root)
    if compat:
        deg = (Graph(g.vertices, g.edges, "single", g.labelled) if single else g).degrees()
        df = df.join(deg.where((F.col("vlabel") == p.labels[root]) & (F.col("in_deg") >= p.in_deg(root)) & (F.col("out_deg") >= p.out_deg(root))).select(F.col("vid").alias(u(root))), u(root), "left_semi")
    return df


def _outer(p: Pattern) -> list[Expr]:
    """Constraints that no pair relation applies."""
    return [e for e in p.constraints if len(e.vertices()) > 1 and not (len(e.vertices()) == 2 and tuple(e.vertices()) in p.pairs)]


def can(p: Pattern, roots: list[int]) -> bool:
    """Whether no constraint ties two leaves together."""
    return all(len(e.vertices() - set(roots)) <= 1 for e in _outer(p))


def root_tuples(g: Graph, p: Pattern, roots: list[int], pending: Pending, compat: bool, single: bool, hint: str | None) -> DataFrame | None:
    """(u<root>, ...) of all roots; none for a lone root, which its leaves' relations hold."""
    if not compat:
        return joined(g, p, set(roots), pending, hint)
    df, bound = None, set()
    for r in roots:
        own = roots_scan(g, p, r, True, single)
        for n, *_ in star_classes(p, r) if single else ():  # in the other layout the joins to come are the same test
            own = own.join(pair(g, p, r, n, single, r).select(u(r)).distinct(), u(r), "left_semi")
        near = [o for o in roots if o in bound and (o, r) in p.pairs]
        if df is None:
            df = own
        elif not near:
            df = df.crossJoin(own)
        else:
            for o in near:  # an edge is tested from the earlier root
                step = pair(g, p, o, r, single)
                df = df.join(step.hint(hint) if hint else step, [u(x) for x in (o, r) if x in bound or o != near[0]])
            df = df.join(own, u(r), "left_semi")
        bound.add(r)
    return df


def bare(p: Pattern, roots: list[int]) -> bool:
    """Whether all there is to count beside the roots is one leaf of several roots: its matches are
    enumerated anyway, and nothing is gained by grouping them."""
    some = classes(p, roots)
    return len(some) == 1 and len(some[0]) == 1 and sum((r, some[0][0]) in p.pairs for r in roots) > 1


def classes(p: Pattern, roots: list[int]) -> list[list[int]]:
    """Leaf classes; leaves that an outer constraint names stand alone."""
    named = {n for e in _outer(p) for n in e.vertices()}
    out: list[list[int]] = []
    for some in leaf_classes(p, roots):
        plain = [n for n in some if n not in named]
        out += ([plain] if plain else []) + [[n] for n in some if n in named]
    return sorted(out)


def component(g: Graph, p: Pattern, roots: list[int], counting: bool, compat: bool = False, single: bool = False, hint: str | None = None) -> tuple[DataFrame, list[tuple[list[int], Column]]]:
    """Root tuples, and for each leaf class its leaves and its size (counting) or its images."""
    outer = [] if compat else _outer(p)
    pending = Pending(outer)
    leaves = classes(p, roots) if not compat else leaf_classes(p, roots)
    if not p.pairs:
        return roots_scan(g, p, roots[0], compat, single), []
    near = {some[0]: [r for r in roots if (r, some[0]) in p.pairs] for some in leaves}
    made: dict[tuple, str] = {}
    out: dict[int, Column] = {}
    # leaves of several roots first, while the tuples are narrow
    leaves_in_turn = sorted(leaves, key=lambda some: -len(near[some[0]]))
    along = not compat and bool(leaves) and len(near[leaves_in_turn[0][0]]) > 1  # whether the first is joined among the roots
    df = None if along else root_tuples(g, p, roots, pending, compat, single, hint)
    for some in leaves_in_turn:
        n, by = some[0], near[some[0]]
        late = [e for e in pending.left if n in e.vertices()]
        if len(by) == 1 and not late:
            (r,) = by
            key = (r, leaf(p, r, n))
            if key not in made:
                name = made[key] = f"{'size' if counting else 'img'}_{r}_{n}"
                side = pair(g, p, r, n, single, r).groupBy(u(r)).agg(F.count("*").alias(name)) if counting else images(g, p, r, n, name, single)
                side = side.hint(hint) if hint else side
                df = side if df is None else df.join(side, u(r))
            out[n] = F.col(made[key])
            continue
        chain = Chain(g, p, g.sizes(p.elabels()) if len(by) > 1 else None, hint, single)
        wide, at = df, None
        if along:
            wide, along, late = joined(g, p, {*roots, n}, pending, hint), False, []
        else:
            # each tuple meets its leaves from the root that has the fewest, then the others must have
            # them too; the planner reckons with the same fan
            for k, r in enumerate(sorted(by, key=lambda r: chain.sizes.fan(p, r, n)) if chain.sizes else by):
                if wide is None:
                    wide = chain.pair(r, n, None)
                else:
                    wide, at = chain.add(wide, at, r, n, (r, n) if k else (r,))
        if late:
            wide = wide.where(all_of([to_column(e) for e in late]))
        name = f"{'size' if counting else 'img'}_{n}"
        held = [] if df is None else [c for c in df.columns if c not in {u(r) for r in roots}]
        what = F.count("*") if counting else F.array_sort(F.collect_list(u(n)))
        if not counting and chain.sizes:  # lists don't shrink before they are moved
            wide = wide.select(*[u(r) for r in roots], u(n), *held).repartition(chain.tasks, *[u(r) for r in roots])
        df = wide.groupBy(*[u(r) for r in roots]).agg(*[F.first(c).alias(c) for c in held], what.alias(name))
        out[n] = F.col(name)
    return df, [(some, out[some[0]]) for some in leaves]


def count_of(df: DataFrame, sizes: list[tuple[list[int], Column]], collapse: bool = False) -> DataFrame:
    """(n): the sum of the products. collapse: each class once, whatever its number of leaves."""
    factors = [size.cast(COUNT) for some, size in sizes for _ in (some[:1] if collapse else some)]
    return df.agg(F.coalesce(F.sum(reduce(lambda a, b: (a * b).cast(COUNT), factors, F.lit(1).cast(COUNT))), F.lit(0)).cast(COUNT).alias("n"))


def rows_of(df: DataFrame, p: Pattern, arrays: list[tuple[list[int], Column]]) -> DataFrame:
    """Every match, by exploding the images of each leaf."""
    held = [(some, f"class_{k}") for k, (some, _) in enumerate(arrays)]
    df = df.select("*", *[c.alias(name) for (_, c), (_, name) in zip(arrays, held)])
    for some, name in held:
        for n in some:
            df = df.withColumn(u(n), F.explode(name))
    return df.select(*[u(n) for n in sorted(p.labels)])


def statistics(df: DataFrame) -> DataFrame:
    """Of a star: num_rows, num_eqvs (the root is one), and by class the total and average size."""
    names = [c for c in df.columns if c.startswith("img_")]
    totals = [F.count("*"), *[F.coalesce(F.sum(F.size(c)), F.lit(0)) for c in names]]
    got = df.agg(F.count("*").alias("num_rows"), F.array(*totals).alias("eqv_total_num_vertices"))
    return got.select("num_rows", F.lit(len(names) + 1).cast("bigint").alias("num_eqvs"), "eqv_total_num_vertices", F.when(F.col("num_rows") > 0, F.transform("eqv_total_num_vertices", lambda x: x / F.col("num_rows"))).alias("eqv_avg_num_vertices"))


