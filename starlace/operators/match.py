"""Pattern in, matches or their number out.

semantics "homomorphism" (the default): all constraints hold, the count is the number of rows,
and the result depends on neither roots nor layout. "compat": roots must have enough edges
either way; constraints on vertices that aren't neighbours are dropped, and of several on the
same vertices the last counts; where there are several roots the count takes a class of
interchangeable leaves once; the single layout keeps one label for each direction and tests an
edge from one side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import PlanError
from ..plans import planner
from ..plans.pattern import Pattern, as_pattern
from ..sources.graph import Graph
from . import factorized, flat
from .pairs import u

SEMANTICS = ("homomorphism", "compat")
MODES = ("flat", "factorized")
#: How stars are looked up: by hash or in order.
HINTS = {"hash": "shuffle_hash", "sorted": "merge", None: None}


def prepared(g: Graph, p: Pattern, semantics: str, injective: bool = False) -> tuple[Graph, Pattern, bool]:
    """The graph and the pattern as the semantics reads them, and whether the single layout's test applies."""
    if semantics not in SEMANTICS:
        raise PlanError(f"semantics must be one of {', '.join(SEMANTICS)}")
    compat = semantics == "compat"
    if compat:
        p = p.last_wins()
    if injective:
        p = p.injective()
    single = compat and g.layout == "single"
    return (g.reduced if single else g), p, single


def _roots(g: Graph, p: Pattern, compat: bool) -> list[int]:
    """Under compat results depend on the roots, so they are chosen by its rules; else by cost."""
    if compat or len(p.labels) > 8:
        return planner.decompose(p, g.frequency)
    if len(p.pairs) <= 2:
        return [min(p.labels)]
    return planner.cheapest_roots(p, g.sizes(p.elabels()))


def _parts(g: Graph, p: Pattern, roots: list[int] | None, compat: bool) -> list[tuple[Pattern, list[int]]]:
    """Connected parts and their roots."""
    given = planner.checked_roots(p, roots) if roots is not None else None
    out = []
    for some in p.components():
        part = p.restricted(some)
        mine = [r for r in given if r in some] if given is not None else _roots(g, part, compat)
        out.append((part, mine or [min(some)]))
    if compat and len(out) > 1:
        if given is not None:
            first = next(x for x in out if given[0] in x[0].labels)
        else:
            top = planner.decompose(p, g.frequency)[0]
            first = next(x for x in out if top in x[0].labels)
        if len(first[1]) == 1:  # a lone star: what isn't connected with it is passed over
            return [first]
    return out


def _outer(p: Pattern, parts: list[tuple[Pattern, list[int]]]) -> list:
    """Constraints over several parts, or over none."""
    inside = [set(x.labels) for x, _ in parts]
    return [e for e in p.constraints if not e.vertices() or not any(e.vertices() <= s for s in inside)]


def match(g: Graph, pattern: str | Pattern, semantics: str = "homomorphism", mode: str = "flat", roots: list[int] | None = None, injective: bool = False, index: str | None = None) -> DataFrame:
    """One row for each match, columns u<id> by id; mode "factorized" enumerates from arrays."""
    if mode not in MODES:
        raise PlanError(f"mode must be one of {', '.join(MODES)}")
    compat = semantics == "compat"
    g, p, single = prepared(g, as_pattern(pattern), semantics, injective)
    parts = _parts(g, p, roots, compat)
    df = None
    for part, mine in parts:
        if compat or mode == "factorized" and factorized.can(part, mine) and planner.connected(part, mine):
            got = factorized.rows_of(*_swap(*factorized.component(g, part, mine, False, compat, single, HINTS[index]), part))
        else:
            got = flat.component(g, part, HINTS[index])
        df = got if df is None else df.crossJoin(got)
    if not compat or injective:
        df = flat.Pending(_outer(p, parts)).apply(df, set(p.labels))
    return df.select(*[u(n) for part, _ in parts for n in part.labels]).select(*[u(n) for n in sorted(n for part, _ in parts for n in part.labels)])


def _swap(df: DataFrame, arrays: list, p: Pattern) -> tuple:
    return df, p, arrays


def factors(g: Graph, pattern: str | Pattern, semantics: str = "homomorphism", roots: list[int] | None = None) -> DataFrame:
    """Root columns u<id>, and for each leaf class an array column named for its leaves, c_<id>_<id>."""
    compat = semantics == "compat"
    g, p, single = prepared(g, as_pattern(pattern), semantics)
    parts = _parts(g, p, roots, compat)
    if len(parts) > 1 or not compat and (not factorized.can(*parts[0]) or _outer(p, parts)):
        raise PlanError("this pattern has no factorized form")
    part, mine = parts[0]
    df, arrays = factorized.component(g, part, mine, False, compat, single)
    got = df.select(*[u(r) for r in mine], *[c.alias("c_" + "_".join(map(str, some))) for some, c in arrays])
    return got.where(" AND ".join(f"size(`{c}`) > 0" for c in got.columns[len(mine) :])) if arrays else got


def count(g: Graph, pattern: str | Pattern, semantics: str = "homomorphism", mode: str = "factorized", roots: list[int] | None = None, injective: bool = False, index: str | None = None) -> DataFrame:
    """One row, n. mode "flat" enumerates; "factorized" doesn't, but for constraints that tie leaves."""
    if mode not in MODES:
        raise PlanError(f"mode must be one of {', '.join(MODES)}")
    compat = semantics == "compat"
    g0, (g, p, single) = g, prepared(g, as_pattern(pattern), semantics, injective)
    parts = _parts(g, p, roots, compat)
    if not compat and (_outer(p, parts) or mode == "flat"):
        return match(g0, p, semantics, "flat", roots, False, index).agg(F.count("*").cast(factorized.COUNT).alias("n"))
    out = None
    for part, mine in parts:
        if compat or factorized.can(part, mine) and planner.connected(part, mine) and not factorized.bare(part, mine):
            got = factorized.count_of(*factorized.component(g, part, mine, True, compat, single, HINTS[index]), compat and len(mine) > 1)
        else:
            got = flat.component(g, part, HINTS[index]).agg(F.count("*").cast(factorized.COUNT).alias("n"))
        out = got if out is None else out.crossJoin(got.withColumnRenamed("n", "m")).select((F.col("n") * F.col("m")).cast(factorized.COUNT).alias("n"))
    return out


def explain(g: Graph, pattern: str | Pattern, semantics: str = "homomorphism", roots: list[int] | None = None, **how) -> str:
    g0, (g, p, _) = g, prepared(g, as_pattern(pattern), semantics)
    lines = []
    for part, mine in _parts(g, p, roots, semantics == "compat"):
        keys: dict = {}
        named = [f"(u{s.root}, {keys.setdefault(s.key(), len(keys))})" for s in planner.stars(part, mine)]
        lines += [f"roots: [{', '.join(named)}]", f"leaf classes: {planner.leaf_classes(part, mine)}"]
    plan = count(g0, p, semantics, roots=roots, **how)._jdf.queryExecution().explainString(g0.vertices.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return "\n".join([*lines, plan])
