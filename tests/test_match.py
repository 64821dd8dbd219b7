import random

import pytest

from starlace.errors import GraphDataError, PlanError
from starlace.plans import planner
from starlace.plans.pattern import as_pattern
from starlace.plans.parser import parse_expr
from starlace.sources.graph import Graph

from .brute import collapsed, compat_matches, matches

D1 = ({1: 0, 2: 1, 3: 0, 4: 1, 5: 1}, [(1, 2, 0), (3, 4, 0), (3, 5, 0)])
D2 = ({1: 0, 3: 1, 2: 2, 4: 2, 5: 2}, [(1, 2, 0), (1, 4, 0), (1, 5, 0), (3, 2, 0), (3, 4, 0), (1, 3, 9)])
M1 = "(match (vertices (u1 0) (u2 1) (u3 1)) (arcs (u1 u2 0) (u1 u3 0)))"
M3 = "(match (vertices (u1 0) (u3 1) (u2 2) (u4 2)) (arcs (u1 u2 0) (u1 u4 0) (u3 u2 0) (u3 u4 0) (u1 u3 9)))"
ARC = "(match (vertices (u1 0) (u2 1)) (arcs (u1 u2 0)) (where {}))"
G2S = ({1: 1, 3: 2, 4: 2, 5: 3, 6: 3}, [(1, 3, 2), (3, 1, 1), (1, 4, 1), (1, 5, 2), (1, 6, 2)])


def made(spark, data, layout="multiple"):
    return Graph.from_rows(spark, data[0].items(), data[1], layout)


def n(df):
    return int(df.collect()[0][0])


def rows(df):
    return sorted(map(tuple, df.collect()))


CASES = [
    (D1, M1, 5, 4), (D1, M1.replace("arcs", "edges"), 5, 5), (D2, M3, 4, 2), (D1, ARC.format("(and (< 1 u1) (< u1 9))"), 2, 3), (D1, ARC.format("#f"), 0, 3), (D1, M1[:-1] + " (where (< u2 u3)))", 1, 4),
    (({1: 0, 2: 0, 3: 0}, [(1, 2, 0), (2, 3, 0), (3, 1, 0)]), "(match (vertices (u1 0) (u2 0) (u3 0)) (arcs (u1 u2 0) (u2 u3 0) (u3 u1 0)))", 3, 3),
    (({1: 0, 2: 0, 3: 0}, [(a, b, 0) for a in (1, 2, 3) for b in (1, 2, 3) if a != b]), "(match (vertices (u1 0) (u2 0) (u3 0) (u4 0)) (edges (u1 u2 0) (u2 u3 0) (u3 u4 0) (u1 u4 0)))", 18, None),
    (({1: 0, 2: 0, 3: 0}, [(1, 1, 0), (2, 3, 0), (3, 2, 0)]), "(match (vertices (u1 0)) (arcs (u1 u1 0)))", 1, None),
    (({1: 5, 2: 6, 9: 7}, [(1, 2, 0)]), "(match (vertices (u1 6) (u2 5)) (arcs (u2 u1 0)))", 1, 1),
    (({1: 0, 2: 1, 3: 0, 4: 1}, [(1, 2, 0), (3, 4, 0)]), "(match (vertices (u1 0) (u2 1) (u3 0)) (arcs (u1 u2 0)))", 4, 2),
]
for k, data in ((0, [(1, 2, 1)]), (1, [(1, 2, 1), (1, 2, 1)]), (1, [(1, 2, 1), (2, 1, 1)])):
    CASES.append((({1: 1, 2: 2}, data), "(match (vertices (u1 1) (u2 2)) (arcs (u1 u2 1)) (edges (u1 u2 1)))", k, k))


@pytest.mark.parametrize("case", range(len(CASES)))
def test_fixtures(spark, case):
    data, text, want, compat = CASES[case]
    g = made(spark, data)
    assert rows(g.match(text)) == matches(as_pattern(text), *data)
    assert n(g.count(text)) == want == n(g.count(text, mode="flat")) == g.match(text, mode="factorized").count()
    if compat is not None:
        assert n(g.count(text, semantics="compat")) == compat
    if case == 2:
        assert g.match(text, semantics="compat").count() == 4


def test_single_layout(spark):
    text = "(match (vertices (u1 1) (u2 2)) (edges (u1 u2 2)))"
    g = made(spark, G2S, "single")
    assert n(g.count(text)) == 1
    assert n(g.count(text, semantics="compat", roots=[1])) == 0
    assert n(g.count(text, semantics="compat", roots=[2])) == 1
    two = ({1: 1, 2: 2}, [(1, 2, 1), (1, 2, 2)])
    both = "(match (vertices (u1 1) (u2 2)) (arcs (u1 u2 1) (u1 u2 2)))"
    one, other = both.replace(" (u1 u2 2)", ""), both.replace("(u1 u2 1) ", "")
    assert [n(made(spark, two).count(t)) for t in (both, one, other)] == [1, 1, 1]
    assert [n(made(spark, two, "single").count(t, semantics="compat")) for t in (both, one, other)] == [0, 0, 1]


def test_roots_must_cover(spark):
    g = made(spark, ({1: 0, 2: 1, 3: 2}, [(1, 2, 0), (1, 3, 0)]))
    with pytest.raises(PlanError):
        g.count("(match (vertices (u1 0) (u2 1) (u3 2)) (arcs (u1 u2 0) (u1 u3 0) (u2 u3 0)))", roots=[1])
    with pytest.raises(PlanError):
        g.count(M1, semantics="other")


G5 = ({1: 0, 2: 1, 3: 1, 4: 2, 5: 0, 6: 1, 7: 1, 8: 2}, [(1, 2, 0), (1, 3, 0), (1, 4, 0), (5, 6, 0), (5, 7, 0), (5, 8, 0)])
G5P = "(match (vertices (u1 0) (u2 1) (u3 2) (u4 1) (u5 0)) (arcs (u1 u2 0) (u1 u3 0) (u5 u2 0) (u5 u4 0)))"
G6 = ({1: 1, 2: 2, 3: 3, 4: 4, 11: 1, 14: 4}, [(1, 2, 0), (2, 3, 0), (3, 4, 0), (3, 14, 0), (11, 2, 0)])
G6P = "(match (vertices (u1 1) (u2 2) (u3 3) (u4 4)) (arcs (u1 u2 0) (u2 u3 0) (u3 u4 0)))"


def test_stars(spark):
    g = made(spark, G5)
    assert rows(g.star(G5P, 1)) == [(1, [2, 3], [4]), (5, [6, 7], [8])]
    assert rows(g.star(G5P, 5)) == [(1, [2, 3]), (5, [6, 7])]
    assert n(g.count(G5P)) == 8
    h = made(spark, G6)
    assert rows(h.star(G6P, 2)) == [(2, [1, 11], [3])] and rows(h.star(G6P, 3)) == [(3, [2], [4, 14])]
    assert n(h.count(G6P)) == 4
    from starlace.operators.factorized import statistics

    got = statistics(g.star(G5P, 1)).collect()[0]
    assert (got.num_rows, got.num_eqvs, got.eqv_total_num_vertices, got.eqv_avg_num_vertices) == (2, 3, [2, 4, 2], [1.0, 2.0, 1.0])


def random_case(r):
    size = r.randint(2, 7)
    vertices = {v: r.randint(0, 1) for v in range(1, size + 1)}
    edges = [(r.randint(1, size), r.randint(1, size), r.randint(0, 1)) for _ in range(r.randint(1, 16))]
    k = r.randint(2, 4)
    arcs, und = set(), set()
    for b in range(2, k + 1):
        a = r.randint(1, b - 1)
        (und if r.random() < 0.4 else arcs).add((a, b, r.randint(0, 1)) if r.random() < 0.5 else (b, a, r.randint(0, 1)))
    for _ in range(r.randint(0, 2)):
        a, b = r.sample(range(1, k + 1), 2)
        (und if r.random() < 0.4 else arcs).add((a, b, r.randint(0, 1)))
    und = {(min(a, b), max(a, b), x) for a, b, x in und}
    atom = lambda: f"({r.choice(['<', '>=', '=', '!='])} {r.choice([f'u{r.randint(1, k)}', f'(% u{r.randint(1, k)} {r.choice([2, 3, -2])})'])} {r.choice([f'u{r.randint(1, k)}', str(r.randint(0, 7))])})"
    where = ""
    if r.random() < 0.7:
        text = atom()
        for _ in range(r.randint(0, 2)):
            text = f"({r.choice(['and', 'and', 'or'])} {text} {r.choice([atom(), f'(not {atom()})', f'(not (and {atom()} {atom()}))'])})"
        where = f" (where {text})"
    text = "(match (vertices " + " ".join(f"(u{u} {r.randint(0, 1)})" for u in range(1, k + 1)) + ")"
    for name, some in (("arcs", arcs), ("edges", und)):
        if some:
            text += f" ({name} " + " ".join(f"(u{a} u{b} {x})" for a, b, x in sorted(some)) + ")"
    return vertices, edges, text + where + ")"


@pytest.mark.parametrize("seed", range(14))
def test_random(spark, seed):
    r = random.Random(seed)
    vertices, edges, text = random_case(r)
    p = as_pattern(text)
    g = Graph.from_rows(spark, vertices.items(), edges)
    want = matches(p, vertices, edges)
    assert rows(g.match(text)) == want, text
    assert n(g.count(text)) == len(want), text
    assert rows(g.match(text, mode="factorized")) == want, text
    freq = lambda k: len({v for e in edges for v in e[:2] if vertices[v] == k})
    roots = planner.decompose(p.last_wins(), freq)
    compat = compat_matches(p, vertices, edges, roots)
    assert rows(g.match(text, semantics="compat")) == compat, text
    assert n(g.count(text, semantics="compat")) == (collapsed(p, compat, planner.leaf_classes(p.last_wins(), roots)) if len(roots) > 1 else len(compat)), text
    cover = sorted(p.labels)
    assert n(g.count(text, roots=cover)) == len(want), text


def test_injective(spark):
    g = made(spark, D1)
    assert g.match(M1, injective=True).count() == 2 == n(g.count(M1, injective=True))


def test_index_types_agree(spark):
    g = made(spark, D2)
    assert n(g.count(M3, index="hash")) == n(g.count(M3, index="sorted")) == 4


def test_division_by_zero_is_guarded(spark):
    g = made(spark, ({0: 0, 1: 1}, [(0, 1, 0)]))
    assert g.match(ARC.format("(or (= u1 0) (= (% u2 u1) 0))")).count() == 1
    with pytest.raises(Exception, match="REMAINDER_BY_ZERO|zero"):
        g.match(ARC.format("(= (% u2 u1) 0)")).collect()


def test_programmatic_pattern(spark):
    p = as_pattern(M1).add_constraint(parse_expr("(!= u2 u3)"))
    assert made(spark, D1).match(p).count() == 2


def test_explain(spark):
    text = made(spark, D2).explain(M3)
    assert "roots: [(u1" in text and "leaf classes: [[2, 4]]" in text and "Physical Plan" in text


def test_errors(spark):
    with pytest.raises(GraphDataError):
        made(spark, D1, "csr")
    with pytest.raises(GraphDataError):
        Graph.from_rows(spark, [(1, 0)], [(1, 2, 0)]).check()
