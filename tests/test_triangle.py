import random

import numpy as np
import pytest

from starlace import queries
from starlace.operators import triangle
from starlace.sources.graph import Graph

from .brute import matches
from starlace.plans.pattern import as_pattern

SIDES = "(match (vertices (u1 0) (u2 1) (u3 1)) (arcs (u1 u2 0) (u3 u2 1) (u1 u3 0)))"


def pairs(some):
    return tuple(np.array([x[k] for x in sorted(some)], np.int64) for k in (0, 1))


@pytest.mark.parametrize("seed", range(6))
def test_triangles_of_arrays(seed):
    """From whichever corner the paths are fewest, in stretches of one path and of many."""
    r = random.Random(seed)
    wide = [(3, 30, 30), (30, 3, 30), (30, 30, 3)][seed % 3]
    ab, bc, ac = ({(r.randrange(wide[x]), r.randrange(wide[y]) + 10**12) for _ in range(150)} for x, y in ((0, 1), (1, 2), (0, 2)))
    ab = {(a, b - 10**12) for a, b in ab}
    bc = {(b, c - 5) for b, c in bc}
    ac = {(a, c - 5) for a, c in ac}
    want = sorted((a, b, c) for a, b in ab for x, c in bc if x == b and (a, c) in ac)
    for stretch in (1, 7, 10**6):
        got = [row for found in triangle.triangles_of(pairs(ab), pairs(bc), pairs(ac), stretch) for row in zip(*(x.tolist() for x in found))]
        assert sorted(got) == want and want


def test_blocks_hold_any_ids():
    for a, b in (([5], [-7]), ([-(2**62), -3, -3, 2**62], [9, -1, 2**40, 0]), ([1, 1, 2], [7, 8, 300])):
        got = triangle.unpack_block(triangle.pack_block(np.array(a), np.array(b)), len(a))
        assert [x.tolist() for x in got] == [a, b]


def test_cells_follow_the_pairs_where_ids_are_near_each_other():
    """60 graphs side by side: what is moved stays near the pairs themselves, and no cell has many."""
    near = np.diag(np.full(64, 1000))
    k, cells = triangle.plan_cells([near, near, near], 64, 5000)
    assert k == 64 and [tuple(c) for c in cells] == [(n, n, n) for n in range(64)]
    every = np.full((64, 64), 100)
    k, cells = triangle.plan_cells([every, every, every], 64, 3 * 64 * 64 * 100 // 20)
    assert len(cells) == k**3 and k < 8
    assert len(triangle.plan_cells([near, every * 0, every], 64, 5000)[1]) == 0


@pytest.mark.parametrize("seed", range(3))
def test_a_triangle_by_cells(spark, monkeypatch, seed):
    """Other labels, arcs against the ids, a constraint over all three."""
    monkeypatch.setattr(triangle, "PATHS", 0)
    monkeypatch.setattr(triangle, "TIMES", 0)
    r = random.Random(seed)
    vertices = {v: r.randint(0, 1) for v in range(1, 25)}
    edges = [(r.randint(1, 24), r.randint(1, 24), r.randint(0, 1)) for _ in range(260)]
    g = Graph.from_rows(spark, vertices.items(), edges)
    for text in (SIDES, SIDES[:-1] + " (where (< (% u1 5) (% (% u2 u3) 4))))"):
        want = matches(as_pattern(text), vertices, edges)
        df = g.match(text)
        assert "MapInArrow" in df._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(tuple, df.collect())) == want and want
        assert int(g.count(text).collect()[0][0]) == len(want)


def test_the_part_triangles_go_by_cells_at_size(spark, monkeypatch):
    """Paths of two pairs are 20 times the pairs: they were all moved, 33 GB of them on 1 GB."""
    from starlace.sources.testgraph import graph

    g = graph(spark, "/root/testdata/sf0.001")
    want = g.count(queries.TRIANGLE).collect()
    monkeypatch.setattr(triangle, "PATHS", 1000)
    monkeypatch.setattr(triangle, "TIMES", 1)
    df = g.count(queries.TRIANGLE)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join Inner" not in plan.replace("rightHint=(strategy=broadcast)", "").split("MapInArrow")[0]
    assert df.collect() == want
