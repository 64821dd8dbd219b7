import sqlite3

import pytest

from starlace.errors import GraphDataError
from starlace.sources.graph import Graph

G1 = ([(1, 10), (2, 20), (3, 20)], [(1, 2, 12), (1, 3, 13), (2, 3, 23), (3, 2, 32)])
G2 = ([(1, 1), (3, 2), (4, 2), (5, 3), (6, 3)], [(1, 3, 2), (1, 3, 1), (1, 3, 3), (3, 1, 1), (1, 4, 1), (1, 5, 2), (1, 6, 2)])


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("layout", ["multiple", "single"])
def test_degrees_and_frequency(spark, layout):
    g = Graph.from_rows(spark, *G1, layout)
    assert rows(g.degrees().select("vid", "in_deg", "out_deg")) == [(1, 0, 2), (2, 2, 1), (3, 2, 1)]
    assert [g.frequency(k) for k in (0, 10, 20)] == [0, 1, 2]


def test_neighbours(spark):
    g = Graph.from_rows(spark, *G2)
    assert [tuple(r) for r in g.neighbors(1, 2).where("nid = 3").collect()] == [(3, 2, [1], [1, 2, 3])]
    assert sorted(r.nid for r in g.neighbors(1).collect()) == [3, 4, 5, 6]
    assert rows(g.reduced.neighbors(1, 2).where("nid = 3")) == [(3, 2, [1], [3])]


def test_info_and_doubling(spark):
    g = Graph.from_rows(spark, [(1, 1), (2, 2), (3, 2)], [(1, 2, 12), (1, 3, 13), (2, 3, 23)])
    assert rows(g.info()) == [(3, 3, 2, 3)] and g.doubled.count() == 6
    assert rows(g.label_groups().where("vid = 1")) == [(1, 1, 2, [2, 3])]


def test_isolated_vertices(spark):
    g = Graph.from_rows(spark, [(1, 5), (2, 6), (9, 7)], [(1, 2, 0)])
    assert rows(g.info()) == [(3, 1, 3, 1)] and g.frequency(7) == 0
    assert rows(g.view()[0]) == [(1, 5), (2, 6)]


@pytest.mark.parametrize("layout", ["multiple", "single"])
def test_save_and_load(spark, tmp_path, layout):
    path = f"file://{tmp_path}/g"
    g = Graph.from_rows(spark, *G2, layout).save(path)
    assert g.layout == layout and rows(g.vertices) == sorted(G2[0])
    assert rows(g.view()[1]) == (sorted(G2[1]) if layout == "multiple" else [(1, 3, 3), (1, 4, 1), (1, 5, 2), (1, 6, 2), (3, 1, 1)])
    plan = g.count("(match (vertices (u1 1) (u2 2)) (arcs (u1 u2 1)))")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: []" not in plan and "isnotnull(elabel" in plan.split("PartitionFilters")[1]
    with pytest.raises(Exception):
        Graph.load(spark, f"file://{tmp_path}/nothing")


def test_bad_rows_and_positions(spark):
    v = spark.createDataFrame([("1", "0"), ("2", "1"), (None, "1"), ("x", "1"), ("3", "99999999999")], "a string, b string")
    e = spark.createDataFrame([("1", "2", "0"), ("1", None, "0"), ("1", "2", "y")], "p string, q string, r string")
    g = Graph.from_tables(v, e)
    assert rows(g.vertices) == [(1, 0), (2, 1)] and rows(g.edges) == [(1, 2, 0)]
    with pytest.raises(GraphDataError):
        Graph.from_tables(e.select("p"), e)


def test_last_row_of_a_vertex_counts(spark):
    assert rows(Graph.from_rows(spark, [(1, 5), (1, 3)], []).vertices) == [(1, 3)]
    v = spark.createDataFrame([(1, 3, 1), (1, 5, 0)], "vid long, vlabel int, at int")
    e = spark.createDataFrame([], "src long, dst long, elabel int")
    assert rows(Graph.from_tables(v, e, order="at").vertices) == [(1, 3)]
    assert rows(Graph.from_tables(v.drop("at"), e).vertices) == [(1, 5)]


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "g.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE vertices (vid INT, vlabel INT)")
        db.execute("CREATE TABLE edges (src INT, dst INT, elabel INT)")
        db.executemany("INSERT INTO vertices VALUES (?, ?)", [(1, 9), (2, 20), (3, 20), (1, 10), (None, 1), ("a", 1)])
        db.executemany("INSERT INTO edges VALUES (?, ?, ?)", [*G1[1], (1, None, 3), (1, "x", 3)])
    g = Graph.from_sqlite(spark, path, parts=3)
    assert rows(g.vertices) == sorted(G1[0]) and rows(g.edges) == sorted(G1[1])


def test_command_line(spark, tmp_path, capsys):
    from starlace.cli import main

    v, e = (f"file://{tmp_path}/{x}" for x in ("v", "e"))
    spark.createDataFrame(G1[0], "vid long, vlabel int").write.parquet(v)
    spark.createDataFrame(G1[1], "src long, dst long, elabel int").write.parquet(e)
    out = f"file://{tmp_path}/graph"
    assert main(["createdb", "multiple", "--vertices", v, "--edges", e, out]) == 0
    assert main(["dbinfo", out]) == 0
    assert "3 4 2 4" in capsys.readouterr().out
    assert main(["run", out, "-e", "(match (vertices (u1 10) (u2 20)) (arcs (u1 u2 12)))"]) == 0
    assert "num_rows: 1" in capsys.readouterr().err
    assert main(["run", out, "-e", "(match"]) == 1
