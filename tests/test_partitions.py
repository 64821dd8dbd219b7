"""What one task holds doesn't follow the tables: the number of partitions does."""

import collections
import glob
import os

import pytest

import __spark_entry__ as driver
from starlace.operators import flat, match
from starlace.sources import shared
from starlace.sources.graph import Graph
from starlace.sources.testgraph import graph

SF = "/root/testdata/sf0.001"


@pytest.fixture
def small_tasks(spark, monkeypatch):
    """As if the tables were large: the number of partitions that they ask for."""
    monkeypatch.setattr(shared, "A_TASK", 2048)
    monkeypatch.setattr(flat, "SMALL", 0)
    n = shared.tasks(spark.read.parquet(f"{SF}/lineitem.parquet"))
    assert n > 30
    return n


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def by_sql(name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    run = con.execute(driver.oracle_sql()[name])
    columns = [d[0] for d in run.description]
    return collections.Counter(tuple(str(r[columns.index(c)]) for c in sorted(columns)) for r in run.fetchall())


def rows(df):
    return collections.Counter(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())


def test_roots_that_only_a_leaf_ties_together_dont_multiply(spark):
    """Customers and suppliers of a nation are joined through their orders, not with each other."""
    vertices = {1000: 1} | {k: 2 for k in range(300)} | {2000 + k: 3 for k in range(300)} | {5000 + k: 5 for k in range(300)}
    edges = [e for k in range(300) for e in ((k, 1000, 1), (2000 + k, 1000, 2), (k, 5000 + k, 3), (5000 + k, 2000 + (7 * k) % 300, 5))]
    from starlace import queries

    df = match.factors(Graph.from_rows(spark, vertices.items(), edges), queries.LOCAL_SUPPLIERS, roots=[1, 4, 3])
    joins = [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner, (u" in line]
    assert joins and all("u1#" in j or "u2#" in j or "u3#" in j for j in joins)
    assert sorted(tuple(r) for r in df.select("u1", "u3", "u4").collect()) == sorted((k, 2000 + (7 * k) % 300, 1000) for k in range(300))


def test_a_saved_graph_has_files_as_many_as_its_edges_ask_for(spark, small_tasks, tmp_path):
    """32 runs of a label were all there were, sorted in one task each."""
    g = graph(spark, SF, "single")
    saved = g.save(f"file://{tmp_path}/g")
    assert len(glob.glob(f"{tmp_path}/g/edges/elabel=4/*/*/*.parquet")) > 32
    assert sorted(saved.edges.collect()) == sorted(g.reduced.edges.collect())


#: Query, and the partitions of the stages that held the most, in multiples of what the input asks for.
FOLLOW = [
    ("a4_join_count_flat", 1),  # F4
    ("s8_single_layout", 4),  # F5
    ("j8_leaf_intersection", 1),  # F6
    ("j7_intersection", 2),  # F7
    ("a2_join_count", 1),  # F8
    ("a6_distinct_labels", 2),  # F9
    ("s15_info", 2),  # F10
    ("a3_star_count_flat", 1),  # F11
    ("compat_collapsed_count", 1),  # F12
    ("a5_group_by", 1),  # F13
    ("s13_label_frequency", 1),  # F15
    ("p6_either_way", 1),  # F16
]


@pytest.mark.parametrize("name, times", FOLLOW)
def test_partitions_follow_the_input(spark, small_tasks, name, times):
    df = driver.queries()[name](spark, SF)
    got = rows(df)
    plan = plan_of(df)
    assert f", {times * small_tasks}), REPARTITION_BY_NUM" in plan
    if name in ("a2_join_count", "a4_join_count_flat", "j8_leaf_intersection", "compat_collapsed_count"):
        assert "ShuffledHashJoin" in plan  # rows that are tested by a set aren't sorted for it
    assert got == by_sql(name)


def test_the_frequency_of_a_label_reads_its_edges_alone(spark, monkeypatch):
    """to choose between customers and nations, all edges of the graph were made."""
    monkeypatch.setattr(Graph, "label_frequency", lambda g: pytest.fail("all labels are counted"))
    g = graph(spark, SF)
    plan = g.connected_vertices().where("vlabel = 2")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_partkey" not in plan and "l_orderkey" not in plan
    assert rows(driver.queries()["compat_last_constraint"](spark, SF)) == by_sql("compat_last_constraint")
    assert (g.frequency(1), g.frequency(99)) == (25, 0)
