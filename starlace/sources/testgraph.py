"""The relational test tables as a graph.

vid = vlabel * 10,000,000 + key. Vertices: 0 region, 1 nation, 2 customer, 3 supplier, 4 part,
5 order, 6 user. Edges: 0 nation-region, 1 customer-nation, 2 supplier-nation, 3 customer-order,
4 order-part, 5 order-supplier (both with repeats), 6 supplier-part, 7 part-part of one order,
smaller key first, 8 a ring of users. The labels of an edge's ends are known from its kind, so
no join attaches them, and a filter on the edge label leaves one branch of the union.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import Graph
from .shared import tasks

BASE = 10_000_000
_TABLES = ((0, "region", "r_regionkey"), (1, "nation", "n_nationkey"), (2, "customer", "c_custkey"), (3, "supplier", "s_suppkey"), (4, "part", "p_partkey"), (5, "orders", "o_orderkey"))


def _id(label: int, key: str):
    return (F.lit(label * BASE).cast("bigint") + F.col(key).cast("bigint"))


def graph(spark: SparkSession, sf_dir: str, layout: str = "multiple") -> Graph:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    users = read("events").select("user_id").dropna().distinct()
    vertices = [read(t).select(_id(k, key).alias("vid"), F.lit(k).alias("vlabel")) for k, t, key in _TABLES]
    vertices.append(users.select(_id(6, "user_id").alias("vid"), F.lit(6).alias("vlabel")))
    line = read("lineitem")

    def edges(label: int, df: DataFrame, a: int, src: str, b: int, dst: str) -> DataFrame:
        return df.select(_id(a, src).alias("src"), F.lit(a).alias("slabel"), _id(b, dst).alias("dst"), F.lit(b).alias("dlabel"), F.lit(label).alias("elabel"))

    n = tasks(line)
    # an order's parts meet in one row: moved once, neither joined nor sorted by part
    parts = line.select("l_orderkey", "l_partkey").dropna().repartition(n, "l_orderkey").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("some"))
    repeated = parts.select(F.explode("some").alias("l_partkey"), "some").select("l_partkey", F.explode("some").alias("other")).where("l_partkey < other")
    together = repeated.repartition(2 * n, "l_partkey", "other").distinct()
    supplied = line.select("l_suppkey", "l_partkey")
    ring = users.crossJoin(users.agg(F.count("*").alias("n"))).select("user_id", ((F.col("user_id") + 1) % F.col("n")).alias("next"))
    few = [
        edges(0, read("nation"), 1, "n_nationkey", 0, "n_regionkey"), edges(1, read("customer"), 2, "c_custkey", 1, "c_nationkey"), edges(2, read("supplier"), 3, "s_suppkey", 1, "s_nationkey"),
        edges(3, read("orders"), 2, "o_custkey", 5, "o_orderkey"), edges(4, line, 5, "l_orderkey", 4, "l_partkey"), edges(5, line, 5, "l_orderkey", 3, "l_suppkey"),
        edges(8, ring, 6, "user_id", 6, "next"),
    ]
    more = lambda s, p: [edges(6, s, 3, "l_suppkey", 4, "l_partkey"), edges(7, p, 4, "l_partkey", 4, "other")]
    labelled = reduce(DataFrame.unionByName, few + more(supplied.repartition(n, "l_suppkey", "l_partkey").distinct(), together))
    g = Graph(reduce(DataFrame.unionByName, vertices), labelled.select("src", "dst", "elabel"), layout, labelled)
    g.tasks, g.sets, g.rough = n, frozenset((6, 7)), reduce(DataFrame.unionByName, few + more(supplied, repeated))
    return g


_V = {k: f"SELECT {k * BASE} + CAST({key} AS BIGINT) AS vid, {k} AS vlabel FROM {t}" for k, t, key in _TABLES} | {6: f"SELECT DISTINCT {6 * BASE} + user_id AS vid, 6 AS vlabel FROM events WHERE user_id IS NOT NULL"}


def _e(label: int, a: int, src: str, b: int, dst: str, table: str) -> str:
    return f"SELECT {a * BASE} + CAST({src} AS BIGINT) AS src, {b * BASE} + CAST({dst} AS BIGINT) AS dst, {label} AS elabel FROM {table}"


_E = {
    0: _e(0, 1, "n_nationkey", 0, "n_regionkey", "nation"), 1: _e(1, 2, "c_custkey", 1, "c_nationkey", "customer"), 2: _e(2, 3, "s_suppkey", 1, "s_nationkey", "supplier"),
    3: _e(3, 2, "o_custkey", 5, "o_orderkey", "orders"), 4: _e(4, 5, "l_orderkey", 4, "l_partkey", "lineitem"), 5: _e(5, 5, "l_orderkey", 3, "l_suppkey", "lineitem"),
    6: _e(6, 3, "l_suppkey", 4, "l_partkey", "(SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)"),
    7: _e(7, 4, "a", 4, "b", "(SELECT DISTINCT x.l_partkey AS a, y.l_partkey AS b FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey)"),
    8: _e(8, 6, "user_id", 6, "next", "(SELECT user_id, (user_id + 1) % (SELECT count(DISTINCT user_id) FROM events) AS next FROM (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL))"),
}


def cte(elabels: set[int] | None = None) -> str:
    """WITH v, e and ed (e without repeats), of the given edge labels."""
    e = [_E[k] for k in sorted(_E if elabels is None else elabels)]
    return f"WITH v AS ({' UNION ALL '.join(_V.values())}), e AS ({' UNION ALL '.join(e)}), ed AS (SELECT DISTINCT * FROM e)"
