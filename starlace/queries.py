"""One query, and its SQL, for each operator of the inventory, over the test graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import factorized, match
from .plans import sql
from .plans.pattern import Pattern
from .plans.parser import parse_expr
from .sources.graph import Graph
from .sources.shared import shared_path
from .sources.testgraph import cte, graph

LOCAL_SUPPLIERS = "(match (vertices (u1 2) (u2 5) (u3 3) (u4 1)) (arcs (u1 u2 3) (u2 u3 5) (u1 u4 1) (u3 u4 2)))"
CUSTOMER = "(match (vertices (u1 2) (u2 1)) (arcs (u1 u2 1)) (where {}))"
TRIANGLE = "(match (vertices (u1 4) (u2 4) (u3 4)) (arcs (u1 u2 7) (u2 u3 7) (u1 u3 7)))"
STAR = "(match (vertices (u1 5) (u2 4) (u3 4) (u4 3)) (arcs (u1 u2 4) (u1 u3 4) (u1 u4 5)))"
ORDER_STAR = "(match (vertices (u1 2) (u2 5) (u3 5) (u4 1)) (arcs (u1 u2 3) (u1 u3 3) (u1 u4 1)))"
RECTANGLE = "(match (vertices (u1 3) (u2 4) (u3 3) (u4 4)) (arcs (u1 u2 6) (u3 u2 6) (u3 u4 6) (u1 u4 6)) (where (and (< u1 u3) (and (< u1 30000003) (< u3 30000006)))))"
DIAMOND = "(match (vertices (u1 5) (u2 4) (u3 4) (u4 3)) (arcs (u1 u2 4) (u1 u3 4) (u4 u2 6) (u4 u3 6) (u1 u4 5)))"
RING = "(match (vertices (u1 6) (u2 6) (u3 6)) (arcs (u1 u2 8) (u2 u3 8)))"


def _n(df: DataFrame) -> DataFrame:
    return df.select(F.col("n").cast("bigint").alias("n"))


_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def _add(name: str, run: Callable[[Graph], DataFrame], text: str, elabels: set[int] | None = None, layout: str = "multiple") -> None:
    _QUERIES[name] = (lambda s, d: run(graph(s, d, layout)), f"{cte(elabels)} {text}")


def _rows(name: str, pattern, **how) -> None:
    _add(name, lambda g: g.match(pattern, **how), sql.rows(pattern), sql.elabels(pattern))


def _count(name: str, pattern, **how) -> None:
    _add(name, lambda g: _n(g.count(pattern, **how)), sql.count(pattern), sql.elabels(pattern))


# The language and its expressions
_rows("q_local_suppliers", LOCAL_SUPPLIERS)
for _name, _where in {
    "e1_vertex": "(< u2 u1)", "e2_integer": "(>= u1 20000010)", "e3_boolean": "#t", "e4_and": "(and (< u1 20000100) (>= u1 20000010))", "e5_or": "(or (< u1 20000010) (>= u2 10000020))", "e6_not": "(not (and (< u1 20000100) (>= u2 10000005)))",
    "e7_less": "(< u1 20000050)", "e8_not_less": "(>= u2 10000015)", "e9_equal": "(= u2 10000003)", "e10_unequal": "(!= u2 10000003)", "e11_remainder": "(= (% u1 7) 3)",
}.items():
    _rows(_name, CUSTOMER.format(_where))
_rows("e11_remainder_negative", CUSTOMER.format("(and (= (% -7 3) -1) (= (% u1 -7) 3))"))
_rows("q4_undirected", "(match (vertices (u1 1) (u2 2)) (edges (u1 u2 1)) (where (< u2 20000200)))")
_rows("q3_q4_arcs_and_edges", "(match (vertices (u1 2) (u2 5) (u3 1)) (arcs (u1 u2 3)) (edges (u3 u1 1)) (where (< u1 20000100)))")
_rows("q12_pattern_api", Pattern().add_vertex(1, 3).add_vertex(2, 1).add_arc(1, 2, 2).add_edge_constraint(1, 2, parse_expr("(and (< u2 10000020) (= (% u1 2) 0))")))

# Predicates
_rows("p1_root_constraint", "(match (vertices (u1 2) (u2 5) (u3 1)) (arcs (u1 u2 3) (u1 u3 1)) (where (< u1 20000040)))")
_rows("p2_neighbour_constraint", "(match (vertices (u1 2) (u2 5) (u3 1)) (arcs (u1 u2 3) (u1 u3 1)) (where (and (< u2 50000500) (= (% u3 2) 1))))")
_rows("p3_edge_constraint", "(match (vertices (u1 5) (u2 4)) (arcs (u1 u2 4)) (where (= (% u1 100) (% u2 100))))")
_count("p5_label_presence", "(match (vertices (u1 3) (u2 1) (u3 4)) (arcs (u1 u2 2) (u1 u3 6)))")
_rows("p6_pair_many_labels", "(match (vertices (u1 5) (u2 3) (u3 4)) (arcs (u1 u2 5) (u1 u3 4) (u2 u3 6)) (where (< u1 50000200)))")
_count("p6_arc_and_edge_one_label", "(match (vertices (u1 5) (u2 4)) (arcs (u1 u2 4)) (edges (u1 u2 4)))")
_count("p6_either_way", "(match (vertices (u1 4) (u2 4)) (edges (u1 u2 7)))")
_rows("p9_early_rejection", "(match (vertices (u1 2) (u2 5) (u3 4)) (arcs (u1 u2 3) (u2 u3 4)) (where (< u3 40000005)))")
_rows("p10_global_constraint", "(match (vertices (u1 5) (u2 4) (u3 3)) (arcs (u1 u2 4) (u1 u3 5)) (where (= (% u2 50) (% u3 50))))")
_rows("p10_constant_false", CUSTOMER.format("#f"))

# Joins
_add("j1_star", lambda g: g.star(ORDER_STAR, 1).select("root", *[F.array_join(c, ",").alias(c) for c in ("img_1", "img_2")]),
     "SELECT a.src AS root, string_agg(DISTINCT a.dst::VARCHAR, ',' ORDER BY a.dst::VARCHAR) AS img_1, any_value(b.dst)::VARCHAR AS img_2 FROM ed a JOIN ed b ON a.src = b.src AND b.elabel = 1 WHERE a.elabel = 3 GROUP BY a.src", {1, 3})
_count("j2_label_merge", "(match (vertices (u1 1) (u2 2) (u3 3) (u4 0)) (arcs (u2 u1 1) (u3 u1 2) (u1 u4 0)))")
_count("j3_hash_lookup", LOCAL_SUPPLIERS, index="hash")
_count("j4_sorted_lookup", LOCAL_SUPPLIERS, index="sorted")
_rows("j5_multi_star_join", RECTANGLE)
_rows("j6_multi_star_rows", RECTANGLE, mode="factorized")
_rows("j7_intersection", TRIANGLE.replace("(u1 u3 7)))", "(u1 u3 7)) (where (< u3 40000150)))"), mode="factorized")
_add("j8_leaf_intersection", lambda g: match.factors(g, DIAMOND, roots=[1, 4]).select("u1", "u4", F.array_join("c_2_3", ",").alias("parts")),
     "SELECT u1, u4, string_agg(u2::VARCHAR, ',' ORDER BY u2) AS parts FROM (SELECT DISTINCT s.src AS u1, s.dst AS u4, o.dst AS u2 FROM ed s JOIN ed o ON s.src = o.src AND o.elabel = 4 JOIN ed x ON x.src = s.dst AND x.dst = o.dst AND x.elabel = 6 WHERE s.elabel = 5) GROUP BY u1, u4", {4, 5, 6})
_rows("j9_product_of_leaves", ORDER_STAR.replace("(u1 u4 1)))", "(u1 u4 1)) (where (< u1 20000030)))"), mode="factorized")
_count("j10_edges_are_tests", "(match (vertices (u1 5) (u2 4)) (arcs (u1 u2 4)))")
_count("j11_theta", "(match (vertices (u1 4) (u2 4)) (arcs (u1 u2 7)) (where (< (% u1 13) (% u2 11))))")
_rows("j12_components", "(match (vertices (u1 1) (u2 0) (u3 3) (u4 1)) (arcs (u1 u2 0) (u3 u4 2)) (where (and (< u3 30000010) (= u2 0))))")
_rows("j13_self_loop", "(match (vertices (u1 6) (u2 6)) (arcs (u1 u2 8) (u1 u1 8)))")
_rows("q_ring_path", RING)
_rows("q_injective", Pattern(labels={1: 4, 2: 4}).add_edge(1, 2, 7).injective().add_constraint(parse_expr("(< u1 40000020)")))

# Counts
_count("a1_star_count", STAR)
_count("a2_join_count", DIAMOND)
_count("a2_triangles", TRIANGLE)
_count("a3_star_count_flat", STAR, mode="flat")
_count("a4_join_count_flat", DIAMOND, mode="flat")
_add("a5_group_by", lambda g: g.label_groups().groupBy("vlabel", "nlabel").agg(F.count("*").alias("n")), "SELECT vlabel, nlabel, count(DISTINCT vid)::BIGINT AS n FROM (SELECT a.vlabel, e.src AS vid, b.vlabel AS nlabel FROM e JOIN v a ON a.vid = e.src JOIN v b ON b.vid = e.dst UNION ALL SELECT b.vlabel, e.dst, a.vlabel FROM e JOIN v a ON a.vid = e.src JOIN v b ON b.vid = e.dst) GROUP BY vlabel, nlabel")
_add("a6_distinct_labels", lambda g: g.info().select("num_vlabels", "num_elabels"), "SELECT (SELECT count(DISTINCT vlabel) FROM v) AS num_vlabels, (SELECT count(DISTINCT elabel) FROM e) AS num_elabels")
_add("a7_star_statistics", lambda g: factorized.statistics(g.star(ORDER_STAR, 1)).select("num_rows", "num_eqvs", F.array_join("eqv_total_num_vertices", ",").alias("totals"), F.expr("round(eqv_avg_num_vertices[1], 6)").alias("avg_orders")),
     "SELECT count(DISTINCT src)::BIGINT AS num_rows, 3::BIGINT AS num_eqvs, count(DISTINCT src) || ',' || count(*) || ',' || count(DISTINCT src) AS totals, round(count(*) / count(DISTINCT src), 6) AS avg_orders FROM ed WHERE elabel = 3", {3})
_count("a8_partial_sums", RECTANGLE.replace("30000003", "30000020").replace("30000006", "30000040"))

# Rows
_rows("r1_decompress_star", STAR.replace("(u1 u4 5)))", "(u1 u4 5)) (where (< u1 50000300)))"), mode="factorized")
_rows("r2_decompress_join", DIAMOND, mode="factorized")
_add("r3_super_rows", lambda g: match.factors(g, LOCAL_SUPPLIERS, roots=[1, 4, 3]).select("u1", "u3", "u4", F.array_join("c_2", ",").alias("orders")),
     "SELECT u1, u3, u4, string_agg(u2::VARCHAR, ',' ORDER BY u2) AS orders FROM (" + sql.rows(LOCAL_SUPPLIERS) + ") GROUP BY u1, u3, u4", {1, 2, 3, 5})

# Sources and graph access
_add("s3_label_dictionary", lambda g: Graph.from_tables(g.vertices, g.edges).vertices.groupBy("vlabel").agg(F.max("vid").alias("max_vid"), F.count("*").alias("n")), "SELECT vlabel, max(vid) AS max_vid, count(*)::BIGINT AS n FROM v GROUP BY vlabel")
_add("s4_doubled_edges", lambda g: Graph(g.vertices, g.edges.where("elabel IN (0, 2)")).doubled, "SELECT a.vlabel, e.src AS vid, b.vlabel AS nlabel, e.dst AS nid, true AS direction, elabel FROM e JOIN v a ON a.vid = e.src JOIN v b ON b.vid = e.dst UNION ALL SELECT b.vlabel, e.dst, a.vlabel, e.src, false, elabel FROM e JOIN v a ON a.vid = e.src JOIN v b ON b.vid = e.dst", {0, 2})
_add("s8_single_layout", lambda g: g.reduced.edges.where("elabel IN (4, 6)").groupBy("elabel").agg(F.count("*").alias("n")), "SELECT elabel, count(*)::BIGINT AS n FROM (SELECT src, dst, max(elabel) AS elabel FROM e GROUP BY src, dst) GROUP BY elabel", {4, 6}, "single")
_add("s10_label_scan", lambda g: g.with_label(3).select("vid"), "SELECT vid FROM v WHERE vlabel = 3", {0})
_add("s11_neighbours", lambda g: g.neighbors(10_000_003, 2).select("nid", "nlabel", F.array_join("in_labels", ",").alias("in_labels"), F.array_join("out_labels", ",").alias("out_labels")), "SELECT src AS nid, 2 AS nlabel, string_agg(elabel::VARCHAR, ',') AS in_labels, '' AS out_labels FROM e WHERE dst = 10000003 AND elabel = 1 GROUP BY src", {1})
_add("s12_label_groups", lambda g: Graph(g.vertices, g.edges, "multiple", g.labelled.where("elabel IN (0, 2)")).label_groups().select("vlabel", "vid", "nlabel", F.array_join("neighbors", ",").alias("neighbors")), "SELECT vlabel, vid, nlabel, string_agg(nid::VARCHAR, ',' ORDER BY nid) AS neighbors FROM (SELECT DISTINCT * FROM (SELECT a.vlabel, e.src AS vid, b.vlabel AS nlabel, e.dst AS nid FROM e JOIN v a ON a.vid = e.src JOIN v b ON b.vid = e.dst UNION ALL SELECT b.vlabel, e.dst, a.vlabel, e.src FROM e JOIN v a ON a.vid = e.src JOIN v b ON b.vid = e.dst)) GROUP BY vlabel, vid, nlabel", {0, 2})
_add("s13_label_frequency", lambda g: g.label_frequency(), "SELECT vlabel, count(*)::BIGINT AS n FROM v WHERE vid IN (SELECT src FROM e UNION SELECT dst FROM e) GROUP BY vlabel")
_add("s14_degrees", lambda g: g.degrees().where("vlabel IN (1, 3)").select("vid", "vlabel", "in_deg", "out_deg"), "SELECT vid, vlabel, (SELECT count(*) FROM e WHERE dst = vid)::BIGINT AS in_deg, (SELECT count(*) FROM e WHERE src = vid)::BIGINT AS out_deg FROM v WHERE vlabel IN (1, 3) AND vid IN (SELECT src FROM e UNION SELECT dst FROM e)")
_add("s15_info", lambda g: g.info(), "SELECT (SELECT count(*) FROM v) AS num_vertices, (SELECT count(*) FROM e) AS num_edges, (SELECT count(DISTINCT vlabel) FROM v) AS num_vlabels, (SELECT count(DISTINCT elabel) FROM e) AS num_elabels")
_add("s16_view", lambda g: Graph(g.vertices, g.edges.where("elabel = 2"), "multiple", g.labelled.where("elabel = 2")).view()[1], "SELECT src, dst, elabel FROM e", {2})

def _saved(g: Graph, *elabels: int) -> Graph:
    """g, or its edges of some labels, written as a graph folder and read again."""
    if elabels:
        g = Graph(g.vertices, g.edges, g.layout, g.labelled.where(F.col("elabel").isin(*elabels)))
    return g.save(shared_path(g.vertices.sparkSession, "graph"))


_add("s5_edges_with_repeats", lambda g: _saved(g, 4, 5).edges.groupBy("src", "dst", "elabel").agg(F.count("*").alias("n")), "SELECT src, dst, elabel, count(*)::BIGINT AS n FROM e GROUP BY src, dst, elabel", {4, 5})
_add("s6_graph_folder", lambda g: _saved(g, 1, 2, 3, 5).match(LOCAL_SUPPLIERS), sql.rows(LOCAL_SUPPLIERS), {1, 2, 3, 5})
_add("s7_saved_star_count", lambda g: _n(_saved(g, 4, 5).count(STAR)), sql.count(STAR), {4, 5})
_add("s19_single_layout_folder", lambda g: _saved(g, 4, 6).info(), "SELECT (SELECT count(*) FROM v) AS num_vertices, (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM e)) AS num_edges, (SELECT count(DISTINCT vlabel) FROM v) AS num_vlabels, 2::BIGINT AS num_elabels", {4, 6}, "single")

# Planner
_count("l3_given_roots", LOCAL_SUPPLIERS, roots=[2, 4])
_count("l4_isomorphic_stars", "(match (vertices (u1 6) (u2 6) (u3 6) (u4 6)) (arcs (u1 u2 8) (u2 u3 8) (u3 u4 8)))")
_count("l9_flat_mode", LOCAL_SUPPLIERS, mode="flat")

# The compatible semantics
_TWO_PARTS = "(match (vertices (u1 5) (u2 4) (u3 4)) (arcs (u1 u2 4) (u1 u3 4)))"
_add("compat_degree_filter", lambda g: _n(g.count(_TWO_PARTS, semantics="compat")), "SELECT coalesce(sum(k * k), 0)::BIGINT AS n FROM (SELECT src, count(DISTINCT dst) AS k FROM e WHERE elabel = 4 GROUP BY src) WHERE src IN (SELECT src FROM e GROUP BY src HAVING count(*) >= 2)", {3, 4, 5})
_add("compat_collapsed_count", lambda g: _n(g.count(DIAMOND, semantics="compat", roots=[1, 4])),
     "SELECT count(*)::BIGINT AS n FROM (SELECT DISTINCT s.src AS u1, s.dst AS u4, o.dst AS u2 FROM ed s JOIN ed o ON s.src = o.src AND o.elabel = 4 JOIN ed x ON x.src = s.dst AND x.dst = o.dst AND x.elabel = 6 WHERE s.elabel = 5 AND s.src IN (SELECT src FROM e GROUP BY src HAVING count(*) >= 3) AND s.dst IN (SELECT src FROM e WHERE elabel IN (2, 6) GROUP BY src HAVING count(*) >= 2))", {2, 4, 5, 6})
_add("compat_last_constraint", lambda g: g.match(CUSTOMER.format("(and (< u1 20000010) (< u1 20000030))"), semantics="compat"), sql.rows(CUSTOMER.format("(< u1 20000030)")), {1})
_add("compat_dropped_constraint", lambda g: _n(g.count("(match (vertices (u1 2) (u2 5) (u3 1)) (arcs (u1 u2 3) (u1 u3 1)) (where (< u2 u3)))", semantics="compat")), "SELECT count(*)::BIGINT AS n FROM ed WHERE elabel = 3 AND src IN (SELECT src FROM e GROUP BY src HAVING count(*) >= 2)", {1, 3})
_add("compat_single_layout", lambda g: _n(g.count("(match (vertices (u1 3) (u2 1)) (edges (u1 u2 2)))", semantics="compat", roots=[2])), "SELECT count(*)::BIGINT AS n FROM ed WHERE elabel = 2", {2}, "single")


# SQL by hand over the tables themselves, which shares nothing with the engine's parser
_C, _O, _S, _P, _N = ("20000000 + c_custkey", "50000000 + o_orderkey", "30000000 + s_suppkey", "40000000 + l_partkey", "10000000 + c_nationkey")
_CUSTOMERS = f"SELECT {_C} AS u1, {_N} AS u2 FROM customer"
_STARS = "SELECT sum(p * p * s)::BIGINT AS n FROM (SELECT count(DISTINCT l_partkey) AS p, count(DISTINCT l_suppkey) AS s FROM lineitem GROUP BY l_orderkey)"
_DIAMONDS = """SELECT sum(k * k)::BIGINT AS n FROM (SELECT count(*) AS k FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey
    JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) c ON c.l_suppkey = a.l_suppkey AND c.l_partkey = b.l_partkey GROUP BY a.l_orderkey, a.l_suppkey)"""
_TOGETHER = "SELECT DISTINCT x.l_partkey AS a, y.l_partkey AS b FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey"
_LOCAL = f"SELECT DISTINCT {_C} AS u1, {_O} AS u2, {_S} AS u3, {_N} AS u4 FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey"
_BY_HAND = {
    "q_local_suppliers": _LOCAL, "s6_graph_folder": _LOCAL, "j3_hash_lookup": f"SELECT count(*)::BIGINT AS n FROM ({_LOCAL})", "l9_flat_mode": f"SELECT count(*)::BIGINT AS n FROM ({_LOCAL})", "l3_given_roots": f"SELECT count(*)::BIGINT AS n FROM ({_LOCAL})",
    "e4_and": f"{_CUSTOMERS} WHERE c_custkey BETWEEN 10 AND 99", "e5_or": f"{_CUSTOMERS} WHERE c_custkey < 10 OR c_nationkey >= 20", "e6_not": f"{_CUSTOMERS} WHERE c_custkey >= 100 OR c_nationkey < 5", "e9_equal": f"{_CUSTOMERS} WHERE c_nationkey = 3",
    "e11_remainder": f"{_CUSTOMERS} WHERE ({_C}) % 7 = 3", "e11_remainder_negative": f"{_CUSTOMERS} WHERE ({_C}) % 7 = 3",
    "q4_undirected": f"SELECT {_N} AS u1, {_C} AS u2 FROM customer WHERE c_custkey < 200",
    "p1_root_constraint": f"SELECT {_C} AS u1, {_O} AS u2, {_N} AS u3 FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey < 40",
    "p3_edge_constraint": f"SELECT DISTINCT 50000000 + l_orderkey AS u1, {_P} AS u2 FROM lineitem WHERE l_orderkey % 100 = l_partkey % 100",
    "p9_early_rejection": f"SELECT DISTINCT 20000000 + o_custkey AS u1, {_O} AS u2, {_P} AS u3 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_partkey < 5",
    "p10_global_constraint": f"SELECT DISTINCT 50000000 + a.l_orderkey AS u1, 40000000 + a.l_partkey AS u2, 30000000 + b.l_suppkey AS u3 FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey % 50 = b.l_suppkey % 50",
    "j2_label_merge": "SELECT sum(c * s)::BIGINT AS n FROM (SELECT c_nationkey AS k, count(*) AS c FROM customer GROUP BY 1) JOIN (SELECT s_nationkey AS k, count(*) AS s FROM supplier GROUP BY 1) USING (k)",
    "j10_edges_are_tests": "SELECT count(*)::BIGINT AS n FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)",
    "a1_star_count": _STARS, "a3_star_count_flat": _STARS, "s7_saved_star_count": _STARS, "a2_join_count": _DIAMONDS, "a4_join_count_flat": _DIAMONDS,
    "a2_triangles": f"WITH t AS ({_TOGETHER}) SELECT count(*)::BIGINT AS n FROM t x JOIN t y ON y.a = x.b JOIN t z ON z.a = x.a AND z.b = y.b",
    "p6_either_way": f"SELECT 2 * count(*)::BIGINT AS n FROM ({_TOGETHER})",
}
for _name, _text in _BY_HAND.items():
    _QUERIES[_name] = _QUERIES[_name][0], _text


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in _QUERIES.items()}
