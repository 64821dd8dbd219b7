"""The data graph as DataFrames.

``vertices(vid bigint, vlabel int)``, ``edges(src bigint, dst bigint, elabel int)``; edges may
repeat. ``labelled`` has the labels of both ends beside each edge, so that a pattern edge is
one filtered scan: on a saved graph, one directory of Parquet.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import GraphDataError
from ..plans.planner import Sizes
from .shared import tasks

VERTICES = "vid bigint, vlabel int"
EDGES = "src bigint, dst bigint, elabel int"
LAYOUTS = ("multiple", "single")
_FORMAT = "starlace-graph-2"


def _typed(df: DataFrame, names: tuple[str, ...], kinds: tuple[str, ...]) -> DataFrame:
    """Rows whose values can't be converted are dropped."""
    lower = {c.lower(): c for c in df.columns}
    if not all(n in lower for n in names):
        df = df.toDF(*[*names, *[f"_{k}" for k in range(len(df.columns) - len(names))]]) if len(df.columns) >= len(names) else df
        lower = {c.lower(): c for c in df.columns}
    if not all(n in lower for n in names):
        raise GraphDataError(f"columns {', '.join(names)} are needed")
    return df.select(*[F.col(f"`{lower[n]}`").try_cast(k).alias(n) for n, k in zip(names, kinds)]).dropna()


class Graph:
    """A directed graph with one integer label on each vertex and edge.

    layout "single" is a storage hint under the default semantics; under "compat" it keeps, for
    each ordered pair of vertices, only the largest edge label.
    """

    def __init__(self, vertices: DataFrame, edges: DataFrame, layout: str = "multiple", labelled: DataFrame | None = None):
        if layout not in LAYOUTS:
            raise GraphDataError(f"layout must be one of {', '.join(LAYOUTS)}")
        self.vertices, self.edges, self.layout, self._labelled = vertices, edges, layout, labelled
        self._frequency: dict[int, int] = {}
        self._vertex_counts: dict[int, int] | None = None
        self._once: DataFrame | None = None
        self._edge_counts: dict[int, dict[tuple[int, int, int], int]] = {}
        #: Labels whose edges are there once; edges of which some may be there more often, for estimates.
        self.sets: frozenset[int] = frozenset()
        self.rough: DataFrame | None = None

    @cached_property
    def tasks(self) -> int:
        """Partitions of what is moved; in proportion to the graph."""
        return tasks(self.edges)

    # sources

    @classmethod
    def from_tables(cls, vertices: DataFrame, edges: DataFrame, layout: str = "multiple", order: str | None = None) -> Graph:
        """Tables by column name, or by position. Of rows with one vid the last by ``order`` counts,
        or, as tables have no order of their own, that with the largest label."""
        if order is not None:
            raw = vertices.withColumnRenamed(order, "_order")
            v = raw.select(F.col("vid").try_cast("bigint").alias("vid"), F.col("vlabel").try_cast("int").alias("vlabel"), "_order").dropna()
            v = v.groupBy("vid").agg(F.max_by("vlabel", "_order").alias("vlabel"))
        else:
            v = _typed(vertices, ("vid", "vlabel"), ("bigint", "int")).groupBy("vid").agg(F.max("vlabel").alias("vlabel"))
        return cls(v, _typed(edges, ("src", "dst", "elabel"), ("bigint", "bigint", "int")), layout)

    @classmethod
    def from_rows(cls, spark: SparkSession, vertices: Iterable[tuple], edges: Iterable[tuple], layout: str = "multiple") -> Graph:
        """Of vertices given twice the last counts."""
        v = spark.createDataFrame(list(dict((int(a), int(b)) for a, b in vertices).items()), VERTICES)
        return cls(v, spark.createDataFrame([tuple(map(int, e)) for e in edges], EDGES), layout)

    @classmethod
    def from_sqlite(cls, spark: SparkSession, path: str, layout: str = "multiple", parts: int = 8) -> Graph:
        """Tables vertices and edges of an SQLite file that all executors can read, columns by
        position, split by rowid; the last row of a vid counts."""
        import sqlite3

        def table(name: str, width: int) -> DataFrame:
            with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
                top = db.execute(f"SELECT coalesce(max(rowid), 0) FROM {name}").fetchone()[0]
                low = db.execute(f"SELECT coalesce(min(rowid), 0) FROM {name}").fetchone()[0]
            step = max(1, -(-(top - low + 1) // parts))
            names = [f"c{k}" for k in range(width)]

            def read(batches):
                import pandas as pd

                with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
                    for pdf in batches:
                        for k in pdf["id"]:
                            rows = db.execute(f"SELECT rowid, * FROM {name} WHERE rowid >= ? AND rowid < ?", (low + k * step, low + (k + 1) * step))
                            while some := rows.fetchmany(100_000):
                                # what isn't a whole number isn't a value here
                                clean = [(r[0], *[v if isinstance(v, int) else None for v in r[1 : width + 1]]) for r in some]
                                yield pd.DataFrame(clean, columns=["n", *names], dtype="Int64")

            return spark.range(0, parts, 1, parts).mapInPandas(read, "n bigint, " + ", ".join(f"{c} bigint" for c in names))

        v, e = table("vertices", 2), table("edges", 3)
        return cls.from_tables(v.toDF("n", "vid", "vlabel"), e.drop("n").toDF("src", "dst", "elabel"), layout, order="n")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Graph:
        """A saved graph; its description tells the format and the layout."""
        rows = spark.read.text(f"{path}/description").collect()
        about = json.loads("".join(r[0] for r in rows)) if rows else {}
        if about.get("format") != _FORMAT:
            raise GraphDataError(f"{path} isn't a graph")
        v = spark.read.schema("vid bigint, vlabel int").parquet(f"{path}/vertices").select("vid", "vlabel")
        once = spark.read.schema("src bigint, dst bigint, times bigint, elabel int, slabel int, dlabel int").parquet(f"{path}/edges").select("src", "slabel", "dst", "dlabel", "elabel", "times")
        a = once.withColumn("times", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times") if about["repeats"] else once.drop("times")
        g = cls(v, a.select("src", "dst", "elabel"), about["layout"], a)
        g._once = once
        g._vertex_counts = {k: n for k, n in about["vertices"]}
        for s, e, d, n in about["edges"]:
            g._edge_counts.setdefault(e, {})[s, e, d] = n
        few = min(spark.sparkContext.defaultParallelism, sum(x[3] for x in about["edges"]) // 20_000)
        g.tasks = max(2, few, max([-(-x[3] // 300_000) for x in about["edges"]], default=0))
        return g

    # build and export

    def save(self, path: str, mode: str = "error") -> Graph:
        """Vertices by label; edges by the labels of edge and ends, each once with the number of times
        it is there, sorted within files; numbers of both."""
        spark = self.vertices.sparkSession
        n = 2 * self.tasks
        spread = lambda name: F.pmod(F.xxhash64(name), F.lit(max(32, n)))
        self.vertices.repartition(n, "vlabel", spread("vid")).sortWithinPartitions("vlabel", "vid").write.mode(mode).partitionBy("vlabel").parquet(f"{path}/vertices")
        if self.layout == "single":  # each is there once
            some = self.reduced.labelled.withColumn("times", F.lit(1).cast("bigint"))
        else:
            some = self.labelled.repartition(2 * n, "src", "dst").groupBy("src", "slabel", "dst", "dlabel", "elabel").agg(F.count("*").alias("times"))
        some.repartition(n, "elabel", "slabel", "dlabel", spread("src")).sortWithinPartitions("elabel", "slabel", "dlabel", "src", "dst").write.mode(mode).partitionBy("elabel", "slabel", "dlabel").parquet(f"{path}/edges")
        kept = spark.read.parquet(f"{path}/edges").groupBy("slabel", "elabel", "dlabel").agg(F.count("*"), F.sum("times")).collect()
        vertices = spark.read.parquet(f"{path}/vertices").groupBy("vlabel").count().collect()
        about = {"format": _FORMAT, "layout": self.layout, "vertices": [list(r) for r in vertices], "edges": [list(r)[:4] for r in kept], "repeats": any(r[4] > r[3] for r in kept)}
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode(mode).text(f"{path}/description")
        return Graph.load(spark, path)

    def persist(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Graph:
        if self._once is None:
            self._labelled = self.labelled.persist(level)
        else:
            self._once = self._once.persist(level)
        return self

    @property
    def labelled(self) -> DataFrame:
        """(src, slabel, dst, dlabel, elabel); an edge without both ends isn't in the graph."""
        if self._labelled is None:
            s = self.vertices.select(F.col("vid").alias("src"), F.col("vlabel").alias("slabel"))
            d = self.vertices.select(F.col("vid").alias("dst"), F.col("vlabel").alias("dlabel"))
            self._labelled = self.edges.join(s, "src").join(d, "dst").select("src", "slabel", "dst", "dlabel", "elabel")
        return self._labelled

    @property
    def once(self) -> bool:
        """Whether ``counted`` has each edge once."""
        return self._once is not None

    @property
    def counted(self) -> DataFrame:
        """labelled with one more column, times: on a saved graph each edge once."""
        return self.labelled.withColumn("times", F.lit(1).cast("bigint")) if self._once is None else self._once

    @property
    def doubled(self) -> DataFrame:
        """Each edge once from either end: (vlabel, vid, nlabel, nid, direction, elabel), direction true at its source."""
        a = self.labelled
        out = a.select(F.col("slabel").alias("vlabel"), F.col("src").alias("vid"), F.col("dlabel").alias("nlabel"), F.col("dst").alias("nid"), F.lit(True).alias("direction"), "elabel")
        back = a.select(F.col("dlabel").alias("vlabel"), F.col("dst").alias("vid"), F.col("slabel").alias("nlabel"), F.col("src").alias("nid"), F.lit(False).alias("direction"), "elabel")
        return out.unionByName(back)

    @cached_property
    def reduced(self) -> Graph:
        """One edge for each ordered pair, with its largest label."""
        a = self.labelled.repartition(4 * self.tasks, "src", "dst").groupBy("src", "slabel", "dst", "dlabel").agg(F.max("elabel").alias("elabel")).select("src", "slabel", "dst", "dlabel", "elabel")
        g = Graph(self.vertices, a.select("src", "dst", "elabel"), "multiple", a)
        g.tasks = self.tasks
        return g

    def view(self) -> tuple[DataFrame, DataFrame]:
        """Sorted vertices that have an edge, and sorted edges."""
        g = self.reduced if self.layout == "single" else self
        return g.connected_vertices().orderBy("vid"), g.edges.select("src", "dst", "elabel").orderBy("src", "dst", "elabel")

    # statistics

    def connected_vertices(self) -> DataFrame:
        a = self.labelled if self.rough is None else self.rough
        return a.select(F.col("src").alias("vid"), F.col("slabel").alias("vlabel")).union(a.select("dst", "dlabel")).distinct()

    def info(self) -> DataFrame:
        """One row: num_vertices, num_edges, num_vlabels, num_elabels."""
        v = self.vertices.agg(F.count("*").alias("num_vertices"), F.countDistinct("vlabel").alias("num_vlabels"))
        e = self.edges.agg(F.count("*").alias("num_edges"), F.countDistinct("elabel").alias("num_elabels"))
        return v.crossJoin(e).select("num_vertices", "num_edges", "num_vlabels", "num_elabels")

    def label_frequency(self) -> DataFrame:
        """(vlabel, n): vertices with an edge, by label."""
        return self.connected_vertices().groupBy("vlabel").agg(F.count("*").alias("n"))

    def frequency(self, label: int) -> int:
        """Vertices of the label with an edge; edges that can't have any aren't read."""
        if label not in self._frequency:
            self._frequency[label] = self.connected_vertices().where(F.col("vlabel") == label).count()
        return self._frequency[label]

    def sizes(self, elabels: set[int]) -> Sizes:
        """Statistics for the planner: a saved graph has them written down, another counts once, what
        is quicker to count where it has that."""
        if self._vertex_counts is None:
            self._vertex_counts = dict(self.vertices.groupBy("vlabel").count().collect())
        if new := [k for k in sorted(elabels) if k not in self._edge_counts]:
            self._edge_counts |= {k: {} for k in new}
            for s, e, d, n in (self.labelled if self.rough is None else self.rough).where(F.col("elabel").isin(new)).groupBy("slabel", "elabel", "dlabel").count().collect():
                self._edge_counts[e][s, e, d] = n
        return Sizes(self._vertex_counts, {k: n for e in elabels for k, n in self._edge_counts[e].items()})

    def degrees(self) -> DataFrame:
        """(vid, vlabel, in_deg, out_deg): edges, or, in the single layout, neighbours."""
        d = self.doubled.select("vid", "vlabel", "nid", "direction", "elabel")
        if self.layout == "single":
            d = d.groupBy("vid", "vlabel", "nid", "direction").agg(F.max("elabel").alias("elabel")).where("elabel >= 0")
        return d.groupBy("vid", "vlabel").agg(F.count(F.when(~F.col("direction"), 1)).alias("in_deg"), F.count(F.when(F.col("direction"), 1)).alias("out_deg"))

    def with_label(self, label: int) -> DataFrame:
        return self.vertices.where(F.col("vlabel") == label)

    def neighbors(self, vid: int, label: int | None = None) -> DataFrame:
        """(nid, nlabel, in_labels, out_labels), the labels sorted, repeats kept."""
        d = self.doubled.where(F.col("vid") == vid)
        d = d if label is None else d.where(F.col("nlabel") == label)
        labels = lambda way: F.sort_array(F.collect_list(F.when(F.col("direction") == F.lit(way), F.col("elabel"))))
        return d.groupBy("nid", "nlabel").agg(labels(False).alias("in_labels"), labels(True).alias("out_labels"))

    def label_groups(self) -> DataFrame:
        """(vlabel, vid, nlabel, neighbors): sorted distinct neighbours by their label."""
        return self.doubled.groupBy("vlabel", "vid", "nlabel").agg(F.array_sort(F.collect_set("nid")).alias("neighbors"))

    def check(self) -> Graph:
        """Raises where an edge has an end that is no vertex."""
        ends = self.edges.select(F.col("src").alias("vid")).union(self.edges.select("dst")).distinct()
        lost = ends.join(self.vertices, "vid", "left_anti").limit(1).collect()
        if lost:
            raise GraphDataError(f"{lost[0][0]} has an edge but is no vertex")
        return self

    # queries

    def match(self, pattern, **how) -> DataFrame:
        """Matches: see starlace.operators.match.match."""
        from ..operators.match import match

        return match(self, pattern, **how)

    def count(self, pattern, **how) -> DataFrame:
        """One row, n: see starlace.operators.match.count."""
        from ..operators.match import count

        return count(self, pattern, **how)

    def star(self, pattern, root: int, **how) -> DataFrame:
        from ..operators.factorized import star

        return star(self, pattern, root, **how)

    def explain(self, pattern, **how) -> str:
        """Roots, stars, leaf classes and the physical plan."""
        from ..operators.match import explain

        return explain(self, pattern, **how)
