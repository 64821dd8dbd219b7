"""Connected components by alternating large-star and small-star steps.

Each step is a grouped minimum and a join on edges; the number of rounds grows with the
logarithm of the largest component. Lineage is cut by writing each round's edges to the
shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import written


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.xxhash64("hi", "lo") % 1_000_003)).first())


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of bigint ids -> (id, group): every id of an edge and the least id of its component."""
    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    e = written(e, "edges")
    mark = _mark(e)
    while mark[0]:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(low, "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .unionByName(low.select("hi", F.col("m").alias("lo"))).distinct()
        )
        e = written(small, "edges")
        was, mark = mark, _mark(e)
        if was == mark:
            break
    return e.groupBy(F.col("hi").alias("id")).agg(F.min("lo").alias("group")).unionByName(e.select(F.col("lo").alias("id"), F.col("lo").alias("group")).distinct())
