"""The folder that all executors share, and numbers of tasks that follow the input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINTS = "spark.checkpoint.dir"
#: Bytes of the largest table's files for one task: about 300,000 rows of two keys.
A_TASK = 4 << 20


def tasks(df: DataFrame) -> int:
    """A number of partitions in proportion to the files of the largest table that df reads. Adaptive
    execution doesn't merge partitions whose number is given, so that what a task holds stays the same
    however large the table is. Where files aren't known, spark.sql.shuffle.partitions."""
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    known = [n for k in range(leaves.size()) if (n := int(str(leaves.apply(k).stats().sizeInBytes()))) < 1 << 60]
    if not known:
        return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    some = max(known)
    return max(2, min(spark.sparkContext.defaultParallelism, some >> 18), -(-some // A_TASK))


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; where that is unset one is chosen
    here, if all runs on this machine alone."""
    base = spark.conf.get(CHECKPOINTS, None) or spark.sparkContext.getConf().get(CHECKPOINTS, None)
    if not base:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINTS} must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set(CHECKPOINTS, base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"
