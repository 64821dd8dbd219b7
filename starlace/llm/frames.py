"""Small DataFrame helpers of the corpus operators."""

from __future__ import annotations

import gc
import uuid
import weakref
from functools import wraps
from inspect import signature

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINTS = "spark.checkpoint.dir"
#: Where written tables are.
_AT: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have, in any case of letters."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def own(df: DataFrame, *without: str) -> list[Column]:
    """df's columns as they are. Those of the given names, in any case of letters, are left out:
    a column that an operator adds takes the place of one that has its name."""
    gone = {c.lower() for c in without}
    return [F.col(quoted(c)) for c in df.columns if c.lower() not in gone]


def picked(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, whatever the others are called: of equal names the first, and one
    that differs by case only where none is equal."""
    have = df.columns
    at = [have.index(n) if n in have else [c.lower() for c in have].index(n.lower()) for n in names]
    return df.toDF(*[f"c{k}" for k in range(len(have))]).select(*[F.col(f"c{k}").alias(n) for k, n in zip(at, names)])


def kept_names(operator):
    """For operators whose first argument is a table and whose result begins with its columns:
    names that occur twice, or that differ only in case, come through. Of equal names the first
    is the one that parameters mean."""

    @wraps(operator)
    def run(docs: DataFrame, *args, **how) -> DataFrame:
        names = docs.columns
        if len({c.lower() for c in names}) == len(names):
            return operator(docs, *args, **how)
        bound = signature(operator).bind(docs, *args, **how)
        bound.apply_defaults()
        meant = {v for v in bound.arguments.values() if isinstance(v, str)}
        apart, taken = [], {c.lower() for c in names}
        for k, c in enumerate(names):
            exact = c in meant and c not in names[:k]
            new = c if exact else f"{c}__{k}"
            while not exact and new.lower() in taken:
                new += "_"
            taken.add(new.lower())
            apart.append(new)
        got = operator(docs.toDF(*apart), *args, **how)
        back = dict(zip(apart, names))
        return got.toDF(*[back.get(c, c) for c in got.columns])

    return run


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new path in the folder that all executors share. spark.checkpoint.dir names it; where that
    is unset a folder is chosen here, if all runs on this machine alone."""
    base = spark.conf.get(CHECKPOINTS, None) or spark.sparkContext.getConf().get(CHECKPOINTS, None)
    if not base:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINTS} must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set(CHECKPOINTS, base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: computed once, and no executor's loss can undo it."""
    spark = df.sparkSession
    path = shared_dir(spark, what)
    df.write.parquet(path)
    got = spark.read.schema(df.schema).parquet(path)
    _AT[got] = path
    return got


def cleared(spark: SparkSession, *tables: DataFrame) -> None:
    """Removes tables that ``written`` made and nothing will read again, and has the driver collect
    its garbage: shuffle files of jobs that are over go only when it does."""
    jvm = spark.sparkContext._jvm
    for df in tables:
        if path := _AT.pop(df, None):
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    gc.collect()
    jvm.System.gc()


def checked_broadcast(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """A broadcast hint while df has at most limit rows; beyond that the join is left to shuffle."""
    return F.broadcast(df) if rows <= limit else df
