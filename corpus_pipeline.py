"""The corpus pipeline: documents in, piece ids of the clean documents out.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the
next stage's docs. All but the last keep the columns of documents; n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starlace.llm import decontaminate, near_dedup, pieces, pii, repetition
from starlace.llm.frames import kept_names, quoted, written


@kept_names
def _counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """n_chars as the text now is."""
    if "n_chars" not in docs.columns:
        return docs
    n = F.length(quoted(text)).cast(docs.schema["n_chars"].dataType)
    return docs.select(*[n.alias("n_chars") if c == "n_chars" else F.col(quoted(c)) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that mostly repeat themselves go."""
    return repetition.filter_repetitive(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dedup.drop_near_copies(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out."""
    return _counted(decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced by their kind."""
    return _counted(pii.redact(docs))


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids of the text's pieces, their number, and the text they decode to."""
    return pieces.encode_decode(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near copies", near_copies),
    ("benchmark passages", benchmark_passages),
    ("personal data", personal_data),
    ("pieces", piece_ids),
]

#: SQL can't express suffix arrays, signatures, boosted trees or the tokenizer's search.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs
