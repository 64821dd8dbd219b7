import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"w{k % 977}x{k % 1009}" for k in range(30_000))
A = "the quick brown fox jumps over the lazy dog while seven wise owls watch from a hollow oak near the river bank"
EXTRA = ("rule", "spans", "pii", "id", "group", "sig", "x", "keep", "lm", "rank", "Text__1", "piece_ids", "key", "a", "b", "count", "n")


def rows():
    """Nulls, empty and long texts, ties, repeated rows."""
    return [
        (1, A, "en", "s", len(A)), (2, A, "en", "s", len(A)), (3, A.replace("seven", "eight"), "en", None, 1), (4, "", None, "s", 0), (5, None, None, None, None),
        (None, A, None, None, 3), (None, None, None, None, None), (6, LONG, "en", "s", len(LONG)), (7, "Une phrase toute différente, avec un mail a.b@example.org ici.", "fr", "s", None),
        (8, "one", "en", "s", 3), (9, "one", "en", "s", 3), (10, "x", None, None, 1), (1, A, "en", "s", len(A)), (11, "☃ 漢字 🙂 \u0000 tab\tend", "zh", "s", 5), (12, "spam eggs " * 400, "en", "s", 4000), (-3, "   \n ", "en", "s", 5),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows(), DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(spark, odd):
    """Extra columns named like the operators' own, and one that differs from text by case only."""
    from pyspark.sql import functions as F

    some = odd.select("*", *[F.lit(k).alias(c) for k, c in enumerate(EXTRA)])
    return some.toDF(*[*odd.columns, *EXTRA[:-1], "Text"])


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
