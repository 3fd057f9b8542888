import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty texts, ties, repeated rows, a long text, and columns with clashing names."""
    rows = [
        (1, "Alpha beta gamma delta epsilon zeta eta theta.", "x"),
        (2, "Alpha  beta\tgamma delta epsilon zeta eta theta.", "y"),
        (3, None, "x"),
        (4, "", "x"),
        (5, "   ", None),
        (5, "   ", None),
        (None, "Alpha beta gamma delta epsilon zeta eta theta.", "x"),
        (6, "one two", "x"),
        (7, "ONE two", "x"),
        (8, "lorem ipsum " * 4000, "x"),
        (9, "Straße é É  日本語 x \n\n end 🙂", "x"),
    ]
    schema = "doc_id long, text string, score string"
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, schema).withColumn("kept", F.lit("k")).withColumn("key", F.lit(1)).withColumn("group_size", F.lit("g"))


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
