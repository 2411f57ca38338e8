import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, empty texts, ties and repeated rows, one very long text.
ODD = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "  \n\t", None, "s", 3), (4, "one", "en", None, 3), (4, "one", "en", None, 3), (None, "lost words here", "fr", "s", 15), (5, "long text " * 30000, "en", "s", 300000), (6, "Ünïcode wörd çé", "fr", "s", 15)]


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(ODD, SCHEMA).withColumn("size", F.lit("clash")).withColumn("items", F.lit(1)).withColumn("_bucket", F.lit(1))


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
