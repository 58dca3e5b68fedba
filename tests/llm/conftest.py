import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty, wordless and long texts, repeated rows, an extra column with a clashing name."""
    rows = [
        (1, "the same passage of many words " * 12, "en", "a", 1, "x"),
        (2, "the same passage of many words " * 12, "en", "a", 1, "x"),
        (2, "the same passage of many words " * 12, "en", "a", 1, "x"),
        (3, None, None, None, None, None),
        (4, "", "en", None, 0, "y"),
        (5, " \n\t \r\n", "de", "b", 6, "y"),
        (6, "Größe: é ü 汉字 " * 30 + "token = 'abcdefghijkl0123'\nlast line", "fr", "b", 9, "z"),
        (7, " ".join(f"w{i % 977}" for i in range(30_000)), "en", "c", 9, "z"),
        (8, "before the " + "the same passage of many words " * 3 + "after", "en", "c", 9, "z"),
        (None, "a document without an id " * 5, "en", "c", 9, "z"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, block string"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
