import tempfile

import pytest
from pyspark.sql import SparkSession

TEXTS = [
    (1, "The cat sat on the mat and looked at the dog by the door of the house.\nSecond line here, quite short.", "en", "a", 100),
    (2, None, "en", "a", None),
    (3, "", None, "b", 0),
    (4, "   \n\t ", "en", None, 6),
    (5, "one two", "en", None, 7),
    (6, "The cat sat on the mat and looked at the dog by the door of the house.\nSecond line here, quite short.", "en", "b", 100),
    (7, "12345 678 !!!", None, "c", 13),
    (8, "Der Hund und die Katze sind in dem Haus mit der Tür.\nSecond line here, quite short.", "de", "c", 80),
    (9, "word " * 9000, "en", "d", 45000),
    (10, "x" * 70000, "en", "a", 70000),
    (10, "x" * 70000, "en", "a", 70000),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def small(spark):
    """The 200 documents of the smallest tables."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture
def odd(spark):
    """Nulls, blanks, very long texts, repeated rows."""
    return spark.createDataFrame(TEXTS, SCHEMA)


@pytest.fixture
def clashing(odd):
    """Extra columns that are called like ones the operators make."""
    from pyspark.sql import functions as F

    for name in ("size", "score", "id", "key", "component", "bucket", "target", "taken", "kept", "row", "n", "held_out", "lang_pred", "k", "gone"):
        odd = odd.withColumn(name, F.lit("x"))
    return odd


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
