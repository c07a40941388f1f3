import tempfile

import pytest
from pyspark.sql import SparkSession

from tidelane.functions.schemas import TRAFFIC

# link, speed, travel time, second, borough: link 58 has equal rows, 58 and 73 tie, Hoboken is no borough
ROWS = [
    (31, 6.0, 410.0, 1653000000, "Staten Island"),
    (31, 18.0, 130.0, 1653003600, "Staten Island"),
    (31, 12.0, 200.0, 1653090000, "Staten Island"),
    (58, 27.5, 95.0, 1653007200, "Bronx"),
    (58, 27.5, 95.0, 1653007200, "Bronx"),
    (73, 27.5, 88.0, 1653010800, "Manhattan"),
    (90, 3.0, 900.0, 1653093600, "Hoboken"),
]
CODES = {"Manhattan": 1, "Bronx": 2, "Staten Island": 5, "Hoboken": -1}


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
def traffic(spark):
    return spark.createDataFrame([(*r, CODES[r[4]], f"Segment {r[0]}") for r in ROWS], TRAFFIC)


@pytest.fixture(scope="session")
def scans():
    """The tables that a plan reads, a name a scan."""

    def found(df):
        leaves = df._jdf.queryExecution().sparkPlan().collectLeaves()
        return [str(leaves.apply(i).toString()) for i in range(leaves.size()) if "FileScan" in leaves.apply(i).toString()]

    return found
