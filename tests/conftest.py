import pytest
from pyspark.sql import SparkSession

# made on import, as tests build expressions when they are collected
_session = (
    SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
    .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
)
_session.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    return _session
