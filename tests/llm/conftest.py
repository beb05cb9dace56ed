import pytest
from llm_samples import ROWS
from pyspark.sql import SparkSession

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def rows():
    return ROWS


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With extra columns whose names the operators use inside."""
    made = [(d, t, "en", None, None, 1, "x", 2, 3) for d, t in rows]
    return spark.createDataFrame(made, COLUMNS + ", _key bigint, kept string, bucket int, slot int").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
