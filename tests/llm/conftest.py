import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"


LONG = " ".join(f"w{i % 977}é" for i in range(30_000))
TEXTS = [None, "", " \n\t ", "one", "one two\nthree", "a a a a a a", "x y z x y z\nx y z\n\nx y z", "#$ b|c <d>\n#$ b|c <d>", "é è é è é\né è é è é", LONG]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and clashing extra columns."""
    rows = [(i, t, "en" if i % 2 else None, None if i == 3 else f"s{i % 3}", 0, "x", 1.0) for i, t in enumerate(TEXTS)]
    rows += [rows[4], rows[6], (None, "some text of a row without id", None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, score double")
