import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402


@pytest.fixture(scope="session")
def docs(spark):
    """The odd rows, with columns whose names operators might use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(brute.ROWS, brute.SCHEMA)
    return df.withColumns({"h1": F.lit("x"), "line": F.lit(1), "n_lines": F.lit("clash"), "tokens": F.lit("clash"), "lang_pred": F.lit("clash"), "root": F.lit(0)})


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
