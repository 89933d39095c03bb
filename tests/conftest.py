import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH")) if x)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    conf = {"spark.master": "local[4]", "spark.driver.memory": "3g", "spark.sql.shuffle.partitions": "4", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": str(shared)}
    s = SparkSession.builder.config(map=conf).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def rows():
    """Rows of a frame as sorted tuples."""

    def of(df, *cols):
        found = df.select(*cols) if cols else df
        return sorted((tuple(r) for r in found.collect()), key=lambda t: tuple((x is None, str(x)) for x in t))

    return of


@pytest.fixture
def crowded():
    """A frame with extra columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    def of(df):
        for c in ("rank", "n", "ord", "part", "key", "form", "bucket", "id", "a", "b", "after", "total", "record", "changed", "raw", "occ", "sign", "size", "range", "proj", "why", "cut", "mark"):
            if c not in df.columns:
                df = df.withColumn(c, F.lit("x"))
        return df

    return of
