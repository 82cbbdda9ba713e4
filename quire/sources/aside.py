"""Tables written aside for one computation, so that what made them runs once.

The root is ``spark.checkpoint.dir`` where the session has one: the folder that
all executors share.  Only a local session may leave it unset.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The configured folder, or one of a local session's own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        _LOCAL[app] = tempfile.mkdtemp(prefix="quire-aside-")
    return _LOCAL[app]


class Aside:
    """Parquet tables under one fresh folder."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.base, self.count = spark, f"{shared_folder(spark)}/quire-{label}-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        """``df``, computed once and read back from where it was written."""
        self.count += 1
        path = f"{self.base}/{self.count}"
        schema = df.schema
        df.write.parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self) -> None:
        """Delete the folder, once nothing that is still to run reads it."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
