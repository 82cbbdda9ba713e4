"""Shared-storage scratch tables, the only way operators here cut lineage.

The root is ``spark.checkpoint.dir`` where the session has one, since that is
the folder every executor can read.  Only where it is unset (a local session,
tests) does a temporary folder stand in for it.
"""

from __future__ import annotations

import re
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}
_MADE: list[Scratch] = []
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
SWEEP_SECONDS = 5.0  # at least so long from one sweep to the next
_SWEPT: dict[str, float] = {}


def shared_root(spark: SparkSession) -> str:
    """Folder for scratch tables: the configured one, or a local one if unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = chosen.get() if chosen.isDefined() else None
    if root:
        return root.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="quire-scratch-")
    return _LOCAL_ROOTS[app]


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to what tasks that hold whole texts can afford; never raises them.

    Rows and bytes of a batch bound what the JVM's writer, the Python worker
    and the JVM's reader each hold of a task's texts at a time.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = int(re.sub(r"\D+$", "", spark.conf.get(key)) or 0)
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def set_aside(df: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns of these names renamed, and how to name them back."""
    back = {f"_in_{n}": n for n in names if n in df.columns}
    return df.withColumnsRenamed({n: aside for aside, n in back.items()}), back


def sweep(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are done.

    It does so once the driver's garbage collector has found that nothing refers
    to them, which a driver with memory to spare may put off for the whole run.
    """
    app, now = spark.sparkContext.applicationId, time.monotonic()
    if now - _SWEPT.get(app, now - SWEEP_SECONDS) >= SWEEP_SECONDS:
        spark._jvm.System.gc()
        _SWEPT[app] = time.monotonic()


class Scratch:
    """Parquet tables under one fresh folder of the shared root."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_root(spark)}/quire-{label}-{uuid.uuid4().hex}"
        self.names: list[str] = []
        _MADE.append(self)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return the frame that reads it back."""
        sweep(self.spark)  # of what the steps before have left
        path = f"{self.base}/{name}"
        schema = df.schema
        df.write.mode("overwrite").parquet(path)
        self.names.append(name)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Delete a table that no later plan reads, or all of them."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.delete(path, True)

    def keep_only(self, *starts: str) -> None:
        """Delete the tables whose names begin with none of these."""
        for name in self.names:
            if not name.startswith(starts):
                self.drop(name)
        self.names = [n for n in self.names if n.startswith(starts)]


@contextmanager
def temporary() -> Iterator[None]:
    """Delete all scratch folders made inside, once what was computed from them is written elsewhere."""
    mark = len(_MADE)
    yield
    for made in _MADE[mark:]:
        made.drop()
    del _MADE[mark:]
