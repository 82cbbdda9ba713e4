"""Structured Streaming over append-only logs.

An extension: new log rows arrive as a stream, and each micro-batch is merged
to a table of latest rows or replayed to committed ones.  Batches are keyed by
their id, so a batch that is run again after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.operators.pack import latest
from quire.schemas import LOG
from quire.sources.store import Store


def read_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """A log folder as a stream of (seq, record_type, line)."""
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", max_files).parquet(path)


#: Versions of a table beyond which it is merged to one.
MOST_PARTS = 20


def merge_latest(store: Store, table: str, key: list[str]):
    """A ``foreachBatch`` function that adds each batch's newest rows to a table, once.

    A batch is appended, not merged with what there is; ``read_latest`` picks
    the newest row of each key.  The batch's id is committed with its rows.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        last = store.note(f"{table}.batch")
        if last is not None and batch_id <= last:
            return
        store.append({table: latest(batch, key)}, **{f"{table}.batch": batch_id})
        if store.parts(table) > MOST_PARTS:
            store.update({table: read_latest(store, table, key)})

    return apply


def read_latest(store: Store, table: str, key: list[str]) -> DataFrame:
    """The newest row of each key."""
    return latest(store.read(table), key)


def start_latest(stream: DataFrame, store: Store, table: str, key: list[str], checkpoint: str) -> StreamingQuery:
    """Run ``merge_latest`` over all that is there, then stop."""
    writer = stream.writeStream.foreachBatch(merge_latest(store, table, key)).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time_col: str, size: str = "5 minutes", late: str = "10 minutes", by: str = "record_type") -> DataFrame:
    """Rows for each window and type, closed once the watermark has passed."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, size), by).agg(F.count("*").alias("n"))
