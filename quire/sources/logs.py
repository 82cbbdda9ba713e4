"""Append-only JSON logs with an explicit order, and idempotent staging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.schemas import LOG
from quire.sources.aside import Aside


class MalformedLog(ValueError):
    """A line of a log isn't JSON."""


def read_foreign(spark: SparkSession, path: str) -> DataFrame:
    """(seq, record_type, line) of a JSONL file that another program wrote.

    Lines are numbered within their file, blank ones too.  A file is read in
    splits; a line's number is its place in the split and the lines of the
    splits before it, so only the counts of splits meet.
    """
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"), F.regexp_replace("value", "\r$", "").alias("line")
    )
    counts = rows.groupBy("_f", "_b").agg(F.count("*").alias("_n"), F.min("_i").alias("_min"))
    before = F.sum("_n").over(Window.partitionBy("_f").orderBy("_b")) - F.col("_n")
    placed = rows.join(F.broadcast(counts.select("_f", "_b", "_min", before.alias("_off"))), ["_f", "_b"])
    numbered = placed.select((F.col("_off") + F.col("_i") - F.col("_min") + 1).alias("seq"), "line").where(F.trim("line") != "")
    return numbered.select("seq", F.get_json_object("line", "$.record_type").alias("record_type"), "line")


def strict(log: DataFrame) -> DataFrame:
    """The log, or an error on its first line that isn't JSON."""
    bad = log.where(F.try_parse_json("line").isNull()).orderBy("seq").limit(1).collect()
    if bad:
        raise MalformedLog(f"line {bad[0]['seq']} isn't JSON")
    return log


def lenient(log: DataFrame) -> DataFrame:
    """The log without lines that aren't JSON."""
    return log.where(F.try_parse_json("line").isNotNull())


def append(rows: DataFrame, path: str) -> None:
    """Add rows (seq, record_type, line) to a log; Spark's committer makes it whole or not at all."""
    rows.select(*LOG.names).write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG).parquet(path)


def next_seq(log: DataFrame) -> int:
    return (log.agg(F.max("seq")).first()[0] or 0) + 1


def to_log(records: DataFrame, record_type: str, start: int, order: list[str]) -> DataFrame:
    """Records as log rows, numbered on from ``start`` in a given order.

    Numbers are a partition's offset plus the row's place in it: only the
    counts of the range partitions meet, never the rows.  The rows are written
    aside first: range bounds are sampled and small partitions merged anew
    whenever a plan runs, so counts of one run don't fit the rows of another.
    """
    columns = records.columns
    kind = F.lit(record_type).alias("record_type")
    placed = records.repartitionByRange(*order).sortWithinPartitions(*order) if order else records
    line = F.to_json(F.struct(kind, *columns))
    rows = Aside(records.sparkSession, "log").keep(placed.select(F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_i"), line.alias("line")))
    counts = rows.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_i").alias("_min"))
    offsets = counts.select("_p", "_min", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_off"))
    met = rows.join(F.broadcast(offsets), "_p")
    return met.select((F.lit(start) + F.col("_off") + F.col("_i") - F.col("_min")).alias("seq"), kind, "line")


class StageConflict(ValueError):
    """The same place was staged before with other content."""


def stage(pending: DataFrame, staged: DataFrame) -> DataFrame:
    """Rows of ``staged`` that are new; the same content again is none, other content an error.

    Rows are (layer, sequence, target_id, task_id, content_hash, payload).
    """
    old = pending.select("layer", "sequence", F.col("content_hash").alias("_old"))
    met = staged.join(old, ["layer", "sequence"], "left")
    clash = met.where("_old is not null and _old <> content_hash").limit(1).collect()
    if clash:
        raise StageConflict(f"{clash[0]['layer']} {clash[0]['sequence']} was staged with other content")
    return met.where("_old is null").drop("_old")


def uncommitted(pending: DataFrame, commits: DataFrame) -> DataFrame:
    """Staged rows that no commit covers, in order."""
    left = pending.join(commits.select("layer", "sequence").distinct(), ["layer", "sequence"], "left_anti")
    return left.orderBy("sequence", "target_id", "task_id")


def content_hash(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with a hash over columns as JSON."""
    return df.withColumn("content_hash", F.sha2(F.to_json(F.struct(*columns)), 256))


def set_hash(records: DataFrame, columns: list[str]) -> str:
    """One hash of a set of records, whatever their order."""
    row = records.select(F.sha2(F.to_json(F.struct(*columns)), 256).alias("h")).agg(
        F.count("*").alias("n"), *[F.sum(F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(8)]
    )
    return row.select(F.sha2(F.to_json(F.struct("*")), 256)).first()[0]
