"""What runs and their tasks add up to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def task_totals(tasks: DataFrame) -> DataFrame:
    """For each run and task type: tasks, failures, tokens, time."""
    return tasks.groupBy("run_id", "task_type").agg(
        F.count("*").alias("tasks"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.lower(F.coalesce("status", F.lit(""))).contains("retry")).alias("retried"),
        F.sum(F.coalesce("prompt_tokens", F.lit(0))).alias("prompt_tokens"),
        F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"),
        F.sum(F.coalesce("duration_ms", F.lit(0))).alias("duration_ms"),
    )


def max_concurrency(spans: DataFrame, by: str, start: str, end: str) -> DataFrame:
    """(by, max_open): most spans open at once; one that ends as another starts isn't open with it."""
    up = spans.select(by, F.col(start).alias("_t"), F.lit(1).alias("_d"))
    down = spans.select(by, F.col(end).alias("_t"), F.lit(-1).alias("_d"))
    w = Window.partitionBy(by).orderBy("_t", "_d").rowsBetween(Window.unboundedPreceding, 0)
    return up.unionByName(down).withColumn("_open", F.sum("_d").over(w)).groupBy(by).agg(F.max("_open").alias("max_open"))


def recoveries(cards: DataFrame) -> DataFrame:
    """(action, cards) of recovered scene cards."""
    return cards.where("action is not null and action <> 'none'").groupBy("action").agg(F.count("*").alias("cards"))


def single_scene_hints(scenes: DataFrame, paragraphs: DataFrame, least: int = 6) -> DataFrame:
    """Chapters that one scene spans whole, and the paragraph after which to break them."""
    one = scenes.groupBy("chapter_id").agg(F.count("*").alias("n"), F.min("paragraph_start").alias("s"), F.min("paragraph_end").alias("e")).where("n = 1")
    size = paragraphs.groupBy("chapter_id").agg(
        F.count("*").alias("paragraph_count"), F.min_by("id", "ordinal").alias("first"), F.max_by("id", "ordinal").alias("last"), F.min("ordinal").alias("o")
    )
    met = one.join(size, "chapter_id").where((F.col("s") == F.col("first")) & (F.col("e") == F.col("last")) & (F.col("paragraph_count") >= least))
    middle = paragraphs.select("chapter_id", F.col("ordinal").alias("_o"), F.col("id").alias("break_after"))
    return met.join(middle, "chapter_id").where(F.col("_o") == F.col("o") + F.floor(F.col("paragraph_count") / 2) - 1).select("chapter_id", "paragraph_count", "break_after")
