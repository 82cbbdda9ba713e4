"""Order-keeping selections: heads, tails, spreads, merges, chunks, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """Rows by hash of ``by``, in as many partitions as the session shuffles to.

    For steps that sort or aggregate several times what they get: the adaptive
    planner, which knows the shuffled bytes only, would merge partitions until a
    task holds too much.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _counted(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """``_rn`` from 1 and ``_n`` within each group."""
    w = Window.partitionBy(*by)
    return df.withColumns({"_rn": F.row_number().over(w.orderBy(*order)), "_n": F.count("*").over(w)})


def tail(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The last k rows of each group."""
    return _counted(df, by, order).where(F.col("_rn") > F.col("_n") - k).drop("_rn", "_n")


def bookend(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k // 2 and the last k - k // 2 rows of each group."""
    head = k // 2
    return _counted(df, by, order).where((F.col("_rn") <= head) | (F.col("_rn") > F.col("_n") - (k - head))).drop("_rn", "_n")


def spread_marks(n: Column, k: int) -> Column:
    """0-based indices of k rows spread evenly over n, first and last included."""
    if k == 1:
        return F.array(F.lit(0).cast("long"))
    every = F.sequence(F.lit(0).cast("long"), n - 1)
    even = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.round(i * (n - 1) / F.lit(float(k - 1))).cast("long"))
    return F.when(n <= k, every).otherwise(F.array_distinct(even))


def spread(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """At most k rows of each group, evenly spaced in order.

    A row's own index tells whether it is chosen, so no index list is joined:
    index j is chosen if some i has round(i * (n - 1) / (k - 1)) = j.
    """
    counted = _counted(df, by, order)
    j, last = F.col("_rn") - 1, F.col("_n") - 1
    if k == 1:
        return counted.where("_rn = 1").drop("_rn", "_n")
    i = F.floor(j * (k - 1) / last)
    hit = F.exists(F.array(i - 1, i, i + 1), lambda x: (x >= 0) & (x <= k - 1) & (F.round(x * last / F.lit(float(k - 1))) == j))
    return counted.where((F.col("_n") <= k) | hit).drop("_rn", "_n")


def head(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rn") <= k).drop("_rn")


def head_tail(df: DataFrame, by: list[str], order: list[Column], keep_all: int = 12, first: int = 8, last: int = 4) -> DataFrame:
    """All of a small group, else its first and last rows."""
    keep = (F.col("_n") <= keep_all) | (F.col("_rn") <= first) | (F.col("_rn") > F.col("_n") - last)
    return _counted(df, by, order).where(keep).drop("_rn", "_n")


def chunks(df: DataFrame, by: list[str], order: list[Column], size: int) -> DataFrame:
    """``chunk`` from 0: groups of ``size`` rows in order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / size).cast("long"))


def ordered_union(parts: list[DataFrame], key: str, position: str) -> DataFrame:
    """Rows of the parts in order of part and position, the first of each key only."""
    every = parts[0].withColumn("_src", F.lit(0))
    for i, part in enumerate(parts[1:], 1):
        every = every.unionByName(part.withColumn("_src", F.lit(i)))
    w = Window.partitionBy(key).orderBy("_src", position)
    first = every.where(F.trim(F.coalesce(F.col(key), F.lit(""))) != "").withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    return first.drop("_rn").withColumnRenamed("_src", "source_rank")


def latest(df: DataFrame, key: list[str], seq: str = "seq") -> DataFrame:
    """The row of greatest ``seq`` for each key; aggregates map-side, no sort."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_row"))
    return best.select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def upsert(current: DataFrame, changes: DataFrame, key: list[str], seq: str = "seq") -> DataFrame:
    """``current`` with rows replaced by newer ones of the same key."""
    return latest(current.unionByName(changes, allowMissingColumns=True), key, seq)


def without(df: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key isn't among ``gone``."""
    return df.join(gone.select(*key).distinct(), key, "left_anti")


def replace_group(current: DataFrame, fresh: DataFrame, group: str) -> DataFrame:
    """``current`` with whole groups taken from ``fresh``."""
    return without(current, fresh, [group]).unionByName(fresh)
