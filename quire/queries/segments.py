"""Queries on segmentation, windows and order-keeping samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import pack, segment
from quire.queries import query, table
from quire.queries.texts import LINES_SQL, lines


def _turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(paragraphs, breaks) of conversations: turns with turn % 3 = 2 are breaks."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chapter_id"), "turn")
    breaks = c.where("turn % 3 = 2").select("chapter_id", (F.col("turn") + 1).alias("ordinal"))
    from pyspark.sql import Window

    w = Window.partitionBy("chapter_id").orderBy("turn")
    p = c.where("turn % 3 <> 2").select("chapter_id", F.col("turn").alias("id"), F.row_number().over(w).alias("ordinal"), (F.col("turn") + 1).alias("block_ordinal"))
    return p, breaks


TURNS_SQL = """WITH breaks AS (SELECT conv_id AS chapter_id, turn + 1 AS o FROM conversations WHERE turn % 3 = 2),
p AS (SELECT conv_id AS chapter_id, turn AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ordinal, turn + 1 AS block_ordinal FROM conversations WHERE turn % 3 <> 2)"""


@query(
    TURNS_SQL
    + " SELECT DISTINCT b.chapter_id, arg_max(p.id, p.block_ordinal) AS id FROM breaks b JOIN p ON p.chapter_id = b.chapter_id AND p.block_ordinal < b.o GROUP BY b.chapter_id, b.o"
)
def seg_explicit_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.explicit_breaks(*_turns(spark, sf_dir))


@query(
    TURNS_SQL
    + " SELECT DISTINCT b.chapter_id, arg_max(p.id, p.ordinal) AS id FROM breaks b JOIN p ON p.chapter_id = b.chapter_id AND p.ordinal < b.o GROUP BY b.chapter_id, b.o"
)
def seg_explicit_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.explicit_breaks(*_turns(spark, sf_dir), legacy_ordinals=True)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as paragraphs: (chapter_id, id, ordinal, text)."""
    return lines(spark, sf_dir).select(F.col("doc_id").alias("chapter_id"), F.col("pos").alias("id"), (F.col("pos") + 1).alias("ordinal"), F.col("line").alias("text"))


@query(
    "WITH "
    + LINES_SQL
    + """, c AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id),
    k AS (SELECT doc_id, n, least(4, greatest(1, n // 2)) AS k FROM c),
    t AS (SELECT lines.doc_id, pos, n, k, pos + 1 AS p FROM lines JOIN k USING (doc_id)),
    parts AS (SELECT doc_id, pos, CASE WHEN p <= (n % k) * (n // k + 1) THEN (p - 1) // (n // k + 1) + 1 ELSE n % k + (p - 1 - (n % k) * (n // k + 1)) // (n // k) + 1 END AS part FROM t)
    SELECT doc_id AS chapter_id, part::BIGINT AS part, min(pos)::INTEGER AS first, max(pos)::INTEGER AS last, count(*) AS n FROM parts GROUP BY doc_id, part"""
)
def seg_even_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _lines(spark, sf_dir)
    none = p.select("chapter_id", "id").limit(0)
    cut = segment.count_breaks(p, none, target=4)
    scenes = segment.build_scenes(p, segment.merge_breaks((cut, "paragraph_count")))
    return scenes.select("chapter_id", F.col("ordinal").cast("long").alias("part"), F.col("paragraph_start").alias("first"), F.col("paragraph_end").alias("last"), F.col("paragraph_count").alias("n"))


@query(
    TURNS_SQL
    + """, b AS (SELECT DISTINCT b.chapter_id, arg_max(p.id, p.block_ordinal) AS id FROM breaks b JOIN p ON p.chapter_id = b.chapter_id AND p.block_ordinal < b.o GROUP BY b.chapter_id, b.o),
    m AS (SELECT p.*, b.id IS NOT NULL AS cut FROM p LEFT JOIN b USING (chapter_id, id)),
    s AS (SELECT *, (coalesce(sum(cut::INT) OVER (PARTITION BY chapter_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1)::INTEGER AS scene FROM m)
    SELECT chapter_id, scene, arg_min(id, ordinal) AS paragraph_start, arg_max(id, ordinal) AS paragraph_end, count(*) AS n,
           CASE WHEN arg_max(cut, ordinal) THEN 'explicit' ELSE 'chapter_end' END AS boundary_source
    FROM s GROUP BY chapter_id, scene"""
)
def seg_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, breaks = _turns(spark, sf_dir)
    out = segment.detect(p, breaks, mode="explicit")
    return out.select("chapter_id", F.col("ordinal").alias("scene"), "paragraph_start", "paragraph_end", F.col("paragraph_count").alias("n"), "boundary_source")


@query(
    """SELECT user_id AS chapter_id, o::INTEGER AS ordinal, 'gap or overlap' AS problem FROM (
      SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS o, count(*) OVER (PARTITION BY user_id) AS n, event_id FROM events)
    WHERE n >= 12 AND o = 4"""
)
def seg_partition_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes of three events each, the fourth one begun an event late."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id")
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("chapter_id"), F.col("event_id").alias("id"), F.row_number().over(w.orderBy("event_id")).alias("ordinal"), F.count("*").over(w).alias("n")
    )
    e = e.where("n >= 12").drop("n")
    scene = F.ceil(F.col("ordinal") / 3).cast("int")
    s = e.withColumn("scene", scene).groupBy("chapter_id", "scene").agg(
        F.min_by("id", "ordinal").alias("a"), F.max_by("id", "ordinal").alias("b"), F.max_by("id", -F.abs(F.col("ordinal") - (F.col("scene") - 1) * 3 - 2)).alias("second")
    )
    start = F.when(F.col("scene") == 4, F.coalesce("second", "a")).otherwise(F.col("a"))
    return segment.partition_violations(s.select("chapter_id", F.col("scene").alias("ordinal"), start.alias("paragraph_start"), F.col("b").alias("paragraph_end")), e)


WINDOW_SQL = (
    "WITH RECURSIVE "
    + LINES_SQL
    + """, t AS (SELECT doc_id, list(CASE WHEN strlen(line) = 0 THEN 0 ELSE greatest(1, strlen(line) // 4) END ORDER BY pos) AS ts FROM lines GROUP BY doc_id),
walk(doc_id, ts, i, win, first, tokens) AS (
  SELECT doc_id, ts, 1, 1, 1, ts[1] FROM t
  UNION ALL
  SELECT doc_id, ts, i + 1, CASE WHEN tokens + ts[i + 1] > 400 THEN win + 1 ELSE win END, CASE WHEN tokens + ts[i + 1] > 400 THEN i + 1 ELSE first END,
         CASE WHEN tokens + ts[i + 1] > 400 THEN ts[i + 1] ELSE tokens + ts[i + 1] END
  FROM walk WHERE i < len(ts)
)
SELECT doc_id AS chapter_id, win::INTEGER AS "window", first::INTEGER AS first, max(i)::INTEGER AS last, max(tokens)::BIGINT AS tokens FROM walk GROUP BY doc_id, win, first"""
)


@query(WINDOW_SQL)
def seg_greedy_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.token_windows(_lines(spark, sf_dir), 400, 0)


OVERLAP_SQL = (
    "WITH RECURSIVE "
    + LINES_SQL
    + """, t AS (SELECT doc_id, list(CASE WHEN strlen(line) = 0 THEN 0 ELSE greatest(1, strlen(line) // 4) END ORDER BY pos) AS ts FROM lines GROUP BY doc_id),
walk(doc_id, ts, s, e, total, w) AS (
  SELECT doc_id, ts, 0, 1, ts[1], 1 FROM t
  UNION ALL
  SELECT doc_id, ts, CASE WHEN grow THEN s ELSE nxt END, CASE WHEN grow THEN e + 1 ELSE nxt + 1 END, CASE WHEN grow THEN total + ts[e + 1] ELSE ts[nxt + 1] END, CASE WHEN grow THEN w ELSE w + 1 END
  FROM (SELECT *, total + ts[e + 1] <= 400 AS grow, greatest(e - 3, s + 1) AS nxt FROM walk WHERE e < len(ts))
)
SELECT doc_id AS chapter_id, w::INTEGER AS "window", (s + 1)::INTEGER AS first, max(e)::INTEGER AS last, max(total)::BIGINT AS tokens FROM walk GROUP BY doc_id, w, s"""
)


@query(OVERLAP_SQL)
def seg_overlap_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.token_windows(_lines(spark, sf_dir), 400, 3)


_RANKED = "WITH " + LINES_SQL + ", r AS (SELECT doc_id AS chapter_id, pos::INTEGER AS id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn, count(*) OVER (PARTITION BY doc_id) AS n FROM lines)"


@query(
    _RANKED
    + """, picks AS (SELECT DISTINCT chapter_id, round(i * (n - 1) / 11.0)::BIGINT AS j FROM (SELECT DISTINCT chapter_id, n FROM r WHERE n > 12), range(0, 12) AS t(i))
    SELECT chapter_id, id FROM r WHERE n <= 12 UNION ALL SELECT r.chapter_id, r.id FROM r JOIN picks ON picks.chapter_id = r.chapter_id AND picks.j = r.rn - 1"""
)
def smp_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.spread(_lines(spark, sf_dir).select("chapter_id", "id"), ["chapter_id"], [F.col("id")], 12)


@query(_RANKED + " SELECT chapter_id, id FROM r WHERE rn > n - 4")
def smp_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.tail(_lines(spark, sf_dir).select("chapter_id", "id"), ["chapter_id"], [F.col("id")], 4)


@query(_RANKED + " SELECT chapter_id, id FROM r WHERE rn <= 3 OR rn > n - 3")
def smp_bookend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.bookend(_lines(spark, sf_dir).select("chapter_id", "id"), ["chapter_id"], [F.col("id")], 6)


@query(_RANKED + " SELECT chapter_id, id FROM r WHERE n <= 12 OR rn <= 8 OR rn > n - 4")
def smp_head_tail_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.head_tail(_lines(spark, sf_dir).select("chapter_id", "id"), ["chapter_id"], [F.col("id")])


@query(_RANKED + " SELECT chapter_id, id, ((rn - 1) // 8)::BIGINT AS chunk FROM r")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.chunks(_lines(spark, sf_dir).select("chapter_id", "id"), ["chapter_id"], [F.col("id")], 8)
