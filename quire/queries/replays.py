"""Queries on append-only logs, staging and run metrics; events are the log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import pack, replay
from quire.plans import metrics
from quire.queries import query, table
from quire.sources import logs
from quire.sources.aside import Aside


@query("SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS seq FROM events GROUP BY 1, 2")
def inc_last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "value", F.col("event_id").alias("seq"))
    return pack.latest(e, ["user_id", "event_type"])


_KIND_SQL = "CASE WHEN event_id % 5 = 4 THEN 'mark' ELSE 'item' END AS kind, event_id % 3 = 0 AND event_id % 5 <> 4 AS fresh"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log: every fifth is a commit, every third other one begins anew."""
    m = F.col("event_id")
    kind = F.when(m % 5 == 4, "mark").otherwise("item")
    return table(spark, sf_dir, "events").select("user_id", m.alias("seq"), kind.alias("kind"), ((m % 3 == 0) & (m % 5 != 4)).alias("fresh"), "event_type")


@query(
    f"""WITH log AS (SELECT user_id, event_id AS seq, {_KIND_SQL} FROM events),
    last AS (SELECT user_id, max(seq) AS m FROM log WHERE kind = 'mark' GROUP BY user_id),
    prev AS (SELECT log.user_id, coalesce(max(seq), -1) AS p FROM log JOIN last USING (user_id) WHERE kind = 'mark' AND seq < m GROUP BY log.user_id),
    live AS (SELECT log.*, m FROM log JOIN last USING (user_id) LEFT JOIN prev USING (user_id) WHERE seq < m AND seq > coalesce(p, -1)),
    start AS (SELECT user_id, max(seq) FILTER (fresh) AS s FROM live GROUP BY user_id)
    SELECT live.user_id, seq, m AS marker FROM live JOIN start USING (user_id) WHERE seq >= coalesce(s, -1)"""
)
def inc_snapshot_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = replay.committed_epochs(_log(spark, sf_dir), "user_id", "kind", "mark", F.col("fresh"))
    return live.select("user_id", "seq", F.col("_marker").alias("marker"))


@query(
    f"""WITH log AS (SELECT user_id, event_id AS seq, event_type, {_KIND_SQL} FROM events),
    ep AS (SELECT *, coalesce(sum((kind = 'mark')::INT) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS e FROM log),
    st AS (SELECT *, max(seq) FILTER (fresh) OVER (PARTITION BY user_id, e) AS s FROM ep)
    SELECT user_id, max(seq) FILTER (kind = 'mark') AS seq, count(DISTINCT event_type) FILTER (kind = 'item' AND seq >= coalesce(s, -1)) AS pending
    FROM st GROUP BY user_id, e HAVING max(seq) FILTER (kind = 'mark') IS NOT NULL"""
)
def inc_pending_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.epoch_counts(_log(spark, sf_dir), "user_id", "event_type", "kind", "mark", F.col("fresh"))


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def inc_skip_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.pending(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").where("quality = 1"), ["doc_id"])


@query("SELECT event_id, user_id FROM events WHERE event_id < (SELECT min(event_id) FROM events WHERE value > 100 AND event_id > 500)")
def inc_prefix_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = (F.col("value") > 100) & (F.col("event_id") > 500)
    return replay.committed_prefix(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), "event_id", failed).drop("value")


@query(
    """SELECT user_id::VARCHAR AS run_id, event_type AS task_type, count(*) AS tasks, count(*) FILTER (value > 150) AS failed, 0::BIGINT AS retried,
      sum(event_id)::BIGINT AS prompt_tokens, 0::BIGINT AS output_tokens, sum(event_id % 7)::BIGINT AS duration_ms FROM events GROUP BY 1, 2"""
)
def agg_run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("task_type"), F.when(F.col("value") > 150, "failed").otherwise("done").alias("status"),
        F.col("event_id").alias("prompt_tokens"), F.lit(None).cast("long").alias("output_tokens"), (F.col("event_id") % 7).alias("duration_ms"),
    )
    return metrics.task_totals(t)


@query(
    """WITH s AS (SELECT user_id, event_id AS a, event_id + 200 + event_id % 90 AS b FROM events),
    d AS (SELECT user_id, a AS t, 1 AS d FROM s UNION ALL SELECT user_id, b, -1 FROM s),
    o AS (SELECT user_id, sum(d) OVER (PARTITION BY user_id ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS n FROM d)
    SELECT user_id, max(n)::BIGINT AS max_open FROM o GROUP BY user_id"""
)
def agg_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return metrics.max_concurrency(table(spark, sf_dir, "events").select("user_id", e.alias("a"), (e + 200 + e % 90).alias("b")), "user_id", "a", "b")


@query("SELECT event_id AS seq, 'event' AS record_type FROM events WHERE json_valid(props)")
def src_log_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.lit("event").alias("record_type"), F.col("props").alias("line"))
    return logs.lenient(log).select("seq", "record_type")


@query("SELECT row_number() OVER (ORDER BY event_id) + 9 AS seq, event_id, 'event' AS record_type FROM events")
def snk_log_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records appended to a log in two goes, numbered on, and read back."""
    path = f"{Aside(spark, 'log').base}/log"
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    middle = e.agg(F.percentile_approx("event_id", 0.5)).first()[0]  # wherever the second go begins, the log is the same
    logs.append(logs.to_log(e.where(F.col("event_id") <= middle), "event", 10, ["event_id"]), path)
    logs.append(logs.to_log(e.where(F.col("event_id") > middle), "event", logs.next_seq(logs.read_log(spark, path)), ["event_id"]), path)
    return logs.read_log(spark, path).select("seq", F.get_json_object("line", "$.event_id").cast("long").alias("event_id"), "record_type")


@query("SELECT l_orderkey AS sequence, 'lines' AS layer FROM (SELECT DISTINCT l_orderkey FROM lineitem) WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0)")
def snk_stage_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = table(spark, sf_dir, "lineitem").select(F.lit("lines").alias("layer"), F.col("l_orderkey").alias("sequence")).distinct()
    staged = staged.withColumns({"target_id": F.col("sequence").cast("string"), "task_id": F.lit("t")})
    commits = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.lit("lines").alias("layer"), F.col("o_orderkey").alias("sequence"))
    return logs.uncommitted(staged, commits).select("layer", "sequence")


@query(
    """SELECT l_orderkey AS order_id, l_linenumber AS line, l_suppkey AS supplier FROM lineitem WHERE l_orderkey % 4 <> 0
    UNION ALL SELECT l_orderkey, min(l_linenumber), -1 FROM lineitem WHERE l_orderkey % 4 = 0 GROUP BY l_orderkey"""
)
def snk_replace_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("supplier"))
    fresh = current.where("order_id % 4 = 0").groupBy("order_id").agg(F.min("line").alias("line"))
    fresh = fresh.withColumn("supplier", F.lit(-1).cast(current.schema["supplier"].dataType))
    return pack.replace_group(current, fresh, "order_id")


@query(
    """SELECT user_id, event_type, CASE WHEN sum(CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END) > 0 THEN arg_max(value, event_id) FILTER (event_id % 4 = 0) ELSE arg_max(value, event_id) FILTER (event_id % 4 <> 0) END AS value
    FROM events GROUP BY 1, 2"""
)
def snk_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows replaced by changes that come later in the log."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "value", F.col("event_id").alias("seq"))
    changes = e.where("seq % 4 = 0").withColumn("seq", F.col("seq") + 10**12)
    return pack.upsert(e.where("seq % 4 <> 0"), changes, ["user_id", "event_type"]).drop("seq")
