import json

import pytest
from pyspark.sql import functions as F

from quire.operators import replay
from quire.sources import logs


def log(spark, rows):
    return spark.createDataFrame([(i + 1, r["record_type"], json.dumps(r)) for i, r in enumerate(rows)], "seq long, record_type string, line string")


def scene(i, a, b, ordinal, chapter="c1"):
    return {"record_type": "scene", "id": i, "chapter_id": chapter, "paragraph_start": a, "paragraph_end": b, "ordinal": ordinal, "status": "generated"}


def snap(n, chapter="c1"):
    return {"record_type": "chapter_snapshot", "chapter_id": chapter, "scene_count": n, "committed_at": "t"}


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_last_snapshot_wins(spark):
    rows = [scene("a", "p1", "p4", 1), snap(1), scene("b", "p1", "p2", 1), scene("c", "p3", "p4", 2), snap(2)]
    got, bad = replay.scenes(log(spark, rows))
    assert ids(got) == ["b", "c"] and bad.isEmpty()


def test_interrupted_and_restarted(spark):
    rows = [scene("a", "p1", "p4", 1), snap(1), scene("x", "p1", "p2", 1)]
    assert ids(replay.scenes(log(spark, rows))[0]) == ["a"]
    rows = [scene("x", "p1", "p2", 1), scene("y", "p3", "p3", 2), scene("a", "p1", "p4", 1), snap(1)]
    got, bad = replay.scenes(log(spark, rows))
    assert ids(got) == ["a"] and bad.isEmpty()


def test_count_mismatch(spark):
    _, bad = replay.scenes(log(spark, [scene("a", "p1", "p4", 1), snap(2)]))
    assert "mismatch" in bad.first()["problem"]
    with pytest.raises(replay.LogError):
        replay.require(bad, "log")


def test_empty_snapshot(spark):
    got, bad = replay.scenes(log(spark, [snap(0)]))
    assert ids(got) == [] and bad.isEmpty()


def test_cards(spark):
    p = spark.createDataFrame([(f"p{i}", "c1", i) for i in range(1, 5)], "id string, chapter_id string, ordinal int")

    def card(s, evidence, status="generated"):
        return {"record_type": "scene_card", "scene_id": s, "title": s, "summary": "x", "evidence": evidence, "status": status}

    rows = [scene("a", "p1", "p2", 1), scene("b", "p3", "p4", 2), snap(2), card("a", ["p3"]), card("a", ["p1"]), card("b", ["p3"], "skipped")]
    data = log(spark, rows)
    live = replay.cards(data, replay.scenes(data)[0])
    assert [(r["scene_id"], r["evidence"]) for r in live.collect()] == [("a", ["p1"])]
    assert replay.card_violations(data, live, p).isEmpty()
    wrong = log(spark, [*rows, card("a", ["p4"]), card("zz", [])])
    found = replay.card_violations(wrong, replay.cards(wrong, replay.scenes(wrong)[0]), p)
    assert sorted(r["problem"] for r in found.collect()) == ["evidence not in scene range", "missing scene"]


def test_entities_and_occurrences(spark):
    def entity(i, run, chapter="c1"):
        return {"record_type": "entity", "id": i, "chapter_id": chapter, "type": "character", "canonical_name": i, "aliases": [], "evidence": ["s1"], "generation": {"run_id": run}}

    mark = {"record_type": "entity_snapshot", "chapter_id": "c1", "entity_count": 1, "occurrence_count": 1}
    old = {"record_type": "entity_snapshot", "chapter_id": "c1", "entity_count": 9, "mention_count": 3}
    data = log(spark, [entity("e1", "r1"), entity("e2", "r2", ""), old, mark])
    where = spark.createDataFrame([("s1", "c1")], "scene_id string, chapter_id string")
    got, bad = replay.entities(data, where)
    assert ids(got) == ["e2"] and bad.isEmpty()
    occ = log(spark, [{"record_type": "occurrence", "entity_id": e, "scene_id": s, "surface_texts": t} for e, s, t in [("e2", "s1", [" A ", "A"]), ("e1", "s1", ["B"]), ("e9", "s1", ["C"])]])
    found, wrong = replay.occurrences(occ, got, data, where)
    assert [(r["entity_id"], r["surface_texts"]) for r in found.collect()] == [("e2", ["A"])]
    assert [r["problem"] for r in wrong.collect()] == ["missing entity"]
    assert replay.occurrence_count_violations(found, data).isEmpty()


def test_roles(spark):
    rows = [{"record_type": "character_role", "character_id": "a"}, {"record_type": "character_roles_snapshot", "role_count": 1}, {"record_type": "character_role", "character_id": "b"}, {"record_type": "character_roles_snapshot", "role_count": 2}]
    assert [json.loads(r["line"])["character_id"] for r in replay.roles(log(spark, rows)).collect()] == ["a"]


def test_prefix(spark):
    df = spark.createDataFrame([(1, False), (2, False), (3, True), (4, False)], "seq long, failed boolean")
    assert sorted(r["seq"] for r in replay.committed_prefix(df).collect()) == [1, 2]


def test_logs(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = logs.to_log(spark.range(50).select(F.col("id")), "n", 5, ["id"])
    logs.append(rows, path)
    back = logs.read_log(spark, path)
    assert [json.loads(r["line"])["id"] + 5 for r in back.orderBy("seq").collect()] == [r["seq"] for r in back.orderBy("seq").collect()]
    assert logs.next_seq(back) == 55
    (tmp_path / "foreign.jsonl").write_text('{"record_type": "a"}\n\nnot json\n')
    foreign = logs.read_foreign(spark, str(tmp_path / "foreign.jsonl"))
    assert logs.lenient(foreign).count() == 1
    with pytest.raises(logs.MalformedLog):
        logs.strict(foreign)


def test_log_numbers_follow_the_order(spark):
    """More rows than range bounds are sampled from: the numbers still have no gap and no repeat."""
    records = spark.range(40000).select((F.lit(39999) - F.col("id")).alias("id"), F.col("id").cast("string").alias("name"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as if partitions were too large to be merged
    try:
        got = logs.to_log(records, "n", 5, ["id"]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r["seq"], json.loads(r["line"])["id"]) for r in got) == [(i + 5, i) for i in range(40000)]


def test_staging(spark):
    kind = "layer string, sequence long, target_id string, task_id string, content_hash string, payload string"
    old = spark.createDataFrame([("a", 1, "x", "t", "h1", "")], kind)
    assert logs.stage(old, old).isEmpty()
    with pytest.raises(logs.StageConflict):
        logs.stage(old, old.withColumn("content_hash", F.lit("h2")))


def test_foreign_logs_are_numbered_over_splits(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    lines = [json.dumps({"record_type": "a" if i % 3 else "b", "i": i}) if i % 7 else "" for i in range(5000)]
    path.write_text("\r\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        got = logs.read_foreign(spark, str(path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r["seq"]: r["line"] for r in got} == {i + 1: x for i, x in enumerate(lines) if x}
    assert {r["record_type"] for r in got} == {"a", "b"}
