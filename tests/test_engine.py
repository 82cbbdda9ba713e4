import json
import random
import uuid
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quire.engine import Engine, InsufficientEvidence
from quire.plans import compile as layers
from quire.plans import book, checking, doctor, planner, roles, verify
from quire.sources import prompts
from quire.sources.provider import FakeProvider, Response, attempt, generate
from quire.sources.settings import Settings
from quire.sources.store import Conflict, Store
from quire.streaming import replay as stream

TEXT = "# Chapter {n}\n\nMara opened door {n}.\n\nShe waited.\n\n***\n\nThe window closed at {n}.\n\nNobody came."


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "book"), Settings(card_policy="include-generated", max_evidence=4))
    files = spark.createDataFrame([(f"/x/{n}-c.md", f"{n}-c.md", TEXT.format(n=n)) for n in (1, 2)], "path string, file_name string, content string")
    e.import_files(files)
    return e


def test_import_and_search(engine):
    assert engine.status()["paragraphs"] == 8
    hits = engine.search("mara door")["paragraphs"].collect()
    assert [r["text"] for r in hits] == ["Mara opened door 1.", "Mara opened door 2."] or len(hits) == 2
    with pytest.raises(FileExistsError):
        engine.import_files(None)


def test_compile_and_ask(engine):
    engine.compile_scenes()
    assert engine.status()["scenes"] == 4
    p = engine.store.read("paragraphs").where(F.col("text") == "Mara opened door 1.").first()["id"]
    good = json.dumps({"title": "Door", "summary": {"action": "Mara opens it"}, "evidence": [{"paragraph_id": p}], "themes": ["doors"]})
    engine.compile_cards(FakeProvider(((p, f"```json\n{good}\n```"),), default='{"summary": "x", "evidence": ["p-none"]}'))
    cards = {r["title"]: r for r in engine.store.read("scene_cards").collect()}
    assert cards["Door"]["summary"] == "Mara opens it" and cards["Door"]["action"] == "none"
    assert sum(r["action"] == "fallback" for r in cards.values()) == 3
    assert engine.status()["index_terms"] == 1
    engine.compile_summaries(FakeProvider(default=json.dumps({"summary": "s", "themes": "one", "evidence": [p]})))
    assert {r["summary"] for r in engine.store.read("summaries").where("chapter_id = 'ch-0001'").collect()} == {"s"}
    got = engine.ask("mara door", FakeProvider(default=json.dumps({"answer": "yes", "evidence": [p, "p-made-up"]})))
    assert got.text == "yes" and got.evidence == [p] and got.intent == "narrow_recall"
    given = engine.packet("How does the book end?")
    assert given.intent == "ending" and given.section("paragraph") and given.section("summary")
    assert engine.cards_to_verify("recovered").count() == 3
    calls = engine.store.read("tasks").collect()
    assert [r["task_type"] for r in calls] == ["answer"] and calls[0]["prompt"].endswith("mara door") and engine.store.read("runs").first()["status"] == "completed"
    with pytest.raises(OSError):
        engine.ask("mara door", FakeProvider(default="!down"))
    assert {r["status"] for r in engine.store.read("runs").collect()} == {"completed", "failed"}


def people(engine):
    """Scenes, cards, entities and roles of the two-chapter book, all by scripted models."""
    engine.compile_scenes()
    p = {r["text"]: r["id"] for r in engine.store.read("paragraphs").collect()}
    script = []
    for n in (1, 2):
        body = {"title": f"Door {n}", "summary": f"Mara opens door number {n} and waits for someone.", "evidence": [p[f"Mara opened door {n}."]], "participants": ["Mara"], "entities": ["door"]}
        script.append((p[f"Mara opened door {n}."], json.dumps(body)))
    engine.compile_cards(FakeProvider(tuple(script), default="{}"))
    scenes = {r["title"]: r["scene_id"] for r in engine.store.read("scene_cards").where("title like 'Door%'").collect()}
    said = lambda n: {"entities": [{"canonical_name": "Mara", "type": "character", "aliases": ["the girl"], "occurrences": [{"scene_id": scenes[f"Door {n}"], "surface_texts": ["mara"], "confidence": 0.9}]}]}
    engine.compile_entities(FakeProvider(tuple((scenes[f"Door {n}"], json.dumps(said(n))) for n in (1, 2))))
    return p, scenes


def test_entities_roles_and_book(engine):
    p, scenes = people(engine)
    e = engine.store.read("entities").orderBy("chapter_id").collect()
    assert [(r["canonical_name"], r["type"]) for r in e] == [("Mara", "character")] * 2 and engine.status()["occurrences"] == 2
    assert {(r["chapter_id"], r["entity_count"], r["occurrence_count"]) for r in engine.store.read("entity_snapshots").collect()} == {("ch-0001", 1, 1), ("ch-0002", 1, 1)}
    role = {"source_entity_ids": [r["id"] for r in e], "canonical_name": "The Girl", "classification": "Principal", "role": "hero", "rationale": "she acts", "evidence": [{"scene_id": scenes["Door 1"], "reason": "opens it"}]}
    answer = lambda r: FakeProvider(default=json.dumps({"roles": [r]}))
    with pytest.raises(roles.RoleError, match="without a role"):
        engine.compile_roles(answer(role | {"source_entity_ids": [e[0]["id"]]}))
    with pytest.raises(roles.RoleError, match="principal without"):
        engine.compile_roles(answer(role | {"evidence": []}))
    assert engine.compile_roles(answer(role)) and not engine.compile_roles(FakeProvider(default="!not asked"))
    r = engine.store.read("roles").first()
    assert (r["canonical_name"], r["aliases"], r["classification"]) == ("the girl", ["Mara"], "principal")
    assert engine.compile_roles(answer(role | {"role": "villain"}), force=True) and engine.store.read("roles").first()["character_id"] == r["character_id"]
    engine.compile_summaries(FakeProvider(default=json.dumps({"summary": "Doors open.", "evidence": list(p.values())})))
    whole = {"summary": "All doors open.", "evidence": ["ch-0001", "ch-0002"], "character_final_states": [{"character_id": r["character_id"], "state": " waits "}, {"character_id": r["character_id"], "state": "x"}]}
    for wrong, why in ((whole | {"evidence": ["ch-0001"]}, "chapter not cited"), (whole | {"character_final_states": []}, "no final state")):
        with pytest.raises(book.SummaryError, match=why):
            engine.compile_book(FakeProvider(default=json.dumps(wrong)))
    engine.compile_book(FakeProvider(default=json.dumps(whole)))
    got = engine.store.read("summaries").where("record_type = 'book_summary'").first()
    assert got["summary"] == "All doors open." and [tuple(x) for x in got["character_final_states"]] == [(r["character_id"], "waits")] and got["source_records"] == ["ch-0001", "ch-0002"]
    given = engine.packet("Who are the characters?")
    assert given.intent == "character_inventory" and [x["record_id"] for x in given.section("role")] == [f"character_role:{r['character_id']}"]
    assert given.section("summary")[0]["record_id"] == "book_summary" and {"ch-0001", e[0]["id"]} <= given.valid_records()
    made = engine.ask("Who are the characters?", FakeProvider(default='{"answer": "Mara", "records_used": ["no such"]}'))
    assert made.records_used == given.records()
    made = engine.ask("Who are the characters?", FakeProvider(default=json.dumps({"answer": "Mara", "records_used": [f"character_role:{r['character_id']}", "x"]})))
    assert made.records_used == [f"character_role:{r['character_id']}"]


def test_cut_off_book_summary(engine):
    engine.compile_scenes()
    engine.compile_summaries(FakeProvider(default='{"summary": "One thing. Another."}'))
    engine.compile_book(FakeProvider(default='{"summary": "Cut'))
    got = engine.store.read("summaries").where("record_type = 'book_summary'").first()
    assert got["action"] == "fallback" and got["evidence"] == ["ch-0001", "ch-0002"] and got["summary"].count("door") == 2


def test_verification_layer(engine):
    people(engine)
    before = engine.store.read("scene_cards").count()
    engine.compile_verification(FakeProvider((("door number 1", '{"supported": false}'),), default='{"verification": {"supported": true, "support_level": "Direct"}}'), "all")
    got = {r["title"]: r for r in engine.store.read("scene_cards").collect()}
    assert len(got) == before and got["Door 1"]["status"] == "rejected" and got["Door 2"]["status"] == "verified" and got["Door 2"]["verification"]["support_level"] == "explicit"
    assert engine.cards_to_verify("all").count() == 0
    with pytest.raises(checking.VerdictError):
        engine.compile_verification(FakeProvider(default="{}"), "all", force=True)


def test_condensed_evidence(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "long"), Settings(max_evidence=2))
    text = "# One\n\n" + "\n\n".join(f"Overall thing {i}." for i in range(20))
    e.import_files(spark.createDataFrame([("/x/1-a.md", "1-a.md", text)], "path string, file_name string, content string"))
    first = e.store.read("paragraphs").where("ordinal = 1").first()["id"]
    fake = FakeProvider((("## Question", '{"answer": "a", "records_used": ["digest-0001"]}'),), default=json.dumps({"summary": "things", "support": [first, "p-none"]}))
    got = e.ask("Overall, what?", fake)
    given = e.packet("Overall, what?", provider=fake)
    assert got.records_used == ["digest-0001"] and len(given.section("digest")) == 3 and len(given.section("paragraph")) == 2 and first in given.valid_records()


@pytest.mark.parametrize("how,want", [("skip", "skipped"), ("fallback", "generated")])
def test_failed_cards(engine, how, want):
    engine.compile_scenes()
    scenes, p = engine.store.read("scenes"), engine.store.read("paragraphs")
    done = layers.scene_cards(scenes, p, FakeProvider(default="!timeout: slow"), on_failure=how)
    assert {r["status"] for r in done.collect()} == {want}
    with pytest.raises(layers.ExtractionError):
        layers.scene_cards(scenes, p, FakeProvider(default="!no"), on_failure="strict")


def test_each_row_is_asked_once_a_try(spark, tmp_path):
    class Counting:
        """Answers at random and notes each call in a file of its own."""

        def __init__(self, folder):
            self.folder = folder

        def generate(self, request):
            path = Path(self.folder) / f"{request.user}-{uuid.uuid4().hex}"
            path.write_text("x")
            return Response(json.dumps({"ok": random.random() < 0.5, "by": path.name}))

    items = spark.range(40).select(F.col("id").alias("k"))

    def ask(left, number, last):
        return generate(left.select("k", F.format_string(f"t{number}-%d", "k").alias("user")), Counting(str(tmp_path)), "t", "").select("k", F.get_json_object("content", "$.ok").alias("ok"))

    done = attempt(items, ["k"], ask, F.col("ok") == "true", lambda left: left.select("k"), tries=3)
    rows = [done.collect() for _ in range(2)]
    assert sorted(map(tuple, rows[0])) == sorted(map(tuple, rows[1])) and len(rows[0]) == 40 and len({r["k"] for r in rows[0]}) == 40
    asked = Counter(tuple(f.name.split("-")[:2]) for f in tmp_path.iterdir())
    assert set(asked.values()) == {1} and sum(k[0] == "t1" for k in asked) == 40 > sum(k[0] == "t2" for k in asked) > sum(k[0] == "t3" for k in asked)


def test_nothing_to_answer_from(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "none"))
    files = spark.createDataFrame([("/x/1-a.md", "1-a.md", "# Only a title")], "path string, file_name string, content string")
    e.import_files(files)
    with pytest.raises(InsufficientEvidence):
        e.ask("who?", FakeProvider())


@pytest.mark.parametrize(
    "question,mode,chapter,want",
    [
        ("How does it end?", "recall", "", "ending"), ("List the characters", "recall", "", "character_inventory"), ("How does Mara change?", "recall", "", "character_arc"),
        ("Recap", "recall", "", "whole_summary"), ("Recap", "recall", "ch-0001", "chapter_summary"), ("Which motif?", "recall", "", "theme_style"), ("x", "style", "", "theme_style"),
        ("Overall?", "recall", "", "broad"), ("Who is he?", "recall", "", "character_question"), ("x", "continuity", "", "character_question"), ("Where?", "recall", "", "narrow_recall"),
    ],
)
def test_intents(spark, question, mode, chapter, want):
    assert spark.range(1).select(planner.intent(F.lit(question), F.lit(mode), F.lit(chapter)).alias("i")).first()["i"] == want


def test_summaries_for(spark):
    s = spark.createDataFrame(
        [("b", "book_summary", None, "B"), ("c1", "chapter_summary", "ch-0001", "C"), ("c2", "chapter_summary", "ch-0002", " ")], "record_id string, record_type string, chapter_id string, summary string"
    ).withColumns({"themes": F.array().cast("array<string>"), "unresolved": F.array().cast("array<string>")})
    pick = lambda kind, chapter="": sorted(r["record_id"] for r in planner.summaries_for(s, kind, chapter).collect())
    assert pick("whole_summary") == ["b"] and pick("chapter_summary") == ["c1"] and pick("broad", "ch-0001") == ["c1"] and pick("ending") == ["b"]


def test_verification():
    assert verify.effective_mode(None, "selective") == "selective" and verify.effective_mode("off", "all") == "off" and verify.effective_mode("x", None) == "all"


def test_roles(spark):
    e = spark.createDataFrame([("e1", "character"), ("e2", "character")], "id string, type string")
    o = spark.createDataFrame([("e1", "s1")], "entity_id string, scene_id string")
    r = spark.createDataFrame([("c1", ["e1"], "principal", "", [("s2", "why")])], "character_id string, source_entity_ids array<string>, classification string, rationale string, evidence array<struct<scene_id:string,reason:string>>")
    problems = {x["problem"].split(":")[0] for x in layers.role_violations(r, e, o).collect()}
    assert problems == {"entity without a role", "evidence of a scene it isn't in", "principal without rationale or evidence"}
    same = layers.stable_roles(r.withColumn("character_id", F.lit(None).cast("string")), r)
    assert same.first()["character_id"] == "c1"


def test_cut_off_entities(spark):
    content = '{"entities": [{"name": "Mara", "type": "Character", "occurrences": [{"scene_id": "s1", "surface_texts": ["mara"]}]}, {"name": "Cut'
    a = spark.createDataFrame([("c1", content)], "chapter_id string, content string")
    refs = spark.createDataFrame([("s1", "Mara ")], "scene_id string, raw_value string")
    scenes = spark.createDataFrame([("s1", "c1")], "id string, chapter_id string")
    found, occ = layers.entities_from(a, refs, scenes)
    assert [(r["canonical_name"], r["type"]) for r in found.collect()] == [("Mara", "character")] and occ.first()["confidence"] == 0.8


def test_store_keeps_the_old_tables(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.rebuild({"a": spark.range(3), "b": spark.range(2)})
    bad = spark.range(1).select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception, match="no"):
        store.update({"a": bad})
    assert store.read("a").count() == 3


def test_store_copies_nothing_and_deletes_late(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.rebuild({"a": spark.range(3), "b": spark.range(2)}, seen=1)
    old = store.read("a")
    files = lambda n: sorted(p.name for p in (tmp_path / "s" / n).iterdir())
    b = files("b")
    store.update({"a": spark.range(5)})
    assert files("b") == b and len(files("a")) == 2 and old.count() == 3 and store.read("a").count() == 5 and store.note("seen") == 1
    store.append({"a": spark.range(1)})
    assert store.read("a").count() == 6 and store.parts("a") == 2
    store.update({}, drop=("b",))
    assert store.names() == ["a"] and store.vacuum() == 1 and old.sparkSession.read.parquet(*[f"{tmp_path}/s/a/{x}" for x in files("a")]).count() == 6


def test_store_survives_a_death_between_its_steps(spark, tmp_path, monkeypatch):
    """Whatever step fails, the tables are the old ones, and the next change goes through."""
    store = Store(spark, str(tmp_path / "s"))
    store.rebuild({"a": spark.range(3)})
    real = store._fs

    class Dying:
        def __init__(self, at):
            self.at = at

        def __getattr__(self, name):
            if name == self.at:
                raise OSError("died")
            return getattr(real, name)

    for at in ("create", "rename"):
        monkeypatch.setattr(store, "_fs", Dying(at))
        with pytest.raises(OSError, match="died"):
            store.update({"a": spark.range(9)})
        monkeypatch.setattr(store, "_fs", real)
        assert Store(spark, str(tmp_path / "s")).read("a").count() == 3
    store.update({"a": spark.range(4)})
    assert store.read("a").count() == 4


def test_two_writers(spark, tmp_path):
    one, two = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    one.rebuild({"a": spark.range(3)})
    seen = two._manifest()
    one.update({"a": spark.range(4)})
    with pytest.raises(Conflict):
        two._commit({"a": spark.range(5)}, seen, 0, {})
    assert one.read("a").count() == 4


def test_stream(spark, tmp_path):
    path = str(tmp_path / "log")
    kind = "seq long, record_type string, line string"
    store = Store(spark, str(tmp_path / "t"))
    for rows in ([(1, "a", "x"), (2, "b", "y")], [(3, "a", "z")]):
        spark.createDataFrame(rows, kind).write.mode("append").parquet(path)
        stream.start_latest(stream.read_stream(spark, path), store, "latest", ["record_type"], str(tmp_path / "cp")).awaitTermination()
    got = lambda: {(r["record_type"], r["line"]) for r in stream.read_latest(store, "latest", ["record_type"]).collect()}
    assert got() == {("a", "z"), ("b", "y")}
    again = stream.merge_latest(store, "latest", ["record_type"])
    again(spark.createDataFrame([(9, "a", "late")], kind), store.note("latest.batch"))  # a batch that is run again
    assert got() == {("a", "z"), ("b", "y")}


def test_prompts(tmp_path):
    assert set(prompts.sync(tmp_path).values()) == {"written"} and set(prompts.sync(tmp_path).values()) == {"kept"}
    (tmp_path / "answer.md").write_text("prompt-version: answer-v0\nold")
    (tmp_path / "roles.md").write_text("mine")
    done = prompts.sync(tmp_path)
    assert done["answer"] == "upgraded" and done["roles"] == "kept"
    assert prompts.load(tmp_path, "roles").version == "custom" and prompts.load(None, "roles").version == "roles-v1" and prompts.load(tmp_path, "answer").version == "answer-v1"


def test_doctor(engine, spark, tmp_path):
    assert all(c.ok for c in doctor.check_settings(Settings())) and all(c.ok for c in doctor.check_tables(engine.store))
    wrong = {c.name for c in doctor.check_settings(Settings(scene_mode="x", max_evidence=0, models={"a": {"base_url": "nothing"}})) if not c.ok}
    assert wrong == {"scene_mode", "max_evidence", "models.a"}
    assert not doctor.check_tables(Store(spark, str(tmp_path / "empty")))[0].ok
    engine.compile_scenes()
    engine.store.update({"scenes": engine.store.read("scenes").where("ordinal > 1")})
    assert [c.name for c in doctor.check_tables(engine.store) if not c.ok] == ["scenes"]
    assert doctor.check_provider(FakeProvider()).ok and not doctor.check_provider(FakeProvider(default="!down")).ok


def test_deleted_scenes(engine):
    _, scenes = people(engine)
    engine.delete_scenes(engine.store.read("scene_cards").where("title = 'Door 1'").select("scene_id"))
    assert engine.status()["scenes"] == 3 and engine.status()["scene_cards"] == 3 and engine.status()["index_terms"] == 0
    assert [r["chapter_id"] for r in engine.store.read("entities").collect()] == ["ch-0002"] and engine.status()["occurrences"] == 1
    assert engine.search("mara")["scene_cards"].where(F.col("scene_id") == scenes["Door 1"]).isEmpty()
