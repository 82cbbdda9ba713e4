import math

from pyspark.sql import functions as F

from quire.operators import postings, revindex, search


def corpus(spark):
    rows = [("p-1", "c1", "Mara opened the well-known door."), ("p-2", "c1", "The résumé lay open."), ("p-3", "c2", "Mara left; the window stayed."), ("p-4", "c2", "mara MARA Mara door")]
    return spark.createDataFrame(rows, "id string, chapter_id string, text string")


def ids(df):
    return [r["id"] for r in df.collect()]


def run(spark, q, **how):
    return search.score(corpus(spark), q, ["id"], ["text"], **how)


def test_words_are_anded(spark):
    assert set(ids(run(spark, "mara door"))) == {"p-1", "p-4"}
    assert ids(run(spark, "resume")) == ["p-2"]
    assert ids(run(spark, "well-known")) == ["p-1"]
    assert ids(run(spark, "")) == [] and ids(run(spark, "?!")) == []


def test_operators(spark):
    assert set(ids(run(spark, "Mara AND door OR window"))) == {"p-1", "p-3", "p-4"}
    assert set(ids(run(spark, "mara NOT door"))) == {"p-3"}
    assert ids(run(spark, "OR")) == [] and ids(run(spark, "mara AND")) == []
    assert ids(run(spark, "door or window")) == []


def test_statistics_come_before_filters(spark):
    all_rows = {r["id"]: r["score"] for r in run(spark, "mara").collect()}
    some = {r["id"]: r["score"] for r in run(spark, "mara", where=F.col("chapter_id") == "c2").collect()}
    assert some == {k: all_rows[k] for k in ("p-3", "p-4")}


def test_formula(spark):
    got = {r["id"]: r["score"] for r in run(spark, "window").collect()}
    lengths = [6, 4, 5, 4]
    idf = math.log((4 - 1 + 0.5) / (1 + 0.5))
    want = -idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 5 / (sum(lengths) / 4)))
    assert abs(got["p-3"] - want) < 1e-9


def test_index_is_literal(spark):
    raw = '{"themes": ["Loss", "loss", 7, ""], "participants": ["Mara", " Mara "], "pov": "Mara", "unresolved": {"a": 1}}'
    cards = spark.createDataFrame([("s1", "c1", raw), ("s2", "c1", "not json")], "scene_id string, chapter_id string, raw_json string")
    refs = revindex.refs(cards)
    assert {(r["term_type"], r["term"]) for r in refs.collect()} == {("theme", "Loss"), ("theme", "loss"), ("participant", "Mara"), ("participant", " Mara "), ("pov", "Mara")}
    again = revindex.terms(refs.unionByName(refs))
    assert {r["occurrence_count"] for r in again.collect()} == {1}
    assert revindex.inspect(refs, "Mara")[0] == "refs" and revindex.inspect(refs, "Lo")[0] == "terms"


def test_index_shuffles_postings_once(spark):
    """Tokens meet in one exchange, by ranges; a larger index deals its texts before that and holds the same."""
    docs = spark.createDataFrame([(i, f"Étre word{i % 7} the the") for i in range(50)] + [(50, None), (50, "the The")], "id long, text string")
    built = postings.build(docs, ["id"], ["text"], 1)
    plan = built._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "rangepartitioning" in plan
    rows = lambda df: sorted(tuple(r) for r in df.drop("bucket").collect())
    want = sorted([t for i in range(50) for t in (("etre", i, 1, 4), (f"word{i % 7}", i, 1, 4), ("the", i, 2, 4))] + [("the", 50, 2, 2)])
    assert rows(built) == want
    assert rows(postings.build(docs, ["id"], ["text"], 2)) == want


def test_references_stay_dealt(spark):
    """A task sorts a share of the cards, however few bytes they are; a scene's references repeat nothing."""
    card = '{"themes": ["a", "a", "B"]}'
    cards = spark.createDataFrame([(str(i % 40), "1", card) for i in range(80)], "scene_id string, chapter_id string, raw_json string").coalesce(1)
    found = revindex.refs(cards)
    assert found.count() == 80
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
