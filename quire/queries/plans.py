"""Queries on question planning, verification and the model combinator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import phrases
from quire.functions import text as tx
from quire.plans import planner, verify
from quire.queries import query, table
from quire.queries.texts import LINES_SQL, lines
from quire.sources.provider import FakeProvider, attempt, generate

#: Question texts that each conversation turn asks, by turns; the last is its own text.
QUESTIONS = (
    "How does the book end?", "Who are the characters?", "How does Mara change?", "Give me a summary of this chapter.", "Summarize it!",
    "What are the themes?", "Overall, what happens in the whole book?", "Who is the narrator?", "Where is the door?",
)


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("conv_id") + F.col("turn")) % (len(QUESTIONS) + 1)
    asked = F.coalesce(F.get(F.array(*[F.lit(x) for x in QUESTIONS]), k.cast("int")), F.col("text"))
    mode = F.get(F.array(*[F.lit(x) for x in ("recall", "continuity", "style")]), (F.col("conv_id") % 3).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", asked.alias("question"), mode.alias("mode"))


def _any(words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(p, ' {w} ')" for w in words) + ")"


_ASKED_SQL = (
    "WITH asked AS (SELECT conv_id, turn, coalesce(list_extract(["
    + ", ".join("'" + x.replace("'", "''") + "'" for x in QUESTIONS)
    + f"], ((conv_id + turn) % {len(QUESTIONS) + 1} + 1)::INTEGER), text) AS question, list_extract(['recall', 'continuity', 'style'], (conv_id % 3 + 1)::INTEGER) AS mode FROM conversations),"
    + r"""
q AS (SELECT *, ' ' || trim(regexp_replace(translate(lower(question), '?.,!;:-_/\''"', '            '), '\s+', ' ', 'g')) || ' ' AS p FROM asked)"""
)
_INTENT_SQL = f"""CASE WHEN {_any(phrases.ENDING)} THEN 'ending' WHEN {_any(phrases.INVENTORY)} THEN 'character_inventory'
  WHEN {_any(phrases.GENERIC_ARC)} OR ({_any(phrases.CHANGE)} AND ({_any(phrases.HOW_DOES)} OR {_any(phrases.CHARACTER)})) THEN 'character_arc'
  WHEN {_any(phrases.SUMMARY)} AND {_any(phrases.CHAPTER)} THEN 'chapter_summary' WHEN {_any(phrases.SUMMARY)} THEN 'whole_summary'
  WHEN mode IN ('interpretation', 'style') OR {_any(phrases.THEME)} THEN 'theme_style' WHEN {_any(phrases.BROAD)} THEN 'broad'
  WHEN {_any(phrases.CHARACTER)} OR mode IN ('continuity', 'development') THEN 'character_question' ELSE 'narrow_recall' END"""


@query(
    _ASKED_SQL
    + f""", i AS (SELECT conv_id, turn, {_INTENT_SQL} AS intent FROM q)
    SELECT conv_id, turn, intent, CASE WHEN intent IN ('character_question', 'narrow_recall') THEN 20 ELSE 80 END AS paragraph_limit FROM i"""
)
def pl_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = planner.intent(F.col("question"), F.col("mode"), F.lit(""))
    q = _questions(spark, sf_dir).select("conv_id", "turn", kind.alias("intent"))
    return q.withColumn("paragraph_limit", planner.paragraph_limit(F.col("intent"), F.lit(20)))


_NAMES = (("mara", "character", ("the narrator",)), ("door", "object", ()), ("the end", "unknown", ("book",)), ("les", "group", ("der", "and")))


def _by_name(spark: SparkSession, sf_dir: str, score, pick: Column) -> DataFrame:  # noqa: ANN001
    """Questions scored against the few names, each name a row of an array: no join."""
    q = _questions(spark, sf_dir).withColumn("q", tx.normalize_question(F.col("question")))
    names = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("type"), F.array(*[F.lit(a) for a in al]).cast("array<string>").alias("aliases")) for n, t, al in _NAMES])
    rows = q.select("conv_id", "turn", "q", "mode", F.explode(names).alias("e"))
    return rows.select("conv_id", "turn", F.col("e.name").alias("name"), score(rows).alias("score")).where("score > 0")


def _mention(value: str) -> str:
    return f"contains(p, ' {value} ')"


_ENTITY_SQL = " UNION ALL ".join(
    f"""SELECT conv_id, turn, '{n}' AS name, (CASE WHEN {_mention(n)} THEN 100 ELSE 0 END + CASE WHEN {" OR ".join(map(_mention, al)) or "FALSE"} THEN 80 ELSE 0 END
    + CASE WHEN {_any(phrases.CHARACTER)} OR mode = 'continuity' THEN {dict(character=20, group=8, organization=8, unknown=4).get(t, 0)} ELSE 0 END)::INTEGER AS score FROM q"""
    for n, t, al in _NAMES
)


@query(_ASKED_SQL + f" SELECT * FROM ({_ENTITY_SQL}) WHERE score > 0")
def pl_entity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    def score(rows: DataFrame) -> Column:
        wants = planner.is_character_question(F.col("q"), F.col("mode"))
        return planner.entity_score(F.col("q"), F.col("e.name"), F.col("e.aliases"), F.col("e.type"), wants, F.lit(False))

    return _by_name(spark, sf_dir, score, F.lit(0))


_ROLE_SQL = " UNION ALL ".join(
    f"""SELECT conv_id, turn, '{n}' AS name, (CASE WHEN {_mention(n)} THEN 100 ELSE 0 END + CASE WHEN {" OR ".join(map(_mention, al)) or "FALSE"} THEN 80 ELSE 0 END
    + {70 if t == "object" else 0} + CASE WHEN intent = 'character_inventory' THEN {40 - {"character": 0, "group": 2}.get(t, 4)} ELSE 0 END
    + CASE WHEN intent = 'character_arc' AND {_any(phrases.GENERIC_ARC)} THEN {25 if t == "character" else 0} ELSE 0 END)::INTEGER AS score FROM i"""
    for n, t, al in _NAMES
)


@query(_ASKED_SQL + f", i AS (SELECT *, {_INTENT_SQL} AS intent FROM q) SELECT * FROM ({_ROLE_SQL}) WHERE score > 0")
def pl_role_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    def score(rows: DataFrame) -> Column:
        kind = planner.intent(F.col("q"), F.col("mode"), F.lit(""))
        rank = F.when(F.col("e.type") == "character", "principal").when(F.col("e.type") == "group", "supporting").otherwise("uncertain")
        return planner.role_score(F.col("q"), F.col("e.name"), F.col("e.aliases"), F.col("e.type") == "object", rank, kind)

    return _by_name(spark, sf_dir, score, F.lit(0))


@query(
    "WITH "
    + LINES_SQL
    + """, r AS (SELECT doc_id, pos, doc_id % 3 AS m, row_number() OVER w AS rn, count(*) OVER (PARTITION BY doc_id) AS n FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    picks AS (SELECT DISTINCT doc_id, round(i * (n - 1) / 7.0)::BIGINT AS j FROM (SELECT DISTINCT doc_id, n FROM r WHERE n > 8 AND m = 1), range(0, 8) AS t(i))
    SELECT r.doc_id, pos::INTEGER AS position FROM r LEFT JOIN picks ON picks.doc_id = r.doc_id AND picks.j = rn - 1
    WHERE n <= 8 OR (m = 0 AND rn > n - 8) OR (m = 1 AND j IS NOT NULL) OR (m = 2 AND rn <= 8)"""
)
def pl_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("doc_id") % 3
    kind = F.when(m == 0, "ending").when(m == 1, "broad").otherwise("narrow_recall")
    found = lines(spark, sf_dir).select("doc_id", F.col("pos").alias("position"))
    return planner.pack_paragraphs(found, ["doc_id"], 8, kind, m == 0)


@query(
    """SELECT doc_id, length(trim(text, ' ' || chr(10) || chr(9) || chr(13))) < 40 OR doc_id % 5 = 0 OR len(string_split(text, ' ')) > 500 AS suspicious FROM documents"""
)
def ver_select_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short texts, texts without evidence (every fifth), and those with over 16 participants and questions (500 words)."""
    d = table(spark, sf_dir, "documents")
    evidence = F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("p-1")))
    many = F.when(F.size(F.split("text", " ")) > 500, F.array_repeat(F.lit("x"), 17)).otherwise(F.array().cast("array<string>"))
    flag = verify.should_verify("selective", F.lit(False), verify.is_suspicious(evidence, F.col("text"), many, F.array().cast("array<string>")))
    return d.select("doc_id", flag.alias("suspicious"))


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'accepted' ELSE 'verified' END AS status FROM labels")
def ver_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", verify.status(F.col("toxic") != 1, F.col("quality") == 1).alias("status"))


@query(
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'first' WHEN doc_id % 3 = 1 THEN 'second' ELSE left(text, 20) END AS answer,
      CASE WHEN doc_id % 3 = 0 THEN 'none' WHEN doc_id % 3 = 1 THEN 'retry' ELSE 'fallback' END AS action FROM documents"""
)
def fake_llm_retry_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the rows is answered at once, a third when asked again, the rest from its own text."""
    first, second = FakeProvider((("ask 0", "first"),), default="!no"), FakeProvider((("ask 1", "second"),), default="!no")

    def ask(items: DataFrame, number: int, last: DataFrame | None) -> DataFrame:
        prompts = items.select("doc_id", F.concat(F.lit("ask "), F.col("doc_id") % 3).alias("user"))
        return generate(prompts, (first, second)[number - 1], "test", "").select("doc_id", F.col("content").alias("answer"), "error")

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = attempt(docs, ["doc_id"], ask, F.col("error") == "", lambda left: left.select("doc_id", F.substring("text", 1, 20).alias("answer")))
    return done.select("doc_id", "answer", "action")


@query(
    """WITH e AS (SELECT n_nationkey AS id, n_name AS name, n_regionkey, ' ' || lower(n_name) || ' ' AS p FROM nation),
    s AS (SELECT id, (CASE WHEN contains(' who is in france and who left china ', p) THEN 100 ELSE 0 END + CASE WHEN n_regionkey = 3 THEN 80 ELSE 0 END + CASE WHEN n_regionkey = 0 THEN 20 ELSE 4 END
      + CASE WHEN id IN (1, 2) THEN 60 ELSE 0 END)::INTEGER AS score, lower(name) AS l FROM e)
    SELECT id, score, row_number() OVER (ORDER BY score DESC, l, id) AS position FROM s ORDER BY score DESC, l, id LIMIT 6"""
)
def pl_top_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as entities of a question: names, aliases of one region, types, search hits, order and limit."""
    n = table(spark, sf_dir, "nation")
    e = n.select(
        F.col("n_nationkey").alias("id"), F.col("n_name").alias("canonical_name"), F.when(F.col("n_regionkey") == 3, F.array(F.lit("Who is"))).otherwise(F.array(F.lit("nobody"))).alias("aliases"),
        F.when(F.col("n_regionkey") == 0, "Character").otherwise("unknown").alias("type"),
    )
    best = planner.top_entities(e, "Who is in FRANCE, and who left China?", "recall", "character_question", ["1", "2"]).withColumn("_m", F.monotonically_increasing_id())
    return best.select("id", F.col("score").cast("int").alias("score"), F.row_number().over(Window.orderBy("_m")).cast("long").alias("position"))
