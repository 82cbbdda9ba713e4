"""Replay of append-only logs: snapshots commit, the last commit wins.

Log rows carry ``seq``, the line order.  Epochs come from running sums over it
within a chapter, so chapters are replayed side by side.  Every rule that a
strict reader enforces is a row of a violations frame; ``require`` raises on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import clean_list
from quire.operators.segment import partition_violations

SCENE = "id string, chapter_id string, paragraph_start string, paragraph_end string, ordinal int, boundary_source string, status string"
CARD = "scene_id string, title string, summary string, evidence array<string>, status string, generation struct<run_id: string, model: string, prompt_version: string>"
ENTITY = "id string, chapter_id string, type string, canonical_name string, aliases array<string>, evidence array<string>, status string, generation struct<run_id: string, model: string, prompt_version: string>"
OCCURRENCE = "entity_id string, chapter_id string, scene_id string, surface_texts array<string>, source_fields array<string>, confidence double, status string"
SUMMARY = (
    "chapter_id string, chapter_title string, summary string, themes array<string>, unresolved array<string>, evidence array<string>, source_records array<string>,"
    " character_final_states array<struct<character_id:string,state:string>>, status string,"
    " generation struct<run_id:string,model:string,prompt_version:string,generated_at:string,character_roles_hash:string>"
)
SNAPSHOT = "chapter_id string, scene_count int, entity_count int, occurrence_count int, mention_count int, committed_at string"


class LogError(ValueError):
    """A log breaks a rule of replay."""


def require(violations: DataFrame, what: str) -> None:
    """Raise with the first violation, if there is one."""
    found = violations.orderBy(*violations.columns).limit(1).collect()
    if found:
        raise LogError(f"{what}: {found[0].asDict()}")


def records(log: DataFrame, record_type: str, schema: str) -> DataFrame:
    """Parsed rows of one type with their ``seq`` and the raw line."""
    some = log.where(F.col("record_type") == record_type)
    return some.select("seq", F.from_json("line", schema).alias("r"), F.col("line").alias("raw_json")).select("seq", "r.*", "raw_json")


def committed_epochs(rows: DataFrame, key: str, kind: str, commit: str, reset: Column, seq: str = "seq") -> DataFrame:
    """Item rows of the last committed epoch of each key.

    ``kind`` tells items from ``commit`` markers.  A marker commits the items
    since the marker before it, or since the last row where ``reset`` holds;
    items after the last marker aren't committed.  ``_marker`` is the seq of
    the marker that committed them.
    """
    w = Window.partitionBy(key).orderBy(seq)
    marker = F.col(kind) == commit
    # epochs count markers from the back: 1 is what the last marker committed
    back = Window.partitionBy(key).orderBy(F.desc(seq)).rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumns({"_epoch": F.sum(marker.cast("int")).over(back), "_reset": F.coalesce(reset, F.lit(False)) & ~marker})
    last = marked.where("_epoch = 1")
    until = Window.partitionBy(key)
    from_seq = F.coalesce(F.max(F.when(F.col("_reset"), F.col(seq))).over(until), F.lit(-(2**62)))
    placed = last.withColumns({"_from": from_seq, "_marker": F.max(F.when(marker, F.col(seq))).over(until)})
    return placed.where((F.col(kind) != commit) & (F.col(seq) >= F.col("_from"))).drop("_epoch", "_reset", "_from")


def epoch_counts(rows: DataFrame, key: str, item: str, kind: str, commit: str, reset: Column, seq: str = "seq") -> DataFrame:
    """(key, seq, pending): distinct items that each marker found pending."""
    marker = F.col(kind) == commit
    w = Window.partitionBy(key).orderBy(seq)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    epoch = F.coalesce(F.sum(marker.cast("int")).over(before), F.lit(0))
    marked = rows.withColumns({"_epoch": epoch, "_r": F.coalesce(reset, F.lit(False)) & ~marker})
    start = F.max(F.when(F.col("_r"), F.col(seq))).over(Window.partitionBy(key, "_epoch"))
    live = marked.withColumn("_from", F.coalesce(start, F.lit(-(2**62))))
    counted = live.groupBy(key, "_epoch").agg(
        F.max(F.when(marker, F.col(seq))).alias("seq"),
        F.count_distinct(F.when(~marker & (F.col(seq) >= F.col("_from")), F.col(item))).alias("pending"),
    )
    return counted.where("seq is not null").select(key, "seq", "pending")


def scenes(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(committed scenes, violations of counting) from a scene log."""
    items = records(log, "scene", SCENE)
    marks = records(log, "chapter_snapshot", SNAPSHOT)
    both = items.select("*", F.lit("item").alias("_kind")).unionByName(
        marks.select("seq", "chapter_id", "scene_count", F.lit("mark").alias("_kind")), allowMissingColumns=True
    )
    reset = F.col("ordinal") == 1
    live = committed_epochs(both, "chapter_id", "_kind", "mark", reset)
    # within an epoch the last line for an ordinal holds
    kept = live.groupBy("chapter_id", "ordinal").agg(F.max_by(F.struct(*[c for c in items.columns if c not in ("chapter_id", "ordinal")]), "seq").alias("r"))
    out = kept.select("chapter_id", "ordinal", "r.*")
    counts = epoch_counts(both, "chapter_id", "ordinal", "_kind", "mark", reset)
    wrong = counts.join(marks.select("chapter_id", "seq", "scene_count"), ["chapter_id", "seq"]).where("pending <> scene_count or scene_count is null")
    bad = items.where("id is null or trim(id) = '' or chapter_id is null or trim(chapter_id) = '' or ordinal is null or ordinal <= 0")
    problems = wrong.select("seq", F.format_string("scene_count mismatch for %s: declared %d, pending %d", "chapter_id", "scene_count", "pending").alias("problem"))
    return out, problems.unionByName(bad.select("seq", F.lit("scene without id, chapter or ordinal").alias("problem")))


def scene_snapshots(log: DataFrame) -> DataFrame:
    """(chapter_id, committed_at) of the last snapshot of each chapter."""
    marks = records(log, "chapter_snapshot", SNAPSHOT)
    return marks.groupBy("chapter_id").agg(F.max_by("committed_at", "seq").alias("committed_at"))


def scene_violations(committed: DataFrame, chapters: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Scenes that don't fit their chapters: (chapter_id, ordinal, problem)."""
    unknown = committed.join(chapters.select(F.col("id").alias("chapter_id")), "chapter_id", "left_anti")
    twice = committed.groupBy("id").agg(F.min("chapter_id").alias("chapter_id"), F.min("ordinal").alias("ordinal"), F.count("*").alias("n")).where("n > 1")
    return (
        unknown.select("chapter_id", "ordinal", F.lit("missing chapter").alias("problem"))
        .unionByName(twice.select("chapter_id", "ordinal", F.lit("duplicate scene id").alias("problem")))
        .unionByName(partition_violations(committed, paragraphs))
    )


def cards(log: DataFrame, committed: DataFrame) -> DataFrame:
    """The last card of each committed scene; skipped ones left out."""
    found = records(log, "scene_card", CARD)
    last = found.groupBy("scene_id").agg(F.max_by(F.struct(*[c for c in found.columns if c != "scene_id"]), "seq").alias("r")).select("scene_id", "r.*")
    live = last.join(committed.select(F.col("id").alias("scene_id"), "chapter_id", "paragraph_start", "paragraph_end"), "scene_id")
    return live.where(F.coalesce(F.lower(F.trim("status")), F.lit("")) != "skipped")


def card_violations(log: DataFrame, live: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(scene_id, problem): cards of scenes that never were, evidence out of range."""
    ever = records(log, "scene", SCENE).select(F.col("id").alias("scene_id")).distinct()
    lost = records(log, "scene_card", CARD).join(ever, "scene_id", "left_anti").select("scene_id", F.lit("missing scene").alias("problem"))
    place = paragraphs.select(F.col("id").alias("_pid"), F.col("chapter_id").alias("_pc"), F.col("ordinal").alias("_po"))
    ends = live.join(place.select(F.col("_pid").alias("paragraph_start"), F.col("_po").alias("_a")), "paragraph_start").join(
        place.select(F.col("_pid").alias("paragraph_end"), F.col("_po").alias("_b")), "paragraph_end"
    )
    cited = ends.select("scene_id", "chapter_id", "_a", "_b", F.explode("evidence").alias("_pid")).join(place, "_pid", "left")
    fits = (F.col("_pc") == F.col("chapter_id")) & F.col("_po").between(F.col("_a"), F.col("_b"))
    return lost.unionByName(cited.where(~F.coalesce(fits, F.lit(False))).select("scene_id", F.lit("evidence not in scene range").alias("problem")))


def entities(log: DataFrame, scene_chapters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(committed entities, violations of counting).

    ``scene_chapters`` (scene_id, chapter_id) places entities that name no
    chapter by the scenes they cite.  A new run id begins a new batch.  Old
    snapshots that count mentions commit nothing.
    """
    items = records(log, "entity", ENTITY)
    cited = items.where("chapter_id is null or trim(chapter_id) = ''").select("seq", F.explode("evidence").alias("scene_id"))
    inferred = cited.join(scene_chapters, "scene_id").groupBy("seq").agg(F.min("chapter_id").alias("_c"))
    items = items.join(inferred, "seq", "left").withColumn("chapter_id", F.coalesce(F.when(F.trim("chapter_id") != "", F.col("chapter_id")), "_c")).drop("_c")
    items = items.where("chapter_id is not null")
    marks = records(log, "entity_snapshot", SNAPSHOT).where("occurrence_count is not null or mention_count is null")
    both = items.select("*", F.lit("item").alias("_kind")).unionByName(
        marks.select("seq", "chapter_id", "entity_count", "occurrence_count", F.lit("mark").alias("_kind")), allowMissingColumns=True
    )
    run = F.trim(F.coalesce("generation.run_id", F.lit("")))
    w = Window.partitionBy("chapter_id").orderBy("seq")
    both = both.withColumn("_new", (F.col("_kind") == "item") & (F.coalesce(F.lag(F.when(F.col("_kind") == "item", run)).over(w), F.lit("\u0000")) != run))
    live = committed_epochs(both, "chapter_id", "_kind", "mark", F.col("_new"))
    rest = [c for c in items.columns if c not in ("chapter_id", "id")]
    out = live.groupBy("chapter_id", "id").agg(F.max_by(F.struct(*rest), "seq").alias("r")).select("chapter_id", "id", "r.*")
    counts = epoch_counts(both, "chapter_id", "id", "_kind", "mark", F.col("_new"))
    wrong = counts.join(marks.select("chapter_id", "seq", "entity_count"), ["chapter_id", "seq"]).where("pending <> entity_count or entity_count is null")
    problems = wrong.select("seq", F.format_string("entity_count mismatch for %s: declared %d, pending %d", "chapter_id", "entity_count", "pending").alias("problem"))
    twice = out.groupBy("id").agg(F.count("*").alias("n"), F.min("seq").alias("seq")).where("n > 1")
    return out, problems.unionByName(twice.select("seq", F.lit("duplicate committed entity id").alias("problem")))


def occurrences(log: DataFrame, committed: DataFrame, entity_log: DataFrame, scene_chapters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(last occurrence of each committed entity and scene, violations)."""
    rows = records(log, "occurrence", OCCURRENCE).withColumns(
        {"entity_id": F.trim("entity_id"), "scene_id": F.trim("scene_id"), "surface_texts": clean_list(F.col("surface_texts")), "source_fields": clean_list(F.col("source_fields"))}
    )
    ever = records(entity_log, "entity", ENTITY).select(F.col("id").alias("entity_id")).distinct()
    lost = rows.join(ever, "entity_id", "left_anti").select("seq", F.lit("missing entity").alias("problem"))
    live = rows.join(committed.select(F.col("id").alias("entity_id"), F.col("chapter_id").alias("_ec")), "entity_id")
    placed = live.join(scene_chapters.select("scene_id", F.col("chapter_id").alias("_sc")), "scene_id", "left")
    why = (
        F.when(F.col("_sc").isNull(), F.lit("missing scene"))
        .when((F.coalesce(F.trim("chapter_id"), F.lit("")) != "") & (F.col("chapter_id") != F.col("_sc")), F.lit("chapter differs from the scene's"))
        .when(F.col("_ec") != F.col("_sc"), F.lit("chapter differs from the entity's"))
        .when(F.coalesce(F.size("surface_texts"), F.lit(0)) <= 0, F.lit("no surface texts"))
    )
    judged = placed.withColumn("problem", why)
    good = judged.where("problem is null").withColumn("chapter_id", F.col("_sc")).drop("_sc", "_ec", "problem")
    rest = [c for c in good.columns if c not in ("entity_id", "scene_id")]
    out = good.groupBy("entity_id", "scene_id").agg(F.max_by(F.struct(*rest), "seq").alias("r")).select("entity_id", "scene_id", "r.*")
    return out, lost.unionByName(judged.where("problem is not null").select("seq", "problem"))


def occurrence_count_violations(found: DataFrame, entity_log: DataFrame) -> DataFrame:
    """Chapters whose occurrences aren't as many as their last snapshot says."""
    marks = records(entity_log, "entity_snapshot", SNAPSHOT).where("occurrence_count is not null")
    declared = marks.groupBy("chapter_id").agg(F.max_by("occurrence_count", "seq").alias("declared"))
    counted = found.groupBy("chapter_id").agg(F.count("*").alias("n"))
    return declared.join(counted, "chapter_id", "left").where(F.col("declared") != F.coalesce("n", F.lit(0))).select("chapter_id", "declared", F.coalesce("n", F.lit(0)).alias("found"))


def summaries(log: DataFrame, chapters: DataFrame, paragraphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(last summary of each record, violations (seq, problem)) from a summary log.

    A chapter's summary may cite paragraphs of that chapter only, the book's
    only chapters; both need a text.
    """
    both = [records(log, kind, SUMMARY).withColumn("record_type", F.lit(kind)) for kind in ("chapter_summary", "book_summary")]
    none = F.array().cast("array<string>")
    rows = both[0].unionByName(both[1]).withColumns(
        {
            "chapter_id": F.trim(F.coalesce("chapter_id", F.lit(""))),
            "summary": F.trim(F.coalesce("summary", F.lit(""))),
            "status": F.coalesce(F.when(F.trim("status") != "", F.trim("status")), F.lit("generated")),
            **{c: clean_list(F.coalesce(c, none)) for c in ("themes", "unresolved", "evidence", "source_records")},
        }
    )
    is_book = F.col("record_type") == "book_summary"
    rows = rows.withColumn("record_id", F.when(is_book, F.lit("book_summary")).otherwise(F.concat(F.lit("chapter_summary:"), "chapter_id")))
    known = chapters.select(F.col("id").alias("_c")).distinct()
    place = paragraphs.select(F.col("id").alias("_ref"), F.col("chapter_id").alias("_pc"))
    own = rows.where(
        (F.col("summary") == "") | (is_book & (F.col("chapter_id") != "")) | (~is_book & (F.col("chapter_id") == ""))
    ).select("seq", F.when(F.col("summary") == "", "no summary").when(is_book, "a book's summary with a chapter").otherwise("no chapter").alias("problem"))
    lost = rows.where(~is_book & (F.col("chapter_id") != "")).join(known, F.col("chapter_id") == F.col("_c"), "left_anti").select("seq", F.lit("missing chapter").alias("problem"))
    cited = rows.where(~is_book).select("seq", "chapter_id", F.explode("evidence").alias("_ref")).join(place, "_ref", "left")
    foreign = cited.where(F.coalesce(F.col("_pc") != F.col("chapter_id"), F.lit(True))).select("seq", F.lit("evidence isn't of the chapter").alias("problem"))
    named = rows.where(is_book).select("seq", F.explode(F.concat("evidence", "source_records")).alias("_ref")).join(known, F.col("_ref") == F.col("_c"), "left_anti")
    rest = [c for c in rows.columns if c != "record_id"]
    last = rows.groupBy("record_id").agg(F.max_by(F.struct(*rest), "seq").alias("r")).select("record_id", "r.*")
    bad = own.unionByName(lost).unionByName(foreign).unionByName(named.select("seq", F.lit("names a missing chapter").alias("problem")))
    return last, bad.distinct()


def roles(log: DataFrame) -> DataFrame:
    """Raw role lines that the last fitting snapshot of the whole log committed."""
    rows = log.where(F.col("record_type").isin("character_role", "character_roles_snapshot"))
    count = F.get_json_object("line", "$.role_count").cast("int")
    mark = F.col("record_type") == "character_roles_snapshot"
    # a role belongs to the snapshot after it: their number from the front is the same
    marks = rows.where(mark).select("seq", count.alias("_count"))
    bounds = [(r["seq"], r["_count"]) for r in marks.orderBy("seq").collect()]  # one for each compile of a book
    edges = F.array(*[F.lit(s).cast("long") for s, _ in bounds]) if bounds else F.array().cast("array<bigint>")
    placed = rows.where(~mark).withColumn("_epoch", F.size(F.filter(edges, lambda e: e < F.col("seq"))))
    sizes = {r["_epoch"]: r["n"] for r in placed.groupBy("_epoch").agg(F.count("*").alias("n")).collect()}
    fitting = [i for i, (_, n) in enumerate(bounds) if sizes.get(i, 0) == n]
    return placed.where(F.col("_epoch") == F.lit(fitting[-1] if fitting else -1)).select("seq", "line")


def pending(items: DataFrame, current: DataFrame, key: list[str], force: bool = False, same: Column | None = None) -> DataFrame:
    """Items that no current row covers; all of them if forced.

    ``same`` says which current rows still count, by prompt version, model or hash.
    """
    held = current if same is None else current.where(F.coalesce(same, F.lit(False)))
    return items if force else items.join(held.select(*key).distinct(), key, "left_anti")


def is_current_summary(version: str) -> Column:
    """Whether a summary has a text and was made with this prompt."""
    return (F.trim(F.coalesce("summary", F.lit(""))) != "") & (F.trim(F.coalesce("prompt_version", F.lit(""))) == version.strip())


def committed_prefix(results: DataFrame, seq: str = "seq", failed: Column | None = None) -> DataFrame:
    """Rows before the first failed one in order."""
    bad = F.col("failed") if failed is None else failed
    first = results.where(bad).agg(F.coalesce(F.min(seq), F.lit(2**62)).alias("_first"))
    # one row; its size doesn't follow the data
    return results.join(F.broadcast(first), F.col(seq) < F.col("_first")).drop("_first")
