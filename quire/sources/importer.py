"""From source files to ordered, titled chapters.

Files are rows (path, file_name, content).  Every rule that makes an order
ambiguous is a row of a problems frame; ``plan_folder`` raises on it.
"""

from __future__ import annotations

import tomllib
import uuid
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.text import chapter_id, title_from_filename, uni_trim
from quire.operators.blocks import TITLE, titles

NUMBER = "^([0-9]+)[-_. ]+"
#: Stems of files that are never chapters.
NOT_CHAPTERS = ("readme", "license", "toc", "book")
MANIFESTS = ("toc.toml", "book.toml")


class AmbiguousOrder(ValueError):
    """The order of chapters can't be told from what there is."""


@dataclass
class Manifest:
    """Chapters in their order: file and, if given, title."""

    chapters: list[tuple[str, str]]
    title: str = ""
    version: int = 1
    warnings: list[str] = field(default_factory=list)


def read_files(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """(path, file_name, content) of eligible files right inside a folder."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    named = raw.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), F.decode("content", "UTF-8").alias("content"))
    return discover(named)


def discover(files: DataFrame) -> DataFrame:
    """Without hidden files and those that are never chapters."""
    stem = F.lower(F.regexp_replace("file_name", r"\.[^.]*$", ""))
    return files.where(~F.col("file_name").startswith(".") & ~stem.isin(*NOT_CHAPTERS))


def parse_manifest(text: str) -> Manifest:
    """A table of contents; empty lists, blank files and repeated files are errors."""
    data = tomllib.loads(text)
    chapters = [(str(c.get("file", "")).strip(), str(c.get("title", "")).strip()) for c in data.get("chapter", [])]
    if not chapters:
        raise AmbiguousOrder("the manifest lists no chapters")
    names = [f for f, _ in chapters]
    if "" in names:
        raise AmbiguousOrder("a chapter of the manifest names no file")
    twice = sorted({f for f in names if names.count(f) > 1})
    if twice:
        raise AmbiguousOrder(f"the manifest lists {twice[0]!r} twice")
    return Manifest(chapters, str(data.get("title", "")), int(data.get("version", 1)))


def manifest_order(files: DataFrame, manifest: Manifest) -> tuple[DataFrame, list[str]]:
    """(files with ``order`` and ``manifest_title``, warnings on files it leaves out)."""
    listed = files.sparkSession.createDataFrame([(i + 1, f, t) for i, (f, t) in enumerate(manifest.chapters)], "order int, file_name string, manifest_title string")
    missing = listed.join(files, "file_name", "left_anti").orderBy("order").limit(1).collect()
    if missing:
        raise AmbiguousOrder(f"the manifest lists {missing[0]['file_name']!r}, which isn't there")
    stray = [r["file_name"] for r in files.join(listed, "file_name", "left_anti").select("file_name").orderBy("file_name").collect()]
    return files.join(F.broadcast(listed), "file_name"), [f"{name} isn't in the manifest and was left out" for name in stray]


def numeric_order(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files with ``order`` by their number prefix, problems (file_name, problem))."""
    prefix = F.regexp_extract("file_name", NUMBER, 1)
    numbered = files.withColumn("number", F.when(prefix != "", prefix.try_cast("decimal(38,0)")))
    same = Window.partitionBy("number")
    marked = numbered.withColumn("_n", F.when(F.col("number").isNotNull(), F.count("*").over(same)))
    why = F.when(F.col("number").isNull(), F.lit("no numeric prefix")).when(F.col("_n") > 1, F.format_string("order value %s is shared", F.col("number").cast("string")))
    problems = marked.select("file_name", why.alias("problem")).where("problem is not null")
    # chapters of one book: as many rows as a folder has files
    order = F.row_number().over(Window.orderBy("number", "file_name"))
    return marked.withColumn("order", order).drop("_n"), problems


def build_chapters(ordered: DataFrame) -> DataFrame:
    """(id, ordinal, title, file, source_key, content): titles from manifest, heading or file name."""
    named = ordered.withColumn("manifest_title", F.lit("")) if "manifest_title" not in ordered.columns else ordered
    headings = titles(named, "file_name", "content").withColumnRenamed("title", "_heading")
    met = named.join(headings, "file_name", "left")
    fallback = title_from_filename(F.col("file_name"))
    title = F.coalesce(
        F.when(F.trim(F.coalesce("manifest_title", F.lit(""))) != "", F.trim("manifest_title")), F.col("_heading"), F.when(fallback != "", fallback), F.col("file_name")
    )
    cid = chapter_id(F.col("order"))
    return met.select(
        cid.alias("id"), F.col("order").alias("ordinal"), title.alias("title"), F.concat(cid, F.lit(".md")).alias("file"), F.col("file_name").alias("source_key"), "content"
    )


def plan_folder(files: DataFrame, manifest: Manifest | None = None) -> tuple[DataFrame, list[str]]:
    """(chapters, warnings) of a folder; its manifest, else number prefixes, give the order."""
    if files.isEmpty():
        raise AmbiguousOrder("no Markdown files found")
    if manifest is not None:
        ordered, warnings = manifest_order(files, manifest)
        return build_chapters(ordered), warnings
    ordered, problems = numeric_order(files)
    found = problems.orderBy("file_name").limit(1).collect()
    if found:
        raise AmbiguousOrder(f"{found[0]['file_name']}: {found[0]['problem']}")
    return build_chapters(ordered), []


def proposed_manifest(files: DataFrame) -> str:
    """A manifest to edit: the files by number, then name."""
    prefix = F.regexp_extract("file_name", NUMBER, 1)
    rows = files.select("file_name", prefix.try_cast("decimal(38,0)").alias("n")).orderBy(F.asc_nulls_last("n"), "file_name").collect()
    return "version = 1\n" + "".join(f'\n[[chapter]]\nfile = "{r["file_name"]}"\n' for r in rows)


def boundaries(docs: DataFrame, id_col: str, text_col: str, level: int = 1, regex: str | None = None) -> DataFrame:
    """(id_col, pos, line, title): lines with the chapter title where one begins, else null."""
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "\r\n", "\n")
    lines = docs.select(id_col, F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    if regex is None:
        start = "#" * level + " "
        rest = uni_trim(F.expr(f"substring(line, {level + 2})"))
        return lines.withColumn("title", F.when(F.col("line").startswith(start) & (rest != ""), rest))
    import re

    groups = re.compile(regex).groups
    hit = F.col("line").rlike(regex)
    title = uni_trim(F.regexp_extract("line", regex, 1)) if groups else uni_trim(F.col("line"))
    return lines.withColumns({"title": F.when(hit, title), "empty_match": hit & (F.regexp_extract("line", regex, 0) == "")})


def boundary_problems(marked: DataFrame, id_col: str) -> DataFrame:
    """(id_col, pos, problem): no boundary, empty or repeated titles, matches of no length."""
    starts = marked.where("title is not null")
    none = marked.select(id_col).distinct().join(starts.select(id_col).distinct(), id_col, "left_anti")
    found = none.select(id_col, F.lit(-1).alias("pos"), F.lit("no chapter boundary").alias("problem"))
    if "empty_match" in marked.columns:
        found = found.unionByName(starts.where("empty_match").select(id_col, "pos", F.lit("zero-length match").alias("problem")))
    found = found.unionByName(starts.where("title = ''").select(id_col, "pos", F.lit("empty title").alias("problem")))
    twice = starts.groupBy(id_col, F.lower("title").alias("_t")).agg(F.max("pos").alias("pos"), F.count("*").alias("n")).where("n > 1")
    return found.unionByName(twice.select(id_col, "pos", F.lit("duplicate title").alias("problem")))


def continuous_split(marked: DataFrame, id_col: str) -> DataFrame:
    """(id_col, chapter_no, title, content, source_key) of documents split at their boundaries.

    Chapter 0, what stands before the first one, is left out; see ``front_matter``.
    """
    w = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    numbered = marked.withColumn("chapter_no", F.sum(F.col("title").isNotNull().cast("int")).over(w))
    body = F.sort_array(F.collect_list(F.struct("pos", "line")))
    out = numbered.where("chapter_no > 0").groupBy(id_col, "chapter_no").agg(F.min_by("title", "pos").alias("title"), body.alias("_b"))
    content = F.array_join(F.transform("_b", lambda x: x["line"]), "\n")
    key = F.format_string("%s#chapter-%04d", F.col(id_col).cast("string"), F.col("chapter_no"))
    return out.select(id_col, "chapter_no", "title", content.alias("content"), key.alias("source_key"))


def front_matter(marked: DataFrame, id_col: str) -> DataFrame:
    """(id_col, has_front_matter): whether anything but blanks stands before the first boundary."""
    first = F.coalesce(F.min(F.when(F.col("title").isNotNull(), F.col("pos"))).over(Window.partitionBy(id_col)), F.lit(2**31 - 1))
    before = marked.withColumn("_first", first)
    hit = (F.col("pos") < F.col("_first")) & (uni_trim(F.col("line")) != "")
    return before.groupBy(id_col).agg(F.max(hit).alias("has_front_matter"))


def find_manifest(folder: str, named: str | None = None) -> str | None:
    """Path of the manifest to use: the one named, which must be there, else the first usual one in a local folder."""
    places = [named] if named else [f"{folder.rstrip('/')}/{m}" for m in MANIFESTS]
    found = next((p for p in places if Path(p).is_file()), None)
    if named and found is None:
        raise FileNotFoundError(f"no manifest at {named}")
    return found


def plan_file(docs: DataFrame, name: str, level: int = 1, regex: str | None = None, single: bool = False) -> tuple[DataFrame, list[str]]:
    """(chapters, warnings) of one continuous document (id, text): split at its boundaries, or whole."""
    if single:
        title = F.coalesce(F.when(F.regexp_extract("text", r"(?m)^# +(\S.*)$", 1) != "", F.trim(F.regexp_extract("text", r"(?m)^# +(\S.*)$", 1))), title_from_filename(F.lit(name)))
        one = docs.select(F.lit("ch-0001").alias("id"), F.lit(1).alias("ordinal"), title.alias("title"), F.lit("ch-0001.md").alias("file"), F.lit(name).alias("source_key"), F.col("text").alias("content"))
        return one, []
    marked = boundaries(docs.select(F.lit(name).alias("id"), "text"), "id", "text", level, regex)
    problems = boundary_problems(marked, "id").orderBy("pos").limit(1).collect()
    if problems:
        raise AmbiguousOrder(f"{name}, line {problems[0]['pos'] + 1}: {problems[0]['problem']}")
    order = F.col("chapter_no").cast("int")
    parts = continuous_split(marked, "id").select(F.format_string("ch-%04d", order).alias("id"), order.alias("ordinal"), "title", F.format_string("ch-%04d.md", order).alias("file"), "source_key", "content")
    front = front_matter(marked, "id").where("has_front_matter").count()
    return parts, [f"{name}: text before the first chapter was left out"] * front


def import_record(chapters: DataFrame, paragraphs: DataFrame, source: str = "", warnings: list[str] | None = None) -> DataFrame:
    """One row (run_id, type, source_path, imported_at, chapters, paragraphs, status, warnings) on an import that is done."""
    spark = chapters.sparkSession
    row = [(f"import-{uuid.uuid4().hex[:26]}", "markdown", source, datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), chapters.count(), paragraphs.count(), "completed", list(warnings or []))]
    return spark.createDataFrame(row, "run_id string, type string, source_path string, imported_at string, chapters int, paragraphs int, status string, warnings array<string>")


def contents(chapters: DataFrame, title: str = "") -> str:
    """The table of contents of chapters in order, as TOML that ``parse_manifest`` reads."""
    quoted = lambda v: '"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"'
    rows = chapters.select("file", "title").orderBy("ordinal").collect()  # one for each chapter of a book
    return f"version = 1\ntitle = {quoted(title)}\n" + "".join(f"\n[[chapter]]\nfile = {quoted(r['file'])}\ntitle = {quoted(r['title'])}\n" for r in rows)


def eligible(name: str) -> bool:
    """Whether one file name may be a chapter, for callers without a session."""
    return not name.startswith(".") and PurePosixPath(name).stem.lower() not in NOT_CHAPTERS


TITLE_PATTERN = TITLE
