"""Drop lines that several documents share, keeping one owner for each.

Lines are exploded to 128-bit hashes of their normalised form, which are written
once, as both steps that follow read them.  One aggregation with map-side
combining finds, for each hash, how many documents hold it and the smallest of
them; a join brings that back to the line hashes; the text meets the decisions
only once, as arrays of dropped positions.

Defined results: a null or empty text is one empty line; a null ``doc_id``
owns and drops nothing; rows that repeat a ``doc_id`` are one document when
documents are counted, but each row keeps its own lines; an empty table gives
an empty result.  Columns other than id and text pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.nativetext import BLANKS, ascii_lower
from quire.llm.scratch import Scratch, set_aside

MIN_CHARS = 10
MIN_DOCS = 2


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def shared_lines(rows: DataFrame, min_docs: int) -> DataFrame:
    """(h1, h2, owner) of each line key that at least ``min_docs`` documents hold."""
    held = rows.where(F.col("_id").isNotNull())
    per_key = held.groupBy("h1", "h2")
    if min_docs == 2:
        # two documents at least: the smallest and the largest differ
        found = per_key.agg(F.min("_id").alias("owner"), F.max("_id").alias("_last")).where("owner < _last")
    else:
        found = per_key.agg(F.min("_id").alias("owner"), F.countDistinct("_id").alias("_n")).where(F.col("_n") >= min_docs)
    return found.select("h1", "h2", "owner")


def dropped_positions(rows: DataFrame, min_docs: int) -> DataFrame:
    """(_id, _t, _gone): for each document row the line positions that go."""
    # The join key is made anew from the aggregate's columns, so both sides are
    # dealt for this join alone and the adaptive planner may split a hot line.
    x, y = F.col("h1").bitwiseXOR(F.col("h2")).alias("_x"), F.col("h2").alias("_y")
    shared = shared_lines(rows, min_docs).select(x, y, "owner")
    held = rows.where(F.col("_id").isNotNull()).select("_id", "_t", "_pos", x, y)
    gone = held.join(shared, ["_x", "_y"]).where("_id > owner")
    return gone.groupBy("_id", "_t").agg(F.collect_set("_pos").alias("_gone"))


def _without(lines: Column, gone: Column) -> Column:
    """The lines but those at the positions ``gone``, joined; linear but for one sort."""
    every = F.sequence(F.lit(0), F.size(lines) - 1)
    kept = F.transform(F.array_except(every, gone), lambda p: F.struct(p.alias("p"), F.lit(True).alias("k")))
    cut = F.transform(gone, lambda p: F.struct(p.alias("p"), F.lit(False).alias("k")))
    marks = F.sort_array(F.concat(kept, cut))
    return F.array_join(F.zip_with(lines, marks, lambda line, m: F.when(m["k"], line)), "\n")


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
) -> DataFrame:
    """``docs`` with the text reduced, plus ``n_lines`` and ``n_dropped``."""
    if min_docs < 2:
        raise ValueError("min_docs must be 2 or more")
    text = F.col(text_col)
    keyed = docs.select(
        F.col(id_col).alias("_id"),
        F.xxhash64(text).alias("_t"),
        F.posexplode(F.transform(_lines(text), line_key)).alias("_pos", "_key"),
    )
    rows = keyed.where(F.char_length("_key") >= min_chars).select(
        "_id", "_t", "_pos", F.xxhash64("_key").alias("h1"), F.xxhash64(F.lit("second"), "_key").alias("h2")
    )
    rows = Scratch(docs.sparkSession, "lines").save(rows, "hashes")
    gone = dropped_positions(rows, min_docs).withColumnsRenamed({"_id": "_q_id", "_t": "_q_t"})
    joined = docs.join(gone, (docs[id_col] == gone["_q_id"]) & (F.xxhash64(docs[text_col]) == gone["_q_t"]), "left")
    lines = _lines(text)
    dropped = F.coalesce(F.size(F.col("_gone")), F.lit(0)).cast("long")
    return joined.withColumns(
        {
            text_col: F.when(F.col("_gone").isNull(), F.coalesce(text, F.lit(""))).otherwise(_without(lines, F.col("_gone"))),
            "n_lines": F.size(lines).cast("long"),
            "n_dropped": F.when(F.col("_gone").isNull(), F.lit(0).cast("long")).otherwise(dropped),
        }
    ).drop("_q_id", "_q_t", "_gone")


def reduced(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs``, its own columns only, with reduced texts and their lengths.

    A document of which nothing but blanks is left, all else being lines that
    others hold, is dropped; so is one that had no text.
    """
    aside, back = set_aside(docs, ("n_lines", "n_dropped"))
    done = dedup_lines(aside, id_col, text_col)
    if chars_col in docs.columns:
        done = done.withColumn(chars_col, F.char_length(text_col).cast("long"))
    left = F.octet_length(F.btrim(F.col(text_col), F.lit(BLANKS))) > 0
    return done.where(left).select(*aside.columns).withColumnsRenamed(back)
