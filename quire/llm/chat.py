"""Chat formatting: typed content parts to one marked string, and back.

A turn's content is a list of typed parts.  A visitor, one branch for each
type, flattens them in order: text is escaped, and an image, audio clip or
document becomes a placeholder with its number, its reference recorded with
the tokens it expands to.  Turns are wrapped in markers, all of which begin with
``<``.  In texts a backslash becomes ``\\b`` and ``<`` becomes ``\\l`` (in roles
``:`` becomes ``\\c`` too), so no marker occurs in escaped text and unescaping is
exact.  The loss mask is a list of spans of the formatted text, the contents of
the assistant's turns, counted in code points and in bytes while it is made.

Each turn is flattened where it lies; turns then meet by conversation once, to
be placed (sums in order, spilled where a conversation is large) and joined to
one row, which is the result's own size.

Defined results: null text is empty; a null role is empty; rows of a
conversation are ordered by turn, then role, then text (nulls first), so ties
and repeated rows keep a fixed order; a null conversation id is one
conversation of its own; a part of unknown type is a document; a part without a
reference has an empty one; texts of any length are formatted whole; an empty
table gives an empty result; columns other than those named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Markers; all but the end of the role begin with the sign that texts never hold.
TURN, END, ROLE_END = "<turn>", "</turn>", ":"
#: Signs and what stands for them in texts, in the order of escaping; the last one is for roles only.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (ROLE_END, "\\c"))
LOSS_ROLE = "assistant"
#: Tokens a placeholder expands to: a base, and one for each so many units (pixels, milliseconds, bytes).
EXPANSION = {"image": (85, 1024), "audio": (2, 40), "document": (8, 4)}

PART = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("ref", T.StringType()),
        T.StructField("units", T.LongType()),
    ]
)


def escape(text: Column, signs: int = 2) -> Column:
    """Reversible: neither a marker nor a bare backslash is left."""
    for sign, said in ESCAPES[:signs]:
        text = F.replace(text, F.lit(sign), F.lit(said))
    return text


def unescape(text: Column) -> Column:
    """What ``escape`` was given; backslashes come last, when no other escape is left."""
    for sign, said in reversed(ESCAPES):
        text = F.replace(text, F.lit(said), F.lit(sign))
    return text


def _kind(part: Column) -> Column:
    return F.when(part["type"].isin("text", "image", "audio"), part["type"]).when(part["type"].isNull(), F.lit("text")).otherwise(F.lit("document"))


def _tokens(part: Column) -> Column:
    kind = _kind(part)
    size = F.coalesce(part["units"], F.lit(0).cast("long"))
    found = F.greatest(F.lit(0), F.floor(F.octet_length(F.coalesce(part["text"], F.lit(""))) / 4)).cast("long")
    for name, (base, step) in EXPANSION.items():
        found = F.when(kind == name, (F.lit(base) + F.ceil(size / step)).cast("long")).otherwise(found)
    return found


def visit_parts(parts: Column) -> Column:
    """Struct of a turn's flattened text, its attachments in order and its expanded tokens."""

    def visit(done: Column, part: Column) -> Column:
        kind = _kind(part)
        number = F.size(done["attachments"]) + 1
        mark = F.concat(F.lit("<"), kind, F.lit(":"), number.cast("string"), F.lit(">"))
        ref = F.struct(number.cast("long").alias("number"), kind.alias("type"), F.coalesce(part["ref"], F.lit("")).alias("ref"), _tokens(part).alias("tokens"))
        is_text = kind == "text"
        return F.struct(
            F.concat(done["content"], F.when(is_text, escape(F.coalesce(part["text"], F.lit("")))).otherwise(mark)).alias("content"),
            F.when(is_text, done["attachments"]).otherwise(F.concat(done["attachments"], F.array(ref))).alias("attachments"),
            (done["tokens"] + _tokens(part)).alias("tokens"),
        )

    start = F.struct(
        F.lit("").alias("content"),
        F.array().cast("array<struct<number:bigint,type:string,ref:string,tokens:bigint>>").alias("attachments"),
        F.lit(0).cast("long").alias("tokens"),
    )
    return F.aggregate(F.coalesce(parts, F.array().cast(T.ArrayType(PART))), start, visit)


def text_part(text: Column) -> Column:
    """A content list of one text part."""
    nothing = F.lit(None)
    part = F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), nothing.cast("string").alias("ref"), nothing.cast("long").alias("units"))
    return F.array(part)


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts") -> DataFrame:
    """(conv_col, formatted, attachments, tokens, loss): one row for each conversation.

    ``attachments`` holds (turn from 1, number within the turn, type, ref,
    tokens); ``loss`` the spans under the loss mask, in order, as (start, end) in
    code points and (from_byte, to_byte) in UTF-8, from 0, ends excluded.
    """
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    seen = rows.select(F.col(conv_col).alias("_c"), F.col(turn_col).alias("_t"), role.alias("_r"), visit_parts(F.col(parts_col)).alias("_v"))
    head = F.concat(F.lit(TURN), escape(F.col("_r"), 3), F.lit(ROLE_END))
    turns = seen.select(
        "_c", "_t", "_r", F.concat(head, F.col("_v.content"), F.lit(END)).alias("segment"), F.char_length(head).alias("h"), F.octet_length(head).alias("hb"),
        F.col("_v.attachments").alias("attachments"), F.col("_v.tokens").alias("tokens"),
    )
    before = Window.partitionBy("_c").orderBy("_t", "_r", "segment").rowsBetween(Window.unboundedPreceding, -1)
    placed = turns.withColumns(
        {
            "at": F.coalesce(F.sum(F.char_length("segment").cast("long")).over(before), F.lit(0)),
            "byte": F.coalesce(F.sum(F.octet_length("segment").cast("long")).over(before), F.lit(0)),
        }
    )
    end_chars, end_bytes = len(END), len(END.encode())
    span = F.struct(
        (F.col("at") + F.col("h")).alias("start"), (F.col("at") + F.char_length("segment") - end_chars).alias("end"),
        (F.col("byte") + F.col("hb")).alias("from_byte"), (F.col("byte") + F.octet_length("segment") - end_bytes).alias("to_byte"),
    )
    entry = F.struct("_t", "_r", "segment", "at", F.when(F.col("_r") == LOSS_ROLE, span).alias("span"), "attachments", "tokens")
    met = placed.groupBy("_c").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    files = F.flatten(
        F.transform(
            "e",
            lambda x, i: F.transform(
                x["attachments"],
                lambda a: F.struct((i + 1).cast("long").alias("turn"), a["number"].alias("number"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens")),
            ),
        )
    )
    return met.select(
        F.col("_c").alias(conv_col),
        F.array_join(F.transform("e", lambda x: x["segment"]), "").alias("formatted"),
        files.alias("attachments"),
        F.aggregate("e", F.lit(0).cast("long"), lambda s, x: s + x["tokens"]).alias("tokens"),
        F.filter(F.transform("e", lambda x: x["span"]), lambda x: x.isNotNull()).alias("loss"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: an array of (role, text); markers occur nowhere else."""
    turns = F.filter(F.split(formatted, END), lambda x: x != "")

    def turn(x: Column) -> Column:
        role = F.substring_index(x, ROLE_END, 1)
        return F.struct(
            unescape(F.replace(role, F.lit(TURN), F.lit(""))).alias("role"),
            unescape(F.substring(x, F.char_length(role) + len(ROLE_END) + 1, F.char_length(x))).alias("text"),
        )

    return F.transform(turns, turn)


def masked(formatted: Column, loss: Column) -> Column:
    """What the spans of the loss mask cut from the formatted text, in order, still escaped."""

    def cut(raw: Column) -> Column:
        return F.transform(loss, lambda s: F.decode(F.substring(raw, (s["from_byte"] + 1).cast("int"), (s["to_byte"] - s["from_byte"]).cast("int")), "UTF-8"))

    # bytes are made once, as the variable of an outer transform, and cut at their places
    return F.get(F.transform(F.array(F.encode(formatted, "UTF-8")), cut), F.lit(0))


PROBE = r"\### Assistant: </turn> ok"


def digest(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    rows = conversations.select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], rows.schema)
    done = format_conversations(rows.unionByName(probe).withColumn("parts", text_part(F.col("text"))))
    said = F.array_join(F.transform(parse(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = done.select(
        "conv_id", "formatted", F.size(F.split("formatted", END)).alias("n"), said.alias("said"),
        F.array_join(F.transform(masked(F.col("formatted"), F.col("loss")), unescape), "").alias("under"), "attachments", "tokens",
    )
    return read.select(
        "conv_id",
        (F.col("n") - 1).cast("long").alias("n_turns"),
        F.sha2("said", 256).alias("turns_sha256"),
        F.char_length("under").cast("long").alias("loss_chars"),
        F.sha2("under", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"),
        "tokens",
    )
