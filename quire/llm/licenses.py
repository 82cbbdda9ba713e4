"""Licence scans: ordered signature rules behind a keyword prefilter.

A text becomes its lower-cased words parted by single spaces.  Rows without any
gate word skip all rules; in the others a rule is tried only if its keyword
occurs.  Matches become word intervals.  They are taken by priority, then length,
then place, and one that overlaps an interval already taken, inside it or not,
is dropped; base phrases are never dropped and drop nothing.

Everything is a column expression on the row itself: nothing is shuffled.

Defined results: null or empty text has no words and no labels; repeated rows
get equal answers; of intervals alike in all, the earlier rule's is taken; an empty table gives an empty result; columns named like an
output are replaced, others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.license_rules import BASE, Rule, rules
from quire.llm.nativetext import ascii_lower

#: One of these occurs wherever any rule can match.
GATES = (
    "licen", "copyright", "spdx", "public domain", "rights reserved", " cc", "commons ", "permi", "redistribut", "reproduced", "confidential", "altered source", "endorse", "advertising", "software",
    "trade secret", "unauthori", "in no event", "supplied as", " mulan ", "fuck", " beer ", "wtfpl", " org ", " under ", "covered by ", "governed by ", "subject to ", "joinup ",
)
_SPAN = "struct<start:int,end:int,priority:int,rule:int,label:string,confidence:double>"


def padded_words(text: Column) -> Column:
    """The words in lower case, one space before, between and after them.

    Letters beyond A-Z may be lower-cased as well, which no phrase can tell, but
    for the two whose lower case begins with an ASCII letter.
    """
    said = F.coalesce(text, F.lit(""))
    folds = said.contains("\u212a") | said.contains("\u0130")
    gaps = F.regexp_replace(F.when(folds, ascii_lower(said)).otherwise(F.lower(said)), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    return F.concat(F.lit(" "), F.btrim(gaps), F.lit(" "))


def _spaces(text: Column) -> Column:
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))).cast("int")


def _spans(words: Column, regex: Column, rule: Column, label: Column, priority: Column, confidence: Column) -> Column:
    """Word intervals of all matches of a rule, in order."""
    whole = F.concat(F.lit("(?<= )(?:"), regex, F.lit(")(?= )"))
    met = F.regexp_extract_all(words, whole, F.lit(0))
    pieces = F.split(words, whole)
    start = F.struct(F.lit(0).alias("i"), F.lit(-1).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))

    def step(s: Column, piece: Column) -> Column:
        at = s["at"] + _spaces(piece)
        said = F.get(met, s["i"])
        size = _spaces(said) + 1
        span = F.struct(
            at.alias("start"), (at + size).alias("end"), priority.alias("priority"), rule.alias("rule"), label.alias("label"), confidence.alias("confidence")
        )
        return F.struct(
            (s["i"] + 1).alias("i"),
            (at + F.coalesce(size - 1, F.lit(0))).alias("at"),
            F.when(said.isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(span))).alias("out"),
        )

    return F.aggregate(pieces, start, step, lambda s: s["out"])


def _rule_array(all_rules: list[Rule]) -> Column:
    """The rules as one literal array of structs."""
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("rule"),
                F.lit(r.label).alias("label"),
                F.lit(r.keyword).alias("keyword"),
                F.lit(r.regex).alias("regex"),
                F.lit(r.priority).alias("priority"),
                F.lit(r.confidence).alias("confidence"),
            )
            for i, r in enumerate(all_rules)
        ]
    )


def resolve(spans: Column) -> Column:
    """The intervals that stay: base phrases, then by priority, length, place and rule what overlaps none taken before."""
    others = F.filter(spans, lambda s: s["priority"] < 100)
    keyed = F.sort_array(
        F.transform(others, lambda s: F.struct((-s["priority"]).alias("p"), (s["start"] - s["end"]).alias("n"), s["start"].alias("a"), s["rule"].alias("r"), s.alias("s")))
    )

    def step(kept: Column, x: Column) -> Column:
        s = x["s"]
        met = F.exists(kept, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"]))
        return F.when(met, kept).otherwise(F.concat(kept, F.array(s)))

    taken = F.aggregate(keyed, F.array().cast(f"array<{_SPAN}>"), step)
    return F.sort_array(F.concat(F.filter(spans, lambda s: s["priority"] == 100), taken))


def scan(docs: DataFrame, text_col: str = "text", all_rules: list[Rule] | None = None) -> DataFrame:
    """``docs`` with n_words, base_places (arrays of starts by phrase), detections."""
    found = rules() if all_rules is None else all_rules
    words = F.col("_words")
    out = docs.withColumn("_words", padded_words(F.col(text_col)))
    # rows without a gate word are not looked at again
    gate = F.lit(False)
    for g in GATES:
        gate = gate | words.contains(g)
    none = F.array().cast(f"array<{_SPAN}>")
    tried = F.filter(_rule_array(found), lambda r: F.contains(words, r["keyword"]))
    spans = F.flatten(F.transform(tried, lambda r: _spans(words, r["regex"], r["rule"], r["label"], r["priority"], r["confidence"])))
    inner = F.octet_length(words) - 2
    return out.withColumns(
        {
            "n_words": F.when(inner <= 0, F.lit(0)).otherwise(_spaces(words) - 1).cast("long"),
            "_spans": F.when(gate, spans).otherwise(none),
        }
    ).withColumn("detections", F.when(F.size("_spans") > 0, resolve(F.col("_spans"))).otherwise(none)).drop("_words", "_spans")


def with_labels(scanned: DataFrame) -> DataFrame:
    """Digest columns of ``scan``: base places and labels, all labels and the score."""
    base = F.filter("detections", lambda d: d["priority"] == 100)

    def joined(spans: Column) -> Column:
        return F.array_join(F.sort_array(F.array_distinct(F.transform(spans, lambda d: d["label"]))), ",")

    return scanned.withColumns(
        {
            "n_base": F.size(base).cast("long"),
            "first_word": F.array_min(F.transform(base, lambda d: d["start"])).cast("long"),
            "last_word": F.array_max(F.transform(base, lambda d: d["start"])).cast("long"),
            "base_labels": joined(base),
            "labels": joined(F.col("detections")),
            "score": F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0)),
        }
    )


def digest(docs: DataFrame) -> DataFrame:
    found = with_labels(scan(docs.select("doc_id", "text")))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def base_labels() -> list[str]:
    return [label for _, label in BASE]
