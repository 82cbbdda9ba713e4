"""String functions as columns; all stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks, and the letters without; one sign each.
MARKED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"
#: Signs that part words in questions.
QUESTION_SIGNS = "?.,!;:-_/\\'\""


def uni_trim(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    """White space runs made one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def fields(text: Column) -> Column:
    """The words between white space."""
    return F.filter(F.split(collapse(text), " "), lambda w: w != "")


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    low = F.lower(text)
    return F.when(F.octet_length(low) == F.char_length(low), low).otherwise(F.translate(low, MARKED.lower(), PLAIN.lower()))


def tokens(text: Column) -> Column:
    """Index tokens: folded runs of letters and numbers."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def sanitize_query(query: Column) -> Column:
    """Letters and decimal digits, everything else one space between."""
    return F.array_join(F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0)), " ")


def normalize_question(text: Column) -> Column:
    """Lower case, signs to spaces, collapsed."""
    return collapse(F.translate(F.lower(F.coalesce(text, F.lit(""))), QUESTION_SIGNS, " " * len(QUESTION_SIGNS)))


def contains_phrase(normalized: Column, phrase: Column) -> Column:
    """Whether whole words of a normalised question hold a normalised phrase."""
    return (phrase != "") & F.contains(F.concat(F.lit(" "), normalized, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))


def contains_any(normalized: Column, phrases: tuple[str, ...]) -> Column:
    """Whether any of fixed phrases occurs; the phrases are already normal.  One pass of one expression."""
    return F.concat(F.lit(" "), normalized, F.lit(" ")).rlike(" (?:" + "|".join(re.escape(p) for p in phrases) + ") ")


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def approx_tokens(text: Column) -> Column:
    """A quarter of the bytes, at least 1; 0 for an empty text."""
    size = F.octet_length(F.coalesce(text, F.lit("")))
    return F.when(size == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(size / 4).cast("int"))).cast("long")


def cut_at_word(text: Column, limit: int) -> Column:
    """At most ``limit`` code points, cut back to the last space after the first sign."""
    head = F.substring(text, 1, limit)
    word = F.regexp_extract(head, r"(?s)^(.+) [^ ]*$", 1)
    return F.when(word == "", head).otherwise(word)


def first_sentence(text: Column, limit: int) -> Column:
    """Up to the first of ``.!?``, or ``limit`` code points cut at a word and "...". """
    flat = collapse(F.coalesce(text, F.lit("")))
    sentence = F.regexp_extract(flat, r"(?s)^([^.!?]*[.!?]?)", 1)
    return F.when(F.char_length(sentence) <= limit, sentence).otherwise(F.concat(F.trim(cut_at_word(sentence, limit)), F.lit("...")))


def _trim_title(text: Column) -> Column:
    bare = F.regexp_replace(uni_trim(text), "^[\"']+|[\"']+$", "")
    return uni_trim(F.regexp_replace(F.regexp_replace(bare, r"[.,;:!?\-]+$", ""), "^[\"']+|[\"']+$", ""))


def derived_title(summary: Column, fallback: Column, max_words: int = 12, max_chars: int = 80) -> Column:
    """The first words of a summary as a title, else ``fallback``."""
    title = _trim_title(F.array_join(F.slice(fields(F.coalesce(summary, F.lit(""))), 1, max_words), " "))
    short = F.when(F.char_length(title) > max_chars, _trim_title(cut_at_word(title, max_chars))).otherwise(title)
    return F.when(short == "", fallback).otherwise(short)


def title_from_filename(name: Column) -> Column:
    """Without extension and number prefix; dashes to spaces; first letters upper case."""
    stem = F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), "^[0-9]+[-_. ]+", "")
    words = fields(F.translate(stem, "-_", "  "))
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " ")


def strip_fences(text: Column) -> Column:
    """A model's answer without code fences around it."""
    bare = uni_trim(F.coalesce(text, F.lit("")))
    opened = F.regexp_replace(bare, r"(?s)^```[a-zA-Z]*\s*", "")
    return F.when(bare.startswith("```"), uni_trim(F.regexp_replace(opened, r"(?s)\s*```\s*$", ""))).otherwise(bare)


def text_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def chapter_id(order: Column) -> Column:
    return F.format_string("ch-%04d", order)


def stable_id(prefix: str, *parts: Column) -> Column:
    """An id that follows from its parts alone."""
    return F.concat(F.lit(prefix + "-"), F.upper(F.substring(F.sha2(F.concat_ws("\u0000", *[p.cast("string") for p in parts]), 256), 1, 26)))


def clean_list(items: Column) -> Column:
    """Trimmed, without blanks, each once, in order."""
    return F.array_distinct(F.filter(F.transform(items, uni_trim), lambda x: x != ""))


def excluding(items: Column, value: Column) -> Column:
    """``clean_list`` without a value, whatever its case."""
    return F.filter(clean_list(items), lambda x: F.lower(x) != F.lower(uni_trim(value)))


def limited(items: Column, most: int = 6) -> Column:
    return F.slice(clean_list(items), 1, most)


def source_key(ids: Column) -> Column:
    """One key for a set of ids, whatever their order."""
    return F.array_join(F.array_sort(clean_list(ids)), "\u0000")


def clamp_unit(value: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))


def truncate(text: Column, limit: int) -> Column:
    """For display: at most ``limit`` code points, the last an ellipsis."""
    return F.when(F.char_length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit - 1), F.lit("…")))


def file_name_of(target: Column) -> Column:
    """A name safe for a staging file."""
    kept = F.regexp_replace(F.coalesce(target, F.lit("")), r"[^A-Za-z0-9._-]+", "-")
    bare = F.regexp_replace(kept, "^[-.]+|[-.]+$", "")
    return F.when(bare == "", F.lit("item")).otherwise(bare)


def normalize_term_type(value: Column) -> Column:
    """Singular or plural name of a term type to the type, else null."""
    v = F.lower(uni_trim(value))
    known = {"themes": "theme", "entities": "entity", "participants": "participant", "povs": "pov", "locations": "location"}
    out = F.when(v.isin("theme", "entity", "participant", "pov", "location", "unresolved"), v)
    for name, one in known.items():
        out = out.when(v == name, one)
    return out


def normalize_entity_type(value: Column) -> Column:
    v = F.regexp_replace(F.lower(uni_trim(F.coalesce(value, F.lit("")))), "[ _]+", "-")
    return F.when(v.isin("character", "location", "object", "organization", "group", "document", "event-concept"), v).otherwise("unknown")


def normalize_support(value: Column, supported: Column) -> Column:
    """Support level of a verdict: explicit, inference or unsupported."""
    v = F.translate(F.lower(uni_trim(F.coalesce(value, F.lit("")))), " _", "--")
    return (
        F.when(v.isin("explicit", "inference", "unsupported"), v)
        .when(v.isin("explicit-fact", "direct", "direct-support"), "explicit")
        .when(v.isin("reasonable-inference", "inferential", "indirect"), "inference")
        .when(~supported, "unsupported")
        .otherwise("inference")
    )


def redact_ids(text: Column) -> Column:
    """Paragraph ids out of a text, with the brackets they stood in."""
    return collapse(F.regexp_replace(text, r"\s*[\[(]?\bp-[0-9A-HJKMNP-TV-Z]{26}\b[\])]?", ""))


def rfc3339(time: Column) -> Column:
    """A timestamp as RFC 3339 text in UTC, whole seconds; the session's zone must be UTC."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_time(text: Column) -> Column:
    """RFC 3339 text as a timestamp; null where it isn't one."""
    shape = r"^\d{4}-\d\d-\d\d[Tt]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"
    return F.when(F.trim(text).rlike(shape), F.try_to_timestamp(F.upper(F.trim(text))))


def elapsed_ms(start: Column, end: Column) -> Column:
    """Milliseconds between two times, 0 if they are the wrong way round."""
    return F.greatest(F.lit(0).cast("long"), F.unix_millis(end) - F.unix_millis(start))
