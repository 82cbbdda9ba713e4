import pytest
from pyspark.sql import functions as F

from quire.functions import jsonvals, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "source,limit,want",
    [("One two. Three", 240, "One two."), ("no end", 240, "no end"), ("", 240, ""), ("aaa bbb ccc", 6, "aaa..."), ("abcdefghij", 4, "abcd..."), ("  a \n b! c", 99, "a b!")],
)
def test_first_sentence(spark, source, limit, want):
    assert one(spark, text.first_sentence(F.lit(source), limit)) == want


@pytest.mark.parametrize("source,want", [("", 0), ("a", 1), ("abcdefgh", 2), ("éé", 1)])
def test_approx_tokens(spark, source, want):
    assert one(spark, text.approx_tokens(F.lit(source))) == want


@pytest.mark.parametrize("name,want", [("010-the_last-Door.md", "The Last Door"), ("1. intro.md", "Intro"), ("plain.md", "Plain")])
def test_title_from_filename(spark, name, want):
    assert one(spark, text.title_from_filename(F.lit(name))) == want


def test_trim_takes_all_white_space(spark):
    assert one(spark, text.uni_trim(F.lit("  a b  "))) == "a b"


def test_title_is_cut_and_bared(spark):
    assert one(spark, text.derived_title(F.lit('"Hello there,"'), F.lit("x"))) == "Hello there"
    assert one(spark, text.derived_title(F.lit(" "), F.lit("Scene 1"))) == "Scene 1"
    long = " ".join(["wordword"] * 20)
    assert len(one(spark, text.derived_title(F.lit(long), F.lit("x")))) <= 80


def test_lists(spark):
    items = F.array(*map(F.lit, [" b ", "a", "b", "", "A"]))
    assert one(spark, text.clean_list(items)) == ["b", "a", "A"]
    assert one(spark, text.excluding(items, F.lit("a "))) == ["b"]
    assert one(spark, text.source_key(items)) == one(spark, text.source_key(F.reverse(items)))


@pytest.mark.parametrize("raw,want", [("```json\n{}\n```", "{}"), (" {} ", "{}"), ("```\nx```", "x")])
def test_fences(spark, raw, want):
    assert one(spark, text.strip_fences(F.lit(raw))) == want


def test_tolerant_json():
    assert jsonvals.value_text({"b": 1, "a": [True, " x "]}) == "a: true; x; b: 1"
    assert jsonvals.value_text({"id": "p-1", "title": "T"}) == "T"
    assert jsonvals.evidence_ids({"ids": ["p-2", {"paragraph": "p-1"}], "p-3": 1}) == ["p-2", "p-1", "p-3"]
    assert jsonvals.complete_objects('{"entities": [{"a": "]}"}, {"b": [1', "entities") == ['{"a": "]}"}']
    assert jsonvals.complete_objects("{}", "entities") == []


@pytest.mark.parametrize(
    "url,want",
    [("http://localhost:1", "loopback"), ("http://10.0.0.1", "private"), ("http://169.254.1.1", "link-local"), ("http://100.64.0.1", "shared"), ("https://example.com", "remote"), ("x", "invalid")],
)
def test_endpoint_scope(url, want):
    assert jsonvals.endpoint_scope(url) == want
