"""The pipeline against plain code, and the rules that its files keep."""

import zlib

import brute
import numpy as np
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from quire.llm import langid, mixing, queries


def bytes_of(text):
    data = np.frombuffer((text or "").encode(), np.uint8)
    return data, np.array([0, len(data)])


def spoken(rows):
    """Rows in a known language, by counts and mixtures of single texts."""
    counts = {}
    for i, text, lang, _ in rows:
        if text is not None and lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            grams, inside = langid._grams(*bytes_of(text))
            counts[lang] = counts.get(lang, 0) + np.bincount(grams[inside], minlength=1 << langid.GRAM_LOG)
    model = langid.LanguageModel(counts).with_unknown()
    shares = [langid.infer(*bytes_of(t), model)[0] for _, t, _, _ in rows]
    return [r for r, s in zip(rows, shares) if any(c.isalpha() for c in r[1] or "") and s[-1] <= langid.MAX_UNKNOWN]


def test_stages(spark, sf_dir, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    # a document in no language, one that loses all its lines, one with a passage in much text of its own
    said = [r["text"] for r in docs.where("n_chars > 4000").limit(3).collect()]
    noise = " ".join("qxzj kvwq zzxq jjqk".split()[i % 4] + "xq" * (i % 3) for i in range(80))
    own = " ".join(f"{w}{i}" for i, w in enumerate((said[0] + said[1]).split()))
    more = [(900_001, noise, None, "src1"), (900_002, "\n".join(x for x in said[2].split("\n") if len(x) > 30), "en", "src1"), (900_003, own + "\n" + max((t for _, t in items), key=len) + "\n" + own[:500], None, "src2")]
    extra = spark.createDataFrame(more, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.char_length("text").cast("long"))
    docs.unionByName(extra).write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()]
    source = {r[0]: r[3] for r in rows}
    first = spoken(rows)
    assert 900_001 not in {r[0] for r in first} and len(first) > len(rows) - 10
    kept = [(i, t) for i, _, _, t in brute.dedup([(i, t) for i, t, _, _ in first]) if t.strip(" \t\n\x0b\x0c\r")]
    assert 900_002 not in dict(kept)
    root = brute.components(kept)
    kept = [(i, t) for i, t in kept if root[i] == i]
    clean, cuts = {}, 0
    for i, t in kept:
        n, hit, _ = brute.leaks(t, items)
        if 20 * len(hit) < n or not hit:
            clean[i] = brute.cut(t, items)
            cuts += bool(hit)
    assert cuts > 0
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == set(clean)
    assert [r["doc_id"] for r in out if r["text"] != clean[r["doc_id"]]] == []
    assert [r["doc_id"] for r in out if r["n_chars"] != len(r["text"])] == []
    assert all(not brute.leaks(r["text"], items)[1] for r in out) and all(r["lang"] for r in out)
    tokens = {r["doc_id"]: r["tokens"] for r in out}
    totals = {}
    for i, t in tokens.items():
        totals[source[i]] = totals.get(source[i], 0) + t
    plans = {p.source: p for p in mixing.plan_sources(totals, mixing.ENTROPY, mixing.REPEATS, None, mixing.BLOCK_TOKENS)}
    for r in out:
        assert r["copies"] in (plans[r["source"]].epochs, plans[r["source"]].epochs + 1) and 1 <= r["epoch"] <= r["copies"]
    assert len(out) == sum({r["doc_id"]: r["copies"] for r in out}.values())


def test_stages_on_nothing(spark, sf_dir, docs):
    some = docs.select("doc_id", "text", "lang", "source").withColumn("n_chars", F.char_length("text").cast("long"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, some.limit(0), sf_dir).count() == 0, name
        out = stage(spark, some, sf_dir)
        assert out.count() > 0 and set(some.columns) <= set(out.columns), name


def test_registered():
    found = __spark_entry__.queries()
    assert {f"op{n}_" for n in range(1, 11)} == {q.split("_")[0] + "_" for q in found if q.startswith("op")}
    assert "pipeline" in found and set(queries.oracle_sql()) <= set(queries.queries())
