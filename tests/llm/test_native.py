"""The operators that are DataFrame expressions only."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import brute
import pytest
from pyspark.sql import functions as F

from quire.llm import chat, license_rules, licenses, line_dedup, mixing, urls


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_line_dedup(docs, none):
    got = line_dedup.dedup_lines(docs)
    want = brute.dedup([(r[0], r[1]) for r in brute.ROWS])
    assert sorted((r["doc_id"] or -1, r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()) == sorted((i or -1, n, d, t) for i, n, d, t in want)
    assert line_dedup.dedup_lines(none).count() == 0
    assert line_dedup.reduced(docs).columns == docs.columns
    assert "Python" not in plan(got) and "Arrow" not in plan(got)


def test_line_dedup_thresholds(spark):
    rows = [(i, "a line in many documents\nown line number %d" % i) for i in range(1, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["n_dropped"] for r in line_dedup.dedup_lines(df, min_docs=5).collect()} == {0}
    assert sorted(r["n_dropped"] for r in line_dedup.dedup_lines(df, min_docs=4).collect()) == [0, 1, 1, 1]
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(df, min_docs=1)


def test_line_dedup_long_text(spark):
    long = "\n".join(f"line number {i % 700} of the text" for i in range(20_000))
    df = spark.createDataFrame([(1, long), (2, long + "\nand one more line")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_dropped"], r["text"]) for r in line_dedup.dedup_lines(df).collect()}
    assert got == {1: (0, long), 2: (20_000, "and one more line")}


PAGES = [
    (1, "http://A.example.NET/en/x?q=1#f"), (2, "https://sub.example.net/de/"), (3, "http://example.com/de/y"), (4, "http://example.com/DE/y"), (5, "http://x.org/fr/"),
    (6, None), (7, "no scheme example.net/"), (8, "ftp://notexample.com/de/"), (9, "http://example.net"), (10, "x://y://net/z"), (11, ""), (12, "http://net?x"), (13, "http://h\nost.net/p\nq"),
]


def judged(url):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut].translate(brute.ASCII), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    best = None
    for h, p, _ in urls.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best)):
            best = h + p
    return host, path, best


def test_urls(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string").withColumn("host", F.lit("clash"))
    mined = urls.mine_rules(spark.createDataFrame([], "url string, label string"), "url", "label")
    got = {r["page_id"]: r for r in urls.judge(pages, mined).collect()}
    for page, url in PAGES:
        assert (got[page]["host"], got[page]["path"], got[page]["rule"]) == judged(url), url
    assert got[4]["verdict"] == "allow" and got[2]["verdict"] == "block" and got[1]["verdict"] == "allow"


def test_urls_learn(spark):
    rng = random.Random(1)
    rows = [(f"http://s{i % 3}.bad-host.info/x/{i}", "block") for i in range(60)] + [(f"http://s{rng.randint(0, 9)}.good{i % 5}.info/x/{i}", "allow") for i in range(200)]
    mined = urls.mine_rules(spark.createDataFrame(rows, "url string, label string"), "url", "label")
    pages = spark.createDataFrame([(1, "http://new.bad-host.info/x/9999"), (2, "http://new.good1.info/x/1"), (3, "http://else.info/")], "page_id long, url string")
    got = {r["page_id"]: (r["verdict"], r["mined_rule"]) for r in urls.judge(pages, mined).collect()}
    assert got[1][0] == "block" and "bad-host" in got[1][1]
    assert got[2][0] == "allow" and got[3][0] == "allow"


def mined_by_brute_force(rows, need, confidence=urls.MIN_CONFIDENCE, lift=urls.MIN_LIFT):
    """{(tokens, verdict): confidence} of all rules that no part of theirs makes redundant."""
    total, labels, met = len(rows), Counter(label for _, label in rows), defaultdict(Counter)
    for tokens, label in rows:
        for k in range(1, len(tokens) + 1):
            for some in itertools.combinations(sorted(tokens), k):
                met[some][label] += 1
    rules = {}
    for some, by in met.items():
        for label, n in by.items():
            if n >= need and (c := n / by.total()) >= confidence and c / (labels[label] / total) >= lift:
                rules[some, label] = c
    parts = lambda some: (p for k in range(1, len(some)) for p in itertools.combinations(some, k))
    return {(some, label): c for (some, label), c in rules.items() if not any(rules.get((p, label), 0) >= c for p in parts(some))}


@pytest.mark.parametrize("max_rules", [urls.MAX_RULES, 1])
def test_urls_all_rules(spark, max_rules):
    rng = random.Random(3)
    rows = []
    for i in range(500):
        path = [s for s, p in (("de", 0.4), ("ads", 0.2), ("news", 0.5), ("x", 0.3)) if rng.random() < p]
        bad = ("ads" in path and rng.random() < 0.85) or ("de" in path and "x" in path and rng.random() < 0.95)
        rows.append((i, f"http://a{i % 3}.info/{'/'.join(path)}", "block" if bad else "allow"))
    df = spark.createDataFrame(rows, "page_id long, url string, label string")
    tokens = {r["page_id"]: r["t"] for r in df.select("page_id", urls.url_tokens(F.col("url")).alias("t")).collect()}
    want = mined_by_brute_force([(tokens[i], label) for i, _, label in rows], 20)
    mined = urls.mine_rules(df, "url", "label")
    rules = mined.collect()
    assert {(tuple(r["tokens"]), r["verdict"]): r["confidence"] for r in rules} == want and len(want) > 3
    rules.sort(key=lambda r: (-r["confidence"], len(r["tokens"]), r["tokens"]))
    for r in urls.judge(df.drop("label"), mined, max_rules=max_rules).collect():
        first = next((x for x in rules if set(x["tokens"]) <= set(tokens[r["page_id"]])), None)
        assert (r["verdict"], r["mined_rule"]) == ((first["verdict"], " & ".join(first["tokens"])) if first else ("allow", None))


def test_urls_labels(spark):
    """Only label rows teach, and only of pages outside the fixed rules; with nulls they don't."""
    urls_ = ["http://a.net/x", "http://b.info/x", "http://c.info/y", "http://d.info/z", None, "http://e.info/q"]
    pages = spark.createDataFrame(list(enumerate(urls_)), "page_id long, url string").withColumn("label", F.lit("clash"))
    labels = spark.createDataFrame([(0, 0, 0), (1, 0, 0), (2, 1, 1), (3, 1, 0), (3, 1, 0), (4, 1, 0), (5, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    got = sorted((r["url"] or "", r["label"]) for r in urls.labelled_pages(pages, labels).collect())
    assert got == [("", "allow"), ("http://b.info/x", "block"), ("http://c.info/y", "block"), ("http://d.info/z", "allow")]


def test_urls_held_out(spark):
    """Rules mined from half of the labelled URLs, held against the other half."""
    rng = random.Random(5)
    rows = []
    for i in range(4000):
        bad = rng.random() < 0.25
        host = rng.choice(["casino-x", "pills-y"]) if bad and rng.random() < 0.8 else f"site{rng.randint(0, 60)}"
        tail = "?sid=%d" % i if bad and rng.random() < 0.5 else rng.choice(["", "#top", "?page=2"])
        rows.append((i, f"http://{host}.info/{rng.choice(['a', 'b', 'c'])}/{i}{tail}", "block" if bad else "allow"))
    df = spark.createDataFrame(rows, "page_id long, url string, label string")
    mined = urls.mine_rules(df.where("page_id % 2 = 0"), "url", "label")
    got = urls.judge(df.where("page_id % 2 = 1"), mined).collect()
    blocked = [r for r in got if r["verdict"] == "block"]
    assert sum(r["label"] == "block" for r in blocked) / len(blocked) > 0.95
    assert sum(r["label"] == "block" for r in blocked) / sum(r["label"] == "block" for r in got) > 0.8


def test_urls_odd_pages(spark):
    rows = [("http://s.bad.info/x", "block")] * 30 + [(f"http://s{i}.good.info/x", "allow") for i in range(60)]
    mined = urls.mine_rules(spark.createDataFrame(rows, "url string, label string"), "url", "label")
    long = "http://s.bad.info/" + "/".join(f"seg{i}x" for i in range(20_000))
    pages = spark.createDataFrame([(1, long), (1, long), (2, None), (None, "http://s.bad.info/")], "page_id long, url string").withColumns({"ix": F.lit(1), "verdicts": F.lit(2)})
    got = urls.judge(pages, mined)
    assert sorted((r["page_id"] or -1, r["verdict"]) for r in got.collect()) == [(-1, "block"), (1, "block"), (1, "block"), (2, "allow")]
    assert urls.judge(pages.limit(0), mined).count() == 0 and "Python" not in plan(got)


def test_urls_sure_rules_leave_room(spark):
    """Twelve tokens that only blocked URLs hold make 4,095 sure rules; a rule of 0.9 stays all the same."""
    rows = [("http://h.info/" + "/".join("abcdefghi"), "block")] * 30 + [("ftp://de.net/de", "block")] * 36 + [("ftp://de.net/de", "allow")] * 4
    rows += [(f"http://g{i % 50}.info/n", "allow") for i in range(200)]
    got = urls.mine_rules(spark.createDataFrame(rows, "url string, label string"), "url", "label").collect()
    assert {round(r["confidence"], 3) for r in got if r["tokens"] == ["path=de"]} == {0.9}


def test_urls_learn_from_all_tokens(spark):
    host = ".".join(f"l{j}" for j in range(18))
    rows = [(f"http://{host}.h{i % 3}.info/x{'?sid=1' if i % 2 else ''}", "block" if i % 2 else "allow") for i in range(120)] + [("ftp://b.org/y", "allow")] * 60
    got = urls.mine_rules(spark.createDataFrame(rows, "url string, label string"), "url", "label").collect()
    assert (["query=sid"], "block", 1.0) in [(r["tokens"], r["verdict"], r["confidence"]) for r in got]


TEXTS = ["", "plain", r"\### Assistant: </turn> ok", "<turn>user:x</turn>", "\\", "\\\\<", "a\nb", "<image:1>", "end \\", "\\</turn>", "::", "ü<", None, "\\b\\l\\c", "</turn", "数字 😀 <", "long < \\ text é " * 60_000]


def test_chat_round_trip(spark):
    rows = [(c, t, role, TEXTS[(c + t) % len(TEXTS)]) for c in range(len(TEXTS)) for t, role in enumerate(("system", "user", "assistant", "assistant"))]
    rows += [(100, 0, None, "x"), (100, 0, "a:b<\\", "y"), (None, 1, "user", "z"), (100, 0, None, "x"), (101, 0, "assistant", "x"), (101, 0, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"segment": F.lit(1), "formatted": F.lit("clash")})
    done = chat.format_conversations(df.withColumn("parts", chat.text_part(F.col("text"))))
    read = done.select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("t"), "loss", chat.masked(F.col("formatted"), F.col("loss")).alias("m"))
    for r in read.collect():
        own = sorted((x[1], x[2] or "", x[3] or "") for x in rows if x[0] == r["conv_id"])
        assert [(x["role"], x["text"]) for x in r["t"]] == [(b, c) for _, b, c in own]
        under = [r["formatted"][s["start"] : s["end"]] for s in r["loss"]]
        assert under == r["m"] == [r["formatted"].encode()[s["from_byte"] : s["to_byte"]].decode() for s in r["loss"]]
        back = [x.replace("\\c", ":").replace("\\l", "<").replace("\\b", "\\") for x in under]
        assert back == [c for _, b, c in own if b == "assistant"]
    assert "Python" not in plan(done)
    assert chat.format_conversations(df.limit(0).withColumn("parts", chat.text_part(F.col("text")))).count() == 0


def test_chat_parts(spark):
    parts = [("text", "see <", None, None), ("image", None, "i.png", 2048), ("text", " and ", None, None), ("audio", None, "a.wav", 80), ("pdf", None, None, 40), (None, "t", None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<{chat.PART.simpleString()}>")
    r = chat.format_conversations(df).first()
    assert r["formatted"] == "<turn>user:see \\l<image:1> and <audio:2><document:3>t</turn><turn>assistant:</turn>"
    assert [tuple(a) for a in r["attachments"]] == [(1, 1, "image", "i.png", 87), (1, 2, "audio", "a.wav", 4), (1, 3, "document", "", 18)]
    assert r["tokens"] == 1 + 87 + 1 + 4 + 18 and [tuple(x) for x in r["loss"]] == [(len(r["formatted"]) - 7, len(r["formatted"]) - 7) * 2]


def test_licenses_base(spark):
    phrases = license_rules.BASE
    texts = ["Under the MIT license. under-the mit-license", "apache LICENSE, version 2.0 (cc by-nc) cc by nc cc by nc", "underthe mit license", None, "", "x" * 10, "cc by ncé", "ünder the mit license under the mit license", "under the m\u0130t license", "under the mit licen\u212ae Apache \u212a license", "apache license version 2 \u212a \u0130", "ÉÀ Under THE MIT License É"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("labels", F.lit(7))
    got = licenses.with_labels(licenses.scan(df)).collect()
    for r in got:
        n, at, labels = brute.places(texts[r["doc_id"]], phrases)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (n, len(at), min(at, default=None), max(at, default=None))
        assert r["base_labels"] == ",".join(sorted(labels)) and labels <= set(r["labels"].split(","))
    assert licenses.with_labels(licenses.scan(df.limit(0))).count() == 0


@pytest.mark.parametrize(
    "text,labels",
    [
        ("Licensed under the Apache License, Version 2.0 (the License)", "apache-2"), ("SPDX-License-Identifier: GPL-3.0-or-later", "gpl-3"), ("SPDX-License-Identifier: MIT", "mit"),
        ("released under the GNU General Public License v2", "gpl-2"), ("distributed under the BSD 3-Clause License", "bsd-3"), ("CC BY-NC-SA 4.0", ""), ("shared under CC BY-NC-SA 4.0", "cc-by-nc-sa"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit"), ("All rights reserved.", "proprietary"), ("He met the apache in the mit building", ""),
    ],
)
def test_license_rules(spark, text, labels):
    got = licenses.with_labels(licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert set(filter(None, got["labels"].split(","))) - {"cc-by-nc"} == set(filter(None, [labels]))


def examples(pattern, rng):
    """A random text that a rule's expression matches, by a walk of the parsed expression."""
    def walk(parsed):
        out = ""
        for op, arg in parsed:
            if op is re._constants.LITERAL:
                out += chr(arg)
            elif op is re._constants.NOT_LITERAL:
                out += "z"
            elif op is re._constants.IN:
                kind, value = rng.choice([x for x in arg if x[0] is not re._constants.NEGATE])
                out += "z" if arg[0][0] is re._constants.NEGATE else chr(value if kind is re._constants.LITERAL else rng.choice(value))
            elif op is re._constants.MAX_REPEAT:
                out += "".join(walk(arg[2]) for _ in range(rng.randint(arg[0], min(int(arg[1]), arg[0] + 2))))
            elif op is re._constants.SUBPATTERN:
                out += walk(arg[3])
            elif op is re._constants.BRANCH:
                out += walk(rng.choice(arg[1]))
            else:
                raise AssertionError(op)
        return out

    return walk(re._parser.parse(pattern))


def test_license_keywords_are_in_all_that_rules_match():
    rng = random.Random(9)
    for rule in license_rules.rules():
        regex, _, tag = rule.regex.partition("(?<=")
        for _ in range(300):
            words = " spdx license identifier " * bool(tag) + f" {examples(regex, rng)} "
            assert re.fullmatch(regex, words.removeprefix(" spdx license identifier ").strip())
            assert rule.keyword in words and any(g in words for g in licenses.GATES), (rule.label, rule.keyword, words)


def test_license_wordings(spark):
    want = {
        "released under the FreeBSD license": "bsd-2", "SPDX-License-Identifier: 0BSD": "0bsd", "licensed under the 0BSD license": "0bsd", "provided under the GPL3": "gpl-3", "released under LGPL2": "lgpl-2",
        "released under the GNU Library General Public License version 2": "lgpl-2", "distributed under the GPL2 license": "gpl-2", "covered by the AGPL3": "agpl-3", "released under LGPL3": "lgpl-3",
        "licensed under the terms below": "license", "licenced under the terms below": "license", "Licensed under the GPLv2": "gpl-2", "available under LGPLv3": "lgpl-3", "released under the MPLv2": "mpl-2",
        "0BSD license": "0bsd", "FreeBSD license": "bsd-2", "Licensed under the terms of X": "license", "License: GPL-3": "gpl-3", "SPDX-License-Identifier: (MIT OR Apache-2.0)": "apache-2,mit",
        "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 OR BSD-3-Clause": "bsd-3,gpl-2", "see the python license plate": "", "used by MIT students": "", "a ruby license plate": "",
        "https://opensource.org/licenses/MIT": "mit", "see http://www.apache.org/licenses/LICENSE-2.0 for more": "apache-2", "https://creativecommons.org/licenses/by-nc-sa/4.0/": "cc-by-nc-sa",
        "This is free and unencumbered software released into the public domain.": "unlicense", "it is in the public domain": "public-domain", "Eclipse Public License v2.0": "epl-2",
        "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License": "gpl-2", "Creative Commons Attribution-ShareAlike 4.0 International": "cc-by-sa",
    }
    rows = list(enumerate(want)) + [(0, next(iter(want)))]
    got = {r["doc_id"]: r["labels"] for r in licenses.with_labels(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert {text: got[i] for i, text in enumerate(want)} == want


def test_license_spans_of_a_long_text(spark):
    text = "word " * 200_000 + "licensed under the gpl v3 " + "Under the MIT License. " * 300 + "x " * 200_000
    r = licenses.with_labels(licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    n, at, _ = brute.places(text, license_rules.BASE)
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["labels"]) == (n, len(at), at[0], at[-1], "gpl-3,mit")


def test_resolve_by_plain_code(spark):
    rng = random.Random(14)
    rows = []
    for i in range(60):
        spans = []
        for rule in range(rng.randint(0, 14)):
            start = rng.randint(0, 30)
            spans.append((start, start + rng.randint(1, 9), rng.choice([40, 70, 80, 85, 100]), rule, f"l{rule}", 0.5))
        rows.append((i, spans))
    kind = "array<struct<start:int,end:int,priority:int,rule:int,label:string,confidence:double>>"
    got = spark.createDataFrame(rows, f"i int, spans {kind}").select("i", licenses.resolve(F.col("spans")).alias("kept")).collect()
    for r in got:
        kept = []
        for s in sorted((s for s in rows[r["i"]][1] if s[2] < 100), key=lambda s: (-s[2], s[0] - s[1], s[0], s[3])):
            if not any(k[0] < s[1] and s[0] < k[1] for k in kept):
                kept.append(s)
        assert [tuple(s) for s in r["kept"]] == sorted(kept + [s for s in rows[r["i"]][1] if s[2] == 100])


def test_hundreds_of_rules():
    assert len(license_rules.rules()) > 300


def test_mixing_weights():
    shares = [0.7, 0.2, 0.1]
    a = mixing.find_exponent(shares, 0.9, 3.0, False)
    w = mixing.tempered(shares, a)
    assert abs(sum(w) - 1) < 1e-12 and w[0] < 0.7 and max(x / p for x, p in zip(w, shares)) <= 3.0
    assert mixing.find_exponent(shares, 1.0, 1e9, False) == pytest.approx(0, abs=1e-9)
    assert mixing.find_exponent(shares, 1.0, 1.0, False) == pytest.approx(1, abs=1e-9)
    assert mixing.plan_sources({}, 1, 1, None, 10) == [] and mixing.plan_sources({"a": 0}, 1, 1, None, 10)[0].epochs == 1


def brute_mix(rows, plans, seed=mixing.SEED):
    out = {}
    for p in plans:
        own = [(i, t) for i, s, t in rows if s == p.source]
        key = {i: hashlib.md5(f"{seed}|{i}".encode()).hexdigest() for i, _ in own}
        upto = 0
        turn = {b: hashlib.md5(f"{seed}|{p.source}|{p.epochs + 1}|{b}".encode()).hexdigest() for b in range(p.blocks)}
        for i, t in sorted(own, key=lambda x: (turn[int(key[x[0]][:8], 16) % p.blocks], key[x[0]])):
            upto += t
            out[i] = p.epochs + (upto <= p.part)
    return out


@pytest.mark.parametrize("budget", ["total", None, 500, 0])
def test_mixing(spark, budget):
    rng = random.Random(3)
    rows = [(i, rng.choice("aaaaaabbc"), rng.randint(1, 60)) for i in range(300)]
    df = spark.createDataFrame([(i, "x" * (4 * t), s) for i, s, t in rows], "doc_id long, text string, source string")
    got = mixing.mix(df, budget=budget, block_tokens=200)
    totals = {}
    for _, s, t in rows:
        totals[s] = totals.get(s, 0) + t
    plans = mixing.plan_sources(totals, mixing.ENTROPY, mixing.REPEATS, sum(totals.values()) if budget == "total" else budget, 200)
    assert {r["doc_id"]: r["copies"] for r in got.collect()} == brute_mix(rows, plans)
    assert "Python" not in plan(got)
    if budget is None:
        assert mixing.expand(df, block_tokens=200).select("doc_id").distinct().count() == 300


def test_mixing_tiny_and_empty_sources(spark):
    plans = {p.source: p for p in mixing.plan_sources({"big": 7_000_000_000, "one": 1, "three": 3, "none": 0}, 0.97, 2.0, None, 1000)}
    assert plans["one"].epochs >= 1 and plans["three"].epochs >= 1 and (plans["none"].epochs, plans["none"].part) == (1, -1)
    df = spark.createDataFrame([(1, "x" * 400, "a"), (2, None, "b"), (3, "", "b"), (4, "y" * 40, "c")], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["copies"] for r in mixing.mix(df, budget="total").collect()}
    assert got[2] == got[3] == 1


def test_blocks_are_permuted(spark):
    """Other seeds and epochs take other blocks into the part."""
    df = spark.createDataFrame([(i, "x" * 40, "a" if i % 4 else "b") for i in range(800)], "doc_id long, text string, source string")
    taken = [{r["block"] for r in mixing.mix(df, budget=3000, block_tokens=100, seed=s).where("copies > 0 and source = 'a'").collect()} for s in ("s1", "s2")]
    assert taken[0] != taken[1] and all(0 < len(t) < 60 for t in taken)


def test_mixing_odd_rows(docs, none):
    got = mixing.mix(docs)
    assert got.count() == len(brute.ROWS) and got.where("copies < 1").count() == 0
    assert mixing.mix(none).count() == 0 and mixing.expand(none).count() == 0
