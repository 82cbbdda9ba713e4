"""URL filters: fixed host and path rules, then association rules mined by pattern growth.

A URL is the set of its tokens: each label of its host with the labels after
it, each path segment, the number of segments, the kinds of its query and
fragment.  Labelled URLs are the transactions.  As in FP-growth, item sets grow
from their conditional bases, here rows of a table; rules whose consequent is a
label stay if support, confidence and lift are high enough and no shorter rule
of at least the same confidence says the same.  Redundant rules are pruned as
sets grow, before they are made, and all others stay.  Up to ``MAX_RULES`` are
broadcast as an inverted index from token to rules; more are joined to the
pages by each rule's rarest token.  A rule fires where all tokens of its
antecedent were met; the most confident one that fires gives the verdict, and
without one a URL is allowed.

Defined results: null or empty URLs, and those without ``://``, have an empty
host and path, fit no fixed rule and are judged by their tokens; repeated page
ids are judged row by row; label rows with nulls are not learned from; with no
labelled URL nothing is mined and all that no fixed rule fits is allowed.
"""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.nativetext import ascii_lower
from quire.llm.scratch import Scratch

#: (host, path, verdict); a rule fits its host and all subdomains.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
MIN_SUPPORT = 0.002
MIN_COUNT = 20  # labelled URLs that any rule must hold in
MIN_CONFIDENCE = 0.8
MIN_LIFT = 1.5
MAX_RULES = 2000  # more than these are met by a join, not by a broadcast index
_RULE = "rule_id long, tokens array<string>, verdict string, confidence double, support double"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, start, says in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule = F.when(fits, F.lit(name + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL: host endings, path segments without digits, shape."""
    host, path = host_of(url), path_of(url)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    endings = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))), lambda i: F.concat(F.lit("host="), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    parts = F.transform(segments, lambda x: F.concat(F.lit("path="), F.regexp_replace(ascii_lower(x), "[0-9]+", "N")))
    shape = F.array(
        F.concat(F.lit("scheme="), ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A(.*?)://", 1))),
        F.concat(F.lit("depth="), F.size(segments).cast("string")),
        F.concat(F.lit("query="), F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^=&#]*)", 1)),
        F.concat(F.lit("fragment="), F.coalesce(url, F.lit("")).contains("#").cast("string")),
    )
    return F.array_distinct(F.concat(endings, parts, shape))


def mine_rules(
    labelled: DataFrame,
    url_col: str,
    label_col: str,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
    min_lift: float = MIN_LIFT,
) -> DataFrame:
    """(rule_id, tokens, verdict, confidence, support): all rules that no shorter one makes redundant."""
    scratch = Scratch(labelled.sparkSession, "url-rules")
    items = F.array_sort(url_tokens(F.col(url_col))).alias("items")
    known = labelled.where(F.col(url_col).isNotNull() & F.col(label_col).isNotNull()).select(items, F.col(label_col).alias("label"))
    baskets = scratch.save(known.groupBy("items", "label").agg(F.count("*").alias("n")), "baskets")
    total = baskets.agg(F.sum("n")).first()[0] or 0
    need = math.ceil(max(min_support, min(1.0, MIN_COUNT / max(1, total))) * total)
    sums = baskets.groupBy("label").agg(F.sum("n").alias("n")).where(F.col("n") >= need).collect()
    # a label so common that even a sure rule lacks the lift has no rules
    verdicts = [(r["label"], r["n"] / total) for r in sorted(sums) if 1 / (r["n"] / total) >= min_lift]
    found = _mine(scratch, baskets, verdicts, total, need, min_confidence, min_lift) if verdicts else []
    if not found:
        return labelled.sparkSession.createDataFrame([], _RULE)
    rules = scratch.save(reduce(DataFrame.unionAll, found), "rules")
    scratch.keep_only("rules")
    ordered = rules.orderBy(F.size("tokens"), F.desc("confidence"), "tokens", "verdict")
    return ordered.select(F.monotonically_increasing_id().alias("rule_id"), "tokens", "verdict", "confidence", "support")


def _mine(scratch: Scratch, baskets: DataFrame, verdicts: list[tuple[str, float]], total: int, need: int, min_confidence: float, min_lift: float) -> list[DataFrame]:
    """The rules of each size.

    A set grows by one token of the baskets that hold it, each time from its
    conditional base (what follows it in those baskets, equal ones counted).
    Sets that no rule worth keeping can contain don't grow: those below the
    support, those met as often as a part of them (same confidence, longer) and
    those with one label only (no longer rule is surer).
    """
    counts, bests = [f"c{i}" for i in range(len(verdicts))], [f"b{i}" for i in range(len(verdicts))]

    def counted(rows: DataFrame) -> DataFrame:
        each = [F.coalesce(F.sum(F.when(F.col("label") == v, F.col("n"))), F.lit(0)).alias(c) for (v, _), c in zip(verdicts, counts)]
        return rows.groupBy("set").agg(F.sum("n").alias("held"), *each).where(F.array_max(F.array(*counts)) >= need)

    def rules(sets: DataFrame) -> DataFrame:
        says = []
        for (v, share), c, b in zip(verdicts, counts, bests):
            sure = F.col(c) / F.col("held")
            ok = (F.col(c) >= need) & (sure >= min_confidence) & (sure / F.lit(share) >= min_lift) & (sure > F.col(b))
            says.append(F.struct(F.lit(v).alias("verdict"), sure.alias("confidence"), (F.col(c) / F.lit(total)).alias("support"), ok.alias("ok")))
        met = sets.select(F.col("set").alias("tokens"), F.inline(F.filter(F.array(*says), lambda r: r["ok"])))
        return met.drop("ok")

    def open_ended(sets: DataFrame) -> DataFrame:
        return sets.where((F.array_max(F.array(*counts)) < F.col("held")) & (F.col("held") < total))

    def grown(rows: DataFrame) -> DataFrame:
        met = rows.select("set", "label", "n", "rest", F.posexplode("rest").alias("at", "token"))
        rest = F.slice("rest", F.col("at") + 2, F.size("rest"))
        return met.select(F.array_append("set", F.col("token")).alias("set"), "label", "n", rest.alias("rest"))

    def base(rows: DataFrame) -> DataFrame:
        return rows.where(F.size("rest") > 0).groupBy("set", "label", "rest").agg(F.sum("n").alias("n"))

    singles = counted(baskets.select(F.explode("items").alias("token"), "label", "n").select(F.array("token").alias("set"), "label", "n"))
    sets = scratch.save(singles.select("*", *[F.lit(0.0).alias(b) for b in bests]), "sets-1")
    found = [rules(sets)]
    tokens = sorted(r[0] for r in open_ended(sets).select(F.get("set", F.lit(0))).collect())
    # tokens within the support number at most the mean basket's size by its inverse
    within = F.array_sort(F.array_intersect("items", F.from_json(F.lit(json.dumps(tokens)), "array<string>")))
    first = base(baskets.select(F.array().cast("array<string>").alias("set"), "label", "n", within.alias("rest")))
    state, size = scratch.save(base(grown(first)), "base-1"), 1
    while not state.isEmpty():
        size += 1
        wider = grown(state)
        parts = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.filter("set", lambda _, j: j != i))
        split = counted(wider).select("*", F.explode(parts).alias("part"))
        before = open_ended(sets).select(
            F.col("set").alias("part"), F.col("held").alias("_held"), *[F.greatest(F.col(b), F.col(c) / F.col("held")).alias(f"_{b}") for b, c in zip(bests, counts)]
        )
        met = split.join(before, "part").groupBy("set", "held", *counts).agg(
            F.count("*").alias("_parts"), F.min("_held").alias("_least"), *[F.max(f"_{b}").alias(b) for b in bests]
        )
        sets = scratch.save(met.where((F.col("_parts") == size) & (F.col("_least") > F.col("held"))).drop("_parts", "_least"), f"sets-{size}")
        found.append(rules(sets))
        state = scratch.save(base(wider.join(open_ended(sets).select("set"), "set")), f"base-{size}")
    return found


def _joined(pages: DataFrame, mined: DataFrame, url_col: str) -> DataFrame:
    """``pages`` with the first rule that fires, for rules too many to broadcast."""
    rules = mined.select("rule_id", "tokens", F.struct((-F.col("confidence")).alias("c"), F.size("tokens").alias("k"), "rule_id", "verdict", "tokens").alias("r"))
    posts = rules.select("rule_id", "r", F.explode("tokens").alias("token"))
    rarest = posts.join(posts.groupBy("token").agg(F.count("*").alias("h")), "token").groupBy("rule_id").agg(
        F.min(F.struct("h", "token")).alias("m"), F.first("r").alias("r")
    )
    url = F.coalesce(F.col(url_col), F.lit(""))
    known = pages.select(url.alias("_u")).distinct().withColumn("_t", url_tokens(F.col("_u")))
    met = known.select("_u", "_t", F.explode("_t").alias("_token")).join(rarest, F.col("_token") == F.col("m.token"))
    fired = met.where(F.size(F.array_except("r.tokens", "_t")) == 0).groupBy("_u").agg(F.min("r").alias("_r"))
    out = pages.join(fired, url == F.col("_u"), "left")
    return out.withColumns({"_mined": F.col("_r.verdict"), "mined_rule": F.array_join("_r.tokens", " & ")}).drop("_u", "_r")


def judge(pages: DataFrame, mined: DataFrame, id_col: str = "page_id", url_col: str = "url", max_rules: int = MAX_RULES) -> DataFrame:
    """``pages`` with host, path, rule, verdict and the mined rule that spoke, if any."""
    rules = [r.asDict() for r in mined.orderBy(F.desc("confidence"), F.size("tokens"), "rule_id").limit(max_rules + 1).collect()]
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rule, says = fixed_rule(F.col("host"), F.col("path"))
    out = pages.withColumns({"host": host, "path": path, "_tokens": url_tokens(F.col(url_col))})
    if len(rules) > max_rules:
        out = _joined(out, mined, url_col)
    elif rules:
        index: dict[str, list[int]] = {}
        for at, r in enumerate(rules):
            for token in r["tokens"]:
                index.setdefault(token, []).append(at)
        spark = pages.sparkSession
        table = spark.createDataFrame(
            [(index, [len(r["tokens"]) for r in rules], [r["verdict"] for r in rules], [" & ".join(r["tokens"]) for r in rules])],
            "_q_ix map<string, array<int>>, _q_sizes array<int>, _q_verdicts array<string>, _q_names array<string>",
        )
        # one row, of a size that max_rules bounds; the key is the same for all pages
        out = out.withColumn("_one", F.lit(1)).join(F.broadcast(table.withColumn("_one", F.lit(1))), "_one", "left")
        posted = F.flatten(F.transform("_tokens", lambda t: F.coalesce(F.try_element_at("_q_ix", t), F.array().cast("array<int>"))))
        out = out.withColumn("_posted", F.array_sort(posted))
        # in order, a rule's postings are a run: it fires if the run is as long as its antecedent
        fired = F.filter("_posted", lambda r, i: F.coalesce(F.get("_posted", i - F.get("_q_sizes", r) + 1) == r, F.lit(False)))
        out = out.withColumn("_fired", F.array_min(fired))
        out = out.withColumns({"_mined": F.get("_q_verdicts", F.col("_fired")), "mined_rule": F.get("_q_names", F.col("_fired"))})
        out = out.drop("_one", "_q_ix", "_q_sizes", "_q_verdicts", "_q_names", "_posted", "_fired")
    else:
        out = out.withColumns({"_mined": F.lit(None).cast("string"), "mined_rule": F.lit(None).cast("string")})
    return out.withColumns({"rule": rule, "verdict": F.coalesce(says, F.col("_mined"), F.lit("allow"))}).drop("_tokens", "_mined")


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, label): what the labels say of the pages that no fixed rule judges.

    A label row is taken to speak of the page with its id; an id labelled poor
    or toxic is to block, another labelled one to allow.  Pages that a fixed
    rule judges are left out, or the miner would only learn those rules again.
    """
    marks = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(
        F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad")
    )
    _, says = fixed_rule(host_of(F.col("url")), path_of(F.col("url")))
    met = pages.where(says.isNull()).select("page_id", "url").join(marks, F.col("page_id") == F.col("doc_id"))
    return met.select("url", F.when(F.col("bad") == 1, "block").otherwise("allow").alias("label"))


def digest(pages: DataFrame, labels: DataFrame) -> DataFrame:
    mined = mine_rules(labelled_pages(pages, labels), "url", "label")
    return judge(pages.select("page_id", "url"), mined).select("page_id", "host", "path", "rule", "verdict", "mined_rule")
