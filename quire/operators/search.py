"""Full-text search: BM25, word and boolean queries, several sources.

Statistics are of the whole corpus; filters come after scoring and before the
limit.  ``score`` scans texts that have no index, counting only the query's
tokens; ``postings`` holds the index that a store keeps.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import MARKED, PLAIN, tokens

K1, B = 1.2, 0.75
IDF_FLOOR = 1e-6
_FOLD = str.maketrans(MARKED.lower(), PLAIN.lower())


def sanitize(query: str) -> str:
    """Letters and decimal digits; everything else a space."""
    return " ".join("".join(c if unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd" else " " for c in query).split())


def query_tokens(word: str) -> list[str]:
    """Index tokens of a query word."""
    return re.findall(r"[^\W_]+", word.lower().translate(_FOLD))


@dataclass(frozen=True)
class Query:
    """A parsed query: its tokens, each once, and a test on whether each is met."""

    tokens: tuple[str, ...]
    tree: tuple | None

    def matches(self, count: Column) -> Column:
        """``count``: array of token frequencies in the order of ``tokens``."""
        at = {t: i for i, t in enumerate(self.tokens)}

        def test(node: tuple) -> Column:
            kind, *parts = node
            if kind == "word":
                return F.get(count, F.lit(at[parts[0]])) > 0
            a, b = test(parts[0]), test(parts[1])
            return a & b if kind == "and" else a | b if kind == "or" else a & ~b

        return test(self.tree) if self.tree else F.lit(False)

    def scored(self) -> tuple[str, ...]:
        """Tokens that add to the score: those not only under NOT."""

        def seen(node: tuple) -> list[str]:
            if node[0] == "word":
                return [node[1]]
            return seen(node[1]) + ([] if node[0] == "not" else seen(node[2]))

        return tuple(dict.fromkeys(seen(self.tree))) if self.tree else ()


def parse(query: str) -> Query:
    """Words are joined by AND; upper-case AND, OR and NOT are operators.

    NOT binds strongest, then adjacency and AND, then OR.  A query that isn't
    well formed, or is empty, matches nothing.
    """
    words = sanitize(query).split()
    used: list[str] = []
    at = 0

    def word() -> tuple | None:
        nonlocal at
        if at >= len(words) or words[at] in ("AND", "OR", "NOT"):
            return None
        node = None
        for t in query_tokens(words[at]):
            used.append(t)
            node = ("word", t) if node is None else ("and", node, ("word", t))
        at += 1
        return node

    def negated() -> tuple | None:
        nonlocal at
        node = word()
        while node and at < len(words) and words[at] == "NOT":
            at += 1
            other = word()
            node = ("not", node, other) if other else None
        return node

    def both() -> tuple | None:
        nonlocal at
        node = negated()
        while node and at < len(words) and words[at] != "OR":
            if words[at] == "AND":
                at += 1
            other = negated()
            node = ("and", node, other) if other else None
        return node

    tree = both()
    while tree and at < len(words):
        at += 1
        other = both()
        tree = ("or", tree, other) if other else None
    return Query(tuple(dict.fromkeys(used)) if tree else (), tree)


def frequencies(text: Column, wanted: tuple[str, ...]) -> Column:
    """How often each wanted token occurs in an array of tokens."""

    def count(word: str) -> Column:
        return F.size(F.filter(text, lambda x: x == word)).cast("long")

    return F.array(*[count(w) for w in wanted])


def score(
    docs: DataFrame,
    query: str,
    key: list[str],
    text_cols: list[str],
    where: Column | None = None,
    limit: int | None = 20,
) -> DataFrame:
    """(key, score): rows that match, best first; a lower score is better, ties by key."""
    q = parse(query)
    joined = F.concat(*[tokens(F.col(c)) for c in text_cols])
    if q.tree is None:
        return docs.select(*key).limit(0).withColumn("score", F.lit(0.0))
    counted = docs.select("*", joined.alias("_tokens")).select(
        *docs.columns, frequencies(F.col("_tokens"), q.tokens).alias("_tf"), F.size("_tokens").cast("long").alias("_dl")
    )
    wanted = q.scored()
    places = {t: q.tokens.index(t) for t in wanted}
    stats = counted.agg(
        F.count("*").alias("n"), F.avg("_dl").alias("avgdl"), *[F.count_if(F.get("_tf", F.lit(i)) > 0).alias(f"df{i}") for i in places.values()]
    ).first()
    n, avgdl = stats["n"], stats["avgdl"] or 1.0
    total: Column = F.lit(0.0)
    for i in places.values():
        idf = max(IDF_FLOOR, math.log((n - stats[f"df{i}"] + 0.5) / (stats[f"df{i}"] + 0.5)))
        tf = F.get("_tf", F.lit(i)).cast("double")
        total = total + F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_dl") / avgdl))
    found = counted.where(q.matches(F.col("_tf")))
    if where is not None:
        found = found.where(where)
    ranked = found.select(*key, (-total).alias("score"))
    return ranked.orderBy("score", *key).limit(limit) if limit else ranked


def search_sources(found: dict[str, tuple[DataFrame, str, int]]) -> DataFrame:
    """(source, rank, id, score) of one query's hits in several sources, each under its own limit.

    ``found`` gives for each source its scored hits, their key and the limit.
    """
    parts = []
    for name, (hits, key, limit) in found.items():
        best = hits.orderBy("score", key).limit(limit)
        rank = F.row_number().over(Window.orderBy("score", key))  # at most ``limit`` rows
        parts.append(best.select(F.lit(name).alias("source"), rank.alias("rank"), F.col(key).cast("string").alias("id"), "score"))
    return reduce(DataFrame.unionByName, parts)
