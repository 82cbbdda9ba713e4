"""Stored full-text index: postings by token, document lengths, corpus statistics.

``build`` tokenises every text once.  Postings (token, key, tf, dl) lie in
buckets by token, sorted, so a query reads the folders of its few tokens and, in
them, the row groups that hold these.  Only documents that hold one of the
tokens take part in a query; nothing of the others is read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import tokens
from quire.operators.search import B, IDF_FLOOR, K1, parse

#: Bytes of text whose postings go in one bucket.
BUCKET_BYTES = 256 << 20
#: Bytes of text that a task splits to tokens, and of text whose postings one sorts, once there are several buckets.
DEALT_BYTES, TASK_BYTES = 16 << 20, 8 << 20


def _bucket(token: Column, buckets: Column) -> Column:
    return F.pmod(F.xxhash64(token), buckets).cast("int")


def buckets_for(docs: DataFrame, text_cols: list[str]) -> int:
    """How many buckets the postings of these texts need; reads lengths only."""
    size = F.sum(F.octet_length(F.concat_ws(" ", *text_cols)).cast("long"))
    return -(-(docs.agg(size).first()[0] or 0) // BUCKET_BYTES) or 1


def build(docs: DataFrame, key: list[str], text_cols: list[str], buckets: int) -> DataFrame:
    """(token, key, tf, dl, bucket): a row for each token of each document; a key names one document.

    Tokens are shuffled once, by ranges, and counted after that.
    """
    # splits of the files may be of any size: texts are dealt anew, so that no task has to spill its tokens
    dealt = docs.select(*key, *text_cols).repartition(buckets * (BUCKET_BYTES // DEALT_BYTES), *key) if buckets > 1 else docs
    said = dealt.select(*key, F.concat(*[tokens(F.col(c)) for c in text_cols]).alias("_t"))
    each = said.select(*key, F.size("_t").cast("long").alias("dl"), F.explode("_t").alias("token"))
    placed = each.select(_bucket(F.col("token"), F.lit(buckets)).alias("bucket"), "token", *key, "dl")
    # every task writes runs of tokens of few buckets; a token of many documents goes to several tasks
    ranged = placed.repartitionByRange(*([buckets * (BUCKET_BYTES // TASK_BYTES)] if buckets > 1 else []), "bucket", "token", *key)
    # rows of a token and key lie together, so they are counted where they are
    counted = ranged.groupBy("bucket", "token", *key).agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    ordered = counted.sortWithinPartitions("bucket", "token", *key)
    return ordered.select("token", *key, "tf", "dl", "bucket")


def statistics(docs: DataFrame, postings: DataFrame, buckets: int) -> DataFrame:
    """One row: documents, their mean length in tokens, buckets of the postings."""
    whole = docs.agg(F.count("*").alias("n"))
    return whole.crossJoin(postings.agg(F.sum("tf").alias("_t"))).select("n", (F.coalesce("_t", F.lit(0)) / F.greatest("n", F.lit(1))).alias("avgdl"), F.lit(buckets).alias("buckets"))


def search(postings: DataFrame, stats: DataFrame, query: str, key: list[str], where: DataFrame | None = None, limit: int | None = 20) -> DataFrame:
    """(key, score): documents that match, best first; a lower score is better, ties by key.

    Statistics are of the whole corpus; ``where`` holds the keys that a filter
    lets through, and comes before the limit.
    """
    q = parse(query)
    if q.tree is None:
        return postings.select(*key).limit(0).withColumn("score", F.lit(0.0))
    whole = stats.first()
    n, avgdl = whole["n"], whole["avgdl"] or 1.0
    spark = postings.sparkSession
    places = spark.range(1).select(*[_bucket(F.lit(t), F.lit(whole["buckets"])) for t in q.tokens]).first()
    met = postings.where(F.col("bucket").isin(*sorted(set(places))) & F.col("token").isin(*q.tokens))
    tf = [F.coalesce(F.max(F.when(F.col("token") == t, F.col("tf"))), F.lit(0)) for t in q.tokens]
    found = met.groupBy(*key).agg(F.array(*tf).alias("_tf"), F.max("dl").alias("_dl"))
    df = {r["token"]: r["df"] for r in met.groupBy("token").agg(F.count("*").alias("df")).collect()}  # a row for each word asked for
    total: Column = F.lit(0.0)
    for t in q.scored():
        idf = max(IDF_FLOOR, math.log((n - df.get(t, 0) + 0.5) / (df.get(t, 0) + 0.5)))
        count = F.get("_tf", F.lit(q.tokens.index(t))).cast("double")
        total = total + F.lit(idf) * count * (K1 + 1) / (count + K1 * (1 - B + B * F.col("_dl") / avgdl))
    ranked = found.where(q.matches(F.col("_tf")))
    if where is not None:
        ranked = ranked.join(where.select(*key).distinct(), key, "left_semi")
    ranked = ranked.select(*key, (-total).alias("score"))
    return ranked.orderBy("score", *key).limit(limit) if limit else ranked
