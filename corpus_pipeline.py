"""Five stages from raw documents to a mixed training corpus.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's ``docs``.  All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import decontaminate, jaccard_join, langid, line_dedup, mixing
from quire.llm.scratch import Scratch, temporary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; a null ``lang`` becomes the predicted one.

    The languages are those of ``lang`` itself.  Null, empty and letterless
    texts go, and so do those of which the mixture puts more than 3/4 in no
    learned language.  Repeated rows are judged alike; without any ``lang`` only
    texts without a letter go.
    """
    return langid.keep_known(docs)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that a document of smaller id holds; ``n_chars`` follows.

    Documents of which only blanks are left go.  Rows without an id keep all
    their lines; rows that repeat an id are one document, each with its lines.
    """
    return line_dedup.reduced(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near duplicates.

    Texts without words and rows without an id are no one's duplicates; rows
    that repeat the smallest id all stay.
    """
    return jaccard_join.keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """No contaminated documents; benchmark spans are cut from the others and ``n_chars`` follows.

    Null and empty texts hold no window and stay; an empty benchmark changes nothing.
    """
    return decontaminate.cleaned(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each use of each document, weighted by source; every document is used.

    Documents without a source are one source; those without tokens are used once.
    """
    return mixing.expand(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", drop_shared_lines),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", remove_benchmark),
    ("source_mixing", mix_sources),
]

#: Language inference and exact near-duplicate search aren't SQL; tests hold
#: run() against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        if i == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with temporary():  # what the stage set aside goes once its rows are written
            docs = scratch.save(stage(spark, docs, sf_dir), name)
        scratch.keep_only(name)
    return docs
