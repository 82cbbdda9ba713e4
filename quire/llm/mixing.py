"""Mix sources to target weights: temperature, budget, block permutations.

The token shares of the sources are raised to an exponent and normalised.  The
exponent is the smallest of [0, 1], found by bisection, for which the entropy
stays within its target and no source is repeated beyond the limit.  Each
source's share of the budget becomes whole epochs and a part of one more.  A
source's documents are dealt by hash to blocks of about ``block_tokens``.  Seed,
source and epoch permute the blocks, and the part takes them in that order; only
the documents of the block in which it ends are sorted.  To find that block, the
sums of 4,096 ranges of the permutation are looked at first, then the blocks of
one range, so no source is ever gathered in one task.

Defined results: null sources and the empty name are one source; a document's
tokens are a quarter of its UTF-8 bytes, rounded down but at least 1 (0 if it
is null or empty); a source without tokens has weight 0 and its documents one
copy; rows that repeat an id are placed together; a single source has weight 1;
an empty table gives an empty result.  All columns pass through; those named
like an output are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = "mix-1"
BLOCK_TOKENS = 200_000
ENTROPY = 0.97
REPEATS = 2.0
MAX_SOURCES = 100_000
STEPS = 60
RANGE_DIGITS = 3  # of a block's turn, in base 16


def text_tokens(text: Column) -> Column:
    """Estimated tokens: a quarter of the bytes, at least 1 for any text."""
    size = F.octet_length(F.coalesce(text, F.lit("")))
    return F.when(size == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(size / 4))).cast("long")


@dataclass(frozen=True)
class Plan:
    """A source's weight, its whole epochs and the tokens of the part of one more (-1: no part)."""

    source: str
    weight: float
    epochs: int
    part: int
    blocks: int


def tempered(shares: list[float], exponent: float) -> list[float]:
    raised = [p**exponent for p in shares]
    total = sum(raised)
    return [r / total for r in raised]


def find_exponent(shares: list[float], entropy: float, repeats: float, cover: bool) -> float:
    """Smallest exponent within the entropy target (a share of the largest) and the repetition limit."""
    if len(shares) < 2:
        return 1.0

    def fits(exponent: float) -> bool:
        w = tempered(shares, exponent)
        h = -sum(x * math.log(x) for x in w if x > 0)
        ratio = [x / p for x, p in zip(w, shares)]
        most = max(ratio) / min(ratio) if cover else max(ratio)
        return h <= entropy * math.log(len(shares)) and most <= repeats

    low, high = 0.0, 1.0
    for _ in range(STEPS):
        mid = (low + high) / 2
        low, high = (low, mid) if fits(mid) else (mid, high)
    return high


def plan_sources(totals: dict[str, int], entropy: float, repeats: float, budget: int | None, block_tokens: int) -> list[Plan]:
    """The plan for each source; without a budget, enough for every source to be used whole."""
    counted = {s: t for s, t in sorted(totals.items()) if t > 0}
    plans = [Plan(s, 0.0, 1, -1, 1) for s in totals if s not in counted]
    if not counted:
        return plans
    total = sum(counted.values())
    shares = [t / total for t in counted.values()]
    weights = tempered(shares, find_exponent(shares, entropy, repeats, budget is None))
    whole = budget is None
    if whole:
        budget = math.ceil(max(t / w for t, w in zip(counted.values(), weights)))
    for (source, tokens), weight in zip(counted.items(), weights):
        target = max(math.floor(weight * budget + 1e-6), tokens if whole else 0)
        plans.append(Plan(source, round(weight, 9), target // tokens, target % tokens, max(1, -(-tokens // block_tokens))))
    return plans


def block_turn(seed: Column, source: Column, epoch: Column, block: Column) -> Column:
    """What blocks are ordered by in an epoch of a source: a permutation of them."""
    return F.md5(F.concat_ws("|", seed, source, epoch.cast("string"), block.cast("string")))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    entropy: float = ENTROPY,
    repeats: float = REPEATS,
    budget: str | int | None = None,
    block_tokens: int = BLOCK_TOKENS,
    seed: str = SEED,
) -> DataFrame:
    """``docs`` with tokens, weight, block and copies (0 or more uses of the document).

    ``budget`` is a number of tokens, "total" for those there are, or None for
    as many as use every document at least once.
    """
    spark = docs.sparkSession
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    light = docs.select(F.col(id_col).alias("_id"), source.alias("_source"), text_tokens(F.col(text_col)).alias("_tokens"))
    sums = light.groupBy("_source").agg(F.sum("_tokens").alias("t")).limit(MAX_SOURCES + 1).collect()
    if len(sums) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources to plan")
    totals = {r["_source"]: r["t"] for r in sums}
    tokens = sum(totals.values()) if budget == "total" else budget
    plans = plan_sources(totals, entropy, repeats, tokens, block_tokens)
    plan = spark.createDataFrame(
        [(p.source, p.weight, p.epochs, p.part, p.blocks) for p in plans], "_ps string, _weight double, _epochs long, _part long, _blocks long"
    )
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("_id").cast("string"), F.lit("")))).alias("_key")
    block = (F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") % F.col("_blocks")).alias("_block")
    turn = block_turn(F.lit(seed), F.col("_source"), F.col("_epochs") + 1, F.col("_block")).alias("_turn")

    def placed(rows: DataFrame, by: DataFrame) -> DataFrame:
        return rows.select("*", key).join(F.broadcast(by), F.col("_source") == F.col("_ps")).select("*", block).select("*", turn)

    sizes = placed(light, plan).groupBy("_ps", "_part", "_turn").agg(F.sum("_tokens").alias("t"))
    sizes = sizes.withColumn("_range", F.substring("_turn", 1, RANGE_DIGITS))
    # the range, then the block, in which a source's part ends, and what those before it leave
    ranges = sizes.groupBy("_ps", "_part", "_range").agg(F.sum("t").alias("t"))
    ranges = ranges.withColumn("_before", F.sum("t").over(Window.partitionBy("_ps").orderBy("_range")) - F.col("t")).where("_before <= _part")
    last = ranges.groupBy("_ps").agg(F.max("_range").alias("_range"), F.max("_before").alias("_before"))
    inside = sizes.join(F.broadcast(last), ["_ps", "_range"])  # a row for each source, which MAX_SOURCES bounds
    along = Window.partitionBy("_ps").orderBy("_turn")
    inside = inside.withColumn("_before", F.col("_before") + F.sum("t").over(along) - F.col("t")).where("_before <= _part")
    cut = inside.groupBy(F.col("_ps").alias("_cs")).agg(F.max("_turn").alias("_cut"), (F.max("_part") - F.max("_before")).alias("_rest"))
    full = plan.join(cut, F.col("_ps") == F.col("_cs"), "left").drop("_cs")
    names = [c for c in docs.columns if c not in ("tokens", "weight", "block", "copies")]
    rows = docs.select(*names, F.col(id_col).alias("_id"), source.alias("_source"), text_tokens(F.col(text_col)).alias("_tokens"))
    rows = placed(rows, full)

    def out(frame: DataFrame, more: Column) -> DataFrame:
        return frame.select(
            *names, F.col("_tokens").alias("tokens"), F.col("_weight").alias("weight"), F.col("_block").alias("block"), (F.col("_epochs") + more).alias("copies")
        )

    ends = F.col("_turn") == F.coalesce(F.col("_cut"), F.lit(""))
    inner = Window.partitionBy("_source").orderBy("_key", "_id", "_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = rows.where(ends).withColumn("_sum", F.sum("_tokens").over(inner))
    whole = out(rows.where(~ends), F.when(F.col("_turn") < F.col("_cut"), 1).otherwise(0).cast("long"))
    return whole.unionByName(out(edge, F.when(F.col("_sum") <= F.col("_rest"), 1).otherwise(0).cast("long")))


def digest(docs: DataFrame) -> DataFrame:
    mixed = mix(docs.select("doc_id", "text", "source"), budget="total")
    return mixed.select("doc_id", "source", "tokens", "weight", "block", "copies")


def expand(docs: DataFrame, **how: object) -> DataFrame:
    """Every use of every document as a row: ``epoch`` from 1, and ``order_key`` to read blocks by."""
    mixed = mix(docs, **how)
    used = mixed.where("copies > 0").select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("epoch"))
    source = F.coalesce(F.col(how.get("source_col", "source")).cast("string"), F.lit(""))
    return used.withColumn("order_key", block_turn(F.lit(how.get("seed", SEED)), source, F.col("epoch"), F.col("block")))
