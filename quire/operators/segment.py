"""Segmentation of ordered paragraphs to scenes, and windows over them.

Paragraphs are rows (chapter_id, id, ordinal, ...); ``block_ordinal`` is their
place among all blocks where breaks are blocks too.  Each function is a plan of
windows and joins keyed by chapter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import approx_tokens, stable_id

MIN_SCENE = 2
DEFAULT_TARGET = 4


def explicit_breaks(paragraphs: DataFrame, breaks: DataFrame, legacy_ordinals: bool = False) -> DataFrame:
    """(chapter_id, id): the last paragraph before each break block.

    Breaks are (chapter_id, ordinal) in block ordinals.  By default so are the
    paragraphs; ``legacy_ordinals`` compares paragraph ordinals instead, which
    drifts later with every further break.
    """
    place = F.col("ordinal") if legacy_ordinals else F.col("block_ordinal")
    p = paragraphs.select("chapter_id", place.cast("long").alias("_o"), F.col("id").alias("_id"), F.lit(0).alias("_k"))
    b = breaks.select("chapter_id", F.col("ordinal").cast("long").alias("_o"), F.lit(None).cast(paragraphs.schema["id"].dataType).alias("_id"), F.lit(1).alias("_k"))
    # a break at an ordinal comes before a paragraph at the same one: strictly less
    w = Window.partitionBy("chapter_id").orderBy("_o", F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0)
    met = p.unionByName(b).withColumn("id", F.last("_id", ignorenulls=True).over(w))
    return met.where("_k = 1 and id is not null").select("chapter_id", "id").distinct()


def merge_breaks(*sources: tuple[DataFrame, str]) -> DataFrame:
    """(chapter_id, id, boundary_source): the first source that names a paragraph wins."""
    every = None
    for rank, (df, name) in enumerate(sources):
        part = df.select("chapter_id", "id", F.struct(F.lit(rank).alias("r"), F.lit(name).alias("s")).alias("_b"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("chapter_id", "id").agg(F.min("_b").alias("_b")).select("chapter_id", "id", F.col("_b.s").alias("boundary_source"))


def spans(paragraphs: DataFrame, breaks: DataFrame) -> DataFrame:
    """Paragraphs with ``span`` from 1, ``pos`` from 1 within it, its length ``span_n``."""
    w = Window.partitionBy("chapter_id").orderBy("ordinal")
    b = breaks.select("chapter_id", "id", F.lit(1).alias("_cut"))
    cut = F.coalesce(F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = paragraphs.join(b, ["chapter_id", "id"], "left").withColumn("span", (cut + 1).cast("int"))
    s = Window.partitionBy("chapter_id", "span")
    return marked.withColumns({"pos": F.row_number().over(s.orderBy("ordinal")), "span_n": F.count("*").over(s)}).drop("_cut")


def scene_counts(spanned: DataFrame, target: int | None = None, max_paragraphs: int | None = None) -> DataFrame:
    """(chapter_id, span, span_n, scenes): scenes for each span.

    Each span starts with as many as the maximum asks for.  Further ones, up to
    the target, go one by one to the span of greatest length / (count + 1); as
    these quotients fall with the count, the order is a ranking of all of them.
    """
    if target is None and max_paragraphs is None:
        target = DEFAULT_TARGET
    n = F.col("span_n")
    most = F.greatest(F.lit(1), F.floor(n / MIN_SCENE))
    base = F.least(most, F.ceil(n / max_paragraphs)) if max_paragraphs else F.lit(1).cast("long")
    one = spanned.select("chapter_id", "span", "span_n").distinct().withColumns({"_most": most, "_base": base})
    # no chapter can take more than the target beyond the base
    room = F.least(F.col("_most") - F.col("_base"), F.lit(max(0, target or 0)).cast("long"))
    tries = one.withColumn("_k", F.explode(F.when(room > 0, F.sequence(F.lit(1).cast("long"), room)).otherwise(F.array().cast("array<bigint>"))))
    ranked = tries.withColumn(
        "_rank", F.row_number().over(Window.partitionBy("chapter_id").orderBy(F.desc(n / (F.col("_base") + F.col("_k"))), "span", "_k"))
    )
    need = one.groupBy("chapter_id").agg(F.greatest(F.lit(0), F.lit(target or 0) - F.sum("_base")).alias("_need"))
    added = ranked.join(need, "chapter_id").where("_rank <= _need").groupBy("chapter_id", "span").agg(F.count("*").alias("_more"))
    out = one.join(added, ["chapter_id", "span"], "left")
    return out.select("chapter_id", "span", "span_n", (F.col("_base") + F.coalesce("_more", F.lit(0))).alias("scenes"))


def even_part(pos: Column, n: Column, k: Column) -> Column:
    """Part, from 1, of position pos in n split to k parts, the first n % k one longer."""
    size, extra = F.floor(n / k), n % k
    long_part = F.floor((pos - 1) / (size + 1)) + 1
    return F.when(pos <= extra * (size + 1), long_part).otherwise(extra + F.floor((pos - 1 - extra * (size + 1)) / size) + 1)


def count_breaks(paragraphs: DataFrame, breaks: DataFrame, target: int | None = None, max_paragraphs: int | None = None) -> DataFrame:
    """(chapter_id, id): last paragraphs of the parts that paragraph counts ask for."""
    s = spans(paragraphs, breaks)
    counted = s.join(scene_counts(s, target, max_paragraphs).select("chapter_id", "span", "scenes"), ["chapter_id", "span"])
    part = even_part(F.col("pos"), F.col("span_n"), F.col("scenes"))
    following = even_part(F.col("pos") + 1, F.col("span_n"), F.col("scenes"))
    return counted.where((F.col("pos") < F.col("span_n")) & (part != following)).select("chapter_id", "id")


def build_scenes(paragraphs: DataFrame, breaks: DataFrame) -> DataFrame:
    """Scenes between breaks: id, chapter_id, ordinal, first and last paragraph, source, counts."""
    w = Window.partitionBy("chapter_id").orderBy("ordinal")
    b = breaks.select("chapter_id", "id", "boundary_source")
    cut = F.col("boundary_source").isNotNull().cast("int")
    marked = paragraphs.select("chapter_id", "id", "ordinal").join(b, ["chapter_id", "id"], "left")
    island = F.coalesce(F.sum(cut).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1
    scenes = marked.withColumn("_scene", island.cast("int")).groupBy("chapter_id", "_scene").agg(
        F.min_by("id", "ordinal").alias("paragraph_start"),
        F.max_by("id", "ordinal").alias("paragraph_end"),
        F.max_by(F.coalesce("boundary_source", F.lit("chapter_end")), "ordinal").alias("boundary_source"),
        F.min("ordinal").alias("first_ordinal"),
        F.max("ordinal").alias("last_ordinal"),
        F.count("*").alias("paragraph_count"),
    )
    return scenes.withColumnRenamed("_scene", "ordinal").withColumns(
        {"id": stable_id("sc", F.col("chapter_id"), F.col("ordinal"), F.col("paragraph_start"), F.col("paragraph_end")), "status": F.lit("generated")}
    )


def detect(
    paragraphs: DataFrame,
    breaks: DataFrame,
    proposed: DataFrame | None = None,
    mode: str = "hybrid",
    target: int | None = None,
    max_paragraphs: int | None = None,
) -> DataFrame:
    """Scenes of all chapters; breaks as rows (chapter_id, ordinal), proposals as (chapter_id, id)."""
    explicit = explicit_breaks(paragraphs, breaks)
    sources = [(explicit, "explicit")]
    if proposed is not None and mode != "explicit":
        sources.append((accepted_proposals(paragraphs, proposed), "model"))
    found = merge_breaks(*sources)
    if mode != "explicit" and (mode == "paragraph-count" or target or max_paragraphs):
        found = merge_breaks(*sources, (count_breaks(paragraphs, found, target, max_paragraphs), "paragraph_count"))
    return build_scenes(paragraphs, found)


def accepted_proposals(paragraphs: DataFrame, proposed: DataFrame) -> DataFrame:
    """Proposed breaks of the chapters whose proposals all name known paragraphs."""
    known = paragraphs.select("chapter_id", "id")
    bad = proposed.join(known, ["chapter_id", "id"], "left_anti").select("chapter_id").distinct()
    return proposed.select("chapter_id", "id").join(bad, "chapter_id", "left_anti").distinct()


def partition_violations(scenes: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(chapter_id, ordinal, problem): why scenes don't split their chapters to parts."""
    p = paragraphs.select("chapter_id", F.col("id").alias("_pid"), F.col("ordinal").alias("_po"))
    first = p.select("chapter_id", F.col("_pid").alias("paragraph_start"), F.col("_po").alias("_from"))
    last = p.select("chapter_id", F.col("_pid").alias("paragraph_end"), F.col("_po").alias("_to"))
    s = scenes.select("chapter_id", "ordinal", "paragraph_start", "paragraph_end")
    s = s.join(first, ["chapter_id", "paragraph_start"], "left").join(last, ["chapter_id", "paragraph_end"], "left")
    span = p.groupBy("chapter_id").agg(F.min("_po").alias("_first"), F.max("_po").alias("_last"))
    w = Window.partitionBy("chapter_id").orderBy("ordinal")
    seen = s.join(span, "chapter_id", "left").withColumns(
        {"_rn": F.row_number().over(w), "_before": F.lag("_to").over(w), "_next": F.lead("ordinal").over(w)}
    )
    why = F.array(
        F.when(F.col("_first").isNull(), F.lit("scenes without paragraphs")),
        F.when(F.col("ordinal") != F.col("_rn"), F.lit("ordinal gap")),
        F.when(F.col("_first").isNotNull() & (F.col("_from").isNull() | F.col("_to").isNull()), F.lit("unknown paragraph")),
        F.when(F.col("_from") > F.col("_to"), F.lit("range reversed")),
        F.when((F.col("_rn") == 1) & (F.col("_from") != F.col("_first")), F.lit("missing head")),
        F.when((F.col("_rn") > 1) & (F.col("_from") != F.col("_before") + 1), F.lit("gap or overlap")),
        F.when(F.col("_next").isNull() & (F.col("_to") != F.col("_last")), F.lit("missing tail")),
    )
    return seen.select("chapter_id", "ordinal", F.explode(F.filter(why, lambda x: x.isNotNull())).alias("problem"))


def full_span(scenes: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(chapter_id, id): scenes that cover their whole chapter."""
    ends = paragraphs.groupBy("chapter_id").agg(F.min_by("id", "ordinal").alias("_a"), F.max_by("id", "ordinal").alias("_b"))
    met = scenes.join(ends, "chapter_id")
    return met.where((F.col("paragraph_start") == F.col("_a")) & (F.col("paragraph_end") == F.col("_b"))).select("chapter_id", "id")


def oversized(sized: DataFrame, target: int, tokens: str = "tokens") -> DataFrame:
    """Rows whose prompt has more tokens than the target; none without a target."""
    return sized.where(F.col(tokens) > target) if target > 0 else sized.limit(0)


def token_windows(paragraphs: DataFrame, target: int, overlap: int = 3, by: str = "chapter_id") -> DataFrame:
    """(by, window from 1, first, last, tokens): paragraphs packed greedily, by 1-based position.

    No paragraph is split; one over the target is a window of its own; the last
    ``overlap`` of a window begin the next, which moves on by one at least.
    The walk is a fold over a chapter's token counts, which are all it holds.
    """
    sizes = paragraphs.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("ordinal", approx_tokens(F.col("text")).alias("t")))).alias("_p"))
    counts = F.transform("_p", lambda x: x["t"])
    if target <= 0:
        total = F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)
        return sizes.select(by, F.lit(1).alias("window"), F.lit(1).alias("first"), F.size("_p").alias("last"), total.alias("tokens"))
    overlap = max(0, overlap)
    start = F.struct(
        F.lit(1).alias("i"), F.lit(1).alias("first"), F.lit(0).cast("long").alias("tokens"),
        F.array().cast("array<struct<first:int,last:int,tokens:bigint>>").alias("done"),
    )

    # a window that overflows at i closes at i - 1; the next starts back by the overlap
    def step(s: Column, t: Column) -> Column:
        full = (s["i"] > s["first"]) & (s["tokens"] + t > target)
        begin = F.greatest(s["first"] + 1, s["i"] - overlap)
        closed = F.struct(s["first"].alias("first"), (s["i"] - 1).alias("last"), s["tokens"].alias("tokens"))
        return F.struct(
            (s["i"] + 1).alias("i"),
            F.when(full, begin).otherwise(s["first"]).cast("int").alias("first"),
            F.when(full, F.lit(-1)).otherwise(s["tokens"] + t).cast("long").alias("tokens"),
            F.when(full, F.concat(s["done"], F.array(closed))).otherwise(s["done"]).alias("done"),
        )

    if overlap == 0:
        # without overlap the next window starts at i with t alone
        def plain(s: Column, t: Column) -> Column:
            moved = step(s, t)
            return F.struct(moved["i"].alias("i"), moved["first"].alias("first"), F.when(moved["tokens"] < 0, t).otherwise(moved["tokens"]).alias("tokens"), moved["done"].alias("done"))

        folded = F.aggregate(counts, start, plain)
        final = F.concat(folded["done"], F.array(F.struct(folded["first"].alias("first"), F.size("_p").alias("last"), folded["tokens"].alias("tokens"))))
        windows = sizes.select(by, F.posexplode(final).alias("_i", "_w"))
        return windows.select(by, (F.col("_i") + 1).alias("window"), F.col("_w.first").alias("first"), F.col("_w.last").alias("last"), F.col("_w.tokens").alias("tokens"))
    return _overlapping(sizes, target, overlap, by)


def _overlapping(sizes: DataFrame, target: int, overlap: int, by: str) -> DataFrame:
    """Windows with overlap: the walk may step back, so it isn't a fold."""

    def walk(pdf):
        rows = []
        for key, entries in zip(pdf[by], pdf["_p"]):
            counts = [int(e["t"]) for e in entries]
            start, number = 0, 1
            while start < len(counts):
                end, total = start, 0
                while end < len(counts) and (end == start or total + counts[end] <= target):
                    total += counts[end]
                    end += 1
                rows.append((key, number, start + 1, end, total))
                if end == len(counts):
                    break
                start, number = max(end - overlap, start + 1), number + 1
        return rows

    import pandas as pd

    names = [by, "window", "first", "last", "tokens"]

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame(walk(pdf), columns=names)

    kind = sizes.schema[by].dataType.simpleString()
    return sizes.mapInPandas(run, f"{by} {kind}, window int, first int, last int, tokens long")
