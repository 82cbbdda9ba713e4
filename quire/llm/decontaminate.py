"""Find benchmark passages in documents and cut them or the documents.

The windows of the benchmark, 13 words (a shorter item is one window of its
own length), become a sorted table of hashes and word sequences that is
broadcast to the scan.  Each document's word windows are looked up there; a
hit is verified word by word before it counts.  The windows are counted first,
and the table is made only while they number at most ``max_windows``.  A larger
benchmark stays a table of rows: a bit table of fixed size is broadcast, only
windows that it may hold leave the scan, and they meet the benchmark's in a join.

Defined results: null or empty texts have no words and no hits; a document
inside which several windows overlap counts each word once; items with null
text or without words have no windows; items that repeat an id are one item, and
a null id is the empty one; rows that repeat a ``doc_id`` are judged one by one;
words that a cut brings together are looked at again, until no window is left;
empty tables give empty results or no hits; a column named ``_leak`` is replaced,
others pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import textkit as tk
from quire.llm.scratch import Scratch, bound_batches

WINDOW = 13
MIN_SHARE = 20  # a document with 1/20 of its words hit is contaminated
MAX_WINDOWS = 500_000  # windows of a benchmark that are broadcast
BITS_LOG = 27  # bits of the table that is broadcast for a larger one


class WindowTable:
    """Benchmark windows by length: sorted hashes, the words behind each, the items."""

    def __init__(self, items: list[tuple[object, str]], window: int = WINDOW):
        found: dict[tuple[str, ...], set[str]] = {}
        for item, text in items:
            words = split_words(text)
            k = min(window, len(words))
            for i in range(len(words) - k + 1 if k else 0):
                found.setdefault(tuple(words[i : i + k]), set()).add("" if item is None else str(item))
        self.lengths: dict[int, tuple[np.ndarray, list[list[tuple[bytes, frozenset[str]]]]]] = {}
        by_length: dict[int, list[tuple[str, ...]]] = {}
        for words in found:
            by_length.setdefault(len(words), []).append(words)
        for k, windows in by_length.items():
            joined = [" ".join(w).encode() for w in windows]
            data = np.frombuffer(b" ".join(joined), np.uint8)
            starts, ends, _ = tk.word_bounds(data, np.array([0, len(data)]), tk.ALNUM_WORDS)
            hashes = tk.run_hashes(tk.word_hashes(data, starts, ends), k)[::k]
            keys = np.unique(hashes)
            slots: list[list[tuple[bytes, frozenset[str]]]] = [[] for _ in keys]
            for at, text, words in zip(np.searchsorted(keys, hashes).tolist(), joined, windows):
                slots[at].append((text, frozenset(found[words])))
            self.lengths[k] = (keys, slots)


def split_words(text: str | None) -> list[str]:
    """Words of letters and digits, A-Z lower-cased; other code points from 0x80 are letters."""
    if not text:
        return []
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    starts, ends, _ = tk.word_bounds(data, np.array([0, len(data)]), tk.ALNUM_WORDS)
    raw = data.tobytes()
    return [raw[a:b].lower().decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist())]


def scan_column(column: pa.Array, table: WindowTable) -> Iterator[tuple[int, list[tuple[int, int]], list[tuple[int, int]], set[str]]]:
    """For each row: words, hit word spans, their byte spans, ids of the items met."""
    for lo, hi, data, offsets in tk.row_blocks(column):
        starts, ends, ranges = tk.word_bounds(data, offsets, tk.ALNUM_WORDS)
        words = tk.word_hashes(data, starts, ends)
        n_rows = hi - lo
        hits: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
        row_of = None
        for k, (keys, slots) in table.lengths.items():
            runs = tk.run_hashes(words, k)
            if not len(runs):
                continue
            at = np.searchsorted(keys, runs)
            at[at == len(keys)] = 0
            for i in np.flatnonzero(keys[at] == runs).tolist():
                if row_of is None:
                    row_of = np.repeat(np.arange(n_rows), np.diff(ranges))
                if row_of[i] != row_of[i + k - 1]:
                    continue  # a run over the end of a row
                said = b" ".join(data[a:b].tobytes().lower() for a, b in zip(starts[i : i + k].tolist(), ends[i : i + k].tolist()))
                for text, ids in slots[at[i]]:
                    if text == said:
                        spans, items = hits.setdefault(int(row_of[i]), ([], set()))
                        spans.append((i, i + k))
                        items |= ids
        first = ranges.tolist()
        for row in range(n_rows):
            spans, items = hits.get(row, ([], set()))
            merged = merge(spans)
            cut = [(int(starts[a] - offsets[row]), int(ends[b - 1] - offsets[row])) for a, b in merged]
            yield first[row + 1] - first[row], [(a - first[row], b - first[row]) for a, b in merged], cut, items


def merge(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch made one."""
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def without(text: str, cuts: list[tuple[int, int]]) -> str:
    """The text without these spans of its bytes."""
    raw = text.encode("utf-8", "surrogatepass")
    ends = [0, *(b for _, b in cuts)]
    return b"".join(raw[a:b] for a, b in zip(ends, [*(a for a, _ in cuts), len(raw)])).decode("utf-8", "surrogatepass")


_FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("cuts", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def _scan(docs: DataFrame, text_col: str, table: WindowTable, out: str, keep_text: bool) -> DataFrame:
    """``docs`` with a struct column ``out`` of what was found in the text."""
    shared = docs.sparkSession.sparkContext.broadcast(table)
    columns = [c for c in docs.columns if c != out and (keep_text or c != text_col)]
    schema = T.StructType([docs.schema[c] for c in columns] + [T.StructField(out, _FOUND)])
    kind = pa.struct(
        [("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("cuts", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            rows = [
                {"n_words": n, "spans": [list(s) for s in spans], "cuts": [list(s) for s in cuts], "items": sorted(items)}
                for n, spans, cuts, items in scan_column(batch.column(batch.schema.names.index(text_col)), known)
            ]
            arrays = [batch.column(batch.schema.names.index(c)) for c in columns] + [pa.array(rows, kind)]
            yield pa.RecordBatch.from_arrays(arrays, [*columns, out])

    return docs.select(*dict.fromkeys([*columns, text_col])).mapInArrow(tk.tidy(run), schema)


def _items(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """(item, text, n) of the items that have words, and how many windows each has."""
    bound_batches(benchmark.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [np.zeros(0, np.int64)]
            for _, _, data, offsets in tk.row_blocks(batch.column(1)):
                sizes.append(np.diff(tk.word_bounds(data, offsets, tk.ALNUM_WORDS)[2]))
            words = np.concatenate(sizes)
            counts = pa.array(np.where(words > 0, np.maximum(1, words - window + 1), 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts], ["item", "text", "n"]).filter(pa.array(words > 0))

    return benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).mapInArrow(run, "item string, text string, n long")


def _table(items: DataFrame, window: int, max_windows: int) -> WindowTable | None:
    """The benchmark's windows, or None if they are too many to broadcast."""
    if (items.agg(F.sum("n")).first()[0] or 0) > max_windows:
        return None
    return WindowTable([(r["item"], r["text"]) for r in items.select("item", "text").collect()], window)


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    max_windows: int = MAX_WINDOWS,
    keep_text: bool = True,
) -> DataFrame:
    """``docs`` with ``_leak``: n_words, merged word and byte spans hit, items met."""
    items = _items(benchmark, item_col, item_text_col, window)
    table = _table(items, window, max_windows)
    if table is not None:
        return _scan(docs, text_col, table, "_leak", keep_text)
    return _joined(docs, text_col, items, window, keep_text)


def _item_windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                table = WindowTable([(item, text)], window)
                for k, (keys, slots) in table.lengths.items():
                    rows = [(k, int(h), said.decode("utf-8", "replace")) for h, slot in zip(keys.astype(np.int64), slots) for said, _ in slot]
                    ks, hs, said = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ks, pa.int32()), pa.array(hs, pa.int64()), pa.array(said, pa.string()), pa.array([item or ""] * len(rows), pa.string())], ["k", "h", "said", "item"]
                    )

    return run


def _candidates(lengths: list[int], shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]
            for lo, hi, data, offsets in tk.row_blocks(batch.column(2)):
                starts, ends, ranges = tk.word_bounds(data, offsets, tk.ALNUM_WORDS)
                words = tk.word_hashes(data, starts, ends)
                row_of = np.repeat(np.arange(hi - lo), np.diff(ranges))
                for k in lengths:
                    runs = tk.run_hashes(words, k)
                    bit = runs & np.uint64((1 << BITS_LOG) - 1)
                    met = np.flatnonzero((bits[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1))
                    met = met[row_of[met] == row_of[met + k - 1]] if len(met) else met
                    row = row_of[met] if len(met) else met
                    said = [b" ".join(data[a:b].tobytes().lower() for a, b in zip(starts[i : i + k].tolist(), ends[i : i + k].tolist())).decode("utf-8", "replace") for i in met.tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(keys[0][lo + row]), pa.array(keys[1][lo + row]), pa.array(np.full(len(met), k, np.int32)), pa.array(runs[met].astype(np.int64)), pa.array(said, pa.string()),
                            pa.array(met - ranges[:-1][row]), pa.array(starts[met] - offsets[row]), pa.array(ends[met + k - 1] - offsets[row]),
                        ],
                        ["h1", "h2", "k", "h", "said", "at", "from", "to"],
                    )

    return run


def _joined(docs: DataFrame, text_col: str, items: DataFrame, window: int, keep_text: bool) -> DataFrame:
    """``find_leaks`` for a benchmark too large to broadcast; texts are told apart by 128-bit hashes."""
    spark = docs.sparkSession
    windows = Scratch(spark, "windows").save(items.mapInArrow(_item_windows(window), "k int, h long, said string, item string").distinct(), "windows")
    lengths = sorted(r["k"] for r in windows.select("k").distinct().collect())  # at most ``window`` of them
    bit = F.col("h").bitwiseAND(F.lit((1 << BITS_LOG) - 1))
    words = windows.select(F.shiftright(bit, 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("m"))
    bits = np.zeros(1 << (BITS_LOG - 6), dtype=np.uint64)  # of a fixed size
    for batch in words.groupBy("w").agg(F.expr("bit_or(m)").alias("m")).toArrow().to_batches():
        bits[batch.column(0).to_numpy()] = batch.column(1).to_numpy().view(np.uint64)
    keys = [F.xxhash64(text_col).alias("h1"), F.xxhash64(F.lit("second"), F.col(text_col)).alias("h2")]
    texts = docs.where(F.col(text_col).isNotNull()).select(*keys, F.col(text_col).alias("text"))
    found = texts.mapInArrow(_candidates(lengths, spark.sparkContext.broadcast(bits)), "h1 long, h2 long, k int, h long, said string, at long, from long, to long")
    hits = found.distinct().join(windows, ["k", "h", "said"])
    span, cut = F.struct("at", (F.col("at") + F.col("k")).alias("to")), F.struct("from", "to")
    by_text = hits.groupBy(F.col("h1").alias("_h1"), F.col("h2").alias("_h2")).agg(
        F.collect_set(span).alias("_spans"), F.collect_set(cut).alias("_cuts"), F.collect_set("item").alias("_met")
    )
    met = docs.drop("_leak").join(by_text, (keys[0] == F.col("_h1")) & (keys[1] == F.col("_h2")), "left").drop("_h1", "_h2")
    counted = _scan(met, text_col, WindowTable([], window), "_leak", keep_text)
    leak = F.struct(
        F.col("_leak.n_words").alias("n_words"),
        _merged("_spans", "at", "to").alias("spans"),
        _merged("_cuts", "from", "to").alias("cuts"),
        F.array_sort(F.coalesce("_met", F.array().cast("array<string>"))).alias("items"),
    )
    return counted.withColumn("_leak", leak).drop("_spans", "_cuts", "_met")


def _merged(spans: str, start: str, end: str) -> Column:
    """Spans in order, those that overlap or touch made one."""
    rows = F.array_sort(F.coalesce(F.col(spans), F.array().cast(f"array<struct<{start}:bigint,{end}:bigint>>")))

    def add(done: Column, s: Column) -> Column:
        return F.struct(
            F.when(s[start] <= done["to"], done["at"]).otherwise(s[start]).alias("at"),
            F.greatest(done["to"], s[end]).alias("to"),
            F.when((s[start] <= done["to"]) | (done["to"] < 0), done["out"]).otherwise(F.concat(done["out"], F.array(F.array(done["at"], done["to"])))).alias("out"),
        )

    begin = F.struct(F.lit(-1).cast("long").alias("at"), F.lit(-1).cast("long").alias("to"), F.array().cast("array<array<bigint>>").alias("out"))
    return F.aggregate(rows, begin, add, lambda d: F.when(d["to"] < 0, d["out"]).otherwise(F.concat(d["out"], F.array(F.array(d["at"], d["to"])))))


def hit_words() -> Column:
    """Words inside the merged spans of ``_leak``."""
    return F.aggregate(F.col("_leak.spans"), F.lit(0).cast("long"), lambda s, x: s + x[1] - x[0])


def leak_columns(found: DataFrame, min_share: int = MIN_SHARE) -> DataFrame:
    """Digest columns of ``find_leaks``: n_words, n_hit, n_items, items_sha256, contaminated."""
    leak, hit = F.col("_leak"), hit_words()
    return found.withColumns(
        {
            "n_words": leak["n_words"],
            "n_hit": hit,
            "n_items": F.size(leak["items"]).cast("long"),
            "items_sha256": F.sha2(F.array_join(leak["items"], ","), 256),
            "contaminated": (hit > 0) & (hit * min_share >= leak["n_words"]),
        }
    )


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    min_share: int = MIN_SHARE,
    max_windows: int = MAX_WINDOWS,
) -> DataFrame:
    """``docs`` without contaminated rows; in the others the spans that were hit are cut, until none is left."""
    items = _items(benchmark, item_col, item_text_col, window)
    table = _table(items, window, max_windows)
    if table is not None:
        return _cut(docs, text_col, table, min_share)
    scratch, done, todo = Scratch(docs.sparkSession, "decontaminate"), [], docs
    while True:  # each round looks at those only that the last one cut
        found = scratch.save(_joined(todo, text_col, items, window, True), f"round-{len(done)}")
        hit = F.size("_leak.spans") > 0
        done.append(found.where(~hit).select(*docs.columns))
        cut = found.where(hit)
        if len(done) == 1:
            cut = cut.where(hit_words() * min_share < F.col("_leak.n_words"))
        if cut.isEmpty():
            return reduce(DataFrame.unionByName, done)
        todo = _spliced(cut, text_col).drop("_leak")


def _spliced(found: DataFrame, text_col: str) -> DataFrame:
    """Rows of ``find_leaks`` with their spans cut from the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index(text_col)
            leaks = batch.column(batch.schema.names.index("_leak")).to_pylist()
            texts = [t if t is None else without(t, x["cuts"]) for t, x in zip(batch.column(at).to_pylist(), leaks)]
            yield batch.set_column(at, text_col, pa.array(texts, pa.string()))

    return found.mapInArrow(tk.tidy(run), found.schema)


def _cut(docs: DataFrame, text_col: str, table: WindowTable, min_share: int) -> DataFrame:
    """``decontaminate`` in one scan."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            at = batch.schema.names.index(text_col)
            column, keep, changed = batch.column(at), [], {}
            for i, (n, spans, cuts, _) in enumerate(scan_column(column, known)):
                hit = sum(b - a for a, b in spans)
                keep.append(hit == 0 or hit * min_share < n)
                if hit and keep[-1]:
                    text = column[i].as_py()
                    while cuts:
                        text = without(text, cuts)
                        cuts = next(scan_column(pa.array([text], pa.string()), known))[2]
                    changed[i] = text
            if changed:
                texts = column.to_pylist()
                for i, text in changed.items():
                    texts[i] = text
                batch = batch.set_column(at, text_col, pa.array(texts, pa.string()))
            yield batch if all(keep) else batch.filter(pa.array(keep))

    return docs.mapInArrow(tk.tidy(run), docs.schema)


def cleaned(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``decontaminate`` with the column of text lengths, where there is one, brought up to date."""
    done = decontaminate(docs, benchmark, text_col)
    return done.withColumn(chars_col, F.char_length(text_col).cast(docs.schema[chars_col].dataType)) if chars_col in docs.columns else done


def digest(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = leak_columns(find_leaks(docs.select("doc_id", "text"), benchmark, keep_text=False))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def items_digest(items: list[str]) -> str:
    """The digest of item ids as the query states it, for tests."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
