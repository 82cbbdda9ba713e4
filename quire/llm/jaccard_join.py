"""Exact Jaccard join on word shingles by prefix filters under several token orders.

Every document becomes its set of 64-bit shingle hashes.  Documents with equal
sets form one class before anything is joined, so copies cost one row each.

* Pass 1 gives each document's class key and a fixed-size count sketch of the
  corpus; the sketch ranks tokens that a large share of documents hold behind
  all others in every order.
* Pass 2 emits the prefix of each set under the first order, packed by token
  range.  Two sets that reach the threshold share a prefix token, under this
  order and under any other.  Within a token's bucket size and position filters
  apply, and a bound from a bitmap of each set: bits in which two differ stand
  for tokens that only one of them holds.
  Buckets of up to ``SMALL`` sets yield all their pairs.  Larger ones yield one
  link from each set to its neighbour in size and to an anchor, and are kept for
  pass 3.  A token that a sample of the documents shows in very many prefixes is
  dealt to several buckets by set; pass 3 then sees all of them.
* Candidates must also share enough prefix tokens under the second order, and
  under the third, to leave the threshold in reach.  Only pairs that pass both
  have their sets shipped and intersected in full.
* Pass 3 is about pairs of large buckets whose ends are not yet connected; only
  these can still add a link that matters.  Rounds that take a few random ones
  bring large groups together; the last round takes all pairs still apart.  So a
  group of n near copies costs about n checks, and no link between classes that
  lie in different components is lost.

Defined results: null or empty texts, or texts without words, have an empty set
and link with nothing (they are their own component); fewer words than a
shingle make one shingle; a null ``doc_id`` has no component; rows that repeat
a ``doc_id`` are one document, linked by what any of them links; an empty table
gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm import textkit as tk
from quire.llm.components import components
from quire.llm.scratch import Scratch, bound_batches

SHINGLE = 5
PERCENT = 80
ORDERS = (0, 1, 2)
SMALL = 8
#: Rounds over large buckets: random neighbours (0), then one in so many pairs apart; the last takes all.
ROUNDS = (0, 8, 1)
PARTNERS = 8  # so many pairs apart for each entry are few enough to try all of them
NEIGHBOURS = 3  # partners of a set in a round of random ones
CELLS_LOG = 20
SLICES = 64
BLOOM_LOG = 25
BITS = tuple(f"b{i}" for i in range(8))  # 64 bits each; a bit says whether an odd number of tokens hash to it
HOT = 1 << 20  # prefixes that hold a token, beyond which it has several buckets
SAMPLE = 64  # one in so many ids is looked at to find such tokens
CHUNK = 1 << 16  # entries in one row of a large bucket
RUN = 4096  # sets of a large bucket that are put in a random order at a time
ENTRY = np.dtype([("tok", "<u8"), ("set", "<i8"), ("size", "<i4"), ("rank", "<i4")])


def prefix_size(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Tokens of a set of n of which one is shared by any set that reaches the threshold."""
    return n - (percent * n + 99) // 100 + 1


def needed(a: np.ndarray | int, b: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Least intersection with which sets of these sizes reach the threshold."""
    return (percent * (a + b) + 99 + percent) // (100 + percent)


def in_rows(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The order of values by row, then value: one sort of both in 64 bits, made exact where the bits left out matter."""
    bits = np.uint64(max(1, int(n).bit_length()))
    by = np.argsort((rows.astype(np.uint64) << (np.uint64(64) - bits)) | (values >> bits))
    v, r = values[by], rows[by]
    if ((v[1:] < v[:-1]) & (r[1:] == r[:-1])).any():
        by = np.lexsort((values, rows))
    return by


def block_sets(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, tokens, bounds) of blocks of rows: each row's distinct shingle hashes, sorted, lie between its bounds."""
    for lo, hi, data, offsets in tk.row_blocks(column):
        starts, ends, ranges = tk.word_bounds(data, offsets, tk.SPACE_WORDS)
        words, counts, n = tk.word_hashes(data, starts, ends), np.diff(ranges), hi - lo
        row_of = np.repeat(np.arange(n), counts)
        runs = tk.run_hashes(words, k)
        inside = row_of[: len(runs)] == row_of[len(row_of) - len(runs) :]
        tokens, rows = runs[inside], row_of[: len(runs)][inside]
        short = np.flatnonzero((counts > 0) & (counts < k))
        if len(short):
            few = [tk.run_hashes(words[ranges[i] : ranges[i + 1]], int(counts[i])) for i in short]
            tokens, rows = np.concatenate([tokens, *few]), np.concatenate([rows, short])
        by = in_rows(tokens, rows, n)
        tokens, rows = tokens[by], rows[by]
        first = np.ones(len(tokens), dtype=bool)
        first[1:] = (tokens[1:] != tokens[:-1]) | (rows[1:] != rows[:-1])
        yield lo, hi, tokens[first], np.searchsorted(rows[first], np.arange(n + 1))


def token_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    for _, _, tokens, bounds in block_sets(column, k):
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield tokens[a:b]


def class_keys(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that equal sets share, for each row."""
    out = []
    for seed in (11, 12):
        sums = np.zeros(len(tokens) + 1, dtype=np.uint64)
        np.cumsum(tk.mix(tokens, seed), out=sums[1:])
        out.append((sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64))
    return out[0], out[1]


def bitmaps(tokens: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The words of each row's bitmap: the exclusive or of its tokens' bits."""
    some = np.flatnonzero(bounds[1:] > bounds[:-1])
    word = (tokens >> np.uint64(26)) % np.uint64(len(BITS))
    bit = np.uint64(1) << ((tokens >> np.uint64(20)) & np.uint64(63))
    out = []
    for i in range(len(BITS)):
        value = np.zeros(len(bounds) - 1, dtype=np.uint64)
        if len(some):
            value[some] = np.bitwise_xor.reduceat(np.where(word == np.uint64(i), bit, np.uint64(0)), bounds[some])
        out.append(value.view(np.int64))
    return out


def ordered(tokens: np.ndarray, levels: np.ndarray, order: int) -> np.ndarray:
    """Tokens as sort keys of an order: common ones last, the rest by a hash of their own."""
    level = levels[(tokens >> np.uint64(64 - CELLS_LOG)).astype(np.int64)].astype(np.uint64)
    key = tk.mix(tokens, 20 + order) if order else tokens
    return (level << np.uint64(60)) | (key >> np.uint64(4))


def _profile(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << CELLS_LOG, dtype=np.int64)
        names = ["id", "n", "s1", "s2", *BITS, "slice", "counts"]
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            for lo, hi, tokens, bounds in block_sets(batch.column(1), k):
                n, rows = np.diff(bounds), hi - lo
                s1, s2 = class_keys(tokens, bounds)
                counts += np.bincount((tokens >> np.uint64(64 - CELLS_LOG)).astype(np.int64), minlength=len(counts))
                bits = [pa.array(b) for b in bitmaps(tokens, bounds)]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, rows), pa.array(n), pa.array(s1), pa.array(s2), *bits, pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names)
        # 16 bits are enough to know a cell as common, as one task reads one split
        parts = np.minimum(counts, 65535).astype("<u2").reshape(SLICES, -1)
        used = [i for i in range(SLICES) if parts[i].any()]
        packed = [zlib.compress(parts[i].tobytes(), 1) for i in used]
        empty = [pa.nulls(len(used), pa.int64())] * (4 + len(BITS))
        yield pa.RecordBatch.from_arrays([*empty, pa.array(used, pa.int32()), pa.array(packed, pa.binary())], names)

    return run


def _sum_slices(pdf):
    total = np.zeros((1 << CELLS_LOG) // SLICES, dtype=np.int64)
    for blob in pdf["counts"]:
        total += np.frombuffer(zlib.decompress(blob), "<u2")
    return pdf.iloc[:1][["slice"]].assign(counts=[total.astype("<i8").tobytes()])


def common_levels(profile: DataFrame) -> np.ndarray:
    """A level for each sketch cell, 0 where it holds no common token.

    The result has a fixed size.  It only shapes the orders: any level gives
    right results, as it is the same for all documents.
    """
    slices = profile.where("slice is not null").select("slice", "counts").groupBy("slice").applyInPandas(_sum_slices, "slice int, counts binary")
    counts = np.zeros((SLICES, (1 << CELLS_LOG) // SLICES), dtype=np.int64)
    for row in slices.collect():
        counts[row["slice"]] = np.frombuffer(row["counts"], "<i8")
    return levels_of(counts.reshape(-1))


def levels_of(counts: np.ndarray) -> np.ndarray:
    """Levels by how far a cell's count lies above what the rare tokens of a cell sum up to.

    Those grow with the corpus and vary by about the root of their number, so a
    token that is in a fixed share of the documents stands out at every size.
    """
    usual = np.median(counts)
    spread = max(np.sqrt(usual), 1.4826 * np.median(np.abs(counts - usual)))
    floor = max(64.0, 6.0 * spread)
    levels = np.zeros(len(counts), dtype=np.uint8)
    high = counts - usual >= floor
    levels[high] = np.minimum(15, 1 + np.log2((counts[high] - usual) / floor)).astype(np.uint8)
    return levels


def _prefix_tokens(k: int, percent: int, shared, order: int):
    """The prefix tokens of some sets, to find those that very many hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        for batch in batches:
            for tokens in token_sets(batch.column(0), k):
                if len(tokens):
                    keys = np.sort(ordered(tokens, levels, order))[: prefix_size(len(tokens), percent)]
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], ["tok"])

    return run


def _prefixes(k: int, percent: int, shared, parts: int, order: int, hot: dict[int, int]):
    hot_tokens = np.array(sorted(hot), dtype=np.uint64)
    hot_shares = np.array([hot[int(t)] for t in hot_tokens], dtype=np.uint64)

    def part_of(entries: np.ndarray) -> np.ndarray:
        key = tk.mix(entries["tok"], 7)
        if len(hot_tokens):
            at = np.minimum(np.searchsorted(hot_tokens, entries["tok"]), len(hot_tokens) - 1)
            salt = np.where(hot_tokens[at] == entries["tok"], tk.mix(entries["set"].view(np.uint64), 8) % hot_shares[at], 0)
            key = key + salt.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (key % np.uint64(parts)).astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, seen = shared.value, set()

        def packed(held: list[np.ndarray]) -> pa.RecordBatch:
            entries = np.concatenate(held)
            part = part_of(entries)
            by = np.argsort(part, kind="stable")
            entries, part = entries[by], part[by]
            firsts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            blobs = [entries[a:b].tobytes() for a, b in zip(firsts, np.r_[firsts[1:], len(part)])]
            return pa.RecordBatch.from_arrays([pa.array(part[firsts]), pa.array(blobs, pa.binary())], ["part", "entries"])

        held, pending = [], 0
        for batch in batches:
            for _, _, tokens, bounds in block_sets(batch.column(0), k):
                sizes = np.diff(bounds)
                s1, s2 = class_keys(tokens, bounds)
                fresh = sizes > 0
                for i, key in enumerate(zip(s1.tolist(), s2.tolist())):
                    if key in seen:
                        fresh[i] = False
                    elif len(seen) < 1_000_000:  # a memory of copies; past it copies only cost their rows
                        seen.add(key)
                row_of = np.repeat(np.arange(len(sizes)), sizes)
                mine = fresh[row_of]
                row_of, keys = row_of[mine], ordered(tokens[mine], levels, order)
                by = in_rows(keys, row_of, len(sizes))
                row_of, keys = row_of[by], keys[by]
                rank = np.arange(len(keys)) - np.searchsorted(row_of, np.arange(len(sizes)))[row_of]
                first = rank < prefix_size(sizes, percent)[row_of]
                row_of = row_of[first]
                rows = np.zeros(len(row_of), ENTRY)
                rows["tok"], rows["set"], rows["size"], rows["rank"] = keys[first], s1[row_of], sizes[row_of], rank[first]
                held.append(rows)
                pending += len(rows)
                if pending > 1 << 20:
                    yield packed(held)
                    held, pending = [], 0
        if pending:
            yield packed(held)

    return run


def _pass_filters(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether entries of one bucket may reach the threshold by size and position."""
    na, nb = a["size"].astype(np.int64), b["size"].astype(np.int64)
    rest = 1 + np.minimum(na - a["rank"] - 1, nb - b["rank"] - 1)
    return (np.minimum(na, nb) * 100 >= np.maximum(na, nb) * percent) & (rest >= needed(na, nb, percent))


def _bucket_pairs(percent: int, hot: dict[int, int]):
    hot_tokens = np.array(sorted(hot), dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "tok", "entries"]
        blobs = [x.as_py() for batch in batches for x in batch.column(1)]
        if not blobs:
            return
        e = np.concatenate([np.frombuffer(x, ENTRY) for x in blobs])
        del blobs
        e = e[np.argsort(e["tok"], kind="stable")]
        same = np.r_[False, e["tok"][1:] == e["tok"][:-1]]
        shared = same | np.r_[same[1:], False]
        if len(hot_tokens):
            shared |= np.isin(e["tok"], hot_tokens)
        e = e[shared]  # most tokens are in one set only
        if not len(e):
            return
        e = e[np.lexsort((e["set"], e["size"], e["tok"]))]
        again = np.r_[False, (e["tok"][1:] == e["tok"][:-1]) & (e["set"][1:] == e["set"][:-1]) & (e["size"][1:] == e["size"][:-1])]
        e = e[~again]
        firsts = np.flatnonzero(np.r_[True, e["tok"][1:] != e["tok"][:-1]])
        sizes = np.diff(np.r_[firsts, len(e)])
        left, right = [], []
        for m in range(2, SMALL + 1):
            at = firsts[sizes == m]
            for i in range(m):
                for j in range(i + 1, m):
                    left.append(at + i)
                    right.append(at + j)
        big = sizes > SMALL
        if len(hot_tokens):  # what other tasks hold of the token is met in pass 3
            big |= np.isin(e["tok"][firsts], hot_tokens)
        large = [(int(f), int(f + m)) for f, m in zip(firsts[big], sizes[big])]
        for lo, hi in large:
            left.append(np.arange(lo, hi - 1))
            right.append(np.arange(lo + 1, hi))
            size, at = e["size"][lo:hi].astype(np.int64), 0
            while at < hi - lo:  # an anchor for each run of sizes that may link with it
                end = int(np.searchsorted(size * percent, size[at] * 100, side="right"))
                left.append(np.full(end - at - 1, lo + at))
                right.append(np.arange(lo + at + 1, lo + end))
                at = end
        if left:
            l, r = np.concatenate(left), np.concatenate(right)
            ok = _pass_filters(e[l], e[r], percent)
            a, b = e["set"][l[ok]], e["set"][r[ok]]
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
            n = len(pairs)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names)
        large = [(at, min(hi, at + CHUNK)) for lo, hi in large for at in range(lo, hi, CHUNK)]
        for at in range(0, len(large), 256):
            some = large[at : at + 256]
            nothing = pa.nulls(len(some), pa.int64())
            toks = pa.array([int(e["tok"][lo].astype(np.int64)) for lo, _ in some], pa.int64())
            yield pa.RecordBatch.from_arrays([nothing, nothing, toks, pa.array([e[lo:hi].tobytes() for lo, hi in some], pa.binary())], names)

    return run


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for tok, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            e = np.frombuffer(blob, ENTRY)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(e), tok)), pa.array(e["set"].copy()), pa.array(e["size"].astype(np.int64)), pa.array(e["rank"].astype(np.int64))],
                ["tok", "set", "size", "rank"],
            )


def id_filter(ids: DataFrame) -> np.ndarray:
    """A fixed-size bit table that holds every id of ``ids`` (and, by chance, some others)."""
    bit = F.pmod(F.xxhash64("id"), F.lit(1 << BLOOM_LOG))
    words = ids.select(bit.alias("b")).select(F.expr("cast(b div 64 as int)").alias("w"), F.expr("shiftleft(1L, cast(b % 64 as int))").alias("m"))
    table = np.zeros(1 << (BLOOM_LOG - 6), dtype=np.int64)
    for batch in words.groupBy("w").agg(F.expr("bit_or(m)").alias("m")).toArrow().to_batches():
        table[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return table


def _sets(k: int, percent: int, shared_levels, shared_bits, orders: tuple[int, ...] | None):
    """(id, size, tokens) of rows whose id may be wanted.

    Without orders the whole sets, sorted; with orders their prefixes under
    each, one after another, as the upper 32 bits of the sort keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, bits = shared_levels.value, shared_bits.value
        for batch in batches:
            b = batch.column(2).to_numpy(zero_copy_only=False)
            hit = (bits[b >> 6].view(np.uint64) >> (b & 63).astype(np.uint64)) & np.uint64(1) == 1
            batch = batch.filter(pa.array(hit))
            held, keys, sizes, blobs = 0, [], [], []
            ids = batch.column(0).to_pylist()

            def out():
                return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())], ["id", "size", "tokens"])

            for i, tokens in zip(ids, token_sets(batch.column(1), k)):
                if orders is None:
                    blobs.append(tokens.tobytes())
                else:
                    blobs.append(b"".join(prefix(tokens, levels, o, percent).tobytes() for o in orders))
                keys.append(i)
                sizes.append(len(tokens))
                held += len(tokens)
                if held > 1 << 20:
                    yield out()
                    held, keys, sizes, blobs = 0, [], [], []
            if keys:
                yield out()

    return run


def prefix(tokens: np.ndarray, levels: np.ndarray, order: int, percent: int) -> np.ndarray:
    """The prefix of a set under an order, as the upper halves of its sort keys."""
    keys = ordered(tokens, levels, order)
    size = prefix_size(len(keys), percent)
    if size < len(keys):
        keys = np.partition(keys, size - 1)[:size]
    keys.sort()
    return (keys >> np.uint64(32)).astype("<u4")


def within_reach(x: np.ndarray, y: np.ndarray, nx: int, ny: int, percent: int) -> bool:
    """Whether two sets may reach the threshold by their sorted prefixes of one order.

    Below the smaller of the two last keys both prefixes are complete, so the
    intersection is at most what they share there and all that either has left.
    """
    if not len(x) or not len(y):
        return False
    end = min(x[-1], y[-1])
    a, b = np.searchsorted(x, end), np.searchsorted(y, end)
    both = 0
    if a and b:
        at = np.searchsorted(y[:b], x[:a])
        at[at == b] = 0
        both = int((y[:b][at] == x[:a]).sum())
    return both + min(nx - a, ny - b) >= needed(nx, ny, percent)


def _hopeful(percent: int, orders: int):
    """Pairs that every order's prefixes leave in reach of the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, nu, nv = (batch.column(i).to_pylist() for i in range(4))
            sides = [[np.frombuffer(x.as_buffer(), "<u4").reshape(orders, -1) for x in batch.column(c)] for c in (4, 5)]
            keep = [i for i in range(len(u)) if all(within_reach(x, y, nu[i], nv[i], percent) for x, y in zip(sides[0][i], sides[1][i]))]
            yield pa.RecordBatch.from_arrays([pa.array([u[i] for i in keep], pa.int64()), pa.array([v[i] for i in keep], pa.int64())], ["u", "v"])

    return run


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            u, v = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i in range(len(u)):
                a = np.frombuffer(batch.column(2)[i].as_buffer(), "<u8")
                b = np.frombuffer(batch.column(3)[i].as_buffer(), "<u8")
                if linked(a, b, percent):
                    us.append(u[i])
                    vs.append(v[i])
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return run


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the threshold."""
    if not len(a) or not len(b) or min(len(a), len(b)) * 100 < max(len(a), len(b)) * percent:
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return both * 100 >= percent * (len(a) + len(b) - both)


class JaccardJoin:
    """One run of the join: the passes above over a DataFrame of documents.

    Both sides of its joins grow with the documents, so they are sorted and
    merged at every size; the adaptive planner can split what is hot.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, orders: tuple[int, ...]):
        self.spark: SparkSession = docs.sparkSession
        self.docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        self.k, self.percent, self.orders = k, percent, orders
        self.scratch, self.bits = Scratch(self.spark, "jaccard"), []
        bound_batches(self.spark)

    def run(self) -> DataFrame:
        """(id, n, root): a row for each document row; root is null where id is."""
        profile = self.scratch.save(
            self.docs.mapInArrow(tk.tidy(_profile(self.k)), "id long, n long, s1 long, s2 long, " + ", ".join(f"{b} long" for b in BITS) + ", slice int, counts binary"), "profile"
        )
        self.levels = self.spark.sparkContext.broadcast(common_levels(profile))
        rows = profile.where("slice is null").select("id", "n", "s1", "s2", *BITS)
        # every id of a class links to its smallest; a repeated id joins its classes
        classes = rows.where("n > 0 and id is not null").groupBy("s1", "s2").agg(F.min("id").alias("rep"), *[F.first(c).alias(c) for c in ("n", *BITS)])
        self.classes = self.scratch.save(classes, "classes")
        total = rows.agg(F.sum("n")).first()[0] or 0
        size = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        parts = max(size, total * (100 - self.percent) // 100 * ENTRY.itemsize // (48 << 20) + 1)
        hot = self.hot_tokens(total)
        run = _prefixes(self.k, self.percent, self.levels, 4 * parts, self.orders[0], hot)
        packed = self.docs.where("id is not null").select("text").mapInArrow(tk.tidy(run), "part int, entries binary")
        found = self.scratch.save(
            packed.repartition(parts, "part").mapInArrow(tk.tidy(_bucket_pairs(self.percent, hot)), "a long, b long, tok long, entries binary"), "buckets"
        )
        first = self.rep_pairs(found.where("tok is null").select("a", "b").distinct())
        first = self.scratch.save(first, "pairs-1")
        links = self.verify(first, "1")
        member = rows.where("id is not null and n > 0").select("id", "s1", "s2").join(self.classes.hint("merge"), ["s1", "s2"])
        copies = member.where("id > rep").select(F.col("id").alias("u"), F.col("rep").alias("v")).distinct()
        links = self.connect_large(found.where("tok is not null").select("tok", "entries"), links, first)
        root = components(links.unionByName(copies), self.scratch, "cc-all")
        self.scratch.keep_only("profile", "cc-all")
        return rows.join(root.select(F.col("node").alias("id"), "root").hint("merge"), "id", "left").select("id", "n", F.coalesce("root", "id").alias("root"))

    def hot_tokens(self, total: int) -> dict[int, int]:
        """Tokens that more than ``HOT`` prefixes hold, by a sample, and in how many buckets each goes.

        There can be no more of them than ``HOT`` goes into the prefixes' tokens.
        """
        if total < HOT:
            return {}
        some = self.docs.where((F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0) & F.col("text").isNotNull()).select("text")
        tokens = some.mapInArrow(_prefix_tokens(self.k, self.percent, self.levels, self.orders[0]), "tok long")
        found = tokens.groupBy("tok").agg(F.count("*").alias("n")).where(F.col("n") * SAMPLE > HOT).collect()
        return {r["tok"] % 2**64: -(-r["n"] * SAMPLE // HOT) for r in found}

    def rep_pairs(self, pairs: DataFrame) -> DataFrame:
        """Pairs of class keys as pairs (u, v) of class representatives, u < v."""
        c = self.classes
        ends = [c.select(F.col("s1").alias(e), F.col("rep").alias(f"r{e}"), F.col("n").alias(f"n{e}"), *[F.col(b).alias(f"{b}{e}") for b in BITS]) for e in ("a", "b")]
        both = pairs.join(ends[0].hint("merge"), "a").join(ends[1].hint("merge"), "b")
        both = both.where((F.col("ra") != F.col("rb")) & self._bits_reach(F.col("na"), F.col("nb"), [(F.col(f"{b}a"), F.col(f"{b}b")) for b in BITS]))
        return both.select(F.least("ra", "rb").alias("u"), F.greatest("ra", "rb").alias("v")).distinct()

    def _bits_reach(self, na: Column, nb: Column, bits: list[tuple[Column, Column]]) -> Column:
        """Whether sets may reach the threshold by the bits in which their bitmaps differ.

        Each stands for a token at least that only one set holds, so the
        intersection is at most half of what the sizes leave without them.
        """
        differ = reduce(lambda x, y: x + y, [F.bit_count(a.bitwiseXOR(b)) for a, b in bits])
        return (na + nb - differ) * (100 + self.percent) >= (na + nb) * 2 * self.percent

    def verify(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (u, v) whose sets reach the threshold; the filters of the other orders come first."""
        others = self.orders[1:]
        if others:
            met = self.with_sets(pairs, others).select("u", "v", "nu", "nv", "tu", "tv")
            pairs = self.scratch.save(met.mapInArrow(tk.tidy(_hopeful(self.percent, len(others))), "u long, v long"), f"hopeful-{name}")
        met = self.with_sets(pairs, None).select("u", "v", "tu", "tv")
        links = self.scratch.save(met.mapInArrow(tk.tidy(_verified(self.percent)), "u long, v long"), f"links-{name}")
        if others:
            self.scratch.drop(f"hopeful-{name}")
        while self.bits:  # what they filtered is written
            self.bits.pop().unpersist()
        return links

    def with_sets(self, pairs: DataFrame, orders: tuple[int, ...] | None) -> DataFrame:
        """The pairs with sizes and tokens (whole sets, or prefixes under ``orders``) of both ends."""
        ids = pairs.select(F.explode(F.array("u", "v")).alias("id"))
        self.bits.append(self.spark.sparkContext.broadcast(id_filter(ids)))
        bit = F.pmod(F.xxhash64("id"), F.lit(1 << BLOOM_LOG))
        sets = self.docs.where("id is not null").select("id", "text", bit.alias("bit")).mapInArrow(
            tk.tidy(_sets(self.k, self.percent, self.levels, self.bits[-1], orders)), "id long, size long, tokens binary"
        )
        u = sets.select(F.col("id").alias("u"), F.col("size").alias("nu"), F.col("tokens").alias("tu"))
        v = sets.select(F.col("id").alias("v"), F.col("size").alias("nv"), F.col("tokens").alias("tv"))
        return pairs.select("u", "v").join(u.hint("merge"), "u").join(v.hint("merge"), "v")

    def connect_large(self, buckets: DataFrame, links: DataFrame, known: DataFrame) -> DataFrame:
        """``links`` and what the large buckets add between different components.

        While many pairs of a bucket are still apart, rounds of some of them
        bring groups together.  The last round takes all that are then still
        apart, so nothing is missed.
        """
        if buckets.isEmpty():
            return links
        c = self.classes.select(F.col("s1").alias("set"), "rep", *BITS)
        rows = buckets.mapInArrow(_unpack, "tok long, set long, size long, rank long").join(c.hint("merge"), "set")
        entries = self.scratch.save(rows.select("tok", "rep", "size", "rank", *BITS), "entries")
        for step, share in enumerate(ROUNDS):
            root = components(links, self.scratch, f"cc-{step}").select(F.col("node").alias("rep"), "root")
            e = self.scratch.save(entries.join(root.hint("merge"), "rep", "left").withColumn("root", F.coalesce("root", "rep")), f"rooted-{step}")
            by_root = e.groupBy("tok", "root").agg(F.count("*").alias("n"))
            main = by_root.groupBy("tok").agg(
                F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n"), F.count("*").alias("roots")
            ).where("roots > 1")
            apart, total = main.agg(F.sum(F.expr("(n - n_main) * n")), F.sum("n")).first()
            if not apart:
                return links
            if apart <= PARTNERS * total:
                share = 1  # few enough to take all of them at once
            pairs = self.pairs_apart(e, main, share) if share else self.some_pairs(e.join(main.select("tok", "n").hint("merge"), "tok"), step)
            pairs = self.scratch.save(pairs.join(known.hint("merge"), ["u", "v"], "left_anti"), f"apart-{step}")
            self.scratch.drop(f"rooted-{step}")
            links = links.unionByName(self.verify(pairs, f"apart-{step}"))
            known = known.unionByName(pairs)
            if share == 1:
                return links
        return links

    def _may_reach(self, a: dict[str, Column], b: dict[str, Column]) -> Column:
        """Size, position and bitmap filters on two entries of one bucket."""
        t = self.percent
        rest = F.lit(1) + F.least(a["size"] - a["rank"] - 1, b["size"] - b["rank"] - 1)
        sizes = F.least(a["size"], b["size"]) * 100 >= F.greatest(a["size"], b["size"]) * t
        reach = rest * (100 + t) >= (a["size"] + b["size"]) * t
        return (a["root"] != b["root"]) & sizes & reach & self._bits_reach(a["size"], b["size"], [(a[x], b[x]) for x in BITS])

    def some_pairs(self, e: DataFrame, step: int) -> DataFrame:
        """A few pairs for each set: with those before it in a random order of each bucket, in runs of bounded size."""
        fields = ("rep", "root", "size", "rank", *BITS)
        place = F.xxhash64("rep", F.lit(step))
        run = F.pmod(place, F.floor(F.col("n") / RUN) + 1)
        w = Window.partitionBy("tok", run).orderBy(place, "rep")
        partners = F.array(*[F.lag(F.struct(*fields), i).over(w) for i in (1, 2)])
        met = e.withColumn("_partners", partners).select(*fields, F.explode("_partners").alias("p")).where("p is not null")
        met = met.where(self._may_reach({f: F.col(f) for f in fields}, {f: F.col(f"p.{f}") for f in fields}))
        pairs = met.select(F.least("rep", "p.rep").alias("u"), F.greatest("rep", "p.rep").alias("v")).distinct()
        few = Window.partitionBy("u").orderBy(F.xxhash64("v", F.lit(step)), "v")
        return pairs.withColumn("_rn", F.row_number().over(few)).where(F.col("_rn") <= NEIGHBOURS).drop("_rn")

    def pairs_apart(self, e: DataFrame, main: DataFrame, share: int) -> DataFrame:
        """Pairs of a bucket in different components: those outside its largest with all others.

        One in ``share`` of the pairs, by a hash of both; all of them for 1.
        """
        met = e.join(main.select("tok", "main").hint("merge"), "tok")
        x = met.where("root <> main").select("tok", *[F.col(f).alias(f"{f}_x") for f in ("rep", "root", "size", "rank", *BITS)])
        y = met.select("tok", "main", *[F.col(f).alias(f"{f}_y") for f in ("rep", "root", "size", "rank", *BITS)])
        names = ("root", "size", "rank", *BITS)
        once = (F.col("root_y") == F.col("main")) | (F.col("rep_x") < F.col("rep_y"))
        if share > 1:
            low, high = F.least("rep_x", "rep_y"), F.greatest("rep_x", "rep_y")
            once = once & (F.pmod(F.xxhash64(low, high), F.lit(share)) == 0)
        found = x.join(y.hint("merge"), "tok").where(once & self._may_reach({f: F.col(f"{f}_x") for f in names}, {f: F.col(f"{f}_y") for f in names}))
        return found.select(F.least("rep_x", "rep_y").alias("u"), F.greatest("rep_x", "rep_y").alias("v")).distinct()


def jaccard_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = SHINGLE,
    percent: int = PERCENT,
    orders: tuple[int, ...] = ORDERS,
) -> DataFrame:
    """(id_col, n_shingles, component_id) for every row of ``docs``."""
    out = JaccardJoin(docs, id_col, text_col, k, percent, orders).run()
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("root").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with only the smallest id of each component; rows with null ids stay."""
    found = jaccard_components(docs, id_col, text_col)
    gone = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_q_gone")).distinct()
    return docs.join(gone.hint("merge"), docs[id_col] == gone["_q_gone"], "left_anti")
