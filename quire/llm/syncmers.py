"""Document fingerprints from closed syncmers, compared by position.

A k-mer of code points is a closed syncmer if the smallest of the hashed
s-mers inside it is its first or its last one.  Whether a k-mer is chosen
depends on nothing outside it, so two texts that share a passage choose the
same anchors in it.  The fingerprint is all anchors of the text, each with its
64-bit hash and position, however long the text; one that holds no closed syncmer
(at most a few code points more than a k-mer) is one anchor of its own.  Two fingerprints are compared over all anchors: the longest
chain of common anchors in the order of both texts, as a share of the anchors of
both (those of the chain counted once).

A fingerprint is written as base85 (RFC 1924's signs, as ``base64.b85encode``) of
its anchors in the order of the text: their number (4 bytes), their hashes (8
bytes each), then 3 bits for each with how far its position lies beyond the one
before (from 0), filled up to whole bytes.  A step of 7 or more, which closed
syncmers don't leave between them, is 7 there, and its 4 bytes follow after the
steps.  Zeros fill the last 4 bytes.  All numbers have their lowest byte first,
the steps their highest bit; nothing stands for no anchors.

Defined results: null text is empty; an empty text has an empty fingerprint,
which equals another empty one (likeness 1) and is unlike any other (0); equal
texts have equal fingerprints; rows are ordered by descending id, then text,
nulls last, so repeated ids follow one another; the next row after the last is
the first, and a single row is its own next.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import textkit as tk
from quire.llm.scratch import bound_batches

K, S = 10, 4
ROWS_PER_BUCKET = 2000
MAX_BUCKETS = 1 << 16
BUCKETS_PER_TASK = 16
OUT_BYTES = 4 << 20  # of fingerprints in one batch
MANY = 8  # pairs for each anchor, beyond which bits are used
FAR = 7  # a step that is written in 4 bytes
_STEP = 0x9E3779B97F4A7C15
_SIGNS = np.frombuffer(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz!#$%&()*+-;<=>?@^_`{|}~", np.uint8)
_TWO_SIGNS = np.stack([np.repeat(_SIGNS, 85), np.tile(_SIGNS, 85)], 1)
_SIGN_VALUES = np.zeros(128, np.uint32)
_SIGN_VALUES[_SIGNS] = np.arange(85)


def _rolling(codes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` code points, built from runs of powers of two."""
    done, total, power, width = 0, None, codes.astype(np.uint64), 1
    bits = size
    while bits:
        if bits & 1:
            n = len(codes) - done - width + 1
            if total is None:
                total = power.copy()
            else:
                total = total[:n] * np.uint64(pow(_STEP, width, 2**64)) + power[done : done + n]
            done += width
        bits >>= 1
        if bits:
            power = power[:-width] * np.uint64(pow(_STEP, width, 2**64)) + power[width:]
            width *= 2
    return total[: len(codes) - size + 1]


def _window_min(x: np.ndarray, size: int) -> np.ndarray:
    """Smallest of each run of ``size`` values."""
    held, width = x, 1
    while width * 2 <= size:
        held = np.minimum(held[:-width], held[width:])
        width *= 2
    n = len(x) - size + 1
    return np.minimum(held[:n], held[size - width : size - width + n])


def anchors(codes: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the closed syncmers of a text as code points."""
    n = len(codes)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n >= k:
        small = tk.mix(_rolling(codes, s), 32)
        low = _window_min(small, k - s + 1)
        m = n - k + 1
        at = np.flatnonzero((small[:m] == low) | (small[k - s : k - s + m] == low))
        if len(at):
            return tk.mix(_rolling(codes, k)[at], 33 + k), at
    return tk.mix(_rolling(codes, n) + np.uint64(n), 31), np.zeros(1, np.int64)


def _written(raw: bytes) -> str:
    """Bytes in fours as base85, two signs at a time."""
    rest = np.frombuffer(raw, ">u4").astype(np.uint32)
    out = np.empty((len(rest), 5), np.uint8)
    tens = rest // 85
    out[:, 4] = _SIGNS[rest - tens * 85]
    high = tens // 7225
    out[:, 2:4] = _TWO_SIGNS[tens - high * 7225]
    out[:, :2] = _TWO_SIGNS[high]
    return out.tobytes().decode("ascii")


def _read(text: str) -> bytes:
    signs = _SIGN_VALUES[np.frombuffer(text.encode("ascii"), np.uint8)].reshape(-1, 5)
    total = signs[:, 0]
    for i in range(1, 5):
        total = total * np.uint32(85) + signs[:, i]
    return total.astype(">u4").tobytes()


class Fingerprint:
    """All anchors of a text, hashes and positions, in the order of the text."""

    def __init__(self, hashes: np.ndarray, at: np.ndarray):
        by = np.argsort(at, kind="stable")
        self.values, self.at = hashes[by], at[by]

    def __str__(self) -> str:
        if not len(self.values):
            return ""
        steps = np.diff(self.at, prepend=0)
        far = steps[steps >= FAR].astype("<u4").tobytes()
        bits = np.unpackbits(np.minimum(steps, FAR).astype(np.uint8)[:, None], axis=1)[:, 5:]
        packed = b"".join((np.array([len(steps)], "<u4").tobytes(), self.values.astype("<u8").tobytes(), np.packbits(bits).tobytes(), far))
        return _written(packed + bytes(-len(packed) % 4))


def unpacked(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of a written fingerprint."""
    if not fingerprint:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    raw = _read(fingerprint)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    size = -(-3 * n // 8)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8, size, 4 + 8 * n), count=3 * n).reshape(n, 3)
    steps = bits @ np.array([4, 2, 1], np.int64)
    far = steps == FAR
    steps[far] = np.frombuffer(raw, "<u4", int(far.sum()), 4 + 8 * n + size)
    return np.frombuffer(raw, "<u8", n, 4), np.cumsum(steps)


def fingerprint(codes: np.ndarray) -> Fingerprint:
    return Fingerprint(*anchors(codes))


def _same_ends(a: np.ndarray, b: np.ndarray) -> int:
    """How many values at the start of both are equal."""
    n = min(len(a), len(b))
    other = np.flatnonzero(a[:n] != b[:n])
    return int(other[0]) if len(other) else n


def longest_chain(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of two rows of hashes."""
    head = _same_ends(a, b)
    a, b = a[head:], b[head:]
    tail = _same_ends(a[::-1], b[::-1])
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    by = np.argsort(b, kind="stable")
    ordered = b[by]
    low, high = np.searchsorted(ordered, a, "left"), np.searchsorted(ordered, a, "right")
    met = high > low
    low, high = low[met], high[met]
    sizes = high - low
    total = int(sizes.sum())
    if total > MANY * (len(a) + len(b)):
        return head + tail + _chain_by_bits(a[met].tolist(), b.tolist())
    # for each anchor of a its places in b from the last to the first, so that none is taken twice
    within = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    tails: list[int] = []
    for p in by[np.repeat(high, sizes) - 1 - within].tolist():
        if not tails or p > tails[-1]:
            tails.append(p)
        else:
            tails[bisect.bisect_left(tails, p)] = p
    return head + tail + len(tails)


def _chain_by_bits(a: list[int], b: list[int]) -> int:
    """The same for texts that repeat themselves: a bit for each value of ``a``."""
    places: dict[int, int] = {}
    at: dict[int, list[int]] = {}
    for i, x in enumerate(a):
        at.setdefault(x, []).append(i)
    for x, spots in at.items():
        bits = bytearray(len(a) // 8 + 1)
        for i in spots:
            bits[i >> 3] |= 1 << (i & 7)
        places[x] = int.from_bytes(bits, "little")
    every = (1 << len(a)) - 1
    free = every
    for x in b:
        hit = free & places.get(x, 0)
        if hit:
            free = ((free + hit) | (free - hit)) & every
    return len(a) - free.bit_count()


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """Share of the anchors of both that lie on the longest common chain."""
    if not len(a.values) or not len(b.values):
        return float(len(a.values) == len(b.values))
    chain = longest_chain(a.values, b.values)
    return chain / (len(a.values) + len(b.values) - chain)


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)


def edited(codes: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The last third replaced by as much (or all) of the following text's start."""
    third = len(codes) // 3
    return np.concatenate([codes[: len(codes) - third], following[:third]])


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many of the descending bounds lie above the key: coarse steps, then fine ones."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    whole = F.array(*[F.lit(b) for b in bounds]) if len(bounds) <= 64 else F.from_json(F.lit(str(bounds)), "array<bigint>")
    coarse = F.from_json(F.lit(str(bounds[step - 1 :: step])), "array<bigint>")
    passed = F.size(F.filter(coarse, lambda b: b > key)) * step
    return passed + F.size(F.filter(F.slice(whole, passed + 1, F.lit(step)), lambda b: b > key))


def ordered_buckets(docs: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> tuple[DataFrame, int]:
    """(bucket, extra, id, text) so that each bucket, sorted, is a run of all rows by descending id; how many.

    Row counts and bounds come from the ids alone; bounds number at most
    ``MAX_BUCKETS``.  The first row of each bucket is also dealt, as ``extra``,
    to the bucket before it, so every row meets its successor in one task and
    the texts are shuffled once.
    """
    key = F.coalesce(F.col("id"), F.lit(-(2**63)))
    rows = docs.select(key.alias("key"))
    total = rows.count()
    n = max(1, min(MAX_BUCKETS, total // rows_per_bucket))
    bounds: list[int] = []
    if n > 1:
        cuts = [i / n for i in range(1, n)]
        found = rows.agg(F.percentile_approx("key", cuts, max(10_000, 4 * n)).alias("q")).first()["q"]
        bounds = sorted({int(x) for x in found}, reverse=True)
    placed = docs.withColumn("bucket", _bucket(key, bounds))
    # a row at or above a bound is in the bucket before it
    heads = placed.groupBy("bucket").agg(F.max(key).alias("key")).orderBy("bucket").collect()
    before = {heads[i]["key"]: heads[i - 1]["bucket"] for i in range(1, len(heads))}
    if heads:
        before_first = heads[-1]["bucket"]
        first_key = heads[0]["key"]
    else:
        before_first, first_key = 0, None
    copies = [(k, b, 1) for k, b in before.items()] + ([(first_key, before_first, 2)] if heads else [])
    head = docs.sparkSession.createDataFrame(copies, "hk long, hb int, ek int")
    dealt = placed.join(F.broadcast(head.groupBy("hk").agg(F.collect_list(F.struct("hb", "ek")).alias("h"))), key == F.col("hk"), "left")
    own = F.array(F.struct(F.col("bucket").alias("hb"), F.lit(0).alias("ek")))
    out = dealt.select("id", "text", F.explode(F.concat(own, F.coalesce(F.col("h"), F.array().cast("array<struct<hb:int,ek:int>>")))).alias("d")).select(
        F.col("d.hb").alias("bucket"), F.col("d.ek").alias("extra"), "id", "text"
    )
    return out, len(bounds) + 1


_OUT = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), _TYPES)] if rows else [pa.array([], t) for t in _TYPES], _NAMES)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with the row that follows it in its bucket; ``extra`` rows only follow."""
    last: tuple | None = None
    for batch in batches:
        out: list[tuple] = []
        held = 0
        buckets, extras, ids = (batch.column(i).to_pylist() for i in range(3))
        for i in range(len(ids)):
            codes = code_points(batch.column(3)[i].as_py())
            row = (buckets[i], extras[i], ids[i], codes, fingerprint(codes))
            if last is not None and last[0] == row[0] and not last[1]:
                out.append(_compare(last, row))
                held += len(out[-1][3]) + len(out[-1][4])
                if held > OUT_BYTES:
                    yield _batch(out)
                    out, held = [], 0
            last = row
        yield _batch(out)


_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _compare(row: tuple, following: tuple) -> tuple:
    _, _, key, codes, own = row
    changed = edited(codes, following[3])
    other = fingerprint(changed)
    digest = hashlib.sha256(changed.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest()
    return key, len(codes), digest, str(own), str(other), likeness(own, other), likeness(own, following[4])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of each text, of its edited text, and likeness to that and to the next."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bound_batches(docs.sparkSession)
    placed, buckets = ordered_buckets(rows)
    # neighbouring buckets share a task, and the number of tasks follows that of the rows
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-buckets // BUCKETS_PER_TASK))
    task = F.floor(F.col("bucket") * F.lit(parts) / F.lit(buckets)).cast("int")
    run = placed.repartitionById(parts, task).sortWithinPartitions("bucket", "extra", F.desc_nulls_last("id"), "text")
    return run.mapInArrow(tk.tidy(_pairs), _OUT).withColumnRenamed("id", id_col)
