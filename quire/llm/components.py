"""Connected components of a graph held as a DataFrame of links.

Each round first contracts the links of every partition to a forest of stars,
then, where stars of different partitions meet, runs a large-star and a
small-star step.  The number of rounds follows the logarithm of the longest
path; no link, node or label is ever brought to the driver.  Once the links left
number at most ``LOCAL_LINKS``, one task contracts them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.scratch import Scratch

MAX_ROUNDS = 60
#: So many links (16 bytes each) are contracted in one task at once.
LOCAL_LINKS = 2_000_000


def local_roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node each can reach) of a list of links."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    label = np.arange(len(nodes))
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        for end in (a, b):
            np.minimum.at(label, label[end], low)
            np.minimum.at(label, end, low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
        if (label == before).all():
            break
    return nodes, nodes[label]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
    if not held:
        return
    nodes, roots = local_roots(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
    keep = nodes != roots
    yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(roots[keep])], ["u", "v"])


def components(links: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, root) of every node of ``links`` (columns u, v, long) that isn't its own root."""
    edges = links
    for step in range(MAX_ROUNDS):
        if edges.count() <= LOCAL_LINKS:
            # a fixed bound, not a share of the data: what is left fits one task
            return scratch.save(edges.coalesce(1).mapInArrow(_stars, "u long, v long"), f"{name}-last").select(F.col("u").alias("node"), F.col("v").alias("root"))
        # u is the larger end: every star points down to its root
        stars = scratch.save(edges.mapInArrow(_stars, "u long, v long").dropDuplicates(["u", "v"]), f"{name}-{step}")
        twice = stars.groupBy("u").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo < hi")
        chained = stars.join(stars.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
        if twice.isEmpty() and chained.isEmpty():
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges = scratch.save(_small_star(_large_star(stars)), f"{name}-{step}-edges")
    raise RuntimeError(f"links did not contract in {MAX_ROUNDS} rounds")


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node move to the smallest of its neighbours and itself."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
    moved = both.join(low, both["u"] == low["n"]).where("v > u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and itself, move to the smallest of them."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low.select(F.col("u").alias("n"), "m"), edges["u"] == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
