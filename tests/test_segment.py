import pytest
from pyspark.sql import functions as F

from quire.operators import pack, segment
from quire.plans.compile import support_paragraphs


def chapter(spark, n, blocks=None):
    rows = [("ch-0001", f"p-{i:03d}", i, (blocks or {}).get(i, i), "x" * 40) for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "chapter_id string, id string, ordinal int, block_ordinal int, text string")


def sizes(spark, n, breaks=(), blocks=None, **how):
    b = spark.createDataFrame([("ch-0001", x) for x in breaks], "chapter_id string, ordinal int")
    out = segment.detect(chapter(spark, n, blocks), b, mode="paragraph-count", **how)
    return [r["paragraph_count"] for r in out.orderBy("ordinal").collect()]


@pytest.mark.parametrize(
    "n,breaks,how,want",
    [(25, (), {}, [7, 6, 6, 6]), (25, (), {"max_paragraphs": 24}, [13, 12]), (8, (5,), {"target": 4}, [2, 2, 2, 2]), (7, (), {"target": 4}, [3, 2, 2]), (1, (), {}, [1]), (0, (), {}, [])],
)
def test_counts(spark, n, breaks, how, want):
    assert sizes(spark, n, breaks, **how) == want


def test_break_ordinals_count_all_blocks(spark):
    # p1 p2 *** p3 *** p4: breaks are blocks 3 and 5
    p = chapter(spark, 4, {1: 1, 2: 2, 3: 4, 4: 6})
    b = spark.createDataFrame([("ch-0001", 3), ("ch-0001", 5)], "chapter_id string, ordinal int")
    assert {r["id"] for r in segment.explicit_breaks(p, b).collect()} == {"p-002", "p-003"}
    assert {r["id"] for r in segment.explicit_breaks(p, b, legacy_ordinals=True).collect()} == {"p-002", "p-004"}


def test_unknown_proposals_reject_a_chapter(spark):
    p = chapter(spark, 6)
    proposed = spark.createDataFrame([("ch-0001", "p-002"), ("ch-0001", "p-999")], "chapter_id string, id string")
    assert segment.accepted_proposals(p, proposed).count() == 0


@pytest.mark.parametrize(
    "rows,problem",
    [
        ([(1, 1, 2), (2, 3, 3)], "missing tail"),
        ([(1, 1, 1), (2, 3, 4)], "gap or overlap"),
        ([(1, 1, 2), (3, 3, 4)], "ordinal gap"),
        ([(2, 1, 4)], "ordinal gap"),
        ([(1, 1, 2), (2, 2, 4)], "gap or overlap"),
    ],
)
def test_partition_violations(spark, rows, problem):
    s = spark.createDataFrame([("ch-0001", o, f"p-{a:03d}", f"p-{b:03d}") for o, a, b in rows], "chapter_id string, ordinal int, paragraph_start string, paragraph_end string")
    assert problem in {r["problem"] for r in segment.partition_violations(s, chapter(spark, 4)).collect()}


def greedy(counts, target, overlap):
    out, start = [], 0
    while start < len(counts):
        end, total = start, 0
        while end < len(counts) and (end == start or total + counts[end] <= target):
            total += counts[end]
            end += 1
        out.append((start + 1, end))
        if end == len(counts):
            break
        start = max(end - overlap, start + 1)
    return out


@pytest.mark.parametrize("overlap", [0, 1, 3])
def test_token_windows(spark, overlap):
    texts = [4, 90, 8, 8, 400, 4, 4, 4, 80, 80, 4]
    rows = [("c", i, "x" * n) for i, n in enumerate(texts)]
    p = spark.createDataFrame(rows, "chapter_id string, ordinal int, text string")
    got = segment.token_windows(p, 25, overlap).orderBy("window").collect()
    assert [(r["first"], r["last"]) for r in got] == greedy([max(1, n // 4) for n in texts], 25, overlap)


@pytest.mark.parametrize("n,k", [(5, 12), (30, 12), (13, 12), (100, 7), (9, 2), (9, 1)])
def test_spread(spark, n, k):
    df = spark.range(n).select(F.lit(1).alias("g"), F.col("id"))
    got = sorted(r["id"] for r in pack.spread(df, ["g"], [F.col("id")], k).collect())
    even = [0] if k == 1 else sorted({int(i * (n - 1) / (k - 1) + 0.5) for i in range(k)})
    assert got == (list(range(n)) if n <= k else even)


def test_support():
    assert support_paragraphs([["a", "b"], ["b", "c"]], [["b"], ["b"]]) == ["b", "c"]
    assert support_paragraphs([["a", "b", "c", "d"]], [["d", "c", "b", "a"]]) == ["d", "c", "b"]
