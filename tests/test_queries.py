"""Every registered query against its SQL, on the smallest shared tables."""

import math

import duckdb
import pytest

from quire.queries import load

QUERIES = load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    fn, sql = QUERIES[name]
    df = fn(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    assert got
    if sql is None:
        return
    res = duck.sql(sql)
    assert sorted(res.columns) == names
    at = [res.columns.index(c) for c in names]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in res.fetchall()), key=repr)


@pytest.mark.parametrize("flags", ["ANR", "RNA", "NRA"])
def test_tied_lines_have_one_order(spark, tmp_path, flags):
    """Lines that agree in all keys of an order come out the same, however they are stored."""
    spark.createDataFrame([(1, 7)], "o_orderkey long, o_custkey long").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(1, 2, 5, f, "O") for f in flags]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string, l_linestatus string").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = QUERIES["agg_group_by_scene_field"][0](spark, str(tmp_path)).collect()
    assert [r["values"] for r in rows] == ["R|N|A"]


def test_chapters_without_occurrences(spark, tmp_path):
    """Orders without lines make no chapter, orders of unknown customers do; customers without orders declare nothing."""
    con = duckdb.connect()
    made = {
        "customer": ("c_custkey long", [(1,), (2,), (3,)]),
        "orders": ("o_orderkey long, o_custkey long", [(10, 1), (11, 1), (20, 2), (90, 9)]),
        "lineitem": ("l_orderkey long, l_suppkey long", [(10, 5), (10, 5), (11, 5), (11, 6), (90, 5)]),
    }
    for name, (schema, rows) in made.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    fn, sql = QUERIES["agg_occurrences_by_chapter"]
    got = sorted(tuple(r) for r in fn(spark, str(tmp_path)).select("chapter_id", "entity_count", "occurrence_count").collect())
    assert got == sorted(con.sql(sql).fetchall()) == [(1, 2, 3), (3, 0, 0), (9, 1, 1)]


def test_chapters_stay_dealt(spark, sf_dir):
    """Small shuffled bytes don't merge the tasks that sort a chapter's references several times."""
    out = QUERIES["agg_group_by_scene_field"][0](spark, sf_dir)
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
