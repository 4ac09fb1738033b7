"""Every registered query of the catalogue against its DuckDB form on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from loomwork.operators import curves, relational
from loomwork.plans import catalogue

DATA = "/root/testdata/sf0.001"


def norm(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else format(v + 0.0, ".6g")
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    found = duck.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted("|".join(norm(dict(zip(columns, r))[c]) for c in sorted(columns)) for r in found.fetchall())
    assert sorted("|".join(norm(r[c]) for c in sorted(columns)) for r in df.collect()) == want


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nan_ranks_last_and_single_point_is_its_own_area(spark):
    rows = spark.createDataFrame([("t", float("nan"), 1.0, "a"), ("t", -5.0, 0.0, "b")], "track string, score double, tb double, date string")
    assert [r["date"] for r in curves.ranked(rows, "track", "score", "tb", "date").orderBy("rank").collect()] == ["b", "a"]
    one = spark.createDataFrame([("g", 3.0, 0.7)], "g string, x double, y double")
    assert curves.auc(one, "g", "x", "y", 100.0).first()["auc"] == 0.7


def test_allocation_is_capped_and_whole(spark):
    s = spark.createDataFrame([("a", 1), ("b", 10), ("c", 89)], "k string, n long")
    got = {r["k"]: r["alloc"] for r in relational.allocate(s, 50, "k").collect()}
    assert sum(got.values()) == 50 and got["a"] <= 1


def test_completeness_has_all_pairs_of_many_event_types(spark, tmp_path):
    rows = [(i, f"type {i % 1200}", i % 3 or None) for i in range(1500)]
    spark.createDataFrame(rows, "event_id long, event_type string, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    got = catalogue.QUERIES["completeness_cross_join"](spark, str(tmp_path)).collect()
    want = duckdb.connect().execute(catalogue.ORACLES["completeness_cross_join"].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'").replace("JOIN events", f"JOIN '{tmp_path}/events.parquet/*.parquet'")).fetchall()
    assert len(got) == 3600 and sorted(map(str, want)) == sorted(str((r["event_type"], r["user_id"], r["n"])) for r in got)
