"""Global places, tiles, line numbers and tree digests."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from loomwork.operators import digests, ordering


def test_places_with_ties_and_nulls(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 2, 3, *([2] * 10)]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "v int, _x int").repartition(7)
    out = ordering.placed(df, [F.col("v").asc_nulls_first()], "pos", "total", ranges=5).collect()
    assert sorted(r["pos"] for r in out) == list(range(500)) and {r["total"] for r in out} == {500}
    assert [r["v"] or 0 for r in sorted(out, key=lambda r: r["pos"])] == sorted(v or 0 for v, _ in rows)
    assert ordering.placed(df.limit(0), [F.col("v")]).count() == 0


@pytest.mark.parametrize("n", [0, 3, 10, 23])
def test_tiles(spark, n):
    df = spark.range(n)
    got = {r["id"]: r["tile"] for r in ordering.tiled(df, [F.col("id")], 10).collect()}
    want = [t for t in range(1, 11) for _ in range(n // 10 + (t <= n % 10))]
    assert [got[i] for i in range(n)] == want


def test_line_numbers_over_splits(spark, tmp_path):
    for name, n in (("a", 400), ("b", 1), ("c", 0), ("d", 150)):
        (tmp_path / name).write_text("".join(f"{name} {'x' * (i % 90)} {i}\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = ordering.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert len(got) == 551 and all(r["value"].endswith(f" {r['line']}") and f"/{r['value'][0]}" in r["file"] for r in got)


FIELDS = ["k", "v"]


def plain_root(rows, digits):
    level = {}
    part = lambda x: "-" if x is None else f"{len(str(x))}:{x}"
    named = [hashlib.sha256(",".join(map(part, r)).encode()).hexdigest() for r in rows]
    for d in set(named):
        level.setdefault(d[:digits], []).append(f"{d}\t{named.count(d)}\n")
    for k in range(digits, -1, -1):
        level = {p: hashlib.sha256("".join(sorted(x)).encode()).hexdigest() for p, x in level.items()}
        if k:
            up = {}
            for p, d in level.items():
                up.setdefault(p[: k - 1], []).append(f"{p}\t{d}\n")
            level = up
    return level.get("")


def test_tree_digests(spark):
    rows = [("a", "1"), ("a", "1"), ("b", None), ("b", ""), (None, "x"), ("c,1", "2"), *((str(i), "y") for i in range(60))]
    df = lambda r: spark.createDataFrame(r, "k string, v string")
    one = digests.root(df(rows), FIELDS, digits=2).first()
    assert one["n"] == len(rows) and one["digest"] == plain_root(rows, 2)
    assert digests.root(df(rows[::-1]).repartition(5), FIELDS, digits=2).first()["digest"] == one["digest"]
    for other in (rows[1:], [*rows, ("a", "1")], [("c", "1,2") if r[0] == "c,1" else r for r in rows], [("b", "") if r[1] is None else r for r in rows]):
        assert digests.root(df(other), FIELDS, digits=2).first()["digest"] != one["digest"]
    found = digests.changed(*(digests.buckets(df(r), FIELDS, digits=2) for r in (rows, rows[1:]))).collect()
    assert len(found) == 1 and found[0]["n_a"] - found[0]["n_b"] == 1
    got = {(r["k"], r["v"]): (r["n_a"], r["n_b"]) for r in digests.changed_rows(df(rows), df([*rows[1:], (None, None)]), FIELDS, 2).collect()}
    assert got == {("a", "1"): (2, 1), (None, None): (0, 1)}
    assert digests.root(df(rows).limit(0), FIELDS).count() == 0


def test_split_locks(spark):
    records = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (9, "z")], "k int, v string")
    wanted = spark.createDataFrame([("t", 1), ("t", 2), ("t", 2), ("v", 3), ("v", 7), ("e", 8), ("v", None)], "split string, k int")
    got = {r["split"]: r for r in digests.split_lock(records, wanted, "split", "k", ["v"]).collect()}
    assert [(got[s]["n"], got[s]["n_missing"]) for s in "tve"] == [(2, 0), (2, 1), (1, 1)] and got["e"]["digest"] is None
    changed = records.withColumn("v", F.when(F.col("k") == 3, "C").otherwise(F.col("v")))
    after = {r["split"]: r["digest"] for r in digests.split_lock(changed, wanted, "split", "k", ["v"]).collect()}
    assert after["t"] == got["t"]["digest"] and after["v"] != got["v"]["digest"]
