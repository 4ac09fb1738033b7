"""Kernels and text sources against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.operators import alignment, geometry
from loomwork.sources import text


def plain_rmsd(p, t):
    p, t = p - p.mean(0), t - t.mean(0)
    u, _, v = np.linalg.svd(p.T @ t)
    turn = u @ np.diag([1, 1, np.sign(np.linalg.det(u @ v))]) @ v
    return np.sqrt(((p @ turn - t) ** 2).sum() / len(p))


def test_rmsd_equals_svd(spark):
    rng = np.random.default_rng(3)
    p = rng.normal(size=(6, 9, 3))
    t = rng.normal(size=(6, 9, 3))
    t[1] = p[1] * [1, 1, -1]  # a mirror image may not be matched by a reflection
    spin = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    t[2] = p[2] @ (spin * np.linalg.det(spin)) + 4
    rows = lambda x: spark.createDataFrame([(k, i, *map(float, x[k, i])) for k in range(6) for i in range(9)], "k int, i int, x double, y double, z double")
    got = {r["k"]: r["rmsd"] for r in geometry.superposed_rmsd(rows(p), rows(t), "k").collect()}
    for k in range(6):
        assert got[k] == pytest.approx(plain_rmsd(p[k], t[k]), abs=1e-5)


def test_alignment_edge_cases(spark):
    df = spark.createDataFrame([(1, "ACD-E", "AcdCD-Exx"), (2, "", ""), (3, None, None)], "k int, q string, r string")
    got = {r["k"]: r for r in df.select("k", alignment.aligned(F.col("r")).alias("a"), alignment.insertions(F.col("r")).alias("n"), alignment.index_pairs(F.col("q"), F.col("q")).alias("p")).collect()}
    assert got[1]["a"] == "ACD-E" and got[1]["n"] == [0, 2, 0, 0, 0] and [tuple(x) for x in got[1]["p"]] == [(i, i) for i in range(4)]
    assert got[2]["a"] == "" and got[2]["n"] == [] and got[2]["p"] == []
    assert got[3]["a"] is None and got[3]["n"] is None
    none = alignment.projection_stats(df, "k", "q", "q").where("k = 2").first()
    assert tuple(none) == (2, 0, 0.0, 0.0, 0.0)


def test_text_sources(spark, tmp_path):
    (tmp_path / "ids").write_text("# head\n a \n\nb # why\na\n")
    assert sorted(r["id"] for r in text.id_list(spark, f"{tmp_path}/ids", True).collect()) == ["a", "a", "b"]
    assert [tuple(r) for r in text.repeated(text.id_list(spark, f"{tmp_path}/ids", True)).collect()] == [("a", 2)]
    (tmp_path / "o.json").write_text('{"x": {"n": 1},\n "y": {"n": null}}')
    assert {r["key"]: r["value"]["n"] for r in text.json_object(spark, f"{tmp_path}/o.json", "struct<n:int>").collect()} == {"x": 1, "y": None}
    (tmp_path / "c.tsv").write_text("a\tb\nlonely\n")
    assert [tuple(r) for r in text.cluster_table(spark, f"{tmp_path}/c.tsv").collect()] == [("a", "b")]
    (tmp_path / "f.a3m").write_text(">one first\nAC\nDe\n>two\nGG\n>three\n")
    assert sorted((r["name"], r["sequence"]) for r in text.records(spark, f"{tmp_path}/f.a3m").collect()) == [("one", "ACDe"), ("three", ""), ("two", "GG")]
    text.write_ids(spark.createDataFrame([("b",), ("a",), ("b",)], "id string"), f"{tmp_path}/out")
    assert sorted(r["value"] for r in spark.read.text(f"{tmp_path}/out").collect()) == ["a", "b"]
