"""Sinks that are taken up again, failures as rows, projections and quantiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.operators import projections as P
from loomwork.sources import steps


def test_a_killed_run_and_its_resumption(spark, tmp_path):
    folder = f"file://{tmp_path}/sink"
    rows = lambda s, n=3: spark.createDataFrame([(s * 10 + i, "x") for i in range(n)] + [(s, "same")] * 2, "k int, v string")
    assert steps.read(spark, folder, "k int, v string").count() == 0 and steps.steps(folder) == []
    assert steps.append(rows(1), folder, 1) and steps.append(rows(2), folder, 2)
    rows(3).write.parquet(f"{folder}/data/{3:012d}-{'0' * 32}")  # killed before its record
    (tmp_path / "sink" / "commits" / f"{3:012d}.tmp").write_text("{")
    assert steps.steps(folder) == [1, 2] and not steps.append(rows(2, 1), folder, 2)
    assert steps.append(rows(3), folder, 3) and steps.append(rows(4), folder, 4)
    assert steps.cut_back(folder, 2) == 2 and steps.append(rows(3, 1), folder, 3)
    got = sorted((r["step"], r["k"], r["v"]) for r in steps.read(spark, folder, "k int, v string").collect())
    assert got == sorted([(s, s * 10 + i, "x") for s, n in ((1, 3), (2, 3), (3, 1)) for i in range(n)] + [(s, s, "same") for s in (1, 2, 3)] * 2)


def test_lines_up_to_a_step(spark):
    lines = ['{"step": 3, "x": 1}', '{"step": 4}', '{"step": 5}', '{"step": "7"}', "", "  ", "no json", '{"x": 1}', '{"step": null}', "[1]", '{"step": 4.9}', '{"step": "x"}']
    got = [r["value"] for r in steps.lines_up_to(spark.createDataFrame([(x,) for x in lines], "value string"), 4).collect()]
    assert got == [x for x in lines if x.strip() and x not in ('{"step": 5}', '{"step": "7"}')]


def test_failures_are_rows(spark):
    def work(row):
        if row["n"] == 0:
            raise ZeroDivisionError("no\nmore")
        return {"half": row["n"] / 2}

    rows = spark.createDataFrame([("a", 1, 2.0), ("b", 1, 0.0), ("b", 2, 4.0), ("c", 1, 0.0), (None, 1, 0.0)], "k string, turn int, n double")
    got = steps.attempted(rows, work, "k", "half double")
    fault = "ZeroDivisionError: no"
    want = [("a", 1.0, None), ("b", None, fault), ("b", 2.0, None), ("c", None, fault), (None, None, fault)]
    assert sorted(str((r["k"], r["value"] and r["value"]["half"], r["error"])) for r in got.collect()) == sorted(map(str, want))
    left = steps.outstanding(got.withColumn("t", F.lit(1)), "k", F.col("t")).collect()
    assert sorted(str(r["k"]) for r in left) == ["None", "c"]


@pytest.mark.parametrize("parts", [1, 7])
def test_directions(spark, parts):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (200, 6)) * [5, 3, 2, 1, 0.5, 0.1] @ np.linalg.qr(rng.normal(0, 1, (6, 6)))[0] + 1e3
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(200, None), (201, [1.0]), (202, [float("nan")] * 6), (203, [None] * 6)]
    out = P.projected(spark.createDataFrame(rows, "i int, v array<double>").repartition(parts), "v", ["a", "b"], 6).collect()
    c = x - x.mean(0)
    u, s, vt = np.linalg.svd(c, full_matrices=False)
    vt *= np.where(np.take_along_axis(vt, np.abs(vt).argmax(1)[:, None], 1) < 0, -1, 1)
    want = c @ vt[:2].T
    assert all(np.allclose([r["a"], r["b"]], want[r["i"]], atol=1e-6) for r in out if r["i"] < 200)
    assert all(r["a"] is None for r in out if r["i"] >= 200)
    with pytest.raises(ValueError):
        P.directions(spark.createDataFrame(rows[:1], "i int, v array<double>"), "v", 2, 6)


def test_quantiles(spark, monkeypatch):
    rng = np.random.default_rng(8)
    sets = {"normal": rng.normal(0, 1, 400), "ties": rng.integers(0, 3, 300).astype(float), "one": np.array([5.0]), "same": np.full(50, 2.5), "tail": np.exp(rng.normal(0, 20, 200)), None: np.array([1.0, 2.0]), "two": np.array([-1e300, 1e300])}
    rows = [(k, float(v)) for k, vs in sets.items() for v in vs] + [("ties", None), ("ties", float("nan")), ("empty", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    shares = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    for cells in (4096, 3):
        monkeypatch.setattr(P, "CELLS", cells)
        got = {(r["k"], r["share"]): (r["n"], r["n_missing"], r["quantile"]) for r in P.quantiles(df.where("k <> 'two' OR k IS NULL"), "k", "v", shares).collect()}
        for k, vs in sets.items():
            for s in shares if k != "two" else ():
                n, missing, q = got[k, s]
                assert n == len(vs) and missing == (2 if k == "ties" else 0) and np.isclose(q, np.quantile(vs, s), rtol=1e-12)
        assert got["empty", 0.5] == (0, 1, None)


def test_hidden_overlay(spark):
    rows = spark.createDataFrame([("train", "A", 0.0), ("background", "C", 0.2), ("background", "D", 0.4), ("val", None, 0.6)], "split string, digest string, v double")
    out = P.in_sets(P.overlaid(rows, "digest", rows.where("digest = 'C'").unionByName(rows.where("digest IS NULL"))), "split")
    assert {r["set"]: r["count"] for r in out.groupBy("set").count().collect()} == {"train": 1, "background": 2, "val": 1, "hidden_val": 1, "non_train_source_pool": 2}
