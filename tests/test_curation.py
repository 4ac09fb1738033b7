"""Chain scores, class rules, splits and coverage against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.functions import classes
from loomwork.operators import chains, coverage, splits

ATOMS = "k string, res int, slot int, x double, y double, z double"


def chain(name, shift=0.0, turn=None, length=6):
    """A chain of `length` residues of 14 atoms."""
    p = np.array([[3.8 * i, 0.1 * s, 0.05 * s] for i in range(length) for s in range(14)])
    p = p + np.random.default_rng(4).normal(scale=0.5, size=p.shape)
    if turn is not None:
        p = p @ turn
    return [(name, i // 14, i % 14, *map(float, q + shift)) for i, q in enumerate(p)]


def test_perfect_and_turned_chains_score_one(spark):
    turn = np.linalg.qr(np.random.default_rng(1).normal(size=(3, 3)))[0]
    turn *= np.sign(np.linalg.det(turn))
    true = spark.createDataFrame(chain("a") + chain("b") + [("c", 0, 1, 0.0, 0.0, 0.0)], ATOMS)
    pred = spark.createDataFrame(chain("a") + chain("b", 7.0, turn) + [("c", 0, 1, 0.0, 0.0, 0.0)], ATOMS)
    for f, name, empty in ((chains.gdt, "gdt", 0.0), (chains.backbone_score, "backbone", 1.0), (chains.dipdiff, "dipdiff", 1.0), (chains.sphere_scores, "spheres", 1.0)):
        got = {r["k"]: r[name] for r in f(pred, true, "k").collect()}
        assert got == pytest.approx({"a": 1.0, "b": 1.0, "c": empty}, abs=1e-9), name


def test_gdt_counts_points_within_limits(spark):
    line = lambda bend: spark.createDataFrame([("a", i, 1, 3.8 * i, bend * (i >= 8), 0.0) for i in range(10)], ATOMS)
    assert chains.gdt(line(20.0), line(0.0), "k", (0.5,)).first()["gdt"] == pytest.approx(0.8)


def test_clashes_equal_all_pairs(spark):
    rng = np.random.default_rng(2)
    p = rng.uniform(-6, 6, size=(120, 3))
    radius = [1.7, 1.55, 0.0, 1.8]
    rows = [("a", i // 4, i % 4, *map(float, x), radius[i % 4]) for i, x in enumerate(p)]
    got = chains.clash_score(spark.createDataFrame(rows, ATOMS + ", radius double"), "k").first()
    want = sum(a[6] > 0 and b[6] > 0 and b[1] - a[1] > 1 and a[6] + b[6] - np.linalg.norm(np.subtract(a[3:6], b[3:6])) > 0.4 for a in rows for b in rows)
    assert got["n_clashes"] == want > 10 and got["clash"] == pytest.approx(1 / (1 + 1000 * want / 120 / 100))


def test_domain_ids_and_lists(spark):
    rows = spark.createDataFrame([("e3ghiC1",), ("1abcA00",), (" d1ab",), ("eelan",), (None,), ("E1abcAB",)], "d string")
    assert [r[0] for r in rows.select(classes.chain_of_domain(F.col("d"))).collect()] == ["3ghi_C", "1abc_A0", None, None, None, "1abc_AB"]
    assert spark.range(1).select(classes.listed(F.lit(" b, a,,b ,c"))).first()[0] == ["b", "a", "c"]
    with pytest.raises(ValueError):
        classes.salt_digest("short")


def test_gate_and_mismatches(spark):
    row = spark.createDataFrame([(0.5, float("nan"), None)], "a double, b double, c double")
    stats = {c: F.col(c) for c in "abc"}
    assert [row.select(classes.fails_gate(stats, {c: x})).first()[0] for c, x in (("a", 0.5), ("a", 0.6), ("b", 0.1), ("c", 0.0))] == [False, True, True, False]
    assert row.select(classes.mismatches(stats, {"a": F.lit(0.5), "b": F.lit(1.0)})).first()[0] == ["b"]


def test_sequential_splits_are_disjoint_whole_and_repeatable(spark):
    pool = spark.createDataFrame([(f"id{i}", "ab"[i % 3 == 0]) for i in range(60)], "id string, s string").repartition(3)
    sizes = [("hidden", 9), ("val", 12), ("train", 30)]
    out = [sorted(map(tuple, splits.sequential(p, "s", "id", sizes, "x" * 32).collect())) for p in (pool, pool.coalesce(1))]
    assert out[0] == out[1] and len({r[0] for r in out[0]}) == 51
    assert {n: sum(r[2] == n for r in out[0]) for n, _ in sizes} == dict(sizes)
    assert sum(r[1] == "b" and r[2] == "hidden" for r in out[0]) == 3
    with pytest.raises(ValueError):
        splits.sequential(pool, "s", "id", [("a", 61)], "x" * 32)


def test_draw_follows_a_reference(spark):
    pool = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(90)], "id long, s string")
    reference = spark.createDataFrame([(i, "ab"[i % 4 == 0]) for i in range(40)], "id long, s string")
    got = [r["s"] for r in splits.drawn(pool, "s", "id", 20, "salt", reference).collect()]
    assert {x: got.count(x) for x in "abc"} == {"a": 15, "b": 5, "c": 0}


def test_quality_report(spark):
    rows = [("a", "x", None)] * 3 + [("a", "y", "u")] + [("b", "x", "u")] * 2
    r = splits.quality_report(spark.createDataFrame(rows, "split string, f string, g string"), ["f", "g"]).first()
    assert r["min_split_size"] == 2 and r["unknown_share"] == pytest.approx(3 / 12) and 0 < r["max_jsd"] <= 1
    report = spark.createDataFrame([(0.4, 0.6, 100), (0.4, 0.1, 99)], "max_jsd double, unknown_share double, min_split_size long")
    assert [r["faults"] for r in splits.gate(report, 0.35, 0.5).collect()] == [["divergence", "unknown"], []]


def test_coverage_rules(spark):
    near = [[0, 1, 2], [1, 2, 0], [2, 1, 0], [3, 2, 1]]
    far = [[0.0, 0.2, 0.4], [0.0, 0.3, 0.5], [0.0, 0.1, 0.6], [0.0, 0.7, 0.8]]
    graph = spark.createDataFrame([(i, n, d) for i in range(4) for n, d in zip(near[i], far[i])], "row int, neighbour int, distance double")
    train = spark.createDataFrame([(1,)], "id int")
    assert sorted(map(tuple, coverage.nearest_train(graph, train).collect())) == [(0, 0.2), (1, 0.0), (2, 0.1), (3, 0.8)]
    assert sorted(map(tuple, coverage.local_distance(graph, 2).collect())) == [(0, 0.4), (1, 0.5), (2, 0.6), (3, 0.8)]
    one = lambda rows: spark.createDataFrame([("js", x) for x in rows], "metric string, value double")
    r = coverage.against_random(one([0.2]), one([0.1, 0.2, 0.3])).first()
    assert r["percentile"] == pytest.approx(2 / 3) and r["tail"] == 1.0
    rows = spark.createDataFrame([(i, i < 3) for i in range(10)], "id long, train boolean")
    got = [{r["id"] for r in coverage.capped(rows.repartition(n), "train", "id", 4, "s").collect()} for n in (1, 3)]
    assert got[0] == got[1] and len(got[0]) == 7 and {0, 1, 2} <= got[0]
