"""Plans and results that small tables do not tell apart from wrong ones."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.operators import chains, passages, projections, records
from loomwork.plans import catalogue


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def atoms(spark):
    return spark.createDataFrame([("c", i, 1, float(i), 0.0, 0.0) for i in range(5)], "k string, res int, slot int, x double, y double, z double")


def test_near_pairs_send_no_side_whole(atoms):
    own = atoms.select("k", F.struct("res", "slot").alias("id"), "res", "slot", F.array("x", "y", "z").alias("p"))
    pairs = chains.near_pairs(own, "k", "p", 1.5)
    assert "BroadcastExchange" not in plan(pairs)
    assert sorted((r["res"], r["res2"]) for r in pairs.collect()) == sorted((a, b) for a in range(5) for b in range(5) if abs(a - b) == 1)


def test_clash_pairs_send_no_side_whole(atoms):
    pairs = chains.clash_pairs(atoms.withColumn("radius", F.lit(1.5)), "k", 0.4, 1.8)
    assert "BroadcastExchange" not in plan(pairs)
    assert sorted((r["a"]["res"], r["b"]["res"]) for r in pairs.collect()) == [(0, 2), (1, 3), (2, 4)]


def test_crop_keeps_the_sign_of_zero(spark, tmp_path):
    values = [-1e-6, 1e-6, -0.0, 0.0, -0.5, 0.123456, float("nan"), None, -5e-6, 5e-6] + [0.25] * 6
    spark.createDataFrame([(1, [0.0] * 24 + values + [0.0] * 24)], "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalogue.QUERIES["array_crop_center"](spark, str(tmp_path)).first()["crop"]
    want = duckdb.connect().execute(catalogue.ORACLES["array_crop_center"].replace("FROM embeddings", f"FROM '{tmp_path}/embeddings.parquet/*.parquet'")).fetchone()[1]
    assert list(map(str, got)) == list(map(str, want)) and str(got[0]) == "-0.0"


def test_shares_of_ranges_too_long_to_list(spark):
    n = 2_000_000_000
    lengths = spark.createDataFrame([("a", n), ("b", 10), ("c", 0)], "k string, n int")
    ranges = spark.createDataFrame([("a", "h", 1, n), ("a", "s", 5, n), ("b", "s", 1, 8), ("b", "h", 2, 3), ("b", "h", 3, 4), ("b", "x", 1, 10), ("b", "s", 9, 99)], "k string, kind string, first int, last int")
    got = {r["k"]: (r["h"], r["s"]) for r in records.annotated_shares(lengths, ranges, "k", ["h", "s"]).collect()}
    assert got == {"a": (1.0, 0.0), "b": (0.3, 0.7), "c": (None, None)}


def test_quantiles_read_their_rows_before_the_last_plan(spark):
    values = [0.0, -0.0, 1e-300, 5e-324, 1e300, -1e300] + [i / 7 for i in range(300)]
    df = spark.createDataFrame([("a", v) for v in values] + [(None, 2.0), (None, None)], "k string, v double")
    out = projections.quantiles(df, "k", "v", [0.0, 0.01, 0.5, 1.0])
    assert "ExistingRDD" not in plan(out)  # the values were counted by turns; what is left are small tables
    got = {(r["k"], r["share"]): r["quantile"] for r in out.collect()}
    assert all(got["a", s] == pytest.approx(float(np.quantile(values, s)), rel=1e-12) for s in (0.0, 0.01, 0.5, 1.0)) and got[None, 0.5] == 2.0


def shuffled(spark, job):
    """What a job gives, and the rows that it shuffles."""
    sc = spark.sparkContext

    def stages():
        found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before, out = stages(), job()
    return out, sum(n for k, n in stages().items() if k not in before)


def test_near_pairs_shuffle_each_atom_of_a_small_chain_once(spark):
    rng = np.random.default_rng(3)
    rows = [(k, i, *map(float, rng.normal(0, 1, 3))) for k in range(20) for i in range(10)]
    atoms = spark.createDataFrame(rows, "k int, id int, x double, y double, z double").select("k", "id", F.array("x", "y", "z").alias("p"))
    got, n = shuffled(spark, lambda: chains.near_pairs(atoms, "k", "p", 15.0).select("k", "id", "id2").collect())
    assert len(got) == len({tuple(r) for r in got}) == 20 * 90 and n == 200  # 28 rows an atom before
    clashes = atoms.select("k", F.col("id").alias("res"), F.lit(1).alias("slot"), *(F.get("p", F.lit(i)).alias(c) for i, c in enumerate("xyz")), F.lit(1.5).alias("radius"))
    got, n = shuffled(spark, lambda: chains.clash_pairs(clashes, "k", 0.4, 10.0).collect())
    want = sum(k == l and b - a > 1 and np.linalg.norm(np.subtract(p, q)) < 2.6 for k, a, *p in rows for l, b, *q in rows)
    assert len(got) == want and n == 200


def test_near_pairs_of_many_blocks(spark):
    rng = np.random.default_rng(8)
    place = np.concatenate([rng.uniform(-9, 9, (400, 3)), np.repeat([[2.0, -6.0, 0.0]], 3, 0), rng.uniform(-1, 1, (5, 3)) + 1e9])
    rows = [("a", i, list(map(float, p))) for i, p in enumerate(place)] + [("b", i, list(map(float, p))) for i, p in enumerate(place[:50])]
    far = [1e300, float("inf"), float("nan"), None]
    rows += [("a", 1000 + i, [x, 0.0, 0.0]) for i, x in enumerate([*far, 1e300])] + [("a", 2000, None), ("a", 2001, []), (None, 1, [0.0] * 3), (None, 2, [0.0] * 3)]
    got = chains.near_pairs(spark.createDataFrame(rows, "k string, id int, p array<double>"), "k", "p", 1.0).collect()
    apart = np.linalg.norm(place[:, None] - place[None], axis=2)
    want = {(k, i, j) for k, n in (("a", len(place)), ("b", 50)) for i in range(n) for j in range(n) if i != j and apart[i, j] <= 1} | {("a", 1000, 1004), ("a", 1004, 1000)}
    assert sorted((r["k"], r["id"], r["id2"]) for r in got) == sorted(want) and len(want) > 100
    assert all(r["d"] == pytest.approx(apart[r["id"], r["id2"]]) for r in got if r["id"] < 1000)


def test_a_line_that_all_texts_have_is_not_shuffled_for_each(spark):
    line = "a line that stands in every text, word for word"
    texts = spark.createDataFrame([("xy"[i % 2], line) for i in range(4000)], "g string, text string").coalesce(2)
    got, n = shuffled(spark, lambda: passages.in_several(texts, "g", "text", 40).collect())
    assert {r["passage"]: r["n"] for r in got} == {line[i : i + 40]: 2 for i in range(len(line) - 39)} and n < 200
