"""Global alignment against a plain table of all cells, projection and scattered arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.operators import aligner


def plain_score(a, b, match=2, mismatch=-1, open=-4, extend=-1):
    low = -(10**9)
    best = {(0, 0): (0, low, low)}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i or j:
                at = lambda x, y: best.get((x, y), (low,) * 3)
                m = max(at(i - 1, j - 1)) + (match if i and j and a[i - 1] == b[j - 1] else mismatch) if i and j else low
                x = max(at(i - 1, j)[0] + open, at(i - 1, j)[1] + extend, at(i - 1, j)[2] + open)
                y = max(at(i, j - 1)[0] + open, at(i, j - 1)[1] + open, at(i, j - 1)[2] + extend)
                best[i, j] = (m, x, y)
    return max(best[len(a), len(b)])


def counted(a, b, pairs, match=2, mismatch=-1, open=-4, extend=-1):
    out, before = 0, (-1, -1)
    for q, t in [*pairs, (len(a), len(b))]:
        for gap in (q - before[0] - 1, t - before[1] - 1):
            assert gap >= 0
            out += open + (gap - 1) * extend if gap else 0
        if q < len(a):
            out += match if a[q] == b[t] else mismatch
        before = (q, t)
    return out


@pytest.mark.parametrize("scores", [(2, -1, -4, -1), (1, -3, -2, -2), (5, -4, -1, 0)])
def test_scores_and_pairs(monkeypatch, scores):
    monkeypatch.setattr(aligner, "CELLS", 200)
    rng = np.random.default_rng(2)
    word = lambda n: "".join(rng.choice(list("ACDé漢"), n))
    a = [word(rng.integers(0, 25)) for _ in range(120)] + ["A", "", None, "ACDE", "x" * 60, "ABC"]
    b = [(x[: rng.integers(0, len(x) + 1)] + word(rng.integers(0, 9)) if rng.random() < 0.6 else word(rng.integers(0, 25))) for x in a[:120]] + ["", "A", "A", "ACDF", "x" * 45, "xyz"]
    for x, y, found in zip(a, b, aligner.align(a, b, scores)):
        if not x or not y:
            assert found is None
            continue
        score, pairs = found
        assert score == plain_score(x, y, *scores) == counted(x, y, list(zip(*pairs.tolist())), *scores)


def test_long_pairs_stay_small():
    a = "ACDEFGHIKLMNPQRSTVWY" * 150
    score, pairs = aligner.align([a], [a[:1000] + a[1010:]])[0]
    assert score == 2 * 2990 - 4 - 9 and pairs.shape == (2, 2990)


def test_columns(spark):
    rows = spark.createDataFrame([(1, "ACDE", "ACDF"), (2, "", "A"), (3, None, "A"), (4, "ACDEFGHIKL", "ACDHIKL"), (5, "aC", "AC")], "k int, a string, b string")
    own = rows.withColumn("x", aligner.alignment(F.col("a"), F.col("b")))
    got = {r["k"]: r for r in own.select("k", "x", aligner.pairs_score(F.col("a"), F.col("b"), F.col("x.q"), F.col("x.t")).alias("s")).collect()}
    assert got[1]["x"]["q"] == [0, 1, 2, 3] and got[1]["x"]["score"] == got[1]["s"] == 5
    assert got[2]["x"]["score"] is None and got[3]["x"]["q"] == []
    assert got[4]["x"]["q"] == [0, 1, 2, 6, 7, 8, 9] and got[4]["s"] == got[4]["x"]["score"] == 14 - 4 - 2
    assert got[5]["s"] == got[5]["x"]["score"] == 1
    assert own.limit(0).count() == 0


def test_projection_of_four_residues(spark):
    chains = spark.createDataFrame([("k", "ACDE", "ACDF"), ("none", "", "ACD")], "key string, query string, seq string")
    atoms = spark.createDataFrame([("k", i, 1, float(i)) for i in range(3)] + [("k", 3, 0, 9.0), ("other", 0, 1, 5.0)], "key string, res int, slot int, x double")
    pairs = aligner.projection(chains, "key", "query", "seq")
    got = {r["key"]: tuple(r)[1:] for r in aligner.projection_report(pairs, atoms, "key").collect()}
    assert got == {"k": (0.75, 1.0, 1.0, 3), "none": (0.0, 0.0, 0.0, 0)}
    assert sorted((r["res"], r["x"]) for r in aligner.projected_atoms(pairs, atoms, "key").collect()) == [(0, 0.0), (1, 1.0), (2, 2.0), (3, 9.0)]


def test_projection_moves_residues(spark):
    chains = spark.createDataFrame([("k", "WWACDEFG", "ACDEFGYY")], "key string, query string, seq string")
    atoms = spark.createDataFrame([("k", i, 1, float(i)) for i in range(8)], "key string, res int, slot int, x double")
    got = sorted((r["res"], r["x"]) for r in aligner.projected_atoms(aligner.projection(chains, "key", "query", "seq"), atoms, "key").collect())
    assert got == [(i + 2, float(i)) for i in range(6)]


def test_scattered_arrays(spark):
    rows = [(1, 4, [0, 2, 9, -1, 2], [1, 0, 0, 0, 2], [7, 8, 9], [[1.0], [2.0], [3.0]], [True, False, True]), (2, 0, [], [], [1], [[1.0]], [True]), (3, 2, [1], [5], None, None, None),
            (4, None, None, None, [1], [[1.0]], [True]), (5, 2, [0], [0], [], [], [])]
    df = spark.createDataFrame(rows, "k int, n int, p array<int>, s array<int>, a array<int>, b array<array<double>>, c array<boolean>")
    got = {r["k"]: (r["a"], r["b"], r["c"]) for r in aligner.scattered_arrays(df, "n", "p", "s", {"a": 20, "b": [0.0], "c": False}).collect()}
    assert got[1] == ([8, 20, 9, 20], [[2.0], [0.0], [3.0], [0.0]], [False, False, True, False])
    assert got[2] == ([], [], []) == got[4] and got[3] == ([20, 20], [[0.0]] * 2, [False] * 2) == got[5]
