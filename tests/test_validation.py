"""Records against rules."""

import pytest

from loomwork.operators import validation as V


def checked(spark, rules, arrays, **more):
    rows = [("r", k, kind, shape) for k, (kind, shape) in (arrays | more).items() if kind]
    df = spark.createDataFrame(rows or [("r", None, None, None)], "record string, key string, kind string, shape array<int>")
    return V.validated(V.gathered(df, "record"), rules).first()["faults"]


GOOD = {"aatype": ("int32", [5]), "msa": ("int64", [2, 5]), "deletions": ("int32", [2, 5]), "template_aatype": ("int32", [0, 5]), "template_ca_coords": ("float32", [0, 5, 3]), "template_ca_mask": ("bool", [0, 5])}
LABEL = {"ca_mask": ("bool", [5]), "ca_coords": ("float32", [5, 3])}
NONE = (None, None)


@pytest.mark.parametrize(("more", "want"), [
    ({}, []),
    ({"aatype": ("float32", [5])}, ["`aatype` dtype must be int32/int64 (got float32)"]),
    ({"aatype": ("float32", [5, 1]), "msa": ("bool", [1])}, ["`aatype` dtype must be int32/int64 (got float32)", "`msa` dtype must be int32/int64 (got bool)", "`aatype` must have shape (L), got (5, 1)"]),
    ({"msa": NONE, "aatype": NONE}, ["Missing key `aatype`", "Missing key `msa`"]),
    ({"msa": ("int32", [2, 6])}, ["`msa` dimension 2 must equal L=5, got 6"]),
    ({"deletions": ("int32", [3, 4])}, ["`deletions` dimension 1 must equal N=2, got 3", "`deletions` dimension 2 must equal L=5, got 4"]),
    ({"msa": ("int32", [7])}, ["`msa` must have shape (N, L), got (7)"]),
    ({"template_ca_coords": ("float64", [1, 5, 3])}, ["`template_ca_coords` dimension 1 must equal T=0, got 1"]),
    ({"residue_index": ("int32", [4])}, ["`residue_index` dimension 1 must equal L=5, got 4"]),
    ({"something_else": ("text", [1, 1, 1])}, []),
])
def test_features(spark, more, want):
    assert checked(spark, V.FEATURES, GOOD, **more) == want


@pytest.mark.parametrize(("more", "want"), [
    ({}, []), ({"resolution": ("float32", [])}, []), ({"resolution": ("float64", [1])}, []), ({"resolution": ("float64", [2])}, ["`resolution` must have shape (), got (2)"]),
    ({"atom14_mask": ("int32", [5, 14])}, ["`atom14_mask` dtype must be bool (got int32)"]), ({"atom14_positions": ("float32", [4, 14, 3])}, ["`atom14_positions` dimension 1 must equal L=5, got 4"]),
    ({"ca_mask": ("bool", [5, 1])}, ["`ca_mask` must have shape (L), got (5, 1)"]),
])
def test_labels(spark, more, want):
    assert checked(spark, V.LABELS, LABEL, **more) == want


def test_an_empty_record_lacks_all(spark):
    assert checked(spark, V.LABELS, {}) == ["Missing key `ca_mask`", "Missing key `ca_coords`"]


def test_described_columns_and_ranges(spark):
    rules = (V.Rule("a", V.INTS, ("L",), low=0, high=20), V.Rule("b", V.FLOATS, ("L", 2), low=-1.0), V.Rule("c", V.FLOATS, (), required=False))
    rows = [(1, [1, 2], [[0.0, 1.0], [2.0, 3.0]], 1.0), (2, [1, 21], [[0.0, 1.0], [2.0]], None), (3, None, [], 0.0), (4, [], [], None), (5, [1], [[float("nan"), 0.0]], None), (6, [1], [[-2.0, 0.0]], None), (7, [None], [[1.0, 0.0]], None)]
    df = spark.createDataFrame(rows, "k int, a array<int>, b array<array<double>>, c double")
    got = {r["k"]: r["faults"] for r in V.validated(V.described(df, "k", ["a", "b", "c"]), rules).collect()}
    low = "`b` must be finite and within [-1.0, None]"
    assert got[1] == [] and got[3] == ["Missing key `a`"] and got[5] == [low] == got[6]
    assert got[2] == ["`b` must have shape (L, 2), got (2, -1)", "`a` must be finite and within [0, 20]"] and got[7] == ["`a` must be finite and within [0, 20]"]
    assert got[4] == ["`b` must have shape (L, 2), got (0, 0)"]
    assert V.validated(V.described(df.limit(0), "k", ["a"]), rules).count() == 0
