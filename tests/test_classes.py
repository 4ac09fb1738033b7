"""Class rules, payloads, annotation lists and nested values on awkward rows."""

import pytest
from pyspark.sql import functions as F

from loomwork.functions import classes as C
from loomwork.sources import text

NAN = float("nan")


def column(spark, values, kind, made):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in rows.select("i", made(F.col("v")).alias("x")).orderBy("i").collect()]


def test_shares(spark):
    rows = [(0.4, 0.19, 0.0, "alpha"), (0.4, 0.2, 0.0, "alpha_beta"), (0.1, 0.3, None, "beta"), (0.2, 0.15, 0.9, "alpha_beta"), (0.1, 0.1, 0.7, "coil_or_sparse"), (0.1, 0.1, 0.69, "mixed_low_confidence"),
            (0.1, 0.1, None, "mixed_low_confidence"), (None, 0.5, 0.5, "unknown"), (0.5, None, 0.5, "unknown"), (NAN, 0.1, 0.1, "mixed_low_confidence"), (0.5, NAN, NAN, "mixed_low_confidence")]
    got = spark.createDataFrame(rows, "h double, b double, c double, want string").select(C.class_of_shares(F.col("h"), F.col("b"), F.col("c")).alias("x"), "want").collect()
    assert all(r["x"] == r["want"] for r in got)


def test_architectures(spark):
    rows = {None: "unknown", "  ": "unknown", "All-Alpha": "alpha", "beta sandwiches": "beta", "Alpha+Beta": "alpha_beta", "a/b two layers": "alpha_beta", "x a+b y": "alpha_beta", "helical bundle": "alpha",
            "TIM barrel": "beta", "small protein": "coil_or_sparse", "other thing": "other_thing", "mixed": "alpha_beta", "cath_annotated": "cath_annotated"}
    assert column(spark, list(rows), "string", C.architecture_of) == list(rows.values())
    codes = {"1": "alpha", "2": "beta", "3": "alpha_beta", " 4 ": "coil_or_sparse", "6": "6", "Mainly Beta": "beta", "mixed": "alpha_beta", None: "unknown", "strand": "strand"}
    assert column(spark, list(codes), "string", C.class_of_code) == list(codes.values())
    assert [tuple(x) for x in column(spark, ["all beta", "zzz", None], "string", C.shares_of_class)] == [("beta", 0.05, 0.55, 0.4), ("mixed_low_confidence", 0.25, 0.15, 0.6), ("mixed_low_confidence", 0.25, 0.15, 0.6)]


def test_payloads(spark):
    rows = [({"secondary_structure_class": None, "structural_class": "beta", "helix_fraction": "0.5", "beta_fraction": "0.1"}, ("alpha", 0.5, 0.1, None, "unknown", "unknown", 0)),
            ({"structural_class": "Mainly Beta", "metadata_source_count": "-3"}, ("beta", None, None, None, "unknown", "unknown", 0)),
            ({"secondary_helix_fraction": None, "helix_fraction": "0.9", "beta_fraction": "0.1"}, ("unknown", None, 0.1, None, "unknown", "unknown", 0)),
            ({"helix_fraction": "-1", "beta_fraction": "x", "domain_architecture_class": " Alpha ", "domain_architecture_source": " cath ", "metadata_source_count": "4"}, ("unknown", None, None, None, "alpha", "cath", 4)),
            ({}, ("unknown", None, None, None, "unknown", "unknown", 0))]
    assert [tuple(x) for x in column(spark, [r[0] for r in rows], "map<string,string>", C.payload_class)] == [r[1] for r in rows]


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_annotation_lists(spark):
    cath = text.cath_classes(lines(spark, "1abcA00  1 10", "1abcA01 6", "", "# no", "x 1", None))
    ecod = text.ecod_classes(lines(spark, "000000001\te3ghiC1\tmanual\tnothing here", "e4jklD2 alpha/beta plait", "effort e5"))
    got = {r["chain"]: r["classes"] for r in text.annotated(cath, ecod).collect()}
    assert got == {"1abc_A": ["6", "alpha"], "4jkl_D": ["alpha_beta"]}
    chains = spark.createDataFrame([("1abc_A", "beta"), ("4jkl_D", "helix"), ("9zzz_Z", "")], "chain string, own string")
    marked = spark.createDataFrame([("4jkl_D", "cath_annotated"), ("4jkl_D", "zeta"), ("1abc_A", "unknown")], "chain string, class string")
    got = {r["chain"]: (r["architecture"], r["source"]) for r in text.chosen_architecture(chains, {"marked": marked, "ecod": ecod, "cath": cath}, "own").collect()}
    assert got == {"1abc_A": ("6", "cath"), "4jkl_D": ("alpha_beta", "ecod"), "9zzz_Z": ("unknown", "fallback")}


@pytest.mark.parametrize(("line", "want"), [
    ('{"chain_id": " a ", "x": ["CATH", {"alpha": "helix"}]}', [("a", "alpha"), ("a", "cath_annotated")]),
    ('{"chain_id": "b", "beta": 1, "n": [null, 2.5, true, "say \\"alpha\\" \\\\ beta:"]}', [("b", "alpha_beta")]),
    ('{"chain_id": "", "x": "alpha"}', []), ('{"x": "alpha"}', []), ('["chain_id", "alpha"]', []), ('{"chain_id": "c", "x": "alpha"', []), ("", []), ("null", []), ('{"chain_id": "d"}', []),
])
def test_keywords(spark, line, want):
    assert sorted((r["chain"], r["class"]) for r in text.keyword_classes(lines(spark, line)).collect()) == want


def test_nested_values(spark):
    v = lines(spark, '{"a": [{"b": {"c": [7, 8]}}, {"b": 1}], "n": null, "e": [], "s": "x"}').select(F.expr("parse_json(value)").alias("v"))
    paths = {("a", "b", "c"): "7", ("n",): None, ("e", "x"): None, ("s",): "x", ("s", "t"): None, ("no",): None}
    assert [r for r in v.select(*(text.plucked(F.col("v"), *p).alias(str(i)) for i, p in enumerate(paths))).first()] == list(paths.values())
    assert v.select(text.leaves(F.col("v")).alias("x")).first()["x"] == ["7", "8", "1", "None", "x"]
