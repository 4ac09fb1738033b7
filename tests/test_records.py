"""Record assembly and text sources on literal fixtures."""

import hashlib

from pyspark.sql import functions as F

from loomwork.operators import records, relational
from loomwork.sources import hits, reports, text


def test_annotation_lists(spark):
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    cath = text.cath_classes(lines("1abcA00  1 10", "# no", "", "x 1", "2XYZB01\t4", "1abcA01 3"))
    scope = text.scope_classes(lines("d1abca_ 1ABC A:1-20 b.1.1", "d2defc1 2def - c.1", "short 9zzz - a.1", "d3ghi 3ghi _B_: k.1"))
    ecod = text.ecod_classes(lines("000 e4jklA1 Alpha bundle", "e5mnoB2 beta barrel alpha", "none here", "e6pqrC1 a+b plaits"))
    got = {r["chain"]: r["classes"] for r in text.annotated(cath, scope, ecod).collect()}
    assert got == {"1abc_A": ["alpha", "alpha_beta", "beta"], "2xyz_B": ["coil_or_sparse"], "d2de_fc": ["alpha_beta"], "3ghi_B": ["other"],
                   "4jkl_A": ["alpha"], "5mno_B": ["alpha_beta"], "6pqr_C": ["alpha_beta"]}


def test_fasta_and_digests(spark, tmp_path):
    text.write_fasta(spark.createDataFrame([("b", "MK"), ("a", "GG")], "id string, sequence string").coalesce(1), f"{tmp_path}/f")
    assert sorted((r["name"], r["sequence"]) for r in text.records(spark, f"{tmp_path}/f").collect()) == [("a", "GG"), ("b", "MK")]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x").write_bytes(b"abc")
    assert [(r["length"], r["sha256"]) for r in text.file_digests(spark, f"{tmp_path}/d").collect()] == [(3, hashlib.sha256(b"abc").hexdigest())]


def test_awkward_arrays(spark):
    df = spark.createDataFrame([(1, "a", [1, 2], [3]), (2, "a", None, None), (3, None, [], []), (4, "a", [7], [8])], "k int, g string, x array<int>, y array<int>")
    got = {r["k"]: (r["x"], r["y"], r["mask"], r["consistent"]) for r in records.padded_batch(df, "g", {"x": 0, "y": 21}).collect()}
    assert got == {1: ([1, 2], [3, 21], [True, True], False), 2: ([0, 0], [21, 21], [False, False], True), 3: ([], [], [], True), 4: ([7, 0], [8, 21], [True, False], True)}
    row = spark.range(1).select(
        records.scattered(F.lit(3), F.array(F.lit(1), F.lit(1), F.lit(9)), F.array(F.lit(5), F.lit(6), F.lit(7)), 0).alias("s"),
        records.row_sample(F.array().cast("array<int>"), 4, "s", F.lit(1)).alias("none"), records.row_sample(F.array(F.lit(4)), 4, "s", F.lit(1)).alias("one"),
    ).first()
    assert (row["s"], row["none"], row["one"]) == ([0, 6, 0], [], [4])


def test_shares_clip_and_first_kind_wins(spark):
    lengths = spark.createDataFrame([("a", 4), ("b", 0), ("c", 2)], "k string, n int")
    ranges = spark.createDataFrame([("a", "h", -3, 2), ("a", "s", 2, 9), ("a", "x", 1, 4), ("b", "h", 1, 1), ("c", "h", 2, 1)], "k string, kind string, first int, last int")
    got = {r["k"]: (r["h"], r["s"]) for r in records.annotated_shares(lengths, ranges, "k", ["h", "s"]).collect()}
    assert got == {"a": (0.5, 0.5), "b": (None, None), "c": (0.0, 0.0)}


def test_long_chains_of_named_and_large_ids_are_linked(spark):
    big = (1 << 62) + 5
    names = spark.createDataFrame([(f"n{i:03}", f"v{i // 2}", f"w{(i + 1) // 2}") for i in range(60)] + [("z", None, None)], "node string, x string, y string")
    assert {(r["node"], r["component"]) for r in relational.linked(names, "node", ["x", "y"]).collect()} == {(f"n{i:03}", "n000") for i in range(60)} | {("z", "z")}
    ids = spark.createDataFrame([(big + i, "same") for i in range(4)], "node long, x string")
    assert {r["component"] for r in relational.linked(ids, "node", ["x"]).collect()} == {big}


def test_hit_list_file(spark, tmp_path):
    block = "Q query 2 AB- 3 (9)\nT Consensus 1 abc 3\nT x 4 ABC 6 (9)\n\nQ query x CD 5\nT x 7 CD 8 (9)\nQ query 4 C 4 (9)\nT x 7 CD 8 (9)\n"
    (tmp_path / "a.hhr").write_text(f"Query  q\nMatch_columns 9\n\nNo 1\n>2xyzB some\n{block}\nNo 2\n>badname?\n{block}\nNo 3\n>3abc-C\nQ query 1 - 1\nT x 1 A 1\n")
    got = hits.hits(hits.hit_blocks(spark, f"{tmp_path}/a.hhr")).collect()
    assert [(r["entry"], r["chain"], r["query"], r["template"], [tuple(p) for p in r["pairs"]]) for r in got] == [("2xyz", "B", "AB-CDC", "ABCCDCD", [(1, 3), (2, 4)])]


def test_leaderboard_text(spark):
    rows = [("b", "n1", "t", 0.5), ("limited", "n2", None, float("nan")), ("limited", "n|3", "t", 0.25), (None, "n4", "t", None)]
    e = spark.createDataFrame(rows, "track string, name string, team string, rank_score double").select(
        "*", F.lit(1.0).alias("hidden"), F.lit(None).cast("double").alias("public"), F.lit("d").alias("date"), F.lit("0123456789").alias("commit"), F.lit("x\ny").alias("description"))
    got = reports.markdown(reports.ranked_lines(e), ["limited"]).split("\n")
    assert got[0] == "### `limited`" and got[3:5] == [r"| 1 | n\|3 | t | 0.2500 | 1.0000 | n/a | d | `0123456` | x y |", "| 2 | n2 |  | n/a | 1.0000 | n/a | d | `0123456` | x y |"]
    assert [x for x in got if x.startswith("###")] == ["### `limited`", "### `unknown`", "### `b`"]
