"""Candidates, id lists, curve reports, report texts and the order of hits."""

import json

import pytest
from pyspark.sql import functions as F

from loomwork.operators import candidates as K
from loomwork.operators import curves
from loomwork.sources import hits, manifests, reports

S = "ACDEFGHIKL"


@pytest.mark.parametrize(("meta", "length", "resolution", "copies", "faults"), [
    ({"sequence": S, "resolution": 2.0}, 10, 2.0, 1, []),
    ({"sequence": "  ", "seq": f" {S.lower()} ", "seq_length": None, "sequence_length": 50}, 10, 999.0, 1, []),
    ({"seqres": S, "seq_length": "12.0", "oligomeric_count": "2"}, 10, 999.0, 2, ["oligomeric_count"]),
    ({"sequence": S, "seq_length": "12", "resolution": "nan"}, 12, "nan", 1, []),
    ({"sequence": S, "seq_length": 3.9, "resolution": "3.5", "num_chains": None}, 3, 3.5, 1, ["min_length", "resolution"]),
    ({"sequence": S, "sequence_length": 40, "resolution": [1]}, 40, 999.0, 1, ["max_length"]),
    ({"sequence": "AXXX", "oligomeric_count": True}, 4, 999.0, 1, ["unknown_aa_fraction"]),
    ({"sequence": 5}, 0, 999.0, 1, ["missing_sequence"]),
    ([1], 0, 999.0, 1, ["bad_metadata"]),
    ("not json{", 0, 999.0, 1, ["bad_metadata"]),
])
def test_fields_and_faults(spark, meta, length, resolution, copies, faults):
    text = meta if isinstance(meta, str) else json.dumps(meta)
    row = K.read(spark.createDataFrame([("c", text)], "chain_id string, meta string")).withColumn("faults", K.all_faults(4, 30, 3.0, 0.5)).first()
    assert (row["length"], row["copies"], row["faults"]) == (length, copies, faults)
    assert str(row["resolution"]) == str(resolution)


def test_lenient_numbers_and_first_faults(spark):
    ok = {"secondary_structure_class": "alpha", "helix_fraction": "0.5", "beta_fraction": "0.1", "coil_fraction": "0.4", "domain_architecture_class": "alpha"}
    rows = [("a", {"seq": S, "seq_length": "12.7"}, True, ok), ("b", {"seq": S}, False, ok), ("c", {"x": 1}, True, ok), ("d", {"seq": S, "resolution": 9}, True, {}), ("e", {"seq": S}, True, {}),
            ("f", {"seq": S}, True, ok | {"domain_architecture_class": " "}), ("g", None, True, ok), ("h", {"seq": S}, None, ok)]
    df = spark.createDataFrame([(k, None if m is None else json.dumps(m), a, p) for k, m, a, p in rows], "chain_id string, meta string, accepted boolean, payload map<string,string>")
    read = K.read(df, whole=False)
    assert read.where("chain_id = 'a'").first()["length"] == 12
    got = {r["chain_id"]: r["f"] for r in read.join(df.drop("meta"), "chain_id").select("chain_id", K.first_fault(4, 30, 3.0).alias("f")).collect()}
    assert got == {"a": None, "b": "not_accepted_in_structure_metadata", "c": "missing_sequence", "d": "resolution", "e": "missing_secondary_structure_metadata", "f": "missing_domain_architecture_metadata",
                   "g": "bad_metadata", "h": "not_accepted_in_structure_metadata"}


def test_bins_and_representatives(spark):
    nan = float("nan")
    rows = spark.createDataFrame([(63, 0.0), (64, nan), (191, 1.5), (500, 1.51), (1, 999.0), (1, None)], "n int, r double")
    assert [tuple(r) for r in rows.select(K.length_bin(F.col("n")), K.resolution_bin(F.col("r"))).collect()] == [
        ("len_040_063", "res_unknown"), ("len_064_095", "res_2p5_3p0"), ("len_128_191", "res_le_1p5"), ("len_192_256", "res_1p5_2p0"), ("len_040_063", "res_unknown"), ("len_040_063", "res_unknown")]
    groups = {"class": [("u", "unknown", 1.0, 9, ""), ("k", "alpha", 3.0, 1, "")], "fine": [("z", "a", 0.0, 9, ""), ("n", "a", nan, 9, ""), ("f", "a", 900.0, 1, "")],
              "long": [("s", "a", 2.0, 5, None), ("l", "a", 2.0, 6, None)], "date": [("d", "a", 2.0, 5, "2020"), ("m", "a", 2.0, 5, None)]}
    flat = spark.createDataFrame([(g, *r) for g, rs in groups.items() for r in rs], "g string, key string, class string, resolution double, length int, release string")
    assert {r["g"]: r["key"] for r in K.representatives(flat, "g", "key", "salt").collect()} == {"class": "k", "fine": "f", "long": "l", "date": "m"}


def test_id_lists(spark, tmp_path):
    (tmp_path / "a").write_text("# head\nz1\n\n  # indented\n a2 \nz1\n")
    path = str(tmp_path / "a")
    ids = lambda **o: [r["id"] for r in manifests.ordered_ids(spark, path, **o).orderBy("line").collect()]
    assert ids() == ["z1", "a2", "z1"] and ids(indented_comments=False) == ["z1", "# indented", "a2", "z1"]
    with pytest.raises(ValueError, match="z1"):
        manifests.ordered_ids(spark, path, repeated="error")
    assert manifests.ordered_ids(spark, str(tmp_path / "none"), missing="ok").count() == 0
    (tmp_path / "e").write_text("#\n\n")
    with pytest.raises(ValueError):
        manifests.ordered_ids(spark, str(tmp_path / "e"))
    assert manifests.ordered_ids(spark, str(tmp_path / "e"), empty="ok").count() == 0
    lists = {n: spark.createDataFrame([(0, x)], "line long, id string") for n, x in (("one", "p"), ("two", "q"))}
    assert manifests.combined(lists).count() == 2
    with pytest.raises(ValueError, match="p"):
        manifests.combined({"one": lists["one"], "two": lists["one"]})
    manifests.write_ordered(manifests.ordered_ids(spark, path), str(tmp_path / "out"))
    parts = sorted((tmp_path / "out").glob("part-*"))
    assert "".join(p.read_text() for p in parts) == "z1\na2\nz1\n"


def test_partitions_and_clusters(spark):
    df = lambda rows, s: spark.createDataFrame(rows, s)
    splits = df([("t", 1), ("v", 2), ("v", 1), ("t", 4), ("t", 4)], "split string, k int")
    got = {r["k"]: r["fault"] for r in manifests.partition_faults(splits, df([(1,), (2,), (3,)], "k int"), "k").collect()}
    assert got == {1: "in two splits", 3: "in no split", 4: "not known"}
    clusters = df([(0, "r1", "a"), (1, "r2", "a"), (2, "r3", "b")], "line int, representative string, member string")
    assert {r["member"]: r["representative"] for r in manifests.cluster_map(clusters, df([("a",)], "member string")).collect()} == {"a": "r2"}
    with pytest.raises(ValueError, match="c"):
        manifests.cluster_map(clusters, df([("c",)], "member string"))


def test_structure_metadata(spark, tmp_path):
    good = {"accepted": True, "secondary_structure_class": "alpha", "secondary_helix_fraction": 0.5, "secondary_beta_fraction": 0.1, "secondary_coil_fraction": 0.4, "domain_architecture_class": "alpha"}

    def read(chains):
        (tmp_path / "m.json").write_text(json.dumps({"chains": chains} if chains is not None else [1]))
        return {r["chain_id"]: (r["accepted"], r["payload"].get("secondary_structure_class")) for r in manifests.structure_metadata(spark, str(tmp_path / "m.json")).collect()}

    assert read([{"chain_id": "a", "accepted": False}, 5, {"chain_id": " "}, {"chain_id": "a"} | good, {"chain_id": "b", "secondary_structure_class": None}]) == {"a": (True, "alpha"), "b": (False, None)}
    for bad in (None, [{"chain_id": "a"}], [{"chain_id": "a"} | good | {"domain_architecture_class": ""}], [{"chain_id": "a"} | good | {"secondary_coil_fraction": -1}]):
        with pytest.raises(ValueError):
            read(bad)


def test_published_curve(spark):
    # A published curve and its areas.
    points = [(0, 0, 0.17133560383319854, 0.015289380487985909), (1000, 2000, 0.22606375575065613, 0.07405546116828919), (2000, 4000, 0.21525285404920577, 0.04476294599659741),
              (5000, 10000, 0.25901592007279395, 0.22247545310854913), (10000, 20000, 0.34230435886979105, 0.17571232506632806)]
    rows = spark.createDataFrame([("run", *p, None if p[0] == 1000 else 0.5, float("nan")) for p in points], "run string, step int, samples int, score double, ca double, gap double, off double")
    got = {r["component"]: r for r in curves.report(rows, "run", "samples", "step", "score", ["ca", "gap", "off"], 20000).collect()}
    assert got["score"]["auc"] == pytest.approx(0.26340618432313206, abs=1e-15) and got["ca"]["auc"] == pytest.approx(0.15004086685054935, abs=1e-15)
    assert got["ca"]["final"] == points[-1][3] and got["ca"]["at_samples"]["4000"] == points[2][3] and set(got["ca"]["at_steps"]) == {"0", "1000", "2000", "5000", "10000"}
    assert got["gap"]["at_steps"]["1000"] == points[1][2] and got["gap"]["at_steps"]["0"] == 0.5 and got["off"]["auc"] != got["off"]["auc"]


def test_links_and_markers(spark):
    rows = [("t", None, None, 1.0, "sub mit", None), ("t", "a[b]", "team", 0.5, None, "x (1)/y z"), ("t", None, "only team", 0.1, None, None)]
    df = spark.createDataFrame(rows, "track string, name string, team string, rank_score double, submission string, path string")
    df = df.withColumns({c: F.lit(None).cast(k) for c, k in (("hidden", "double"), ("public", "double"), ("date", "string"), ("commit", "string"), ("description", "string"))})
    lines = [r["line"] for r in reports.ranked_lines(df).orderBy("rank").collect()]
    assert lines[0].startswith("| 1 | [sub mit](submissions/sub%20mit) | sub mit | 1.0000 |") and lines[1].startswith("| 2 | [a\\[b\\]](x%20%281%29/y%20z) | team |") and lines[2].startswith("| 3 | only team | only team |")
    assert reports.markdown(reports.ranked_lines(df.limit(0)), ["one"]) == "| Track | Status |\n|---|---|\n| `one` | No accepted submissions yet |"
    assert reports.between_markers("a <b> old <e> c", "new", "<b>", "<e>") == "a <b>\nnew\n<e> c"
    with pytest.raises(ValueError):
        reports.between_markers("<e> <b>", "new", "<b>", "<e>")


def test_hits_keep_their_order(spark, tmp_path):
    for f in ("x", "y"):
        (tmp_path / f).write_text("HHsearch\n\nNo 1\n" + "".join(f">{k}abc_A name\nQ query 1 AC 2 (2)\nT {k}abc_A 1 AC 2 (2)\nNo {k + 1}\n" for k in range(1, 8)))
    got = hits.hits(hits.hit_blocks(spark, str(tmp_path))).collect()
    for f in ("x", "y"):
        assert [r["entry"] for r in sorted((r for r in got if r["file"].endswith(f)), key=lambda r: r["line"])] == [f"{k}abc" for k in range(1, 8)]
