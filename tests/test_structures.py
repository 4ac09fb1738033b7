"""Structure files: parser, models, alternative places, chains."""

import gzip

import pytest

from loomwork.functions import residues
from loomwork.operators import structures as S
from loomwork.sources import cif

HEAD = ["group_PDB", "label_atom_id", "label_alt_id", "label_comp_id", "label_asym_id", "label_entity_id", "label_seq_id", "auth_asym_id", "Cartn_x", "Cartn_y", "Cartn_z", "occupancy", "pdbx_PDB_model_num"]
ENTITY = "loop_\n_entity.id\n_entity.type\n1 polymer\n2 water\n"


def written(path, atoms, more=""):
    lines = ["data_synth", "#", more, "loop_", *(f"_atom_site.{h}" for h in HEAD), *(" ".join(map(str, a)) for a in atoms), "#"]
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def backbone(chain="A", n=3, model=1):
    return [("ATOM", a, ".", "ALA", chain, 1, r + 1, chain, x, y, 3.8 * r, 1.0, model) for r in range(n) for a, x, y in (("N", 0, 1), ("CA", 0, 0), ("C", 1, 0), ("O", 1, -1))]


def test_three_residues(spark, tmp_path):
    atoms = S.polymer_atoms(spark, written(tmp_path / "s.cif", backbone() + backbone(model=2), ENTITY))
    listed = S.residue_list(atoms)
    got = {(r["res"], r["slot"]): (r["x"], r["y"], r["z"]) for r in S.chosen_atoms(atoms, listed).collect()}
    assert got == {(r, s): (x, y, 3.8 * r) for r in range(3) for s, x, y in ((0, 0, 1), (1, 0, 0), (2, 1, 0), (3, 1, -1))}
    assert [r["sequence"] for r in S.sequences(listed).collect()] == ["AAA"]


def test_preferred_place_goes_before_occupancy(spark, tmp_path):
    row = lambda alt, occ, x, atom="CA": ("ATOM", atom, alt, "SER", "A", 1, 7, "A", x, 0, 0, occ, 1)
    atoms = S.polymer_atoms(spark, written(tmp_path / "s.cif", [row("B", 0.9, 1), row("A", 0.1, 2), row("B", 0.4, 3, "N"), row("C", 0.6, 4, "N"), row("A", 0.5, 5, "OG"), row(".", 0.5, 6, "OG")]))
    got = {r["slot"]: r["x"] for r in S.chosen_atoms(atoms, S.residue_list(atoms)).collect()}
    assert got == {1: 2.0, 0: 4.0, 5: 5.0}


def test_polymers_and_unknown_residues(spark, tmp_path):
    rows = [*backbone(n=1), ("HETATM", "CA", ".", "MSE", "A", 1, 2, "A", 9, 9, 9, 1.0, 1), ("HETATM", "O", ".", "HOH", "A", 2, ".", "A", 5, 5, 5, 1.0, 1)]
    for more, want in ((ENTITY, "AX"), ("", "A")):
        listed = S.residue_list(S.polymer_atoms(spark, written(tmp_path / f"{want}.cif", rows, more)))
        assert [r["sequence"] for r in S.sequences(listed).collect()] == [want]


def test_chains_by_name_and_by_sequence(spark):
    known = spark.createDataFrame([("f", "b", "A", "ACDEFGHIKL"), ("f", "b", "B", "ACDEFGHIK"), ("f", "b", "C", "WWWW")], "file string, block string, chain string, sequence string")
    ask = [("A", None), ("A", "WWWW"), ("Z", "acdefghikl"), ("Z", "ACDEFGHI"), ("Z", "YYYY"), ("Z", ""), ("Z", None)]
    wanted = spark.createDataFrame([("f", "b", c, e, i) for i, (c, e) in enumerate(ask)], "file string, block string, chain string, expected string, i int")
    got = {r["i"]: (r["found"], r["fault"]) for r in S.resolved(wanted, known).collect()}
    none = (None, "no such chain")
    assert got == {0: ("A", None), 1: ("A", "other sequence"), 2: ("A", "other sequence"), 3: ("B", "other sequence"), 4: none, 5: none, 6: none}
    assert S.resolved(wanted.limit(0), known).count() == 0


def test_tokens_rows_and_faults():
    text = """data_one
_cell.length_a 1.0
_cell.note 'it''s a ''cell'' # a comment
_cell.long
;first
second
;
loop_
_x.a
_x.b   # comment
1 "two words"
. '.'
3
'?'
data_two
_x.a 5
_y.a 6
"""
    assert list(cif.rows(text.splitlines(), "x")) == [("one", ["a", "b"], ["1", "two words"]), ("one", ["a", "b"], [None, "."]), ("one", ["a", "b"], ["3", "?"]), ("two", ["a"], ["5"])]
    assert list(cif.rows(text.splitlines(), "CELL")) == [("one", ["length_a", "note", "long"], ["1.0", "it''s a ''cell'", "first\nsecond"])]
    with pytest.raises(ValueError):
        list(cif.rows(["data_a", "loop_", "_x.a", "_x.b", "1 2 3", "_y.c 4"], "x"))
    with pytest.raises(ValueError):
        list(cif.rows(["data_a", "_x.a", ";open"], "x"))
    assert list(cif.rows([], "x")) == []


def test_source_reads_folders_blocks_and_gzip(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.cif").write_text("data_a\n_refine.ls_d_res_high 2.5\n_atom_site.id 1\ndata_b\n_atom_site.id 2\n_refine.ls_d_res_high ?\n_em_3d_reconstruction.resolution 3.1\n")
    with gzip.open(tmp_path / "in" / "deep" / "b.cif.gz", "wt") as f:
        f.write("data_c\n_atom_site.id 1\n_refine.ls_d_res_high -1\ndata_d\n_atom_site.id 1\n")
    got = {r["block"]: r["resolution"] for r in S.resolutions(spark, str(tmp_path / "in")).collect()}
    assert got == {"a": 2.5, "b": 3.1, "c": 0.0, "d": 0.0}
    assert cif.category(spark, str(tmp_path / "in"), "nothing", ["a"]).count() == 0


def test_annotated_ranges(spark, tmp_path):
    (tmp_path / "a.cif").write_text(
        "data_a\nloop_\n_struct_conf.conf_type_id\n_struct_conf.beg_auth_asym_id\n_struct_conf.beg_label_seq_id\n_struct_conf.end_label_seq_id\nHELX_P A 2 4\nTURN_P A 5 6\n"
        "_struct_sheet_range.beg_auth_asym_id A\n_struct_sheet_range.beg_label_seq_id 4\n_struct_sheet_range.end_label_seq_id 8\n"
    )
    got = sorted((r["chain"], r["kind"], r["first"], r["last"]) for r in S.ranges(spark, str(tmp_path / "a.cif")).collect())
    assert got == [("A", "helix", 2, 4), ("A", "strand", 4, 8)]


def test_tables(spark):
    assert len(residues.IDS) == 20 and "".join(residues.LETTERS.values()) == "ARNDCQEGHILKMFPSTWYV"
    assert residues.slots(spark).count() == 167 and residues.chi_places(spark).groupBy("type", "chi").count().where("count <> 4").isEmpty()


def test_atoms_of_a_file_are_taken_apart_once(spark, tmp_path):
    (tmp_path / "a.cif").write_text("data_a\nloop_\n_atom_site.group_PDB\n_atom_site.label_atom_id\n_atom_site.label_comp_id\n_atom_site.label_asym_id\n_atom_site.label_seq_id\nATOM CA GLY A 1\n")
    from loomwork.operators import structures

    atoms = structures.polymer_atoms(spark, f"{tmp_path}/a.cif")
    lines = [x for x in atoms._jdf.queryExecution().executedPlan().toString().splitlines() if "BatchScan" in x]
    assert len(lines) == 1 and atoms.count() == 1  # what is left to read of the text is `entity`
