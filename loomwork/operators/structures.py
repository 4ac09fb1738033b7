"""Atoms of chains from structure files: models, polymers, alternative places, slots and chains by name or by sequence."""

from __future__ import annotations

from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import residues
from ..sources import cif
from ..sources.places import stored

_ITEMS = ["group_PDB", "label_atom_id", "label_alt_id", "label_comp_id", "label_asym_id", "label_entity_id", "label_seq_id", "auth_seq_id", "auth_asym_id",
          "pdbx_PDB_ins_code", "Cartn_x", "Cartn_y", "Cartn_z", "occupancy", "pdbx_PDB_model_num"]
ENTRY = ["file", "block"]
#: How like a sequence has to be for a chain of another name.
LIKE = 0.85


def polymer_atoms(spark: SparkSession, path: str) -> DataFrame:
    """file, block, row, chain, residue_key, residue, atom, alt, occupancy, x, y, z of the atoms of polymers in each block's first model.

    A chain goes by its author's name where it has one. Where a file does not say what its entities are, the group ATOM is taken as the polymers.
    """
    raw = stored(cif.category(spark, path, "atom_site", _ITEMS), "atoms")  # read twice, so the text is taken apart once
    kinds = cif.category(spark, path, "entity", ["id", "type"]).select(*ENTRY, F.col("id").alias("label_entity_id"), F.lower("type").alias("kind")).dropDuplicates([*ENTRY, "label_entity_id"])
    model = F.coalesce("pdbx_PDB_model_num", F.lit(""))
    first = raw.groupBy(*ENTRY).agg(F.min_by(model, "row").alias("first"))
    own = raw.join(first, ENTRY).where(model == F.col("first")).join(kinds, [*ENTRY, "label_entity_id"], "left")
    own = own.where(F.coalesce(F.col("kind") == "polymer", F.col("group_PDB") == "ATOM"))
    number = lambda c, other=None: F.coalesce(F.col(c).try_cast("double"), F.lit(other))
    return own.select(
        *ENTRY, "row", F.coalesce("auth_asym_id", "label_asym_id").alias("chain"),
        F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in ("label_seq_id", "auth_seq_id", "pdbx_PDB_ins_code", "label_comp_id"))).alias("residue_key"),
        F.upper("label_comp_id").alias("residue"), F.col("label_atom_id").alias("atom"), F.col("label_alt_id").alias("alt"), number("occupancy", 1.0).alias("occupancy"),
        number("Cartn_x").alias("x"), number("Cartn_y").alias("y"), number("Cartn_z").alias("z"),
    )


def residue_list(atoms: DataFrame) -> DataFrame:
    """file, block, chain, residue_key, residue, letter and res of polymer_atoms: residues from 0 in the order of the file, whatever numbers they bear there."""
    own = atoms.groupBy(*ENTRY, "chain", "residue_key", "residue").agg(F.min("row").alias("at"))
    res = (F.row_number().over(Window.partitionBy(*ENTRY, "chain").orderBy("at")) - 1).alias("res")  # a chain's residues
    return own.select(*ENTRY, "chain", "residue_key", "residue", residues.letter_of(F.col("residue")).alias("letter"), res)


def chosen_atoms(atoms: DataFrame, listed: DataFrame) -> DataFrame:
    """file, block, chain, res, slot, x, y, z: one place for each atom that has a slot.

    Of alternative places those without a sign or with A go before others, then the larger occupancy, then the earlier row. Residues that
    are not among the twenty have no slots.
    """
    order = F.struct(F.when(F.col("alt").isNull() | (F.col("alt") == "A"), 0).otherwise(1), -F.col("occupancy"), "row")
    best = atoms.groupBy(*ENTRY, "chain", "residue_key", "residue", "atom").agg(F.min_by(F.struct("x", "y", "z"), order).alias("p"))
    table = residues.slots(atoms.sparkSession).select("residue", "atom", "slot")
    return best.join(F.broadcast(table), ["residue", "atom"]).join(listed.select(*ENTRY, "chain", "residue_key", "residue", "res"), [*ENTRY, "chain", "residue_key", "residue"]).select(*ENTRY, "chain", "res", "slot", "p.*")


def sequences(listed: DataFrame) -> DataFrame:
    """file, block, chain and sequence, a letter for each residue."""
    own = listed.groupBy(*ENTRY, "chain").agg(F.array_sort(F.collect_list(F.struct("res", "letter"))).alias("s"))
    return own.select(*ENTRY, "chain", F.array_join(F.col("s.letter"), "").alias("sequence"))


@F.arrow_udf(DoubleType())
def _likeness(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([SequenceMatcher(a=x or "", b=y or "", autojunk=False).ratio() for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())


def likeness(a: Column, b: Column) -> Column:
    """Twice the characters in common blocks over all characters of both, from 0 to 1; the blocks are the longest ones, found from left to right."""
    return _likeness(a, b)


def resolved(wanted: DataFrame, known: DataFrame, like: float = LIKE) -> DataFrame:
    """wanted (file, block, chain, expected and others) with found (a chain of known, or null) and fault.

    A chain of that name is taken; else, of an entry's chains, the one most like the expected sequence if that is `like` or more, of
    equals the longer, then the first by name. Faults: `no such chain`, or `other sequence` where the chain's is not the expected one. known: sequences().
    """
    names = known.select(*ENTRY, F.col("chain").alias("found"), "sequence")
    own = wanted.withColumn("_n", F.monotonically_increasing_id())
    own = own.select("_n", *wanted.columns)
    exact = own.join(names.withColumn("chain", F.col("found")), [*ENTRY, "chain"], "left")
    missing = exact.where("found IS NULL AND expected <> ''").select("_n", *ENTRY, F.upper("expected").alias("_e"))
    bound = 2.0 * F.least(F.length("_e"), F.length("sequence")) / (F.length("_e") + F.length("sequence"))  # no two sequences of these lengths are more alike
    near = missing.join(names, ENTRY).where(bound >= like).withColumn("_r", likeness(F.col("_e"), F.upper("sequence"))).where(F.col("_r") >= like)
    order = F.struct(-F.col("_r"), -F.length("sequence"), "found")
    best = near.groupBy("_n").agg(F.min_by(F.struct("found", "sequence"), order).alias("_b"))
    both = exact.join(best, "_n", "left").withColumn("found", F.coalesce("found", "_b.found")).withColumn("sequence", F.coalesce("sequence", "_b.sequence"))
    fault = F.when(F.col("found").isNull(), "no such chain").when(F.col("expected").isNotNull() & (F.col("expected") != F.col("sequence")), "other sequence")
    return both.select(*wanted.columns, "found", "sequence", fault.alias("fault"))


def resolutions(spark: SparkSession, path: str) -> DataFrame:
    """file, block and resolution of each block that has atoms: the refinement's, else the microscope's, else the reflections'; 0 where there is none or a negative one."""
    out = cif.category(spark, path, "atom_site", ["id"]).select(*ENTRY).distinct()
    for k, (name, item) in enumerate((("refine", "ls_d_res_high"), ("em_3d_reconstruction", "resolution"), ("reflns", "d_resolution_high"))):
        one = cif.category(spark, path, name, [item]).groupBy(*ENTRY).agg(F.min_by(F.col(item).try_cast("double"), "row").alias(f"_{k}"))
        out = out.join(one, ENTRY, "left")
    return out.select(*ENTRY, F.greatest(F.coalesce("_0", "_1", "_2", F.lit(0.0)), F.lit(0.0)).alias("resolution"))


def ranges(spark: SparkSession, path: str) -> DataFrame:
    """file, block, chain, kind (`helix` or `strand`), first and last (numbers in the chain's sequence) of annotated stretches."""
    helix = cif.category(spark, path, "struct_conf", ["beg_auth_asym_id", "beg_label_asym_id", "beg_label_seq_id", "end_label_seq_id", "conf_type_id"]).where("conf_type_id LIKE 'HELX%'").withColumn("kind", F.lit("helix"))
    sheet = cif.category(spark, path, "struct_sheet_range", ["beg_auth_asym_id", "beg_label_asym_id", "beg_label_seq_id", "end_label_seq_id"]).withColumn("kind", F.lit("strand"))
    both = helix.drop("conf_type_id").unionByName(sheet)
    at = [F.col(c).try_cast("int").alias(n) for c, n in (("beg_label_seq_id", "first"), ("end_label_seq_id", "last"))]
    return both.select(*ENTRY, F.coalesce("beg_auth_asym_id", "beg_label_asym_id").alias("chain"), "kind", *at).where("first IS NOT NULL AND last IS NOT NULL")


def write_blocks(atoms: DataFrame, path: str) -> None:
    """Write atoms (block, chain, entity, polymer, model, seq, residue, atom, alt, occupancy, x, y, z) as CIF text, a data block for each block, places to three decimals.

    Rows go by model, chain, seq, atom and alt. A block is one string, so it has to fit a row.
    """
    dot = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    number = lambda c: F.format_string("%.3f", F.col(c))
    line = F.concat_ws(" ", F.when(F.col("polymer"), "ATOM").otherwise("HETATM"), dot("atom"), dot("alt"), "residue", "chain", dot("entity"), dot("seq"), "chain", number("x"), number("y"), number("z"), number("occupancy"), dot("model"))
    names = ["group_PDB", "label_atom_id", "label_alt_id", "label_comp_id", "label_asym_id", "label_entity_id", "label_seq_id", "auth_asym_id", "Cartn_x", "Cartn_y", "Cartn_z", "occupancy", "pdbx_PDB_model_num"]
    head = "".join(f"_atom_site.{n}\n" for n in names)
    kinds = F.concat_ws(" ", dot("entity"), F.when(F.col("polymer"), "polymer").otherwise("non-polymer"))
    own = atoms.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("model", "chain", "seq", "atom", F.coalesce("alt", F.lit("")), line.alias("line")))).alias("x"), F.array_sort(F.collect_set(kinds)).alias("kinds"))
    text = F.concat(
        F.lit("data_"), "block", F.lit("\nloop_\n_entity.id\n_entity.type\n"), F.array_join("kinds", "\n"), F.lit(f"\n#\nloop_\n{head}"), F.array_join(F.col("x.line"), "\n"), F.lit("\n#")
    )
    own.select(text.alias("value")).write.text(path)
