"""Candidates for a benchmark: fields read from JSON metadata by key presence, rules that refuse them, representatives of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classes as C
from ..functions.expressions import foreign_share, salted_score

#: Names under which metadata hold a field, letters of the standard residues, what a missing resolution reads.
SEQUENCE, RELEASE = ("sequence", "seq", "seqres", "aatype_sequence"), ("release_date", "pdb_release_date", "deposition_date")
STANDARD, NO_RESOLUTION = "ACDEFGHIKLMNPQRSTVWY", 999.0
#: Upper edges and names of bins of lengths and of resolutions.
LENGTH_BINS = ((64, "len_040_063"), (96, "len_064_095"), (128, "len_096_127"), (192, "len_128_191"))
RESOLUTION_BINS = ((1.5, "res_le_1p5"), (2.0, "res_1p5_2p0"), (2.5, "res_2p0_2p5"))


def _field(meta: Column, name: str) -> Column:
    return F.try_variant_get(meta, f"$.{name}", "variant")


def first_text(meta: Column, *names: str) -> Column:
    """Of a variant's fields, in order, the first that is a text with more than white space, trimmed; other fields are passed over."""
    texts = (F.when(F.schema_of_variant(_field(meta, n)) == "STRING", F.trim(F.try_variant_get(meta, f"$.{n}", "string"))) for n in names)
    return F.coalesce(*(F.nullif(t, F.lit("")) for t in texts))


def first_number(meta: Column, names: tuple[str, ...], default: Column, whole: bool = False) -> Column:
    """The first of the fields that is there, even if it is null, as a double; default if that is no number or text of one, or if none is there.

    whole: a text has to be that of a whole number. Fractions are kept; true reads 1.
    """
    value = F.coalesce(*(_field(meta, n) for n in names))
    kind, text = F.schema_of_variant(value), F.trim(F.try_variant_get(value, "$", "string"))
    number = text.try_cast("double")
    number = F.when(kind == "STRING", F.when(text.rlike(r"^[+-]?[0-9]+$"), number) if whole else number)
    number = number.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)"), F.try_variant_get(value, "$", "double")).when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("double"))
    return F.coalesce(number, default)


def read(chains: DataFrame, key: str = "chain_id", meta: str = "meta", whole: bool = True) -> DataFrame:
    """key, good, sequence, length, resolution, copies and release of JSON metadata (text).

    good: whether it is an object; others have no fields. A field that is there decides, so a null length is the sequence's, whatever its other name holds.
    whole: numbers of residues and copies written as text have to be whole, else they may be fractions, which are cut.
    """
    v = F.expr(f"try_parse_json(`{meta}`)")
    own = chains.select(key, v.alias("_v")).withColumn("_good", F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False)))
    own = own.select(key, "_good", F.when(F.col("_good"), F.col("_v")).alias("_v"))
    m = F.col("_v")
    own = own.withColumn("_s", F.upper(first_text(m, *SEQUENCE)))
    size = F.coalesce(F.length("_s"), F.lit(0)).cast("double")
    cut = lambda names, default: first_number(m, names, default, whole)
    towards_zero = lambda c, default: F.when(F.isnan(c), default).otherwise(F.signum(c) * F.floor(F.abs(c))).cast("long")
    return own.select(
        key, F.col("_good").alias("good"), F.col("_s").alias("sequence"), towards_zero(cut(("seq_length", "sequence_length"), size), size).alias("length"),
        first_number(m, ("resolution",), F.lit(NO_RESOLUTION)).alias("resolution"), towards_zero(cut(("oligomeric_count", "num_chains"), F.lit(1.0)), F.lit(1.0)).alias("copies"),
        first_text(m, *RELEASE).alias("release"),
    )


def _over(resolution: Column, most: float) -> Column:
    return (resolution != NO_RESOLUTION) & ~F.isnan(resolution) & (resolution > most)  # NaN is not above anything


def all_faults(least: int, most: int, coarsest: float, most_unknown: float) -> Column:
    """All rules that a row of read() breaks, in order; without a sequence that alone."""
    found = F.array(
        F.when(F.col("length") < least, F.lit("min_length")), F.when(F.col("length") > most, F.lit("max_length")), F.when(_over(F.col("resolution"), coarsest), F.lit("resolution")),
        F.when(F.col("copies") != 1, F.lit("oligomeric_count")), F.when(foreign_share("sequence", STANDARD) > most_unknown, F.lit("unknown_aa_fraction")),
    )
    return F.when(~F.col("good"), F.array(F.lit("bad_metadata"))).when(F.col("sequence").isNull(), F.array(F.lit("missing_sequence"))).otherwise(F.array_compact(found))


def first_fault(least: int, most: int, coarsest: float) -> Column:
    """The first rule that a row of read(), with accepted and payload (a map of texts), breaks; null if none."""
    p = C.payload_class(F.col("payload"))
    lacks = (p["class"] == "unknown") | p["helix"].isNull() | p["beta"].isNull() | p["coil"].isNull()
    return (
        F.when(~F.coalesce("accepted", F.lit(False)), "not_accepted_in_structure_metadata").when(~F.col("good"), "bad_metadata").when(F.col("sequence").isNull(), "missing_sequence")
        .when((F.col("length") < least) | (F.col("length") > most), "length").when(_over(F.col("resolution"), coarsest), "resolution").when(F.col("copies") != 1, "oligomeric_count")
        .when(F.coalesce(lacks, F.lit(True)), "missing_secondary_structure_metadata").when(p["architecture"] == "unknown", "missing_domain_architecture_metadata")
    )


def length_bin(length: Column) -> Column:
    """Name of a length's bin; the first has no lower bound and the last no upper one."""
    out = F.when(length < LENGTH_BINS[0][0], LENGTH_BINS[0][1])
    for edge, name in LENGTH_BINS[1:]:
        out = out.when(length < edge, name)
    return out.otherwise("len_192_256")


def resolution_bin(resolution: Column) -> Column:
    """Name of a resolution's bin; missing, 0 and 999 or more are unknown, NaN is in the last bin as it is below no edge."""
    out = F.when(resolution.isNull() | (resolution == 0) | (~F.isnan(resolution) & (resolution >= NO_RESOLUTION)), "res_unknown")
    for edge, name in RESOLUTION_BINS:
        out = out.when(resolution <= edge, name)
    return out.otherwise("res_2p5_3p0")


def representatives(rows: DataFrame, group: str, key: str, salt: str) -> DataFrame:
    """The row of each group that stands for it: a known class before an unknown one, the finer resolution (none, 0, NaN and 999 or more count 999), the
    longer sequence, the earlier release (a missing one first), the salted hash of the key, the key. rows: class, resolution, length, release and others."""
    r = F.col("resolution")
    fine = F.when(~F.isnan(r) & (r != 0) & (r < NO_RESOLUTION), r).otherwise(NO_RESOLUTION)
    order = F.struct(F.when(F.col("class") == "unknown", 1).otherwise(0), fine, -F.col("length"), F.coalesce("release", F.lit("")), salted_score(salt, key), F.col(key))
    return rows.groupBy(group).agg(F.min_by(F.struct(*(c for c in rows.columns if c != group)), order).alias("_r")).select(group, "_r.*")
