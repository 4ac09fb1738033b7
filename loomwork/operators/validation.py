"""Records of named arrays checked against a table of rules, in one pass and without looking into other records."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

INTS, FLOATS, BOOLS = ("int32", "int64"), ("float32", "float64"), ("bool",)
#: Names of Spark's types as records have them.
KINDS = {"int": "int32", "bigint": "int64", "float": "float32", "double": "float64", "boolean": "bool"}
_ENTRY = "struct<kind:string,shape:array<int>,low:double,high:double,whole:boolean>"


@dataclass(frozen=True)
class Rule:
    """What one array of a record has to be.

    dims: a number, or a name that stands for the same number throughout a record, given by the first rule that has it. also: other dims that
    will do. required: it has to be there; others are checked only if they are. stop: with a wrong rank nothing further is said of the record.
    low, high: bounds of its values, which then have to be finite too.
    """

    key: str
    kinds: tuple[str, ...]
    dims: tuple[str | int, ...]
    required: bool = True
    stop: bool = False
    low: float | None = None
    high: float | None = None
    also: tuple[tuple[str | int, ...], ...] = ()


#: What a record of features and one of labels have to hold.
FEATURES = (
    Rule("aatype", INTS, ("L",), stop=True),
    Rule("msa", INTS, ("N", "L")),
    Rule("deletions", INTS, ("N", "L")),
    Rule("template_aatype", INTS, ("T", "L")),
    Rule("template_ca_coords", FLOATS, ("T", "L", 3)),
    Rule("template_ca_mask", BOOLS, ("T", "L")),
    Rule("residue_index", INTS, ("L",), required=False),
    Rule("between_segment_residues", INTS, ("L",), required=False),
)
LABELS = (
    Rule("ca_mask", BOOLS, ("L",)),
    Rule("ca_coords", FLOATS, ("L", 3)),
    Rule("atom14_positions", FLOATS, ("L", 14, 3), required=False),
    Rule("atom14_mask", BOOLS, ("L", 14), required=False),
    Rule("residue_index", INTS, ("L",), required=False),
    Rule("resolution", FLOATS, (), required=False, also=((1,),)),
)


def gathered(rows: DataFrame, record: str, key: str = "key", kind: str = "kind", shape: str = "shape") -> DataFrame:
    """record and arrays, a map of each record's array descriptions, of one row for each array; a record's arrays are few. Of rows with one key the least counts."""
    one = rows.where(F.col(key).isNotNull()).groupBy(record, key).agg(F.min(F.struct(F.col(kind).alias("kind"), F.col(shape).alias("shape"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(True).alias("whole"))).alias("x"))
    named = one.groupBy(record).agg(F.map_from_entries(F.collect_list(F.struct(key, "x"))).alias("arrays"))
    return rows.select(record).distinct().join(named, record, "left").withColumn("arrays", F.coalesce("arrays", F.map_from_arrays(F.array(), F.array()).cast(f"map<string,{_ENTRY}>")))


def described(df: DataFrame, record: str, columns: list[str]) -> DataFrame:
    """record and arrays of a table whose columns are the arrays: nested to any depth, null meaning that the record has none. Of a ragged dimension the size is -1."""

    def entry(name: str) -> Column:
        kind, flat, shape = df.schema[name].dataType, F.col(name), []
        if isinstance(kind, ArrayType):
            shape.append(F.size(flat))
            kind = kind.elementType
            while isinstance(kind, ArrayType):
                width = F.transform(flat, lambda x: F.coalesce(F.size(x), F.lit(-1)))
                shape.append(F.when(F.size(flat) == 0, 0).when(F.array_min(width) == F.array_max(width), F.array_min(width)).otherwise(-1))
                flat, kind = F.flatten(flat), kind.elementType
        else:
            flat = F.array(flat)
        values = F.transform(flat, lambda x: x.cast("double"))
        sizes = F.array(*shape).cast("array<int>")
        good = F.forall(values, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
        own = F.struct(F.lit(KINDS.get(kind.simpleString(), kind.simpleString())).alias("kind"), sizes.alias("shape"), F.array_min(values).alias("low"), F.array_max(values).alias("high"), good.alias("whole"))
        return F.struct(F.lit(name).alias("key"), F.when(F.col(name).isNotNull(), own).alias("x"))

    there = F.filter(F.array(*map(entry, columns)), lambda e: e["x"].isNotNull())
    return df.select(record, F.map_from_entries(there).alias("arrays"))


def messages(rules: tuple[Rule, ...], arrays: Column) -> Column:
    """What is wrong with a record, in the order of the rules: first missing arrays, which end it; then kinds; then shapes; then values."""
    at = {r.key: F.try_element_at(arrays, F.lit(r.key)) for r in rules}
    there = {k: x.isNotNull() for k, x in at.items()}
    rank = {k: F.size(x["shape"]) for k, x in at.items()}
    size = lambda k, i: F.get(at[k]["shape"], F.lit(i))
    given: dict[str, tuple[str, int]] = {}
    for r in rules:
        for i, d in enumerate(r.dims):
            if isinstance(d, str):
                given.setdefault(d, (r.key, i))
    value = {d: F.when(there[k] & (rank[k] == len(next(r for r in rules if r.key == k).dims)), size(k, i)) for d, (k, i) in given.items()}
    shown = lambda k: F.concat(F.lit("("), F.array_join(at[k]["shape"].cast("array<string>"), ", "), F.lit(")"))
    only = lambda test, text: F.when(F.coalesce(test, F.lit(False)), text)

    def shape(r: Rule) -> list[Column]:
        fixed = lambda dims: reduce(lambda a, b: a & b, (size(r.key, i) == d for i, d in enumerate(dims) if isinstance(d, int)), rank[r.key] == len(dims))
        fits = reduce(lambda a, b: a | b, map(fixed, r.also), fixed(r.dims))
        out = [only(there[r.key] & ~fits, F.concat(F.lit(f"`{r.key}` must have shape ({', '.join(map(str, r.dims))}), got "), shown(r.key)))]
        for i, d in enumerate(r.dims):
            if isinstance(d, str) and given[d] != (r.key, i):
                off = there[r.key] & fixed(r.dims) & (size(r.key, i) != value[d])
                out.append(only(off, F.concat(F.lit(f"`{r.key}` dimension {i + 1} must equal {d}="), value[d].cast("string"), F.lit(", got "), size(r.key, i).cast("string"))))
        return out

    missing = F.array_compact(F.array(*(only(~there[r.key], F.lit(f"Missing key `{r.key}`")) for r in rules if r.required)))
    kinds = [only(there[r.key] & ~at[r.key]["kind"].isin(*r.kinds), F.concat(F.lit(f"`{r.key}` dtype must be {'/'.join(r.kinds)} (got "), at[r.key]["kind"], F.lit(")"))) for r in rules]
    shapes = [(r, shape(r)) for r in rules]
    ranges = []
    for r in rules:
        if r.low is not None or r.high is not None:
            bad = ~at[r.key]["whole"]
            bad = bad | (at[r.key]["low"] < r.low) if r.low is not None else bad
            bad = bad | (at[r.key]["high"] > r.high) if r.high is not None else bad
            ranges.append(only(there[r.key] & bad, F.lit(f"`{r.key}` must be finite and within [{r.low}, {r.high}]")))
    stops = reduce(lambda a, b: a | b, (F.coalesce(there[r.key] & (rank[r.key] != len(r.dims)), F.lit(False)) for r in rules if r.stop), F.lit(False))
    early = [m for r, found in shapes if r.stop for m in found]
    rest = [m for _, found in shapes for m in found] + ranges
    every = lambda found: F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
    return F.when(F.size(missing) > 0, missing).when(stops, every(kinds + early)).otherwise(every(kinds + rest))


def validated(records: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """records (with arrays, as gathered() and described() give them) with `faults`, empty where all is well; arrays that no rule names are not looked at."""
    return records.withColumn("faults", messages(rules, F.col("arrays"))).drop("arrays")
