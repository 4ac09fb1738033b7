"""Text sources and sinks: id lists, JSON objects, cluster tables and FASTA-like records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ..functions import classes as C


def id_list(spark: SparkSession, path: str, inline_comments: bool = False) -> DataFrame:
    """id of every line that is neither blank nor a comment, in no order; with inline_comments `#` ends a line's id."""
    line = F.substring_index("value", "#", 1) if inline_comments else F.col("value")
    return spark.read.text(path).select(F.trim(line).alias("id")).where("id <> '' AND NOT startswith(id, '#')")


def repeated(ids: DataFrame) -> DataFrame:
    """id and n of ids that occur more than once."""
    return ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def json_object(spark: SparkSession, path: str, value: str | DataType) -> DataFrame:
    """key and value of one JSON object in a file, such as a small cache; the object must fit one task.

    A file that holds no object gives one row with a null key.
    """
    kind = value if isinstance(value, str) else value.simpleString()
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{kind}>").alias("m"))
    return whole.select(F.explode_outer("m").alias("key", "value"))


def cluster_table(spark: SparkSession, path: str) -> DataFrame:
    """representative and member of a table with tabs and no header; lines with fewer fields are left out."""
    return spark.read.csv(path, sep="\t", schema="representative string, member string").where("representative IS NOT NULL AND member IS NOT NULL")


def records(spark: SparkSession, path: str) -> DataFrame:
    """file, name and sequence of FASTA or A3M records, read in splits; a text before the first name is left out."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.input_file_name().alias("file"), F.regexp_replace("value", "^>", "").alias("v"))
    name = F.regexp_extract("v", r"^\s*(\S*)", 1)
    body = F.regexp_replace(F.regexp_replace("v", r"^[^\n]*", ""), r"\s+", "")
    return raw.select("file", name.alias("name"), body.alias("sequence")).where("name <> ''")


def _fields(lines: DataFrame, least: int) -> DataFrame:
    """line and p, its fields, of lines (value) that are neither blank nor a comment and have `least` fields."""
    line = F.trim(F.regexp_replace("value", r"\s+", " "))
    return lines.select(line.alias("line")).where("line <> '' AND NOT startswith(line, '#')").select("line", F.split("line", " ").alias("p")).where(F.size("p") >= least)


def cath_classes(lines: DataFrame) -> DataFrame:
    """chain and class of lines (value) of domain id and class code; shorter ids than five characters are left out."""
    own = _fields(lines, 2).where("length(p[0]) >= 5")
    return own.select(F.concat_ws("_", F.lower(F.expr("substr(p[0], 1, 4)")), F.expr("substr(p[0], 5, 1)")).alias("chain"), C.class_of_code(F.expr("p[1]")).alias("class"))


def scope_classes(lines: DataFrame) -> DataFrame:
    """chain and class of lines (value) of domain id, entry, chain and range, class string; a line without a chain is known by its domain id."""
    named = F.expr("trim(BOTH '_' FROM substring_index(p[2], ':', 1))")
    chain = F.when(named.isin("", "-", "."), C.chain_of_domain(F.expr("p[0]"))).otherwise(F.concat_ws("_", F.lower(F.expr("p[1]")), named))
    return _fields(lines, 4).select(chain.alias("chain"), C.class_of_sccs(F.expr("p[3]")).alias("class")).where("chain IS NOT NULL")


def ecod_classes(lines: DataFrame) -> DataFrame:
    """chain and class of lines (value): the first field that is a domain id (an e, six characters or more) and the line's words."""
    ids = F.transform(F.filter("p", lambda x: x.startswith("e") & (F.length(x) >= 6)), C.chain_of_domain)
    return _fields(lines, 1).select(F.get(F.array_compact(ids), F.lit(0)).alias("chain"), C.class_of_words(F.col("line")).alias("class")).where("chain IS NOT NULL")


def annotated(*lists: DataFrame) -> DataFrame:
    """chain and classes, distinct and sorted, over all lists; blank and unknown classes and missing chains are left out."""
    every = lists[0]
    for more in lists[1:]:
        every = every.unionByName(more)
    every = every.withColumn("class", F.trim("class")).where("chain IS NOT NULL AND class <> '' AND class <> 'unknown'")
    return every.groupBy("chain").agg(F.sort_array(F.collect_set("class")).alias("classes"))


def chosen_architecture(chains: DataFrame, sources: dict[str, DataFrame], fallback: str) -> DataFrame:
    """chains (chain and others) with architecture and source: from the first source, in order, whose first class by name is usable, else from the column `fallback`.

    sources: chain and class of each list. Of a source only the first class counts: if that says no more than that there is an annotation, the next source is asked.
    """
    out = chains
    picks = []
    for k, (name, rows) in enumerate(sources.items()):
        first = annotated(rows).select("chain", F.get("classes", F.lit(0)).alias(f"_{k}"))
        out = out.join(first, "chain", "left")
        value = C.architecture_of(F.col(f"_{k}"))
        picks.append(F.when(~value.isin("unknown", "cath_annotated", "scope_annotated"), F.struct(value.alias("architecture"), F.lit(name).alias("source"))))
    last = F.struct(C.architecture_of(F.col(fallback)).alias("architecture"), F.lit("fallback").alias("source"))
    return out.withColumn("_x", F.coalesce(*picks, last)).select(*chains.columns, "_x.*")


def keyword_classes(lines: DataFrame) -> DataFrame:
    """chain and class of JSON objects, one to a line (value), by the words in all their values at any depth; what is no object with a chain_id is left out;
    text after an object is not looked at.

    A line may give several classes: that it names a list, and one of structure.
    """
    own = lines.select(F.expr("try_parse_json(value)").alias("v")).where("v IS NOT NULL AND schema_of_variant(v) LIKE 'OBJECT%'")
    named = own.select(F.trim(F.expr("try_variant_get(v, '$.chain_id', 'string')")).alias("chain"), F.lower(F.array_join(leaves(F.col("v")), " ")).alias("words")).where("chain <> ''")
    has = lambda *words: F.col("words").rlike("|".join(words))
    kind = F.when(has("alpha") & has("beta"), "alpha_beta").when(has("helix", "alpha"), "alpha").when(has("sheet", "strand", "beta"), "beta")
    found = F.array_compact(F.array(F.when(has("cath"), F.lit("cath_annotated")), F.when(has("scop"), F.lit("scope_annotated")), kind))
    return named.select("chain", F.explode(found).alias("class"))


def leaves(value: Column) -> Column:
    """All values of a variant that hold no others, in order, as text; names of fields are no values."""
    # A text token of JSON is a value unless a colon follows it; numbers and words stand outside of texts.
    tokens = F.regexp_extract_all(F.to_json(value), F.lit(r'("(?:[^"\\]|\\.)*"(?:\s*:)?|[^\s{}\[\],:"]+)'), F.lit(1))
    return F.transform(F.filter(tokens, lambda t: ~t.endswith(":")), lambda t: F.coalesce(F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<string>")[0], F.lit("None")))


def plucked(value: Column, *path: str) -> Column:
    """The text at a path of fields of a variant; of a list on the way, or at the end, the first item. Null where a field is missing."""
    here = value
    item = lambda v: F.schema_of_variant(v).startswith("ARRAY")
    for name in path:
        here = F.when(item(here), F.try_variant_get(here, "$[0]", "variant")).otherwise(here)
        here = F.try_variant_get(here, f"$.{name}", "variant")
    here = F.when(item(here), F.try_variant_get(here, "$[0]", "variant")).otherwise(here)
    return F.try_variant_get(here, "$", "string")


def write_fasta(rows: DataFrame, path: str) -> None:
    """Write id and sequence as FASTA records, sorted by id over all files."""
    rows.orderBy("id").select(F.concat(F.lit(">"), "id", F.lit("\n"), "sequence").alias("value")).write.mode("errorifexists").text(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, length and sha256 of each file below path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def write_ids(ids: DataFrame, path: str) -> None:
    """Write distinct ids, one to a line, sorted over all files."""
    ids.select(F.col("id").cast("string").alias("value")).distinct().orderBy("value").write.mode("errorifexists").text(path)
