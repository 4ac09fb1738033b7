"""Hit lists of a profile search: blocks of aligned fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import numbered_lines

#: Rows of a block that hold no sequence.
NO_SEQUENCE = ("Consensus", "ss_dssp", "ss_pred", "ss_conf")


def hit_blocks(spark: SparkSession, path: str) -> DataFrame:
    """file, line and value, the text after the `>` of each hit, read in splits; what stands before a file's first hit is left out.

    line rises with a hit's place in its file.
    """
    raw = numbered_lines(spark, path, "\n>")
    headed = F.col("value").rlike(r"^(HH|Query |Command |Match_columns|No |\s*$)")
    return raw.where(~headed).withColumn("value", F.regexp_replace("value", "^>", ""))


def aligned_pairs(query: Column, template: Column, query_start: Column, template_start: Column) -> Column:
    """Structs q and t (places from 0) where two fragments of one length have both a residue; starts count from 1."""
    before = lambda text, i: F.length(F.translate(F.substring(text, F.lit(1), i), "-", ""))
    place = lambda i: F.struct((query_start - 1 + before(query, i)).alias("q"), (template_start - 1 + before(template, i)).alias("t"), i.alias("i"))
    full = lambda x: (F.substring(query, x["i"] + 1, F.lit(1)) != "-") & (F.substring(template, x["i"] + 1, F.lit(1)) != "-")
    every = F.filter(F.transform(F.sequence(F.lit(0), F.length(query) - 1), place), full)
    return F.when(F.length(query) > 0, F.transform(every, lambda x: F.struct(x["q"], x["t"]))).otherwise(F.array())


def hits(blocks: DataFrame) -> DataFrame:
    """blocks (value) with entry, chain, query and template (all fragments joined) and pairs, for hits that have any pair.

    A template fragment is paired with the query fragment last seen, if both starts are numbers and both are equally long. Blocks whose
    first word is no chain name are left out; a block is one row and ends where the next number line stands.
    """
    block = F.element_at(F.split("value", r"\nNo "), 1)
    words = F.transform(F.split(block, r"\r?\n"), lambda x: F.split(F.trim(x), r"\s+"))
    is_query = lambda p: (F.get(p, F.lit(0)) == "Q") & (F.get(p, F.lit(1)) == "query")
    is_template = lambda p: (F.get(p, F.lit(0)) == "T") & ~F.get(p, F.lit(1)).isin(*NO_SEQUENCE)
    kept = F.filter(words, lambda p: (F.size(p) >= 4) & (is_query(p) | is_template(p)))
    rows = F.transform(kept, lambda p: F.struct(is_query(p).alias("own"), F.get(p, F.lit(2)).try_cast("int").alias("start"), F.get(p, F.lit(3)).alias("text")))
    name = r"^\s*([0-9A-Za-z]{4})[_\-]?([0-9A-Za-z]+)(?:\s|$)"
    own = blocks.select("*", F.lower(F.regexp_extract("value", name, 1)).alias("entry"), F.regexp_extract("value", name, 2).alias("chain"), rows.alias("_rows")).where("entry <> ''")
    joined = lambda mine: F.array_join(F.transform(F.filter("_rows", lambda x: x["own"] == F.lit(mine)), lambda x: x["text"]), "")

    def step(state: Column, x: Column) -> Column:
        fits = ~x["own"] & x["start"].isNotNull() & state["start"].isNotNull() & (F.length(state["text"]) == F.length(x["text"]))
        found = F.struct(state["text"].alias("q"), x["text"].alias("t"), state["start"].alias("qs"), x["start"].alias("ts"))
        return F.struct(
            F.when(x["own"], x["start"]).otherwise(state["start"]).alias("start"), F.when(x["own"], x["text"]).otherwise(state["text"]).alias("text"),
            F.when(fits, F.concat(state["chunks"], F.array(found))).otherwise(state["chunks"]).alias("chunks"),
        )

    empty = F.array().cast("array<struct<q:string,t:string,qs:int,ts:int>>")
    start = F.struct(F.lit(None).cast("int").alias("start"), F.lit(None).cast("string").alias("text"), empty.alias("chunks"))
    chunks = F.aggregate("_rows", start, step, lambda s: s["chunks"])
    pairs = F.flatten(F.transform(chunks, lambda c: aligned_pairs(c["q"], c["t"], c["qs"], c["ts"])))
    return own.select(*blocks.columns, "entry", "chain", joined(True).alias("query"), joined(False).alias("template"), pairs.alias("pairs")).where(F.size("pairs") > 0)
