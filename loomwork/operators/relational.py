"""Grouping, ranking, splitting and set operators over DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import salted_score


def merged(df: DataFrame) -> DataFrame:
    """df, for a join that sorts both sides and sends neither whole: rows made by explode are many times what Spark takes them for from the file's size."""
    return df.hint("merge")


def top_of_each(df: DataFrame, by: list[str], order: list[Column], n: int = 1, name: str = "place") -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= n)


def reasons(df: DataFrame, tests: list[tuple[str, Column]]) -> DataFrame:
    """df with first_reason (null if none holds) and all_reasons, in the tests' order; null tests do not hold."""
    found = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in tests)))
    return df.withColumn("all_reasons", found).withColumn("first_reason", F.get("all_reasons", F.lit(0)))


def counts_by_field(df: DataFrame, fields: list[str], *by: str) -> DataFrame:
    """by, field, value, n: how often each field has each value, in one pass."""
    long = df.select(*by, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("unknown")).alias("value")) for f in fields))).alias("x"))
    return long.groupBy(*by, "x.field", "x.value").agg(F.count(F.lit(1)).alias("n"))


def divergence(df: DataFrame, split: str, fields: list[str]) -> DataFrame:
    """split, field, jsd (base 2), tvd and max_dev of each split's distribution against that of all rows."""
    own = counts_by_field(df, fields, split)
    overall = own.groupBy("field", "value").agg(F.sum("n").alias("m"))
    splits = own.select(split, "field").distinct()
    both = splits.join(overall, "field").join(own, [split, "field", "value"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    whole = Window.partitionBy(split, "field")
    p, q = F.col("n") / F.sum("n").over(whole), F.col("m") / F.sum("m").over(whole)
    both = both.withColumn("p", p).withColumn("q", q).withColumn("h", (F.col("p") + F.col("q")) / 2)
    part = lambda c: F.when(F.col(c) > 0, 0.5 * F.col(c) * F.log2(F.col(c) / F.col("h"))).otherwise(0.0)
    gap = F.abs(F.col("p") - F.col("q"))
    return both.groupBy(split, "field").agg(F.sum(part("p") + part("q")).alias("jsd"), (0.5 * F.sum(gap)).alias("tvd"), F.max(gap).alias("max_dev"))


def allocate(strata: DataFrame, size: int, key: str, n: str = "n", share: str | None = None) -> DataFrame:
    """strata (a row for each) with alloc: size dealt in proportion to `share` (n if None), by largest remainders.

    First the whole parts, no more than a stratum has; then one more each by remainder, larger stratum, key; what is
    left fills the largest strata. Strata fit one machine: they are counts, not rows.
    """
    every = Window.partitionBy()
    weight = F.col(share or n)
    quota = F.lit(size) * weight / F.sum(weight).over(every)
    a = strata.withColumn("quota", quota).withColumn("part", F.least(F.floor("quota"), F.col(n)))
    room = (F.col("part") < F.col(n)) & (weight > 0)
    a = a.withColumn("left", F.lit(size) - F.sum("part").over(every)).withColumn("room", room)
    a = a.withColumn("turn", F.row_number().over(Window.partitionBy("room").orderBy(F.desc(F.col("quota") - F.floor("quota")), F.desc(n), key)))
    a = a.withColumn("part", F.col("part") + F.when(F.col("room") & (F.col("turn") <= F.col("left")), 1).otherwise(0))
    a = a.withColumn("left", F.lit(size) - F.sum("part").over(every)).withColumn("cap", F.col(n) - F.col("part"))
    before = F.coalesce(F.sum("cap").over(Window.partitionBy().orderBy(F.desc(n), key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fill = F.least(F.col("cap"), F.greatest(F.lit(0), F.col("left") - before))
    return a.withColumn("alloc", (F.col("part") + fill).cast("long")).select(*strata.columns, "alloc")


def stratified_sample(df: DataFrame, strata: str, key: str, size: int, salt: str) -> DataFrame:
    """size rows of df, dealt over strata as `allocate` does, the first of each by salted hash."""
    sizes = allocate(df.groupBy(strata).agg(F.count(F.lit(1)).alias("n")), size, strata).select(strata, "alloc")
    scored = df.withColumn("score", salted_score(salt, strata, key))
    ranked = scored.withColumn("rn", F.row_number().over(Window.partitionBy(strata).orderBy("score", key)))
    return ranked.join(F.broadcast(sizes), strata).where("rn <= alloc").drop("rn", "alloc")  # a row for each stratum


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the rows whose keys new has, and new."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def first_source(df: DataFrame, key: str, sources: list[str], source: str, value: str) -> DataFrame:
    """key and value from the first of the sources that has one."""
    rank = reduce(lambda c, x: c.when(F.col(source) == x[1], x[0]), enumerate(sources[1:], 1), F.when(F.col(source) == sources[0], 0))
    return df.where(F.col(value).isNotNull()).groupBy(key).agg(F.min_by(source, rank).alias(source), F.min_by(value, rank).alias(value))


def ordered_digest(df: DataFrame, key: str, value: str) -> DataFrame:
    """sha256 over `key, tab, value, line break` by key, for tables whose lines fit one row."""
    line = F.concat(F.col(key).cast("string"), F.lit("\t"), F.col(value).cast("string"), F.lit("\n"))
    rows = df.agg(F.array_sort(F.collect_list(F.struct(F.col(key), line.alias("line")))).alias("x"), F.count(F.lit(1)).alias("n"))
    return rows.select("n", F.sha2(F.array_join(F.transform("x", lambda y: y["line"]), ""), 256).alias("digest"))


def linked(df: DataFrame, node: str, attributes: list[str]) -> DataFrame:
    """node and component, the least node that shares an attribute's value, directly or through others.

    Minima pass from nodes to values and back until no label changes, however many rounds that takes; ids may be of any type that sorts.
    """
    pairs = df.select(node, F.explode(F.array(*(F.struct(F.lit(i).alias("kind"), F.col(a).cast("string").alias("value")) for i, a in enumerate(attributes)))).alias("x")).select(node, "x.kind", "x.value").where("value IS NOT NULL")
    label = df.select(node, F.col(node).alias("component")).distinct()
    while True:
        before = label
        least = pairs.join(label, node).groupBy("kind", "value").agg(F.min("component").alias("m"))
        near = pairs.join(least, ["kind", "value"]).groupBy(node).agg(F.min("m").alias("m"))
        label = label.join(near, node, "left").select(node, F.least("component", F.coalesce("m", "component")).alias("component"))
        hop = label.select(F.col(node).alias("component"), F.col("component").alias("up"))
        label = label.join(hop, "component").select(node, F.col("up").alias("component"))
        label = label.checkpoint() if label.sparkSession.conf.get("spark.checkpoint.dir", None) else label.persist()
        if label.join(before.withColumnRenamed("component", "was"), node).where("component <> was").isEmpty():
            return label
