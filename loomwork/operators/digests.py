"""Digests of whole tables as trees: of buckets of rows, then of groups of buckets, up to one for the table.

A row is known by the sha256 of its fields, and its bucket is the first digits of that, so a row's place depends on nothing but the row. A bucket's
digest covers its rows' digests in order, with how often each occurs; a group's digest covers those of up to 16 buckets. Two tables
differ in the same buckets, and groups, wherever they were read and in whatever order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hexadecimal digits that name a bucket: 65,536 buckets.
DIGITS = 4


def row_digest(*fields: str) -> Column:
    """sha256 of a row's fields, each with its length before it, so that no two rows read the same; null is told from an empty text."""
    part = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    return F.sha2(F.concat_ws(",", *(part(c) for c in fields)), 256)


def buckets(df: DataFrame, fields: list[str], by: list[str] | None = None, digits: int = DIGITS) -> DataFrame:
    """by, prefix, n and digest of each bucket that has rows; by: a table is digested for each of its values.

    Repeated rows are counted before they meet in a bucket, so a bucket holds digests of different rows alone: about their number over 16 ** digits.
    """
    by = by or []
    own = df.select(*by, row_digest(*fields).alias("row")).groupBy(*by, "row").agg(F.count(F.lit(1)).alias("m"))
    line = F.concat("row", F.lit("\t"), F.col("m").cast("string"), F.lit("\n"))
    found = own.groupBy(*by, F.substring("row", 1, digits).alias("prefix")).agg(F.sum("m").alias("n"), F.array_sort(F.collect_list(line)).alias("x"))
    return found.select(*by, "prefix", "n", F.sha2(F.array_join("x", ""), 256).alias("digest"))


def tree(leaves: DataFrame, by: list[str] | None = None, digits: int = DIGITS) -> DataFrame:
    """by, prefix, n and digest of every level of buckets(), down to the empty prefix, which stands for all rows. A level's digest covers at most 16 lines."""
    by = by or []
    out = level = leaves
    for k in range(digits - 1, -1, -1):
        line = F.concat("prefix", F.lit("\t"), "digest", F.lit("\n"))
        level = level.groupBy(*by, F.substring("prefix", 1, k).alias("up")).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(line)).alias("x"))
        level = level.select(*by, F.col("up").alias("prefix"), "n", F.sha2(F.array_join("x", ""), 256).alias("digest"))
        out = out.unionByName(level)
    return out


def root(df: DataFrame, fields: list[str], by: list[str] | None = None, digits: int = DIGITS) -> DataFrame:
    """by, n and digest of all rows; a table without rows has no digest."""
    return tree(buckets(df, fields, by, digits), by, digits).where("prefix = ''").drop("prefix")


def changed(a: DataFrame, b: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, prefix, n_a and n_b of the buckets (or tree levels) of two tables that differ; one that only one table has counts 0 in the other."""
    keys = [*(by or []), "prefix"]
    other = b.select(*keys, F.col("n").alias("n_b"), F.col("digest").alias("_d"))
    both = a.withColumnRenamed("n", "n_a").join(other, keys, "full").where("NOT (digest <=> _d)")
    return both.select(*keys, F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))


def changed_rows(a: DataFrame, b: DataFrame, fields: list[str], digits: int = DIGITS) -> DataFrame:
    """fields, n_a and n_b of the rows that differ in how often two tables have them, looked for in changed buckets alone."""
    where = changed(buckets(a, fields, digits=digits), buckets(b, fields, digits=digits)).select("prefix")
    side = lambda d, name: d.select(*fields, F.substring(row_digest(*fields), 1, digits).alias("prefix")).join(where, "prefix", "left_semi").groupBy(*fields).agg(F.count(F.lit(1)).alias(name))
    one, two = side(a, "n_a"), side(b, "n_b").select(*(F.col(c).alias(f"_{c}") for c in fields), "n_b")
    same = F.lit(True)
    for c in fields:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    both = one.join(two, same, "full").where("NOT (n_a <=> n_b)")
    return both.select(*(F.when(F.col("n_a").isNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in fields), F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))


def split_lock(records: DataFrame, expected: DataFrame, split: str, key: str, fields: list[str], digits: int = DIGITS) -> DataFrame:
    """split, n (expected keys), n_missing (those without a record) and digest of the contents of the records that are there; none of them: null.

    records: key and fields. Keys that no split expects, and null ones, take no part; a key expected in two splits counts in both.
    """
    wanted = expected.select(split, key).where(F.col(key).isNotNull()).distinct()
    there = records.select(key).distinct().withColumn("_there", F.lit(True))
    counts = wanted.join(there, key, "left").groupBy(split).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_there").isNull()).alias("n_missing"))
    digest = root(wanted.join(records, key), [key, *(f for f in fields if f != key)], [split], digits).drop("n")
    return counts.join(digest, split, "left").select(split, "n", "n_missing", "digest")
