"""Assembly and audit of records: first occurrences, annotated shares, row samples, padded batches, scattered values, fingerprints."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import merged

#: Ranges aimed at in a task.
PART = 500_000


def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of least `order` of each key (null is a key too); of rows that tie, the least."""
    row = F.struct(order, *(c for c in df.columns if c not in (order, key)))
    return df.groupBy(key).agg(F.min(row).alias("row")).select(*(F.col(key) if c == key else F.col(f"row.{c}").alias(c) for c in df.columns))


def annotated_shares(lengths: DataFrame, ranges: DataFrame, key: str, kinds: list[str]) -> DataFrame:
    """key and the share of its positions 1 to n that each kind of range covers; a position goes to the first of its kinds.

    lengths: key, n. ranges: key, kind, first, last (both inside). Parts outside 1 to n, empty ranges and other kinds count for nothing; without
    positions shares are null. Ranges are taken in the order of their starts, so positions are counted and none is made a row.
    """
    rank = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    n = max(ranges.sparkSession.sparkContext.defaultParallelism, math.ceil(ranges.count() / PART))  # so tasks do not grow with the table
    lengths = lengths.repartition(n, key)
    inside = merged(ranges.repartition(n, key)).join(lengths, key).select(key, rank.alias("rank"), F.greatest(F.col("first"), F.lit(1)).alias("s"), F.least("last", "n").alias("e")).where("rank > 0 AND s <= e")
    before = Window.partitionBy(key).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda i, c: F.when(F.col("rank") <= i, c)
    new = lambda i: upto(i, F.greatest(F.lit(0), F.col("e").cast("long") - F.greatest(F.col("s") - 1, F.max(upto(i, F.col("e"))).over(before))))
    fresh = inside.select(key, *(new(i).alias(f"_u{i}") for i in range(1, len(kinds) + 1)))
    counts = fresh.groupBy(key).agg(*(F.coalesce(F.sum(f"_u{i}"), F.lit(0)).alias(f"_u{i}") for i in range(1, len(kinds) + 1)))  # positions of the first i kinds
    counts = counts.select(key, *((F.col(f"_u{i}") - (F.col(f"_u{i - 1}") if i > 1 else F.lit(0))).alias(f"_{i}") for i in range(1, len(kinds) + 1)))
    share = lambda i: F.when(F.col("n") > 0, F.coalesce(F.col(f"_{i}"), F.lit(0)) / F.col("n"))
    return merged(lengths).join(counts, key, "left").select(key, *(share(i).alias(k) for i, k in enumerate(kinds, 1)))


def row_sample(rows: Column, depth: int, salt: str, key: Column) -> Column:
    """The first of rows and depth - 1 others in their order, drawn by salted hash of key and place; all if there are no more."""
    score = lambda p: F.sha2(F.concat_ws(":", F.lit(salt), key.cast("string"), p.cast("string")), 256)
    others = F.filter(F.sequence(F.lit(0), F.size(rows) - 1), lambda p: p > 0)
    drawn = F.slice(F.array_sort(F.transform(others, lambda p: F.struct(score(p), p.alias("p")))), 1, depth - 1)
    places = F.concat(F.array(F.lit(0)), F.array_sort(F.transform(drawn, lambda x: x["p"])))
    return F.when(F.size(rows) > 0, F.transform(places, lambda p: F.get(rows, p))).otherwise(rows)


def padded_batch(df: DataFrame, batch: str, arrays: dict[str, object]) -> DataFrame:
    """df with its arrays filled up to the longest of the batch, mask (true where the row has a value) and consistent (whether the row's arrays are equally long).

    arrays: column and what fills it. Null arrays read empty. The batch's length comes by a join, so a batch may have any number of rows.
    """
    first = next(iter(arrays))
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    own = df.select("*", F.greatest(*map(size, arrays), F.lit(0)).alias("_own"))
    both = own.join(own.groupBy(batch).agg(F.max("_own").alias("_all")).withColumnRenamed(batch, "_batch"), F.col(batch).eqNullSafe(F.col("_batch")))
    full = lambda c, x: F.concat(F.coalesce(F.col(c), F.array()), F.array_repeat(F.lit(x), F.col("_all") - size(c)))
    same = F.lit(True)
    for c in arrays:
        same = same & (size(c) == size(first))
    mask = F.transform(F.sequence(F.lit(1), F.col("_all")), lambda i: i <= F.col("_own"))
    return both.select(*(full(c, arrays[c]).alias(c) if c in arrays else c for c in df.columns), F.when(F.col("_all") > 0, mask).otherwise(F.array()).alias("mask"), same.alias("consistent"))


def scattered(length: Column, places: Column, values: Column, fill: object) -> Column:
    """An array of `length`, at places (from 0) the values, elsewhere fill; of a place named twice the last, places outside are left out."""
    at = lambda i: F.get(values, F.size(places) - F.array_position(F.reverse(places), i).cast("int"))
    return F.when(length > 0, F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.when(F.array_contains(places, i), at(i)).otherwise(F.lit(fill)))).otherwise(F.array())


def in_slots(points: Column, slots: int) -> Column:
    """Each point repeated for every slot."""
    return F.transform(points, lambda p: F.array_repeat(p, slots))


def array_or(values: Column, length: Column, fill: object) -> Column:
    """values, or an array of fill where they are missing."""
    return F.coalesce(values, F.array_repeat(F.lit(fill), length.cast("int")))


def prune_report(records: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """One row: kept, removed and missing, numbers of distinct keys in both, in records alone and in expected alone; null is no key."""
    side = lambda d, name: d.select(key).where(F.col(key).isNotNull()).distinct().withColumn(name, F.lit(True))
    both = side(records, "r").join(side(expected, "e"), key, "full")
    return both.agg(F.count_if(F.expr("r AND e")).alias("kept"), F.count_if(F.expr("r AND e IS NULL")).alias("removed"), F.count_if(F.expr("e AND r IS NULL")).alias("missing"))


def split_fingerprint(records: DataFrame, expected: DataFrame, split: str, key: str) -> DataFrame:
    """split, n (expected keys), n_missing (those without a record) and a checksum of the keys that are there.

    The checksum sums 48 bits of each distinct key's sha256: a quick test of keys by chance, not of contents. `digests.split_lock` covers both.
    """
    there = records.select(key).distinct().withColumn("_there", F.lit(True))
    bits = F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    both = expected.select(split, key).where(F.col(key).isNotNull()).distinct().join(there, key, "left")
    digest = F.coalesce(F.sum(F.when(F.col("_there"), bits)), F.lit(0)).cast("string")
    return both.groupBy(split).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_there").isNull()).alias("n_missing"), digest.alias("digest"))


def capped_background(df: DataFrame, kept: Column, cap: int, salt: str, key: str) -> DataFrame:
    """Rows that are kept anyway, and `cap` others, those first by salted hash of key."""
    score = F.sha2(F.concat_ws(":", F.lit(salt), F.col(key).cast("string")), 256)
    keep = F.coalesce(kept, F.lit(False))
    return df.where(keep).unionByName(df.where(~keep).orderBy(score, key).limit(cap))
