"""Places in one order over a whole table, without one task that sees all rows.

Rows are dealt to ranges of the order, each range is sorted and numbered where it lies, and the sizes of the ranges before it, one number for
each, are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.places import stored

#: Bits of monotonically_increasing_id below the partition.
_BITS = 33


def _before(sizes: DataFrame, by: list[str], part: str, size: str, name: str) -> DataFrame:
    """sizes with `name`, the sum of `size` in the parts before, for each group of by; a row for each part of a table."""
    w = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn(name, F.coalesce(F.sum(size).over(w), F.lit(0)))


def placed(df: DataFrame, order: list[Column], name: str = "pos", total: str | None = None, ranges: int | None = None) -> DataFrame:
    """df with its rows' places, from 0, in an order; with `total`, also the number of rows.

    Rows that tie are put in the order in which they are read, so a hot value spreads over several ranges. ranges: how many, as many as there are shuffle
    partitions if None. No rows in give none out.
    """
    spark = df.sparkSession
    many = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = df.withColumn("_tie", F.monotonically_increasing_id())
    dealt = own.repartitionByRange(many, *order, F.col("_tie")).sortWithinPartitions(*order, F.col("_tie"))
    at = F.monotonically_increasing_id()
    kept = stored(dealt.withColumn("_at", at), "placed")
    part, place = F.shiftright("_at", _BITS), F.col("_at").bitwiseAND(F.lit((1 << _BITS) - 1))
    sizes = _before(kept.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")), [], "_part", "_n", "_ahead")  # a row for each range
    if total:
        sizes = sizes.withColumn(total, F.sum("_n").over(Window.partitionBy()))
    out = kept.withColumn("_part", part).join(F.broadcast(sizes.drop("_n")), "_part")
    return out.select(*df.columns, (F.col("_ahead") + place).alias(name), *([total] if total else []))


def tiled(df: DataFrame, order: list[Column], tiles: int, name: str = "tile") -> DataFrame:
    """df with its tile from 1 to tiles: equal runs in an order, the first ones a row longer where they cannot be equal."""
    own = placed(df, order, "_pos", "_total")
    size, more = F.floor(F.col("_total") / tiles), F.col("_total") % tiles
    long = more * (size + 1)
    tile = F.when(F.col("_pos") < long, F.floor(F.col("_pos") / (size + 1))).otherwise(more + F.floor((F.col("_pos") - long) / F.nullif(size, F.lit(0))))
    return own.withColumn(name, (tile + 1).cast("int")).drop("_pos", "_total")


def numbered_lines(spark: SparkSession, path: str, end: str | None = None) -> DataFrame:
    """file, line (from 0 in its file) and value of all lines below path, however the files were split; end: what ends a line, if no line break does.

    A split's lines are read in order; the lines of the splits before it are counted and added. Nothing is sorted.
    """
    raw = spark.read.option("recursiveFileLookup", "true").text(path, lineSep=end)
    own = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    own = stored(own, "lines")
    sizes = own.groupBy("file", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    sizes = _before(sizes, ["file"], "_block", "_n", "_ahead").drop("_n")
    return own.join(sizes, ["file", "_block"]).select("file", (F.col("_ahead") + F.col("_id") - F.col("_first")).alias("line"), "value")
