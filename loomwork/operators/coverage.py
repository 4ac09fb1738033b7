"""Coverage of an embedding by a training set: neighbours in a graph, radii, and actual values against random replicates.

A graph table has row, neighbour and distance; a row may list itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import salted_score


def nearest_train(graph: DataFrame, train: DataFrame) -> DataFrame:
    """row, nearest: 0 for training rows, else the least distance to a neighbour in train (id); without one, the largest distance listed."""
    ids = train.select(F.col("id").alias("neighbour"), F.lit(True).alias("known")).distinct()
    own = train.select(F.col("id").alias("row"), F.lit(True).alias("own")).distinct()
    d = graph.join(ids, "neighbour", "left").groupBy("row").agg(F.min(F.when(F.col("known"), F.col("distance"))).alias("d"), F.max("distance").alias("far"))
    return d.join(own, "row", "left").select("row", F.when(F.col("own"), F.lit(0.0)).otherwise(F.coalesce("d", "far")).alias("nearest"))


def local_distance(graph: DataFrame, k: int) -> DataFrame:
    """row, distance: the k-th least distance to others; rows with fewer others have none."""
    w = Window.partitionBy("row").orderBy("distance", "neighbour")
    return graph.where("row <> neighbour").withColumn("rn", F.row_number().over(w)).where(F.col("rn") == k).select("row", "distance")


def coverage_at(nearest: DataFrame, by: str, radii: list[float]) -> DataFrame:
    """by, radius, covered: share of rows whose nearest distance is at most the radius."""
    each = nearest.select(by, "nearest", F.explode(F.array(*map(F.lit, radii))).alias("radius"))
    return each.groupBy(by, "radius").agg(F.avg((F.col("nearest") <= F.col("radius")).cast("double")).alias("covered"))


def against_random(actual: DataFrame, random: DataFrame) -> DataFrame:
    """metric, value, n, percentile (share of random values at most the actual one), tail (two-sided, 1 at most).

    actual: metric, value, one row each; random: metric, value of every replicate.
    """
    both = actual.join(random.select("metric", F.col("value").alias("drawn")), "metric")
    share = lambda test: F.avg(test.cast("double"))
    sums = both.groupBy("metric", "value").agg(F.count(F.lit(1)).alias("n"), share(F.col("drawn") <= F.col("value")).alias("percentile"), share(F.col("drawn") >= F.col("value")).alias("above"))
    return sums.select("metric", "value", "n", "percentile", F.least(F.lit(1.0), 2 * F.least("percentile", "above")).alias("tail"))


def capped(df: DataFrame, keep: str, key: str, most: int, salt: str) -> DataFrame:
    """All rows where the boolean column keep holds, and the first `most` others by salted hash."""
    rest = df.where(~F.coalesce(F.col(keep), F.lit(False))).withColumn("_score", salted_score(salt, key)).orderBy("_score", key).limit(most).drop("_score")
    return df.where(F.col(keep)).unionByName(rest)
