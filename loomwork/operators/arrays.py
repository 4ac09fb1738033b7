"""Nested-array operators: crops, pads, profiles and pairwise kernels on points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import merged


def centre_crop(array: str, size: int) -> Column:
    """The middle `size` elements, all if there are fewer."""
    n = F.size(array)
    return F.slice(array, F.greatest(F.lit(0), F.floor((n - size) / 2).cast("int")) + 1, F.least(n, F.lit(size)))


def padded(array: str, size: Column, fill: Column) -> Column:
    """The array with fill up to size."""
    return F.concat(F.col(array), F.array_repeat(fill, F.greatest(size - F.size(array), F.lit(0)).cast("int")))


def points(df: DataFrame, key: str, array: str, n: int) -> DataFrame:
    """key, i, x, y, z: the array read as n points."""
    return df.select(key, F.col(array).alias("_a"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).select(
        key, "i", *(F.get("_a", F.col("i") * 3 + k).cast("double").alias(c) for k, c in enumerate("xyz"))
    )


def distances(pts: DataFrame, key: str, name: str) -> DataFrame:
    """key, i, j, name: distances of ordered pairs of different points of one key."""
    a, b = pts.alias("a"), pts.alias("b")
    d = F.sqrt(sum((F.pow(F.col(f"a.{c}") - F.col(f"b.{c}"), F.lit(2)) for c in "yz"), F.pow(F.col("a.x") - F.col("b.x"), F.lit(2))))
    return merged(a).join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.i") != F.col("b.i"))).select(F.col(f"a.{key}").alias(key), F.col("a.i").alias("i"), F.col("b.i").alias("j"), d.alias(name))


def lddt(pred: DataFrame, true: DataFrame, key: str, cutoff: float, steps: tuple[float, ...]) -> DataFrame:
    """key, lddt: mean over points of the share of neighbours nearer than cutoff whose distance is kept within steps (strictly).

    Points without neighbours are left out; a key none of whose points has one scores 0.
    """
    both = merged(distances(true, key, "dt").where(F.col("dt") < cutoff)).join(distances(pred, key, "dp"), [key, "i", "j"])
    kept = sum(((F.abs(F.col("dt") - F.col("dp")) < s).cast("double") for s in steps[1:]), (F.abs(F.col("dt") - F.col("dp")) < steps[0]).cast("double")) / len(steps)
    found = both.groupBy(key, "i").agg((F.sum(kept) / (F.count(F.lit(1)) + 1e-8)).alias("s")).groupBy(key).agg(F.avg("s").alias("lddt"))
    return true.select(key).distinct().join(found, key, "left").select(key, F.coalesce("lddt", F.lit(0.0)).alias("lddt"))
