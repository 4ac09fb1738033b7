"""Vectors projected to the few directions in which they vary most, and exact quantiles of sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.places import stored

#: Cells of a histogram.
CELLS = 4096


def _whole(vector: str, size: int) -> Column:
    good = F.forall(F.col(vector), lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return (F.size(vector) == size) & good


def directions(df: DataFrame, vector: str, k: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, the k directions of largest variance (rows) and their variances (over n - 1) of vectors of `size` numbers; others are left out.

    Sums are taken in two passes, of the vectors and then of products around their mean, each task giving size ** 2 numbers. Each direction's largest entry is
    positive (of equal ones the first), so signs do not depend on how rows are dealt.
    """
    own = df.where(_whole(vector, size)).select(F.col(vector).cast("array<double>").alias("v"))

    def sums(centre: np.ndarray | None) -> np.ndarray:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size * size if centre is not None else size)
            n = 0
            for b in batches:
                x = pc.list_flatten(b.column("v")).to_numpy().reshape(-1, size)
                n += len(x)
                total += x.sum(0) if centre is None else ((x - centre).T @ (x - centre)).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total) + 1)), pa.array(np.append(total, float(n)))], names=["i", "x"])

        rows = own.mapInArrow(each, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()  # size ** 2 + 1 rows
        out = np.zeros((size * size if centre is not None else size) + 1)
        for r in rows:
            out[r["i"]] = r["x"]
        return out

    first = sums(None)
    n = first[-1]
    if n < 2:
        raise ValueError("two vectors are needed at least")
    mean = first[:-1] / n
    spread = sums(mean)[:-1].reshape(size, size) / (n - 1)
    values, vectors = np.linalg.eigh((spread + spread.T) / 2)
    rows = vectors.T[::-1][:k]
    largest = np.take_along_axis(rows, np.abs(rows).round(12).argmax(1)[:, None], 1)
    return mean, rows * np.where(largest < 0, -1.0, 1.0), values[::-1][:k]


def projected(df: DataFrame, vector: str, names: list[str], size: int) -> DataFrame:
    """df with a column for each name: the vector along the directions of largest variance, in order; null for vectors of another size or with numbers that are not finite."""
    mean, rows, _ = directions(df, vector, len(names), size)
    along = lambda row: F.aggregate(F.zip_with(F.col(vector), F.array(*(F.lit(float(x)) for x in row)), lambda a, b: a.cast("double") * b), F.lit(-float(row @ mean)), lambda s, x: s + x)
    return df.select("*", *(F.when(_whole(vector, size), along(r)).alias(n) for n, r in zip(names, rows)))


def quantiles(df: DataFrame, by: str, value: str, shares: list[float]) -> DataFrame:
    """by, n (values), n_missing (null or NaN), share and quantile, exact, between two values as far as the share lies between their ranks.

    Values are counted in cells of their range, then in cells of what the values of each cell with a wanted rank span, until such a cell holds one value only.
    Each turn reads the values again and counts CELLS cells at most for a wanted rank, so no task holds the values. Infinite values are an error. A set without
    values has null quantiles; null is a set.
    """
    raw = df.select(F.col(by).alias("_by"), F.col(value).cast("double").alias("_v")).withColumn("_v", F.when(~F.isnan("_v"), F.col("_v") + F.lit(0.0)))  # no negative zero
    stats = raw.groupBy("_by").agg(F.count("_v").alias("_n"), F.count_if(F.col("_v").isNull()).alias("_missing"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    far = F.assert_true(F.coalesce(F.col("_high") - F.col("_low") < float("inf"), F.lit(True)), "values and their range have to be finite")
    stats = stored(stats.where(far.isNull()), "sets")  # small tables are stored so that Spark knows their size when it joins them with the values
    spot = stats.select("*", F.explode(F.array(*map(F.lit, map(float, shares)))).alias("share")).withColumn("_at", F.col("share") * (F.col("_n") - 1))
    ranks = spot.where("_n > 0").select("_by", "_low", "_high", F.explode(F.array(F.floor("_at"), F.ceil("_at"))).alias("_first")).distinct().withColumn("_rank", F.col("_first"))
    while True:
        ranks = stored(ranks, "ranks")
        near = ranks.where("_low < _high").select(F.col("_by").alias("_b"), "_low", "_high").distinct()
        if near.isEmpty():
            break
        near = stored(near, "cells")
        width = (F.col("_high") - F.col("_low")) / CELLS
        cell = F.when(F.col("_v") >= F.col("_high"), CELLS - 1).when(width > 0, F.least(F.lit(CELLS - 1), F.floor((F.col("_v") - F.col("_low")) / width))).otherwise(0).cast("int")
        own = raw.join(near, F.col("_by").eqNullSafe(F.col("_b")) & (F.col("_v") >= F.col("_low")) & (F.col("_v") <= F.col("_high")))
        sizes = own.groupBy("_b", "_low", "_high", cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_m"), F.min("_v").alias("_to_low"), F.max("_v").alias("_to_high"))
        w = Window.partitionBy("_b", "_low", "_high").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # CELLS rows at most
        sizes = sizes.withColumn("_ahead", F.coalesce(F.sum("_m").over(w), F.lit(0)))
        same = F.col("_by").eqNullSafe(F.col("_b")) & (F.col("r._low") == F.col("s._low")) & (F.col("r._high") == F.col("s._high"))
        hit = ranks.alias("r").join(sizes.alias("s"), same & (F.col("_rank") >= F.col("_ahead")) & (F.col("_rank") < F.col("_ahead") + F.col("_m")))
        hit = hit.select("_by", F.col("_to_low").alias("_low"), F.col("_to_high").alias("_high"), "_first", (F.col("_rank") - F.col("_ahead")).alias("_rank"))
        ranks = ranks.where("_low = _high").unionByName(hit)
    side = lambda name: ranks.select(F.col("_by").alias(f"_b{name}"), F.col("_first").alias(f"_f{name}"), F.col("_low").alias(name))
    out = spot.drop("_low", "_high")
    for f, name in ((F.floor("_at"), "_lo"), (F.ceil("_at"), "_hi")):
        out = out.join(side(name), F.col("_by").eqNullSafe(F.col(f"_b{name}")) & (f == F.col(f"_f{name}")), "left")
    mid = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_at") - F.floor("_at"))
    return out.select(F.col("_by").alias(by), F.col("_n").alias("n"), F.col("_missing").alias("n_missing"), "share", mid.alias("quantile"))


def overlaid(df: DataFrame, digest: str, hidden: DataFrame, name: str = "hidden") -> DataFrame:
    """df with whether its digest is among those of hidden (one column of that name); null digests are not."""
    marks = hidden.select(F.col(digest).alias("_digest")).where("_digest IS NOT NULL").distinct()
    return df.join(marks, F.col(digest) == F.col("_digest"), "left").withColumn(name, F.col("_digest").isNotNull()).drop("_digest")


def in_sets(df: DataFrame, split: str, hidden: str = "hidden", train: str = "train") -> DataFrame:
    """df with `set`, a row for each set that a row is in: its split, `hidden_val` if it is hidden, else, if it is no training row, `non_train_source_pool`."""
    more = F.when(F.col(hidden), F.lit("hidden_val")).when(~F.col(split).eqNullSafe(F.lit(train)), F.lit("non_train_source_pool"))
    return df.withColumn("set", F.explode(F.array_distinct(F.array_compact(F.array(F.col(split), more)))))
