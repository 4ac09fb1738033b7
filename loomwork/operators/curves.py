"""Learning curves: area, axis checks, reports and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def auc(df: DataFrame, group: str, x: str, y: str, budget: float) -> DataFrame:
    """group, n_points, auc: trapezoids over budget (1 at least); one point gives its own y."""
    w = Window.partitionBy(group).orderBy(x)
    area = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2
    return df.withColumn("area", area).groupBy(group).agg(
        F.count(F.lit(1)).alias("n_points"),
        F.when(F.count(F.lit(1)) == 1, F.first(y)).otherwise(F.sum("area") / max(budget, 1.0)).alias("auc"),
    )


def axis_faults(df: DataFrame, group: str, x: str, last: float) -> DataFrame:
    """group and whether its axis starts at 0, rises strictly and ends at last."""
    w = Window.partitionBy(group).orderBy(x)
    return df.withColumn("step", F.col(x) - F.lag(x).over(w)).groupBy(group).agg(
        (F.min(x) == 0).alias("starts_at_0"), F.coalesce(F.min("step") > 0, F.lit(True)).alias("rises"), (F.max(x) == last).alias("ends_at_budget")
    )


def ranked(df: DataFrame, track: str, score: str, tiebreak: str, date: str) -> DataFrame:
    """df with rank in its track: NaN last, then tiebreak, then the earlier date."""
    low = lambda c: F.desc(F.nanvl(F.col(c), F.lit(float("-inf"))))
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(track).orderBy(low(score), low(tiebreak), date)))


def report(rows: DataFrame, group: str, x: str, step: str, main: str, components: list[str], budget: float) -> DataFrame:
    """group, component, n_points, auc, final, at_steps and at_samples (maps) of main and of each component of rows, one row for each checkpoint.

    A component that a checkpoint lacks (null) counts as main does there; NaN is a value. Axes are not checked here: see axis_faults.
    """
    names = [main, *(c for c in components if c != main)]
    long = rows.select(group, x, step, F.explode(F.array(*(F.struct(F.lit(c).alias("component"), F.coalesce(c, main).alias("y")) for c in names))).alias("e")).select(group, x, step, "e.*")
    own = long.withColumn("_curve", F.struct(group, "component"))
    area = auc(own, "_curve", x, "y", budget)
    pairs = lambda at: F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct(F.col(at).alias("k"), F.col("y").alias("v")))), lambda e: F.struct(e["k"].cast("string"), e["v"])))
    maps = own.groupBy("_curve").agg(F.max_by("y", x).alias("final"), pairs(step).alias("at_steps"), pairs(x).alias("at_samples"))
    return area.join(maps, "_curve").select(f"_curve.{group}", "_curve.component", "n_points", "auc", "final", "at_steps", "at_samples")
