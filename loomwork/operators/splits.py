"""Splits of a pool: sequential stratified draws, their order, reports, gates and disjointness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import salted_score
from ..sources.places import stored
from .relational import allocate, counts_by_field, divergence


def drawn(pool: DataFrame, strata: str, key: str, size: int, salt: str, reference: DataFrame | None = None) -> DataFrame:
    """size rows of pool, dealt over strata in proportion to pool (or to reference), the first of each stratum by salted hash.

    A stratum's bound is found from counts of the hash's first digits, so only the rows of one digit group are ranked, not whole strata.
    With a reference, strata that it lacks get rows only once the others are empty.
    """
    sizes = pool.groupBy(strata).agg(F.count(F.lit(1)).alias("n"))
    if reference is not None:
        shares = reference.groupBy(strata).agg(F.count(F.lit(1)).alias("share"))
        sizes = sizes.join(shares, strata, "left").withColumn("share", F.coalesce("share", F.lit(0)))
    wanted = allocate(sizes, size, strata, share=None if reference is None else "share").select(strata, "alloc").where("alloc > 0")
    scored = pool.withColumn("_score", salted_score(salt, strata, key)).join(wanted, strata)
    grouped = scored.withColumn("_group", F.substring("_score", 1, 3))
    w = Window.partitionBy(strata).orderBy("_group")
    counts = grouped.groupBy(strata, "_group").agg(F.count(F.lit(1)).alias("_m"))  # 4096 groups of a stratum at most
    before = counts.withColumn("_before", F.sum("_m").over(w) - F.col("_m")).drop("_m")
    placed = grouped.join(before, [strata, "_group"])
    rank = F.row_number().over(Window.partitionBy(strata, "_group").orderBy("_score", key))
    return placed.where("_before < alloc").withColumn("_rank", rank).where("_before + _rank <= alloc").select(*pool.columns)


def in_order(chosen: DataFrame, key: str, salt: str) -> DataFrame:
    """chosen with `order`, a second salted hash by which a split is listed; ties go by key."""
    return chosen.withColumn("order", salted_score(f"{salt}:selected", key)).orderBy("order", key)


def sequential(pool: DataFrame, strata: str, key: str, sizes: list[tuple[str, int]], salt: str) -> DataFrame:
    """pool's rows that are drawn, with `split`: each split is drawn from what the ones before it left. Too small a pool is an error.

    key is unique and not null.
    """
    if (n := pool.count()) < sum(s for _, s in sizes):
        raise ValueError(f"{sum(s for _, s in sizes)} rows are needed, the pool has {n}")
    left, out = pool, None
    for name, size in sizes:
        own = stored(drawn(left, strata, key, size, f"{salt}:{name}").withColumn("split", F.lit(name)), "drawn")
        left = stored(left.join(own.select(key), key, "left_anti"), "left")  # else each draw's plan would hold those of all before
        out = own if out is None else out.unionByName(own)
    return out


def quality_report(splits: DataFrame, fields: list[str], unknown: str = "unknown") -> DataFrame:
    """One row: max_jsd over splits and fields against all rows, unknown_share (of fields' values), min_split_size."""
    jsd = divergence(splits, "split", fields).agg(F.coalesce(F.max("jsd"), F.lit(0.0)).alias("max_jsd"))
    values = counts_by_field(splits, fields).agg((F.sum(F.when(F.col("value") == unknown, F.col("n")).otherwise(0)) / F.sum("n")).alias("unknown_share"))
    least = splits.groupBy("split").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.min("n"), F.lit(0)).alias("min_split_size"))
    return jsd.crossJoin(values).crossJoin(least)  # a row each


def gate(report: DataFrame, max_jsd: float, max_unknown: float, large: int = 100) -> DataFrame:
    """report with `faults`; divergence counts only where every split has `large` rows or more."""
    found = F.array(F.when((F.col("min_split_size") >= large) & (F.col("max_jsd") > max_jsd), F.lit("divergence")), F.when(F.col("unknown_share") > max_unknown, F.lit("unknown")))
    return report.withColumn("faults", F.array_compact(found))


def shared_values(splits: DataFrame, attribute: str) -> DataFrame:
    """attribute and its splits where a value stands in more than one; nulls are no value. A disjoint partition gives no rows."""
    seen = splits.where(F.col(attribute).isNotNull()).select(attribute, "split").distinct()
    return seen.groupBy(attribute).agg(F.array_sort(F.collect_list("split")).alias("splits")).where(F.size("splits") > 1)
