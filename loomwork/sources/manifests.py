"""Id lists in the order of their files, and tables that have to cover or be disjoint."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classes as C
from ..operators.ordering import numbered_lines, placed


def _refuse(bad: DataFrame, column: str, what: str, most: int = 8) -> None:
    """Raise ValueError with the first of the values, if there are any."""
    some = [str(r[0]) for r in bad.select(column).orderBy(column).limit(most).collect()]
    if some:
        raise ValueError(f"{what}: {', '.join(some)}")


def ordered_ids(spark: SparkSession, path: str, missing: str = "error", empty: str = "error", repeated: str = "ok", indented_comments: bool = True) -> DataFrame:
    """line and id of the lines of a list that are neither blank nor comments, `line` being the line's number in the file.

    missing, empty and repeated say what a missing file, a list without ids and an id that occurs twice are: `error` or `ok`. indented_comments: whether a
    `#` after white space begins a comment too; if not, such a line is an id.
    """
    try:
        lines = numbered_lines(spark, path)
    except AnalysisException as e:
        if missing == "error" or e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "line long, id string")
    comment = F.startswith(F.trim("value") if indented_comments else F.col("value"), F.lit("#"))
    ids = lines.select("line", F.regexp_replace("value", r"^\s+|\s+$", "").alias("id"), comment.alias("_c")).where("id <> '' AND NOT _c").drop("_c")
    if empty == "error" and ids.isEmpty():
        raise ValueError(f"{path} has no ids")
    if repeated == "error":
        _refuse(ids.groupBy("id").count().where("count > 1"), "id", f"{path} has ids more than once")
    return ids


def combined(lists: dict[str, DataFrame]) -> DataFrame:
    """source, line and id of several lists; an id in two of them, or twice in one, is an error."""
    every = reduce(DataFrame.unionByName, (rows.withColumn("source", F.lit(name)) for name, rows in lists.items()))
    _refuse(every.groupBy("id").count().where("count > 1"), "id", "ids are in more than one place")
    return every.select("source", "line", "id")


def write_ordered(ids: DataFrame, path: str, order: str = "line") -> None:
    """Write ids, one to a line, in their order over all files; repeated ones stay."""
    ids.orderBy(order).select("id").write.text(path)


def partition_faults(splits: DataFrame, every: DataFrame, key: str) -> DataFrame:
    """key and fault where the splits (split, key) are no partition of every: `in two splits`, `in no split`, `not known`."""
    held = splits.groupBy(key).agg(F.count_distinct("split").alias("n"))
    both = every.select(key).distinct().withColumn("known", F.lit(True)).join(held, key, "full")
    fault = F.when(F.col("known").isNull(), "not known").when(F.col("n").isNull(), "in no split").when(F.col("n") > 1, "in two splits")
    return both.select(key, fault.alias("fault")).where("fault IS NOT NULL")


def cluster_map(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """member and representative, the last line's where a member has several, of the members asked for; one that no line names is an error.

    clusters: line, representative, member; members: member.
    """
    last = clusters.groupBy("member").agg(F.max_by("representative", "line").alias("representative"))
    out = members.select("member").distinct().join(last, "member", "left")
    _refuse(out.where("representative IS NULL"), "member", "the clusters do not cover")
    return out


def structure_metadata(spark: SparkSession, path: str) -> DataFrame:
    """chain_id, accepted and payload (a map of texts) of a JSON object with a list `chains`; the last of rows with one id counts, rows without one are left out.

    Errors: a file that is no such object; an accepted chain without class, shares or architecture; no accepted chain at all. The object has to fit one task.
    """
    whole = spark.read.text(path, wholetext=True).select(F.expr("try_parse_json(value)").alias("v"))
    rows = whole.select(F.schema_of_variant("v").startswith("OBJECT").alias("good"), F.expr("try_variant_get(v, '$.chains', 'array<variant>')").alias("c"))
    if not rows.where("good AND c IS NOT NULL").count():
        raise ValueError(f"{path} has no list of chains")
    flat = rows.select(F.posexplode("c").alias("at", "x")).where(F.schema_of_variant("x").startswith("OBJECT"))
    flat = flat.select("at", F.trim(F.try_variant_get("x", "$.chain_id", "string")).alias("chain_id"), F.expr("try_variant_get(x, '$', 'map<string,variant>')").alias("m")).where("chain_id <> ''")
    text = lambda c: F.when(~F.is_variant_null(c), F.try_variant_get(c, "$", "string"))
    held = flat.select("at", "chain_id", F.transform_values("m", lambda _, c: text(c)).alias("payload"), F.coalesce(F.try_variant_get(F.try_element_at("m", F.lit("accepted")), "$", "boolean"), F.lit(False)).alias("accepted"))
    out = held.groupBy("chain_id").agg(F.max_by(F.struct("accepted", "payload"), "at").alias("r")).select("chain_id", "r.*")
    p = C.payload_class(F.col("payload"))
    lacks: Column = (p["class"] == "unknown") | p["helix"].isNull() | p["beta"].isNull() | p["coil"].isNull() | (p["architecture"] == "unknown")
    _refuse(out.where(F.col("accepted") & lacks), "chain_id", "accepted chains lack a class, shares or an architecture")
    if out.where("accepted").isEmpty():
        raise ValueError(f"{path} has no accepted chains")
    return out
