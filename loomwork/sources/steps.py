"""Sinks that can be taken up again: parts with commit records, lines cut back to a step, and rows that failed kept apart.

A part is written under a name of its own and counts once a small record names it, so a run that is killed leaves nothing half done, and one that is
repeated writes no part twice. One run at a time writes to a sink.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _records(folder: str) -> tuple[pafs.FileSystem, str, dict[int, str]]:
    store, path = pafs.FileSystem.from_uri(folder)
    at = f"{path}/commits"
    found = store.get_file_info(pafs.FileSelector(at, allow_not_found=True))
    out = {}
    for f in found:
        if f.is_file and f.base_name.endswith(".json"):
            with store.open_input_stream(f.path) as file:
                out[int(f.base_name[:-5])] = json.loads(file.read())["path"]
    return store, at, out


def append(rows: DataFrame, folder: str, step: int) -> bool:
    """Write rows as the part of a step, from 0, unless the sink has one; whether it did. Equal rows stay as often as they are there."""
    store, at, known = _records(folder)
    if step in known:
        return False
    path = f"{folder.rstrip('/')}/data/{step:012d}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    store.create_dir(at, recursive=True)
    with store.open_output_stream(f"{at}/{step:012d}.tmp") as file:
        file.write(json.dumps({"path": path}).encode())
    store.move(f"{at}/{step:012d}.tmp", f"{at}/{step:012d}.json")
    return True


def steps(folder: str) -> list[int]:
    """The steps that the sink has, rising."""
    return sorted(_records(folder)[2])


def cut_back(folder: str, last: int) -> int:
    """Take the parts of later steps out of the sink; how many there were."""
    store, at, known = _records(folder)
    late = [s for s in known if s > last]
    for s in sorted(late, reverse=True):
        store.delete_file(f"{at}/{s:012d}.json")
    return len(late)


def read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All rows of the sink with their `step`; a sink without parts has no rows."""
    known = _records(folder)[2]
    if not known:
        return spark.createDataFrame([], f"{schema}, step long")
    raw = spark.read.schema(schema).parquet(*known.values())
    return raw.withColumn("step", F.regexp_extract(F.col("_metadata.file_path"), "/data/([0-9]{12})-[0-9a-f]{32}/", 1).cast("long"))


def lines_up_to(lines: DataFrame, last: int, value: str = "value") -> DataFrame:
    """lines of JSON objects without blank ones and those whose `step` is later than last; a line that says no step, or is no object, stays."""
    step = F.expr(f"try_variant_get(try_parse_json(`{value}`), '$.step', 'double')")
    return lines.where((F.trim(value) != "") & ~F.coalesce(F.floor(step) > last, F.lit(False)))


def attempted(rows: DataFrame, work: Callable[[dict], dict], key: str, schema: str) -> DataFrame:
    """key, value (a struct of schema) and error of each row: what work makes of it, or what it raised, in the first line's words.

    work takes and gives a dict. A row that fails ends nothing else.
    """
    names = list(rows.columns)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False, name=None):
                given = dict(zip(names, r))
                try:
                    out.append((given[key], work(given), None))
                except Exception as e:  # any failure of the caller's work is a row of the result
                    out.append((given[key], None, f"{type(e).__name__}: {e}".split("\n")[0]))
            yield pd.DataFrame(out, columns=[key, "value", "error"])

    return rows.mapInPandas(each, f"`{key}` {rows.schema[key].dataType.simpleString()}, value struct<{schema}>, error string")


def outstanding(attempts: DataFrame, key: str, order: Column) -> DataFrame:
    """The last failure of each key that never succeeded; null is a key too."""
    seen = attempts.groupBy(key).agg(F.max(F.when(F.col("error").isNull(), True)).alias("_ok"), F.max_by("error", order).alias("error"))
    return seen.where("_ok IS NULL").select(key, "error")
