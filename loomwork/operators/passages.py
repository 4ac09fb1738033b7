"""Passages that texts have in common, wherever they stand."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.places import freed, stored

#: Characters of a passage that its key is made of, and runs given out at once.
GRAM, BATCH = 16, 100_000


def _keys(text: str, size: int) -> np.ndarray:
    """For each passage of size characters, the least hash of its pieces of up to GRAM characters; equal passages have equal keys."""
    h, n, base = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64), 1, 0x9E3779B97F4A7C15
    while 2 * n <= min(GRAM, size):
        h, n, base = h[:-n] * np.uint64(base) + h[n:], 2 * n, base * base % 2**64
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    left, step = size - n, 1
    while left:
        by = min(step, left)
        h, left, step = np.minimum(h[:-by], h[by:]), left - by, step + by
    return h.view(np.int64)


def _runs(text: str | None, size: int, turn: int, turns: int) -> tuple[np.ndarray, list[str]]:
    """Key and text of each run of passages with one key, of size passages at most; a text shorter than a passage, or null, is one itself. Only keys of this turn."""
    n = len(text or "")
    if n < size:
        return (np.array([n]), [text]) if n % turns == turn else (np.array([], np.int64), [])
    keys = _keys(text, size)
    starts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
    parts = -(-np.diff(np.append(starts, len(keys))) // size)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    starts = np.repeat(starts, parts) + nth * size
    ends = np.append(starts[1:], len(keys)) + size - 1
    now = keys[starts] % turns == turn
    return keys[starts[now]], [text[i:j] for i, j in zip(starts[now].tolist(), ends[now].tolist())]


def shared(df: DataFrame, node: str, text: str, size: int, turns: int = 3) -> DataFrame:
    """Pairs node, least that link all nodes whose texts share a passage of size characters at any place (a shorter text: all of it).

    Passages with one key stand in one part as runs of text; runs that are alike count once, and only where a key has several are they
    taken apart into passages. Passages are compared as text, not by their keys. Runs are about seven times as large as compressed texts, so
    the keys are dealt to turns; each reads all texts, stores its pairs and frees what it shuffled. Null texts share nothing.
    """
    with freed(df.sparkSession):
        done = [stored(_turn(df, node, text, size, turn, turns), "passages") for turn in range(turns)]
    return reduce(DataFrame.unionByName, done)


def _turn(df: DataFrame, node: str, text: str, size: int, turn: int, turns: int) -> DataFrame:
    """Distinct pairs of shared() by the passages whose keys are of this turn."""
    rows = _dealt(df.where(F.col(node).isNotNull() & F.col(text).isNotNull()), node, text, size, turn, turns)
    same = Window.partitionBy("key", "run").orderBy("node")
    alike = Window.partitionBy("key")
    rows = rows.select("*", F.first("node").over(same).alias("least"), F.row_number().over(same).alias("nth"))
    rows = rows.select("*", (F.min("run").over(alike) != F.max("run").over(alike)).alias("several"))
    # a run that stood before links its node at once, and the first of each kind is taken apart
    rows = rows.where("node <> least OR (nth = 1 AND several)").select("node", "key", "least", F.explode(F.when(F.col("nth") == 1, _passages(size)).otherwise(F.array(F.lit(None).cast("string")))).alias("passage"))
    first = F.first("node").over(Window.partitionBy("key", "passage").orderBy("node"))
    return rows.select("node", F.when(F.col("passage").isNull(), F.col("least")).otherwise(first).alias("least")).where("node <> least").distinct().withColumnRenamed("node", node)


def in_several(df: DataFrame, group: str, text: str, size: int, turns: int = 3) -> DataFrame:
    """passage and n of each passage of size characters, at any place (a shorter text: all of it), that texts of several groups have; n is how many groups.

    Keys are dealt to turns as in `shared`. Keys that one group alone has are left out before runs are taken apart. Null texts count as one passage, null.
    """
    with freed(df.sparkSession):
        done = [stored(_several(df, group, text, size, turn, turns), "passages") for turn in range(turns)]
    return reduce(DataFrame.unionByName, done)


def _several(df: DataFrame, group: str, text: str, size: int, turn: int, turns: int) -> DataFrame:
    """in_several() by the passages whose keys are of this turn."""
    alike = Window.partitionBy("key")
    rows = _dealt(df, group, text, size, turn, turns, once=True).select("*", (F.min("node").over(alike) != F.max("node").over(alike)).alias("several"))
    rows = rows.where("several").select("key", "run", "node").distinct().select("key", "node", F.explode(_passages(size)).alias("passage"))
    return rows.groupBy("key", "passage").agg(F.count_distinct("node").alias("n")).where("n > 1").select("passage", "n")


def _passages(size: int) -> Column:
    """The passages of a run."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length("run") - (size - 1), F.lit(1))), lambda i: F.substring("run", i, F.lit(size)))


def _dealt(df: DataFrame, node: str, text: str, size: int, turn: int, turns: int, once: bool = False) -> DataFrame:
    """node, key and run of all texts, by key; with once, a run that a node has again within the runs given out at once is left out."""
    own = df.select(F.col(node).alias("node"), F.col(text).alias("text"))

    def each(batches):
        for b in batches:
            at, keys, runs = [], [], []
            for i, x in enumerate(b["text"]):
                k, r = _runs(x.as_py(), size, turn, turns)
                at += [i] * len(r)
                keys.append(k)
                runs += r
                if len(runs) >= BATCH or i == len(b) - 1:
                    out = pa.Table.from_arrays([b["node"].take(pa.array(at, pa.int32())), pa.array(np.concatenate(keys), pa.int64()), pa.array(runs, pa.string())], ["node", "key", "run"])
                    yield from (out.group_by(out.column_names, use_threads=False).aggregate([]) if once else out).to_batches()
                    at, keys, runs = [], [], []

    return own.mapInArrow(each, f"node {own.schema['node'].dataType.simpleString()}, key long, run string").repartition("key")
