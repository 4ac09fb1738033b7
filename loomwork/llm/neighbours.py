"""Approximate nearest neighbours by multiprobe p-stable hashing.

Largest inner product becomes least distance by one more coordinate that gives every vector the norm of the longest
one. A table hashes a vector to the cell of its K Gaussian projections; a query visits its own cell and perturbed
ones in the order of their estimated success. Cells are dealt out in parts of bounded size, and what the tables find
is merged and ranked by the exact measure.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import table, written

#: Projections of a table, width of a cell against the spread of projections, tables, cells visited in each.
K, WIDTH, TABLES, PROBES = 4, 2.0, 4, 16
#: Vectors and queries of a cell in one task.
PART = 8192


def _projections(dim: int, t: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([dim, t])
    a = np.linalg.qr(rng.normal(size=(dim, min(K, dim))))[0] * np.sqrt(dim)
    return a / WIDTH, rng.uniform(0, 1, a.shape[1])


def _perturbed(at: np.ndarray) -> list[np.ndarray]:
    """PROBES cells of a table by estimated success: those first whose changed coordinates lie nearest to the next cell."""
    home = np.floor(at)
    f = at - home
    moves = sorted([(x * x, j, -1) for j, x in enumerate(f)] + [((1 - x) ** 2, j, 1) for j, x in enumerate(f)])
    out, heap = [home], [(moves[0][0], (0,))]
    while heap and len(out) < PROBES:
        cost, chosen = heapq.heappop(heap)
        if len({moves[i][1] for i in chosen}) == len(chosen):
            cell = home.copy()
            for i in chosen:
                cell[moves[i][1]] += moves[i][2]
            out.append(cell)
        last = chosen[-1]
        if last + 1 < len(moves):
            heapq.heappush(heap, (cost - moves[last][0] + moves[last + 1][0], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (cost + moves[last + 1][0], (*chosen, last + 1)))
    return out


def _hashed(vectors: DataFrame, dim: int, longest: float, probes: bool) -> DataFrame:
    """id, vec and cell, a text `table:coordinates`; of queries one row for each visited cell."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            if not len(x):
                continue
            v = np.array(list(x.vec), float)
            top = np.abs(v).max(1)  # squares of very large components are beyond a double
            norm = top * np.sqrt(((v / top[:, None]) ** 2).sum(1))
            more = np.zeros(len(v)) if probes else np.sqrt(np.maximum(0, 1 - (norm / longest) ** 2))
            unit = np.c_[v / (norm[:, None] if probes else longest), more]
            for t in range(TABLES):
                a, b = _projections(dim + 1, t)
                at = unit @ a + b
                cells = [[f"{t}:" + ",".join(str(int(z)) for z in c) for c in (_perturbed(p) if probes else [np.floor(p)])] for p in at]
                yield pd.DataFrame({"id": x.id, "vec": x.vec, "cell": cells}).explode("cell")

    return vectors.mapInPandas(each, "id long, vec array<double>, cell string")


def _best(n: int):
    """For mapping groups: each query's n best of the group's vectors, ties at the end included, with exact products."""

    def best(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(v):
            a, b, ids = np.array(list(q.q_vec), float), np.array(list(v.vec), float), v.id.to_numpy()
            for i0 in range(0, len(a), 256):
                part = a[i0 : i0 + 256]
                with np.errstate(over="ignore", invalid="ignore"):
                    near = part @ b.T
                good = (q.q_id.to_numpy()[i0 : i0 + 256, None] != ids[None]) & ~np.isnan(near)
                near[~good] = -np.inf
                least = np.partition(near, -n, axis=1)[:, -n] if near.shape[1] > n else np.full(len(part), -np.inf)
                slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(least), least, 0)))
                for i in range(len(part)):
                    at = np.flatnonzero((near[i] >= least[i] - slack[i]) & good[i])
                    s = np.zeros(len(at))
                    with np.errstate(over="ignore", invalid="ignore"):
                        for d in range(b.shape[1]):  # in one order for every pair, so that equal vectors score the same
                            s += part[i, d] * b[at, d]
                    at, s = at[~np.isnan(s)], s[~np.isnan(s)]
                    top = np.lexsort((ids[at], -s))[:n]
                    out.append(pd.DataFrame({"query_id": q.q_id.iat[i0 + i], "vec_id": ids[at[top]], "score": s[top]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})

    return lambda key, q, v: best(q, v)


def _matched(queries: DataFrame, vectors: DataFrame, n: int) -> DataFrame:
    """Best pairs of queries and vectors (id, vec, cell) in one cell. A cell with many of either is dealt out in parts."""
    parts = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias(name))
    sizes = parts(vectors, "vs").join(parts(queries, "qs"), "cell")  # a row for each cell
    number = lambda of: F.pmod(F.xxhash64("id"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    q = queries.join(sizes, "cell").withColumn("qp", number("qs")).withColumn("vp", every("vs")).select("cell", "qp", "vp", F.col("id").alias("q_id"), F.col("vec").alias("q_vec"))
    v = vectors.join(sizes, "cell").withColumn("vp", number("vs")).withColumn("qp", every("qs")).select("cell", "qp", "vp", "id", "vec")
    return q.groupBy("cell", "qp", "vp").cogroup(v.groupBy("cell", "qp", "vp")).applyInPandas(_best(n), "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, n: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the n vectors with the largest inner product that the probes find.

    Both inputs: id long, vec array<double>. Rows with a null id, a null, empty or zero vec, null or non-finite
    components, or a length other than the commonest take no part; of rows with one id each counts, the best first. A
    query never finds its own id, nor a vector with which its product is no number (an infinite sum of both signs); infinite products tie. Ties go to the smaller id. A query whose cells hold fewer than n others is
    compared with all vectors, in blocks.
    """
    whole = F.expr("id IS NOT NULL AND vec IS NOT NULL AND forall(vec, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf')) AND exists(vec, x -> x <> 0)")
    vectors = vectors.where(whole)
    common = vectors.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return vectors.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    dim = common["d"]
    vectors, queries = vectors.where(F.size("vec") == dim), queries.where(whole & (F.size("vec") == dim))
    top = F.expr("array_max(transform(vec, x -> abs(x)))")
    length = top * F.sqrt(F.aggregate(F.transform("vec", lambda x: x / top), F.lit(0.0), lambda a, x: a + x * x))
    longest, n_ids = vectors.agg(F.max(length), F.countDistinct("id")).first()
    found = _matched(_hashed(queries, dim, longest, True), _hashed(vectors, dim, longest, False), n)
    found = written(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), "found")
    enough = found.groupBy("query_id").count().where(F.col("count") >= min(n, n_ids - 1)).select("query_id")
    short = queries.join(enough, F.col("id") == F.col("query_id"), "left_anti").select("id", "vec")
    blocks = max(1, -(-n_ids // PART))
    rest = _matched(short.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda i: i.cast("string")))), vectors.withColumn("cell", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("string")), n)
    every = found.unionByName(rest).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return every.withColumn("rank", rank).where(F.col("rank") <= n).select("query_id", "rank", "vec_id", "score")


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of embeddings to each row whose vec_id is divisible by 20."""
    x = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    return nearest(x, x.where("id % 20 = 0"))
