"""Mixing sources to target weights by soft membership, on DataFrame functions alone.

A classifier fitted on a labelled table gives every document posteriors over domains. Least squares then finds a
nonnegative rate for each document such that the expected tokens of the domains meet their targets. Gradient steps,
each scaled by the domains' gram matrix over the documents that are not at 0 (so a rare domain moves as fast as
a common one), go on until no rate within its bounds would bring them nearer. A step needs a few sums for each domain over all
documents; a document's rate is 1 + p * m projected to 0 and MOST, with one multiplier m for each domain, so no
rates are stored between steps.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import fresh, table, written

#: Buckets of word hashes, labelled rows that the fit takes at most.
BUCKETS, MOST_LABELLED = 1 << 14, 20_000
#: Steps of a turn after which it counts as not converging, and turns; the slope or change relative to a target (or to LEAST, if that is more) that ends them, and the miss relative to a target that is warned of.
STEPS, CLOSE, LEAST, FAR = 200, 1e-5, 1e-2, 1e-2
#: The share of a miss that a turn has to change.
SLOW = 1e-3
#: How strongly a turn is held to the last one, at first and at least.
EDGES = 1e-2, 1e-6
#: The highest rate of a document, and so its copies.
MOST = 64.0
#: Shares of tokens.
TARGETS = {"good": 0.85, "poor": 0.1, "toxic": 0.05}


#: Upper-case letters and white space, and what they become.
FOLD = "ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", "abcdefghijklmnopqrstuvwxyz     "


def _words(docs: DataFrame, *carried: str) -> DataFrame:
    w = docs.select("row", *carried, F.explode(F.split(F.translate(F.coalesce("text", F.lit("")), *FOLD), " ")).alias("w"))
    return w.select("row", *carried, (F.col("w") != "").cast("int").alias("one"), F.pmod(F.xxhash64("w"), F.lit(BUCKETS)).cast("int").alias("bucket"))


def posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str]) -> DataFrame:
    """row, doc_id, tokens and p, an array of posteriors in the order of domains, for every row of docs (row, doc_id, text).

    labelled: doc_id, domain. The fit is naive Bayes over hashed words of at most MOST_LABELLED labelled rows, by
    the order of a hash of doc_id. A domain without labelled words has only its smoothed prior; a text without
    words gets the priors.
    """
    chosen = labelled.where("doc_id IS NOT NULL AND domain IS NOT NULL").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    chosen = chosen.select("doc_id", "domain", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(MOST_LABELLED).drop("h")
    known = docs.join(F.broadcast(chosen), "doc_id").select("row", "domain", "text")  # at most MOST_LABELLED ids
    own = _words(known, "domain").where("one = 1")
    counts = written(own.groupBy("bucket").agg(*(F.count_if(F.col("domain") == d).alias(f"c{k}") for k, d in enumerate(domains))), "counts")
    totals = counts.agg(*(F.coalesce(F.sum(f"c{k}"), F.lit(0)).alias(f"c{k}") for k in range(len(domains)))).first()
    rows = known.agg(*(F.count_if(F.col("domain") == d) for d in domains)).first()
    prior = [math.log((r + 1) / (sum(rows) + len(domains))) for r in rows]
    none = [math.log(1 / (t + BUCKETS)) for t in totals]
    tables = counts.select("bucket", *(F.log((F.col(f"c{k}") + 1) / F.lit(float(t + BUCKETS))).alias(f"l{k}") for k, t in enumerate(totals)))
    said = _words(docs, "doc_id").join(F.broadcast(tables), "bucket", "left")  # at most BUCKETS rows
    z = said.groupBy("row", "doc_id").agg(
        F.sum("one").alias("tokens"), *((F.sum(F.col("one") * F.coalesce(f"l{k}", F.lit(none[k]))) + prior[k]).alias(f"z{k}") for k in range(len(domains)))
    )
    top = F.greatest(*(F.col(f"z{k}") for k in range(len(domains))))
    e = [F.exp(F.col(f"z{k}") - top) for k in range(len(domains))]
    return z.select("row", "doc_id", "tokens", F.array(*(x / sum(e[1:], e[0]) for x in e)).alias("p"))


def _near(at: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], goal: np.ndarray, centre: np.ndarray, edge: float) -> tuple[np.ndarray, np.ndarray]:
    """m with sums(m) + edge * (m - centre) = goal, and its sums: Newton steps on the convex function of which this is the gradient."""
    scale, m = np.maximum(np.abs(goal), LEAST), centre
    sums, gram = at(m)
    for _ in range(STEPS):
        slope = sums - goal + edge * (m - centre)
        if np.all(np.abs(slope) < CLOSE / 3 * scale):
            return m, sums
        way = -np.linalg.solve(gram + edge * np.eye(len(goal)), slope)
        fall, low, high, length = slope @ way, 0.0, None, 1.0
        for _ in range(STEPS):  # the slope along the way rises from fall; far beyond its zero the step is too long
            sums, gram = at(m + length * way)
            end = (sums - goal + edge * (m + length * way - centre)) @ way
            if end <= 0.5 * abs(fall) and (end >= -0.9 * abs(fall) or high is None):
                break
            low, high = (length, high) if end < 0 else (low, length)
            length = (low + high) / 2 if low else high * min(0.5, max(0.01, fall / (fall - end)))
        m = m + length * way
    raise ArithmeticError(f"rates have not converged: slope {slope.tolist()} for {goal.tolist()}")


def _solved(at: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], goal: np.ndarray) -> np.ndarray:
    """m with sums(m) as near to goal as it gets. at(m): the domains' sums and their gram matrix over rates between the bounds, both a token.

    Each turn keeps m near the last one, ever less so. Sums that meet the goal, or that a turn no longer changes (then no rates
    within the bounds come nearer), end it, or STEPS turns do.
    """
    m, miss, edge, scale = np.zeros(len(goal)), None, EDGES[0], np.maximum(np.abs(goal), LEAST)
    for _ in range(STEPS):
        m, sums = _near(at, goal, m, edge)
        before, miss = miss, sums - goal
        if np.all(np.abs(miss) < CLOSE * scale) or (before is not None and np.all(np.abs(miss - before) < np.maximum(CLOSE * scale, SLOW * np.abs(miss)))):
            return m
        edge = max(edge / 4, EDGES[1])
    return m


def rates(soft: DataFrame, targets: list[float], total: float | None = None, most: float = MOST) -> DataFrame:
    """soft (row, tokens, p) with rate: from 0 to most, such that the sums of rate * tokens * p come as near to
    targets * total as least squares can, and of such rates those nearest to 1. Without tokens the rates stay 1.

    total: tokens wanted in all, as many as there are if None. A target may be 0. Targets out of reach (a domain that few documents are
    likely of) are warned of with what was reached; `reached` gives it too.
    """
    k = len(targets)
    p = [F.get("p", F.lit(i)) for i in range(k)]
    tokens = soft.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    if not tokens:
        return soft.withColumn("rate", F.lit(1.0))
    goal = (total or tokens) / tokens * np.array(targets)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    last: list[np.ndarray] = []

    def rate(m: np.ndarray) -> Column:
        return F.least(F.lit(float(most)), F.greatest(F.lit(0.0), sum((x * F.lit(float(y)) for x, y in zip(p, m)), F.lit(1.0))))

    def at(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t = soft.select("p", "tokens", rate(m).alias("rate")).where("rate > 0")
        between = F.when(F.col("rate") < most, F.col("tokens")).otherwise(0)
        held = [*(F.col("tokens") * F.col("rate") * x for x in p), *(between * p[i] * p[j] for i, j in pairs)]
        rest = [float(x) / tokens for x in t.agg(*(F.coalesce(F.sum(x), F.lit(0.0)) for x in held)).first()]
        gram = np.zeros((k, k))
        for (i, j), x in zip(pairs, rest[k:]):
            gram[i, j] = gram[j, i] = x
        last[:] = [np.array(rest[:k])]
        return last[0], gram

    m = _solved(at, goal)
    if np.any(np.abs(last[0] - goal) > FAR * np.abs(goal)):
        warnings.warn(f"targets out of reach: {goal.tolist()} tokens a token wanted, {last[0].tolist()} reached", stacklevel=2)
    return soft.withColumn("rate", rate(m))


def reached(rated: DataFrame, names: list[str]) -> DataFrame:
    """domain, tokens (expected) and share of what rates() gave, a row for each domain."""
    sums = rated.agg(*(F.coalesce(F.sum(F.col("rate") * F.col("tokens") * F.get("p", F.lit(i))), F.lit(0.0)).alias(f"s{i}") for i in range(len(names))))
    every = sum((F.col(f"s{i}") for i in range(1, len(names))), F.col("s0"))
    rows = F.array(*(F.struct(F.lit(n).alias("domain"), F.col(f"s{i}").alias("tokens"), F.try_divide(F.col(f"s{i}"), every).alias("share")) for i, n in enumerate(names)))
    return sums.select(F.explode(rows).alias("x")).select("x.*")


def _domain() -> Column:
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")


def op8_mixing_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of all documents that bring good, poor and toxic tokens to TARGETS."""
    docs = table(spark, sf_dir, "documents").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    labelled = table(spark, sf_dir, "labels").select("doc_id", _domain().alias("domain"))
    names = sorted(TARGETS)
    soft = written(posteriors(docs, labelled, names), "soft")
    out = rates(soft, [TARGETS[d] for d in names])
    named = [F.get("p", F.lit(k)).alias(f"p_{d}") for k, d in enumerate(names)]
    return out.select("doc_id", F.col("tokens").alias("n_tokens"), *named, "rate")


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float], keep: str, spare: float = 1.1, most: float = 4.0) -> DataFrame:
    """docs, each row as often as its rate says, all columns as they were.

    A rate of 2.3 gives two copies and, by a hash of doc_id, a third for three in ten. The total is set so
    that the domain `keep` has `spare` times its tokens, so rows of it are not lost; no row is there more than `most` times. Null and empty texts have no tokens and the
    priors as posteriors; repeated rows count each; no rows in give no rows out.
    """
    names = sorted(targets)
    row, rate, many, nth = fresh(docs, "_row", "_rate", "_n", "_copy")
    own = written(docs.withColumn(row, F.monotonically_increasing_id()), "mixing")
    soft = written(posteriors(own.select(F.col(row).alias("row"), "doc_id", "text"), labels.select("doc_id", _domain().alias("domain")), names), "soft")
    mass = soft.agg(F.sum(F.col("tokens") * F.get("p", F.lit(names.index(keep))))).first()[0] or 0.0
    out = rates(soft, [targets[d] for d in names], spare * mass / targets[keep] or None, most)
    luck = (F.pmod(F.xxhash64("doc_id", row), F.lit(1 << 20)) + 0.5) / (1 << 20)
    copies = own.join(out.select(F.col("row").alias(row), F.col("rate").alias(rate)), row).withColumn(many, F.floor(F.col(rate) + luck).cast("int")).where(F.col(many) >= 1)
    return copies.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(many)))).select(*docs.columns)
