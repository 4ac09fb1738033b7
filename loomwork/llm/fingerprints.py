"""Document fingerprints by consistent weighted sampling, on DataFrame functions alone.

A text is a bag of words weighted by their counts. For each of K samples every word gets, from its hash alone,
r and c with a Gamma(2, 1) distribution and b uniform; with weight w it scores ln c - r * (t - b + 1), where
t = floor(ln w / r + b). The word with the least score is the sample. Two texts agree in a sample with
the probability of their generalised Jaccard similarity, sum of least weights over sum of greatest.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import table

#: Samples of a signature, rows aimed at in a bucket of neighbours, and most buckets (their bounds pass the driver).
K, BUCKET, MOST_BUCKETS = 32, 1000, 100_000
LEAST = -(1 << 63)


def _uniforms(h: Column, j: int, n: int) -> list[Column]:
    """n numbers in (0, 1) from a hash, for sample j."""
    out = []
    for i in range((n + 1) // 2):
        x = F.xxhash64(h, F.lit(j * 8 + i))
        out += [(x.bitwiseAND(F.lit(0xFFFFFFFF)) + 0.5) / 4294967296.0, (F.shiftrightunsigned(x, 32) + 0.5) / 4294967296.0]
    return out[:n]


def sample_score(h: Column, weight: Column, j: int) -> Column:
    """Score of a word in sample j; equal only for the same word at the same quantised weight."""
    u = _uniforms(h, j, 5)
    r, ln_c, b = -F.log(u[0] * u[1]), F.log(-F.log(u[2] * u[3])), u[4]
    return ln_c - r * (F.floor(F.log(weight.cast("double")) / r + b) - b + 1)


def signature_codes(bags: DataFrame, keys: list[str], weights: list[str], k: int = K, more: list[Column] | None = None) -> DataFrame:
    """For each weight column an array of k sample codes of each key.

    bags: one row for each key and word hash `h`, with integer weights; words of weight 0 take no part. A key
    with no weights gets the codes of the empty bag, which agree with each other only. more: further aggregates of a key's rows.
    """
    scores = [F.min(F.when(F.col(w) > 0, sample_score(F.col("h"), F.col(w), j))).alias(f"{w}_{j}") for w in weights for j in range(k)]
    least = bags.groupBy(*keys).agg(*scores, *(more or []))
    code = lambda c: F.xxhash64(c).bitwiseAND(F.lit(0xFFFFFFFF))
    return least.select(*keys, *(F.array(*(code(F.col(f"{w}_{j}")) for j in range(k))).alias(w) for w in weights), *least.columns[len(keys) + len(scores) :])


def likeness(a: Column, b: Column, k: int = K) -> Column:
    """Share of samples that agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.lit(float(k))


def _text(codes: Column) -> Column:
    return F.array_join(F.transform(codes, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most key, by binary search."""
    if not bounds:
        return F.lit(0)
    values = F.from_json(F.lit(json.dumps(bounds)), "array<bigint>")
    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1))

    def halve(s: Column, _: Column) -> Column:
        mid = F.expr("1").cast("int") * F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        up = (s["lo"] < s["hi"]) & (F.get(values, mid) <= key)
        return F.struct(F.when(up, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(up | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")), halve, lambda s: s["lo"])


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with bucket, place, guest and next_text, the text after it by descending doc_id.

    After the last row comes the first. Equal doc_ids go by descending text, null ones last. Buckets are ranges
    of doc_id with about BUCKET rows; the row that follows a bucket's last stands in it once more as a guest, so
    that no window spans the table.
    """
    keyed = docs.withColumn("key", F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)))
    n = min(MOST_BUCKETS, math.ceil(keyed.count() / BUCKET))
    cuts = keyed.stat.approxQuantile("key", [i / n for i in range(1, n)], 1 / (4 * n)) if n > 1 else []
    keyed = keyed.withColumn("own", _bucket(F.col("key"), sorted({int(x) for x in cuts})))
    tops = sorted((r["own"], r["top"]) for r in keyed.groupBy("own").agg(F.max("key").alias("top")).collect())  # a row for each bucket
    guests = [(top, tops[(i + 1) % len(tops)][0]) for i, (_, top) in enumerate(tops)]
    to = docs.sparkSession.createDataFrame(guests, "top long, host int")
    stands = F.array(F.struct(F.col("own").alias("bucket"), F.lit(False).alias("guest")), F.struct(F.col("host").alias("bucket"), F.lit(True).alias("guest")))
    placed = (
        keyed.join(F.broadcast(to), F.col("key") == F.col("top"), "left")  # a row for each bucket
        .select("doc_id", "key", "text", F.explode(F.filter(stands, lambda x: x["bucket"].isNotNull())).alias("at"))
        .select("doc_id", "key", "text", "at.bucket", "at.guest")
    )
    w = Window.partitionBy("bucket").orderBy("guest", F.desc("key"), F.desc("text"))
    return placed.select("doc_id", "text", "bucket", "guest", F.row_number().over(w).alias("place"), F.lead("text").over(w).alias("next_text"))


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text of documents, of its edited text, and their likeness.

    A null text counts as empty; empty texts are like each other alone. Repeated rows stay apart.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - cut), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), cut)))
    whole = [F.struct(F.lit(o).alias("o"), F.lit(1 - o).alias("e"), F.lit(0).alias("kind"), F.col(t).alias("t"), F.lit(None).cast("long").alias("fact")) for o, t in ((1, "text"), (0, "edited"))]
    digest = F.sha2("edited", 256)
    facts = [F.col("doc_id").cast("long"), F.when(~F.col("guest"), F.col("n_chars")), *(F.conv(F.substring(digest, 16 * i + 1, 16), 16, -10).cast("long") for i in range(4))]
    given = [F.struct(F.lit(0).alias("o"), F.lit(0).alias("e"), F.lit(k).alias("kind"), F.lit("").alias("t"), x.alias("fact")) for k, x in enumerate(facts, 1)]
    # A row's facts go the way of its words, as 64-bit numbers: so texts are dealt to buckets once, and nothing is joined.
    words = rows.select("bucket", "place", F.explode(F.array(*whole, *given)).alias("x")).select("bucket", "place", "x.o", "x.e", "x.kind", "x.fact", F.explode(F.split("x.t", r"\s+")).alias("word"))
    held = (F.col("word") != "").cast("int")
    h = F.when(F.col("kind") == 0, F.xxhash64("word")).otherwise(F.col("fact"))
    bags = words.groupBy("bucket", "place", "kind", h.alias("h")).agg(F.sum(F.col("o") * held).alias("own"), F.sum(F.col("e") * held).alias("edit"))
    kept = [F.max(F.when(F.col("kind") == k, F.col("h"))).alias(f"fact_{k}") for k in range(1, len(facts) + 1)]
    codes = signature_codes(bags, ["bucket", "place"], ["own", "edit"], more=kept)
    codes = codes.withColumn("after", F.lead("own").over(Window.partitionBy("bucket").orderBy("place"))).where("fact_2 IS NOT NULL")  # guests have no number of characters
    hexed = F.lower(F.concat(*(F.lpad(F.hex(f"fact_{k}"), 16, "0") for k in range(3, 7))))
    return codes.select(
        F.col("fact_1").alias("doc_id"), F.col("fact_2").alias("n_chars"), hexed.alias("edited_sha256"), _text(F.col("own")).alias("fingerprint"), _text(F.col("edit")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edit")).alias("near_edited"), likeness(F.col("own"), F.col("after")).alias("near_next"),
    )
