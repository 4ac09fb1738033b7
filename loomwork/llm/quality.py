"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted cyclically, one feature after another, and each feature's trees add up to one lookup
table over its bins; then the same for a few pairs of features. A score is a sum of table entries.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import fresh, short_batches, table, written

#: Labelled rows that the fit takes at most, by the order of a hash of doc_id.
MOST_LABELLED = 20_000
BINS, ROUNDS, RATE, LEAVES, PAIRS, PAIR_BINS, PAIR_ROUNDS = 32, 150, 0.1, 4, 6, 8, 60
THRESHOLD = 0.7
FEATURES = (
    "n_words", "mean_word", "long_words", "distinct", "top_word", "repeats", "symbols", "symbol_ends", "upper", "shouted", "digits",
    "marks", "stops", "bars", "lines", "same_lines", "accents", "words_a_stop", "capitals",
)
_SYMBOL = re.compile(r"[#$%&*@^~<>{}\[\]\\|+=_]")
_END = re.compile(r"[#$%&*]{2,}(?=\s|$)")


def features(text: str | None) -> list[float]:
    """Measures of a whole text, from the text alone; a null or empty text has 0 everywhere."""
    text = text or ""
    words, n = text.split(), len(text)
    if not words:
        return [0.0] * len(FEATURES)
    m = len(words)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    upper, stops = sum(map(str.isupper, text)), text.count(".")
    return [
        float(m), sum(map(len, words)) / m, sum(len(w) > 14 for w in words) / m, len(counts) / m, max(counts.values()) / m,
        sum(a == b for a, b in zip(words, words[1:])) / m, len(_SYMBOL.findall(text)) / n, len(_END.findall(text)) / m,
        upper / n, text.count("!") / m, sum(map(str.isdigit, text)) / n, sum(text.count(c) for c in ",;:?!\"'()-") / n,
        stops / m, text.count("|") / m, len(lines) / m, 1 - len(set(lines)) / max(1, len(lines)), sum(map("\x7f".__lt__, text)) / n,
        m / (1 + stops), sum(w[0].isupper() for w in words) / m,
    ]


@dataclass
class Model:
    """Lookup tables: base + sum of tables[f][bin of f] + sum of pairs[(f, g)][coarse bin of f, of g]."""

    base: float
    cuts: list[np.ndarray]
    tables: np.ndarray
    coarse: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 of rows of features."""
        z = np.full(len(x), self.base)
        low = []
        for f, cut in enumerate(self.cuts):
            b = np.searchsorted(cut, x[:, f], "right")
            z += self.tables[f][b]
            low.append(self.coarse[f][b])
        for (f, g), t in self.pairs.items():
            z += t[low[f], low[g]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _tree(grad: np.ndarray, weight: np.ndarray, leaves: int) -> np.ndarray:
    """Step for each bin from a tree that splits the bins' range best first; grad, weight: sums for each bin."""
    g, w = np.r_[0, np.cumsum(grad)], np.r_[0, np.cumsum(weight)]
    value = lambda a, b: (g[b] - g[a]) ** 2 / (w[b] - w[a] + 1)
    parts = [(0, len(grad))]
    while len(parts) < leaves:
        best = max(((value(a, s) + value(s, b) - value(a, b), a, s, b) for a, b in parts for s in range(a + 1, b) if w[s] - w[a] >= 5 and w[b] - w[s] >= 5), default=(0,))
        if best[0] <= 1e-6:
            break
        parts.remove((best[1], best[3]))
        parts += [(best[1], best[2]), (best[2], best[3])]
    out = np.zeros(len(grad))
    for a, b in parts:
        out[a:b] = (g[b] - g[a]) / (w[b] - w[a] + 1)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Fit on rows of features and labels 0 and 1. With no rows, or one label only, the score is a smoothed share."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    base, k = float(np.log(share / (1 - share))), len(FEATURES)
    if len(y) == 0 or y.min() == y.max():
        return Model(base, [np.zeros(0)] * k, np.zeros((k, 1)), [np.zeros(1, int)] * k, {})
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(k)]
    bins = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(cuts)]
    tables, z = np.zeros((k, BINS)), np.full(len(y), base)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, np.maximum(p * (1 - p), 1e-4)

    for _ in range(ROUNDS):
        for f in range(k):
            r, h = gradients()
            step = RATE * np.clip(_tree(np.bincount(bins[f], r, BINS), np.bincount(bins[f], h, BINS), LEAVES), -4, 4)
            tables[f] += step
            z += step[bins[f]]
    coarse = [np.arange(BINS) * PAIR_BINS // max(1, len(c) + 1) for c in cuts]
    coarse = [np.minimum(c, PAIR_BINS - 1) for c in coarse]
    low = [c[b] for c, b in zip(coarse, bins, strict=True)]
    cell = lambda f, g: low[f] * PAIR_BINS + low[g]
    r, h = gradients()
    gain = {}
    for f in range(k):
        for g in range(f + 1, k):
            a, b = np.bincount(cell(f, g), r, PAIR_BINS**2), np.bincount(cell(f, g), h, PAIR_BINS**2)
            gain[f, g] = float((a**2 / (b + 5)).sum())
    pairs = {p: np.zeros((PAIR_BINS, PAIR_BINS)) for p in sorted(gain, key=gain.get, reverse=True)[:PAIRS]}
    for _ in range(PAIR_ROUNDS):
        for (f, g), t in pairs.items():
            r, h = gradients()
            a, b = (np.bincount(cell(f, g), v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS) for v in (r, h))
            # a tree of depth two: one cut of f, then one of g on either side
            best = (-1.0, None)
            for s in range(1, PAIR_BINS):
                step = np.zeros_like(t)
                for rows in (slice(0, s), slice(s, None)):
                    step[rows] = _tree(a[rows].sum(0), b[rows].sum(0), 2)
                won = float((step * a - 0.5 * step**2 * b).sum())
                best = max(best, (won, step.tobytes()))
            step = RATE * np.clip(np.frombuffer(best[1]).reshape(t.shape), -4, 4)
            t += step
            z += step.ravel()[cell(f, g)]
    return Model(base, cuts, tables, coarse, pairs)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and x, the features of each text."""
    own = docs.select("doc_id", "text")
    kind = own.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([features(t.as_py()) for t in b.column("text")], pa.list_(pa.float64()))], names=["doc_id", "x"])

    return own.mapInArrow(each, f"doc_id {kind}, x array<double>")


def learn(known: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    """Fit on at most `most` rows of known (doc_id, x) with a label (doc_id, quality); null ids and labels are left out."""
    own = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("y"))
    rows = known.join(own, "doc_id").select("x", "y", F.xxhash64("doc_id").alias("h"), "doc_id").orderBy("h", "doc_id").limit(most).select("x", "y").collect()
    return fit(np.array([r["x"] for r in rows], float).reshape(-1, len(FEATURES)), np.array([r["y"] for r in rows], float))


def _held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every text of documents; null texts count as empty. A null doc_id is not held out and not learnt from."""
    known = written(measured(table(spark, sf_dir, "documents")), "quality")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~_held_out())
    model = learn(known, labels)
    kind = known.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(x))], names=["doc_id", "score"])

    scored = known.mapInArrow(each, f"doc_id {kind}, score double")
    return scored.select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text scores at least threshold, all columns as they were.

    The model is fitted on labelled texts, at most MOST_LABELLED of them. Labels decide nothing themselves.
    """
    short_batches(docs.sparkSession)
    chosen = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "quality", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(MOST_LABELLED).drop("h")
    # No more than MOST_LABELLED ids, so they can be sent to every executor.
    own = docs.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")
    model = learn(written(measured(own), "quality"), chosen)

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        return pd.Series(model.score(np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES))))

    (name,) = fresh(docs, "_score")
    return docs.withColumn(name, score("text")).where(F.col(name) >= threshold).drop(name)
