"""Substring dedup by repeated-phrase automata.

Which windows of WINDOW words recur is found without moving every window: each window has an anchor, the least
of its runs of ANCHOR words, and equal windows have equal anchors. Only windows whose anchor is in two documents
are compared over the corpus. What recurs is joined to phrases; every shard of documents compiles its own phrases
into an Aho-Corasick automaton over words and runs it over its documents; the hashes have decided the rows by then.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import table, written
from ._words import U, grams, slices, words

WINDOW, ANCHOR = 13, 4
LAST = (1 << 63) - 1
#: Ids that are sent to every executor at most.
MOST_SENT = 200_000


def _windows(texts: list[bytes], size: int) -> tuple[np.ndarray, ...]:
    """Word hashes, their texts; windows' hashes, whether inside one text, and anchors' hashes."""
    h, of = words(texts)
    w = grams(h, size)
    inside = of[: len(w)] == of[size - 1 :][: len(w)]
    k = min(ANCHOR, size)
    g = grams(h, k)
    least = g[: len(w)].copy()
    for i in range(1, size - k + 1):
        np.minimum(least, g[i : i + len(w)], out=least)
    return h, of, w, inside, least


def _unique(keys: np.ndarray, docs: np.ndarray, rows: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (key, doc, row) in that order, with the first of the rest; and whether one is the key's first."""
    order = np.lexsort((rows, docs, keys)) if rows.any() else np.lexsort((docs, keys))
    keys, docs, rows = keys[order], docs[order], rows[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    keep = new.copy()
    keep[1:] |= (docs[1:] != docs[:-1]) | (rows[1:] != rows[:-1])
    return keys[keep], docs[keep], rows[keep], new[keep], *(x[order][keep] for x in more)


def _rows(keys: np.ndarray, docs: np.ndarray, rows: np.ndarray, first: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    """Rows for the corpus-wide comparison. The least document of a key here stands for those after it, which are already
    known to have a smaller one with the key; they go under their documents (or texts), so a common key makes few rows. A value
    that equals its key is left out."""
    run = np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0)) if len(keys) else np.zeros(0, int)
    later = docs > docs[run]
    shared = np.zeros(len(keys), bool)
    shared[run[later]] = True
    shared = shared[run]
    own = np.where(later, np.where(rows == 0, docs, rows), keys.view(np.int64))
    return pa.RecordBatch.from_arrays(
        [pa.array(own), pa.array(docs), pa.array(value, mask=~later & (value == own)), pa.array(rows), pa.array(later), pa.array(shared)],
        names=["key", "doc", "value", "row", "later", "shared"],
    )


SCHEMA = "key long, doc long, value long, row long, later boolean, shared boolean"


def _sieve(rows: DataFrame) -> DataFrame:
    """rows whose key is in two documents, with whether a smaller document has it."""
    w = Window.partitionBy("key")
    least, most = F.min("doc").over(w), F.max("doc").over(w)
    return rows.select("doc", "row", F.coalesce("value", "key").alias("value"), (F.col("later") | (F.col("doc") > least)).alias("later"), (F.col("shared") | (most > least)).alias("shared"))


def anchors(docs: DataFrame, size: int) -> DataFrame:
    """doc, row and anchors: hashes of those of its anchors that two documents have."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, texts in slices(list(zip(b.column("doc").to_pylist(), b.column("row").to_pylist())), b.column("text").to_pylist()):
                _, of, w, inside, least = _windows(texts, size)
                at = of[: len(w)][inside]
                keys, d, r, first = _unique(least[inside], *(np.array(x, np.int64)[at] for x in zip(*ids)))
                yield _rows(keys, d, r, first, keys.view(np.int64))

    return _sieve(docs.mapInArrow(each, SCHEMA)).where("shared").groupBy("doc", "row").agg(F.collect_set("value").alias("anchors"))


def repeats(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc, row and places: starts (words from 0) of windows that also start in a document with a smaller doc.

    docs: doc and row (long, not null), text; other columns are ignored. Texts of one doc have different rows unless they are
    equal. Of a window that a text holds more than once one place is given. Texts without such windows have no row.
    """
    with_anchors = docs.join(anchors(docs.select("doc", "row", "text"), size), ["doc", "row"], "left")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = dict(zip(range(len(b)), b.column("anchors").to_pylist()))
            for at, texts in slices([i for i in range(len(b)) if held[i]], [t for t, a in zip(b.column("text").to_pylist(), held.values()) if a]):
                _, of, w, inside, least = _windows(texts, size)
                ids, rows = (np.array([b.column(c)[i].as_py() for i in at], np.int64) for c in ("doc", "row"))
                # an anchor counts in the documents that are listed for it; as it is shared, that is all that hold it
                listed = np.array(list({x for i in at for x in held[i]}), np.int64).view(U)
                ok = inside & np.isin(least, listed)
                begins = np.searchsorted(of, np.arange(len(texts)))
                place = np.arange(len(w)) - begins[of[: len(w)]] if len(w) else np.zeros(0, int)
                keys, d, r, first, value = _unique(w[ok], ids[of[: len(w)][ok]], rows[of[: len(w)][ok]], place[ok].astype(np.int64))
                yield _rows(keys, d, r, first, value)

    return _sieve(with_anchors.mapInArrow(each, SCHEMA)).where("later").groupBy("doc", "row").agg(F.collect_list("value").alias("places"))


def _letters(h: np.ndarray) -> str:
    """A string with one character for each word, equal for equal words."""
    ids = np.unique(h, return_inverse=True)[1].ravel().astype(np.uint32) + 1
    ids[ids >= 0xD800] += 0x800  # beyond the surrogates
    return ids.tobytes().decode("utf-32-le")


def _covered(texts: list[bytes], docs: list[int], places: list[list[int] | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word of the texts whether a repeated phrase covers it; and each word's text.

    One automaton holds the phrases of this shard; a phrase applies to documents from the first that it was
    confirmed for on, as a still smaller one holds it.
    """
    h, of, w, inside, _ = _windows(texts, size)
    begins = np.searchsorted(of, np.arange(len(texts) + 1))
    starts = np.zeros(len(h) + 1, np.int32)
    again = np.zeros(len(w), bool)
    for i, p in enumerate(places):
        if p:
            own = slice(begins[i], max(begins[i], begins[i + 1] - size + 1))
            again[own] = np.isin(w[own], w[begins[i] + np.array(p)])
    again &= inside
    if not again.any():
        return np.zeros(len(h), bool), of
    letters, phrases = _letters(h), {}
    edge = np.diff(np.r_[0, again.astype(np.int8), 0])
    for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
        cuts = [s, *(begins[(begins > s) & (begins < e)]), e]
        for a, b in zip(cuts, cuts[1:]):
            phrase = letters[a : b + size - 1]
            phrases[phrase] = min(phrases.get(phrase, LAST), docs[of[a]])
    found = ahocorasick.Automaton()
    for phrase, doc in phrases.items():
        found.add_word(phrase, (len(phrase), doc))
    found.make_automaton()
    for i, doc in enumerate(docs):
        for end, (n, since) in found.iter(letters[begins[i] : begins[i + 1]]):
            if since <= doc:
                starts[begins[i] + end - n + 1] += 1
                starts[begins[i] + end + 1] -= 1
    return np.cumsum(starts[:-1]) > 0, of


def _told_apart(docs: DataFrame) -> DataFrame:
    """docs (doc_id, doc, text) with row: a hash of the text where texts of one doc may differ, else 0, which takes next to no
    room in what is shuffled. It follows from the row's content alone, so it is the same whenever docs are read, and equal
    rows, whose results are equal, share it."""
    h = F.xxhash64("text")
    several = docs.where(F.col("doc") < LAST).groupBy("doc").agg(F.min(h).alias("lo"), F.max(h).alias("hi")).where("lo < hi").select("doc", F.lit(True).alias("several"))
    several = written(several, "several")
    n = several.limit(MOST_SENT + 1).count()
    apart = F.col("doc") == LAST
    if n:
        docs = docs.join(F.broadcast(several) if n <= MOST_SENT else several, "doc", "left")
        apart = apart | F.col("several").isNotNull()
    return docs.select("doc_id", "doc", F.when(apart, h).otherwise(F.lit(0)).alias("row"), "text")


def cleaned(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept, the words that stay, joined by one space.

    A word goes if a window of `size` words covers it that also starts in a document with a smaller doc_id;
    windows are judged on the texts as they are. Null texts have no words. Rows without doc_id come after all others
    and have no order among themselves; equal doc_ids are not smaller than each other.
    """
    own = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    own = _told_apart(own)
    both = own.join(repeats(own, size), ["doc", "row"], "left")  # the same columns, so that one exchange of texts serves both joins
    kind = own.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, ids, places = (b.column(c).to_pylist() for c in ("doc", "doc_id", "places"))
            for at, texts in slices(list(range(len(b))), b.column("text").to_pylist()):
                gone, of = _covered(texts, [docs[i] for i in at], [places[i] for i in at], size)
                begins = np.searchsorted(of, np.arange(len(texts) + 1))
                out = []
                for j, i in enumerate(at):
                    mine = gone[begins[j] : begins[j + 1]]
                    kept = b" ".join(compress(texts[j].split(), ~mine))
                    out.append({"doc_id": ids[i], "n_words": len(mine), "n_removed": int(mine.sum()), "kept": kept.decode("utf-8", "surrogatepass")})
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("doc_id", b.column("doc_id").type), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]))

    return both.mapInArrow(each, f"doc_id {kind}, n_words long, n_removed long, kept string")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents that no window of 13 words repeats from a document with a smaller doc_id."""
    out = cleaned(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM w WHERE len(w) >= 13),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM p),
f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g),
c AS (SELECT DISTINCT doc_id, i + o AS i FROM g JOIN f USING (g), (SELECT unnest(range(0, 13)) AS o) WHERE first < doc_id),
k AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN (SELECT doc_id, count(*) AS n FROM c GROUP BY 1) x USING (doc_id)
LEFT JOIN (SELECT k.doc_id, string_agg(word, ' ' ORDER BY k.i) AS kept FROM k ANTI JOIN c ON k.doc_id = c.doc_id AND k.i = c.i GROUP BY 1) y USING (doc_id)"""
