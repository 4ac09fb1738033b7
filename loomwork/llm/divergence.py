"""Source divergence audit: how far the word use of the sources of a language lies apart.

Every source of a language gives each kept term a share, smoothed and in whole billionths. Terms whose counts are the same in
every source have the same shares everywhere, so terms are grouped by their sparse vector of counts, and each pair of sources is
compared once for a distinct vector and weighted by the number of its terms. The widest terms of a source are ranked one by one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import short_batches, table, written

WORD = re.compile(rb"[a-z\x80-\xff]+")
#: Documents of a language that a kept term is in, terms ranked for a source, what every count is raised by, units of a share.
LEAST, TOP, RAISED, UNITS = 30, 50, 5, 1_000_000_000
#: Terms that a task counts before it passes them on; parts that rows of one language or source are dealt to; numbers compared at once.
HELD, PARTS, BLOCK = 500_000, 64, 1 << 21


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents with it) of docs (text, lang, source; null is ''), summed.

    Terms are runs of letters A-Z, lower-cased, and of characters beyond ASCII.
    """
    short_batches(docs.sparkSession)
    own = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))

    def batch(group: tuple[str, str], said: Counter, held: Counter) -> pa.RecordBatch:
        terms = pa.array([w.decode("utf-8", "surrogatepass") for w in said], pa.string())
        lang, source = (pa.array([g] * len(said), pa.string()) for g in group)
        return pa.RecordBatch.from_arrays([lang, source, terms, pa.array(list(said.values()), pa.int64()), pa.array([held[w] for w in said], pa.int64())], names=["lang", "source", "term", "n", "docs"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for b in batches:
            for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text"))):
                said, held = groups.setdefault((lang, source), (Counter(), Counter()))
                own = Counter(WORD.findall(text.encode("utf-8", "surrogatepass").lower()))
                size -= len(said)
                said.update(own)
                held.update(own.keys())
                size += len(said)
                if size > HELD:
                    yield from (batch(g, *c) for g, c in groups.items())
                    groups, size = {}, 0
        yield from (batch(g, *c) for g, c in groups.items())

    parts = own.mapInArrow(counted, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNITS * (n + RAISED) / (total + RAISED * terms)), exact for totals up to 19 digits."""
    above = (n.cast("decimal(20,0)") + RAISED).cast("decimal(20,0)") * F.lit(UNITS).cast("decimal(10,0)")
    return F.call_function("div", above, total.cast("decimal(20,0)") + (RAISED * terms).cast("decimal(20,0)")) + 1


def shares(n: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """share() of whole numbers in numpy: a long division by thousands, exact while total + RAISED * terms is below 9.2e15."""
    below = total + RAISED * terms
    if np.any(below > (1 << 63) // 1000):
        raise OverflowError("too many occurrences for 64 bits")
    whole, rest = np.divmod(n + RAISED, below)
    for _ in range(3):
        step, rest = np.divmod(rest * 1000, below)
        whole = whole * 1000 + step
    return whole + 1


def _distances(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of distances of all pairs of sources (by their place in the language's list) over distinct vectors."""
    for b in rows:
        langs = b.column("lang").to_pylist()
        begins = [i for i in range(len(langs)) if not i or langs[i] != langs[i - 1]]
        for begin, end in zip(begins, [*begins[1:], len(langs)]):
            run = b.slice(begin, end - begin)
            total = np.array(run.column("totals")[0].as_py(), np.int64)
            terms, k = run.column("terms")[0].as_py(), len(total)
            sums = np.zeros((k, k), np.int64)
            for at in range(0, len(run), step := max(1, BLOCK // max(k, 1))):
                part = run.slice(at, step)
                places, counts = part.column("places"), part.column("counts")
                count = np.zeros((len(part), k), np.int64)
                sizes = np.array([len(x) if x.is_valid else 0 for x in places])
                count[np.repeat(np.arange(len(part)), sizes), places.flatten().to_numpy()] = counts.flatten().to_numpy()
                p = shares(count, total, terms) if terms else count
                times = part.column("times").to_numpy()[:, None]
                for i in range(k - 1):
                    sums[i, i + 1 :] += (np.abs(p[:, i + 1 :] - p[:, i : i + 1]) * times).sum(0)
            i, j = np.triu_indices(k, 1)
            yield pa.RecordBatch.from_arrays([pa.array([langs[begin]] * len(i), pa.string()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(sums[i, j])], names=["lang", "i", "j", "value"])


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank of docs (text, lang, source; null is ''); other columns are not read.

    Part `pair`: the item is another source of the language, the value the sum over all kept terms of the difference of both
    shares. Part `term`: the item is a kept term that the source has and uses more than its language does, the value that difference; `top` are
    ranked. A term is kept that `least` documents of the language have; repeated rows count each. Languages without
    kept terms give pairs of value 0; ties go by item; no rows in give none out.
    """
    counts = term_counts(docs)
    vector = F.array_sort(F.collect_list(F.struct("source", "n")))
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all"), vector.alias("vector")).where(F.col("docs") >= least)
    kept = written(kept.select("lang", "term", "all", "vector"), "kept-terms")

    names = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    flat = kept.select("lang", "term", "all", F.explode("vector").alias("x")).select("lang", "term", "all", "x.source", "x.n")
    own = names.join(flat.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").fillna(0, ["total"])
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("all").alias("said"))
    groups = written(own.join(langs, "lang", "left").fillna(0, ["terms", "said"]), "groups")

    # Languages are few and their terms many: rows of a language, and of a source, are dealt to PARTS parts.
    part = F.pmod(F.xxhash64("term"), F.lit(PARTS)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))
    listed = groups.groupBy("lang", "terms").agg(F.array_sort(F.collect_list(F.struct("source", "total"))).alias("sources"))
    lists = listed.select("lang", "terms", F.col("sources.source").alias("names"), F.col("sources.total").alias("totals"), every.alias("part"))
    vectors = kept.groupBy("lang", "vector").agg(F.count(F.lit(1)).alias("times"))
    vectors = vectors.withColumn("part", F.pmod(F.xxhash64("vector"), F.lit(PARTS)).cast("int"))
    both = lists.join(vectors, ["lang", "part"], "left").select(
        "lang", "terms", "totals", F.coalesce("times", F.lit(0)).alias("times"), F.transform("vector.n", lambda n: n).alias("counts"),
        F.transform("vector.source", lambda s: F.array_position("names", s).cast("int") - 1).alias("places"),
    )
    sums = both.sortWithinPartitions("lang").mapInArrow(_distances, "lang string, i int, j int, value long").groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    sums = sums.join(listed.select("lang", F.col("sources.source").alias("names")), "lang")
    a, b = F.get("names", "i"), F.get("names", "j")
    ends = F.explode(F.array(F.struct(a.alias("source"), b.alias("item")), F.struct(b.alias("source"), a.alias("item")))).alias("x")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = sums.select("lang", ends, "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value").withColumn("rank", F.row_number().over(order))

    known = groups.withColumn("part", every)
    used = flat.withColumn("part", part).join(known, ["lang", "source", "part"])
    more = share(F.col("n"), F.col("total"), F.col("terms")) - share(F.col("all"), F.col("said"), F.col("terms"))
    wide = used.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), more.alias("value")).where("value > 0")
    return pairs.unionByName(wide.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents."""
    return audit(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT row, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY 1, 2 HAVING count(DISTINCT row) >= {LEAST}),
l AS (SELECT g.lang, coalesce(any_value(v), 0)::HUGEINT AS v, coalesce(any_value(s), 0)::HUGEINT AS said FROM (SELECT DISTINCT lang FROM d) g
  LEFT JOIN (SELECT lang, count(*) AS v, sum(n) AS s FROM k GROUP BY 1) USING (lang) GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)::HUGEINT) // (total + 5 * v) AS p,
  1 + (1000000000 * (k.n + 5)::HUGEINT) // (said + 5 * v) AS q FROM s JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
pair AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
u AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= {TOP}"""
