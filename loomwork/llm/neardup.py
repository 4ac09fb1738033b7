"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, star-shaped candidates.

Texts with one shingle set are one class. The classes' bands make buckets, and the least member of a bucket is its
centre; every member is a candidate with the one centre that it meets in most buckets. Candidates are confirmed on
the full sets. Buckets whose members then still lie in more than one component are looked at again by sketch: each
bucket gives a spanning forest of its look-alikes of different components, again and again until no edge of a forest is
refused, so that no link is lost to the choice of a centre and no group gives all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import fresh, scratch, table, written
from ._words import U, grams, mix, slices, words

#: Bins of a sketch, bands, and rows of a band: texts of a similarity of 0.8 share no band in 5 of a million cases, of 0.85 in 6 of a billion.
BINS, BANDS, ROWS = 256, 40, 6
#: Least percentage that these bands serve.
LEAST_PERCENT = 75
#: Members of a bucket that are looked at together, and ids that are sent to every executor at most.
PART, MOST_SENT = 4000, 200_000
#: Most shingles of a set whose sketch also has two bytes of each, so that its similarity to another such set is known but for chance equals.
SMALL = 512
#: Standard errors by which the likeness of two sketches may lie below the similarity asked for.
SLACK = 4.5
TARGET = ("d1", "d2", "n")


def shingles(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text and the text of each, by text, then hash."""
    h, of = words(texts, lower=True)
    n = np.bincount(of, minlength=len(texts))
    g = grams(h, k)
    inside = of[: len(g)] == of[k - 1 :][: len(g)]
    gs, ds = [g[inside]], [of[: len(g)][inside]]
    for d in np.flatnonzero((n > 0) & (n < k)):  # the whole sequence as one
        x = grams(h[of == d], int(n[d]))
        gs.append(x)
        ds.append(np.full(len(x), d))
    g, d = np.concatenate(gs), np.concatenate(ds)
    order = np.lexsort((g, d))
    g, d = g[order], d[order]
    first = np.ones(len(g), bool)
    first[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
    return g[first], d[first]


def minhashes(g: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """One-permutation MinHash of n sets: least hash in each bin; an empty bin takes that of the first full bin in its own random order."""
    out, full = np.zeros((n, BINS), U), np.zeros((n, BINS), bool)
    b = (g >> U(56)).astype(int)
    first = np.ones(len(g), bool)
    first[1:] = (b[1:] != b[:-1]) | (d[1:] != d[:-1])
    out[d[first], b[first]], full[d[first], b[first]] = g[first], True
    rows, bins = np.nonzero(~full & full.any(1)[:, None])
    t = 0
    while len(rows):
        t += 1
        to = (mix(bins.astype(U) * U(0x9E37) + U(t) * U(0x85EBCA6B)) % U(BINS)).astype(int)
        hit = full[rows, to]
        out[rows[hit], bins[hit]] = out[rows[hit], to[hit]]
        rows, bins = rows[~hit], bins[~hit]
    return out


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n (set size), d1 and d2 (digest of the set), bands, sketch (a byte for each bin) and small (two bytes for each
    shingle of sets of SMALL or fewer, else empty)."""
    own = docs.select("doc_id", "text")
    kind = own.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in slices(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                g, d = shingles(texts, k)
                m = len(texts)
                n = np.bincount(d, minlength=m)
                sums = [np.zeros(m, U), np.zeros(m, U)]
                for s, x in zip(sums, (mix(g ^ U(11)), mix(g ^ U(13)))):
                    np.add.at(s, d, x)
                mins = minhashes(g, d, m)
                band = np.zeros((m, BANDS), U)
                for i in range(ROWS):
                    band = mix(band ^ mins[:, i : BANDS * ROWS : ROWS])
                band = mix(band + np.arange(BANDS, dtype=U))
                sketch = (mins & U(255)).astype(np.uint8)
                ends = np.cumsum(n)
                codes = (g & U(0xFFFF)).astype(np.uint16)
                small = [codes[e - x : e].tobytes() if x <= SMALL else b"" for x, e in zip(n.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, batch.column("doc_id").type), pa.array(n, pa.int64()), *(pa.array(s.view(np.int64)) for s in sums),
                     pa.array(list(band.view(np.int64)), pa.list_(pa.int64())), pa.array([x.tobytes() for x in sketch], pa.binary()), pa.array(small, pa.binary())],
                    names=["doc_id", "n", "d1", "d2", "bands", "sketch", "small"],
                )

    return own.mapInArrow(each, f"doc_id {kind}, n long, d1 long, d2 long, bands array<long>, sketch binary, small binary")


def confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of pairs (a, b) with 100 * |A & B| >= percent * |A | B|, on the full shingle sets of docs."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    if ids.limit(MOST_SENT + 1).count() <= MOST_SENT:  # few enough to send; else both sides are shuffled
        texts = texts.join(F.broadcast(ids), "id", "left_semi")
    both = (
        pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
        .join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")
    )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            ta, tb = (batch.column(c).to_pylist() for c in ("ta", "tb"))
            turns = [x for p in zip(ta, tb) for x in p]
            for keys, texts in _pairs(list(zip(a, b)), turns):
                g, d = shingles(texts, k)
                pair = d // 2
                order = np.lexsort((g, pair))
                g, pair = g[order], pair[order]
                same = (g[1:] == g[:-1]) & (pair[1:] == pair[:-1])
                common = np.bincount(pair[1:][same], minlength=len(keys))
                union = np.bincount(pair, minlength=len(keys)) - common
                ok = (union > 0) & (100 * common >= percent * union)
                yield pa.RecordBatch.from_pylist([{"a": x, "b": y} for (x, y), good in zip(keys, ok) if good], schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return both.mapInArrow(each, "a long, b long")


def _pairs(keys: list, texts: list) -> Iterator[tuple[list, list[bytes]]]:
    step = 200
    for i in range(0, len(keys), step):
        yield keys[i : i + step], [(t or "").encode("utf-8", "surrogatepass") for t in texts[2 * i : 2 * (i + step)]]


def components(edges: DataFrame) -> DataFrame:
    """node and root, the least node reachable, of every node of edges (a, b).

    Large-star and small-star by turns until nothing changes; every round is written, so a lost executor costs one
    round. A node with very many neighbours is met by partial minima and a join that can be split.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
        before = tuple(state)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = written(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BINS)


def _may_link(alike: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of n and m shingles whose sketches agree in the share `alike` can have the similarity."""
    least, p = np.minimum(n, m), percent / 100
    return (100 * least >= percent * np.maximum(n, m)) & (alike >= p - SLACK * np.sqrt(p * (1 - p) / np.minimum(least, BINS)))


def _tested(stars: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Those of stars (a, b) that may be linked by size and sketch."""
    side = lambda c: sketches.select(F.col("rep").alias(c), F.col("sketch").alias(f"s{c}"), F.col("n").alias(f"n{c}"))
    both = stars.join(side("a"), "a").join(side("b"), "b")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            same = (_sketches(x.column("sa")) == _sketches(x.column("sb"))).mean(1)
            ok = _may_link(same, x.column("na").to_numpy(), x.column("nb").to_numpy(), percent)
            yield x.select(["a", "b"]).filter(pa.array(ok))

    return both.where("100 * least(na, nb) >= %d * greatest(na, nb)" % percent).mapInArrow(each, "a long, b long").distinct()


def _codes(column: pa.Array) -> np.ndarray:
    """The shingles' codes of small sets, a row for each set, filled up with 65536."""
    values = column.to_pylist()
    n = np.array([len(x) // 2 for x in values])
    out = np.full((len(n), n.max(initial=0)), 65536, np.int32)
    out[np.arange(out.shape[1]) < n[:, None]] = np.frombuffer(b"".join(values), np.uint16)
    return out


def _again(bands: DataFrame, sketches: DataFrame, roots: DataFrame, refused: DataFrame, percent: int) -> DataFrame:
    """Candidates of different components in one bucket that may be linked: key, a, b and forest.

    Members that are not of their bucket's commonest component look for partners in it. Small sets are known well enough by their codes: of
    their pairs a part of a bucket gives a spanning forest (forest is true), which stands for the others if all its edges are links.
    Of larger sets all pairs are given. Pairs that were refused before (b, and the array of its a) are left out.
    """
    label = sketches.join(roots, F.col("rep") == F.col("node"), "left").select("rep", "n", "sketch", "small", F.coalesce("root", "rep").alias("root"))
    of = label.groupBy("rep").agg(F.min("root").alias("root"))
    mixed = bands.join(of, "rep").groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    placed = bands.join(mixed, "key").join(of, "rep")
    main = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m")).groupBy("key").agg(F.max_by("root", F.struct("m", "root")).alias("main"), F.sum("m").alias("all"))
    rows = placed.join(main, "key").withColumn("parts", F.ceil(F.col("all") / PART).cast("int"))
    own, every = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    held = rows.select("key", "parts", "rep", own.alias("vp"), F.lit(False).alias("asks")).withColumn("qp", every)
    asks = rows.where("root <> main").select("key", "parts", "rep", own.alias("qp"), F.lit(True).alias("asks")).withColumn("vp", every)
    columns = ["key", "qp", "vp", "rep", "asks"]
    label = label.join(refused, F.col("rep") == F.col("b"), "left").drop("b")
    dealt = held.select(columns).unionByName(asks.select(columns)).join(label, "rep").repartition("key", "qp", "vp").sortWithinPartitions("key", "qp", "vp")

    def group(x: pa.Table) -> list[tuple[np.ndarray, ...]]:
        asking = x.column("asks").to_numpy()
        key, rep, root, n = (x.column(c).to_numpy() for c in ("key", "rep", "root", "n"))
        at, asks, out = np.flatnonzero(~asking), np.flatnonzero(asking), []
        if not len(at) or not len(asks):
            return out
        sketch, codes, part = _sketches(x.column("sketch")), _codes(x.column("small")), np.unique(root, return_inverse=True)[1]
        no = {(v, r) for r, vs in zip(rep.tolist(), x.column("refused").to_pylist()) for v in vs or ()}
        known = np.zeros(65537, bool)
        for q in asks[np.argsort(rep[asks], kind="stable")]:
            near = at[part[at] != part[q]]
            near = near[100 * np.minimum(n[near], n[q]) >= percent * np.maximum(n[near], n[q])]
            near = near[_may_link((sketch[near] == sketch[q]).mean(1), n[near], n[q], percent)]
            few = np.zeros(len(near), bool)
            if n[q] <= SMALL and len(near):
                few = n[near] <= SMALL
                some = near[few]
                known[codes[q, : n[q]]] = True
                common = np.minimum(known[codes[some]].sum(1), np.minimum(n[some], n[q]))
                known[codes[q, : n[q]]] = False
                fits = ~few
                fits[few] = 100 * common >= percent * (n[some] + n[q] - common)
                near, few = near[fits], few[fits]
            if no and len(near):
                new = np.array([(min(r, s), max(r, s)) not in no for r, s in zip(rep[near].tolist(), [int(rep[q])] * len(near))])
                near, few = near[new], few[new]
            if not len(near):
                continue
            some = near[few]
            some = some[np.argsort(rep[some], kind="stable")]
            some = some[np.unique(part[some], return_index=True)[1]]  # the least of each component
            part[np.isin(part, part[some])] = part[q]
            to = np.r_[some, near[~few]]
            out.append((key[to], np.minimum(rep[to], rep[q]), np.maximum(rep[to], rep[q]), np.arange(len(to)) < len(some)))
        return out

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for b in _and_end(batches):
            if b is not None:
                now = pa.Table.from_batches([b])
                rest = now if rest is None else pa.concat_tables([rest, now])
            if rest is None:
                continue
            keys = np.c_[tuple(rest.column(c).to_numpy().astype(np.int64) for c in ("key", "qp", "vp"))]
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            bounds = [0, *cuts.tolist(), *([len(keys)] if b is None else [])]
            found = [y for s, e in zip(bounds, bounds[1:]) for y in group(rest.slice(s, e - s).combine_chunks())]
            rest = rest.slice(bounds[-1])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["key", "a", "b", "forest"])

    return dealt.mapInArrow(pairs, "key long, a long, b long, forest boolean")


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches that have rows, then None."""
    yield from (b for b in batches if len(b))
    yield None


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable) and kept, for every row of docs.

    Words are lower-cased in A-Z; a set holds the distinct shingles of k words, or the whole sequence if there are
    fewer. Texts without words (null ones too) have no shingles and stay alone. Rows with one doc_id are one
    document that has the links of each of them. A null doc_id stays alone, its component_id null, and is kept.
    """
    if percent < LEAST_PERCENT:
        raise ValueError(f"the bands serve similarities of {LEAST_PERCENT} percent or more")
    known = written(signatures(docs.withColumn("doc_id", F.col("doc_id").cast("long")), k), "signatures")
    classes = known.where("n > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2", "n").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("small").alias("small")
    )
    classes = written(classes, "classes")
    sketches = classes.select("rep", "n", "sketch", "small")  # rows with one doc_id but different sets have several
    bands = classes.select("rep", F.explode("bands").alias("key"))
    shared = bands.groupBy("key").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("key", "a")
    bands = written(bands.join(shared, "key"), "bands")  # of the buckets with two members or more
    stars = bands.where("a < rep").groupBy("rep", "a").agg(F.count(F.lit(1)).alias("m")).groupBy("rep").agg(F.max_by("a", F.struct("m", -F.col("a"))).alias("a"))
    tested = written(_tested(stars.select("a", F.col("rep").alias("b")), sketches, percent), "pairs")
    links = written(confirmed(tested, docs, k, percent), "links")
    members = bands.select("key", "rep")
    while True:
        refused = tested.join(links, ["a", "b"], "left_anti").groupBy("b").agg(F.collect_list("a").alias("refused"))
        found = written(_again(members, sketches, components(links), refused, percent), "found")
        pairs = found.select("a", "b").distinct()
        if found.isEmpty():
            break
        new = written(confirmed(pairs, docs, k, percent), "links")
        tested, links = tested.unionByName(pairs), links.unionByName(new)
        # A bucket whose forest is all links is done; one with a refused edge is looked at again, without that edge.
        members = members.join(found.where("forest").join(new, ["a", "b"], "left_anti").select("key").distinct(), "key", "left_semi")
    # Rows with one doc_id but different sets: their classes share the document.
    twice = known.where("n > 0").join(classes.select(*TARGET, "rep"), list(TARGET)).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    roots = components(links.unionByName(twice.join(classes.select(F.col("rep").alias("b")).distinct(), "b", "left_semi").select("a", "b")))
    # Only classes of several rows or with links tell their rows anything new.
    of_class = classes.join(roots, F.col("rep") == F.col("node"), "left").where("rows > 1 OR root IS NOT NULL").select(*TARGET, F.coalesce("root", "rep").alias("root"))
    known = known.select("doc_id", *TARGET)
    out = known.where("n > 0").join(of_class, list(TARGET), "left").unionByName(known.where("n = 0").withColumn("root", F.lit(None).cast("long")))
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("root", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near-duplicate rows: that of least doc_id (a row without one comes last), then row.

    Every row is a text of its own here, so rows without doc_id are compared as all others are, and rows with one
    doc_id but texts that are not alike all stay. Of rows without words one stays for each doc_id (null too) and text.
    """
    row, doc, text, of = fresh(docs, "_row", "_doc", "_text", "_of")
    own = written(docs.withColumn(row, F.monotonically_increasing_id()), "near-docs")
    with scratch(docs.sparkSession):  # the steps' tables would fill the shared folder for all that follows
        found = near_duplicates(own.select(F.col(row).alias("doc_id"), "text"), k, percent).select(F.col("doc_id").alias(row), "n_shingles", "component_id")
        ids = own.select(row, F.col("doc_id").alias(doc), F.xxhash64("text").alias(text))
        words = F.col("n_shingles") > 0
        groups = found.join(ids, row).groupBy(
            F.when(words, F.col("component_id")).alias("a"), F.when(~words, F.col(doc)).alias("b"), F.when(~words, F.col(text)).alias("c")
        )
        stay = groups.agg(F.min(F.struct(F.col(doc).isNull().alias("n"), F.col(doc).alias("d"), F.col(row).alias("r"))).alias("m")).select(F.col("m.r").alias(of))
        stay = written(stay, "stay", keep=True)
    return own.join(stay, F.col(row) == F.col(of), "left_semi").select(*docs.columns)


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 3-word shingles have a Jaccard similarity of 0.85 or more."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), 3, 85)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
e AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
r AS MATERIALIZED (SELECT doc_id, n, g FROM e),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM r a JOIN r b ON a.g = b.g AND a.doc_id <> b.doc_id WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM c WHERE 100 * i >= 85 * (na + nb - i)),
p(doc_id, r) AS (SELECT doc_id, doc_id FROM s UNION SELECT l.b, p.r FROM p JOIN l ON l.a = p.doc_id)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, m.r AS component_id, s.doc_id = m.r AS kept
FROM s JOIN (SELECT doc_id, min(r) AS r FROM p GROUP BY 1) m USING (doc_id)"""
