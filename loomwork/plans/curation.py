"""Queries of the chain scores, class rules, splits and coverage, registered beside the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classes as C
from ..operators import arrays, chains, coverage, splits
from .catalogue import _two, query, r6

SALT = "another-salt-of-thirty-two-characters"


def _atoms(t):
    """Two tables of 7 residues of three atoms for each vector that has a next one of its label."""
    place = [F.floor(F.col("i") / 3).cast("int").alias("res"), (F.col("i") % 3).cast("int").alias("slot"), "x", "y", "z"]
    return tuple(p.select("vec_id", *place) for p in _two(t))


_ATOMS = """WITH e AS (SELECT vec_id, embedding AS a, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings),
p AS (SELECT vec_id, i // 3 AS res, i % 3 AS slot, """ + ", ".join(f"{c}[i * 3 + {k + 1}]::DOUBLE AS {n}{x}" for c, n in (("a", "p"), ("b", "t")) for k, x in enumerate("xyz")) + """
  FROM e, (SELECT unnest(range(0, 21)) AS i) WHERE b IS NOT NULL)"""
_WIDE = (
    _ATOMS + ", w AS (SELECT vec_id, res, " + ", ".join(f"max(CASE WHEN slot = {s} THEN {n}{x} END) AS {n}{x}{s}" for n in "pt" for x in "xyz" for s in range(3))
    + " FROM p GROUP BY 1, 2), n AS (SELECT *, " + ", ".join(f"lead({n}{x}{s}) OVER o AS next_{n}{x}{s}" for n in "pt" for x in "xyz" for s in range(3))
    + " FROM w WINDOW o AS (PARTITION BY vec_id ORDER BY res))"
)


def _dihedral_sql(n, *points):
    """Degrees of the dihedral of four points, each a prefix and a slot."""
    at = [[f"{pre}{n}{x}{s}" for x in "xyz"] for pre, s in points]
    u, v, w = ([f"({b} - {a})" for a, b in zip(at[k], at[k + 1])] for k in range(3))
    cross = lambda a, b: [f"({a[(i + 1) % 3]} * {b[(i + 2) % 3]} - {a[(i + 2) % 3]} * {b[(i + 1) % 3]})" for i in range(3)]
    dot = lambda a, b: "(" + " + ".join(f"{x} * {y}" for x, y in zip(a, b)) + ")"
    return f"degrees(atan2(sqrt({dot(v, v)}) * {dot(u, cross(v, w))}, {dot(cross(u, v), cross(v, w))}))"


_FOUR = {"phi": (("", 2), ("next_", 0), ("next_", 1), ("next_", 2)), "psi": (("", 0), ("", 1), ("", 2), ("next_", 0)), "omega": (("", 1), ("", 2), ("next_", 0), ("next_", 1))}
_ANGLES = _WIDE + ", a AS (" + " UNION ALL ".join(
    f"SELECT vec_id, res + {int(k == 'phi')} AS res, '{k}' AS angle, {_dihedral_sql('p', *q)} AS p, {_dihedral_sql('t', *q)} AS t FROM n WHERE next_px0 IS NOT NULL" for k, q in _FOUR.items()) + ")"


@query(_ANGLES + ", m AS (SELECT vec_id, angle, avg(least(abs(p - t), 360 - abs(p - t)) / 180) AS e FROM a GROUP BY 1, 2) SELECT vec_id, round(1 - avg(e), 5) AS backbone FROM m GROUP BY 1")
def backbone_agreement(t):
    return chains.backbone_score(*_atoms(t), "vec_id").withColumn("backbone", F.round("backbone", 5))


@query(_ANGLES + """, r AS (SELECT x.vec_id, x.p AS f, y.p AS s FROM a x JOIN a y ON x.vec_id = y.vec_id AND x.res = y.res WHERE x.angle = 'phi' AND y.angle = 'psi'),
c AS (SELECT vec_id, CASE WHEN f BETWEEN -120 AND -25 AND s BETWEEN -100 AND 45 THEN 'h' WHEN (f BETWEEN -180 AND -60 AND s BETWEEN 45 AND 180) OR (f BETWEEN 45 AND 180 AND s BETWEEN -180 AND -120) THEN 'b' ELSE 'c' END AS k FROM r)
SELECT vec_id, count(*) AS n, round(count(*) FILTER (k = 'h') / count(*), 6) AS helix, round(count(*) FILTER (k = 'b') / count(*), 6) AS beta, round(count(*) FILTER (k = 'c') / count(*), 6) AS coil FROM c GROUP BY 1""")
def ramachandran_fractions(t):
    out = chains.ramachandran(_atoms(t)[0], "vec_id")
    return out.select("vec_id", "n", *(r6(F.col(c)).alias(c) for c in ("helix", "beta", "coil")))


@query(_ATOMS + """, o AS (SELECT * FROM p WHERE slot > 0), v AS (SELECT o.*, mid FROM o JOIN (SELECT DISTINCT vec_id, res AS mid FROM p) s USING (vec_id) WHERE abs(res - mid) <= 1),
d AS (SELECT a.vec_id, a.mid, abs(sqrt((a.px - b.px)**2 + (a.py - b.py)**2 + (a.pz - b.pz)**2) - sqrt((a.tx - b.tx)**2 + (a.ty - b.ty)**2 + (a.tz - b.tz)**2)) AS gap
  FROM v a JOIN v b ON a.vec_id = b.vec_id AND a.mid = b.mid AND a.res * 3 + a.slot < b.res * 3 + b.slot),
s AS (SELECT vec_id, mid, avg(((gap < 0.05)::INT + (gap < 0.1)::INT + (gap < 0.2)::INT + (gap < 0.4)::INT) / 4) AS s FROM d GROUP BY 1, 2) SELECT vec_id, round(avg(s), 5) AS dipdiff FROM s GROUP BY 1""")
def dipdiff_windows(t):
    return chains.dipdiff(*_atoms(t), "vec_id", (1, 2), (0.05, 0.1, 0.2, 0.4)).withColumn("dipdiff", F.round("dipdiff", 5))


@query(_ATOMS + """, r AS (SELECT *, 0.1 + 0.02 * slot AS radius FROM p), h AS (SELECT a.vec_id, count(*) AS n FROM r a JOIN r b ON a.vec_id = b.vec_id AND b.res - a.res > 1
  WHERE a.radius + b.radius - sqrt((a.px - b.px)**2 + (a.py - b.py)**2 + (a.pz - b.pz)**2) > 0.08 GROUP BY 1)
SELECT v.vec_id, coalesce(h.n, 0) AS n_clashes, round(1 / (1 + 10.0 * coalesce(h.n, 0) / 21), 6) AS clash FROM (SELECT DISTINCT vec_id FROM p) v LEFT JOIN h USING (vec_id)""")
def clash_cells(t):
    atoms = _atoms(t)[0].withColumn("radius", F.lit(0.1) + F.lit(0.02) * F.col("slot"))
    return chains.clash_score(atoms, "vec_id", 0.08, 0.14).withColumn("clash", r6(F.col("clash")))


@query(None)
def gdt_shares(t):
    return chains.gdt(*_atoms(t), "vec_id", (0.05, 0.1, 0.2, 0.4))


@query(None)
def sphere_shares(t):
    return chains.sphere_scores(*_atoms(t), "vec_id", 0.3, (0.05, 0.1))


_NAMES = ["All-Alpha", " sheet ", "alpha/beta", "", "Few Secondary Structures", "X y", "mixed", "MAINLY beta"]
_NAME_CLASS = ["alpha", "beta", "alpha_beta", "unknown", "coil_or_sparse", "x_y", "alpha_beta", "beta"]


@query("SELECT p_partkey, CASE p_partkey % 9 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_NAME_CLASS)) + " ELSE 'unknown' END AS class FROM part")
def class_normalised(t):
    name = F.get(F.array(*map(F.lit, _NAMES)), (F.col("p_partkey") % 9).cast("int"))
    return t("part").select("p_partkey", C.class_of(name).alias("class"))


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS h, CASE WHEN l_linenumber < 7 THEN l_tax * 10 END AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN b IS NULL THEN 'unknown' WHEN h >= 0.4 AND b < 0.2 THEN 'alpha' WHEN b >= 0.3 AND h < 0.2 THEN 'beta' WHEN h >= 0.2 AND b >= 0.15 THEN 'alpha_beta'
  WHEN 1 - h - b >= 0.7 THEN 'coil_or_sparse' ELSE 'mixed_low_confidence' END AS class FROM f""")
def class_by_shares(t):
    li = t("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("h"), F.when(F.col("l_linenumber") < 7, F.col("l_tax") * 10).alias("b"))
    return li.select("l_orderkey", "l_linenumber", C.class_of_shares(F.col("h"), F.col("b"), 1 - F.col("h") - F.col("b")).alias("class"))


@query("""WITH d AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'e' WHEN 1 THEN '' ELSE 'd' END || right('000' || p_partkey, 4) || CASE WHEN p_size % 2 = 0 THEN 'A' ELSE '' END || p_size AS id FROM part),
b AS (SELECT p_partkey, id, CASE WHEN id LIKE 'e%' THEN substr(id, 2) ELSE id END AS body FROM d)
SELECT p_partkey, CASE WHEN length(id) >= 6 AND regexp_replace(substr(body, 5), '[0-9]$', '') <> '' THEN lower(substr(body, 1, 4)) || '_' || regexp_replace(substr(body, 5), '[0-9]$', '') END AS chain FROM b""")
def domain_chain(t):
    k, size = F.col("p_partkey"), F.col("p_size")
    lead = F.when(k % 3 == 0, "e").when(k % 3 == 1, "").otherwise("d")
    name = F.concat(lead, F.substring(F.concat(F.lit("000"), k.cast("string")), -4, 4), F.when(size % 2 == 0, "A").otherwise(""), size.cast("string"))
    return t("part").select("p_partkey", C.chain_of_domain(name).alias("chain"))


_SIZES = [("hidden", 40), ("val", 60), ("train", 80)]


def _split_sql():
    out, pool = "WITH pool0 AS (SELECT doc_id, lang FROM documents)", "pool0"
    for k, (name, size) in enumerate(_SIZES):
        out += f""", q{k} AS (SELECT lang, n, {size} * n / sum(n) OVER () AS q FROM (SELECT lang, count(*) AS n FROM {pool} GROUP BY 1)),
a{k} AS (SELECT lang, floor(q) + (row_number() OVER (ORDER BY q - floor(q) DESC, n DESC, lang) <= {size} - sum(floor(q)) OVER ())::INT AS alloc FROM q{k}),
s{k} AS (SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY substr(sha256('{SALT}:{name}:' || lang || ':' || doc_id), 1, 16), doc_id) AS rn FROM {pool}) JOIN a{k} USING (lang) WHERE rn <= alloc),
pool{k + 1} AS (SELECT doc_id, lang FROM {pool} ANTI JOIN s{k} USING (doc_id))"""
        pool = f"pool{k + 1}"
    return out + " " + " UNION ALL ".join(f"SELECT doc_id, lang, '{name}' AS split FROM s{k}" for k, (name, _) in enumerate(_SIZES))


@query(_split_sql())
def sequential_splits(t):
    return splits.sequential(t("documents").select("doc_id", "lang"), "lang", "doc_id", _SIZES, SALT)


_GATE_SQL = f"""WITH x AS ({_split_sql()}), d AS (SELECT split, unnest(['lang', 'source']) AS field, unnest([f.lang, f.source]) AS value FROM x JOIN documents f USING (doc_id)),
s AS (SELECT DISTINCT split, field FROM d), v AS (SELECT field, value, count(*) AS m FROM d GROUP BY 1, 2), c AS (SELECT split, field, value, count(*) AS n FROM d GROUP BY 1, 2, 3),
b AS (SELECT s.split, s.field, coalesce(n, 0) / sum(coalesce(n, 0)) OVER w AS p, m / sum(m) OVER w AS q FROM s JOIN v ON s.field = v.field
  LEFT JOIN c ON c.split = s.split AND c.field = s.field AND c.value = v.value WINDOW w AS (PARTITION BY s.split, s.field)),
j AS (SELECT sum(CASE WHEN p > 0 THEN 0.5 * p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN 0.5 * q * log2(2 * q / (p + q)) ELSE 0 END) AS jsd FROM b GROUP BY split, field),
r AS (SELECT max(jsd) AS jsd, (SELECT avg((value = 'unknown')::INT) FROM d) AS u, (SELECT min(n) FROM (SELECT count(*) AS n FROM x GROUP BY split)) AS n FROM j)
SELECT round(jsd, 6) AS max_jsd, round(u, 6) AS unknown_share, n AS min_split_size, concat_ws(',', CASE WHEN n >= 40 AND jsd > 0.1 THEN 'divergence' END, CASE WHEN u > 0.5 THEN 'unknown' END) AS faults FROM r"""


@query(_GATE_SQL)
def split_quality_gate(t):
    d = t("documents").select("doc_id", "lang", "source")
    out = splits.gate(splits.quality_report(splits.sequential(d, "lang", "doc_id", _SIZES, SALT), ["lang", "source"]), 0.1, 0.5, 40)
    return out.select(r6(F.col("max_jsd")).alias("max_jsd"), r6(F.col("unknown_share")).alias("unknown_share"), "min_split_size", F.array_join("faults", ",").alias("faults"))


@query("SELECT source, list_sort(list(DISTINCT lang)) AS splits FROM documents WHERE lang IS NOT NULL GROUP BY source HAVING count(DISTINCT lang) > 1")
def values_in_two_splits(t):
    return splits.shared_values(t("documents").select("source", F.col("lang").alias("split")), "source")


_GRAPH = "WITH g AS (SELECT l_orderkey % 200 AS row, l_suppkey AS neighbour, l_extendedprice AS distance FROM lineitem)"


def _graph(t):
    return t("lineitem").select((F.col("l_orderkey") % 200).alias("row"), F.col("l_suppkey").alias("neighbour"), F.col("l_extendedprice").alias("distance"))


def _nearest(t):
    return coverage.nearest_train(_graph(t), t("supplier").where("s_nationkey % 3 = 0").select(F.col("s_suppkey").alias("id")))


_NEAREST = _GRAPH + """, k AS (SELECT s_suppkey AS id FROM supplier WHERE s_nationkey % 3 = 0),
n AS (SELECT row, CASE WHEN row IN (SELECT id FROM k) THEN 0 ELSE coalesce(min(distance) FILTER (neighbour IN (SELECT id FROM k)), max(distance)) END AS nearest FROM g GROUP BY row)"""


@query(_NEAREST + " SELECT row, round(nearest, 4) AS nearest FROM n")
def nearest_train_neighbour(t):
    return _nearest(t).withColumn("nearest", F.round("nearest", 4))


@query(_GRAPH + " SELECT row, round(distance, 4) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY distance, neighbour) AS rn FROM g WHERE row <> neighbour) WHERE rn = 3")
def local_k_distance(t):
    return coverage.local_distance(_graph(t), 3).withColumn("distance", F.round("distance", 4))


@query(_NEAREST + " SELECT (row % 3)::INT AS part, radius::DOUBLE AS radius, round(avg((nearest <= radius)::INT), 6) AS covered FROM n, (SELECT unnest([500.0, 1500.0, 6000.0]) AS radius) GROUP BY 1, 2")
def coverage_at_radius(t):
    n = _nearest(t).withColumn("part", (F.col("row") % 3).cast("int"))
    return coverage.coverage_at(n, "part", [500.0, 1500.0, 6000.0]).withColumn("covered", r6(F.col("covered")))


@query("""WITH a AS (SELECT p_brand AS metric, round(avg(p_retailprice), 2) AS value FROM part GROUP BY 1),
s AS (SELECT metric, value, count(*) AS n, avg((p_retailprice <= value)::INT) AS le, avg((p_retailprice >= value)::INT) AS ge FROM a JOIN part ON p_brand = metric GROUP BY 1, 2)
SELECT metric, value, n, round(le, 6) AS percentile, round(least(1, 2 * least(le, ge)), 6) AS tail FROM s""")
def empirical_percentile(t):
    p = t("part").select(F.col("p_brand").alias("metric"), F.col("p_retailprice").alias("value"))
    out = coverage.against_random(p.groupBy("metric").agg(F.round(F.avg("value"), 2).alias("value")), p)
    return out.select("metric", "value", "n", r6(F.col("percentile")).alias("percentile"), r6(F.col("tail")).alias("tail"))
