"""Queries of the alignment, geometry and report kernels, registered beside the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import alignment as A
from ..operators import curves, geometry
from .catalogue import _two, query, r6

#: The twenty residues in the order of their ids.
RESIDUES = "ARNDCQEGHILKMFPSTWYV"
_RAW_SQL = "regexp_replace(p_type || substr(p_name, 1, 3) || p_brand || p_name, '[^A-Za-z]', '-', 'g')"
_TWO_SQL = "SELECT p_partkey, translate(p_name, 'aeiou', '-----') AS qa, translate(p_name, 'ldn', '---') AS ta FROM part"
_PAIRS_SQL = f"""WITH s AS ({_TWO_SQL}), c AS (SELECT p_partkey, qa, ta, unnest(range(1, len(qa) + 1)) AS i FROM s),
p AS (SELECT p_partkey, len(replace(substr(qa, 1, i - 1), '-', '')) AS q, len(replace(substr(ta, 1, i - 1), '-', '')) AS t, substr(qa, i, 1) = substr(ta, i, 1) AS same
  FROM c WHERE substr(qa, i, 1) <> '-' AND substr(ta, i, 1) <> '-')"""


def _raw():
    return F.regexp_replace(F.concat("p_type", F.substring("p_name", 1, 3), "p_brand", "p_name"), "[^A-Za-z]", "-")


def _strings(t):
    return t("part").select("p_partkey", F.translate("p_name", "aeiou", "-----").alias("qa"), F.translate("p_name", "ldn", "---").alias("ta"))


@query(f"""WITH r AS (SELECT p_partkey, {_RAW_SQL} AS raw FROM part)
SELECT p_partkey, regexp_replace(raw, '[a-z]', '', 'g') AS aligned, array_to_string(list_transform(regexp_extract_all(raw, '([a-z]*)[A-Z-]', 1), lambda x: len(x)), ',') AS insertions FROM r""")
def alignment_insertions(t):
    return t("part").select("p_partkey", A.aligned(_raw()).alias("aligned"), F.array_join(A.insertions(_raw()).cast("array<string>"), ",").alias("insertions"))


@query(f"""WITH r AS (SELECT {_RAW_SQL} AS raw FROM part),
c AS (SELECT unnest(list_transform(regexp_extract_all(raw, '([a-z]*)[A-Z-]', 1), lambda x, i: {{'at': i - 1, 'n': len(x)}})) AS s FROM r)
SELECT s.at::INT AS at, round(avg(ln(1 + s.n)), 6) AS mean_log FROM c GROUP BY 1""")
def mean_log_insertions(t):
    return t("part").select(F.posexplode(A.insertions(_raw())).alias("at", "n")).groupBy("at").agg(r6(F.avg(F.log1p("n"))).alias("mean_log"))


@query(f"""WITH s AS ({_TWO_SQL})
SELECT p_partkey, array_to_string(list_transform(list_filter(range(1, len(ta) + 1), lambda i: substr(qa, i, 1) <> '-'), lambda i: substr(ta, i, 1)), '') AS kept FROM s""")
def query_gap_columns_dropped(t):
    return _strings(t).select("p_partkey", A.without_gaps_of(F.col("qa"), F.col("ta")).alias("kept"))


@query(f"""SELECT p_partkey, array_to_string(list_transform(range(1, len(p_type) + 1), lambda i:
  CASE WHEN substr(p_type, i, 1) = '-' THEN 21 WHEN instr('{RESIDUES}', substr(p_type, i, 1)) = 0 THEN 20 ELSE instr('{RESIDUES}', substr(p_type, i, 1)) - 1 END), ',') AS tokens FROM part""")
def residue_tokens(t):
    return t("part").select("p_partkey", F.array_join(A.tokens(F.col("p_type"), RESIDUES).cast("array<string>"), ",").alias("tokens"))


@query(_PAIRS_SQL + " SELECT p_partkey, q, t FROM p")
def alignment_index_pairs(t):
    pairs = _strings(t).select("p_partkey", F.explode(A.index_pairs(F.col("qa"), F.col("ta"))).alias("x"))
    return pairs.select("p_partkey", F.col("x.q").cast("long").alias("q"), F.col("x.t").cast("long").alias("t"))


@query(_PAIRS_SQL + """, g AS (SELECT p_partkey, count(*) AS n, count(*) FILTER (same) AS m FROM p GROUP BY 1)
SELECT s.p_partkey, coalesce(n, 0) AS n_pairs, round(coalesce(m / n, 0), 6) AS identity, round(coalesce(n, 0) / len(replace(qa, '-', '')), 6) AS coverage,
  round(coalesce(n, 0) / greatest(len(replace(qa, '-', '')), len(replace(ta, '-', ''))), 6) AS aligned_fraction FROM s LEFT JOIN g USING (p_partkey)""")
def projection_statistics(t):
    out = A.projection_stats(_strings(t), "p_partkey", "qa", "ta")
    return out.select("p_partkey", F.col("n_pairs").cast("long").alias("n_pairs"), *(r6(F.col(c)).alias(c) for c in ("identity", "coverage", "aligned_fraction")))


_CHAIN_SQL = """WITH e AS (SELECT vec_id, embedding AS a FROM embeddings),
p AS (SELECT vec_id, i, a[i * 3 + 1]::DOUBLE AS x, a[i * 3 + 2]::DOUBLE AS y, a[i * 3 + 3]::DOUBLE AS z FROM e, (SELECT unnest(range(0, 21)) AS i)),
b AS (SELECT vec_id, i, lead(x) OVER w - x AS x, lead(y) OVER w - y AS y, lead(z) OVER w - z AS z FROM p WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
f AS (SELECT vec_id, i, x AS ax, y AS ay, z AS az, lead(x) OVER w AS bx, lead(y) OVER w AS by_, lead(z) OVER w AS bz,
  lead(x, 2) OVER w AS cx, lead(y, 2) OVER w AS cy, lead(z, 2) OVER w AS cz FROM b WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
n AS (SELECT *, ay * bz - az * by_ AS mx, az * bx - ax * bz AS my, ax * by_ - ay * bx AS mz, by_ * cz - bz * cy AS nx, bz * cx - bx * cz AS ny, bx * cy - by_ * cx AS nz FROM f)
SELECT vec_id, i::INT AS i, round(degrees(atan2(sqrt(bx**2 + by_**2 + bz**2) * (ax * nx + ay * ny + az * nz), mx * nx + my * ny + mz * nz)), 4) AS angle FROM n WHERE cx IS NOT NULL"""


@query(_CHAIN_SQL)
def dihedral_angles(t):
    from ..operators import arrays

    return geometry.dihedrals(arrays.points(t("embeddings"), "vec_id", "embedding", 21), "vec_id").withColumn("angle", X.rounded(F.col("angle"), 4))


@query(None)
def superposed_rmsd(t):
    pred, true = _two(t)
    return geometry.superposed_rmsd(pred, true, "vec_id")


@query("""WITH a AS (SELECT l_returnflag, l_tax AS w, (l_quantity * 17) % 360 AS a, (l_extendedprice) % 360 AS b FROM lineitem)
SELECT l_returnflag, round(sum(w * least(abs(a - b), 360 - abs(a - b))) / greatest(sum(w), 1e-8), 4) AS error FROM a GROUP BY 1""")
def weighted_angle_error(t):
    e = geometry.angle_error(F.col("l_quantity") * 17 % 360, F.col("l_extendedprice") % 360)
    return t("lineitem").groupBy("l_returnflag").agg(F.round(F.sum(F.col("l_tax") * e) / F.greatest(F.sum("l_tax"), F.lit(1e-8)), 4).alias("error"))


@query("""WITH m AS (SELECT l_returnflag AS f, l_linenumber AS x, avg(l_quantity) AS quantity, avg(l_discount) AS discount FROM lineitem GROUP BY 1, 2),
u AS (UNPIVOT m ON quantity, discount INTO NAME metric VALUE y),
a AS (SELECT f || '|' || metric AS curve, x, y, (x - lag(x) OVER w) * (y + lag(y) OVER w) / 2 AS area FROM u WINDOW w AS (PARTITION BY f, metric ORDER BY x))
SELECT curve, count(*) AS n_points, round(sum(area) / 7, 6) AS auc, round(arg_max(y, x), 6) AS final FROM a GROUP BY 1""")
def curve_report(t):
    m = t("lineitem").groupBy("l_returnflag", F.col("l_linenumber").alias("x")).agg(F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"))
    u = m.unpivot(["l_returnflag", "x"], ["quantity", "discount"], "metric", "y").withColumn("curve", F.concat_ws("|", "l_returnflag", "metric"))
    last = u.groupBy("curve").agg(r6(F.max_by("y", "x")).alias("final"))
    return curves.auc(u, "curve", "x", "y", 7.0).withColumn("auc", r6(F.col("auc"))).join(last, "curve")


@query(r"""WITH h AS (SELECT s_suppkey, 'No ' || s_suppkey || ' ' || s_name || ' Probab=' || (s_nationkey * 4) || ' E-value=1.5e-' || (s_nationkey % 7) || ' Cols=' || s_suppkey AS line FROM supplier)
SELECT s_suppkey, regexp_extract(line, '#(\d+)', 1) AS target, CAST(regexp_extract(line, 'Probab=(\S+)', 1) AS DOUBLE) AS probability, CAST(regexp_extract(line, 'E-value=(\S+)', 1) AS DOUBLE) AS e_value FROM h""")
def hit_list_fields(t):
    key = lambda c: F.col(c).cast("string")
    line = F.concat(F.lit("No "), key("s_suppkey"), F.lit(" "), "s_name", F.lit(" Probab="), (F.col("s_nationkey") * 4).cast("string"), F.lit(" E-value=1.5e-"),
                    (F.col("s_nationkey") % 7).cast("string"), F.lit(" Cols="), key("s_suppkey"))
    number = lambda name: F.regexp_extract("line", name + r"=(\S+)", 1).cast("double")
    return t("supplier").select("s_suppkey", line.alias("line")).select(
        "s_suppkey", F.regexp_extract("line", r"#(\d+)", 1).alias("target"), number("Probab").alias("probability"), number("E-value").alias("e_value")
    )
