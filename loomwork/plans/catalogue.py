"""Named queries over the driver's tables, each with its DuckDB form where SQL has one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import arrays, candidates, curves, ordering, passages, relational as R

QUERIES: dict = {}
ORACLES: dict = {}
SALT = "a-salt-of-thirty-two-characters-or-more"
BINS = [(500, "len_0_499"), (2000, "len_500_1999"), (8000, "len_2000_7999")]
BIN_SQL = "CASE WHEN n_chars < 500 THEN 'len_0_499' WHEN n_chars < 2000 THEN 'len_500_1999' WHEN n_chars < 8000 THEN 'len_2000_7999' ELSE 'len_8000_up' END"
SPLIT_SQL = f"CASE WHEN substr(sha256('{SALT}:' || doc_id), 1, 1) < '2' THEN 'val' ELSE 'train' END"


def query(sql: str | None):
    """Register a query under its function's name with its DuckDB form."""

    def add(f):
        name = f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return add


def r6(c):
    return F.round(c, 6)


def _split():
    return F.when(F.substring(F.sha2(F.concat_ws(":", F.lit(SALT), F.col("doc_id").cast("string")), 256), 1, 1) < "2", "val").otherwise("train")


@query("""
WITH e AS (SELECT user_id, epoch_ms(ts) / 86400000.0 AS x, value, epoch_ms(min(ts) OVER (PARTITION BY user_id)) / 86400000.0 AS x0 FROM events),
a AS (SELECT user_id, value, (x - x0) - lag(x - x0) OVER w AS dx, lag(value) OVER w AS v0 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY x))
SELECT user_id, count(*) AS n_points, round(CASE WHEN count(*) = 1 THEN any_value(value) ELSE sum(dx * (value + v0) / 2) / 30 END, 4) AS auc FROM a GROUP BY user_id""")
def curve_auc(t):
    e = t("events").select("user_id", (F.unix_millis(F.col("ts").cast("timestamp")) / 86400000.0).alias("at"), "value")
    e = e.withColumn("x", F.col("at") - F.min("at").over(Window.partitionBy("user_id")))
    return curves.auc(e, "user_id", "x", "value", 30.0).withColumn("auc", F.round("auc", 4))


@query("""
WITH d AS (SELECT o_custkey, date_diff('day', min(o_orderdate) OVER (PARTITION BY o_custkey), o_orderdate) AS x FROM orders),
s AS (SELECT o_custkey, x, x - lag(x) OVER (PARTITION BY o_custkey ORDER BY x) AS step FROM d)
SELECT o_custkey, min(x) = 0 AS starts_at_0, coalesce(min(step) > 0, true) AS rises, max(x) = 100 AS ends_at_budget FROM s GROUP BY o_custkey""")
def curve_validate(t):
    o = t("orders").withColumn("x", F.datediff("o_orderdate", F.min("o_orderdate").over(Window.partitionBy("o_custkey"))))
    return curves.axis_faults(o, "o_custkey", "x", 100)


@query("""
SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY CASE WHEN c_custkey % 97 = 0 THEN '-inf'::DOUBLE ELSE c_acctbal END DESC, c_nationkey::DOUBLE DESC, c_name) AS rank FROM customer""")
def leaderboard_rank(t):
    c = t("customer").withColumn("s", F.when(F.col("c_custkey") % 97 == 0, float("nan")).otherwise(F.col("c_acctbal"))).withColumn("tb", F.col("c_nationkey").cast("double"))
    return curves.ranked(c, "c_mktsegment", "s", "tb", "c_name").select("c_custkey", "c_mktsegment", "rank")


@query("""
SELECT c_custkey AS id, c_acctbal AS score FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, c_acctbal + 1 FROM customer WHERE c_custkey % 3 = 0""")
def leaderboard_upsert(t):
    c = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score"))
    return R.upsert(c, c.where("id % 3 = 0").withColumn("score", F.col("score") + 1), ["id"])


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, doc_id FROM documents")
def manifest_scan_ordered(t):
    return ordering.placed(t("documents").select("doc_id"), [F.col("doc_id")]).select("pos", "doc_id")


@query("SELECT c_custkey, 'chain_' || lower(hex(encode(c_name))) AS stem, c_name AS back FROM customer")
def key_encode_roundtrip(t):
    return t("customer").withColumn("stem", X.key_encode("c_name")).select("c_custkey", "stem", X.key_decode(F.col("stem")).alias("back"))


@query("SELECT p_partkey, upper(CASE WHEN p_partkey % 5 = 0 THEN trim(p_type) ELSE trim(p_brand) END) AS label FROM part")
def alias_coalesce_normalise(t):
    p = t("part").withColumn("a", F.when(F.col("p_partkey") % 5 == 0, F.lit("  ")).otherwise(F.col("p_brand")))
    return p.select("p_partkey", X.first_filled("a", "p_type").alias("label"))


@query("SELECT event_id, CASE WHEN k >= 0 THEN k END AS k FROM (SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)")
def lenient_number(t):
    k = F.get_json_object("props", "$.k").try_cast("int")
    return t("events").select("event_id", F.when(k >= 0, k).alias("k"))


@query("SELECT doc_id, round(length(regexp_replace(text, '[A-Za-z ]', '', 'g')) / length(text), 6) AS foreign_share FROM documents")
def composition_unknown_fraction(t):
    return t("documents").select("doc_id", r6(X.foreign_share("text", "A-Za-z ")).alias("foreign_share"))


@query("""
WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents), c AS (SELECT doc_id, w, count(*) AS n FROM w GROUP BY 1, 2)
SELECT doc_id, round(max(n) / sum(n), 6) AS top_share FROM c GROUP BY doc_id""")
def token_top_share(t):
    w = t("documents").select("doc_id", F.explode(F.split("text", " ")).alias("w")).groupBy("doc_id", "w").agg(F.count(F.lit(1)).alias("n"))
    return w.groupBy("doc_id").agg(r6(F.max("n") / F.sum("n")).alias("top_share"))


@query(f"SELECT doc_id, {BIN_SQL} AS bin FROM documents")
def bin_case(t):
    return t("documents").select("doc_id", X.binned("n_chars", BINS, "len_8000_up").alias("bin"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_discount >= 0.08 THEN 'alpha' WHEN l_tax >= 0.06 THEN 'beta' WHEN l_quantity < 10 THEN 'coil' ELSE 'mixed' END AS class FROM lineitem""")
def threshold_class(t):
    c = F.when(F.col("l_discount") >= 0.08, "alpha").when(F.col("l_tax") >= 0.06, "beta").when(F.col("l_quantity") < 10, "coil").otherwise("mixed")
    return t("lineitem").select("l_orderkey", "l_linenumber", c.alias("class"))


@query(f"SELECT doc_id, substr(sha256('{SALT}:' || doc_id), 1, 16) AS score FROM documents")
def salted_hash_order(t):
    return t("documents").select("doc_id", X.salted_score(SALT, "doc_id").alias("score"))


_TESTS_SQL = "list_filter([CASE WHEN n_chars < 300 THEN 'short' END, CASE WHEN n_chars > 9000 THEN 'long' END, CASE WHEN lang = 'es' THEN 'lang' END], lambda x: x IS NOT NULL)"


def _rejected(t):
    return R.reasons(t("documents"), [("short", F.col("n_chars") < 300), ("long", F.col("n_chars") > 9000), ("lang", F.col("lang") == "es")])


@query(f"SELECT {_TESTS_SQL}[1] AS reason, count(*) AS n FROM documents GROUP BY 1")
def reject_first_reason(t):
    return _rejected(t).groupBy(F.col("first_reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT reason, count(*) AS n FROM (SELECT unnest({_TESTS_SQL}) AS reason FROM documents) GROUP BY 1")
def reject_all_reasons(t):
    return _rejected(t).select(F.explode("all_reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, round_even(p_retailprice / 7, 2) AS price, round_even(p_retailprice / 7, 2) >= 150 AND p_size > 5 AS passes FROM part")
def quality_gate_rounded(t):
    p = F.bround(F.col("p_retailprice") / 7, 2)
    return t("part").select("p_partkey", p.alias("price"), ((p >= 150) & (F.col("p_size") > 5)).alias("passes"))


@query("SELECT o_orderpriority, count(*) AS n_rows, round(avg(CASE WHEN o_orderkey % 97 <> 0 THEN o_totalprice END), 4) AS mean_price FROM orders GROUP BY 1")
def nan_safe_mean(t):
    o = t("orders").withColumn("v", F.when(F.col("o_orderkey") % 97 == 0, float("nan")).otherwise(F.col("o_totalprice")))
    return o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg(X.finite("v")), 4).alias("mean_price"))


@query("""
WITH s AS (SELECT s_nationkey AS k, max(s_acctbal) AS v FROM supplier GROUP BY 1), c AS (SELECT c_nationkey AS k, max(c_acctbal) AS v FROM customer GROUP BY 1)
SELECT coalesce(s.k, c.k) AS k, CASE WHEN s.k IS NOT NULL THEN 'supplier' ELSE 'customer' END AS source, coalesce(s.v, c.v) AS v FROM s FULL JOIN c ON s.k = c.k""")
def source_priority_coalesce(t):
    s = t("supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.max("s_acctbal").alias("v")).withColumn("source", F.lit("supplier"))
    c = t("customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.max("c_acctbal").alias("v")).withColumn("source", F.lit("customer"))
    return R.first_source(s.unionByName(c), "k", ["supplier", "customer"], "source", "v")


@query("SELECT d.doc_id, l.doc_id IS NOT NULL AND l.toxic = 1 AS excluded FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def exclusion_flag_join(t):
    bad = t("labels").where("toxic = 1").select(F.col("doc_id").alias("bad"))
    return t("documents").join(bad, F.col("doc_id") == F.col("bad"), "left").select("doc_id", F.col("bad").isNotNull().alias("excluded"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def coverage_missing(t):
    return t("documents").select("doc_id").join(t("labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT lang, count(*) AS n, count(l.doc_id) AS present, count(*) - count(l.doc_id) AS missing FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang")
def presence_audit(t):
    both = t("documents").join(t("labels").select(F.col("doc_id").alias("has")), F.col("doc_id") == F.col("has"), "left")
    return both.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count("has").alias("present"), (F.count(F.lit(1)) - F.count("has")).alias("missing"))


@query("""
SELECT t.event_type, u.user_id, count(e.event_id) AS n FROM (SELECT DISTINCT event_type FROM events) t CROSS JOIN (SELECT DISTINCT user_id FROM events) u
LEFT JOIN events e ON e.event_type = t.event_type AND e.user_id = u.user_id GROUP BY 1, 2""")
def completeness_cross_join(t):
    e = t("events")
    need = e.select("event_type").distinct().crossJoin(e.select("user_id").distinct())
    have = e.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))
    return need.join(have, ["event_type", "user_id"], "left").select("event_type", "user_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 1)")
def sibling_expansion(t):
    li = t("lineitem")
    return li.join(li.where("l_quantity = 1").select("l_orderkey").distinct(), "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("""SELECT l_orderkey, arg_min(l_linenumber, (CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END) * 1000 + l_linenumber) AS line FROM lineitem GROUP BY 1""")
def priority_fallback_join(t):
    order = F.struct(F.when(F.col("l_returnflag") == "R", 0).otherwise(1), F.col("l_linenumber"))
    return t("lineitem").groupBy("l_orderkey").agg(F.min_by("l_linenumber", order).alias("line"))


@query(f"""
SELECT field, value, count(*) AS n FROM (SELECT unnest(['lang', 'source', 'bin']) AS field, unnest([lang, source, {BIN_SQL}]) AS value FROM documents) GROUP BY 1, 2""")
def histogram_multi_field(t):
    return R.counts_by_field(t("documents").withColumn("bin", X.binned("n_chars", BINS, "len_8000_up")), ["lang", "source", "bin"])


_DIV = f"""
WITH d AS (SELECT {SPLIT_SQL} AS split, unnest(['lang', 'bin']) AS field, unnest([lang, {BIN_SQL}]) AS value FROM documents),
s AS (SELECT DISTINCT split, field FROM d), v AS (SELECT field, value, count(*) AS m FROM d GROUP BY 1, 2), c AS (SELECT split, field, value, count(*) AS n FROM d GROUP BY 1, 2, 3),
b AS (SELECT s.split, s.field, coalesce(n, 0) / sum(coalesce(n, 0)) OVER w AS p, m / sum(m) OVER w AS q FROM s JOIN v ON s.field = v.field
  LEFT JOIN c ON c.split = s.split AND c.field = s.field AND c.value = v.value WINDOW w AS (PARTITION BY s.split, s.field))
SELECT split, field, round(sum(CASE WHEN p > 0 THEN 0.5 * p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN 0.5 * q * log2(2 * q / (p + q)) ELSE 0 END), 6) AS jsd,
  round(0.5 * sum(abs(p - q)), 6) AS tvd, round(max(abs(p - q)), 6) AS max_dev FROM b GROUP BY 1, 2"""


@query(_DIV)
def split_divergence(t):
    d = t("documents").withColumn("bin", X.binned("n_chars", BINS, "len_8000_up")).withColumn("split", _split())
    return R.divergence(d, "split", ["lang", "bin"]).select("split", "field", *(r6(F.col(c)).alias(c) for c in ("jsd", "tvd", "max_dev")))


@query(f"""WITH d AS (SELECT source, doc_id, CASE WHEN lang = 'fr' THEN 1 ELSE 0 END AS u, CASE WHEN n_chars % 7 = 0 THEN 999 ELSE n_chars % 7 / 2 END AS r, n_chars, CASE WHEN doc_id % 3 > 0 THEN '20' || doc_id % 10 ELSE '' END AS release,
  substr(sha256('{SALT}:' || doc_id), 1, 16) AS score FROM documents)
SELECT source, doc_id AS rep FROM d QUALIFY row_number() OVER (PARTITION BY source ORDER BY u, r, n_chars DESC, release, score, doc_id) = 1""")
def representative_argmin(t):
    k = F.col("doc_id")
    rows = t("documents").select(
        "source", "doc_id", F.when(F.col("lang") == "fr", "unknown").otherwise(F.col("lang")).alias("class"), (F.col("n_chars") % 7 / 2).alias("resolution"), F.col("n_chars").alias("length"),
        F.when(k % 3 > 0, F.concat(F.lit("20"), (k % 10).cast("string"))).alias("release"),
    )
    return candidates.representatives(rows, "source", "doc_id", SALT).select("source", F.col("doc_id").alias("rep"))


@query("SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 4) AS mean, round(stddev_pop(p_retailprice), 4) AS std, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part GROUP BY 1")
def population_summary(t):
    v = "p_retailprice"
    return t("part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(v), 4).alias("mean"), F.round(F.stddev_pop(v), 4).alias("std"), F.min(v).alias("lo"), F.max(v).alias("hi"))


@query("SELECT count(*) AS n, sha256(string_agg(c_custkey || chr(9) || c_name || chr(10), '' ORDER BY c_custkey)) AS digest FROM customer")
def ordered_digest(t):
    return R.ordered_digest(t("customer"), "c_custkey", "c_name")


@query("SELECT l_orderkey, round(sum(0.5 * l_quantity + 0.3 * l_discount + 0.2 * l_tax), 4) AS composite, round(sum(l_quantity * l_discount) / greatest(sum(l_quantity), 1e-8) + 1e-9, 6) AS weighted FROM lineitem GROUP BY 1")
def weighted_composite(t):
    q, d, x = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    return t("lineitem").groupBy("l_orderkey").agg(F.round(F.sum(0.5 * q + 0.3 * d + 0.2 * x), 4).alias("composite"), r6(F.sum(q * d) / F.greatest(F.sum(q), F.lit(1e-8)) + F.lit(1e-9)).alias("weighted"))


@query("SELECT p_brand, round(avg(m), 4) AS mean_of_means FROM (SELECT p_brand, p_size, avg(p_retailprice) AS m FROM part GROUP BY 1, 2) GROUP BY 1")
def equal_class_mean(t):
    return t("part").groupBy("p_brand", "p_size").agg(F.avg("p_retailprice").alias("m")).groupBy("p_brand").agg(F.round(F.avg("m"), 4).alias("mean_of_means"))


@query("""WITH w AS (SELECT label, unnest(range(0, len(embedding))) AS i, floor(unnest(embedding)::DOUBLE * 10)::INT AS w FROM embeddings)
SELECT label, i, w, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY label, i), 6) AS freq FROM w GROUP BY 1, 2, 3""")
def column_profile(t):
    w = t("embeddings").select("label", F.posexplode("embedding").alias("p", "x")).select("label", F.col("p").cast("long").alias("i"), F.floor(F.col("x").cast("double") * 10).cast("int").alias("w"))
    c = w.groupBy("label", "i", "w").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("freq", r6(F.col("n") / F.sum("n").over(Window.partitionBy("label", "i"))))


@query("SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) / 1000, 6) AS used FROM events")
def running_budget_fraction(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t("events").select("event_id", "user_id", F.round(F.sum("value").over(w) / 1000, 6).alias("used"))


_ALLOC = """
g AS (SELECT *, 200 * n / sum(n) OVER () AS quota FROM s), a AS (SELECT *, least(floor(quota), n)::BIGINT AS part FROM g),
b AS (SELECT *, 200 - sum(part) OVER () AS rest, part < n AS room FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY room ORDER BY quota - floor(quota) DESC, n DESC, stratum) AS turn FROM b),
al AS (SELECT stratum, n, part + CASE WHEN room AND turn <= rest THEN 1 ELSE 0 END AS alloc FROM c)"""
_STRATA = "d AS (SELECT doc_id, lang || '|' || source AS stratum FROM documents), s AS (SELECT stratum, count(*) AS n FROM d GROUP BY 1)"


@query(f"WITH {_STRATA}, {_ALLOC} SELECT stratum, n, CAST(alloc AS BIGINT) AS alloc FROM al")
def largest_remainder_allocation(t):
    s = t("documents").select(X.stratum("lang", "source").alias("stratum")).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    return R.allocate(s, 200, "stratum")


@query(f"""WITH {_STRATA}, {_ALLOC}, h AS (SELECT *, substr(sha256('{SALT}:' || stratum || ':' || doc_id), 1, 16) AS score FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY score, doc_id) AS rn FROM h)
SELECT doc_id, r.stratum, score FROM r JOIN al ON r.stratum = al.stratum WHERE rn <= alloc""")
def stratified_hash_sample(t):
    d = t("documents").select("doc_id", X.stratum("lang", "source").alias("stratum"))
    return R.stratified_sample(d, "stratum", "doc_id", 200, SALT).select("doc_id", "stratum", "score")


@query(f"SELECT {SPLIT_SQL} AS split, lang, count(*) AS n FROM documents GROUP BY 1, 2")
def hash_split_counts(t):
    return t("documents").groupBy(_split().alias("split"), "lang").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH d AS (SELECT text, {SPLIT_SQL} AS split FROM documents), p AS (SELECT text, split, unnest(range(1, greatest(length(text) - 38, 2))) AS i FROM d)
SELECT substr(text, i, 40) AS passage, count(DISTINCT split) AS n_splits FROM p GROUP BY 1 HAVING count(DISTINCT split) > 1""")
def attribute_leakage(t):
    return passages.in_several(t("documents").select("text", _split().alias("split")), "split", "text", 40).withColumnRenamed("n", "n_splits")


@query("SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def union_distinct(t):
    return t("orders").select(F.col("o_custkey").alias("k")).union(t("customer").where("c_acctbal < 0").select("c_custkey")).distinct()


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def split_overlap(t):
    o = t("orders").withColumnRenamed("o_custkey", "k")
    return o.where("o_orderstatus = 'F'").select("k").intersect(o.where("o_orderstatus = 'O'").select("k"))


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS rn FROM conversations) WHERE rn <= 2")
def topk_rows(t):
    return R.top_of_each(t("conversations"), ["conv_id"], [F.desc(F.length("text")), F.col("turn")], 2).select("conv_id", "turn", "role")


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS near_mean FROM events")
def sliding_window_pm1(t):
    return t("events").select("event_id", r6(F.avg("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-1, 1))).alias("near_mean"))


_COMP = """
WITH RECURSIVE n AS MATERIALIZED (SELECT doc_id, sha256(text) AS a, lang || ':' || n_chars AS b FROM documents),
k AS (SELECT doc_id, 'a' || a AS v FROM n UNION ALL SELECT doc_id, 'b' || b FROM n), m AS (SELECT v, min(doc_id) AS r FROM k GROUP BY v),
l AS MATERIALIZED (SELECT DISTINCT doc_id AS x, r AS y FROM k JOIN m USING (v)), e AS MATERIALIZED (SELECT x, y FROM l UNION SELECT y, x FROM l),
p(doc_id, r) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.y, p.r FROM p JOIN e ON e.x = p.doc_id),
c AS (SELECT doc_id, min(r) AS component FROM p GROUP BY 1)"""


def _components(t):
    d = t("documents").select("doc_id", F.sha2("text", 256).alias("a"), F.concat_ws(":", "lang", "n_chars").alias("b"))
    return R.linked(d, "doc_id", ["a", "b"])


@query("""
WITH RECURSIVE n AS MATERIALIZED (SELECT doc_id, text, lang || ':' || n_chars AS b FROM documents),
s AS (SELECT doc_id, text, unnest(range(1, greatest(length(text) - 38, 2))) AS i FROM n),
k AS MATERIALIZED (SELECT DISTINCT doc_id, 'a' || substr(text, i, 40) AS v FROM s UNION ALL SELECT doc_id, 'b' || b FROM n), m AS (SELECT v, min(doc_id) AS r FROM k GROUP BY v),
l AS MATERIALIZED (SELECT DISTINCT doc_id AS x, r AS y FROM k JOIN m USING (v)), e AS MATERIALIZED (SELECT x, y FROM l UNION SELECT y, x FROM l),
p(doc_id, r) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.y, p.r FROM p JOIN e ON e.x = p.doc_id),
c AS (SELECT doc_id, min(r) AS component FROM p GROUP BY 1) SELECT doc_id, component FROM c""")
def components_two_relations(t):
    d = t("documents").select("doc_id", "text", F.concat("lang", F.lit(":"), F.col("n_chars").cast("string")).alias("b"))
    links = passages.shared(d, "doc_id", "text", 40).select("doc_id", F.col("least").alias("a"), F.lit(None).cast("string").alias("b"))
    return R.linked(d.select("doc_id", F.col("doc_id").alias("a"), "b").unionByName(links), "doc_id", ["a", "b"])


@query(_COMP + " SELECT doc_id FROM c WHERE component NOT IN (SELECT component FROM c JOIN labels USING (doc_id))")
def component_antijoin(t):
    c = _components(t)
    return c.join(c.join(t("labels").select("doc_id"), "doc_id").select("component").distinct(), "component", "left_anti").select("doc_id")


@query("SELECT vec_id, list_transform(embedding[25:40], lambda x: round(x::DOUBLE, 5)) AS crop FROM embeddings")
def array_crop_center(t):
    return t("embeddings").select("vec_id", F.transform(arrays.centre_crop("embedding", 16), lambda x: X.rounded(x.cast("double"), 5)).alias("crop"))


@query("""WITH d AS (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations), m AS (SELECT *, max(len(w)) OVER (PARTITION BY conv_id) AS k FROM d)
SELECT conv_id, turn, array_to_string(list_concat(w, list_transform(range(0, k - len(w)), lambda i: '-')), ' ') AS padded, len(w) AS n FROM m""")
def array_pad_mask(t):
    d = t("conversations").select("conv_id", "turn", F.split("text", " ").alias("w"))
    longest = d.groupBy("conv_id").agg(F.max(F.size("w")).alias("k"))
    return d.join(longest, "conv_id").select("conv_id", "turn", F.array_join(arrays.padded("w", F.col("k"), F.lit("-")), " ").alias("padded"), F.size("w").cast("long").alias("n"))


@query("SELECT text, arg_min(doc_id, (CASE WHEN source = 'src0' THEN 0 ELSE 1 END) * 1000000000000 + doc_id) AS doc_id FROM documents GROUP BY text")
def merge_dedup_rows(t):
    order = F.struct(F.when(F.col("source") == "src0", 0).otherwise(1), F.col("doc_id"))
    return t("documents").groupBy("text").agg(F.min_by("doc_id", order).alias("doc_id"))


_PTS = """
WITH e AS (SELECT vec_id, embedding AS a, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings),
p AS (SELECT vec_id, i, a[i * 3 + 1]::DOUBLE AS x, a[i * 3 + 2]::DOUBLE AS y, a[i * 3 + 3]::DOUBLE AS z, b[i * 3 + 1]::DOUBLE AS u, b[i * 3 + 2]::DOUBLE AS v, b[i * 3 + 3]::DOUBLE AS w
  FROM e, (SELECT unnest(range(0, 21)) AS i) WHERE b IS NOT NULL),
d AS (SELECT p.vec_id, p.i, q.i AS j, sqrt((p.x - q.x)**2 + (p.y - q.y)**2 + (p.z - q.z)**2) AS dp, sqrt((p.u - q.u)**2 + (p.v - q.v)**2 + (p.w - q.w)**2) AS dt
  FROM p JOIN p q ON p.vec_id = q.vec_id AND p.i <> q.i)"""


def _two(t):
    e = t("embeddings").withColumn("b", F.lead("embedding").over(Window.partitionBy("label").orderBy("vec_id"))).where("b IS NOT NULL")
    return arrays.points(e, "vec_id", "embedding", 21), arrays.points(e, "vec_id", "b", 21)


@query(_PTS + """, s AS (SELECT vec_id, i, sum((abs(dt - dp) < 0.05)::INT + (abs(dt - dp) < 0.1)::INT + (abs(dt - dp) < 0.2)::INT + (abs(dt - dp) < 0.4)::INT) / 4.0 / (count(*) + 1e-8) AS s FROM d WHERE dt < 0.3 GROUP BY 1, 2)
SELECT k.vec_id, coalesce(round(avg(s), 5), 0) AS lddt FROM (SELECT DISTINCT vec_id FROM p) k LEFT JOIN s USING (vec_id) GROUP BY 1""")
def lddt_points(t):
    pred, true = _two(t)
    return arrays.lddt(pred, true, "vec_id", 0.3, (0.05, 0.1, 0.2, 0.4)).withColumn("lddt", F.round("lddt", 5))


@query(_PTS + """ SELECT vec_id, round(1 - sum(abs((dp < 0.2)::INT - (dt < 0.2)::INT)) / greatest(sum(greatest((dp < 0.2)::INT, (dt < 0.2)::INT)), 1), 6) AS agreement FROM d GROUP BY 1""")
def contact_agreement(t):
    pred, true = _two(t)
    both = R.merged(arrays.distances(pred, "vec_id", "dp")).join(arrays.distances(true, "vec_id", "dt"), ["vec_id", "i", "j"])
    p, q = (F.col("dp") < 0.2).cast("int"), (F.col("dt") < 0.2).cast("int")
    return both.groupBy("vec_id").agg(r6(1 - F.sum(F.abs(p - q)) / F.greatest(F.sum(F.greatest(p, q)), F.lit(1))).alias("agreement"))


@query("SELECT vec_id, CASE WHEN len(embedding) <> 64 THEN 'length' WHEN list_max(embedding) > 0.4 THEN 'range' END AS violation FROM embeddings")
def schema_violations(t):
    return t("embeddings").select("vec_id", F.when(F.size("embedding") != 64, "length").when(F.array_max("embedding") > F.lit(0.4), "range").alias("violation"))


@query("""
WITH a AS (SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_custkey % 2 = 0), b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 10 = 0 THEN 'x' ELSE c_name END AS v FROM customer WHERE c_custkey % 3 = 0)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'extra' WHEN b.k IS NULL THEN 'missing' ELSE 'changed' END AS state FROM a FULL JOIN b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v""")
def fingerprint_compare(t):
    c = t("customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    a = c.where("k % 2 = 0").withColumn("a", F.lit(True))
    b = c.where("k % 3 = 0").select("k", F.when(F.col("k") % 10 == 0, "x").otherwise(F.col("v")).alias("w"), F.lit(True).alias("b"))
    state = F.when(F.col("a").isNull(), "extra").when(F.col("b").isNull(), "missing").otherwise("changed")
    return a.join(b, "k", "full").where("NOT (v <=> w)").select("k", state.alias("state"))


@query("SELECT d.doc_id, d.n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def incremental_pending(t):
    return t("documents").join(t("labels").where("quality = 1").select("doc_id"), "doc_id", "left_anti").select("doc_id", "n_chars")


@query("SELECT vec_id, list_transform(embedding, lambda x: round(x / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y))), 4) + 0.0) AS unit FROM embeddings")
def l2_normalise(t):
    n = F.sqrt(F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))
    return t("embeddings").select("vec_id", "embedding", n.alias("n")).select("vec_id", F.transform("embedding", lambda x: F.when(F.col("n") == 0, x.cast("double")).otherwise(F.round(x / F.col("n"), 4) + 0.0)).alias("unit"))


@query("SELECT user_id, n, ntile(10) OVER (ORDER BY n, user_id) AS decile FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)")
def density_decile(t):
    e = t("events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return ordering.tiled(e, [F.col("n"), F.col("user_id")], 10, "decile")


@query("SELECT text_n AS n_copies, count(*) AS n_texts, sum(labelled) AS labelled FROM (SELECT text, count(*) AS text_n, count(l.doc_id) AS labelled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY text) GROUP BY 1")
def cluster_sizes(t):
    both = t("documents").join(t("labels").select(F.col("doc_id").alias("has")), F.col("doc_id") == F.col("has"), "left")
    return both.groupBy("text").agg(F.count(F.lit(1)).alias("n_copies"), F.count("has").alias("l")).groupBy("n_copies").agg(F.count(F.lit(1)).alias("n_texts"), F.sum("l").alias("labelled"))
