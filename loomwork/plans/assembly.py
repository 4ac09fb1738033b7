"""Queries of record assembly and audit, registered beside the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classes as C
from ..functions import expressions as X
from ..operators import candidates, digests, ordering, projections, validation
from ..operators import records as A
from ..sources.places import new_folder
from ..sources import hits, reports, steps, text
from .catalogue import query, r6

SALT = "third-salt-of-thirty-two-characters-or-so"


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def first_seen_rows(t):
    return A.first_seen(t("events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


@query("""WITH r AS (SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN 'helix' WHEN l_returnflag = 'A' THEN 'sheet' ELSE 'turn' END AS kind, l_linenumber * 5 - 6 AS s, l_linenumber * 5 + l_quantity::INT % 9 - 6 AS e FROM lineitem),
p AS (SELECT l_orderkey, kind, unnest(range(greatest(s, 1), least(e, 30) + 1)) AS pos FROM r),
w AS (SELECT l_orderkey, pos, bool_or(kind = 'helix') AS h, bool_or(kind = 'sheet') AS b FROM p GROUP BY 1, 2)
SELECT o_orderkey, round(count(*) FILTER (h) / 30, 6) AS helix, round(count(*) FILTER (b AND NOT h) / 30, 6) AS sheet FROM orders LEFT JOIN w ON l_orderkey = o_orderkey GROUP BY 1""")
def annotated_residue_shares(t):
    kind = F.when(F.col("l_returnflag") == "R", "helix").when(F.col("l_returnflag") == "A", "sheet").otherwise("turn")
    first = (F.col("l_linenumber") * 5 - 6).cast("int")
    ranges = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), kind.alias("kind"), first.alias("first"), (first + F.col("l_quantity").cast("int") % 9).alias("last"))
    out = A.annotated_shares(t("orders").select("o_orderkey", F.lit(30).alias("n")), ranges, "o_orderkey", ["helix", "sheet"])
    return out.select("o_orderkey", r6(F.col("helix")).alias("helix"), r6(F.col("sheet")).alias("sheet"))


@query(f"""WITH s AS (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY sha256('{SALT}:' || vec_id || ':' || i)) AS rn FROM embeddings, (SELECT unnest(range(1, 64)) AS i)),
k AS (SELECT vec_id, i FROM s WHERE rn < 8 UNION ALL SELECT vec_id, 0 FROM embeddings) SELECT vec_id, string_agg(i::VARCHAR, ',' ORDER BY i) AS places FROM k GROUP BY 1""")
def row_sample_places(t):
    e = t("embeddings").select("vec_id", F.transform("embedding", lambda x, i: i).alias("rows"))
    return e.select("vec_id", F.array_join(A.row_sample(F.col("rows"), 8, SALT, F.col("vec_id")).cast("array<string>"), ",").alias("places"))


@query("""WITH a AS (SELECT l_orderkey, l_orderkey % 1000 AS batch, list(l_quantity::INT ORDER BY l_linenumber, l_quantity) AS q FROM lineitem GROUP BY 1),
m AS (SELECT batch, max(len(q)) AS n FROM a GROUP BY 1)
SELECT l_orderkey, array_to_string(list_concat(q, list_transform(range(0, n - len(q)), lambda i: 21)), ',') AS filled, len(q)::BIGINT AS n_real, true AS consistent FROM a JOIN m USING (batch)""")
def padded_batches(t):
    li = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q")))).alias("x"))
    rows = li.select("l_orderkey", (F.col("l_orderkey") % 1000).alias("batch"), F.col("x.q").alias("q"))
    real = F.size(F.filter("mask", lambda x: x)).cast("long")
    return A.padded_batch(rows, "batch", {"q": 21}).select("l_orderkey", F.array_join(F.col("q").cast("array<string>"), ",").alias("filled"), real.alias("n_real"), "consistent")


@query("""WITH a AS (SELECT l_orderkey, l_linenumber * 2 AS pos, l_quantity::INT AS q FROM lineitem),
p AS (SELECT l_orderkey, i, max(CASE WHEN pos = i THEN q END) AS q FROM a, (SELECT unnest(range(0, 12)) AS i) GROUP BY 1, 2)
SELECT l_orderkey, string_agg(coalesce(q, 20)::VARCHAR, ',' ORDER BY i) AS template FROM p GROUP BY 1""")
def template_scatter(t):
    li = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct((F.col("l_linenumber") * 2).cast("int").alias("at"), F.col("l_quantity").cast("int").alias("q")))).alias("x"))
    return li.select("l_orderkey", F.array_join(A.scattered(F.lit(12), F.col("x.at"), F.col("x.q"), 20).cast("array<string>"), ",").alias("template"))


@query("""SELECT vec_id, (CASE WHEN vec_id % 5 = 0 THEN 3 ELSE len(embedding) END * 14)::BIGINT AS n, round(CASE WHEN vec_id % 5 = 0 THEN -42.0 ELSE list_sum(list_transform(embedding, lambda x: x::DOUBLE)) * 14 END, 3) AS total FROM embeddings""")
def slots_or_default(t):
    given = F.when(F.col("vec_id") % 5 != 0, F.col("embedding").cast("array<double>"))
    flat = F.flatten(A.in_slots(A.array_or(given, F.lit(3), -1.0), 14))
    return t("embeddings").select("vec_id", F.size(flat).cast("long").alias("n"), X.rounded(F.aggregate(flat, F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


@query("""WITH r AS (SELECT DISTINCT o_custkey AS k FROM orders), e AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_acctbal > 0)
SELECT count(*) FILTER (r.k IS NOT NULL AND e.k IS NOT NULL) AS kept, count(*) FILTER (e.k IS NULL) AS removed, count(*) FILTER (r.k IS NULL) AS missing FROM r FULL JOIN e ON r.k = e.k""")
def prune_counts(t):
    return A.prune_report(t("orders").select(F.col("o_custkey").alias("k")), t("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")), "k")


@query("""WITH e AS (SELECT c_mktsegment AS split, c_custkey AS k FROM customer), r AS (SELECT DISTINCT o_custkey AS k FROM orders)
SELECT split, count(*) AS n, count(*) FILTER (r.k IS NULL) AS n_missing, coalesce(sum(CASE WHEN r.k IS NOT NULL THEN ('0x' || substr(sha256(r.k::VARCHAR), 1, 12))::BIGINT END), 0)::VARCHAR AS digest
FROM e LEFT JOIN r ON e.k = r.k GROUP BY 1""")
def split_fingerprints(t):
    expected = t("customer").select(F.col("c_mktsegment").alias("split"), F.col("c_custkey").alias("k"))
    return A.split_fingerprint(t("orders").select(F.col("o_custkey").alias("k")), expected, "split", "k")


@query(f"""(SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING')
UNION ALL (SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING' ORDER BY sha256('{SALT}:' || c_custkey), c_custkey LIMIT 50)""")
def background_capped(t):
    return A.capped_background(t("customer").select("c_custkey", "c_mktsegment"), F.col("c_mktsegment") == "BUILDING", 50, SALT, "c_custkey")


@query("""SELECT right('000' || p_partkey, 4) || '_' || CASE WHEN p_size % 2 = 0 THEN 'A' ELSE 'B' END AS chain,
list_sort(list(DISTINCT CASE p_size % 6 WHEN 1 THEN 'alpha' WHEN 2 THEN 'beta' WHEN 3 THEN 'alpha_beta' WHEN 4 THEN 'coil_or_sparse' ELSE (p_size % 6)::VARCHAR END)) AS classes FROM part GROUP BY 1""")
def annotation_list_classes(t):
    chain = F.when(F.col("p_size") % 2 == 0, "A").otherwise("B")
    line = F.concat(F.lit(" "), F.substring(F.concat(F.lit("000"), F.col("p_partkey").cast("string")), -4, 4), chain, F.lit("00 \t"), (F.col("p_size") % 6).cast("string"), F.lit(" 10"))
    return text.annotated(text.cath_classes(t("part").select(line.alias("value"))))


@query("""SELECT o_orderkey, CASE left(o_orderpriority, 1) WHEN '1' THEN 'alpha' WHEN '2' THEN 'beta' WHEN '3' THEN 'alpha_beta' WHEN '4' THEN 'coil_or_sparse' ELSE 'other' END AS class FROM orders""")
def letter_class(t):
    letter = F.translate(F.substring("o_orderpriority", 1, 1), "12345", "abcgk")
    return t("orders").select("o_orderkey", C.class_of_sccs(F.concat(letter, F.lit(".1.2"))).alias("class"))


@query("""SELECT s_suppkey, 'AC-D' AS query, 'A-GD' AS template, s_nationkey || ':4,' || (s_nationkey + 2) || ':6' AS pairs FROM supplier WHERE s_suppkey % 2 = 0""")
def hit_alignment_pairs(t):
    start = (F.col("s_nationkey") + 1).cast("string")
    name = F.when(F.col("s_suppkey") % 2 == 0, "1abc_A").otherwise("none?")
    lines = [F.concat(name, F.lit(" some name")), F.lit("Probab=9.1  E-value=2"), F.lit("Q Consensus 1 acxd 3 (9)"), F.concat(F.lit("Q query "), start, F.lit(" AC-D 3 (9)")),
             F.lit("T Consensus 1 axgd 3 (9)"), F.lit("T 1abc_A  5 A-GD 7 (20)"), F.lit("No 2"), F.lit("T 1abc_A 9 ACGD 12 (20)")]
    found = hits.hits(t("supplier").select("s_suppkey", F.concat_ws("\n", *lines).alias("value")))
    pairs = F.array_join(F.transform("pairs", lambda x: F.concat_ws(":", x["q"], x["t"])), ",")
    return found.select("s_suppkey", "query", "template", pairs.alias("pairs"))


@query(r"""WITH e AS (SELECT s_suppkey, 'track ' || s_nationkey AS track, s_name AS name, CASE WHEN s_suppkey % 3 > 0 THEN s_acctbal END AS score FROM supplier),
r AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY score DESC NULLS LAST, name) AS rank FROM e)
SELECT track, rank::INT AS rank, '| ' || rank || ' | ' || name || ' | a\|b | ' || coalesce(printf('%.4f', score), 'n/a') || ' | n/a | 0.5000 | 2024 | `' || substr(sha256(name), 1, 7) || '` |  |' AS line FROM r""")
def leaderboard_lines(t):
    score = F.when(F.col("s_suppkey") % 3 > 0, F.col("s_acctbal")).cast("double")
    return reports.ranked_lines(t("supplier").select(
        F.concat(F.lit("track "), F.col("s_nationkey").cast("string")).alias("track"), F.col("s_name").alias("name"), F.lit("a|b").alias("team"), score.alias("rank_score"),
        F.lit(float("nan")).alias("hidden"), F.lit(0.5).alias("public"), F.lit("2024").alias("date"), F.sha2("s_name", 256).alias("commit"), F.lit(None).cast("string").alias("description"),
    ))


@query("""SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size > 40 THEN 'large' END, CASE WHEN p_partkey % 3 = 0 THEN 'refused' END, CASE WHEN p_partkey % 4 = 0 THEN 'forbidden' END], lambda x: x IS NOT NULL), ',') AS faults FROM part""")
def file_fault_lists(t):
    k = F.col("p_partkey")
    path = F.concat(F.when(k % 4 == 0, "private/").otherwise("public/"), k.cast("string"), F.when(k % 3 == 0, ".PT").otherwise(".py"))
    faults = reports.file_faults(path, F.col("p_size").cast("long") * (1 << 19), ("private/",))
    return t("part").select("p_partkey", F.array_join(faults, ",").alias("faults"))


_JSON_SQL = """WITH w AS (SELECT p_partkey, ['helix', 'plain', 'all-Alpha', 'beta barrel', 'x'][(p_partkey % 5 + 1)::INT] AS a, ['strand', 'CATH 3.10', 'beta', 'word', 'scop'][(p_size % 5 + 1)::INT] AS b FROM part WHERE p_partkey % 7 <> 3),
c AS (SELECT *, lower(a || ' ' || b) AS t FROM w),
k AS (SELECT p_partkey, unnest([CASE WHEN contains(t, 'cath') THEN 'cath_annotated' END, CASE WHEN contains(t, 'scop') THEN 'scope_annotated' END,
  CASE WHEN contains(t, 'alpha') AND contains(t, 'beta') THEN 'alpha_beta' WHEN contains(t, 'helix') OR contains(t, 'alpha') THEN 'alpha' WHEN contains(t, 'sheet') OR contains(t, 'strand') OR contains(t, 'beta') THEN 'beta' END]) AS class FROM c)
SELECT 'p' || p_partkey AS chain, array_to_string(list_sort(list(class)), ',') AS classes FROM k WHERE class IS NOT NULL GROUP BY 1"""


def _json_lines(t):
    word = lambda words, at: F.get(F.array(*map(F.lit, words)), at.cast("int"))
    k = F.col("p_partkey")
    a = F.struct(F.array(F.struct(word(["helix", "plain", "all-Alpha", "beta barrel", "x"], k % 5).alias("method"), F.lit(1).alias("n"))).alias("exptl"))
    b = F.array(F.array(word(["strand", "CATH 3.10", "beta", "word", "scop"], F.col("p_size") % 5)), F.array(F.lit('quote " and \\\\ bar')))
    line = F.to_json(F.struct(F.concat(F.lit("p"), k.cast("string")).alias("chain_id"), a.alias("entry"), b.alias("alpha beta names are no values")))
    return t("part").select(F.when(k % 7 == 3, F.substr(line, F.lit(1), F.length(line) - 2)).otherwise(line).alias("value"))


@query(_JSON_SQL)
def keyword_annotations(t):
    own = text.annotated(text.keyword_classes(_json_lines(t)))
    return own.select("chain", F.array_join("classes", ",").alias("classes"))


@query("SELECT 'p' || p_partkey AS chain, ['helix', 'plain', 'all-Alpha', 'beta barrel', 'x'][(p_partkey % 5 + 1)::INT] AS method, NULL::VARCHAR AS missing FROM part WHERE p_partkey % 7 <> 3")
def nested_values(t):
    v = _json_lines(t).select(F.expr("try_parse_json(value)").alias("v")).where("v IS NOT NULL")
    return v.select(text.plucked(F.col("v"), "chain_id").alias("chain"), text.plucked(F.col("v"), "entry", "exptl", "method").alias("method"), text.plucked(F.col("v"), "entry", "no", "such").alias("missing"))


_FIELDS = ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"]
_ROW_SQL = "sha256(array_to_string([" + ", ".join(f"coalesce(length({c}) || ':' || {c}, '-')" for c in ("k", "c_name", "c_mktsegment")) + "], ','))"
_TREE_SQL = """WITH l AS (SELECT substr(r, 1, 2) AS prefix, count(*) AS n, sha256(string_agg(r || chr(9) || 1 || chr(10), '' ORDER BY r)) AS digest FROM d GROUP BY 1),
m AS (SELECT substr(prefix, 1, 1) AS prefix, sum(n)::BIGINT AS n, sha256(string_agg(prefix || chr(9) || digest || chr(10), '' ORDER BY prefix)) AS digest FROM l GROUP BY 1),
o AS (SELECT '' AS prefix, sum(n)::BIGINT AS n, sha256(string_agg(prefix || chr(9) || digest || chr(10), '' ORDER BY prefix)) AS digest FROM m)"""


def _customers(t):
    return t("customer").select(F.col("c_custkey").cast("string").alias("k"), "c_name", "c_mktsegment")


@query(f"WITH d AS (SELECT {_ROW_SQL} AS r FROM (SELECT c_custkey::VARCHAR AS k, c_name, c_mktsegment FROM customer)), {_TREE_SQL[5:]} SELECT * FROM l UNION ALL SELECT * FROM m UNION ALL SELECT * FROM o")
def tree_digest(t):
    return digests.tree(digests.buckets(_customers(t), ["k", "c_name", "c_mktsegment"], digits=2), digits=2)


@query("""WITH a AS (SELECT c_custkey::VARCHAR AS k, c_name FROM customer WHERE c_custkey % 50 <> 7), b AS (SELECT c_custkey::VARCHAR AS k, CASE WHEN c_custkey % 40 = 3 THEN NULL ELSE c_name END AS c_name FROM customer)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN b.c_name ELSE a.c_name END AS c_name, (a.k IS NOT NULL)::BIGINT AS n_a, (b.k IS NOT NULL)::BIGINT AS n_b
FROM a FULL JOIN b ON a.k = b.k AND a.c_name IS NOT DISTINCT FROM b.c_name WHERE a.k IS NULL OR b.k IS NULL""")
def changed_rows_located(t):
    c = t("customer").select("c_custkey", F.col("c_custkey").cast("string").alias("k"), "c_name")
    b = c.select("k", F.when(F.col("c_custkey") % 40 != 3, F.col("c_name")).alias("c_name"))
    return digests.changed_rows(c.where("c_custkey % 50 <> 7").select("k", "c_name"), b, ["k", "c_name"], 3)


@query("SELECT 'file' AS kind, row_number() OVER (ORDER BY c_custkey) - 1 AS line, c_name AS value FROM customer")
def lines_numbered(t):
    names = t("customer").select("c_custkey", "c_name").coalesce(1).sortWithinPartitions("c_custkey").select("c_name")
    path = new_folder(names.sparkSession, "names")
    names.write.text(path)
    return ordering.numbered_lines(names.sparkSession, path).select(F.lit("file").alias("kind"), "line", "value")


@query("""WITH v AS (SELECT vec_id, vec_id % 11 AS k, 4 + vec_id % 5 AS l FROM embeddings),
m AS (SELECT vec_id, list_filter([
  CASE WHEN k = 1 THEN 'Missing key `aatype`' END, CASE WHEN k IN (1, 2) THEN 'Missing key `template_ca_mask`' END,
  CASE WHEN k = 3 THEN '`aatype` dtype must be int32/int64 (got float32)' END, CASE WHEN k = 4 THEN '`template_ca_mask` dtype must be bool (got int32)' END,
  CASE WHEN k = 5 THEN '`aatype` must have shape (L), got (' || l || ', 2)' END,
  CASE WHEN k = 6 THEN '`msa` must have shape (N, L), got (' || l || ')' END, CASE WHEN k = 7 THEN '`msa` dimension 2 must equal L=' || l || ', got ' || (l + 1) END,
  CASE WHEN k = 8 THEN '`deletions` dimension 1 must equal N=3, got 2' END, CASE WHEN k = 9 THEN '`template_ca_coords` must have shape (T, L, 3), got (2, ' || l || ', 4)' END], lambda x: x IS NOT NULL) AS faults FROM v)
SELECT vec_id, array_to_string(faults, '; ') AS faults FROM m""")
def records_validated(t):
    k, n = F.col("vec_id") % 11, (F.col("vec_id") % 5 + 4).cast("int")
    array = lambda name, kind, *dims: F.struct(F.lit(name).alias("key"), kind.alias("kind"), F.array(*dims).alias("shape"))
    i, f, b = F.lit("int32"), F.lit("float32"), F.lit("bool")
    aatype = F.when(k == 5, array("aatype", i, n, F.lit(2))).when(k != 1, array("aatype", F.when(k == 3, f).otherwise(i), n))
    msa = F.when(k == 6, array("msa", i, n)).otherwise(array("msa", i, F.lit(3), F.when(k == 7, n + 1).otherwise(n)))
    every = F.array(aatype, msa, array("deletions", i, F.when(k == 8, 2).otherwise(3), n), array("template_aatype", i, F.lit(2), n), array("template_ca_coords", f, F.lit(2), n, F.when(k == 9, 4).otherwise(3)),
                    F.when(~k.isin(1, 2), array("template_ca_mask", F.when(k == 4, i).otherwise(b), F.lit(2), n)))
    rows = t("embeddings").select("vec_id", F.explode(F.array_compact(every)).alias("x")).select("vec_id", "x.*")
    return validation.validated(validation.gathered(rows, "vec_id"), validation.FEATURES).select("vec_id", F.array_join("faults", "; ").alias("faults"))


@query("""WITH v AS (SELECT l_returnflag AS k, CASE WHEN l_linenumber < 7 THEN l_extendedprice END AS v FROM lineitem),
s AS (SELECT k, count(v) AS n, count(*) - count(v) AS n_missing, quantile_cont(v, [0.0, 0.05, 0.5, 0.95, 1.0]) AS q FROM v GROUP BY 1)
SELECT k, n, n_missing, unnest([0.0, 0.05, 0.5, 0.95, 1.0])::DOUBLE AS share, round(unnest(q), 6) AS quantile FROM s""")
def exact_quantiles(t):
    v = t("lineitem").select(F.col("l_returnflag").alias("k"), F.when(F.col("l_linenumber") < 7, F.col("l_extendedprice")).alias("v"))
    return projections.quantiles(v, "k", "v", [0.0, 0.05, 0.5, 0.95, 1.0]).withColumn("quantile", r6(F.col("quantile")))


@query("""WITH h AS (SELECT DISTINCT sha256(p_type) AS d FROM part WHERE p_size < 5), m AS (SELECT p_brand AS split, p_retailprice AS v, sha256(p_type) IN (SELECT d FROM h) AS hidden FROM part),
s AS (SELECT split AS set, v FROM m UNION ALL SELECT CASE WHEN hidden THEN 'hidden_val' ELSE 'non_train_source_pool' END, v FROM m WHERE hidden OR split <> 'Brand#1')
SELECT set, count(*) AS n, round(quantile_cont(v, 0.5), 6) AS quantile FROM s GROUP BY 1""")
def hidden_overlay_quantiles(t):
    p = t("part").select(F.col("p_brand").alias("split"), F.col("p_retailprice").alias("v"), F.sha2("p_type", 256).alias("digest"), "p_size")
    sets = projections.in_sets(projections.overlaid(p, "digest", p.where("p_size < 5")), "split", train="Brand#1")
    return projections.quantiles(sets, "set", "v", [0.5]).select("set", "n", r6(F.col("quantile")).alias("quantile"))


@query(None)
def principal_plane(t):
    return projections.projected(t("embeddings"), "embedding", ["x", "y"], 64).select("vec_id", "x", "y")


@query("""SELECT o_orderkey, o_totalprice, (o_orderkey % 5)::BIGINT AS step FROM orders WHERE o_orderkey % 5 <= 3""")
def resumed_steps(t):
    own = t("orders").select("o_orderkey", "o_totalprice")
    spark, folder = own.sparkSession, new_folder(own.sparkSession, "steps")
    for step in (0, 1, 2, 4):
        steps.append(own.where(F.col("o_orderkey") % 5 == step), folder, step)
    steps.cut_back(folder, 2)
    for step in (0, 1, 2, 3):  # taken up again: what is there is not written twice
        steps.append(own.where(F.col("o_orderkey") % 5 == step), folder, step)
    return steps.read(spark, folder, "o_orderkey long, o_totalprice double")


_CANDIDATES_SQL = """WITH c AS (SELECT p_partkey, p_partkey % 9 AS k, replace(upper(p_type), ' ', '') AS s, p_size FROM part),
f AS (SELECT p_partkey, k, s, CASE WHEN k % 3 < 2 THEN p_size ELSE length(s) END AS l, CASE WHEN k % 2 = 0 THEN p_size / 10 ELSE 999 END AS r, CASE WHEN k = 4 THEN 2 ELSE 1 END AS n,
  length(regexp_replace(s, '[ACDEFGHIKLMNPQRSTVWY]', '', 'g')) / length(s) AS u FROM c)
SELECT p_partkey, array_to_string(CASE WHEN k = 8 THEN ['bad_metadata'] WHEN k = 7 THEN ['missing_sequence'] ELSE list_filter([CASE WHEN l < 10 THEN 'min_length' END, CASE WHEN l > 40 THEN 'max_length' END,
  CASE WHEN r <> 999 AND r > 3 THEN 'resolution' END, CASE WHEN n <> 1 THEN 'oligomeric_count' END, CASE WHEN u > 0.1 THEN 'unknown_aa_fraction' END], lambda x: x IS NOT NULL) END, ',') AS faults FROM f"""


@query(_CANDIDATES_SQL)
def candidate_faults(t):
    k, size = F.col("p_partkey") % 9, F.col("p_size")
    item = lambda name, value: F.concat(F.lit(f'"{name}": '), value)
    number = size.cast("string")
    items = F.array_compact(F.array(
        F.when(k != 7, item("seq", F.concat(F.lit('" '), F.lower(F.replace("p_type", F.lit(" "), F.lit(""))), F.lit('"')))), item("sequence", F.when(k == 7, "12").otherwise("null")),
        F.when(k % 3 == 0, item("seq_length", number)).when(k % 3 == 1, item("sequence_length", F.concat(F.lit('"'), number, F.lit('"')))), F.when(k % 2 == 0, item("resolution", (size / 10).cast("string"))),
        F.when(k == 4, item("num_chains", F.lit('"2"'))),
    ))
    meta = F.when(k == 8, "[1]").otherwise(F.concat(F.lit("{"), F.array_join(items, ", "), F.lit("}")))
    read = candidates.read(t("part").select("p_partkey", meta.alias("meta")), "p_partkey")
    return read.select("p_partkey", F.array_join(candidates.all_faults(10, 40, 3.0, 0.1), ",").alias("faults"))


@query("""WITH o AS (SELECT o_custkey, row_number() OVER w AS i, o_totalprice AS y, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice / 2 ELSE o_totalprice END AS z FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
u AS (UNPIVOT (SELECT o_custkey, i, y AS price, z AS half FROM o) ON price, half INTO NAME component VALUE v),
a AS (SELECT o_custkey, component, i, v, (v + lag(v) OVER (PARTITION BY o_custkey, component ORDER BY i)) / 2 AS area FROM u)
SELECT o_custkey, component, count(*) AS n_points, round(CASE WHEN count(*) = 1 THEN any_value(v) ELSE sum(area) / 20 END, 4) AS auc, round(arg_max(v, i), 4) AS final, round(arg_min(v, i), 4) AS at_first FROM a GROUP BY 1, 2""")
def curve_components(t):
    from pyspark.sql import Window

    from ..operators import curves

    o = t("orders").withColumn("i", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")))
    rows = o.select("o_custkey", "i", (F.col("i") * 100).alias("step"), F.col("o_totalprice").alias("price"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice") / 2).alias("half"))
    out = curves.report(rows, "o_custkey", "i", "step", "price", ["half"], 20.0)
    return out.select("o_custkey", "component", "n_points", F.round("auc", 4).alias("auc"), F.round("final", 4).alias("final"), F.round(F.try_element_at("at_steps", F.lit("100")), 4).alias("at_first"))
