"""Secret scans with corpus-wide ownership frequency.

Every text is scanned once for candidates. The digest of each candidate's value is then counted over the whole
corpus by distinct repositories and owners: a value that many owners hold, or many repositories of few owners, is an
example that was copied around; one that few hold looks like a live credential.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import fresh, table, written

#: Base kinds, in the order in which spans at one start are listed: pattern, group of the value, least length of it.
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]{32,}"), 0, 32),
}
#: Kinds that count only where ownership frequency marks the value as live.
EXTRA = {
    "github": (re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}"), 0, 40),
    "slack": (re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{10,}"), 0, 15),
    "google": (re.compile(r"\bAIza[A-Za-z0-9_-]{35}"), 0, 39),
    "jwt": (re.compile(r"\beyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"), 0, 30),
    "pem": (re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----[^-]*-----END (?:[A-Z]+ )?PRIVATE KEY-----"), 0, 60),
    "entropy": (re.compile(r"[A-Za-z0-9+/_-]{24,}"), 0, 24),
}
KINDS = [*BASE, *EXTRA]
#: Words of the assign kind; a text without any of them has no such span.
WORDS = ("passw", "secret", "token", "api")
#: Bits a character that a value of the kind entropy needs, and digits.
LEAST_BITS, LEAST_DIGITS = 3.6, 4

#: Repositories that make a value live whatever their owners; and of each owner, repositories that a live value is in at
#: most, or this share of those that an owner has on average, if that is more.
ALONE, FEW_REPOS, SHARE = 1, 10, 1e-3

SPAN = "struct<kind:string,start:long,end:long,digest:string,base:boolean>"


def random_looking(value: str) -> bool:
    """Whether a string mixes upper case, lower case and digits like a random token."""
    if sum(x.isdigit() for x in value) < LEAST_DIGITS or value.lower() == value or value.upper() == value:
        return False
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values()) >= LEAST_BITS


def spans_of(text: str) -> list[tuple[str, int, int, str, bool]]:
    """Candidates in a text, base kinds first: kind, start and end in code points, digest of the value, whether base."""
    found = []
    low = text.lower()
    for kind, (pattern, group, least) in BASE.items():
        if kind == "assign" and not any(w in low for w in WORDS) or kind == "access" and "AKIA" not in text:
            continue
        found += [(kind, *m.span(), m[group], True) for m in pattern.finditer(text) if len(m[group]) >= least]
    taken = sorted((s, e) for _, s, e, _, _ in found)
    for kind, (pattern, group, least) in EXTRA.items():
        for m in pattern.finditer(text):
            s, e = m.span()
            if len(m[group]) < least or kind == "entropy" and not random_looking(m[group]):
                continue
            if not any(a < e and s < b for a, b in taken):
                found.append((kind, s, e, m[group], False))
                taken.append((s, e))
    return [(k, s, e, hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest(), base) for k, s, e, v, base in found]


def _repo(repo: Column, row: Column) -> Column:
    """Name of a row's repository."""
    return F.coalesce(repo.cast("string"), F.concat(F.lit("\0"), row.cast("string")))


def scan(docs: DataFrame, doc_id: str = "doc_id", repo: str = "doc_id", owner: str = "source") -> DataFrame:
    """Candidates of every row: row long (one number for each input row), doc_id, repo, owner, spans.

    A null text counts as empty. repo and owner are read as text; null owners are one owner, and a row without
    repository is a repository of its own. Repeated rows stay apart.
    """
    own = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"),
        _repo(F.col(repo), F.monotonically_increasing_id()).alias("repo"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    kind = own.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("digest", pa.string()), ("base", pa.bool_())]))
        for b in batches:
            keys = ("kind", "start", "end", "digest", "base")
            spans = [[dict(zip(keys, x, strict=True)) for x in spans_of(t.as_py())] for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("row", "doc_id", "repo", "owner")), pa.array(spans, span)], names=["row", "doc_id", "repo", "owner", "spans"])

    return own.mapInArrow(each, f"row long, doc_id {kind}, repo string, owner string, spans array<{SPAN}>")


def ownership(candidates: DataFrame) -> DataFrame:
    """Distinct repositories and owners of each digest.

    Two groupings, each with partial sums, so that a value that is everywhere makes no large group.
    """
    owners = candidates.groupBy("digest", "owner").agg(F.lit(1).alias("one")).groupBy("digest").agg(F.count("one").alias("n_owners"))
    repos = candidates.groupBy("digest", "repo").agg(F.lit(1).alias("one")).groupBy("digest").agg(F.count("one").alias("n_repos"))
    return owners.join(repos, "digest")


def looks_live(rows: DataFrame, max_owners: int) -> Column:
    """Verdict on n_owners and n_repos of a value; rows: repo and owner of every row of the corpus.

    Live is what ALONE repositories hold at most, or what at most max_owners owners hold in few repositories of each
    on average: FEW_REPOS, or SHARE of the repositories that the corpus has for each owner.
    """
    repos, owners = rows.agg(F.count_distinct("repo"), F.count_distinct("owner")).first()
    few = max(FEW_REPOS, SHARE * repos / max(owners, 1))
    return (F.col("n_repos") <= ALONE) | ((F.col("n_owners") <= max_owners) & (F.col("n_repos") <= F.col("n_owners") * F.lit(float(few))))


def secret_spans(docs: DataFrame, max_owners: int = 2, doc_id: str = "doc_id", repo: str = "doc_id", owner: str = "source") -> DataFrame:
    """Spans of every row of docs with their verdicts.

    Returns row, doc_id, spans: array of kind, start, end, base, n_owners, n_repos, live, by start, then by kind
    as listed. A value is live if few owners and few repositories hold it (looks_live); else it is an example. Base spans
    stay whatever their verdict; others only if live. Rows without spans have an empty array, and no rows in
    give no rows out.
    """
    scanned = written(scan(docs, doc_id, repo, owner), "secrets")
    c = scanned.where(F.size("spans") > 0).select("row", "repo", "owner", F.explode("spans").alias("s")).select("row", "repo", "owner", "s.*")
    judged = c.join(ownership(c), "digest").withColumn("live", looks_live(scanned, max_owners)).where("base OR live")
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    kept = judged.groupBy(F.col("row").alias("of")).agg(
        F.array_sort(F.collect_list(F.struct("start", order.alias("rank"), "end", "kind", "base", "n_owners", "n_repos", "live"))).alias("spans")
    )
    none = F.from_json(F.lit("[]"), kept.schema["spans"].dataType)
    return scanned.select("row", "doc_id").join(kept, F.col("row") == F.col("of"), "left").select("row", "doc_id", F.coalesce("spans", none).alias("spans"))


def redact(docs: DataFrame, max_owners: int = 2, mark: str = "[SECRET]") -> DataFrame:
    """docs with each live span of text replaced by mark, and n_chars to match; other columns as they were.

    Examples, which many owners or repositories hold (looks_live), stay. Null texts stay null. Only rows with a candidate are joined to verdicts.
    """
    row, spans, of, hits = fresh(docs, "_row", "_spans", "_of", "_live")
    rows = docs.withColumn(row, F.monotonically_increasing_id())
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("digest", pa.string()), ("base", pa.bool_())]))
    keys = ("kind", "start", "end", "digest", "base")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[dict(zip(keys, x, strict=True)) for x in spans_of(t.as_py() or "")] for t in b.column("text")]
            yield b.append_column(spans, pa.array(found, span))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    kept = written(rows.mapInArrow(each, f"{fields}, `{spans}` array<{SPAN}>"), "secrets-docs")
    some = kept.where(F.size(spans) > 0)
    owner = F.coalesce(F.col("source").cast("string"), F.lit("")).alias("owner")
    repo = _repo(F.col("doc_id"), F.col(row)).alias("repo")
    c = some.select(F.col(row).alias("_row"), repo, owner, F.explode(spans).alias("s")).select("_row", "repo", "owner", "s.*")
    live = c.join(ownership(c), "digest").where(looks_live(kept.select(repo, owner), max_owners))
    live = live.groupBy(F.col("_row").alias(of)).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(hits))

    def step(state: Column, x: Column) -> Column:
        fresh = x["end"] > state["at"]
        inside = x["start"] < state["at"]
        begin = F.greatest(x["start"], state["at"])
        add = F.concat(state["out"], F.substring(F.col("text"), (state["at"] + 1).cast("int"), (begin - state["at"]).cast("int")), F.when(inside, F.lit("")).otherwise(F.lit(mark)))
        return F.struct(F.when(fresh, add).otherwise(state["out"]).alias("out"), F.greatest(state["at"], x["end"]).alias("at"))

    clean = F.aggregate(
        hits, F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")), step,
        lambda s: F.concat(s["out"], F.substring(F.col("text"), (s["at"] + 1).cast("int"), F.length("text"))),
    )
    out = some.join(live, F.col(row) == F.col(of), "left").withColumn("text", F.when(F.col(hits).isNull(), F.col("text")).otherwise(clean))
    out = out.withColumn("n_chars", F.when(F.col(hits).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return kept.where(F.size(spans) == 0).select(*docs.columns).unionByName(out.select(*docs.columns))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of documents.

    n_live and n_example count the spans on either side of the ownership frequency.
    """
    found = secret_spans(table(spark, sf_dir, "documents"))
    say = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["base"])
    count = lambda test: F.size(F.expr(f"filter(spans, x -> {test})")).cast("long")
    return found.select(
        "doc_id", *(count(f"x.kind = '{k}'").alias(f"n_{k}") for k in BASE),
        F.sha2(say(base), 256).alias("base_sha256"), say("spans").alias("spans"),
        count("x.live").alias("n_live"), count("NOT x.live").alias("n_example"),
    )
