"""Cuts, audits, token files and bounded rates against plain versions."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from loomwork.llm import binaries, divergence, infill, mixing, neighbours

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
ODD = [(1, "one two  three"), (1, "one two  three"), (2, ""), (3, None), (None, "a b c"), (4, "x <P> y"), (5, " lead\tand trail \n"), (6, "ünï 漢字 🙂 end"), (7, "   "), (8, "<P <S M> " * 40),
       (9, "word " * 3000), (10, "nospace" * 500), (11, "A" * 7), (12, "<"), (13, "a<P"), (14, "\x0b\x0c\r\n"), (15, " a　 b c"), *((i, f"w{i} x y z w{i}") for i in range(20, 60))]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(t, i, "clash", 7) for i, t in ODD], "text string, doc_id long, output string, n int")


def plain_cut(i, text, seed=42):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("run", [8 << 20, 40])
def test_cuts(spark, odd, monkeypatch, run):
    monkeypatch.setattr(infill, "RUN", run)
    out = infill.filled(odd.coalesce(1))
    rows = out.select("*", infill.restored(out["output"], out["form"]).alias("back")).collect()
    assert sorted(map(str, ((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in rows))) == sorted(str((i, *plain_cut(i, t))) for i, t in ODD)
    assert sorted((str(r["doc_id"]), r["back"]) for r in rows) == sorted((str(i), t or "") for i, t in ODD)
    assert infill.filled(odd.limit(0)).count() == 0


def test_outputs_without_their_signs_are_an_error():
    with pytest.raises(ValueError):
        infill.uncut(pa.array(["<P>a<S>b"]), np.array([infill.PSM]))


def plain_audit(rows, least, top):
    words = [(g or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for t, g, s in rows]
    out = []
    for lang in {w[0] for w in words}:
        own = [w for w in words if w[0] == lang]
        docs = Counter(t for _, _, ws in own for t in set(ws))
        kept = [t for t in docs if docs[t] >= least]
        counts = defaultdict(Counter)
        for _, s, ws in own:
            counts[s].update(w for w in ws if docs[w] >= least)
        whole = sum(counts.values(), Counter())
        p = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 5) // (c.total() + 5 * len(kept)) for t in kept}
        q = p(whole)
        shares = {s: p(counts[s]) for s in counts}
        for s in counts:
            pairs = [(-sum(abs(shares[s][t] - shares[o][t]) for t in kept), o.encode()) for o in counts if o != s]
            terms = [(q[t] - shares[s][t], t.encode()) for t in kept if counts[s][t] > 0 and shares[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(found, 1)]
    return sorted(map(str, out))


@pytest.mark.parametrize(("least", "held"), [(2, 200_000), (3, 5), (50, 200_000)])
def test_audit(spark, monkeypatch, least, held):
    monkeypatch.setattr(divergence, "HELD", held)
    rng = np.random.default_rng(3)
    rows = [(" ".join(rng.choice(["Alpha", "beta", "gämma", "delta9x", "ÉTÉ", "eps-ilon", "漢", "ß"], rng.integers(0, 9))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "ü", None, "c"])) for _ in range(90)]
    rows += [(None, "xx", "alone"), ("word word", "yy", "s"), ("word", "yy", "s"), *([("same same", "en", "hot")] * 40)]
    docs = spark.createDataFrame([(t, None if g is None else str(g), None if s is None else str(s), 1) for t, g, s in rows], "text string, lang string, source string, term int")
    got = [tuple(r) for r in divergence.audit(docs, least, 3).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert sorted(map(str, got)) == plain_audit(rows, least, 3)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_shares_are_exact():
    rng = np.random.default_rng(5)
    total = rng.integers(0, 9 * 10**15, 500)
    n = (total * rng.random(500)).astype(np.int64)
    assert [int(divergence.shares(a, b, 1000)) for a, b in zip(n, total)] == [1 + 10**9 * (int(a) + 5) // (int(b) + 5000) for a, b in zip(n, total)]
    with pytest.raises(OverflowError):
        divergence.shares(np.array([1]), np.array([1 << 62]), 1)


def plain_files(rows, end=2):
    t = binaries._tokenizer(binaries.vocabulary_of(public_tokenizers.path(binaries.VOCABULARY)))
    out, at = [], 0
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, end]
        out.append((i, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    return out


@pytest.mark.parametrize("shard", [1 << 20, 400])
def test_token_files(spark, odd, monkeypatch, shard):
    monkeypatch.setattr(binaries, "TOGETHER", 3)
    folder = binaries.write(odd, binaries.vocabulary_of(public_tokenizers.path(binaries.VOCABULARY)), shard_bytes=shard)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in binaries.read(spark, folder, rows=3).collect())
    want = plain_files(sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0)))
    assert got == [(s, i, n, c) for i, s, n, c in want]
    first = binaries.manifest(spark, folder).orderBy("shard").first()
    ids, offsets, _, known = binaries.shard_of(folder, first["shard"], first["n_docs"], first["n_ids"], first["width"])
    assert ids.dtype == np.uint16 and offsets[0] == 0 and not known[0] and first["base"] == 0
    with pytest.raises(ValueError):
        binaries.shard_of(folder, first["shard"], first["n_docs"], first["n_ids"] + 1, first["width"])


def test_token_files_of_nothing_and_of_wide_ids(spark, odd):
    vocabulary = binaries.vocabulary_of(public_tokenizers.path(binaries.VOCABULARY))
    assert binaries.read(spark, binaries.write(odd.limit(0), vocabulary)).count() == 0
    folder = binaries.write(odd.where("doc_id = 2"), vocabulary, end=70_000)
    row = binaries.manifest(spark, folder).first()
    assert row["width"] == 4 and binaries.shard_of(folder, *(row[c] for c in ("shard", "n_docs", "n_ids", "width")))[0].tolist() == [70_000]


def test_parts_have_the_ids_of_the_whole_text():
    t = binaries._tokenizer(binaries.vocabulary_of(public_tokenizers.path(binaries.VOCABULARY)))
    rng = np.random.default_rng(9)
    bits = ["a", "Bc", "'s", "'", " ", "  ", "\n", "\t", " ", "　", "\x85", " ", "1", "23", ".", "!?", "é", "漢", "🙂", "<|endoftext|>", "\x1c", "​", "﻿", "_"]
    texts = ["".join(rng.choice(bits, rng.integers(0, 40))) for _ in range(600)]
    parts = binaries.Parts(t, 2)
    for _ in range(2):  # afresh and from what is kept
        ids, bounds = parts.ids(pa.array(texts), 2)
        got = [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
        assert got == [[*t.encode(x, add_special_tokens=False).ids, 2] for x in texts]
    white = [c for c in map(chr, range(0x3001)) if re.fullmatch("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]", c)]
    cuts = lambda x: binaries.begins(*infill._buffers(pa.array([x]))).tolist()
    assert all(cuts(f"a{c} b") == ([0, 1] if c.isascii() else [0]) for c in white) and cuts("é b") == [0, 2]


def soft(spark, rows):
    return spark.createDataFrame([(i, n, list(p)) for i, (n, p) in enumerate(rows)], "row long, tokens long, p array<double>")


def test_rates_with_a_target_of_nothing(spark):
    out = mixing.rates(soft(spark, [(1, (0.7, 0.3))] * 50 + [(1, (0.1, 0.9))]), [1.0, 0.0])
    sums = np.sum([np.array(r["p"]) * r["rate"] * r["tokens"] for r in out.collect()], 0) / 51
    assert np.allclose(sums, [0.8448, 0.3621], atol=1e-3)


def test_rates_are_bounded_and_as_near_as_bounds_allow(spark):
    rows = [(1000, (0.98, 0.02))] * 40 + [(10, (0.3, 0.7))]
    with pytest.warns(UserWarning, match="out of reach"):
        out = mixing.rates(soft(spark, rows), [0.5, 0.5], most=3.0).collect()
    assert all(0 <= r["rate"] <= 3.0 for r in out) and max(r["rate"] for r in out) == 3.0
    # Least squares over the two rates, by trying them all.
    grid = np.linspace(0, 3, 301)
    miss = lambda a, b: (40000 * a * 0.98 + 10 * b * 0.3 - 20005) ** 2 + (40000 * a * 0.02 + 10 * b * 0.7 - 20005) ** 2
    best = min(miss(a, b) for a in grid for b in grid)
    assert miss(out[0]["rate"], out[-1]["rate"]) <= best * (1 + 1e-4)
    got = {r["domain"]: r["tokens"] for r in mixing.reached(spark.createDataFrame(out), ["x", "y"]).collect()}
    assert math.isclose(got["x"], 40000 * out[0]["rate"] * 0.98 + 10 * out[-1]["rate"] * 0.3, rel_tol=1e-9)


def test_mixed_gives_no_row_more_often_than_its_bound(spark):
    docs = spark.createDataFrame([(i, f"good text number {i} with some plain words", "en", "s", 1) for i in range(300)] + [(990, "bad", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100)] + [(990, 0, 0)], "doc_id long, quality int, toxic int")
    out = mixing.mixed(docs, labels, {"good": 0.5, "poor": 0.25, "toxic": 0.25}, keep="good")
    copies = Counter(r["doc_id"] for r in out.collect())
    assert max(copies.values()) <= 4 and out.columns == docs.columns


def test_pipeline_keeps_clean_documents_and_repeats_none_without_bound(spark):
    out = corpus_pipeline.run(spark, SF).select("doc_id").collect()
    copies = Counter(r["doc_id"] for r in out)
    known = {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 AND toxic = 0").collect()}
    assert set(copies) <= known and max(copies.values()) <= 4
    assert len(good & set(copies)) >= 0.6 * len(good)  # the rest are near copies of others


def test_pipeline_of_nothing(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def plain_nearest(rows, queries, n):
    out = []
    for q, a in queries:
        with np.errstate(over="ignore", invalid="ignore"):
            scored = [(-float(sum(np.array(a) * np.array(b))), i) for i, b in rows if i != q]
        out += [(q, k, i, -s) for k, (s, i) in enumerate(sorted(x for x in scored if x[0] == x[0])[:n], 1)]
    return sorted(out)


def test_neighbours_of_very_large_vectors_and_of_none(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(30)] + [(30, [1e200, 0.0, 1e200, 0.0, 0.0, 1.0]), (31, [-1e200, 1.0, 2.0, 0.0, 0.0, 0.0]), (32, [1e200, 0.0, -1e200, 3.0, 0.0, 0.0]), (33, [1e-200] * 6)]
    odd = [(40, None), (41, [0.0] * 6), (42, [1.0, None] * 3), (43, [float("nan")] + [1.0] * 5), (44, [float("inf")] + [1.0] * 5), (45, [1.0]), (46, [])]
    df = spark.createDataFrame(rows + odd, "id long, vec array<double>")
    got = neighbours.nearest(df, df.where("id % 3 = 0 OR id > 29"), 40)
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got.collect()) == [x[:3] for x in plain_nearest(rows, [r for r in rows if r[0] % 3 == 0 or r[0] > 29], 40)]
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0
    assert neighbours.nearest(df.where("id = 3"), df.where("id = 3")).count() == 0


def test_fingerprints_deal_texts_once(spark, tmp_path):
    rows = [(i, f"word {i} more words here", "en", "s", 20) for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    from loomwork.llm import fingerprints

    out = fingerprints.op4_document_fingerprints(spark, str(tmp_path))
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == 20
