"""Each training-data operator against a plain version on small fixtures with awkward rows."""


import math
import re



import numpy as np
import pytest

from loomwork.llm import chat, fingerprints, licenses, mixing, neardup, neighbours, pieces, quality, secrets, substrings

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BASE = "the quick brown fox jumps over a lazy dog while nine small birds sing loud songs near old stone walls".split()


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)


@pytest.fixture
def odd(spark):
    long = " ".join(f"w{i % 700}" for i in range(9000))
    rows = [(1, " ".join(BASE), "a"), (2, " ".join(BASE), "b"), (3, " ".join([*BASE, "more"]), None), (4, "", "a"), (5, None, "a"), (6, long, "a"),
            (7, "x " + long, "b"), (8, "one", "c"), (9, "one", "c"), (10, "é ü 漢字 \t\n x", "c"), (11, "   ", "d"), (None, " ".join(BASE), "d")]
    return docs(spark, rows)


def plain_substrings(rows, size=13):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    key = lambda i: (1 << 63) - 1 if i is None else i
    first = {}
    for i, w in words:
        for p in range(len(w) - size + 1):
            g = tuple(w[p : p + size])
            first[g] = min(first.get(g, key(i)), key(i))
    out = []
    for i, w in words:
        gone = {p + k for p in range(len(w) - size + 1) if first[tuple(w[p : p + size])] < key(i) for k in range(size)}
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=str)


def test_substrings(spark, odd):
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substrings.cleaned(odd).collect()), key=str)
    assert got == plain_substrings([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert substrings.cleaned(odd.limit(0)).count() == 0


@pytest.mark.parametrize("sent", [0, 10])
def test_substrings_of_rows_that_share_an_id(spark, monkeypatch, sent):
    monkeypatch.setattr(substrings, "MOST_SENT", sent, raising=False)
    other, third = [f"u{i}" for i in range(40)], [f"t{i}" for i in range(30)]
    rows = [(1, BASE), (None, BASE), (None, other), (None, [*third, *BASE, *third[:3], *BASE]), (None, []), (None, other), (5, []), (5, [*third, *BASE[:14]]), (5, third),
            (5, ["x", *BASE, *BASE]), (5, third), (7, [*other[:20], *third]), (None, None)]
    rows = [(i, None if w is None else " ".join(w)) for i, w in rows]
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substrings.cleaned(docs(spark, [(i, t, "a") for i, t in rows]).coalesce(1)).collect()), key=str)
    assert got == plain_substrings(rows)


def plain_groups(rows, k, percent):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()

    sets = {i: shingles(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return {i: (len(sets[i]), root[i], root[i] == i) for i in sets}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, odd, k, percent):
    rng = np.random.default_rng(3)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    words = [f"v{i}" for i in range(200)]
    for n in range(40):  # copies of one text that are nearer to it than to each other
        w = list(words)
        for p in rng.choice(200, 2, replace=False):
            w[p] = f"z{n}_{p}"
        rows.append((100 + n, " ".join(w)))
    rows.append((150, " ".join(words)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs(spark, [(i, t, "s") for i, t in rows]), k, percent).collect() if r["doc_id"] is not None}
    assert got == plain_groups(rows, k, percent)


@pytest.mark.parametrize(("long", "most", "part"), [(150, 4, 4000), (150, 5, 20), (700, 18, 20)])
def test_group_without_a_centre(spark, monkeypatch, long, most, part):
    monkeypatch.setattr(neardup, "PART", part)
    rng = np.random.default_rng(long + most)
    rows = []
    for n in range(120):  # similarities of two copies lie about the least one asked for
        w = [f"v{i}" for i in range(long)]
        for p in rng.choice(long, rng.integers(1, most), replace=False):
            w[p] = f"z{n}_{p}"
        rows.append((int(n * 7 % 120), " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs(spark, [(i, t, "s") for i, t in rows]), 3, 85).collect()}
    assert got == plain_groups(rows, 3, 85)


def test_one_row_of_each_group_stays(spark):
    near, alone = " ".join([*BASE, "more"]), " ".join(f"u{i}" for i in range(20))
    rows = [(None, " ".join(BASE), "n"), (3, near, "a"), (2, " ".join(BASE), "b"), (2, " ".join(BASE), "c"), (None, near, "n"), (2, alone, "d"), (2, alone, "e"),
            (None, "only here", "f"), (None, "only here", "g"), (None, "Only HERE", "h"), (4, "", "i"), (4, "", "j"), (5, "", "k"), (None, None, "l"), (None, None, "m")]
    got = [(r["doc_id"], r["text"], r["source"]) for r in neardup.one_of_each(docs(spark, rows).coalesce(1)).collect()]
    want = [(2, " ".join(BASE), "b"), (2, alone, "d"), (None, "only here", "f"), (4, "", "i"), (5, "", "k"), (None, None, "l")]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("rows", [[(7, " ".join(BASE), "s")] * 6, [(None, " ".join(BASE), "s")] * 6])
def test_one_of_repeated_rows_stays(spark, rows):
    assert neardup.one_of_each(docs(spark, rows)).count() == 1


def test_chat(spark):
    log = [("c", 1, "u1", "message", "user", "hi <|im_end|>"), ("c", 2, "a1", "message", "assistant", ""), ("c", 3, "a1", "delta", None, "bad"),
           ("c", 4, "a1", "regenerate", None, None), ("c", 5, "a1", "delta", None, "go"), ("c", 6, "a1", "delta", None, "od <\\|x|>"), ("c", 7, "u1", "edit", None, "hello"),
           ("c", 8, "x", "message", "user", "gone"), ("c", 9, "x", "delete", None, None), (None, 1, "m", "message", "assistant", None)]
    events = spark.createDataFrame(log, "conv_id string, seq long, message_id string, kind string, role string, text string")
    turns = chat.parse(chat.render(chat.reconstruct(events))).orderBy("conv_id", "place").collect()
    assert [(r["conv_id"], r["role"], r["text"], r["loss"]) for r in turns] == [
        (None, "assistant", "", ""), ("c", "user", "hello", None), ("c", "assistant", "good <\\|x|>", "good <\\|x|>")
    ]


def test_fingerprints(spark, odd):
    rows = {(r["doc_id"], r["place"], r["bucket"]): r for r in fingerprints.with_next(odd.select("doc_id", "text")).where("NOT guest").collect()}
    assert len(rows) == 12
    order = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in odd.collect()), reverse=True)
    after = {a[1]: b[2] for a, b in zip(order, [*order[1:], order[0]]) if a[0]}
    for r in rows.values():
        if r["doc_id"] is not None:
            assert (r["next_text"] or "") == after[r["doc_id"]]


def test_secrets():
    text = 'Token : "abc/def+9" x AKIA' + "Q" * 16 + " PASSWORD=short " + "0a" * 16 + " sſecret=notasciilong secret=token=abcdefgh"
    base = [(k, s, e) for k, s, e, _, b in secrets.spans_of(text) if b]
    want = [("assign", *m.span()) for m in secrets.BASE["assign"][0].finditer(text) if len(m[2]) >= 8]
    want += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16] + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    assert sorted(base) == sorted(want)


def test_redaction_follows_ownership(spark):
    key, shared = "AKIA" + "Z" * 16, "AKIA" + "Y" * 16
    rows = [(1, f"a {key} b", "s1"), *((10 + i, f"see {shared} end", f"s{i}") for i in range(5)), (30, None, "x"), (31, "", "x")]
    got = {r["doc_id"]: r for r in secrets.redact(docs(spark, rows)).collect()}
    assert got[1]["text"] == "a [SECRET] b" and got[1]["n_chars"] == 12
    assert got[10]["text"] == f"see {shared} end" and got[30]["text"] is None and len(got) == 8


@pytest.mark.parametrize(("few", "share"), [(10, 1e-3), (1, 0.2)])
def test_verdicts_equal_a_plain_count_of_owners_and_repositories(spark, monkeypatch, few, share):
    monkeypatch.setattr(secrets, "FEW_REPOS", few, raising=False)
    monkeypatch.setattr(secrets, "SHARE", share, raising=False)
    key = {k: "AKIA" + k * 16 for k in "ABCDEFGH"}
    holds = [*((i, "A", "hot") for i in range(40)), *((50 + i, "B", "hot") for i in range(8)), *((70, "C", s) for s in ("hot", "s1", "s2")), *((80 + i, "D", f"s{i}") for i in range(3)),
             *((None, "E", "s1") for _ in range(30)), (90, "F", None), (91, "F", None), (92, "G", "s1"), (92, "G", "s1"), *((100 + i, "H", f"s{i % 2}") for i in range(21))]
    d = docs(spark, [(i, f"see {key[k]} end", s) for i, k, s in holds])
    repos, owners = {}, {}
    for n, (i, k, s) in enumerate(holds):
        repos.setdefault(k, set()).add(f"row {n}" if i is None else i)
        owners.setdefault(k, set()).add(s)
    most = max(few, share * len(set().union(*repos.values())) / len(set().union(*owners.values())))
    live = {k: len(repos[k]) <= 1 or (len(owners[k]) <= 2 and len(repos[k]) <= most * len(owners[k])) for k in key}
    if few == 10:
        assert live == dict(zip("ABCDEFGH", (False, True, True, False, False, True, True, False)))
    want = sorted((i or -1, len(owners[k]), len(repos[k]), live[k]) for i, k, _ in holds)
    assert sorted((r["doc_id"] or -1, x["n_owners"], x["n_repos"], x["live"]) for r in secrets.secret_spans(d).collect() for x in r["spans"]) == want
    texts = sorted((i or -1, "see [SECRET] end" if live[k] else f"see {key[k]} end") for i, k, _ in holds)
    assert sorted((r["doc_id"] or -1, r["text"]) for r in secrets.redact(d).collect()) == texts


def test_licenses(spark):
    text = "Released under the MIT License. gnu GENERAL public license, CC BY! cc-by é mit  license"
    words = licenses.words_of
    d = docs(spark, [(1, text, "a"), (2, "", "a"), (3, None, "a"), (4, "mit", "b")])
    from pyspark.sql import functions as F

    spans = licenses.license_spans(d.select(F.col("doc_id").alias("row"), words(F.col("text")).alias("words")), [(v, k, True) for k, v in licenses.PHRASES.items()]).collect()
    w = re.findall(licenses.WORD, text.lower())
    want = sorted((1, v, i) for k, v in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(k.split())] == k.split())
    assert sorted((r["row"], r["label"], r["first"]) for r in spans) == want


def test_quality_learns_a_pair():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9
    assert 0 < quality.fit(x[:0], y[:0]).score(x[:3])[0] < 1
    assert quality.features(None) == quality.features("") == [0.0] * len(quality.FEATURES)


def test_nearest(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(400, 16))
    v[50] = v[51] = v[52]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [0.0] * 16), (902, [math.nan] * 16), (903, [1.0, None] * 8), (None, [1.0] * 16)]
    x = spark.createDataFrame(rows, "id long, vec array<double>")
    got = {}
    for r in neighbours.nearest(x, x.where("id % 20 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = []
    for q, found in got.items():
        s = v @ v[q]
        s[q] = -np.inf
        found.sort()
        assert len(found) == 20 and all(abs(s[i] - z) < 1e-9 for _, i, z in found)
        hits.append(len({i for _, i, _ in found} & set(np.argsort(-s)[:20].tolist())) / 20)
    assert len(got) == 20 and np.mean(hits) >= 0.9
    few = neighbours.nearest(x.where("id < 5"), x.where("id = 0")).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2, 3, 4]


def test_rates_meet_targets(spark):
    rows = [(i, 100, [0.9, 0.1] if i % 4 else [0.2, 0.8]) for i in range(400)]
    soft = spark.createDataFrame(rows, "row long, tokens long, p array<double>")
    out = mixing.rates(soft, [0.5, 0.5]).collect()
    total = [sum(r["rate"] * r["tokens"] * r["p"][k] for r in out) for k in (0, 1)]
    assert all(abs(t / 40000 - 0.5) < 0.01 for t in total) and min(r["rate"] for r in out) >= 0


@pytest.mark.parametrize("shares", [(0.93, 0.05, 0.02), (0.97, 0.02, 0.01), (0.97, 0.005, 0.025)])
@pytest.mark.parametrize("targets", [(0.85, 0.1, 0.05), (0.98, 0.01, 0.01)])
def test_rates_meet_targets_of_rare_domains(spark, shares, targets):
    rows = [(k, 1000 * int(1000 * s), [0.998 if j == k else 0.001 for j in range(3)]) for k, s in enumerate(shares)]
    out = mixing.rates(spark.createDataFrame(rows, "row long, tokens long, p array<double>"), list(targets)).collect()
    total = sum(r["tokens"] for r in out)
    for k, t in enumerate(targets):
        assert abs(sum(r["rate"] * r["tokens"] * r["p"][k] for r in out) / total / t - 1) < 0.001
    assert min(r["rate"] for r in out) >= 0


def test_rates_out_of_reach_are_least_squares_and_warned_of(spark):
    rows = [(0, 900, [0.9, 0.08, 0.02]), (1, 100, [0.3, 0.6, 0.1])]
    with pytest.warns(UserWarning, match="out of reach"):
        out = {r["row"]: r for r in mixing.rates(spark.createDataFrame(rows, "row long, tokens long, p array<double>"), [0.2, 0.2, 0.6]).collect()}
    p, goal = np.array([x[2] for x in rows]), np.array([0.2, 0.2, 0.6])
    w = np.array([out[i]["rate"] * t / 1000 for i, t, _ in rows])
    slope = p @ (w @ p - goal)
    assert (w >= 0).all() and (slope > -1e-5).all() and abs(w @ slope) < 1e-5


def test_pieces_equal_the_library(spark):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = ["Hello  world.\n\nfoo\tbar  ", "", None, " ", "x" * 3000, "ab12" * 500, "漢字 \U0001f600 naïve café's", "the the the", "a▁b", "The $5.00, (yes)!!"]
    got = {r["doc_id"]: r for r in pieces.encode(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        assert list(got[i]["ids"]) == m.encode(t or ""), t
    assert all(r["round_trip"] for i, r in got.items() if "▁" not in (texts[i] or ""))


def test_pieces_of_rare_words_in_copies(spark, monkeypatch):
    import sentencepiece

    monkeypatch.setattr(pieces, "MOST_SENT", 3)
    m = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = ["one two three two two", "one two three two two", None, " x", " x", "漢字 fooo barr bazz   qux", "漢字 fooo barr bazz   qux", "one two three two two"]
    rows = [(i // 2, t, "s") for i, t in enumerate(texts)]
    got = sorted((r["doc_id"], list(r["ids"]), r["round_trip"]) for r in pieces.encode(docs(spark, rows)).collect())
    assert got == sorted((i, m.encode(t or ""), True) for i, t, _ in rows)


def test_one_turn_is_enough_without_late_pieces(spark):
    model = pieces.Pieces(pieces.MODEL)
    late = set(model.late())
    assert late and all(set(p) == {pieces.SPACE} for p in late)


@pytest.mark.parametrize("least", [1, 2])
def test_lattice_has_every_piece(spark, least):
    table = ["a", "b", "ab", "abc", "abcde", "bcd", "cabab", "ba"]
    p = spark.createDataFrame([(k, i, -float(i)) for i, k in enumerate(table)], "piece string, id int, score double")
    texts = ["abcde", "cababcdeab", "zzz", "a", "abcdeabcabz", "é漢ab"]
    got = pieces.lattice(spark.createDataFrame([(t,) for t in texts], "word string"), p, max(map(len, table)), least).collect()
    places = {r["word"]: sorted((e["s"], e["e"]) for e in r["edges"] if e["id"] is not None and (e["e"] - e["s"] >= least)) for r in got}
    every = {t: sorted((s, e) for s in range(len(t)) for e in range(s + least, len(t) + 1) if t[s:e] in table) for t in texts}
    assert places == every


def test_words_at_hand_and_holes():
    model = pieces.Pieces(pieces.MODEL)
    kept = pieces._Kept(model, {"foo": b"\1\0"}, {"foo": b"\2\0"})
    assert kept["foo"] == b"\1\0" and not kept.rare  # after a space
    assert kept["bar"] == b"\xff\xff" and kept.rare == {"bar": [pieces.SPACE + "bar"]}
    assert kept["foo\nfoo"][:2] == b"\1\0" and kept["foo\nfoo"][-2:] == b"\2\0"
    kept.forget()
    assert "bar" not in kept and not kept.rare and kept["foo"] == b"\1\0"


def test_viterbi_fold(spark):
    from pyspark.sql import functions as F

    table = {"a": -3.0, "b": -3.0, "ab": -4.0, "ba": -1.0, "aba": -4.5}
    p = spark.createDataFrame([(k, i, s) for i, (k, s) in enumerate(table.items())], "piece string, id int, score double")
    words = spark.createDataFrame([("aba",), ("abab",)], "word string")
    got = {r["word"]: r["bits"] for r in pieces.lattice(words, p, 3).withColumn("bits", pieces.viterbi(F.col("edges"), F.length("word"))).collect()}

    def best(w):
        cost = {0: (0.0, 1)}
        for e in range(1, len(w) + 1):
            cost[e] = max((cost[s][0] + table[w[s:e]], cost[s][1] | 1 << e) for s in range(e) if w[s:e] in table)
        return cost[len(w)][1]

    assert got == {w: best(w) for w in ("aba", "abab")}


CLASHING = ("_row", "_rate", "_n", "_copy", "_gone", "_spans", "_of", "_live", "rate", "row", "word")


def clashing(df):
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHING))


@pytest.mark.parametrize("stage", ["near", "secrets", "mixing"])
def test_stages_keep_columns_that_clash(spark, odd, stage):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 0), (7, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    targets = {"good": 0.5, "poor": 0.3, "toxic": 0.2}
    apply = {"near": neardup.one_of_each, "secrets": secrets.redact, "mixing": lambda d: mixing.mixed(d, labels, targets, keep="good")}[stage]
    d = clashing(odd)
    got = apply(d).collect()
    assert got and all(r[c] == f"own {c}" for r in got for c in CLASHING) and set(got[0].asDict()) == set(d.columns)
    if stage == "secrets":
        assert len(got) == 12
    assert apply(d.where("doc_id < 0")).collect() == []


def test_posteriors_equal_plain_bayes(spark):
    texts = [(0, "Good words here"), (1, "bad bad words"), (2, "good\tbad  unseen"), (3, None), (4, " "), (5, "good good")]
    domains = {0: "g", 1: "b", 5: "g"}
    d = spark.createDataFrame([(i, i, t) for i, t in texts], "row long, doc_id long, text string")
    labelled = spark.createDataFrame([*domains.items(), (None, "g"), (2, None)], "doc_id long, domain string")
    names, words = ["b", "g"], {i: (t or "").lower().split() for i, t in texts}
    seen = {n: [w for i, x in domains.items() if x == n for w in words[i]] for n in names}
    rows = {n: list(domains.values()).count(n) for n in names}
    for r in mixing.posteriors(d, labelled, names).collect():
        z = [math.log((rows[n] + 1) / 5) + sum(math.log((seen[n].count(w) + 1) / (len(seen[n]) + mixing.BUCKETS)) for w in words[r["row"]]) for n in names]
        e = np.exp(np.array(z) - max(z))
        assert r["tokens"] == len(words[r["row"]]) and r["doc_id"] == r["row"] and np.allclose(r["p"], e / e.sum())
