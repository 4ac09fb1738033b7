"""Links by passages of whole texts, against plain comparison and the query's SQL."""

import hashlib
import random

import duckdb

from loomwork.operators import passages
from loomwork.plans import catalogue


def classes(ids, pairs):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {i: root(i) for i in ids}


def test_passages_anywhere_link_and_shorter_ones_do_not(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abé😀 \n") for _ in range(rng.choice([0, 3, 11, 12, 13, 40, 150]))) for _ in range(120)]
    for i in range(0, 100, 3):
        n, at = rng.choice([11, 12, 13, 30]), rng.randrange(60)
        texts[i + 1] = texts[i + 1][:at] + texts[i][at // 2 : at // 2 + n] + texts[i + 1][at:]
    texts += ["a" * 700, "b" + "a" * 12, "a" * 11, "ab" * 200, "ab" * 6]
    rows = list(enumerate(texts))
    held = {}
    for i, x in rows:
        for k in {x[j : j + 12] for j in range(max(1, len(x) - 11))}:
            held.setdefault(k, []).append(i)
    want = classes(range(len(rows)), [(v[0], b) for v in held.values() for b in v[1:]])
    got = passages.shared(spark.createDataFrame([*rows, (999, None)], "id long, text string"), "id", "text", 12).collect()
    assert classes(range(len(rows)), [(r["id"], r["least"]) for r in got]) == want and len(set(want.values())) > 20
    assert all(want[r["id"]] == want[r["least"]] and r["least"] < r["id"] for r in got)


def test_components_two_relations_reads_whole_texts(spark, tmp_path):
    rng = random.Random(7)

    def word(n):
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(n))

    start, middle, end, less = word(40), word(40), word(40), word(39)
    texts = [start + word(200), start + word(300), word(150) + end, word(90) + end, word(70) + middle + word(80), word(5) + middle + word(120), "x" + less + "y", "z" + less + "w" * 9]
    rows = [(i, x, "en", 1000 + i) for i, x in enumerate(texts)]
    rows += [(20, "ab", "en", 2), (21, "ab", "fr", 2), (22, word(60), "de", 60), (23, word(60), "de", 60), (24, word(30), None, 30), (25, word(30), None, 30), (26, None, "es", 7), (27, None, "it", 7), (28, "", "es", 0), (29, "", "it", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["component"] for r in catalogue.QUERIES["components_two_relations"](spark, str(tmp_path)).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4, 6: 6, 7: 7, 20: 20, 21: 20, 22: 22, 23: 22, 24: 24, 25: 25, 26: 26, 27: 27, 28: 28, 29: 28}
    sql = catalogue.ORACLES["components_two_relations"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert dict(duckdb.connect().execute(sql).fetchall()) == got


def test_passages_of_several_groups(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("abé😀 \n") for _ in range(rng.choice([0, 3, 11, 12, 13, 40, 150]))) for _ in range(120)]
    for i in range(0, 100, 3):
        n, at = rng.choice([11, 12, 13, 30]), rng.randrange(60)
        texts[i + 1] = texts[i + 1][:at] + texts[i][at // 2 : at // 2 + n] + texts[i + 1][at:]
    rows = [("xyz"[i % 3], x) for i, x in enumerate(texts)] + [("x", "a" * 700), ("y", "b" + "a" * 12), ("y", "ab" * 200), ("z", "ab" * 6), ("z", None), ("x", None)]
    held = {}
    for g, x in rows:
        for k in {None} if x is None else {x[j : j + 12] for j in range(max(1, len(x) - 11))}:
            held.setdefault(k, set()).add(g)
    want = {k: len(v) for k, v in held.items() if len(v) > 1}
    got = passages.in_several(spark.createDataFrame(rows, "g string, text string"), "g", "text", 12).collect()
    assert {r["passage"]: r["n"] for r in got} == want and len(got) == len(want) and set(want.values()) == {2, 3} and None in want


def test_attribute_leakage_reads_whole_texts(spark, tmp_path):
    rng = random.Random(17)

    def word(n):
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(n))

    split = lambda i: hashlib.sha256(f"{catalogue.SALT}:{i}".encode()).hexdigest() < "2"
    val, train = ([i for i in range(200) if split(i) is side] for side in (True, False))
    start, middle, less, copy, own = word(40), word(41), word(39), word(60), word(40)
    texts = {val[0]: start + word(200), train[0]: start + word(30), val[1]: word(70) + middle + word(80), train[1]: word(5) + middle + word(9), val[2]: "x" + less + "y", train[2]: "z" + less + "w"}
    texts |= {val[3]: copy, train[3]: copy, val[4]: "ab", train[4]: "ab", train[5]: own + word(9), train[6]: own + word(8), val[5]: None, train[7]: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["passage"] or "", r["n_splits"]) for r in catalogue.QUERIES["attribute_leakage"](spark, str(tmp_path)).collect())
    assert got == sorted((x, 2) for x in (start, middle[:40], middle[1:], *(copy[i : i + 40] for i in range(21)), "ab", ""))
    sql = catalogue.ORACLES["attribute_leakage"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted((x or "", n) for x, n in duckdb.connect().execute(sql).fetchall()) == got
