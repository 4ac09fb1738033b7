"""SentencePiece encoding and decoding over a relational lattice.

Words of the corpus, split where no piece can lie across, are exploded into substrings of bounded length and
joined to the piece table; the edges of a word are grouped, and a Spark aggregate folds over them. A unigram model is
folded by Viterbi. A BPE model is not a shortest path, so its fold takes the best merge that is open, again
and again, over the same edges; one turn over the edges in order of score is enough unless a piece is `late` (below).

Every distinct word goes through the lattice once. Words that a sample of texts holds twice go first and are sent to every task, so
that most of a text is encoded where it stands; the others leave a hole, are grouped by word over the corpus, and come back
to the run of texts (a chunk) that lacks them.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import release, short_batches, table, written

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Characters of words that the fold takes; longer words are merged by a queue, to the same result.
LONGEST = 60
#: Texts whose words are looked at first, about, and words of LONGEST characters at most that are then sent to every task. Both
#: decide where a word is encoded, not what comes out.
SAMPLE, MOST_SENT = 20_000, 150_000
#: Distinct parts of texts that a task keeps beside the words at hand.
MOST_KEPT = 30_000
#: First characters of a piece by which the lattice bounds its spans.
LEAD = 3
#: Bytes of text that are encoded together; a longer text is taken alone.
CHUNK = 2 << 20
#: A run of spaces and what follows it; no piece lies across its ends.
COARSE = re.compile(" *[^ ]+| +")
HOLE = 0xFFFF


class Pieces:
    """The piece table of a model: text, id, score of ordinary pieces; ids of bytes; unknown id."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        ordinary = [i for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        self.ids = {m.id_to_piece(i): (i, m.get_score(i)) for i in ordinary}
        self.bytes = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if m.get_piece_size() > HOLE:
            raise ValueError(f"a model of at most {HOLE} pieces is expected")
        texts = [b""] * m.get_piece_size()
        for i in ordinary:
            texts[i] = m.id_to_piece(i).replace(SPACE, " ").encode()
        for b, i in enumerate(self.bytes):
            texts[i] = bytes([b])
        self.flat, self.sizes = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts], np.int32)
        self.begins = np.cumsum(self.sizes, dtype=np.int32) - self.sizes
        self.most = max(map(len, self.ids))
        inside = {(a, b) for p in self.ids for a, b in zip(p, p[1:])}
        # Characters that may follow a letter in a piece count as letters; so a cut after letters splits no piece.
        letters = {c for pair in inside for c in pair if c.isalpha()}
        while more := {b for a, b in inside if a in letters and b != SPACE} - letters:
            letters |= more
        letters |= set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
        own = "".join(re.escape(c) for c in sorted(letters))
        assert not any(b == SPACE and a != SPACE for a, b in inside)
        # Where no piece has a letter after anything else but a space, words end before such letters too.
        apart = not any(b in letters and a not in letters and a != SPACE for a, b in inside)
        self.pattern = f"{SPACE}*[{own}]+|{SPACE}*[^{SPACE}{own}]+|{SPACE}+" if apart else f"{SPACE}*[^{SPACE}{own}]*[{own}]*"

    def late(self) -> list[str]:
        """Pieces that one turn over the edges, best score first, may miss.

        Alone, merged by better pieces only, such a piece is not yet two parts when its own turn comes, or it shares its
        score. Whether a place's boundaries stay depends on nothing inside it, so what holds for a piece alone
        holds wherever it stands.
        """
        many, found = Counter(s for p, (_, s) in self.ids.items() if len(p) > 1), []
        for p, (_, score) in self.ids.items():
            left = set(range(len(p) + 1))
            spans = ((s, e) for s in range(len(p)) for e in range(s + 2, len(p) + 1))
            for _, s, e in sorted((-self.ids[t][1], s, e) for s, e in spans if (t := p[s:e]) in self.ids and self.ids[t][1] > score):
                inside = left.intersection(range(s + 1, e))
                if s in left and e in left and len(inside) == 1:
                    left -= inside
            if len(p) > 1 and (len(left) != 3 or many[score] > 1):
                found.append(p)
        return found

    def merged(self, word: str) -> list[int]:
        """Ids of one word by a queue of merges; for words too long for the fold."""
        s: list[str | None] = list(word)
        after, before = list(range(1, len(s) + 1)), list(range(-1, len(s) - 1))
        queue: list = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(s) and (t := s[i] + s[after[i]]) in self.ids:
                heapq.heappush(queue, (-self.ids[t][1], i, t))

        for i in range(len(s)):
            offer(i)
        while queue:
            _, i, t = heapq.heappop(queue)
            if s[i] is None or after[i] >= len(s) or s[i] + s[after[i]] != t:
                continue
            j = after[i]
            s[i], s[j], after[i] = t, None, after[j]
            if after[i] < len(s):
                before[after[i]] = i
            offer(i)
            offer(before[i])
        return [x for t in s if t is not None for x in ([self.ids[t][0]] if t in self.ids else [self.bytes[b] for b in t.encode()])]

    def spelt(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text of ids, without the space that encoding puts first."""
        size = self.sizes[ids]
        ends = np.cumsum(size, dtype=np.int64)
        kind = np.int32 if ends[-1:].sum() < 1 << 31 else np.int64
        at = np.repeat(self.begins[ids] - (ends - size).astype(kind), size)
        at += np.arange(len(at), dtype=kind)
        text = self.flat[at].tobytes()
        return text[1:] if text[:1] == b" " else text

    def decode(self, ids: list[int]) -> str:
        """Text of ids, without the space that encoding puts first."""
        return self.spelt(np.array(ids, np.int64)).decode("utf-8", "replace")


def split(pattern: re.Pattern, text: str) -> list[str]:
    """Words of a text; an empty text has none."""
    return [w for w in pattern.findall(SPACE + text.replace(" ", SPACE)) if w] if text else []


def _coarse(text: str) -> list[str]:
    """Parts of a text, cut before spaces, each without its first space; found faster than words, which lie within."""
    text = text.replace(SPACE, " ")
    if text[:1] != " " and "  " not in text:
        return text.split(" ") if text else []
    return [x[1:] for x in COARSE.findall(" " + text)]


def _fine(pattern: re.Pattern, part: str) -> list[str]:
    """Words of a part that _coarse gives. Letters alone are one word; ASCII has the most of them, so they are told without the pattern."""
    if part.isascii() and part.isalpha():
        return [SPACE + part]
    return [w for w in pattern.findall(SPACE + part.replace(" ", SPACE)) if w]


def _counted(docs: DataFrame, pattern: str) -> DataFrame:
    """word and n, its places in the corpus, of words that the fold takes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, parts = re.compile(pattern), Counter()

        def handed() -> pa.RecordBatch:
            found: Counter = Counter()
            for part, n in parts.items():
                for w in _fine(own, part):
                    if len(w) <= LONGEST:
                        found[w] += n
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for t in b.column("text").to_pylist():
                parts.update(_coarse(t or ""))
                if len(parts) > MOST_KEPT:
                    yield handed()
        yield handed()

    return docs.select("text").mapInArrow(each, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _bit(x: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), x)


def _one_turn(edges: Column, n: Column) -> Column:
    """What _best_merges gives, by one look at each edge, where no edge's piece is late."""
    open_ = lambda mask, x: (mask.bitwiseAND(x["ends"]) == x["ends"]) & (F.bit_count(mask.bitwiseAND(x["inner"])) == 1)
    return F.aggregate(edges, _bit(n + 1) - 1, lambda mask, x: F.when(open_(mask, x), mask.bitwiseAND(F.bitwise_not(x["inner"]))).otherwise(mask))


def _best_merges(edges: Column, n: Column) -> Column:
    """Bits of the boundaries that are left when the open edge with the best score has been merged until none is.

    edges: structs with s, e and inner (bits of the boundaries between), best score first, leftmost first.
    """
    open_ = lambda mask: lambda x: (mask.bitwiseAND(_bit(x["s"])) != 0) & (mask.bitwiseAND(_bit(x["e"])) != 0) & (F.bit_count(mask.bitwiseAND(x["inner"])) == 1)

    def merge(state: Column, _: Column) -> Column:
        first = F.get(F.filter(edges, open_(state["mask"])), F.lit(0))["inner"]
        # Once no edge is open, the rest of the turns look at none.
        return F.when(state["ended"], state).otherwise(
            F.struct(F.coalesce(state["mask"].bitwiseAND(F.bitwise_not(first)), state["mask"]).alias("mask"), first.isNull().alias("ended"))
        )

    return F.aggregate(F.sequence(F.lit(1), n), F.struct((_bit(n + 1) - 1).alias("mask"), F.lit(False).alias("ended")), merge, lambda x: x["mask"])


def lattice(words: DataFrame, pieces: DataFrame, most: int, least: int = 1) -> DataFrame:
    """words with edges: places of pieces of `least` characters or more in a word, best score first, then leftmost.

    pieces: piece, id, score and perhaps late (bounded by the model). The first character always has an edge, if only one without an id, so
    every word stays; with `least` 1 every character has. Words that come partitioned by word stay so: neither the
    explosion nor the grouping shuffles.
    """
    n, own = F.length("word"), words.columns
    starts = words.select(*own, F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), n - least))).alias("s"))
    first = F.col("s") + F.when(F.col("s") == 0, 1).otherwise(least)
    # No span is longer than the longest piece that begins with the same LEAD characters.
    leads = pieces.where(F.length("piece") >= LEAD).groupBy(F.substring("piece", 1, LEAD).alias("lead")).agg(F.max(F.length("piece")).alias("longest"))
    begun = starts.withColumn("lead", F.substring("word", F.col("s") + 1, F.lit(LEAD))).join(F.broadcast(leads), "lead", "left")
    last = F.col("s") + F.least(F.lit(most), F.coalesce("longest", F.lit(LEAD - 1)))
    spans = begun.select(*own, "s", F.explode(F.sequence(first, F.least(n, F.greatest(first, last)))).alias("e"))
    kept = F.col("id").isNotNull() | ((F.col("e") == F.col("s") + 1) & ((F.col("s") == 0) | F.lit(least == 1)))
    edges = spans.withColumn("piece", F.substring("word", F.col("s") + 1, F.col("e") - F.col("s"))).join(F.broadcast(pieces), "piece", "left").where(kept)
    edge = F.struct((-F.col("score")).alias("cost"), "s", "e", (_bit(F.col("e")) - _bit(F.col("s") + 1)).alias("inner"), "id", (_bit(F.col("s")) + _bit(F.col("e"))).alias("ends"), *(c for c in ("late",) if c in pieces.columns))
    return edges.groupBy(*own).agg(F.sort_array(F.collect_list(edge)).alias("edges"))


def viterbi(edges: Column, n: Column) -> Column:
    """Boundaries' bits of the best-scoring path of a unigram model, folded over the edges by end; n below 61."""
    by_end = F.sort_array(F.transform(F.filter(edges, lambda x: x["id"].isNotNull()), lambda x: F.struct(x["e"], x["s"], x["cost"])))
    start = F.array(F.struct(F.lit(0.0).alias("cost"), F.lit(1).cast("long").alias("bits")))
    start = F.concat(start, F.array_repeat(F.lit(None).cast("struct<cost:double,bits:bigint>"), n))

    def step(best: Column, x: Column) -> Column:
        to, here = F.get(best, x["s"]), F.get(best, x["e"])
        cost = to["cost"] + x["cost"]
        path = F.struct(cost.alias("cost"), to["bits"].bitwiseOR(_bit(x["e"])).alias("bits"))
        better = to.isNotNull() & (here.isNull() | (cost < here["cost"]))
        return F.transform(best, lambda y, i: F.when((i == x["e"]) & better, path).otherwise(y))

    return F.get(F.aggregate(by_end, start, step), n)["bits"]


def encoded_words(words: DataFrame, model: Pieces) -> DataFrame:
    """word and x, its ids in two bytes each, for distinct words (word) of LONGEST characters at most; characters without a piece become bytes."""
    late = set(model.late())
    pieces = words.sparkSession.createDataFrame([(p, i, s, p in late) for p, (i, s) in model.ids.items()], "piece string, id int, score double, late boolean")
    n = F.length("word")
    # Edges of one character take no part in merges; their ids are looked up by code point for the few that are left.
    found = lattice(words.select("word"), pieces, model.most, least=2).withColumn("many", F.filter("edges", lambda x: x["e"] > x["s"] + 1))
    hold = found.select("word", "many", F.when(F.exists("many", lambda x: x["late"]), _best_merges(F.col("many"), n)).otherwise(_one_turn(F.col("many"), n)).alias("bits"))
    bits = F.col("bits")
    left = lambda i: _bit(i).bitwiseAND(bits) != 0
    merged = F.transform(
        F.filter("many", lambda x: (bits.bitwiseAND(x["ends"]) == x["ends"]) & (bits.bitwiseAND(x["inner"]) == 0)), lambda x: F.struct(x["s"].alias("s"), x["id"].alias("id"))
    )
    single = {ord(p): i for p, (i, _) in model.ids.items() if len(p) == 1}
    by_point = F.split(F.lit(",".join(str(single.get(c, "")) for c in range(max(single, default=0) + 1))), ",")  # folded to one constant
    char = lambda s: F.substring(F.col("word"), s + 1, F.lit(1))
    alone = F.transform(
        F.filter(F.sequence(F.lit(0), n - 1), lambda s: left(s) & left(s + 1)),
        lambda s: F.struct(s.alias("s"), F.get(by_point, F.ascii(char(s))).try_cast("int").alias("id")),
    )
    byte = F.array(*map(F.lit, model.bytes))
    spelled = lambda t: F.transform(F.filter(F.split(F.hex(F.encode(t, "UTF-8")), "(?<=\\G..)"), lambda h: h != ""), lambda h: F.get(byte, F.conv(h, 16, 10).cast("int")))
    ids = F.flatten(F.transform(F.sort_array(F.concat(merged, alone)), lambda x: F.when(x["id"].isNotNull(), F.array(x["id"])).otherwise(spelled(char(x["s"])))))
    return hold.select("word", F.unhex(F.array_join(F.transform(ids, lambda i: F.lpad(F.hex(i), 4, "0")), "")).alias("x"))


def _digest(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Rows of a batch in runs of about CHUNK bytes of text, and their texts."""
    ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(batch):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CHUNK, "right")))
        part = batch.slice(start, stop - start)
        yield part, part.column("text").to_pylist()
        start = stop


def _packed(x: np.ndarray) -> bytes:
    """Numbers, compressed; ids take about a fifth less room at this level than at the fastest."""
    import zstandard

    return zstandard.ZstdCompressor(level=5).compress(x.tobytes())


def _unpacked(b: bytes, kind: type) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def _at_hand(own: DataFrame, model: Pieces) -> tuple[dict[str, bytes], dict[str, bytes]]:
    """Ids of words that a sample of about SAMPLE texts holds twice or more, the commonest MOST_SENT at most: those that begin with a
    space, without it, and the others."""
    n = own.count()
    some = own.sample(min(1.0, SAMPLE / n), seed=1) if n > SAMPLE else own
    counted = written(_counted(some, model.pattern).where("n > 1"), "words")
    total, least = 0, 1 << 62
    for r in counted.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).toLocalIterator():
        total += r["words"]
        if total > MOST_SENT:
            break
        least = r["n"]
    words = counted.where(F.col("n") >= least).select("word").repartition("word")
    found: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}
    for r in encoded_words(words, model).toLocalIterator():
        word, x = r["word"], np.frombuffer(r["x"], ">u2").astype(np.uint16).tobytes()
        if word[0] == SPACE:
            found[0][word[1:]] = x
        else:
            found[1][word] = x
    return found


class _Kept(dict):
    """Ids by part of a text, two bytes each, with a hole for each word that is not at hand; `rare` has those words by part.

    It starts with the words at hand (by_part: those that begin with a space, without it; others: the rest), so a part that is a
    word at hand is never missing.
    """

    def __init__(self, model: Pieces, by_part: dict[str, bytes], others: dict[str, bytes]) -> None:
        super().__init__(by_part)
        self.model, self.pattern, self.by_part, self.others, self.rare = model, re.compile(model.pattern), by_part, others, {}

    def __missing__(self, part: str) -> bytes:
        if len(part) < LONGEST and part.isascii() and part.isalpha():  # one word, and not at hand
            found, self.rare[part] = b"\xff\xff", [SPACE + part]
        else:
            ids, lacking = [], []
            for w in _fine(self.pattern, part):
                x = self.by_part.get(w[1:]) if w[0] == SPACE else self.others.get(w)
                if x is not None:
                    ids.append(x)
                elif len(w) > LONGEST:
                    ids.append(np.array(self.model.merged(w), np.uint16).tobytes())
                else:
                    ids.append(b"\xff\xff")
                    lacking.append(w)
            found = b"".join(ids)
            if lacking:
                self.rare[part] = lacking
        self[part] = found
        return found

    def forget(self) -> None:
        """After a chunk: parts with holes go, and all but the words at hand once there are MOST_KEPT more."""
        for part in self.rare:
            del self[part]
        self.rare.clear()
        if len(self) > len(self.by_part) + MOST_KEPT:
            self.clear()
            self.update(self.by_part)


def _name(rare: list[str], texts: list[str]) -> int:
    """Name of a chunk by the words that it lacks; one that lacks none is named by its texts, so that no name is shared by many."""
    return _digest("\0".join(rare or ["", *texts]).encode("utf-8", "surrogatepass"))


def encode(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, ids, n_ids and round_trip (whether the ids decode to the text) for every row of docs.

    Null texts count as empty and have no ids. Repeated rows stay apart. Words of over LONGEST characters are merged
    where they stand. docs is read twice and has to give the same rows in the same order, as a table does; a chunk that
    differs raises an error.
    """
    model = Pieces(path)
    short_batches(docs.sparkSession, 500)
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(_at_hand(own, model))

    def lacking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        kept = _Kept(model, *sent.value)
        for b in batches:
            names, rares = [], []
            for _, texts in _chunks(b):
                for p in filterfalse(kept.__contains__, set(chain.from_iterable(map(_coarse, texts)))):
                    kept[p]
                rares.append(sorted({w for rare in kept.rare.values() for w in rare}))
                kept.forget()
                names.append(_name(rares[-1], texts))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(rares, pa.list_(pa.string()))], names=["name", "rare"])
        release()  # the worker waits for its next task

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        kept = _Kept(model, *sent.value)
        for b in batches:
            for part, texts in _chunks(b):
                ids, rare = [], []
                for t in texts:
                    parts = _coarse(t)
                    ids.append(b"".join(map(kept.__getitem__, parts)))
                    rare += [w for p in filter(kept.rare.__contains__, parts) for w in kept.rare[p]]
                kept.forget()
                place = {w: i for i, w in enumerate(sorted(set(rare)))}
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_name(list(place), texts)], pa.int64()), pa.array([part.column("doc_id").to_pylist()], pa.list_(part.column("doc_id").type)),
                     pa.array([[len(x) // 2 for x in ids]], pa.list_(pa.int32())), pa.array([_packed(np.frombuffer(b"".join(ids), np.uint16))], pa.binary()),
                     pa.array([_packed(np.array([place[w] for w in rare], np.uint32))], pa.binary()),
                     pa.array([[_digest(t.encode("utf-8", "surrogatepass")) for t in texts]], pa.list_(pa.int64()))],
                    names=["name", "docs", "sizes", "ids", "places", "digests"],
                )
        release()

    # One exchange of the rare words' places serves both the grouping by word and the join: the tests for nulls, which always
    # hold, keep columns and filters of both readings the same.
    places = own.mapInArrow(lacking, "name long, rare array<string>").where("name IS NOT NULL").select("name", F.posexplode("rare").alias("at", "word"))
    places = places.where("word IS NOT NULL").repartition("word")
    distinct = places.groupBy("word").agg(F.min("at").alias("at"), F.min("name").alias("name")).where("at IS NOT NULL AND name IS NOT NULL")
    others = encoded_words(distinct, model).select(F.col("word").alias("w"), "x")
    filled = places.join(others.hint("shuffle_hash"), F.col("word") == F.col("w")).groupBy("name").agg(F.collect_list(F.concat(F.unhex(F.lpad(F.hex("at"), 8, "0")), "x")).alias("fill"))
    whole = own.mapInArrow(begun, f"name long, docs array<{kind}>, sizes array<int>, ids binary, places binary, digests array<long>")
    # By hash of the words that come back: the larger side with all ids is not sorted.
    both = whole.join(filled.hint("shuffle_hash"), "name", "left").select("docs", "sizes", "ids", "places", "digests", "fill")

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            for i in range(len(b)):
                row = b.slice(i, 1)
                sizes, digests = (row.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("sizes", "digests"))
                ids, ends = filled_in(_unpacked(row.column("ids")[0].as_py(), np.uint16), np.cumsum(sizes), _unpacked(row.column("places")[0].as_py(), np.uint32), row.column("fill")[0].values)
                begins = np.r_[0, ends[:-1]]
                same = [_digest(model.spelt(ids[s:e])) == d for s, e, d in zip(begins, ends, digests)]
                yield pa.RecordBatch.from_arrays(
                    [row.column("docs").flatten(), pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(ids.astype(np.int32))), pa.array((ends - begins).astype(np.int64)), pa.array(same, pa.bool_())],
                    names=["doc_id", "ids", "n_ids", "round_trip"],
                )

    return both.mapInArrow(end, f"doc_id {kind}, ids array<int>, n_ids long, round_trip boolean")


def filled_in(ids: np.ndarray, ends: np.ndarray, places: np.ndarray, fill: pa.Array | None) -> tuple[np.ndarray, np.ndarray]:
    """ids with each hole replaced by the ids at its place in fill, and the texts' ends in the result.

    fill: binaries, each a place in four bytes and its ids in two bytes each, the high byte first. A place that fill lacks is an error.
    """
    if not len(places):
        return ids, ends
    fill = pa.array([], pa.binary()) if fill is None else fill
    begins = np.frombuffer(fill.buffers()[1], np.int32)[fill.offset : fill.offset + len(fill) + 1] // 2
    flat = np.frombuffer(fill.buffers()[2] or b"", ">u2").astype(np.uint16)
    at = flat[begins[:-1]].astype(np.int64) << 16 | flat[begins[:-1] + 1]
    which = np.full(max(int(places.max()), int(at.max(initial=-1))) + 1, -1)
    which[at] = np.arange(len(at))
    which = which[places]
    if which.min() < 0:
        raise ValueError("a chunk came back without the ids of all its words: docs did not give the same rows twice")
    many = np.diff(begins)[which] - 2
    holes = ids == HOLE
    size = np.ones(len(ids), np.int64)
    size[holes] = many
    after = np.cumsum(size)
    out = np.empty(after[-1], np.uint16)
    out[after[~holes] - 1] = ids[~holes]
    steps = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    out[np.repeat(after[holes] - many, many) + steps] = flat[np.repeat(begins[which] + 2, many) + steps]
    return out, np.r_[0, after][ends]


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every whole text of documents, and whether they decode to it."""
    return encode(table(spark, sf_dir, "documents"))
