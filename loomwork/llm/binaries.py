"""Token ids as flat binary files: one folder of shards in the order of doc_id, mapped into memory by those who read them.

Shard k is three files: `k.ids`, all token ids one after the other, unsigned, little-endian, two or four bytes each; `k.off`, one
more 64-bit offset than the shard has documents, in ids from the shard's first; `k.doc`, the doc_ids as 64-bit integers and
then a byte for each, 0 where there is none. The folder's manifest holds the sizes of all shards; prefix sums of these give the base of each
shard, so a document's place among all ids is its shard's base and its offset.
"""

from __future__ import annotations

import hashlib
import math
import os
import uuid
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import shared_dir, short_batches, table
from .infill import _buffers, _runs, _views

VOCABULARY, END = "byte_bpe_50k.json", 2
#: Bytes of a shard's texts, about; shards whose prefix sums are taken together.
SHARD, TOGETHER = 256 << 20, 1024
#: Parts that are encoded as one text, parts of texts whose ids a process keeps, and rows of the sample by which rows are dealt to shards.
JOINED, KEPT, MOST_SAMPLED = 2000, 600_000, 200_000
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOADED: dict = {}
_KEPT: dict = {}


def _tokenizer(vocabulary: str):
    """The tokenizer of a vocabulary (JSON), made once for each process; special tokens in a text are ordinary text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    key = hashlib.sha256(vocabulary.encode()).digest()
    if key not in _LOADED:
        from tokenizers import Tokenizer

        made = Tokenizer.from_str(vocabulary)
        made.encode_special_tokens = True
        _LOADED.clear()
        _LOADED[key] = made
    return _LOADED[key]


def begins(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Places in UTF-8 bytes where a part begins: each text, and ASCII white space after a character that is none.

    Pre-tokens of the vocabulary never hold white space after another character, and look no further back, so a part has the ids that it has
    within its text. The white space beyond ASCII is told by its bytes, so that no run of white space is cut.
    """
    white = _WHITE[data]
    before = white.copy()
    if len(data) > 1 and data.max() > 0x7F:
        x, y = data[:-1], data[1:]
        before[1:] |= (x == 0xC2) & ((y == 0x85) | (y == 0xA0))
        if len(data) > 2:
            x, y, z = data[:-2], data[1:-1], data[2:]
            two = (x == 0xE2) & (((y == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF))) | ((y == 0x81) & (z == 0x9F)))
            before[2:] |= two | ((x == 0xE1) & (y == 0x9A) & (z == 0x80)) | ((x == 0xE3) & (y == 0x80) & (z == 0x80))
    white[1:] &= ~before[:-1]
    white[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    return np.flatnonzero(white)


class Parts(dict):
    """Packed ids of parts of texts. A process keeps them from task to task; a full one starts anew."""

    def __init__(self, tokenizer, width: int) -> None:
        self.tokenizer, self.width = tokenizer, width
        known = tokenizer.get_vocab(with_added_tokens=False)
        self.sizes = np.zeros(max(known.values()) + 1, np.int64)  # bytes of each token: byte-level tokens have a character for each
        self.sizes[list(known.values())] = list(map(len, known))

    def learn(self, new: list[str], sizes: np.ndarray) -> None:
        """Take up parts, given with their bytes. Parts that begin with white space and do not end with it keep their ids when they stand one after the other, so
        many are encoded as one text and told apart by the bytes of their tokens."""
        white = np.fromiter((p[0] in " \t\n\r\x0b\x0c" and not p[-1].isspace() for p in new), bool, len(new))
        alone = [p for p, w in zip(new, white) if not w]
        for p, x in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)):
            self[p] = array("H" if self.width == 2 else "I", x.ids).tobytes()
        rest, ends = [p for p, w in zip(new, white) if w], np.cumsum(sizes[white])
        texts = ["".join(rest[i : i + JOINED]) for i in range(0, len(rest), JOINED)]
        ids = [np.array(x.ids, f"<u{self.width}") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.concatenate(ids) if ids else np.zeros(0, f"<u{self.width}")
        reached = np.cumsum(self.sizes[flat])
        at = np.searchsorted(reached, ends) + 1
        if len(ends) and not np.array_equal(reached[at - 1], ends):
            raise ValueError("tokens of the vocabulary do not end where its parts do")
        packed, at = flat.tobytes(), (np.append(0, at) * self.width).tolist()
        for p, a, b in zip(rest, at, at[1:]):
            self[p] = packed[a:b]

    def ids(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id after it, and the n + 1 bounds of n texts in them."""
        data, bounds = _buffers(texts)
        at = begins(data, bounds)
        parts = _views(data, np.append(at, len(data))).dictionary_encode()
        distinct, place = parts.dictionary.to_numpy(zero_copy_only=False).tolist(), parts.indices.to_numpy()
        new = [i for i, p in enumerate(distinct) if p not in self]
        if new:
            self.learn([distinct[i] for i in new], np.diff(_buffers(parts.dictionary)[1])[new])
        packed = [self[p] for p in distinct]
        flat = np.frombuffer(b"".join(packed), f"=u{self.width}")
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // self.width
        if len(self) > KEPT:
            self.clear()
        n = sizes[place]
        after = np.cumsum(n)
        source = np.repeat((np.cumsum(sizes) - sizes)[place] - (after - n), n)
        ids = flat[source + np.arange(len(source))]
        ends = np.append(0, after)[np.searchsorted(at, bounds[1:])]
        return np.insert(ids, ends, end), np.append(0, ends + np.arange(1, len(ends) + 1))


def _parts(vocabulary: str, width: int) -> Parts:
    tokenizer = _tokenizer(vocabulary)
    if width not in _KEPT or _KEPT[width].tokenizer is not tokenizer:
        _KEPT[width] = Parts(tokenizer, width)
    return _KEPT[width]


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, key (a hash of the text), row (a number of the row) and text; null texts are empty."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return own.select("doc_id", F.xxhash64("text").alias("key"), F.monotonically_increasing_id().alias("row"), "text")


def shard_bounds(docs: DataFrame, least: int, shard_bytes: int) -> list[tuple]:
    """Places (has a doc_id, doc_id, key, row) that part the rows of docs into shards of about equal size; one fewer than the shards.

    They come from a sample by hash of at most about MOST_SAMPLED rows, and decide where a row stands, not what comes out. There are `least` shards, or
    as many as shard_bytes of text make.
    """
    n = docs.count()
    own = _keyed(docs)
    luck = F.xxhash64("key", "doc_id", "row", F.lit("shards"))
    chosen = own.where(F.pmod(luck, F.lit(max(1, n // MOST_SAMPLED + (n > MOST_SAMPLED)))) == 0)
    rows = chosen.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("known"), "key", "row", F.octet_length("text").alias("size")).collect()  # MOST_SAMPLED, about
    size = sum(r["size"] for r in rows) / max(1, len(rows)) * n
    count = max(least, math.ceil(size / shard_bytes))
    places = sorted((r["known"], r["doc_id"], r["key"], r["row"]) for r in rows)
    return [places[len(places) * k // count] for k in range(1, count)] if places else []


def encoded(docs: DataFrame, vocabulary: str, end: int = END, bounds: list[tuple] | None = None) -> DataFrame:
    """doc_id, key, row, shard and ids (packed) of every row of docs (doc_id, text). shard: how many of the bounds are at or before the row."""
    short_batches(docs.sparkSession)
    width, bounds = _width(vocabulary, end), bounds or []

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _parts(vocabulary, width)
        for batch in batches:
            for run in _runs(batch.column("text")):
                b = batch.slice(run.start, run.stop - run.start)
                ids, at = parts.ids(b.column("text"), end)
                held = pa.BinaryArray.from_buffers(pa.binary(), len(b), [None, pa.py_buffer((at * width).astype(np.int32)), pa.py_buffer(ids.astype(f"<u{width}"))])
                docs, keys, rows = (b.column(c).to_pylist() for c in ("doc_id", "key", "row"))
                shard = [bisect_right(bounds, (d is not None, d or 0, k, r)) for d, k, r in zip(docs, keys, rows)]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "key", "row")), pa.array(shard, pa.int32()), held], names=["doc_id", "key", "row", "shard", "ids"])

    return _keyed(docs).mapInArrow(packed, "doc_id long, key long, row long, shard int, ids binary")


def _width(vocabulary: str, end: int) -> int:
    """Bytes that hold every id."""
    return 2 if max(_tokenizer(vocabulary).get_vocab_size(with_added_tokens=True) - 1, end) < 1 << 16 else 4


def _place(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def write(docs: DataFrame, vocabulary: str, end: int = END, folder: str | None = None, shard_bytes: int = SHARD) -> str:
    """Write the ids of every row of docs (doc_id, text; other columns are not read) in the file format; gives the folder.

    Rows go by doc_id, those without one first, then by a hash of the text, so equal ids cost no order that an input's split
    decides. Null and empty texts are the end id alone; no rows give an empty manifest. A task writes under names of its own
    and renames at the end, so one that is lost or runs twice leaves whole files. The folder must be a file system that
    all executors reach.
    """
    spark = docs.sparkSession
    folder = (folder or f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}").rstrip("/")
    width = _width(vocabulary, end)
    bounds = shard_bounds(docs, int(spark.conf.get("spark.sql.shuffle.partitions")), shard_bytes)
    tokens = encoded(docs, vocabulary, end, bounds)
    order = [F.col("doc_id").asc_nulls_first(), F.col("key").asc(), F.col("row").asc()]

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _place(folder)
        shard, mark, n = None, uuid.uuid4().hex, 0
        sizes, owners, known = [np.zeros(1, np.int64)], [], []
        out = None
        for b in batches:
            if not len(b):
                continue
            if out is None:
                shard = b.column("shard")[0].as_py()
                store.create_dir(path, recursive=True)
                out = store.open_output_stream(f"{path}/{mark}.ids")
            ids = b.column("ids").cast(pa.large_binary())
            bounds = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1]
            out.write(ids.buffers()[2][int(bounds[0]) : int(bounds[-1])])
            sizes.append(np.diff(bounds) // width)
            owners.append(b.column("doc_id").fill_null(0).to_numpy())
            known.append(b.column("doc_id").is_valid().to_numpy(zero_copy_only=False).astype(np.uint8))
            n += len(b)
        if out is None:
            return
        out.close()
        offsets = np.cumsum(np.concatenate(sizes))
        for kind, held in (("off", [offsets.astype("<u8")]), ("doc", [np.concatenate(owners).astype("<i8"), np.concatenate(known)])):
            with store.open_output_stream(f"{path}/{mark}.{kind}") as file:
                for x in held:
                    file.write(x.tobytes())
        for kind in ("ids", "off", "doc"):
            store.move(f"{path}/{mark}.{kind}", f"{path}/{shard:08d}.{kind}")
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n_docs": pa.array([n], pa.int64()), "n_ids": pa.array([int(offsets[-1])], pa.int64()), "width": pa.array([width], pa.int32())})

    dealt = tokens.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions(*order)
    dealt.mapInArrow(filed, "shard int, n_docs long, n_ids long, width int").write.parquet(f"{folder}/manifest")
    return folder


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """shard, n_docs, n_ids, width and base (ids in all shards before) of a folder."""
    own = spark.read.schema("shard int, n_docs long, n_ids long, width int").parquet(f"{folder}/manifest").withColumn("block", F.floor(F.col("shard") / TOGETHER))
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = own.groupBy("block").agg(F.sum("n_ids").alias("n_ids")).select("block", before(Window.orderBy("block")).alias("ahead"))  # a row for TOGETHER shards
    return own.withColumn("within", before(Window.partitionBy("block").orderBy("shard"))).join(blocks, "block").select("shard", "n_docs", "n_ids", "width", (F.col("ahead") + F.col("within")).alias("base"))


def mapped(folder: str, shard: int, kind: str, dtype: str) -> np.ndarray:
    """One file of a shard, mapped into memory where the file system is a local or mounted one, else read."""
    store, path = _place(folder)
    path = f"{path}/{shard:08d}.{kind}"
    if store.get_file_info(path).size == 0:
        return np.zeros(0, dtype)
    if isinstance(store, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with store.open_input_file(path) as file:
        return np.frombuffer(file.readall(), dtype)


def shard_of(folder: str, shard: int, n_docs: int, n_ids: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, offsets, doc_ids and whether there is one, of a shard; a file of another size than the manifest says is an error."""
    ids, offsets, held = mapped(folder, shard, "ids", f"<u{width}"), mapped(folder, shard, "off", "<u8"), mapped(folder, shard, "doc", "u1")
    if (len(ids), len(offsets), len(held)) != (n_ids, n_docs + 1, 9 * n_docs) or int(offsets[-1]) != n_ids:
        raise ValueError(f"shard {shard} of {folder} is not as its manifest says")
    return ids, offsets.astype(np.int64), held[: 8 * n_docs].view("<i8"), held[8 * n_docs :] == 1


def read(spark: SparkSession, folder: str, rows: int = 5000) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files of a folder, each shard read by one task.

    start: ids of all documents before. ids_crc32: of the ids as little-endian unsigned 32-bit integers. A row without doc_id gets none.
    """
    shards = manifest(spark, folder)
    count = max(1, spark.read.schema("shard int").parquet(f"{folder}/manifest").agg(F.max("shard")).first()[0] or 0)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids, offsets, owners, known = shard_of(folder, r["shard"], r["n_docs"], r["n_ids"], r["width"])
                for at in range(0, r["n_docs"], rows):
                    stop = min(at + rows, r["n_docs"])
                    crc = [zlib.crc32(ids[offsets[i] : offsets[i + 1]].astype("<u4")) for i in range(at, stop)]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(owners[at:stop], mask=~known[at:stop]), "start": r["base"] + offsets[at:stop], "n_tokens": np.diff(offsets[at : stop + 1]), "ids_crc32": pa.array(crc, pa.int64())})

    return shards.repartitionById(count + 1, F.col("shard")).mapInArrow(each, "doc_id long, start long, n_tokens long, ids_crc32 long")


def vocabulary_of(path: str) -> str:
    """The text of a vocabulary file, read where the driver runs and sent along with the work; a few megabytes."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every whole text of documents, written and read back."""
    import public_tokenizers

    return read(spark, write(table(spark, sf_dir, "documents"), vocabulary_of(public_tokenizers.path(VOCABULARY))))
