"""Fill-in-middle transformation: a numpy kernel over the UTF-8 buffers of whole Arrow batches.

All texts of a batch lie end to end in one buffer. A lookup classes its bytes, a mask of neighbouring bytes marks where tokens
begin, and a cumulative sum, taken from each document's own start, numbers them; searchsorted then finds the cuts of all rows at
once. The pieces between the cuts are views of the same buffer, put together by Arrow. No step takes one row at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ._common import short_batches, table

#: Signs of the prefix, the suffix and the middle.
SIGNS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = 0, 1, 2
FORMS = ("plain", "psm", "spm")
#: Bytes of text that are cut at once; a longer text is taken alone.
RUN = 8 << 20
NOTHING = pa.scalar("", pa.large_string())
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[ord(s[1]) for s in SIGNS]] = True


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n + 1 bounds of n texts in them."""
    texts = texts.cast(pa.large_string())
    _, bounds, data = texts.buffers()
    bounds = np.frombuffer(bounds, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def _views(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Texts between neighbouring bounds, without a copy of data."""
    return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(data))


def _before(mask: np.ndarray) -> np.ndarray:
    """For each place, and the end, how many are set before it."""
    out = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def signs(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all signs in data and the text of each; a sign lies within one text."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero((data[:-2] == ord("<")) & _LETTER[data[1:-1]] & (data[2:] == ord(">")))
    text = np.searchsorted(bounds, at, "right") - 1
    whole = at + 3 <= bounds[text + 1]
    return at[whole], text[whole]


def cut(texts: pa.Array, h: np.ndarray, rate: int, spm: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Tokens, form, code points of prefix and of middle, and output of each text. h: four columns of hashes."""
    data, bounds = _buffers(texts)
    begins, ends = bounds[:-1], bounds[1:]
    space = _SPACE[data]
    mask = space.copy()
    mask[1:] &= ~space[:-1]
    mask[begins[begins < ends]] = True  # a text's first token, whatever stands before it in the buffer
    before = _before(mask)
    base = before[begins]
    n = before[ends] - base
    first, second = h[0] % (n + 1), h[1] % (n + 1)

    def place(k: np.ndarray) -> np.ndarray:
        return np.minimum(np.searchsorted(before[1:], base + k + 1), ends)

    one, two = place(np.minimum(first, second)), place(np.maximum(first, second))
    signed = np.zeros(len(n), bool)
    signed[signs(data, bounds)[1]] = True
    form = np.where(signed | (begins == ends) | (h[2] % 100 >= rate), PLAIN, np.where(h[3] % 100 < spm, SPM, PSM))
    points = _before((data & 0xC0) != 0x80)
    parts = _views(data, np.append(np.stack([begins, one, two], 1).ravel(), bounds[-1]))
    marks, row = pa.array(["", *SIGNS], pa.large_string()), np.arange(len(n)) * 3

    def chosen(order: tuple, taken: pa.Array, start: np.ndarray | int = 0) -> pa.Array:
        return taken.take(pa.array(start + np.array(order)[form]))

    # For plain, psm and spm: which sign, or none, and which part comes first, second and third.
    output = pc.binary_join_element_wise(
        chosen((0, 1, 2), marks), chosen((0, 0, 2), parts, row), chosen((0, 2, 1), marks), chosen((1, 2, 0), parts, row), chosen((0, 3, 3), marks), chosen((2, 1, 1), parts, row), NOTHING
    )
    return n, form, points[one] - points[begins], points[two] - points[one], output


def uncut(outputs: pa.Array, form: np.ndarray) -> pa.Array:
    """The texts that cut() made the outputs of. A text without signs has three when it is cut, so they part it exactly."""
    data, bounds = _buffers(outputs)
    at, text = signs(data, bounds)
    cuts = form != PLAIN
    at = at[cuts[text]]
    if len(at) != 3 * cuts.sum() or np.any(text[cuts[text]] != np.repeat(np.flatnonzero(cuts), 3)):
        raise ValueError("an output does not hold its three signs")
    places = np.repeat(bounds[:-1, None], 7, 1)
    places[cuts, 1::2] = at.reshape(-1, 3)
    places[cuts, 2::2] = at.reshape(-1, 3) + 3
    parts = _views(data, np.append(places.ravel(), bounds[-1]))
    row = np.arange(len(form)) * 7
    # Parts 2, 4 and 6 follow the signs; a plain text is all in part 6.
    order = [parts.take(pa.array(row + np.array(x)[form])) for x in ((2, 2, 4), (4, 6, 6), (6, 4, 2))]
    return pc.binary_join_element_wise(*order, NOTHING)


def _runs(texts: pa.Array) -> Iterator[slice]:
    """Rows in runs of about RUN bytes."""
    _, bounds = _buffers(texts)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + RUN, "right")) - 1)
        yield slice(at, end)
        at = end


def filled(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every row of docs (doc_id, text); other columns are not read.

    A text is n tokens: a run of white space with the word after it, or white space at the end. The hash of seed and doc_id gives two
    cuts between tokens and the form: `rate` in 100 texts are cut, `spm` in 100 of these have their suffix first. Null and empty texts,
    and texts that hold a sign, are plain: the output is the text, the two lengths are null. A null doc_id is hashed as an empty one;
    rows that share a doc_id and a text have equal outputs. No rows in give none out.
    """
    short_batches(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k}") for k in range(4)]
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *h)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in _runs(batch.column("text")):
                b = batch.slice(run.start, run.stop - run.start)
                n, form, prefix, middle, output = cut(b.column("text"), np.stack([b.column(f"h{k}").to_numpy() for k in range(4)]), rate, spm)
                plain = form == PLAIN
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(n), pa.array(FORMS).take(pa.array(form)), pa.array(prefix, mask=plain), pa.array(middle, mask=plain), output.cast(pa.string())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return own.mapInArrow(each, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string")


@F.arrow_udf(StringType())
def _restored(output: pa.Array, form: pa.Array) -> pa.Array:
    code = pc.index_in(form, pa.array(FORMS)).to_numpy(zero_copy_only=False).astype(np.int64)
    parts = [uncut(output.slice(r.start, r.stop - r.start), code[r]).cast(pa.string()) for r in _runs(output)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def restored(output: Column, form: Column) -> Column:
    """The text that an output of filled() was made of."""
    return _restored(output, form)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents cut, and put together again."""
    out = filled(table(spark, sf_dir, "documents"))
    back = F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), back.alias("restored_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS h,
  regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
i AS (SELECT doc_id, t, u, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
  ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM i),
p AS (SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS x, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || x || '<M>' || m END AS output FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(output) AS output_sha256, sha256(t) AS restored_sha256 FROM o"""
