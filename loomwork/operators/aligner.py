"""Global alignment of pairs of sequences with affine gaps, and what it carries from one sequence to the other.

A batch of pairs is aligned at once: cells of one anti-diagonal depend on the two before alone, so each step takes a whole diagonal of
all pairs. Only every so many diagonals are kept; the way back works on what lies between two of them once more, so memory grows
with a sequence's length times the root of both, not with their product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

#: What a match, a mismatch, the first and each further place of a gap count.
MATCH, MISMATCH, OPEN, EXTEND = 2, -1, -4, -1
PAIR, IN_OTHER, IN_QUERY = 0, 1, 2
#: Cells of a diagonal that are taken together, about.
CELLS = 1 << 16
_LOW = -(1 << 29)


class _Batch:
    """Pairs of sequences as padded codes, and the steps from diagonal to diagonal."""

    def __init__(self, pairs: list[tuple[str, str]], scores: tuple[int, int, int, int]) -> None:
        codes = [[np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32) for s in side] for side in zip(*pairs)]
        self.match, self.mismatch, self.open, self.extend = scores
        (self.m, self.n), self.size = (max(map(len, side)) for side in codes), len(pairs)
        self.query = np.zeros((self.size, self.m), np.uint32)
        self.other = np.zeros((self.size, self.n), np.uint32)
        for row, (q, t) in enumerate(zip(*codes)):
            self.query[row, : len(q)] = q
            self.other[row, self.n - len(t) :] = t[::-1]  # from right to left, so that a diagonal is a slice of both
        self.lengths = np.array([[len(q), len(t)] for q, t in zip(*codes)])

    def start(self) -> tuple[np.ndarray, np.ndarray]:
        """States (pair, gap in the other, gap in the query) of the diagonals -1 and 0."""
        none = np.full((3, self.size, self.m + 1), _LOW, np.int32)
        first = none.copy()
        first[PAIR, :, 0] = 0
        return none, first

    def step(self, d: int, two: np.ndarray, one: np.ndarray, ways: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """States of diagonal d from the two before it; with ways, also from which state each came, two bits for each of the three."""
        new = np.full_like(one, _LOW)
        low, high = max(0, d - self.n), min(self.m, d)
        way = np.zeros((self.size, self.m + 1), np.uint8) if ways else None

        def put(state: int, cells: slice, sources: list[np.ndarray], add: np.ndarray | int) -> None:
            best = np.maximum(np.maximum(sources[0], sources[1]), sources[2])
            new[state, :, cells] = best + add
            if ways:
                way[:, cells] |= (np.where(sources[0] == best, 0, np.where(sources[1] == best, 1, 2)) << (2 * state)).astype(np.uint8)

        a, b = max(1, low), min(high, d - 1)  # both sequences take a character
        if a <= b:
            same = self.query[:, a - 1 : b] == self.other[:, self.n - d + a : self.n - d + b + 1]
            put(PAIR, slice(a, b + 1), [two[s, :, a - 1 : b] for s in range(3)], np.where(same, self.match, self.mismatch))
        a = max(1, low)
        if a <= high:
            put(IN_OTHER, slice(a, high + 1), [one[PAIR, :, a - 1 : high] + self.open, one[IN_OTHER, :, a - 1 : high] + self.extend, one[IN_QUERY, :, a - 1 : high] + self.open], 0)
        b = min(high, d - 1)
        if low <= b:
            put(IN_QUERY, slice(low, b + 1), [one[PAIR, :, low : b + 1] + self.open, one[IN_OTHER, :, low : b + 1] + self.open, one[IN_QUERY, :, low : b + 1] + self.extend], 0)
        return new, way

    def run(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """Scores, and for each pair its index pairs from last to first."""
        rows, last = np.arange(self.size), self.lengths.sum(1)
        every = max(1, int(np.sqrt(last.max())))
        states, kept = self.start(), []
        score, state = np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
        for d in range(1, int(last.max()) + 1):
            if (d - 1) % every == 0:
                kept.append(states)
            states = (states[1], self.step(d, *states)[0])
            at_end = rows[last == d]
            ends = states[1][:, at_end, self.lengths[at_end, 0]]
            score[at_end], state[at_end] = ends.max(0), ends.argmax(0)
        i, at = self.lengths[:, 0].copy(), last.copy()
        found: list[list[tuple]] = []
        for block in range(len(kept) - 1, -1, -1):
            states, ways = kept[block], {}
            for d in range(block * every + 1, min((block + 1) * every, int(last.max())) + 1):
                new, ways[d] = self.step(d, *states, True)
                states = (states[1], new)
            for d in sorted(ways, reverse=True):
                here = rows[at == d]
                if not len(here):
                    continue
                paired, gap = state[here] == PAIR, state[here] == IN_OTHER
                if paired.any():
                    found.append((here[paired], i[here[paired]] - 1, d - i[here[paired]] - 1))
                came = ways[d][here, i[here]] >> (2 * state[here]) & 3
                i[here] -= paired | gap
                at[here] -= 1 + paired
                state[here] = came
        which, q, t = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int),) * 3
        order = np.lexsort((q, which))
        cuts = np.searchsorted(which[order], rows[1:])
        return score, np.split(np.stack([q[order], t[order]]), cuts, 1)


def align(queries: list[str | None], others: list[str | None], scores: tuple[int, int, int, int] = (MATCH, MISMATCH, OPEN, EXTEND)) -> list[tuple[int, np.ndarray] | None]:
    """Score and index pairs (two rows, from 0, rising) of each pair; None where a sequence is null or empty."""
    out: list = [None] * len(queries)
    todo = sorted((i for i in range(len(queries)) if queries[i] and others[i]), key=lambda i: (len(queries[i]), len(others[i])))
    at = 0
    while at < len(todo):
        end = at + 1
        while end < len(todo) and (end - at + 1) * (len(queries[todo[end]]) + 1) <= CELLS:
            end += 1
        score, pairs = _Batch([(queries[i], others[i]) for i in todo[at:end]], scores).run()
        for i, s, p in zip(todo[at:end], score, pairs):
            out[i] = (int(s), p)
        at = end
    return out


_KIND = StructType([StructField("score", IntegerType()), StructField("q", ArrayType(IntegerType())), StructField("t", ArrayType(IntegerType()))])


def alignment(query: Column, other: Column, match: int = MATCH, mismatch: int = MISMATCH, open: int = OPEN, extend: int = EXTEND) -> Column:
    """Struct of score, q and t: places (from 0) that the best global alignment of two strings puts together.

    A gap of n places counts open + (n - 1) * extend, at the ends too; characters are the same or not, upper and lower case differ. Of equally good
    alignments the one is taken that, seen from the end, has a pair before a gap in the other, and that before a gap in the query. Null and empty
    strings have a null score and no pairs.
    """

    @F.arrow_udf(_KIND)
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        found = align(a.to_pylist(), b.to_pylist(), (match, mismatch, open, extend))
        side = lambda k: pa.array([[] if x is None else x[1][k] for x in found], pa.list_(pa.int32()))
        return pa.StructArray.from_arrays([pa.array([None if x is None else x[0] for x in found], pa.int32()), side(0), side(1)], names=["score", "q", "t"])

    return run(query, other)


def pairs_score(query: Column, other: Column, q: Column, t: Column, match: int = MATCH, mismatch: int = MISMATCH, open: int = OPEN, extend: int = EXTEND) -> Column:
    """What an alignment given by its index pairs counts."""
    gap = lambda n: F.when(n > 0, open + (n - 1) * extend).otherwise(0)
    ends = lambda x, s: F.concat(F.array(F.lit(-1)), x, F.array(F.length(s)))
    gaps = lambda x, s: F.aggregate(F.sequence(F.lit(1), F.size(x) + 1), F.lit(0), lambda out, k: out + gap(F.get(ends(x, s), k) - F.get(ends(x, s), k - 1) - 1))
    same = lambda a, b: F.when(F.substring(query, a + 1, F.lit(1)) == F.substring(other, b + 1, F.lit(1)), match).otherwise(mismatch)
    return F.aggregate(F.arrays_zip(q.alias("q"), t.alias("t")), F.lit(0), lambda out, x: out + same(x["q"], x["t"])) + gaps(q, query) + gaps(t, other)


def projection(chains: DataFrame, key: str, query: str, sequence: str) -> DataFrame:
    """key, q and t of the alignment of two sequences, identity, coverage and aligned_fraction: the share of pairs that are the same letter in any
    case, pairs to the query's length, pairs to the longer length. Pairs of nothing give shares of 0."""
    own = chains.select(key, F.coalesce(query, F.lit("")).alias("_a"), F.coalesce(sequence, F.lit("")).alias("_b")).withColumn("_x", alignment(F.col("_a"), F.col("_b")))
    n = F.size("_x.q")
    letter = lambda c, i: F.upper(F.substring(c, i + 1, F.lit(1)))
    same = F.size(F.filter(F.arrays_zip(F.col("_x.q").alias("q"), F.col("_x.t").alias("t")), lambda x: letter(F.col("_a"), x["q"]) == letter(F.col("_b"), x["t"])))
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return own.select(key, "_x.q", "_x.t", share(same, n).alias("identity"), share(n, F.length("_a")).alias("coverage"), share(n, F.greatest(F.length("_a"), F.length("_b"))).alias("aligned_fraction"))


def projected_atoms(pairs: DataFrame, atoms: DataFrame, key: str) -> DataFrame:
    """atoms (key, res, slot and others) whose residue is in t of pairs (key, q, t), with res the place in q; other atoms are left out."""
    flat = pairs.select(key, F.explode(F.arrays_zip("q", "t")).alias("_x")).select(key, F.col("_x.t").alias("res"), F.col("_x.q").alias("_to"))
    return atoms.join(flat, [key, "res"]).withColumn("res", F.col("_to")).select(*atoms.columns)


def projection_report(pairs: DataFrame, atoms: DataFrame, key: str, slot: int = 1) -> DataFrame:
    """projection() without its pairs, with valid_ca: residues of the query that get an atom of that slot."""
    there = projected_atoms(pairs, atoms.where(F.col("slot") == slot), key).groupBy(key).agg(F.count_distinct("res").alias("valid_ca"))
    return pairs.drop("q", "t").join(there, key, "left").withColumn("valid_ca", F.coalesce("valid_ca", F.lit(0)))


def scattered_arrays(df: DataFrame, length: str, places: str, sources: str, arrays: dict[str, object]) -> DataFrame:
    """df with each of the arrays dealt anew, all in one pass: an array of `length` that holds at places[k] what stood at sources[k], elsewhere the fill.

    arrays: column and fill, of any element type. Places and sources outside their arrays, and null ones, count for nothing; of a place named twice
    the last counts; a null or negative length is 0.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.maximum(pc.fill_null(b.column(length), 0).to_numpy(zero_copy_only=False).astype(np.int64), 0)
            ends = np.cumsum(sizes)
            flat = lambda c: pc.fill_null(pc.list_flatten(c), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            to, of = b.column(places), b.column(sources)
            count = [pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (to, of)]
            if np.any(count[0] != count[1]):
                raise ValueError(f"{places} and {sources} differ in length")
            row, to, of = np.repeat(np.arange(len(b)), count[0]), flat(to), flat(of)
            out = b
            for name, fill in arrays.items():
                held = b.column(name)
                many = pc.fill_null(pc.list_value_length(held), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                values = pc.list_flatten(held)
                index = np.full(int(ends[-1]) if len(ends) else 0, len(values))
                good = (to >= 0) & (to < sizes[row]) & (of >= 0) & (of < many[row])
                index[(ends - sizes)[row[good]] + to[good]] = (np.cumsum(many) - many)[row[good]] + of[good]
                made = pa.concat_arrays([values, pa.array([fill], values.type)]).take(pa.array(index))
                new = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), made)
                out = out.set_column(out.schema.get_field_index(name), pa.field(name, new.type), new)
            yield out

    return df.mapInArrow(each, df.schema)
