"""Rows of alignments: insertions, gaps and index pairs, on native array functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def aligned(row: Column) -> Column:
    """The row without its insertions, which are in lower case."""
    return F.regexp_replace(row, "[a-z]", "")


def insertions(row: Column) -> Column:
    """For each aligned column, the letters inserted right before it; those after the last column are lost."""
    return F.transform(F.regexp_extract_all(row, F.lit("([a-z]*)[A-Z-]"), F.lit(1)), F.length)


def without_gaps_of(query: Column, row: Column) -> Column:
    """The row's columns where the query has no gap; columns past the query's end are lost."""
    of_query = F.split(query, "")
    return F.array_join(F.filter(F.split(row, ""), lambda _, i: F.get(of_query, i) != "-"), "")


def tokens(sequence: Column, alphabet: str, gap: str = "-") -> Column:
    """Each character's place in the alphabet; the alphabet's length if it is not there, one more for a gap."""
    n = len(alphabet)
    place = F.map_from_arrays(F.array(*(F.lit(c) for c in alphabet)), F.array(*(F.lit(i) for i in range(n))))
    return F.transform(F.split(sequence, ""), lambda c: F.when(c == gap, n + 1).otherwise(F.coalesce(F.try_element_at(place, c), F.lit(n))))


def index_pairs(query: Column, other: Column) -> Column:
    """Array of q and t, the ungapped positions (from 0) of columns where neither of two aligned strings has a gap.

    The longer string's rest is ignored; null for null strings.
    """
    n = F.least(F.length(query), F.length(other))
    before = lambda s, i: i - F.length(F.regexp_replace(F.substring(s, F.lit(1), i), "[^-]", ""))
    columns = F.filter(
        F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: (F.substring(query, i + 1, F.lit(1)) != "-") & (F.substring(other, i + 1, F.lit(1)) != "-"),
    )
    return F.transform(columns, lambda i: F.struct(before(query, i).alias("q"), before(other, i).alias("t")))


def projection_stats(df: DataFrame, key: str, query: str, other: str) -> DataFrame:
    """key, n_pairs, identity, coverage, aligned_fraction of two aligned strings; shares of nothing are 0."""
    letters = lambda c: F.regexp_replace(c, "-", "")
    pairs = index_pairs(F.col(query), F.col(other))
    own = df.select(key, pairs.alias("p"), letters(F.col(query)).alias("q"), letters(F.col(other)).alias("t"))
    same = F.size(F.filter("p", lambda x: F.substring(F.col("q"), x["q"] + 1, F.lit(1)) == F.substring(F.col("t"), x["t"] + 1, F.lit(1))))
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    n = F.size("p")
    return own.select(
        key, n.alias("n_pairs"), share(same, n).alias("identity"), share(n, F.length("q")).alias("coverage"), share(n, F.greatest(F.length("q"), F.length("t"))).alias("aligned_fraction")
    )
