"""Column expressions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_filled(*columns: str) -> Column:
    """The first of the columns that is not null or blank, trimmed and in upper case."""
    return F.upper(F.coalesce(*(F.when(F.trim(F.col(c)) != "", F.trim(F.col(c))) for c in columns)))


def rounded(x: Column, places: int) -> Column:
    """x (a double) to so many decimals; what comes to zero keeps its sign, as IEEE 754 has it."""
    out = F.round(x, places)
    return F.when(out == 0, F.signum(x) * 0.0).otherwise(out)


def key_encode(column: str, prefix: str = "chain_") -> Column:
    """A reversible name that keeps case apart on any file system."""
    return F.concat(F.lit(prefix), F.lower(F.hex(F.encode(F.col(column), "UTF-8"))))


def key_decode(column: Column, prefix: str = "chain_") -> Column:
    """Undo `key_encode`."""
    return F.decode(F.unhex(F.substring(column, len(prefix) + 1, 1 << 30)), "UTF-8")


def salted_score(salt: str, *columns: str) -> Column:
    """16 hex digits in an order that only the salt decides; equal to the first 8 bytes of SHA-256, big-endian."""
    return F.substring(F.sha2(F.concat_ws(":", F.lit(salt), *(F.col(c).cast("string") for c in columns)), 256), 1, 16)


def stratum(*columns: str) -> Column:
    """The columns' values joined by bars; null reads unknown."""
    return F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in columns))


def binned(column: str, edges: list[tuple[float, str]], above: str, unknown: str = "unknown") -> Column:
    """The name of the first edge that the value lies below; NaN and null have none."""
    out = F.when(F.col(column).isNull() | F.isnan(F.col(column).cast("double")), unknown)
    for edge, name in edges:
        out = out.when(F.col(column) < edge, name)
    return out.otherwise(above)


def foreign_share(column: str, alphabet: str) -> Column:
    """Share of characters outside a regular-expression class; 1 for the empty string."""
    n = F.length(column)
    return F.when(n == 0, 1.0).otherwise(F.length(F.regexp_replace(column, f"[{alphabet}]", "")) / n)


def finite(column: str) -> Column:
    """The value, or null where it is NaN."""
    return F.when(~F.isnan(F.col(column)), F.col(column))
