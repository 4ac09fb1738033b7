"""Reports as text: a table of ranked entries in Markdown, and faults of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns of the table, largest file and endings of files that are refused.
COLUMNS = ("#", "Name", "Team", "Rank Score", "Hidden FoldScore", "Public FoldScore", "Date", "Commit", "Description")
LARGEST = 20 * 1024 * 1024
REFUSED = (".pt", ".pth", ".ckpt", ".safetensors", ".npz")


def cell(value: Column) -> Column:
    """Text for a cell: trimmed, on one line, bars escaped; null is empty."""
    return F.regexp_replace(F.translate(F.trim(F.coalesce(value.cast("string"), F.lit(""))), "\n", " "), r"\|", r"\\|")


def score_cell(value: Column) -> Column:
    """Four decimals, n/a for null and NaN."""
    number = value.cast("double")
    return F.when(number.isNull() | F.isnan(number), "n/a").otherwise(F.format_string("%.4f", number))


def _filled(*columns: Column) -> Column:
    return F.coalesce(*(F.when(c != "", c) for c in columns))


def _named(entries: DataFrame) -> DataFrame:
    for c in ("submission", "path"):
        if c not in entries.columns:
            entries = entries.withColumn(c, F.lit(None).cast("string"))
    own = F.nullif(F.trim(F.coalesce("submission", F.lit(""))), F.lit(""))
    name, team = _filled(F.col("name"), F.col("submission"), F.col("team")), _filled(F.col("team"), F.col("submission"))
    return entries.withColumns({"name": name, "team": team, "path": _filled(F.col("path"), F.concat(F.lit("submissions/"), own))})


def _link(name: Column, path: Column) -> Column:
    label = F.regexp_replace(cell(name), r"([\[\]])", r"\\$1")
    target = F.trim(F.coalesce(path, F.lit("")))
    for old, new in (("\n", ""), (" ", "%20"), ("(", "%28"), (")", "%29")):
        target = F.replace(target, F.lit(old), F.lit(new))
    return F.when((label != "") & (target != ""), F.concat(F.lit("["), label, F.lit("]("), target, F.lit(")"))).otherwise(label)


def ranked_lines(entries: DataFrame, track: str = "track") -> DataFrame:
    """track, rank and line, a row of its Markdown table, for entries with name, team, rank_score, hidden, public, date, commit and description.

    Entries may have submission and path too: a name that is missing is the submission or the team, a missing team is the submission, and the name links to
    the path, or to the submission's own folder.

    Best rank score first (null and NaN last), then date, then name. A track's entries are ranked in one task: a leaderboard is small.
    """
    score = F.when(~F.isnan("rank_score"), F.col("rank_score"))
    rank = F.row_number().over(Window.partitionBy(track).orderBy(score.desc_nulls_last(), F.coalesce("date", F.lit("")), F.coalesce("name", F.lit(""))))
    texts = [_link(F.col("name"), F.col("path")), cell(F.col("team")), *map(score_cell, map(F.col, ("rank_score", "hidden", "public"))), cell(F.col("date")),
             F.concat(F.lit("`"), cell(F.substring("commit", 1, 7)), F.lit("`")), cell(F.col("description"))]
    own = _named(entries).withColumn("rank", rank)
    return own.select(track, "rank", F.concat(F.lit("| "), F.concat_ws(" | ", F.col("rank").cast("string"), *texts), F.lit(" |")).alias("line"))


def markdown(lines: DataFrame, order: list[str], track: str = "track") -> str:
    """The tables of all tracks, those of `order` first, then by name. The entries of a leaderboard are few; they come to the driver. Without entries the
    tracks of order are listed as empty."""
    place = lambda name: (order.index(name) if name in order else len(order), name)
    tables: dict[str, list] = {}
    for r in lines.toLocalIterator():
        tables.setdefault(r[track] or "", []).append((r["rank"], r["line"]))
    if not tables:
        return "\n".join(["| Track | Status |", "|---|---|", *(f"| `{name}` | No accepted submissions yet |" for name in order)])
    head = ["| " + " | ".join(COLUMNS) + " |", "|---:|---|---|---:|---:|---:|---|---|---|"]
    return "\n\n".join("\n".join([f"### `{name or 'unknown'}`", *head, *(line for _, line in sorted(tables[name]))]) for name in sorted(tables, key=place))


def file_faults(path: Column, size: Column, prefixes: tuple[str, ...] = (), exact: tuple[str, ...] = ()) -> Column:
    """Faults of a file, in order: large, refused (by its ending), forbidden (by its path)."""
    ending = F.lower(F.regexp_extract(path, r"[^/.](\.[^./]*)$", 1))
    forbidden = path.isin(*exact) if exact else F.lit(False)
    for prefix in prefixes:
        forbidden = forbidden | path.startswith(prefix)
    return F.array_compact(F.array(F.when(size > LARGEST, "large"), F.when(ending.isin(*REFUSED), "refused"), F.when(forbidden, "forbidden")))


def between_markers(text: str, table: str, begin: str, end: str) -> str:
    """text with table in place of what stands between the two marker lines; a text without them, or with them in the wrong order, is an error."""
    if text.count(begin) != 1 or text.count(end) != 1 or text.index(end) < text.index(begin):
        raise ValueError(f"the text needs {begin} and {end} once each, in this order")
    return f"{text[: text.index(begin) + len(begin)]}\n{table}\n{text[text.index(end) :]}"
