"""CIF files as a Spark data source: one category of every data block as a table.

    cif.category(spark, path, "atom_site", ["id", "Cartn_x"])

Files are packed into partitions by size and read line by line, so a task holds some rows and no file. A category may be a loop or
single items; values may be quoted, or text fields over many lines; `?` and `.` without quotes are null. Files may be gzipped.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes of files that a partition takes, rows of a batch.
PACK, BATCH = 64 << 20, 20_000
_TOKEN = re.compile(r"""'((?:[^']|'(?=\S))*)'(?=\s|$)|"((?:[^"]|"(?=\S))*)"(?=\s|$)|(#.*)|(\S+)""")
_SPECIAL = re.compile(r"[\"'#]")
_WORD = re.compile(r"(data_|save_|loop_$|stop_$|global_$)", re.I)


def tokens(lines: Iterable[str]) -> Iterator[tuple[str, bool]]:
    """Each token of CIF lines and whether it stands as it is, without quotes."""
    field: list[str] | None = None
    for line in lines:
        line = line.rstrip("\r\n")
        if field is not None:
            if not line.startswith(";"):
                field.append(line)
                continue
            yield "\n".join(field), False
            field, line = None, line[1:]
        elif line.startswith(";"):
            field = [line[1:]]
            continue
        if not _SPECIAL.search(line):
            for word in line.split():
                yield word, True
            continue
        for one, two, comment, bare in _TOKEN.findall(line):
            if bare:
                yield bare, True
            elif not comment:
                yield one or two, False
    if field is not None:
        raise ValueError("a text field has no end")


def _value(text: str, bare: bool) -> str | None:
    return None if bare and text in ("?", ".") else text


def rows(lines: Iterable[str], category: str) -> Iterator[tuple[str, list[str], list[str | None]]]:
    """Block, item names (lower case) and values of each row of a category, in the order of the file. A loop that ends within a row is an error."""
    lead, block = f"_{category.lower()}.", ""
    names: list[str] = []
    held: list[str | None] = []
    mode, wanted = "", False
    alone: tuple[list[str], list[str | None]] = ([], [])
    for text, bare in tokens(lines):
        name = bare and text.startswith("_")
        word = bare and not name and _WORD.match(text)
        if mode == "loop" and (name or word):
            if held:
                raise ValueError(f"a loop of {names} ends within a row")
            mode = ""
        if name and mode == "names":
            names.append(text.lower())
        elif name:
            if alone[0] and not text.lower().startswith(lead):
                yield block, *alone
                alone = ([], [])
            mode, names = "item", [text.lower()]
        elif word:
            if alone[0]:
                yield block, *alone
                alone = ([], [])
            if text.lower().startswith("data_"):
                block = text[5:]
            mode, names, held = ("names", [], []) if text.lower() == "loop_" else ("", [], [])
        elif mode == "item":
            if names[0].startswith(lead):
                alone[0].append(names[0][len(lead) :])
                alone[1].append(_value(text, bare))
            mode = ""
        elif mode in ("names", "loop"):
            if mode == "names":
                mode, wanted = "loop", bool(names) and names[0].startswith(lead)
                if wanted:
                    items = [n[len(lead) :] for n in names]
            held.append(_value(text, bare))
            if len(held) == len(names):
                if wanted:
                    yield block, items, held
                held = []
    if held:
        raise ValueError(f"a loop of {names} ends within a row")
    if alone[0]:
        yield block, *alone


class _Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        super().__init__(paths)


class CifReader(DataSourceReader):
    """Reads one category; see CifSource."""

    def __init__(self, schema: StructType, options: dict) -> None:
        self.names, self.path, self.category = schema.fieldNames(), options["path"], options["category"]

    def partitions(self) -> list[_Files]:
        store, path = pafs.FileSystem.from_uri(self.path)
        info = store.get_file_info(path)
        found = [info] if info.is_file else store.get_file_info(pafs.FileSelector(path, recursive=True))
        found = sorted((f for f in found if f.is_file and not re.search(r"(^|/)[._]", f.path[len(path) :])), key=lambda f: f.path)
        packs: list[list[str]] = [[]]
        size = 0
        for f in found:
            if packs[-1] and size + f.size > PACK:
                packs.append([])
                size = 0
            packs[-1].append(f.path)
            size += f.size
        return [_Files(p) for p in packs]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(self.path)
        kinds = [pa.int64() if n == "row" else pa.string() for n in self.names]
        out: list[list] = [[] for _ in self.names]
        for path in partition.value:
            with store.open_input_stream(path, compression="gzip" if path.endswith(".gz") else None) as raw:
                known: dict[tuple, list[int | None]] = {}
                for at, (block, items, values) in enumerate(rows(io.TextIOWrapper(raw, "utf-8", errors="replace"), self.category)):
                    key = tuple(items)
                    if key not in known:
                        place = {n: i for i, n in reversed(list(enumerate(items)))}
                        known[key] = [place.get(n.lower()) for n in self.names]
                    fixed = {"file": path, "block": block, "row": at}
                    for column, n, i in zip(out, self.names, known[key]):
                        column.append(fixed[n] if n in fixed else None if i is None else values[i])
                    if len(out[0]) == BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=self.names)
                        out = [[] for _ in self.names]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=self.names)


class CifSource(DataSource):
    """Data source `cif`. Its schema is the caller's: `file`, `block` and `row` (the row's number in its file) and names of items, all of them strings but row."""

    @classmethod
    def name(cls) -> str:
        return "cif"

    def schema(self) -> StructType:
        raise ValueError("name the items that are wanted in the schema")

    def reader(self, schema: StructType) -> CifReader:
        return CifReader(schema, dict(self.options))


def category(spark: SparkSession, path: str, name: str, items: list[str]) -> DataFrame:
    """file, block, row and the named items of a category of all files below path; an item that a block lacks is null."""
    spark.dataSource.register(CifSource)
    schema = ", ".join(["file string, block string, row long", *(f"`{i}` string" for i in items)])
    return spark.read.format("cif").schema(schema).option("category", name).load(path)
