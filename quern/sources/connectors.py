"""Data sources that Spark lacks: SQLite tables and sheets of XLSX workbooks, read with the standard library."""

from __future__ import annotations

import re
import sqlite3
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


class _Range(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    """Reads ranges of rowids in parallel, each over a read-only connection."""

    def __init__(self, schema, options: dict) -> None:
        self.columns = [f.name for f in schema.fields]
        self.path, self.table, self.parts = options["path"], options["dbtable"], int(options.get("numpartitions", 8))

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        with self._open() as db:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if low is None:
            return [_Range(0, 0)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Range(x, min(x + step, high + 1)) for x in range(low, high + 1, step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        listed = ", ".join(f'"{c}"' for c in self.columns)
        with self._open() as db:
            yield from db.execute(f'SELECT {listed} FROM "{self.table}" WHERE rowid >= ? AND rowid < ?', (partition.low, partition.high))


class SqliteSource(DataSource):
    """format("sqlite"), options path, dbtable, numPartitions; the schema is the reader's, else all columns as text."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            kinds = {"INTEGER": "bigint", "REAL": "double"}
            return ", ".join(f"`{r[1]}` {kinds.get(r[2].upper(), 'string')}" for r in db.execute(f"PRAGMA table_info(\"{self.options['dbtable']}\")"))

    def reader(self, schema) -> DataSourceReader:
        return SqliteReader(schema, self.options)


def _column(reference: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", reference).group():
        n = n * 26 + ord(ch) - 64
    return n - 1


def sheet_rows(path: str, sheet: str | None, typed: bool = False) -> Iterator[list[str | None]]:
    """Rows of a sheet as text, in order; empty cells are null. The sheet is streamed.

    ``typed`` puts n: before numbers and s: before text, so that a number typed as text is told from a number.
    """
    figures, words = ("n:", "s:") if typed else ("", "")
    with zipfile.ZipFile(path) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.parse(z.open("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        links = {r.get("Id"): r.get("Target") for r in ElementTree.parse(z.open("xl/_rels/workbook.xml.rels")).getroot()}
        sheets = {s.get("name"): links[s.get(f"{_REL}id")] for s in ElementTree.parse(z.open("xl/workbook.xml")).iter(f"{_MAIN}sheet")}
        if sheet is not None and sheet not in sheets:
            raise ValueError(f"no sheet {sheet}; there are {', '.join(sheets)}")
        target = sheets[sheet] if sheet is not None else next(iter(sheets.values()))
        name = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        last = 0
        for _, row in ElementTree.iterparse(z.open(name)):
            if row.tag != f"{_MAIN}row":
                continue
            number = int(row.get("r") or last + 1)
            yield from ([] for _ in range(number - last - 1))
            last = number
            cells: list[str | None] = []
            for c in row.iter(f"{_MAIN}c"):
                at = _column(c.get("r")) if c.get("r") else len(cells)
                cells += [None] * (at + 1 - len(cells))
                v = c.find(f"{_MAIN}v")
                if c.get("t") == "s" and v is not None:
                    cells[at] = words + shared[int(v.text)]
                elif c.get("t") == "inlineStr":
                    cells[at] = words + "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                elif v is not None:
                    cells[at] = (words if c.get("t") in ("str", "e", "b") else figures) + v.text
            yield cells
            row.clear()


class XlsxReader(DataSourceReader):
    def __init__(self, schema, options: dict) -> None:
        self.width, self.options = len(schema.fields), options

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        skip = int(self.options.get("header", 0)) + 1
        for i, row in enumerate(sheet_rows(self.options["path"], self.options.get("sheet"), self.options.get("typed") == "true")):
            if i >= skip and any(c is not None for c in row):
                yield tuple((row + [None] * self.width)[: self.width])


class XlsxSource(DataSource):
    """format("xlsx"), options path, sheet, header (rows before the header row), typed; all cells as text, blank rows left out."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        header = int(self.options.get("header", 0))
        for i, row in enumerate(sheet_rows(self.options["path"], self.options.get("sheet"))):
            if i == header:
                names: list[str] = []
                for j, c in enumerate(row):
                    name = (c or f"column_{j}").strip().removesuffix(".0")
                    names.append(name if name not in names else f"{name}_{j}")
                return ", ".join(f"`{n}` string" for n in names)
        raise ValueError("the sheet ends before its header")

    def reader(self, schema) -> DataSourceReader:
        return XlsxReader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SqliteSource)
    spark.dataSource.register(XlsxSource)


#: What the reader gives for a quoted empty cell, which it would not tell from a missing one.
_EMPTY = "\x01"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header and the given schema; a cell that doesn't fit raises. Quoted empty cells are empty texts, others null."""
    rows = spark.read.csv(path, header=True, schema=schema, mode="FAILFAST", enforceSchema=False, escape='"', multiLine=True, emptyValue=_EMPTY)
    return rows.select(*[F.when(F.col(f"`{c}`") == _EMPTY, "").otherwise(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in rows.dtypes])
