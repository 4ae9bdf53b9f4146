"""Spark data sources for files that Spark has no reader for: SQLite catalogs and spreadsheets, both by the standard library."""

from __future__ import annotations

import functools
import re
import sqlite3
import string
import xml.etree.ElementTree as ET
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROWS = 50_000


class SqliteTable(DataSource):
    """One table of a SQLite file. Options: path, dbtable. Row id ranges are partitions, read side by side and read-only."""

    @classmethod
    def name(cls) -> str:
        return "ephyra_sqlite"

    def _open(self):
        return sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)

    def schema(self) -> str:
        kinds = {"INT": "bigint", "REA": "double", "FLO": "double", "DOU": "double", "BOO": "boolean", "BLO": "binary"}
        with self._open() as con:
            cols = con.execute(f"PRAGMA table_info('{_identifier(self.options['dbtable'])}')").fetchall()
        if not cols:
            raise ValueError(f"no table {self.options['dbtable']}")
        return ", ".join(f"`{c[1]}` {kinds.get((c[2] or '').upper()[:3], 'string')}" for c in cols)

    def reader(self, schema) -> DataSourceReader:
        return _SqliteReader(dict(self.options), schema)


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


def _identifier(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z_]\w*", name):
        raise ValueError(f"not a table's name: {name!r}")
    return name


class _SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path, self.table, self.schema = options["path"], _identifier(options["dbtable"]), schema

    def partitions(self):
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {self.table}").fetchone()
        return [_Range(a, a + ROWS) for a in range(low, high + 1, ROWS)] if low is not None else [_Range(0, 0)]

    def read(self, part):
        kinds = [f.dataType.typeName() for f in self.schema.fields]
        cast = {"long": int, "double": float, "boolean": bool, "string": str}
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            for row in con.execute(f"SELECT * FROM {self.table} WHERE rowid >= ? AND rowid < ?", (part.low, part.high)):
                yield tuple(v if v is None or k == "binary" else cast[k](v) for v, k in zip(row, kinds))


class Workbook(DataSource):
    """All filled cells of an .xlsx file: (sheet, row, col, text). Option: path. A sheet is a partition."""

    @classmethod
    def name(cls) -> str:
        return "ephyra_xlsx"

    def schema(self) -> str:
        return "sheet string, row int, col int, text string"

    def reader(self, schema) -> DataSourceReader:
        return _WorkbookReader(self.options["path"])


class _Sheet(InputPartition):
    def __init__(self, name: str, member: str):
        self.name, self.member = name, member


#: Fixed values of the file format: namespaces and members.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
STRINGS, BOOK, LINKS = "xl/sharedStrings.xml", "xl/workbook.xml", "xl/_rels/workbook.xml.rels"


class _Strings:
    """The table of shared strings, read once as events; each is the text of its runs, without phonetic hints."""

    def __init__(self, archive: zipfile.ZipFile):
        self.held: list[str] = []
        if STRINGS not in archive.NameToInfo:
            return
        with archive.open(STRINGS) as f:
            for _, e in ET.iterparse(f):
                if e.tag == MAIN + "rPh":
                    e.clear()
                elif e.tag == MAIN + "si":
                    self.held.append("".join(x.text or "" for x in e.iter() if x.tag == MAIN + "t"))
                    e.clear()


def _column(reference: str) -> int:
    """The number from 0 of a cell reference's column: its letters are digits from 1 to 26."""
    return functools.reduce(lambda n, c: 26 * n + string.ascii_uppercase.index(c) + 1, reference.rstrip(string.digits), 0) - 1


class _WorkbookReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        with zipfile.ZipFile(self.path) as z:
            targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read(LINKS))}
            sheets = list(ET.fromstring(z.read(BOOK)).iter(MAIN + "sheet"))
        return [_Sheet(s.get("name"), "xl/" + targets[s.get(REL)].removeprefix("/xl/")) for s in sheets]

    def read(self, part):
        """Cells as the parser meets them: a sheet is never held whole."""
        with zipfile.ZipFile(self.path) as z:
            shared, row = _Strings(z).held, 0
            with z.open(part.member) as f:
                for event, e in ET.iterparse(f, ("start", "end")):
                    if event == "start":
                        if e.tag == MAIN + "row":
                            row = int(e.get("r", row + 1))
                        continue
                    if e.tag == MAIN + "c":
                        text = self._text(e, shared)
                        if text:
                            yield part.name, row, _column(e.get("r")), text
                        e.clear()
                    elif e.tag == MAIN + "row":
                        e.clear()

    @staticmethod
    def _text(cell, shared: list[str]) -> str | None:
        inside = {x.tag.removeprefix(MAIN): x for x in cell}
        if cell.get("t") == "inlineStr":
            return "".join(inside["is"].itertext()) if "is" in inside else None
        value = inside["v"].text if "v" in inside else None
        return shared[int(value)] if value is not None and cell.get("t") == "s" else value


def sqlite_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    spark.dataSource.register(SqliteTable)
    return spark.read.format("ephyra_sqlite").option("path", path).option("dbtable", name).load()


def workbook(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(Workbook)
    return spark.read.format("ephyra_xlsx").option("path", path).load()


def wide(cells: DataFrame, sheet: str, columns: dict[str, int]) -> DataFrame:
    """(row, one column for each name) of a sheet."""
    from pyspark.sql import functions as F

    return cells.where(F.col("sheet") == sheet).groupBy("row").agg(*[F.max(F.when(F.col("col") == i, F.col("text"))).alias(n) for n, i in columns.items()])
