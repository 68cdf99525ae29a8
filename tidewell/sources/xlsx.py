"""Sheets of XLSX workbooks, read by one task each without a library: a workbook is a zip archive of XML parts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

#: Name spaces of the parts.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def column_number(reference: str) -> int:
    """Place of a cell such as AB12 in its row, from 0."""
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def rows_of(file, sheet: int = 0) -> Iterator[list[str | None]]:
    """Rows of a sheet as strings, streamed; cells that are not there are null."""
    import posixpath
    import zipfile
    from xml.etree import ElementTree as X

    with zipfile.ZipFile(file) as z:
        book = X.fromstring(z.read("xl/workbook.xml"))
        links = {r.get("Id"): r.get("Target") for r in X.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = links[book.find(f"{_MAIN}sheets")[sheet].get(f"{_REL}id")]
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in X.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        with z.open(target.lstrip("/") if target.startswith("/") else posixpath.join("xl", target)) as part:
            for _, row in X.iterparse(part):
                if row.tag != f"{_MAIN}row":
                    continue
                out: list[str | None] = []
                for cell in row.iter(f"{_MAIN}c"):
                    at = column_number(cell.get("r")) if cell.get("r") else len(out)
                    out += [None] * (at + 1 - len(out))
                    value = cell.find(f"{_MAIN}v")
                    if cell.get("t") == "s":
                        out[at] = shared[int(value.text)]
                    elif cell.get("t") == "inlineStr":
                        out[at] = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
                    elif value is not None:
                        out[at] = value.text
                yield out
                row.clear()


def read_xlsx(spark: SparkSession, path: str, sheet: int = 0) -> DataFrame:
    """A sheet as strings under the names of its first row; the driver reads that row only, a task the rest."""
    import pyarrow.fs as pafs

    def opened():
        fs, at = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
        return fs.open_input_file(at)

    with opened() as f:
        first = next(rows_of(f, sheet), [])
    names = [n or f"c{i}" for i, n in enumerate(first)]
    if len(set(names)) != len(names):
        raise ValueError(f"columns share a name: {names}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            with opened() as f:
                own: list[list] = []
                for i, row in enumerate(rows_of(f, sheet)):
                    if i:
                        own.append((row + [None] * len(names))[: len(names)])
                    if len(own) >= 5000:
                        yield pd.DataFrame(own, columns=names)
                        own = []
                yield pd.DataFrame(own, columns=names)

    return spark.range(0, 1, 1, 1).mapInPandas(run, StructType([StructField(n, StringType()) for n in names]))
