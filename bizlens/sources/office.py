"""Office documents -> rows (S7, re-aimed as a corpus job).

``binaryFile`` lists the files; ``mapInPandas`` opens each one with the
standard library (``zipfile`` + XML) and emits one row per non-empty unit:
Word paragraphs, slide text frames, spreadsheet rows of the first sheet.
Files are distributed across tasks; one file is the unit of work.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"

SCHEMA = "path string, kind string, unit long, text string"


def _docx(z: zipfile.ZipFile):
    root = ET.fromstring(z.read("word/document.xml"))
    for p in root.iter(f"{_W}p"):
        text = "".join(t.text or "" for t in p.iter(f"{_W}t")).strip()
        if text:
            yield text


def _pptx(z: zipfile.ZipFile):
    slides = sorted((n for n in z.namelist() if re.match(r"ppt/slides/slide\d+\.xml$", n)),
                    key=lambda n: int(re.findall(r"\d+", n)[-1]))
    for name in slides:
        root = ET.fromstring(z.read(name))
        for para in root.iter(f"{_A}p"):
            text = "".join(t.text or "" for t in para.iter(f"{_A}t")).strip()
            if text:
                yield text


def _xlsx(z: zipfile.ZipFile):
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        sroot = ET.fromstring(z.read("xl/sharedStrings.xml"))
        shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in sroot.iter(f"{_S}si")]
    sheets = sorted(n for n in z.namelist() if re.match(r"xl/worksheets/sheet\d+\.xml$", n))
    if not sheets:
        return
    root = ET.fromstring(z.read(sheets[0]))
    for row in root.iter(f"{_S}row"):
        cells = []
        for c in row.iter(f"{_S}c"):
            v = c.find(f"{_S}v")
            val = v.text if v is not None else ""
            if c.get("t") == "s" and val:
                val = shared[int(val)]
            cells.append(val or "")
        line = "\t".join(cells).strip()
        if line:
            yield line


_PARSERS = {"docx": _docx, "pptx": _pptx, "xlsx": _xlsx}


def _extract(it):
    for pdf in it:
        rows = []
        for path, content in zip(pdf["path"], pdf["content"]):
            kind = path.rsplit(".", 1)[-1].lower()
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for i, text in enumerate(_PARSERS[kind](z)):
                        rows.append((path, kind, i, text))
            except (zipfile.BadZipFile, KeyError, ET.ParseError):
                continue
        yield pd.DataFrame(rows, columns=["path", "kind", "unit", "text"])


def read_office(spark: SparkSession, path: str) -> DataFrame:
    """One text row per paragraph / text frame / sheet row of every matched file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{docx,pptx,xlsx}").load(path) \
        if not path.endswith((".docx", ".pptx", ".xlsx")) else spark.read.format("binaryFile").load(path)
    return files.select("path", "content").mapInPandas(_extract, SCHEMA)
