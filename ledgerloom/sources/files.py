"""File discovery, format identification and dispatch to readers."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 500 * 1024 * 1024
#: Limits of archives: bytes when unpacked, ratio to the packed size, members.
ZIP_BYTES, ZIP_RATIO, ZIP_MEMBERS = 1 << 30, 200, 10_000
IGNORED = r"(^|/)(\.|~\$|Thumbs\.db|desktop\.ini)|\.(tmp|part|crdownload)$"


def discover(spark: SparkSession, path: str, recursive: bool = True, glob: str | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Files under ``path`` as (path, length, content, fingerprint, format): no hidden, temporary or oversized ones, each once."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path).where((F.col("length") <= max_bytes) & ~F.regexp_extract("path", r"([^/]+)$", 1).rlike(IGNORED)).dropDuplicates(["path"])
    return files.select("path", "length", "content", F.substring(F.sha2("content", 256), 1, 12).alias("fingerprint"), identify(F.col("content")).alias("format"))


def identify(content: Column) -> Column:
    """The format that the first bytes show; names and extensions play no part."""
    head = F.substring(content, 1, 1024)
    h = F.hex(F.substring(content, 1, 12))
    text = F.decode(head, "ISO-8859-1")
    low = F.lower(text)
    lines = F.filter(F.slice(F.split(text, r"\r?\n"), 1, 10), lambda x: F.trim(x) != "")
    # the same number of separators on each of the first lines
    constant = lambda s: (F.size(lines) >= 2) & (F.size(F.array_distinct(F.transform(lines, lambda x: F.regexp_count(x, F.lit(s))))) == 1) & (F.regexp_count(lines[0], F.lit(s)) > 0)
    printable = F.length(F.regexp_replace(text, r"[^\x09\x0A\x0D\x20-\x7E\x80-\xFF]", "")) / F.length(text)
    return (
        F.when(F.length(content) == 0, "empty")
        .when(F.instr(text, "%PDF-") > 0, "pdf")
        .when(h.startswith("89504E470D0A1A0A"), "png").when(h.startswith("FFD8FF"), "jpeg")
        .when(h.startswith("49492A00") | h.startswith("4D4D002A"), "tiff").when(h.startswith("424D"), "bmp")
        .when(h.startswith("52494646") & h.endswith("57454250"), "webp")
        .when(h.startswith("D0CF11E0A1B11AE1"), "ole").when(h.startswith("0908"), "xls")
        .when(h.startswith("504B0304"), F.when(F.instr(F.decode(content, "ISO-8859-1"), "xl/workbook") > 0, "xlsx").when(F.instr(F.decode(content, "ISO-8859-1"), "word/document") > 0, "docx").when(F.instr(F.decode(content, "ISO-8859-1"), "ppt/") > 0, "pptx").otherwise("zip"))
        .when(F.startswith(text, F.lit("{\\rtf")), "rtf")
        .when(low.contains("urn:schemas-microsoft-com:office:spreadsheet"), "spreadsheetml")
        .when(low.rlike(r"^\s*(<!doctype html|<html|<table|<body|<head)"), "html")
        .when(low.rlike(r"^\s*<\?xml"), "xml")
        .when(printable < 0.85, "binary")
        .when(constant(",") | constant("\t") | constant(";") | constant(r"\|"), "csv")
        .otherwise("text")
    )


def open_zip(data: bytes) -> zipfile.ZipFile:
    """An archive within the limits; others are refused before anything is unpacked."""
    if len(data) > MAX_BYTES:
        raise ValueError("the archive is too large")
    z = zipfile.ZipFile(io.BytesIO(data))
    infos = z.infolist()
    total = sum(i.file_size for i in infos)
    if len(infos) > ZIP_MEMBERS or total > ZIP_BYTES or total > ZIP_RATIO * max(len(data), 1):
        raise ValueError("the archive exceeds the limits")
    return z


def _tag(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def xlsx_rows(data: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """(sheet, row number, cells) of a workbook."""
    z = open_zip(data)
    names = set(z.namelist())
    shared = []
    if "xl/sharedStrings.xml" in names:
        for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")):
            shared.append("".join(t.text or "" for t in si.iter() if _tag(t) == "t"))
    book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    sheets = [e.get("name") or "" for e in book.iter() if _tag(e) == "sheet"]
    files = sorted((n for n in names if n.startswith("xl/worksheets/sheet")), key=lambda n: (len(n), n))
    for sheet, file in zip(sheets, files):
        for k, row in enumerate(e for e in ElementTree.fromstring(z.read(file)).iter() if _tag(e) == "row"):
            cells: list[str] = []
            for c in row:
                ref = "".join(ch for ch in c.get("r") or "" if ch.isalpha())
                at = 0
                for ch in ref:
                    at = at * 26 + ord(ch) - 64
                while ref and len(cells) < at - 1:
                    cells.append("")
                value = "".join(v.text or "" for v in c.iter() if _tag(v) in ("v", "t"))
                cells.append(shared[int(value)] if c.get("t") == "s" and value else value)
            yield sheet, k, cells


def docx_rows(data: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """(kind, number, parts): paragraphs and table rows of a document in order; a heading's kind is 'heading'."""
    body = ElementTree.fromstring(open_zip(data).read("word/document.xml"))
    text = lambda e: "".join(t.text or "" for t in e.iter() if _tag(t) == "t")
    n = 0

    def walk(e: ElementTree.Element) -> Iterator[tuple[str, int, list[str]]]:
        nonlocal n
        for x in e:
            if _tag(x) == "p":
                style = next((v for s in x.iter() if _tag(s) == "pStyle" for k, v in s.attrib.items() if k.endswith("val")), "").lower()
                if text(x).strip():
                    yield ("heading" if "heading" in style or "title" in style else "paragraph"), n, [text(x)]
                    n += 1
            elif _tag(x) == "tbl":
                for row in x:
                    if _tag(row) == "tr":
                        yield "row", n, [text(c) for c in row if _tag(c) == "tc"]
                        n += 1
            else:
                yield from walk(x)

    yield from walk(body)


def spreadsheetml_rows(data: bytes) -> Iterator[tuple[str, int, list[str]]]:
    root = ElementTree.fromstring(data)
    for sheet in (e for e in root.iter() if _tag(e) == "Worksheet"):
        name = next((v for k, v in sheet.attrib.items() if k.endswith("Name")), "")
        for k, row in enumerate(e for e in sheet.iter() if _tag(e) == "Row"):
            yield name, k, ["".join(d.text or "" for d in c.iter() if _tag(d) == "Data") for c in row if _tag(c) == "Cell"]


READERS = {"xlsx": xlsx_rows, "docx": docx_rows, "spreadsheetml": spreadsheetml_rows}


def read_office(files: DataFrame) -> DataFrame:
    """(path, part, row_no, cells, error) of workbooks and documents in ``files``, a frame as ``discover`` gives it; a file
    that can't be read gives one row with its error."""
    rows = files.where(F.col("format").isin(*READERS)).select("path", "format", "content")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for path, kind, data in zip(f["path"], f["format"], f["content"]):
                try:
                    out += [(path, part, n, cells, None) for part, n, cells in READERS[kind](bytes(data))]
                except Exception as e:  # a damaged file is a result, not a failure of the job
                    out.append((path, None, None, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(out, columns=["path", "part", "row_no", "cells", "error"])

    return rows.mapInPandas(work, "path string, part string, row_no int, cells array<string>, error string")
