"""Office documents and landed files.

Files are read by Spark's ``binaryFile`` source, so they are split over the
executors; the text of a DOCX comes from its XML by the standard library.
"""

from __future__ import annotations

import io
import unicodedata
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
PDF = "application/pdf"
#: Largest file that is opened.
MOST_BYTES = 10 * 1024 * 1024
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, modificationTime, length, content of each file under path."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """path, content: one row for each text file, read whole."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))


def _paragraph(p: ElementTree.Element) -> str:
    parts = []
    for e in p.iter():
        if e.tag == _W + "t":
            parts.append(e.text or "")
        elif e.tag == _W + "tab":
            parts.append("\t")
        elif e.tag in (_W + "br", _W + "cr"):
            parts.append("\n")
    return "".join(parts).strip()


def _blocks(root: ElementTree.Element) -> Iterator[str]:
    for e in root:
        if e.tag == _W + "p":
            yield _paragraph(e)
        elif e.tag == _W + "tbl":
            for row in e.iter(_W + "tr"):
                cells: dict[str, str] = {}
                for cell in row.findall(_W + "tc"):
                    text = " ".join(" ".join(_paragraph(p) for p in cell.iter(_W + "p")).split())
                    if text:
                        cells.setdefault(text.casefold(), text)
                yield " | ".join(cells.values())


# Parts that every DOCX has.
REQUIRED = ("[Content_Types].xml", "word/document.xml")


def docx_text(content: bytes) -> str:
    """Headers and footers, then paragraphs and table rows in order; cells of a row joined, equal ones once."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        parts = [n for n in sorted(names) if n.startswith(("word/header", "word/footer")) and n.endswith(".xml")]
        lines = [t for n in parts for t in _blocks(ElementTree.fromstring(z.read(n))) if t]
        body = ElementTree.fromstring(z.read("word/document.xml")).find(_W + "body")
        lines += [t for t in _blocks(body if body is not None else ElementTree.Element("x")) if t]
    return "\n".join(lines)


def file_text(content: Column, mime: Column) -> Column:
    """Struct of text and error (a code; never part of the content). Without a PDF reader PDFs have the error no_reader."""

    @F.pandas_udf("text string, error string")
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for contents, kinds in batches:
            rows = []
            for c, k in zip(contents, kinds):
                if not c:
                    rows.append((None, "empty"))
                elif len(c) > MOST_BYTES:
                    rows.append((None, "too_large"))
                elif k == DOCX:
                    try:
                        text = docx_text(c)
                        rows.append((text, None) if text.strip() else (None, "no_text"))
                    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                        rows.append((None, "broken"))
                elif k == PDF:
                    rows.append((None, "no_reader" if b"%PDF-" in c[:1024] else "broken"))
                else:
                    rows.append((None, "unknown_type"))
            yield pd.DataFrame(rows, columns=["text", "error"])

    return read(content, mime)


def file_issue(name: Column, content: Column, mime: Column) -> Column:
    """Why a file is not taken in, null if it is: no_name, empty, too_large, unknown_type, not_pdf, not_docx.

    The name is read in its compatibility form and must have a printable character; a PDF begins as one, a DOCX is a
    ZIP that has the parts that every one has.
    """

    @F.pandas_udf("string")
    def check(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for names, contents, kinds in batches:
            yield pd.Series([_issue(n, c, k) for n, c, k in zip(names, contents, kinds)], dtype=object)

    return check(name, content, mime)


def _issue(name: str | None, content: bytes | None, kind: str | None) -> str | None:
    if not any(c.isprintable() and not c.isspace() for c in unicodedata.normalize("NFKC", name or "")):
        return "no_name"
    if not content:
        return "empty"
    if len(content) > MOST_BYTES:
        return "too_large"
    if kind == PDF:
        return None if content.startswith(b"%PDF-") else "not_pdf"
    if kind == DOCX:
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                return None if set(REQUIRED) <= set(z.namelist()) else "not_docx"
        except zipfile.BadZipFile:
            return "not_docx"
    return "unknown_type"


def safe_file_name(name: Column) -> Column:
    """The last part of a path without control characters, at most 255 code points; null if nothing is left."""
    last = F.regexp_replace(name, r"^.*[/\\]", "")
    return F.nullif(F.substring(F.trim(F.regexp_replace(last, r"[\x00-\x1f\x7f]", "")), 1, 255), F.lit(""))


def storage_path(owner: Column, key: Column, mime: Column) -> Column:
    return F.concat(owner, F.lit("/"), key, F.when(mime == PDF, ".pdf").when(mime == DOCX, ".docx").otherwise(""))
