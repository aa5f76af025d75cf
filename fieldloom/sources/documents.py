"""Documents as text: plain files, web pages and word-processor files of a folder, read in parallel."""

from __future__ import annotations

import html
import io
import re
import unicodedata
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Elements of a page that end a line, and those whose content isn't text.
_LINES = re.compile(r"(?i)<br\s*/?>|</(?:p|div|li|ul|ol|tr|h[1-6]|table|section|article|dt|dd)\s*>")
_HIDDEN = re.compile(r"(?is)<(script|style|head|noscript)\b.*?</\1\s*>|<!--.*?-->")
_CELLS = re.compile(r"(?i)</t[dh]\s*>")
_TAGS = re.compile(r"<[^>]*>")
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def decoded(data: bytes) -> str:
    """UTF-8 with or without its mark, UTF-16 by its mark, else Western European."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace")
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("cp1252", "replace")


def normalized(text: str) -> str:
    """Composed letters, plain line ends and blanks, no more than one empty line in a row."""
    t = unicodedata.normalize("NFC", text).replace("\r\n", "\n").replace("\r", "\n").replace(" ", " ")
    t = "\n".join(re.sub(r"[ \t\f\v]+", " ", line).strip() for line in t.split("\n"))
    return re.sub(r"\n{3,}", "\n\n", t).strip()


def page_text(page: str) -> str:
    """The text of a web page; rows of a table are lines with bars between their cells."""
    t = _HIDDEN.sub(" ", page)
    t = _CELLS.sub(" | ", t)
    t = _LINES.sub("\n", t)
    t = normalized(html.unescape(_TAGS.sub("", t)))
    return re.sub(r"(?m) ?\| ?$", "", t)


def word_text(data: bytes) -> str:
    """Paragraphs and tables of a word-processor file (Office Open XML), a table's row as one line with bars."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_WORD}body")
    flat = lambda e: "".join(t.text or "" if t.tag == f"{_WORD}t" else "\t" if t.tag == f"{_WORD}tab" else "\n" if t.tag == f"{_WORD}br" else "" for t in e.iter())
    lines = []
    for e in body if body is not None else []:
        if e.tag == f"{_WORD}p":
            lines.append(flat(e))
        elif e.tag == f"{_WORD}tbl":
            lines += [" | ".join(" ".join(flat(c).split()) for c in row.findall(f"{_WORD}tc")) for row in e.iter(f"{_WORD}tr")]
    return normalized("\n".join(lines))


def text_of(name: str, data: bytes) -> tuple[str | None, str | None]:
    """(text, error) of a file by its ending and its first signs."""
    try:
        if data[:4] == b"PK\x03\x04" and name.lower().endswith(".docx"):
            return word_text(data), None
        if data[:5] == b"%PDF-":
            return None, "no reader for PDF"
        t = decoded(data)
        if name.lower().endswith((".html", ".htm", ".xhtml")) or re.match(r"\s*(?:<!doctype html|<html)", t, re.I):
            return page_text(t), None
        return (None, "binary file") if "\0" in t[:1000] else (normalized(t), None)
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        return None, f"broken file: {type(e).__name__}"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, error): the text of every file under ``path``; files without a reader say why. Empty files give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column(0).to_pylist()
            got = [text_of(n, d) for n, d in zip(names, b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for t, _ in got], pa.string()), pa.array([e for _, e in got], pa.string())], names=["path", "text", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, "path string, text string, error string")
