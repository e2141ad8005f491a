"""Texts and pages of files. Nothing raises on a bad file: its row has an error."""

from __future__ import annotations

import io
import os
import unicodedata
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SCHEMA = "filename string, path string, text string, page_texts array<struct<page int, text string>>, error string"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def pdf_pages(data: bytes) -> list[str]:
    try:
        from pypdf import PdfReader
    except ImportError:
        from PyPDF2 import PdfReader
    return [page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages]


def docx_paragraphs(data: bytes) -> list[str]:
    """Body paragraphs of a docx file, with tabs and line breaks as such."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_WORD}body")
    marks = {f"{_WORD}tab": "\t", f"{_WORD}br": "\n", f"{_WORD}cr": "\n"}
    return ["".join(x.text or "" if x.tag == f"{_WORD}t" else marks.get(x.tag, "") for x in p.iter()) for p in body.findall(f"{_WORD}p")]


def plain_text(data: bytes) -> str:
    return data.decode("utf-8").replace("\r\n", "\n").replace("\r", "\n")


def extract(name: str, data: bytes) -> tuple[str, list[tuple[int, str]], str | None]:
    """(text, pages, error) in lower case. Pages without text are left out and keep their numbers."""
    kind = os.path.splitext(name)[1].lower()
    try:
        if kind == ".pdf":
            found = pdf_pages(data)
            return "".join(f"{t} " for t in found if t).lower(), [(k, t.lower()) for k, t in enumerate(found, 1) if t], None
        if kind == ".docx":
            found = docx_paragraphs(data)
            text, page = "".join(f"{t} " for t in found), "\n".join(found)
        elif kind == ".txt":
            text = page = plain_text(data)
        else:
            return "", [], "unsupported type"
        return text.lower(), [(1, page.lower())] if page.strip() else [], None
    except Exception as e:  # any damage a file can have
        return "", [], f"{type(e).__name__}: {e}"


def scan_folder(spark: SparkSession, folder: str) -> DataFrame:
    """The pdf, docx and txt files right in a folder, extracted in Arrow batches on the executors."""
    return _extracted(spark.read.format("binaryFile").load(folder).where(F.col("path").rlike(r"(?i)\.(pdf|docx|txt)$")))


def scan_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The files at these paths, extracted on the executors; doc_seq says where a path stands in the list."""
    rows = _extracted(spark.read.format("binaryFile").load(paths))
    places = F.create_map(*[F.lit(x) for k, p in enumerate(paths) for x in (os.path.basename(p), k)])
    return rows.withColumn("doc_seq", F.try_element_at(places, "filename").cast("long"))


def _extracted(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, data in zip(batch["path"], batch["content"], strict=True):
                name = path.rsplit("/", 1)[-1]
                text, pages, error = extract(name, bytes(data))
                rows.append((name, path, text, [{"page": k, "text": t} for k, t in pages], error))
            yield pd.DataFrame(rows, columns=["filename", "path", "text", "page_texts", "error"])

    return files.select("path", "content").mapInPandas(run, SCHEMA).withColumn("doc_seq", F.xxhash64("filename"))


@F.pandas_udf(StringType())
def _ascii(names: pd.Series) -> pd.Series:
    return names.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


def sanitised(c: Column) -> Column:
    """A safe file name: what follows the last slash, in plain ASCII letters, digits and _.-; empty if it isn't a supported type."""
    base = F.regexp_extract(c, r"([^/]*)$", 1)
    plain = F.regexp_replace(F.trim(F.regexp_replace(_ascii(base), r"[\t-\r\x1c-\x20]+", " ")), " ", "_")
    clean = F.regexp_replace(F.regexp_replace(plain, r"[^A-Za-z0-9_.-]", ""), r"^[._]+|[._]+$", "")
    return F.when(clean.rlike(r"(?i).\.(pdf|docx|txt)$"), clean).otherwise("")


def inside(folder: str, filename: str) -> str | None:
    """The real path of a file in a folder, or None if the name leads out of it."""
    base = os.path.realpath(folder)
    path = os.path.realpath(os.path.join(base, os.path.basename(filename)))
    return path if path != base and os.path.commonpath([base, path]) == base else None
