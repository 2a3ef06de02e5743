"""Documents from files: text, Markdown, Word and PDF, by extension."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracol.functions.text import filename_key, trimmed

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(data: bytes) -> str:
    """Paragraphs of a Word file, one a line."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in body.iter(f"{_W}p"))


def pdf_text(data: bytes) -> str:
    """Texts of the pages that have any; needs pypdf."""
    from pypdf import PdfReader

    pages = (p.extract_text() for p in PdfReader(io.BytesIO(data)).pages)
    return "\n".join(p for p in pages if p)


def text_of(name: str, data: bytes, strict: bool = False) -> str:
    """Text of a file by its extension. Unknown ones are read as UTF-8, or refused if strict."""
    low = name.lower()
    if low.endswith(".pdf"):
        return pdf_text(data)
    if low.endswith(".docx"):
        return docx_text(data)
    if strict and not low.endswith((".txt", ".md")):
        raise ValueError(f"no reader for {name}")
    return data.decode("utf-8")


def read_files(spark: SparkSession, path: str, most_bytes: int | None = None, on_error: str = "skip") -> DataFrame:
    """path, key, text, error of each file under a path (or glob).

    Files over most_bytes are left out before they are read. A file that can't be read has a null text and an
    error, or stops the run with on_error="raise".
    """
    files = spark.read.format("binaryFile").load(path)
    if most_bytes is not None:
        files = files.where(F.col("length") <= most_bytes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, errors = [], []
            for name, data in zip(frame.path, frame.content, strict=True):
                try:
                    texts.append(text_of(name, bytes(data)))
                    errors.append(None)
                except Exception as error:
                    if on_error == "raise":
                        raise
                    texts.append(None)
                    errors.append(type(error).__name__)
            yield pd.DataFrame({"path": frame.path, "text": texts, "error": errors})

    rows = files.select("path", "content").mapInPandas(run, "path string, text string, error string")
    return rows.select("path", filename_key(F.col("path")).alias("key"), "text", "error")


def ingest(files: DataFrame, session_id: str) -> DataFrame:
    """Reference chunks of readable, non-blank files: session_id, key, chunk_index, chunk."""
    from veracol.operators.retrieval import chunked

    rows = files.where("text IS NOT NULL").where(trimmed(F.col("text")) != "")
    return chunked(rows, "key", "text").select(F.lit(session_id).alias("session_id"), "key", "chunk_index", "chunk")


def merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows but for those whose keys come anew, and the new ones."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)
