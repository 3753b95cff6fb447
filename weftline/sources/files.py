"""Manifest, JSON Lines and page-text sources and sinks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import join_pages, pdf_text
from ..schemas import CHUNK, EXTRACTED, MANIFEST, MIN_PDF_TEXT
from .html import extract
from .pdf import PdfError, page_texts


class MissingInput(FileNotFoundError):
    """The input a job starts from is not there."""


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest as rows, with ``ordinal``, which follows the order of the file (from 0 in a file that is read by one task).

    A JSON array is parsed as a stream, a file by one task; ``*.jsonl`` (one record a line) is split over many tasks. A
    malformed file or a field of the wrong type fails the job.
    """
    lines = path.rstrip("/").endswith((".jsonl", ".ndjson"))
    try:
        rows = spark.read.schema(MANIFEST).option("mode", "FAILFAST").option("multiLine", not lines).json(path)
    except AnalysisException as e:
        raise MissingInput(path) from e
    return rows.select(F.monotonically_increasing_id().alias("ordinal"), "*")


def read_jsonl(spark: SparkSession, path: str, schema: StructType = CHUNK) -> DataFrame:
    """JSON Lines; blank lines are skipped, a malformed line fails the job."""
    try:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    except AnalysisException as e:
        raise MissingInput(path) from e


def write_jsonl(df: DataFrame, path: str, schema: StructType = CHUNK) -> None:
    """Overwrites JSON Lines in UTF-8; text is not escaped and nulls are written."""
    df.select(*schema.names).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_extracted(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, EXTRACTED)


def pdf_texts(pages: DataFrame) -> DataFrame:
    """``path, text`` from page texts ``(path, page_no, text)``: pages in order; a scan gives an empty text."""
    grouped = pages.groupBy("path").agg(F.collect_list(F.struct("page_no", "text")).alias("pages"))
    return grouped.select("path", pdf_text(join_pages(F.col("pages")), MIN_PDF_TEXT).alias("text"))


def stored_files(spark: SparkSession, base: str) -> DataFrame:
    """``saved_path, content``: the bytes of every file under ``base``, by its path from there."""
    root = _uri(spark, base)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    return files.select(F.expr(f"substring(path, {len(root) + 1})").alias("saved_path"), "content")


def _uri(spark: SparkSession, base: str) -> str:
    """The path as the file scan spells it, with a slash at its end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/") + "/"


def file_texts(files: DataFrame) -> DataFrame:
    """``saved_path, text, error`` of stored files: pdf files by their first bytes, anything else as html. A narrow stage.

    A file that cannot be read has an empty text and the reason in ``error``; the others have none.
    """
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, raw in zip(b["saved_path"], b["content"], strict=True):
                try:
                    rows.append((path, text_of_pages(page_texts(raw)) if raw[:5] == b"%PDF-" else extract(raw), None))
                except PdfError as e:
                    rows.append((path, "", str(e)))
            yield pd.DataFrame(rows, columns=["saved_path", "text", "error"])

    return files.mapInPandas(read, "saved_path string, text string, error string")


def pdf_pages(files: DataFrame) -> DataFrame:
    """``path, page_no, text, error`` of each page of pdf files ``(path, content)``; a file that cannot be read gives one row with ``error``."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for path, raw in zip(b["path"], b["content"], strict=True):
                try:
                    rows += [(path, n, t, None) for n, t in enumerate(page_texts(raw), 1)]
                except PdfError as e:
                    rows.append((path, None, None, str(e)))
            yield pd.DataFrame({"path": [r[0] for r in rows], "page_no": pd.array([r[1] for r in rows], dtype="Int32"), "text": [r[2] for r in rows], "error": [r[3] for r in rows]})

    return files.mapInPandas(read, "path string, page_no int, text string, error string")


def text_of_pages(pages: list[str]) -> str:
    """The text of a file from its pages: joined by blank lines; too short a text means a scan and gives nothing."""
    joined = "\n\n".join(p.strip() for p in pages if p)
    return re.sub(r"\n{3,}", "\n\n", joined).strip() if len(joined) >= MIN_PDF_TEXT else ""
