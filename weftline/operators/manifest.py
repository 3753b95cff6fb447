"""Crawl manifest: filters, type resolution, projections, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_pdf, or_default, title_from_url


def fetched() -> Column:
    """Fetched and stored: status ``ok`` and a path that is neither null nor empty."""
    return (or_default(F.col("status"), "") == "ok") & (or_default(F.col("saved_path"), "") != "")


def chunk_type() -> Column:
    """Kind of source for the chunk job: a document must be a pdf file, any other type stays; null drops the row."""
    t = or_default(F.col("type"), "")
    return F.when(t != "document", t).when(is_pdf(F.col("saved_path")), F.lit("pdf"))


def extract_type() -> Column:
    """Kind of source for the extraction job: html pages and documents that are pdf files, nothing else."""
    return F.when(F.col("type") == "html", F.lit("html")).when((F.col("type") == "document") & is_pdf(F.col("saved_path")), F.lit("pdf"))


def metadata(kind: Column) -> list[Column]:
    """The six metadata columns, with defaults."""
    url = or_default(F.col("url"), "")
    return [url.alias("url"), title_from_url(url).alias("title"), or_default(F.col("depth"), 0).alias("depth"), kind.alias("source_type"), or_default(F.col("category"), "").alias("category"), or_default(F.col("fetched_at"), "").alias("fetched_at")]


def first_rows(df: DataFrame, ordinal: str, n: int = 20) -> DataFrame:
    """The first ``n`` rows by file order, before any filter."""
    return df.orderBy(ordinal).limit(n)


def for_chunks(manifest: DataFrame, *keep: str) -> DataFrame:
    """Rows of the chunk job: fetched, of a kind that can be chunked, with metadata."""
    return manifest.where(fetched()).withColumn("_kind", chunk_type()).where("_kind IS NOT NULL").select(*keep, *metadata(F.col("_kind")))


def for_extraction(manifest: DataFrame, *keep: str) -> DataFrame:
    """Rows of the extraction job."""
    return manifest.where(fetched()).withColumn("_kind", extract_type()).where("_kind IS NOT NULL").select(*keep, *metadata(F.col("_kind")))


def with_files(rows: DataFrame, files: DataFrame, key: str = "saved_path") -> DataFrame:
    """Rows whose stored file exists, with its columns."""
    return rows.join(files, key, "inner")


def build_report(manifest: DataFrame, chunks_of: DataFrame, key: str) -> DataFrame:
    """One row: what the chunk job did. ``chunks_of``: ``key, chunks`` of every row that gave chunks.

    Rows that gave chunks are processed; they count as html or pdf by their raw type. A skipped row counts as failed,
    office or, for any other reason, empty.
    """
    rows = manifest.join(chunks_of, key, "left")
    made = or_default(F.col("chunks"), 0) > 0
    raw = or_default(F.col("type"), "")
    failed = ~fetched()
    office = fetched() & (raw == "document") & ~is_pdf(F.col("saved_path"))
    n = lambda c: F.count_if(c)
    return rows.agg(n(made).alias("processed"), n(made & (raw == "html")).alias("html"), n(made & (raw == "document")).alias("pdf"), n(~made).alias("skipped"), n(failed).alias("failed"), n(office).alias("office"), n(~made & ~failed & ~office).alias("empty"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("total_chunks"))


def extract_report(manifest: DataFrame, texts_of: DataFrame, key: str) -> DataFrame:
    """One row: what the extraction job did; ``total``: rows that gave text. ``texts_of``: ``key`` of every row with text."""
    rows = manifest.join(texts_of.select(key, F.lit(True).alias("_has")), key, "left")
    has = F.coalesce(F.col("_has"), F.lit(False)) & fetched() & extract_type().isNotNull()
    return rows.agg(F.count_if(has).alias("total"), F.count_if(has & (extract_type() == "html")).alias("html"), F.count_if(has & (extract_type() == "pdf")).alias("pdf"), F.count_if(~has).alias("skipped"))
