"""The jobs: extract, build chunks, build the index, retrieve, ask. Each is one lazy plan over many rows or questions."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import models
from ..functions.text import head
from ..operators import answer as an
from ..operators import manifest as mf
from ..operators.chunking import chunk_records
from ..operators.search import nearest, rerank
from ..schemas import CHUNK, DENSE_TOP_K, EXTRACTED
from ..sources.collection import Collection, points
from ..sources.files import file_texts, read_jsonl, stored_files, write_jsonl

#: Records of the jobs' files, with their row's place in the manifest.
_NUMBERED = T.StructType([T.StructField("ordinal", T.LongType()), *CHUNK.fields])
_NUMBERED_TEXT = T.StructType([T.StructField("ordinal", T.LongType()), *EXTRACTED.fields])


def stored_texts(spark: SparkSession, base: str) -> DataFrame:
    """``saved_path, text, error`` of all files under ``base``. Bytes are read and given up in one narrow stage; only texts go on."""
    return file_texts(stored_files(spark, base))


def build_chunks(spark: SparkSession, manifest: DataFrame, base: str, out: str) -> DataFrame:
    """From a manifest and its stored files to a chunk file; gives the one-row report. The file is read back for it, not made twice."""
    chunks = chunk_job(manifest, stored_texts(spark, base), "ordinal")
    write_jsonl(chunks, out, _NUMBERED)
    made = read_jsonl(spark, out, _NUMBERED).groupBy("ordinal").agg(F.count("*").alias("chunks"))
    return mf.build_report(manifest, made, "ordinal")


def extract_texts(spark: SparkSession, manifest: DataFrame, base: str, out: str) -> DataFrame:
    """From a manifest and its stored files to a file of extracted texts; gives the one-row report."""
    write_jsonl(extract_job(manifest, stored_texts(spark, base), "ordinal"), out, _NUMBERED_TEXT)
    return mf.extract_report(manifest, read_jsonl(spark, out, _NUMBERED_TEXT).select("ordinal").distinct(), "ordinal")


def samples(manifest: DataFrame, texts: DataFrame, n: int = 3, chars: int = 400) -> DataFrame:
    """``kind, url, chars, text``: the first ``n`` fetched rows of each kind, html and pdf by their raw type, that have text."""
    rows = manifest.where(mf.fetched() & F.col("type").isin("html", "pdf"))
    some = mf.with_files(rows, texts).where(F.coalesce("text", F.lit("")) != "")
    first = [some.where(F.col("type") == kind).orderBy("ordinal").limit(n) for kind in ("html", "pdf")]
    return first[0].unionByName(first[1]).select(F.upper("type").alias("kind"), "url", F.length("text").alias("chars"), head(F.col("text"), chars).alias("text"))


def extract_job(manifest: DataFrame, texts: DataFrame, *keep: str) -> DataFrame:
    """Extracted-text records of the manifest's rows whose stored file has text."""
    rows = mf.for_extraction(manifest, "saved_path", *keep)
    return mf.with_files(rows, texts).where(F.coalesce("text", F.lit("")) != "").select(*keep, *EXTRACTED.names)


def chunk_job(manifest: DataFrame, texts: DataFrame, *keep: str) -> DataFrame:
    """Chunks of the manifest's rows whose stored file has text. One join, then narrow."""
    rows = mf.for_chunks(manifest, "saved_path", *keep)
    with_text = mf.with_files(rows, texts).where(F.coalesce("text", F.lit("")) != "")
    meta = [n for n in CHUNK.names if n not in ("text", "chunk_index", "chunk_len")]
    return chunk_records(with_text, *keep, *meta)


def index_job(chunks: DataFrame, collection: Collection, embed: Callable[[Column], Column], reset: bool = False, stable_ids: bool = False) -> None:
    """Embeds chunks and appends them to a collection; text is mandatory."""
    collection.prepare(reset)
    embedded = chunks.where("text IS NOT NULL").withColumn("_dense", embed(F.col("text")))
    rows = points(embedded, F.col("_dense"), stable_ids=stable_ids)
    if stable_ids:
        collection.upsert_stable(rows)
    else:
        collection.upsert(rows)


HIT = ("text", "url", "title", "category", "source_type", "chunk_index")


def retrieve(questions: DataFrame, table: DataFrame, embed: Callable[[Column], Column] | None, score: Callable[[Column, Column], Column] = models.overlap_score, top_k: int = DENSE_TOP_K, top_n: int | None = None) -> DataFrame:
    """Contexts of ``(qid, query)`` from ``table`` (``point_id`` long, ``dense``, and the hit's fields): dense search, then rerank.

    Without ``embed`` the questions bring their vectors along (``dense``). The second score is computed only for rows
    the first search kept.
    """
    asked = questions.where(F.btrim("query") != "").select("qid", "query", (embed(F.col("query")) if embed else F.col("dense")).alias("dense"))
    found = nearest(table, asked, top_k, id_col="point_id")
    hits = found.join(table.select(F.col("point_id").alias("id"), *HIT), "id").join(questions.select("qid", "query"), "qid")
    best = rerank(hits, score(F.col("query"), F.col("text")), top_n)
    return best.select("qid", "query", "position", *HIT, "score", "rerank_score")


def ask(questions: DataFrame, table: DataFrame, embed: Callable[[Column], Column], score: Callable[[Column, Column], Column] = models.overlap_score, generate: Callable[[Column], Column] | None = None, top_n: int | None = None) -> DataFrame:
    """Answers of ``(qid, query)`` with their sources and contexts; without a generator the stand-in answers."""
    contexts = retrieve(questions, table, embed, score, top_n=top_n)
    return an.answered(questions, contexts, models.extractive_answer(F.col("context")), generate)


def local_embedding(dim: int = models.DENSE_DIM) -> Callable[[Column], Column]:
    return models.embedding(partial(models.HashedNgrams, dim))


def searchable(collection: Collection) -> DataFrame:
    """A collection's points with integer ids, as ``retrieve`` reads them."""
    return collection.read().select(F.xxhash64("id").alias("point_id"), "dense", *(F.col(f"payload.{c}").alias(c) for c in HIT))


def questions_of(spark: SparkSession, *texts: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts)), "qid long, query string")
