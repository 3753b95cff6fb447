"""Queries of the training-data problems and, where SQL can express one, its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment as al
from . import boilerplate as bp
from . import encodings as en
from . import languages as lg
from . import leakage as lk
from . import packing as pk
from . import repeated_lines as rl
from . import residue as rs
from . import sentences as sn
from . import splitting as sp


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return rl.repeated_lines(_t(spark, d, "chunks"), exact=True).select(F.col("id").alias("chunk_id"), "line_no")


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    chunks = _t(spark, d, "chunks")
    return rl.without_lines(chunks, rl.repeated_lines(chunks, exact=True)).select(F.col("id").alias("chunk_id"), "text")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return sp.split_oversized(_t(spark, d, "chunks")).where("piece_no = 0").select(F.col("id").alias("chunk_id"))


def p2_chunk_pieces(spark: SparkSession, d: str) -> DataFrame:
    return sp.split_oversized(_t(spark, d, "chunks")).withColumnRenamed("id", "chunk_id")


def p2_text_pieces(spark: SparkSession, d: str) -> DataFrame:
    return sp.split_oversized(_t(spark, d, "extracted_texts"), "ext_id").withColumnRenamed("id", "ext_id")


def p2_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """The oversized chunks put together again from their pieces, overlaps left out: equal to their texts if no piece is wrong."""
    lap = sp.limit_of(F.col("source_type"), 1)
    pieces_ = p2_chunk_pieces(spark, d).join(_t(spark, d, "chunks").select("chunk_id", lap.alias("lap"), sp.limit_of(F.col("source_type"), 0).alias("cap")), "chunk_id")
    own = F.when(F.col("piece_no") == 0, F.col("text")).otherwise(F.expr("substring(text, lap + 1)"))
    whole = pieces_.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("piece_no", own.alias("own")))).alias("p"), F.max(F.length("text") - F.col("cap")).alias("over"))
    return whole.select("chunk_id", F.array_join(F.transform("p", lambda x: x["own"]), "").alias("text"), (F.col("over") <= 0).alias("fits"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = al.aligned(_t(spark, d, "extracted_texts"))
    return found.withColumnsRenamed({"id_1": "ext_id_1", "id_2": "ext_id_2"})


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return rs.found(_t(spark, d, "extracted_texts"), _t(spark, d, "chunks"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return lg.unstated(lg.segments(_t(spark, d, "extracted_texts"))).withColumnRenamed("id", "ext_id")


def p5_segments(spark: SparkSession, d: str) -> DataFrame:
    return lg.segments(_t(spark, d, "extracted_texts")).drop("url").withColumnRenamed("id", "ext_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return sn.sentence_units(_t(spark, d, "extracted_texts")).select(F.col("id").alias("ext_id"), "start")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return bp.furniture_lines(_t(spark, d, "extracted_texts")).select(F.col("id").alias("ext_id"), "line_no")


def p7_bodies(spark: SparkSession, d: str) -> DataFrame:
    return bp.main_bodies(_t(spark, d, "extracted_texts")).select(F.col("id").alias("ext_id"), "body")


def p7_chunk_bodies(spark: SparkSession, d: str) -> DataFrame:
    return bp.main_bodies(_t(spark, d, "chunks"), "chunk_id").select(F.col("id").alias("chunk_id"), "body")


def p8_contexts(spark: SparkSession, d: str) -> DataFrame:
    return pk.pack(_t(spark, d, "documents")).withColumnRenamed("id", "doc_id")


def p8_cover(spark: SparkSession, d: str) -> DataFrame:
    """Characters of each text that stand in containers, each of which is within its capacity."""
    packed = pk.pack(_t(spark, d, "documents"))
    full = packed.groupBy("container").agg((F.sum("tokens") <= pk.CAPACITY).alias("fits"))
    return packed.join(full, "container").groupBy(F.col("id").alias("doc_id")).agg(F.sum(F.col("end") - F.col("start")).alias("chars"), F.bool_and("fits").alias("fits"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return lk.leaked(_t(spark, d, "documents"), _t(spark, d, "benchmark")).select("doc_id", "item_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return en.mended(_t(spark, d, "documents")).select(F.col("id").alias("doc_id"))


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return en.mended(_t(spark, d, "documents")).select(F.col("id").alias("doc_id"), "restored", "how")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1].isdigit() and callable(f)}


_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_NARROW = "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''")


_REPEATED = rf"""lines AS (
        SELECT chunk_id, url, category, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10)))))::INT AS line_no
        FROM chunks WHERE category IS NOT NULL AND text IS NOT NULL),
    worded AS (SELECT chunk_id, url, category, line_no, regexp_replace(lower(translate(line, '{_WIDE}', '{_NARROW}')), '[^\p{{L}}]', '', 'g') AS w FROM lines),
    pages AS (SELECT category, count(DISTINCT url) AS n FROM chunks WHERE category IS NOT NULL GROUP BY category),
    often AS (SELECT category, w, count(DISTINCT url) AS k FROM worded WHERE w <> '' GROUP BY category, w),
    repeated AS (SELECT chunk_id, line_no FROM worded JOIN often USING (category, w) JOIN pages USING (category) WHERE k >= 5 AND k >= 0.04 * n)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {_REPEATED} SELECT chunk_id, line_no FROM repeated",
        "p1_clean": f"""WITH {_REPEATED}, kept AS (SELECT chunk_id, string_agg(line, chr(10) ORDER BY line_no) AS t FROM (
                SELECT chunk_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10)))))::INT AS line_no FROM chunks WHERE text IS NOT NULL)
            ANTI JOIN repeated USING (chunk_id, line_no) GROUP BY chunk_id)
            SELECT chunk_id, CASE WHEN text IS NOT NULL THEN coalesce(t, '') END AS text FROM chunks LEFT JOIN kept USING (chunk_id)""",
        "p2_rejoined": "SELECT chunk_id, text, true AS fits FROM chunks WHERE length(text) > CASE WHEN lower(source_type) = 'pdf' THEN 2048 ELSE 800 END",
        "p8_cover": "SELECT doc_id, length(text) AS chars, true AS fits FROM documents WHERE length(text) > 0",
        "p2_found": "SELECT chunk_id FROM chunks WHERE length(text) > CASE WHEN lower(source_type) = 'pdf' THEN 2048 ELSE 800 END",
    }
