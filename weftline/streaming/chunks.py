"""The row-wise part of the chunk job under a stream. An addition: the same expressions, nothing stateful."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import chunk_records
from ..schemas import CHUNK

_META = [n for n in CHUNK.names if n not in ("text", "chunk_index", "chunk_len")]


def chunk_stream(records: DataFrame) -> DataFrame:
    """Chunks of a stream of records with metadata and text."""
    return chunk_records(records, *_META)


def write_chunks(chunks: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends chunks as parquet, exactly once, and stops when the input at hand is done."""
    return chunks.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
