"""A vector collection as a table: create, drop, upsert, exists, statistics, read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import or_default
from ..functions.vectors import normalized
from ..schemas import PAYLOAD, POINT


def payload() -> list[Column]:
    """The nine payload fields with their defaults."""
    return [or_default(F.col(f.name), "" if f.dataType.typeName() == "string" else 0).cast(f.dataType).alias(f.name) for f in PAYLOAD.fields]


def points(chunks: DataFrame, dense: Column, *, stable_ids: bool = False) -> DataFrame:
    """``id, dense, payload`` of chunks. Ids are random, as upserts that never meet; with ``stable_ids`` they follow url and index.

    Vectors are stored at length 1, so that cosine is a dot product at query time.
    """
    row_id = F.sha2(F.concat_ws("\u0001", or_default(F.col("url"), ""), or_default(F.col("chunk_index"), 0).cast("string")), 256) if stable_ids else F.uuid()
    return chunks.select(row_id.alias("id"), normalized(dense).alias("dense"), F.struct(*payload()).alias("payload"))


def stats_of(points_: DataFrame) -> DataFrame:
    """One row: number of points and dimension of the vectors (``dense``)."""
    return points_.agg(F.count("*").alias("points"), F.max(F.size("dense")).alias("dim"))


class Collection:
    """A named table of points in the session's catalog."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def create(self) -> None:
        self.spark.createDataFrame([], POINT).write.format("parquet").saveAsTable(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def prepare(self, reset: bool = False) -> None:
        """Drops the collection first if asked to, then creates it where it is absent."""
        if reset and self.exists():
            self.drop()
        if not self.exists():
            self.create()

    def upsert(self, rows: DataFrame) -> None:
        """Appends points. With random ids a second run doubles the rows."""
        rows.select("id", "dense", "payload").write.format("parquet").mode("append").saveAsTable(self.name)

    def upsert_stable(self, rows: DataFrame) -> None:
        """Appends only points whose id is not there yet."""
        old = self.read().select("id")
        rows.dropDuplicates(["id"]).join(old, "id", "left_anti").select("id", "dense", "payload").write.format("parquet").mode("append").saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def stats(self) -> DataFrame:
        """One row: number of points and dimension of the vectors."""
        return stats_of(self.read())
