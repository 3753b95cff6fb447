"""Exact cosine search of many queries, and reranking of what it finds.

The queries are the small side: they are taken in blocks of a checked size, and each task keeps only the best rows it
has seen for every query of the block, so k rows per query and task are shuffled, whatever the table's size. The last
window then ranks those. No cross join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from ..schemas import DENSE_TOP_K, RERANK_TOP_N

#: Queries of a block: what is sent to the executors at once.
BLOCK = 4096
#: Scores are compared at this many decimals, ties go to the smaller id.
DECIMALS = 6


def nearest_one(points: DataFrame, query: list[float], id_col: str, vector: str = "dense", k: int = DENSE_TOP_K) -> DataFrame:
    """The ``k`` points most like one vector, as a plain sort with a limit (each task keeps k rows)."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = points.select(id_col, F.round(cosine(F.col(vector), q), DECIMALS).alias("score")).where("score IS NOT NULL")
    return scored.orderBy(F.desc("score"), id_col).limit(k)


#: Bytes of the scores a task computes at once.
SCORES = 64 << 20


def _best(queries: np.ndarray, qids: np.ndarray, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keeps, of each batch, only the points that beat or tie the k-th best score so far, and sorts those alone."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(queries)
        floor = np.full(n, -np.inf)
        q, ids, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        rows = max(64, min(8192, SCORES // 8 // max(1, n)))
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                vec = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                length = np.sqrt((vec * vec).sum(axis=1))
                s = np.round(queries @ (vec / np.where(length > 0, length, 1)[:, None]).T, DECIMALS)
                s[:, length == 0] = -np.inf
                own = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(n, -np.inf)
                row, col = np.nonzero((s >= np.maximum(floor, own)[:, None]) & np.isfinite(s))
                q, ids, score = np.concatenate([q, row]), np.concatenate([ids, part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)[col]]), np.concatenate([score, s[row, col]])
                order = np.lexsort((ids, -score, q))
                q, ids, score = q[order], ids[order], score[order]
                nth = np.arange(len(q)) - np.searchsorted(q, q)
                floor[q[nth == k - 1]] = score[nth == k - 1]
                q, ids, score = q[nth < k], ids[nth < k], score[nth < k]
        yield pa.RecordBatch.from_arrays([pa.array(qids[q]), pa.array(ids), pa.array(score)], names=["qid", "id", "score"])

    return scan


def nearest(points: DataFrame, queries: DataFrame, k: int = DENSE_TOP_K, *, id_col: str = "id", vector: str = "dense", qid: str = "qid", qvector: str = "dense") -> DataFrame:
    """``qid, id, score, rank`` (from 1) of the ``k`` points most like each query, exactly.

    Ids are integers. Null or zero vectors are neither points nor queries. The vectors of one table have one dimension.
    """
    some = points.where(F.col(vector).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"))
    parts, block = [], []

    def search(block: list) -> DataFrame:
        q = np.array([r[1] for r in block], dtype=np.float64)
        length = np.sqrt((q * q).sum(axis=1))
        keep = length > 0
        return some.mapInArrow(_best(q[keep] / length[keep, None], np.array([r[0] for r in block], dtype=np.int64)[keep], k), "qid long, id long, score double")

    for r in queries.where(F.col(qvector).isNotNull()).select(F.col(qid).cast("long"), F.col(qvector)).toLocalIterator():
        block.append(r)
        if len(block) == BLOCK:
            parts.append(search(block))
            block = []
    if block:
        parts.append(search(block))
    if not parts:
        return points.sparkSession.createDataFrame([], "qid long, id long, score double, rank int")
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rerank(candidates: DataFrame, score: Column, top_n: int | None = None, *, qid: str = "qid", rank: str = "rank") -> DataFrame:
    """The best ``top_n`` candidates of each query by a second score; ties keep the dense order.

    None and 0 mean the default; a negative number is refused. ``rerank_score`` is rounded after sorting.
    """
    n = top_n or RERANK_TOP_N
    if n < 0:
        raise ValueError("top_n must not be negative")
    w = Window.partitionBy(qid).orderBy(F.desc("_score"), rank)
    ranked = candidates.withColumn("_score", score).withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)
    return ranked.withColumn("rerank_score", F.round("_score", 4)).drop("_score")
