"""Helpers shared by the training-data operators: shared storage, text normal forms, hashing."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import unicodedata
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Runs of anything that is neither a letter nor a line break.
NOT_LETTERS = re.compile(r"[^\w\n]+|[\d_]+")


_OWN: list[str] = []
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a session that runs in this one process gets a temporary folder; a cluster is refused.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="weftline-"))
            atexit.register(shutil.rmtree, _OWN[0].removeprefix("file://"), ignore_errors=True)
        where = _OWN[0]
    return where.rstrip("/")


def release(spark: SparkSession, some: slice = slice(None)) -> int:
    """Removes the tables ``cut`` has written (``some`` of them, in the order of writing), once no result that reads them is needed any more; gives their number."""
    gone = _WRITTEN[some]
    del _WRITTEN[some]
    for name in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(gone)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The lineage ends there, later branches read the table instead of running Python again, and the loss of an
    executor costs nothing that was already written. ``release`` removes the tables.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(text: str) -> str:
    """Compatibility forms and letter case made equal."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFKC", text).casefold()


def letters(text: str) -> str:
    """``text`` folded, with everything but letters and line breaks left aside."""
    return NOT_LETTERS.sub("", fold(text))


def hash64(text: str) -> int:
    """Signed 64-bit hash of a string."""
    h = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def codepoints(text: str) -> np.ndarray:
    """The code points of ``text`` as uint32."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


def mixed(a: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, elementwise."""
    a = a ^ (a >> np.uint64(31))
    a = a * np.uint64(0xBF58476D1CE4E5B9)
    return a ^ (a >> np.uint64(29))


def shingle_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k code points from each position on (zeros follow the end)."""
    padded = np.concatenate([codes.astype(np.uint64), np.zeros(k - 1, dtype=np.uint64)])
    h = np.zeros(len(codes), dtype=np.uint64)
    for i in range(k):
        h = h * np.uint64(0x100000001B3) + padded[i : i + len(codes)] * _ODD[i % len(_ODD)]
    return mixed(h)


def minhash_bands(codes: np.ndarray, begin: np.ndarray, end: np.ndarray, k: int, rows: int, bands: int, seed: int = 0) -> np.ndarray:
    """``(stretch, band)``: of each stretch of code points, bands of ``rows`` minimum hashes over its ``k``-character shingles.

    Equal stretches have equal bands; a stretch shorter than ``k`` is one shingle with zeros behind it. None is empty, and
    together they are all of ``codes``.
    """
    out = np.zeros((len(begin), bands), dtype=np.uint64)
    if not len(begin):
        return out.view(np.int64)
    left = np.repeat(end, end - begin) - np.arange(len(codes))
    wide = np.append(codes.astype(np.uint64), np.zeros(k, dtype=np.uint64))
    h = np.zeros(len(codes), dtype=np.uint64)
    for d in range(k):
        h = h * np.uint64(0x100000001B3) + np.where(left > d, wide[d : d + len(codes)], np.uint64(0)) * _ODD[d % len(_ODD)]
    h = mixed(h)
    for d in range(1, k):  # shingles that reach over the end stand only in stretches of less than a shingle
        h[(left == d) & (np.repeat(end - begin, end - begin) >= k)] = np.uint64(0xFFFFFFFFFFFFFFFF)
    over = np.flatnonzero(h == np.uint64(0xFFFFFFFFFFFFFFFF))
    for b in range(bands):
        for r in range(rows):
            n = (seed + b * rows + r + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
            salt = mixed(np.array([n], dtype=np.uint64))[0] | np.uint64(1)
            v = (h ^ (salt >> np.uint64(3))) * salt
            v ^= v >> np.uint64(29)
            v[over] = np.uint64(0xFFFFFFFFFFFFFFFF)
            out[:, b] = mixed(out[:, b] * np.uint64(0x100000001B3) + np.minimum.reduceat(v, begin))
    return out.view(np.int64)
