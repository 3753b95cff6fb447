"""Problem 8: texts put together into contexts of a fixed number of tokens.

Only texts larger than a context are cut, at token boundaries that are character boundaries. Pieces are spread over
partitions of bounded size by a hash; each partition is packed by best-fit decreasing, and lower bounds from dual-
feasible functions certify its number of containers. Where the count is above the bound, the least full containers of
the partition are opened again, the documents of all such partitions are exchanged (spread anew over pools) and packed
once more, for ``ROUNDS`` rounds. No partition or pool holds more than about ``ITEMS`` pieces, whatever the corpus.
"""

from __future__ import annotations

import base64
import math
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

CAPACITY = 2048
ITEMS = 20_000
ROUNDS = 2
#: Public vocabulary of a byte-level tokenizer, as ranks; the same path on every machine.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how text is parted before byte pairs are merged.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def tokenizer(path: str):
    """The tokenizer of a vocabulary file, read once per process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def cut_text(text: str, capacity: int, path: str = VOCABULARY) -> list[tuple[int, int, int]]:
    """``(start, end, tokens)`` of a text's pieces: one if it fits, else pieces of at most ``capacity`` tokens."""
    enc = tokenizer(path)
    ids = enc.encode_ordinary(text)
    if len(ids) <= capacity:
        return [(0, len(text), len(ids))]
    raw = enc.decode_tokens_bytes(ids)
    out, at, char = [], 0, 0
    while at < len(ids):
        end = min(at + capacity, len(ids))
        while end < len(ids) and end > at + 1 and raw[end][0] & 0xC0 == 0x80:  # not within a character
            end -= 1
        piece = b"".join(raw[at:end])
        chars = sum(b & 0xC0 != 0x80 for b in piece)
        out.append((char, char + chars, end - at))
        at, char = end, char + chars
    return out


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each item by best-fit decreasing. Open containers are kept by free room; a bit set finds the tightest."""
    order = np.argsort(-sizes, kind="stable")
    out = np.empty(len(sizes), dtype=np.int64)
    free: dict[int, list[int]] = defaultdict(list)
    mask = used = 0
    for i in order:
        s = int(sizes[i])
        fits = mask >> s << s
        if fits:
            room = (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask &= ~(1 << room)
        else:
            room, b = capacity, used
            used += 1
        out[i] = b
        room -= s
        if room:
            free[room].append(b)
            mask |= 1 << room
    return out


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Containers no packing can do without: the best of two families of dual-feasible functions."""
    if not len(sizes):
        return 0
    v, n = np.unique(sizes, return_counts=True)
    best = math.ceil(int((v * n).sum()) / capacity)
    for e in v[v <= capacity // 2]:  # large items fill a container, small ones nothing
        total = capacity * int(n[v > capacity - e].sum()) + int((v * n)[(v >= e) & (v <= capacity - e)].sum())
        best = max(best, -(-total // capacity))
    for k in range(1, 40):  # rounding down to parts of k, whole multiples kept
        part = (k + 1) * v
        f = np.where(part % capacity == 0, v * k, part // capacity * capacity)
        best = max(best, -(-int((f * n).sum()) // (k * capacity)))
    return best


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str = VOCABULARY) -> DataFrame:
    """``id, piece_no, start, end, tokens`` of every text. Null and empty texts have none; a narrow stage."""
    picked = docs.where(F.length(text_col) > 0).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k, *p) for i, t in zip(b["id"], b["text"], strict=True) for k, p in enumerate(cut_text(t, capacity, path))]
            yield pd.DataFrame(rows, columns=["id", "piece_no", "start", "end", "tokens"])

    return picked.mapInPandas(measure, "id long, piece_no int, start int, end int, tokens int")


def _filler(turn: int, last: bool, capacity: int):
    """Packs one pool; unless it is the last turn, opens containers again where the bound is not met."""
    def fill(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["id", "piece_no", "row"], kind="stable", ignore_index=True)  # the same packing at every layout
        sizes = b["tokens"].to_numpy()
        bins = best_fit(sizes, capacity)
        used, least = int(bins.max()) + 1, lower_bound(sizes, capacity)
        room = capacity - np.bincount(bins, sizes)
        opened = np.zeros(used, dtype=bool)
        if used > least and not last:
            opened[np.argsort(-room, kind="stable")[: 4 * (used - least) + 4]] = True
        b["container"] = [f"{turn}-{key[0]}-{k}" for k in bins]
        b["certified"] = used == least
        b["open"] = opened[bins]
        return b[["id", "piece_no", "start", "end", "tokens", "row", "container", "certified", "open"]]

    return fill


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str = VOCABULARY, items: int = ITEMS) -> DataFrame:
    """``id, piece_no, start, end, tokens, container, certified``: every piece in one container of at most ``capacity`` tokens.

    ``certified``: the container's partition uses as few containers as any packing of it must. Rows with an id repeated
    are packed as often as they occur.
    """
    if capacity < 4:
        raise ValueError("capacity must be at least 4")
    # A row of its own for each piece keeps repeated rows apart.
    todo = cut(pieces(docs, id_col, text_col, capacity, path).withColumn("row", F.monotonically_increasing_id()), "pieces")
    done = None
    for turn in range(ROUNDS + 1):
        n = todo.count()
        pools = max(1, -(-n // items))
        last = turn == ROUNDS

        pool = F.pmod(F.xxhash64("id", "piece_no", F.lit(turn)), F.lit(pools)).cast("int")
        packed = cut(todo.withColumn("pool", pool).groupBy("pool").applyInPandas(_filler(turn, last, capacity), "id long, piece_no int, start int, end int, tokens int, row long, container string, certified boolean, open boolean"), "packed")
        closed = packed.where("NOT open").drop("open", "row")
        done = closed if done is None else done.unionByName(closed)
        todo = packed.where("open").select("id", "piece_no", "start", "end", "tokens", "row")
        if last or not todo.take(1):
            break
    return done
