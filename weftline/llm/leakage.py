"""Problem 9: passages of evaluation items inside a training corpus.

Texts are reduced to their letters and digits, compatibility forms and case made equal, so layout, width and punctuation
play no part. Item-sized windows cannot find an item of which a document holds only half, so the windows are smaller
than an item (``W`` shingles); every window of every item gets a weighted SimHash of 64 bits. Windows of the documents are
looked up in a multi-index of four 16-bit blocks: any fingerprint within 3 bits agrees in at least one block, so all
within that radius are found. Each candidate (document, item) is then verified by exact weighted-shingle similarity: the
weight of the passage's characters that lie on runs of shared shingles, over the weight of the whole passage.

A shingle's weight is the logarithm of the number of items over the items that hold it; shingles of no item weigh
nothing. Instruction lines and shingles are counted over all items. The items are the query set and are searched in
blocks of ``BLOCK``, each block a narrow stage over all documents, so what is sent to the executors has a fixed bound and
no document is shuffled.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import codepoints, cut, fold, shingle_hashes

BLOCK = 2000
RADIUS = 3
LEAST = 0.5
#: Characters of a shingle, shingles of a window, step of the documents' windows, shingles a run needs: for scripts without spaces between words, and with.
KINDS = {"dense": (4, 16, 4, 6), "spaced": (8, 40, 8, 16)}

_NOISE = re.compile(r"[\W_]+")
_DENSE = re.compile(r"[฀-໿぀-ヿ㐀-鿿가-힯]")
_BITS = 22


def stream(text: str) -> str:
    """Letters and digits of ``text``, folded."""
    return _NOISE.sub("", fold(text))


def kind_of(text: str) -> str:
    return "dense" if 2 * len(_DENSE.findall(text)) > len(text) else "spaced"


#: So many items at least begin with a line that is an instruction.
SHARED = 3


def head_of(text: str) -> str:
    """The stream of the first line of a text of several lines, else nothing."""
    head, sep, _ = text.strip().partition("\n")
    return stream(head) if sep else ""


def without_head(text: str) -> str:
    return text.strip().partition("\n")[2]


def passages(items: DataFrame, item_col: str, text_col: str, shared: int = SHARED) -> DataFrame:
    """``i, passage, kind, h, n, of`` of each item: the stream of its text without its opening instruction line (a first line
    of several that at least ``shared`` of all items begin with), its kind of script, its different shingles with the
    number of all passages of that kind that hold each, and the number of those passages.

    Everything is counted over all items, whatever the blocks they are searched in.
    """
    @F.pandas_udf("string")
    def head(texts: pd.Series) -> pd.Series:
        return texts.map(head_of)

    @F.pandas_udf("string")
    def body(texts: pd.Series, opened: pd.Series) -> pd.Series:
        return pd.Series([stream(without_head(t) if o else t) for t, o in zip(texts, opened, strict=True)], dtype=object)

    def shingled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            kinds = [kind_of(t) for t in b["passage"]]
            held = [np.unique(held_in(t, KINDS[k][0])).view(np.int64) for t, k in zip(b["passage"], kinds, strict=True)]
            yield pd.DataFrame({"i": b["i"], "passage": b["passage"], "kind": kinds, "h": held})

    rows = items.where(F.col(text_col).isNotNull() & F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t")).withColumn("head", head("t"))
    opening = rows.where("head <> ''").groupBy("head").agg(F.count("*").alias("c")).where(F.col("c") >= shared).select("head", F.lit(True).alias("opens"))
    texts = rows.join(opening, "head", "left").select("i", body("t", F.coalesce("opens", F.lit(False))).alias("passage")).where("passage <> ''")
    with_row = cut(texts.mapInPandas(shingled, "i long, passage string, kind string, h array<long>").withColumn("row", F.monotonically_increasing_id()), "passages")
    each = with_row.select("row", "kind", F.explode("h").alias("s"))
    counts = each.groupBy("kind", "s").agg(F.count("*").alias("n"))
    known = each.join(counts, ["kind", "s"]).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("s", "n"))).alias("k"))  # an item's own shingles
    of = with_row.groupBy("kind").agg(F.count("*").alias("of"))
    full = with_row.join(known, "row").join(of, "kind")
    return full.select("i", "passage", "kind", F.transform("k", lambda x: x["s"]).alias("h"), F.transform("k", lambda x: x["n"]).alias("n"), "of")


def held_in(text: str, k: int) -> np.ndarray:
    """Hashes of a text's shingles, in order."""
    return shingle_hashes(codepoints(text), k)[: max(1, len(text) - k + 1)]


def simhash(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted SimHash of each row of (windows, shingles)."""
    out = np.empty(len(hashes), dtype=np.uint64)
    for a in range(0, len(hashes), 4096):
        h, w = np.ascontiguousarray(hashes[a : a + 4096]), weights[a : a + 4096].astype(np.float32)
        bits = np.unpackbits(h.view(np.uint8).reshape(*h.shape, 8), axis=2).astype(np.float32)
        total = np.matmul(w[:, None, :], bits)[:, 0, :] * 2 - w.sum(axis=1, keepdims=True)
        out[a : a + 4096] = np.packbits(total > 0, axis=1).view(np.uint64)[:, 0]
    return out


class Index:
    """Fingerprints and shingle weights of the passages of one kind."""

    def __init__(self, found: list[tuple[int, str]], kind: str, counts: tuple[np.ndarray, np.ndarray, int] | None = None):
        """``found``: item and passage; ``counts``: their shingles, the number of passages that hold each, and of all passages (else of these alone)."""
        self.k, self.w, self.step, self.run = KINDS[kind]
        self.ids = [i for i, _ in found]
        self.held = held = [held_in(t, self.k) for _, t in found]
        self.lengths = [len(t) for _, t in found]
        if counts is None:
            flat = np.concatenate([np.unique(h) for h in held]) if held else np.zeros(0, np.uint64)
            self.known, df = np.unique(flat, return_counts=True)
            of = len(held)
        else:
            self.known, at = np.unique(counts[0], return_index=True)
            df, of = counts[1][at], counts[2]
        self.weight = np.log((1 + of) / df).astype(np.float32)
        self.bitmap = np.zeros(1 << _BITS, dtype=bool)
        self.bitmap[self.known >> np.uint64(64 - _BITS)] = True
        prints, of = [], []
        for n, h in enumerate(held):
            w = min(self.w, len(h))
            win = np.lib.stride_tricks.sliding_window_view(h, w)
            prints.append(simhash(win, self.weights(win)))
            of.append(np.full(len(win), n))
        self.prints = np.concatenate(prints) if prints else np.zeros(0, np.uint64)
        self.of = np.concatenate(of) if of else np.zeros(0, np.int64)
        self.blocks = []
        for b in range(4):
            key = (self.prints >> np.uint64(16 * b)).astype(np.uint16)
            order = np.argsort(key, kind="stable")
            self.blocks.append((order, np.searchsorted(key[order], np.arange(65537, dtype=np.int64))))

    def weights(self, h: np.ndarray) -> np.ndarray:
        """Weight of each shingle, 0 if no passage holds it."""
        if not len(self.known):
            return np.zeros(h.shape, np.float32)
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        return np.where(self.known[at] == h, self.weight[at], np.float32(0))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (query, passage) pairs with fingerprints within the radius."""
        q, p = [], []
        for b, (order, starts) in enumerate(self.blocks):
            key = ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
            n = starts[key + 1] - starts[key]
            mine = np.repeat(np.arange(len(prints)), n)
            theirs = order[np.repeat(starts[key], n) + (np.arange(len(mine)) - np.repeat(np.cumsum(n) - n, n))]
            ok = np.bitwise_count(prints[mine] ^ self.prints[theirs]) <= RADIUS
            q.append(mine[ok])
            p.append(self.of[theirs[ok]])
        return np.concatenate(q), np.concatenate(p)

    def similarity(self, doc: np.ndarray, n: int) -> float:
        """Weight of passage n's characters on runs of shingles shared with the document, over the passage's weight."""
        h = self.held[n]
        order = np.argsort(doc, kind="stable")
        lo, hi = np.searchsorted(doc[order], h), np.searchsorted(doc[order], h, side="right")
        many = hi - lo
        j = np.repeat(np.arange(len(h)), many)
        i = order[np.repeat(lo, many) + (np.arange(len(j)) - np.repeat(np.cumsum(many) - many, many))]
        char = np.zeros(self.lengths[n], dtype=np.float32)
        per = self.weights(h)
        for d in range(self.k):  # a character weighs as the shingles that cover it
            char[d : d + len(h)] += per[: max(0, len(char) - d)]
        covered = np.zeros(len(char) + 1, dtype=np.int32)
        band = (i - j) // 4
        for shift in (0, 1):  # runs may drift by small edits: bands of 8 diagonals, overlapping by half
            wide = (band + shift) // 2
            by = np.lexsort((j, wide))
            wd, jj = wide[by], j[by]
            if not len(jj):
                break
            new = np.flatnonzero(np.r_[True, (wd[1:] != wd[:-1]) | (jj[1:] - jj[:-1] > 2 * self.k)])
            end = np.r_[new[1:], len(jj)]
            for a, z in zip(new, end, strict=True):
                if z - a >= self.run:
                    np.add.at(covered, jj[a:z], 1)
                    np.add.at(covered, np.minimum(jj[a:z] + self.k, len(char)), -1)
        return float(char[np.cumsum(covered)[:-1] > 0].sum() / max(char.sum(), 1e-9))

    def find(self, streams: list[str]) -> list[tuple[int, int, float]]:
        """``(text, passage, similarity)`` of all verified pairs of a batch of texts."""
        if not self.ids or not streams:
            return []
        gap = "\0" * self.k
        h = shingle_hashes(codepoints(gap.join(streams) + gap), self.k)
        lengths = np.fromiter(map(len, streams), dtype=np.int64, count=len(streams))
        starts = np.concatenate([[0], np.cumsum(lengths + self.k)[:-1]])
        some = np.flatnonzero(self.bitmap[h >> np.uint64(64 - _BITS)])
        w = np.zeros(len(h) + 1, dtype=np.float32)
        w[some] = self.weights(h[some])
        held = np.concatenate([[0], np.cumsum(w[:-1] > 0)])
        begin = np.arange(0, max(1, len(h) - self.w), self.step)
        ends = np.maximum(0, starts + lengths - self.k + 1 - self.w)  # and the last window of each text
        begin = np.unique(np.concatenate([begin, ends]))
        stop = np.minimum(begin + self.w, len(h))
        keep = 2 * (held[stop] - held[begin]) >= self.w  # a window of foreign shingles cannot verify
        begin = begin[keep & (begin + self.w <= len(h))]
        if not len(begin):
            return []
        win = begin[:, None] + np.arange(self.w)[None, :]
        q, p = self.near(simhash(h[win], w[win]))
        text = np.searchsorted(starts, begin[q] + self.w // 2, side="right") - 1
        out = []
        for t, n in sorted(set(zip(text.tolist(), p.tolist(), strict=True))):
            doc = h[starts[t] : starts[t] + max(1, lengths[t] - self.k + 1)]
            if (s := self.similarity(doc, n)) >= LEAST:
                out.append((t, n, s))
        return out


def leaked(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block: int | None = None) -> DataFrame:
    """``doc_id, item_id, similarity`` of each document that holds at least half of an item's passage.

    Null and empty texts on either side give no rows; of items repeated under another id each is reported; repeated
    document rows are reported repeatedly; texts of any length are read whole. Other columns are not read.
    """
    rows = passages(items, item_col, item_text).orderBy("i", "passage")
    picked = docs.where(F.length(text_col) > 0).select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts, held = [], []

    def search(found: list) -> DataFrame:
        by = defaultdict(list)
        for r in found:
            by[r.kind].append(r)
        counts = lambda v: (np.concatenate([np.array(r.h, dtype=np.int64) for r in v]).view(np.uint64), np.concatenate([np.array(r.n) for r in v]), v[0].of)
        indexes = [Index([(r.i, r.passage) for r in v], kind, counts(v)) for kind, v in sorted(by.items())]

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                ids, streams = b["doc_id"].to_numpy(), [stream(t) for t in b["text"]]
                got = [(ids[t], x.ids[n], s) for x in indexes for t, n, s in x.find(streams)]
                yield pd.DataFrame(got, columns=["doc_id", "item_id", "similarity"])

        return picked.mapInPandas(scan, "doc_id long, item_id long, similarity double")

    for r in rows.toLocalIterator():
        held.append(r)
        if len(held) == (block or BLOCK):
            parts.append(search(held))
            held = []
    if held or not parts:
        parts.append(search(held))
    return reduce(DataFrame.unionByName, parts)
