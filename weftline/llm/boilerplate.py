"""Problem 7: the main body of a page, without menus, notices, lists of other pages, bylines, footers.

Gradient-boosted trees score every line (node) by its attribute tokens, length, punctuation, place, siblings and the
density of its block (subtree). Labels and features come from different sources. The labels of the trees' sample are
corpus statistics: what very many records say in the same words is furniture, sentences hardly any other record has are
body, headings go with the sentences below them, a list without sentences goes with its shared lines. No attribute token
labels a line, and how many records share a line's own wording is no feature of it. That share is evidence of its own,
added to the trees' log-odds. Decoding is hierarchical: a block is furniture, body, or mixed at a price, so a block
and its lines cannot contradict each other.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pages
from .boosting import Boosted
from .forest import WORD, Forest, classes, forests
from .residue import SIGN, automaton, flags
from .sentences import sample

#: Records the trees are fitted on.
SAMPLE = 1500
#: A wording is known if this share of the records (and at least three) holds it: at most lines per record / share wordings.
KNOWN = 0.002
COMMON = 0.01
MIXED = 3.0
#: Log-odds that a line is furniture for each tenfold of its share of the records over ``COMMON`` / 3, and at most.
EVIDENCE, MOST = 2.0, 3.0


def _said(f: Forest) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of a batch: of each line's wording, of its lead, and line and hash of the entries on lines with several."""
    return f.said(), f.leads(), *f.parts_said()


def _held(f: Forest) -> tuple[np.ndarray, np.ndarray]:
    """The different hashes the texts of a batch hold, and how many of its texts hold each."""
    if not len(f):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    said, leads, at, parts = _said(f)
    h = np.concatenate([said, leads, parts])
    doc = np.concatenate([f.doc, f.doc, f.doc[at]])[h != 0]
    h = h[h != 0]
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return np.unique(h[new], return_counts=True)


def wordings(text: str) -> set[int]:
    """Hashes of the wordings of a record's lines, of their leads and of the entries on them."""
    return set(_held(Forest([text], [None]))[0].tolist())


def known_wordings(df: DataFrame, text_col: str, total: int | None = None) -> dict[int, float]:
    """Share of all records that hold a wording, for the wordings that are known.

    Counted over every record; added up per batch before the shuffle. What reaches the driver is bounded by the mean
    number of lines of a record over ``KNOWN``, whatever the number of records.
    """
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            held = [_held(f) for _, f in forests(b["text"].tolist(), [None] * len(b))]
            w = np.concatenate([h for h, _ in held] or [np.zeros(0, np.int64)])
            k = np.concatenate([n for _, n in held] or [np.zeros(0, np.int64)])
            if len(held) > 1:
                w, inverse = np.unique(w, return_inverse=True)
                k = np.bincount(inverse, k).astype(np.int64)
            if len(w):
                yield pd.DataFrame({"w": w, "n": k})

    n = df.count() if total is None else total
    least = max(3, math.ceil(KNOWN * n))
    texts = df.where(F.length(text_col) > 0).select(F.col(text_col).alias("text"))
    rows = texts.mapInPandas(count, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return {r.w: r.n / n for r in rows.toLocalIterator()}


class Lookup:
    """Shares of hashes, for whole arrays."""

    def __init__(self, known: dict[int, float]):
        self.keys = np.array(sorted(known), dtype=np.int64)
        self.values = np.array([known[k] for k in self.keys.tolist()], dtype=np.float32)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(h), np.float32)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where((self.keys[at] == h) & (h != 0), self.values[at], np.float32(0))


class Reading:
    """A batch of texts, what is known of its lines, and their features."""

    def __init__(self, f: Forest, shares: Lookup, titles: frozenset[str] = frozenset(), with_tokens: bool = True):
        self.forest = f
        n = len(f)
        if n:
            f.read_forms()
        said, leads, at, parts = _said(f) if n else (np.zeros(0, np.int64),) * 4
        self.shares = shares(said)
        # a sentence with numbers of its own may be said anew, however many say it in the same words
        self.anew = f.like & (f.digits > 0) & (self.shares > 0) if n else np.zeros(0, bool)
        self.lead_shares = shares(leads)
        common = np.bincount(at, shares(parts) >= COMMON, minlength=n)
        self.entry_share = common / np.maximum(1, np.bincount(at, minlength=n)) if n else np.zeros(0)
        self.said = said
        self.tokens: list[tuple[str, ...]] = self._tokens() if with_tokens else [()] * n
        self.ends = f.like.copy() if n else np.zeros(0, bool)
        self.titled = np.zeros(n, dtype=bool)
        if n:
            self._wrapped(titles, with_tokens)
            self.features = self._features()
        else:
            self.features = np.zeros((0, 1), np.float32)

    def _tokens(self) -> list[tuple[str, ...]]:
        f = self.forest
        out: list[tuple[str, ...]] = [()] * len(f)
        if len(f):
            line, value = f.hits(automaton())
            bits = np.zeros(len(f), dtype=np.int64)
            np.bitwise_or.at(bits, line, value)
            heads = f.heads()
            for i in np.flatnonzero(((classes()[heads] & WORD) == 0) | (heads == 112) | (f.raw[f._hi] == 115)).tolist():
                bits[i] |= pages.hinted(f.squashed[i])
            bits &= SIGN - 1
            for i in np.flatnonzero(bits).tolist():
                out[i] = pages.found_tokens(f.squashed[i], int(bits[i]))
        return out

    def _wrapped(self, titles: frozenset[str], with_tokens: bool) -> None:
        """Wrapped lines of a pdf: a notice is known as a whole, a sentence ends with its block; a running title stands alone."""
        f = self.forest
        pdf = f.pdf[f.block_doc]
        some = np.logical_or.reduceat(self.ends, f.first) & pdf & (f.size > 1)
        self.ends |= some[f.block]
        if with_tokens:
            for b in np.flatnonzero(pdf & (f.size > 1) & (f.size <= 3)).tolist():
                span = range(f.first[b], f.first[b] + f.size[b])
                whole = tuple(dict.fromkeys(t for i in span for t in self.tokens[i])) or pages.squashed_tokens("".join(f.squashed[i] for i in span))
                if whole:
                    for i in span:
                        self.tokens[i] = whole
        self._mark_titled(titles)

    def _mark_titled(self, titles: frozenset[str]) -> None:
        f = self.forest
        if titles and len(f):
            for b in np.flatnonzero(f.pdf[f.block_doc] & (f.size == 1)).tolist():
                self.titled[f.first[b]] = pages.shape(f.text(int(f.first[b]))) in titles

    def set_titles(self, titles: frozenset[str]) -> None:
        """Takes shapes of running titles into account that were not known at first."""
        self._mark_titled(titles)
        if len(self.forest):
            self.features[:, -1] = self.titled

    def _features(self) -> np.ndarray:
        f = self.forest
        n, nb = len(f), len(f.first)
        flags_ = np.zeros((n, len(pages.GROUPS)), dtype=np.float32)
        tokened = np.zeros(n, dtype=np.float32)
        for i, t in enumerate(self.tokens):
            if t:
                tokened[i] = 1
                for k in t:
                    flags_[i, _GROUP[k]] = 1
        first, size, block = f.first, f.size, f.block
        per_line = size[block]
        total = lambda v: np.add.reduceat(v.astype(np.float32), first)[block]
        mean = lambda v: total(v) / per_line
        end = self.ends.astype(np.float32)
        shared = (self.shares >= COMMON).astype(np.float32)
        siblings = (total(shared) - shared) / np.maximum(1, per_line - 1)
        blocks_of = np.bincount(f.block_doc, minlength=len(f.texts))
        block_at = np.cumsum(blocks_of) - blocks_of
        nth_block = np.arange(nb) - block_at[f.block_doc]
        body = np.logical_or.reduceat((end > 0) & (f.length > 24) & (tokened == 0), first)
        first_body, last_body = blocks_of.copy(), np.full(len(f.texts), -1)
        np.minimum.at(first_body, f.block_doc[body], nth_block[body])
        np.maximum.at(last_body, f.block_doc[body], nth_block[body])
        pageno = np.logical_or.reduceat((flags_[:, _GROUP["pageno"]] + flags_[:, _GROUP["print"]]) > 0, first)
        same = f.block_doc[1:] == f.block_doc[:-1]
        near_no = np.zeros(nb, dtype=bool)
        near_no[1:] |= pageno[:-1] & same
        near_no[:-1] |= pageno[1:] & same
        opens = flags_[:, _GROUP["related"]]
        run = np.cumsum(opens) - opens
        self.under = run - run[first][block] > 0
        at = np.arange(n) - first[block]
        left = per_line - 1 - at
        nth, doc = nth_block[block], f.doc
        key = np.stack([doc, self.said])
        order = np.lexsort(key)
        again = (np.diff(key[0][order]) == 0) & (np.diff(key[1][order]) == 0)
        repeated = np.zeros(n, dtype=bool)
        repeated[order[1:]] |= again
        repeated[order[:-1]] |= again
        repeated &= self.said != 0
        return np.column_stack([
            np.minimum(f.length, 400), f.n_parts, f.longest, f.mean_part, f.bullet, f.listed, f.digits, f.forms, flags_, end, siblings, self.lead_shares >= 2 * COMMON, per_line, np.minimum(mean(f.length), 400), mean(end), mean(tokened), mean(f.length < 28),
            self.under, nth, blocks_of[doc] - 1 - nth, at, left, first_body[doc] - nth, nth - last_body[doc], (at > 0) & (np.roll(end, 1) > 0), (left > 0) & (np.roll(end, -1) > 0), (left > 0) & (np.roll(f.length, -1) > 30), f.pdf[doc], near_no[block], repeated, (per_line == 1) & self.titled,
        ]).astype(np.float32)


_GROUP = {k: i for i, k in enumerate(pages.GROUPS)}


def read_page(text: str, kind: str | None, known: dict[int, float], titles: frozenset[str] = frozenset()) -> Reading:
    """One record and its lines' features."""
    return Reading(Forest([text], [kind]), Lookup(known), titles)


def labels(r: Reading) -> np.ndarray:
    """1 for lines that corpus statistics show to be furniture, 0 for lines they show to be body, -1 for the others. No token is read.

    A sentence no other records share is body, as are several on one line with numbers of their own, and so are what stands right above it and long blocks none of whose lines
    is shared. A wording that ``COMMON`` of the records share is furniture, a rarer shared one if it stands apart from
    sentences of the body; entries and leads count like wordings, and running titles by the shape of listed ones. A block
    without sentences of the body goes with its shared lines.
    """
    f = r.forest
    n = len(f)
    out = np.full(n, -1)
    if not n:
        return out
    first, block, size = f.first, f.block, f.size
    entries = r.entry_share >= 0.5
    lead = ~r.ends & (r.lead_shares >= 2 * COMMON)
    several = np.array([x and len(_INNER.findall(f.text(i))) >= 2 for i, x in enumerate(r.anew.tolist())], dtype=bool)
    sentence = r.ends & ((f.length >= 24) | (size[block] > 1)) & ((r.shares == 0) | several) & ~entries
    has = np.logical_or.reduceat(sentence | r.anew, first)
    own = np.logical_and.reduceat((r.shares == 0) & ~entries & ~lead & ~r.titled, first) & (np.add.reduceat(f.length, first) >= LONG)
    out[own[block]] = 0
    out[sentence] = 0
    above = np.zeros(n, dtype=bool)  # right above a sentence, in one block or as a block of its own
    above[:-1] = sentence[1:] & (f.doc[1:] == f.doc[:-1]) & ((block[1:] == block[:-1]) | (size[block[:-1]] == 1))
    above &= ~sentence & ~r.titled & ~entries
    rest = np.add.reduceat(sentence, first) == size - 1  # all of the block but one line
    heads = above & ~r.ends & ((r.shares == 0) | rest[block] & (np.arange(n) == first[block]) & (size[block] > 1))
    out[heads & (~lead | (size[block] > 1))] = 0
    furniture = (out < 0) & ~above & ~r.anew & ((r.shares >= COMMON) | entries | ~has[block] & ((r.shares > 0) | lead)) | r.titled
    out[furniture] = 1
    out[(np.logical_or.reduceat(furniture, first) & ~has)[block] & (out < 0) & ~above & ~r.ends] = 1
    return out


#: Between sentences of one line.
_INNER = re.compile(r"[.!?] +(?=[^\s\d])|[。！？](?=[^\s」』）)”’])")
#: Characters of a block that is the body's by its own words alone.
LONG = 80


def title_shapes(readings: list[Reading], least: int = 10) -> frozenset[str]:
    """Shapes of page titles, as lists of other pages show them: no shape of plain words."""
    seen: Counter = Counter()
    for r in readings:
        f = r.forest
        apart = (labels(r) == 1) & (r.shares == 0) & ~r.ends & (f.size[f.block] > 1)
        seen.update(pages.shape(f.text(i)) for i in np.flatnonzero(apart).tolist())
    return frozenset(k for k, n in seen.items() if n >= least and len(set(k) - set("a0")) >= 2)


def decode(r: Reading, score: np.ndarray) -> np.ndarray:
    """True for the lines of the body. A block is all furniture, all body, or mixed at a price."""
    f = r.forest
    if not len(f):
        return np.zeros(0, dtype=bool)
    evidence = np.where((r.shares > 0) & ~r.anew, EVIDENCE * np.log10(np.maximum(r.shares, 1e-9) * 3 / COMMON), 0)
    s = np.clip(score + np.clip(evidence, 0, MOST), -12, 12)
    furniture, body = -np.logaddexp(0, -s), -np.logaddexp(0, s)
    a, b = np.add.reduceat(furniture, f.first), np.add.reduceat(body, f.first)
    mixed = np.add.reduceat(np.maximum(furniture, body), f.first) - np.where(f.size > 1, MIXED, 0) - np.where(f.pdf[f.block_doc], 3 * MIXED, 0)
    return np.where((mixed > np.maximum(a, b))[f.block], body > furniture, (b > a)[f.block])


@dataclass
class BodyModel:
    """Known wordings and fitted trees: tells body lines from furniture."""

    known: dict[int, float]
    titles: frozenset[str]
    trees: Boosted | None

    def __post_init__(self) -> None:
        self.shares = Lookup(self.known)

    def read(self, f: Forest) -> tuple[Reading, np.ndarray]:
        """A batch, and which of its lines belong to main bodies."""
        r = Reading(f, self.shares, self.titles)
        return r, decode(r, self.trees.score(r.features) if len(f) and self.trees else np.zeros(len(f)))

    def batches(self, texts: list[str], kinds: list[str | None]) -> Iterator[tuple[int, Reading, np.ndarray, np.ndarray]]:
        """For batches of texts: place of the first, the batch, which lines are body, which texts are residue."""
        for at, f in forests(texts, kinds):
            yield at, *self.read(f), flags(f)


def fit(df: DataFrame, id_col: str, text_col: str, type_col: str) -> BodyModel:
    """Wordings counted over all records, trees fitted on lines of ``SAMPLE`` records."""
    total = df.count()
    known = known_wordings(df, text_col, total)
    rows = [(r[0], r[1]) for r in sample(df, id_col, SAMPLE, text_col, type_col, total=total)]
    return train(rows, known)


def readings(rows: list[tuple[str, str | None]], shares: Lookup, titles: frozenset[str] = frozenset()) -> list[Reading]:
    """The records of a sample that are no residue, read in batches."""
    texts, kinds = [t for t, _ in rows if t], [k for t, k in rows if t]
    keep = [not x for _, f in forests(texts, kinds) for x in flags(f)]
    some = [i for i, ok in enumerate(keep) if ok]
    return [Reading(f, shares, titles) for _, f in forests([texts[i] for i in some], [kinds[i] for i in some])]


def train(rows: list[tuple[str, str | None]], known: dict[int, float], part: float = 1.0) -> BodyModel:
    """A model whose trees are fitted on the labelled lines of the first ``part`` of the records."""
    shares = Lookup(known)
    rows = rows[: math.ceil(part * len(rows))]
    read = readings(rows, shares)
    titles = title_shapes(read)
    for r in read:
        r.set_titles(titles)
    y = [labels(r) for r in read]
    xs = [r.features[v >= 0] for r, v in zip(read, y, strict=True)]
    ys = np.concatenate([v[v >= 0] for v in y] or [np.zeros(0)])
    if len(set(ys.tolist())) < 2:
        return BodyModel(known, titles, None)
    return BodyModel(known, titles, Boosted.fit(np.concatenate(xs), ys.astype(float)))


def agreement(rows: list[tuple[str, str | None]], known: dict[int, float], part: float = 0.8) -> dict[str, float]:
    """How well trees fitted on a part of the records agree with the labels of the others, and how many lines no statistic labels."""
    model = train(rows, known, part)
    right = seen = lines = 0
    for r in readings(rows[math.ceil(part * len(rows)) :], model.shares, model.titles):
        y = labels(r)
        keep = decode(r, model.trees.score(r.features) if model.trees else np.zeros(len(y)))
        right += int((keep == (y == 0))[y >= 0].sum())
        seen += int((y >= 0).sum())
        lines += len(y)
    return {"agreement": right / max(1, seen), "unlabelled": 1 - seen / max(1, lines)}


def _picked(df: DataFrame, id_col: str, text_col: str, type_col: str) -> DataFrame:
    return df.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(type_col).alias("kind"))


def furniture_lines(df: DataFrame, id_col: str = "ext_id", text_col: str = "text", type_col: str = "source_type", model: BodyModel | None = None) -> DataFrame:
    """``id, line_no`` of each non-blank line that is not part of the main body.

    Residue records (problem 4), null and blank texts give no rows; unknown kinds count as html; repeated rows repeat.
    One narrow stage after the model is fitted.
    """
    model = model or fit(df, id_col, text_col, type_col)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = b["id"].to_numpy()
            for at, r, keep, bad in model.batches(b["text"].tolist(), b["kind"].tolist()):
                f = r.forest
                out = np.flatnonzero(~keep & ~bad[f.doc]) if len(f) else np.zeros(0, np.int64)
                if len(out):
                    yield pd.DataFrame({"id": ids[at + f.doc[out]], "line_no": f.no[out].astype(np.int32)})

    return _picked(df, id_col, text_col, type_col).mapInPandas(judge, "id long, line_no int")


def main_bodies(df: DataFrame, id_col: str = "ext_id", text_col: str = "text", type_col: str = "source_type", model: BodyModel | None = None) -> DataFrame:
    """``id, body`` of each record: its text without furniture lines, blank lines between blocks kept. Residue records have none."""
    model = model or fit(df, id_col, text_col, type_col)

    def strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, rows = b["id"].tolist(), []
            for at, r, keep, bad in model.batches(b["text"].tolist(), b["kind"].tolist()):
                f = r.forest
                blocks: list[list[str]] = [[] for _ in f.texts]
                for a, n, d in zip(f.first.tolist(), f.size.tolist(), f.block_doc.tolist(), strict=True):
                    if lines := [f.text(i) for i in range(a, a + n) if keep[i]]:
                        blocks[d].append("\n".join(lines))
                rows += [(ids[at + d], "\n\n".join(x)) for d, x in enumerate(blocks) if not bad[d]]
            yield pd.DataFrame(rows, columns=["id", "body"])

    return _picked(df, id_col, text_col, type_col).mapInPandas(strip, "id long, body string")
