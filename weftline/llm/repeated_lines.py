"""Problem 1: lines repeated across the documents of one source.

Numbers, dates, names and marks are masked, the lines of each source are clustered by locality-sensitive hashing of what
remains, and clusters that occur in many of the source's pages are repeated lines. ``BANDS`` bands of minimum hashes are
taken over the masked letters, and one of all letters, which equal wordings share for certain; the most frequent wording
under a band's key represents it (under the last, each wording itself), a wording joins the cluster of a representative
whose shingles it shares to ``SIMILAR``, and a cluster's pages are those of all its wordings.

Where the definition asks for equal letters (``exact``), the wordings within the repeated clusters are counted by themselves.
None is lost by that: a wording's own cluster has all its pages.

Nothing is collected: pages are counted in two steps (first the distinct (source, cluster, page), then their number), and
a wording meets one representative per band, never all others, so a source or a cluster that holds a third of all rows
is spread by page and no pairs within a group are formed. Keys with so few lines that all the keys of a representative
together could not fill enough pages are left out before wordings are compared; this changes no line found with ``exact``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import codepoints, cut, minhash_bands, mixed
from .forest import DIGIT, WORD, Forest, classes, forests, spans_hashed

MIN_PAGES, MIN_SHARE = 5, 0.04
SHINGLE, ROWS, BANDS = 4, 3, 6
#: Share of shingles two wordings of one cluster have in common.
SIMILAR = 0.8
#: Keys of bands that are sent to every task at most; more are joined by a shuffle.
MOST_KEYS = 100_000
#: Letters a line must keep, and half of its own, for its names to be masked.
LEFT = 8

_TITLES, _PERSONS = "Dr Prof Mr Mrs Ms Frau Herr Mme Sr Sra Dra".split(), "教授 博士 先生 女士 老師 主任 同學".split()
_MONTHS = "january february march april may june july august september october november december".split()
_TITLED = rf"\b(?:{'|'.join(_TITLES)})\.? +[^\W\d_]+"
_PERSON = rf"[^\W\d_a-zA-Z]{{2,4}}(?={'|'.join(_PERSONS)})|[A-Za-zÀ-ÿ.-]+ *(?:{'|'.join(_PERSONS)})"
_CAPITALS = r"(?<=[^\W\d_,;:)] )[A-ZÀ-Þ][a-zà-ÿ'’]+(?:[ -][A-ZÀ-Þ][a-zà-ÿ'’]+)*"
_MONTH = rf"\b(?i:{'|'.join(_MONTHS)})\b"
#: Names: after or before a title, and capitalised words within a line; and the months. Without what stands before a title; with capitals alone.
_NAMES = re.compile(f"{_TITLED}|{_PERSON}|{_CAPITALS}|{_MONTH}")
_NO_PERSON = re.compile(f"{_TITLED}|{_CAPITALS}|{_MONTH}")
_PLAIN = re.compile(f"(?=[A-ZÀ-Þ])(?:{_TITLED}|{_CAPITALS})")


@lru_cache(1)
def _words() -> ahocorasick.Automaton:
    """What persons (0), months (1) and titles (2) are told by, in small letters, with its length."""
    out = ahocorasick.Automaton()
    for kind, words in enumerate((_PERSONS, _MONTHS, [t + x for t in _TITLES for x in ". "])):
        for w in words:
            out.add_word(w.lower(), (kind, len(w)))
    out.make_automaton()
    return out


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of each start, so many places from there on."""
    return np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)


def _letters(f: Forest) -> np.ndarray:
    return np.flatnonzero(((f.folded_cls & WORD) != 0) & ((f.folded_cls & DIGIT) == 0))


def _within(raw: np.ndarray) -> np.ndarray:
    """Places of capitals within a line that may begin a name."""
    at = np.flatnonzero(((raw >= 65) & (raw <= 90)) | ((raw >= 0xC0) & (raw <= 0xDE)))
    at = at[(at > 1) & (at < len(raw) - 1)]
    at = at[raw[at - 1] == 32]
    return at[((classes()[raw[at - 2]] & WORD) != 0) & ((raw[at + 1] >= 97) | (raw[at + 1] == 39))]


def _named(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Whether each character of the lines, with a line break behind each, stands in a name; and the lines that may hold one.

    Each line is read by the patterns that can match in it, and where capitals alone can begin a name, from these.
    """
    joined = "\n".join(lines) + "\n"
    ends = np.cumsum([len(x) + 1 for x in lines])

    def of(where: np.ndarray) -> set[int]:
        return set(np.searchsorted(ends, np.unique(where), side="right").tolist())

    raw = codepoints(joined)
    upper = (raw >= 65) & (raw <= 90)
    lower = (raw + 32 * upper).astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
    found = list(_words().iter(lower))
    where, kind, size = np.array([e for e, _ in found], dtype=np.int64), np.array([k for _, (k, _) in found], dtype=np.int64), np.array([n for _, (_, n) in found], dtype=np.int64)
    with_person, with_month, with_title = of(where[kind == 0]), of(where[kind == 1]), of(where[(kind == 2) & upper[where - size + 1]])
    read = with_person | with_month | with_title
    within = _within(raw)
    line = np.searchsorted(ends, within, side="right")
    hit = np.union1d(np.array(sorted(read), dtype=np.int64), line)
    alone = ~np.isin(line, np.array(sorted(read), dtype=np.int64))
    begin, end, last = [], [], 0
    at_capital = re.compile(_CAPITALS).match
    for at in within[alone].tolist():
        if at >= last and (m := at_capital(joined, at)):
            last = m.end()
            begin.append(at)
            end.append(last)
    for i in read:
        a = int(ends[i]) - len(lines[i]) - 1
        for m in (_NAMES if i in with_person else _NO_PERSON if i in with_month else _PLAIN).finditer(lines[i]):
            begin.append(a + m.start())
            end.append(a + m.end())
    step = np.zeros(len(joined) + 1, dtype=np.int32)
    np.add.at(step, begin, 1)
    np.add.at(step, end, -1)
    return np.cumsum(step[:-1]) > 0, hit


def _said(f: Forest, first: np.ndarray, kept: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The letters of lines ``first`` without names, behind each other, and where each line's end. A line of little but names keeps them.

    ``kept``: places of the letters of all lines, from ``begin`` to ``end`` of each.
    """
    n = end[first] - begin[first]
    breaks = np.append(f._starts[1:], len(f.raw)) - 1
    lines = [f.joined[x:y] for x, y in zip(f._starts[first].tolist(), breaks[first].tolist(), strict=True)]
    named, hit = _named(lines)
    size = breaks[first] - f._starts[first]
    own = np.cumsum(size + 1) - size - 1
    hard = np.isin(first, f.hard)
    letter = kept[_ranges(begin[first], n)]
    # a line folded by the table keeps its places
    bare = named[np.where(np.repeat(hard, n), 0, letter + np.repeat(own - f.folded_starts[first], n))] & ~np.repeat(hard, n)
    codes, ends = f.folded_codes[letter], np.cumsum(n)
    left = n - np.add.reduceat(bare, ends - n)
    some = left >= np.maximum(LEFT, n / 2)
    stays = ~(bare & np.repeat(some, n))
    n = np.where(some, left, n)
    codes = codes[stays]
    if len(other := hit[hard[hit]]):
        blank = [lines[i] for i in other.tolist()]
        for k, i in enumerate(other.tolist()):
            where = named[own[i] : own[i] + size[i]]
            if where.any():
                blank[k] = "".join(" " if x else c for c, x in zip(lines[i], where.tolist(), strict=True))
        g = Forest(["\n".join(blank)], [None])
        mine = _letters(g)
        a, z = np.searchsorted(mine, g.folded_starts), np.searchsorted(mine, g.folded_ends)
        pieces, at, ends = [], 0, np.cumsum(n)
        for k in np.flatnonzero(z - a >= np.maximum(LEFT, n[other] / 2)).tolist():
            i = other[k]
            pieces += [codes[at : ends[i] - n[i]], g.folded_codes[mine[a[k] : z[k]]]]
            at = ends[i]
            n[i] = z[k] - a[k]
        codes = np.concatenate([*pieces, codes[at:]])
    return codes, np.cumsum(n)


def line_keys(df: DataFrame, id_col: str, source_col: str, page_col: str, text_col: str) -> DataFrame:
    """A row per line that holds a letter: ``id, src, page, line_no, wording, n, form, said, b0, b1, ...``.

    ``src`` is a hash of the source, ``page`` of the page's address (null stays null), ``wording`` of the source and the
    line's letters. Of lines of a source that are equal in a batch the first has their number as ``n``, the letters without
    names as ``said``, a hash of both wordings as ``form``, and the bands of ``said``; the others have 0, 0, null and 0. Rows
    with null source or text give none.
    """
    picked = df.where(F.col(source_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(source_col).alias("src"),
        F.when(F.col(page_col).isNotNull(), F.xxhash64(page_col)).alias("page"), F.col(text_col).alias("text"))

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, ids, sources, pages = b["text"].tolist(), b["id"].to_numpy(), b["src"].to_numpy(), b["page"].array
            salts = mixed(sources.astype(np.int64).view(np.uint64)).view(np.int64)
            for at, f in forests(texts, [None] * len(texts)):
                kept = _letters(f)
                begin, end = np.searchsorted(kept, f.folded_starts), np.searchsorted(kept, f.folded_ends)
                some = np.flatnonzero(end > begin)
                if not len(some):
                    continue
                place = np.searchsorted(f.full, some)
                doc = f.doc[place]
                wordings = spans_hashed(f.folded_codes[kept], begin, end)[some] ^ salts[at + doc]
                breaks = np.append(f._starts[1:], len(f.raw)) - 1
                _, one, count = np.unique(spans_hashed(f.raw, f._starts, breaks)[some] ^ salts[at + doc], return_index=True, return_counts=True)
                codes, ends = _said(f, some[one], kept, begin, end)
                starts = np.r_[0, ends[:-1]]
                n, form, said, keys = np.zeros(len(some), dtype=np.int32), np.zeros(len(some), dtype=np.int64), np.full(len(some), None, dtype=object), np.zeros((len(some), BANDS), dtype=np.int32)
                n[one], keys[one] = count, minhash_bands(codes, starts, ends, SHINGLE, ROWS, BANDS).astype(np.int32)
                form[one] = mixed(spans_hashed(codes, starts, ends).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + wordings[one].view(np.uint64)).view(np.int64)
                whole = codes.tobytes().decode("utf-32-le", "surrogatepass")
                said[one] = [whole[a:z] for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
                out = {"id": ids[at + doc], "src": sources[at + doc], "page": pages[at + doc], "line_no": f.no[place].astype(np.int32), "wording": wordings, "n": n, "form": form, "said": said}
                yield pd.DataFrame(out | {f"b{k}": keys[:, k] for k in range(BANDS)})

    return picked.mapInPandas(keyed, "id long, src long, page long, line_no int, wording long, n int, form long, said string" + "".join(f", b{k} int" for k in range(BANDS)))


def _pages(keys: DataFrame, *by: str) -> DataFrame:
    """Distinct pages of each key, counted in two steps so that a hot key is spread by page."""
    return keys.where(F.col("page").isNotNull()).select(*by, "page").distinct().groupBy(*by).agg(F.count("*").alias("pages"))


def _excessive(pages: Column, of: Column, min_pages: int, min_share: float) -> Column:
    return (pages >= min_pages) & (pages >= min_share * of - 1e-9)


def _hot(rows: DataFrame, by: str, of: DataFrame, min_pages: int, min_share: float) -> DataFrame:
    """Values of ``by`` that occur in enough pages of their source; ``of``: the pages each has."""
    counted = _pages(rows, "src", by).where(F.col("pages") >= min_pages).join(of, "src")
    return counted.where(_excessive(F.col("pages"), F.col("of"), min_pages, min_share)).select(by)


@lru_cache(1024)
def _shingles(s: str) -> frozenset[str]:
    return frozenset(s[i : i + SHINGLE] for i in range(max(1, len(s) - SHINGLE + 1)))


def similarity(a: str, b: str) -> float:
    """Share of the different shingles of two strings that both have."""
    x, y = _shingles(a), _shingles(b)
    both = len(x & y)
    return both / (len(x) + len(y) - both)


def _few(keys: DataFrame) -> DataFrame:
    """Sent to every task if they are at most ``MOST_KEYS``; else both sides are shuffled."""
    return F.broadcast(keys) if keys.count() <= MOST_KEYS else keys


def _clusters(lines: DataFrame, of: DataFrame, min_pages: int, min_share: float) -> DataFrame:
    """``wording, rep``: each wording with the representatives of its bands that it is like, itself among them.

    Keys whose lines are too few for any cluster to be excessive are left out: a representative has ``BANDS + 1`` of them.
    Then pages are counted as if all wordings under a representative's keys were like it; where these are too few, those
    like it are too, and it is left out before wordings are compared. Strings are read for the pairs that remain.
    """
    keys = F.array(F.xxhash64(F.lit(-1), "wording"), *(F.xxhash64(F.lit(k), "src", f"b{k}") for k in range(BANDS)))
    banded = lines.where("n > 0").select("src", "wording", "form", "n", F.explode(keys).alias("key"))
    most = (BANDS + 1) * F.col("n")
    likely = banded.groupBy("src", "key").agg(F.sum("n").alias("n")).where(most >= min_pages).join(of, "src").where(_excessive(most, F.col("of"), min_pages, min_share))
    likely = _few(cut(likely.select("key"), "keys"))
    some = cut(banded.join(likely, "key").groupBy("key", "wording", "form").agg(F.sum("n").alias("n")), "wordings")
    reps = some.groupBy("key").agg(F.max(F.struct("n", "wording", "form")).alias("r"))
    pairs = cut(some.join(reps, "key").select("wording", "form", F.col("r.wording").alias("rep"), F.col("r.form").alias("rep_form")).distinct(), "pairs")
    full = _few(cut(_hot(pairs.select("wording", "rep").distinct().join(lines.select("src", "wording", "page"), "wording"), "rep", of, min_pages, min_share), "full"))
    pairs = cut(pairs.join(full, "rep", "left_semi"), "pairs")
    unlike = pairs.where("wording <> rep")
    asked = _few(cut(unlike.select("form").union(unlike.select(F.col("rep_form").alias("form"))).distinct(), "forms"))
    said = cut(lines.where("n > 0").select("form", "said").join(asked, "form", "left_semi").distinct(), "said")

    @F.pandas_udf("boolean")
    def like(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([x == y or similarity(x, y) >= SIMILAR for x, y in zip(a, b, strict=True)], dtype=bool)

    both = unlike.join(said, "form").join(said.select(F.col("form").alias("rep_form"), F.col("said").alias("rep_said")), "rep_form")
    return pairs.where("wording = rep").select("wording", "rep").union(both.where(like("said", "rep_said")).select("wording", "rep")).distinct()


def repeated_lines(df: DataFrame, id_col: str = "chunk_id", source_col: str = "category", page_col: str = "url", text_col: str = "text", *, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, exact: bool = False) -> DataFrame:
    """``id, line_no`` of each line in a cluster that occurs in at least ``min_pages`` distinct pages and at least
    ``min_share`` of the distinct pages of its source.

    With ``exact`` the wordings in the clusters are counted and only lines whose own wording passes remain. Null source
    or text: neither counted nor found. Null page: found, but not counted. Repeated rows count once, by page. An empty
    table gives an empty result; other columns are not read.
    """
    lines = cut(line_keys(df, id_col, source_col, page_col, text_col), "lines")
    of = df.where(F.col(source_col).isNotNull() & F.col(page_col).isNotNull()).select(F.xxhash64(source_col).alias("src"), F.xxhash64(page_col).alias("page"))
    of = cut(of.distinct().groupBy("src").agg(F.count("*").alias("of")), "of")

    member = cut(_clusters(lines, of, min_pages, min_share), "members")
    repeated = member.join(_hot(member.join(lines.select("src", "wording", "page"), "wording"), "rep", of, min_pages, min_share), "rep", "left_semi")
    repeated = cut(repeated.select("wording").distinct(), "repeated")
    found = lines.select("id", "src", "page", "line_no", "wording").join(repeated, "wording", "left_semi")
    if exact:
        found = found.join(cut(_hot(found, "wording", of, min_pages, min_share), "exact"), "wording", "left_semi")
    return found.select("id", "line_no")


def without_lines(df: DataFrame, lines: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """``df``'s ``id, text`` with the lines ``(id, line_no)`` removed; texts without such lines stay as they are."""
    gone = lines.groupBy("id").agg(F.collect_set("line_no").alias("gone"))
    kept = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(gone, "id", "left")
    some = F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains("gone", i))
    return kept.select("id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(some, "\n")).alias("text"))
