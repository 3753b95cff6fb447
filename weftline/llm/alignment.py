"""Problem 3: sentence alignment of the language versions of a page.

The sentences of one version are emissions of a hidden Markov model whose states are the other version's sentences,
spans of two of them (merged in translation) and, at each place, nothing (omitted there). Jumps prefer the next sentence but
reach every other, so reordering is decoded too. The model is run in both directions; a pair counts if either path holds
it and the sentences' own likelihood ratio bears it out.

Emissions come from a word translation table (an expectation-maximisation model over words of one and two-character
pieces of the other language), fitted on the sentences of all version pairs that share rare numbers, then on all that this
table aligns, and from numbers, brought to one form: years of either calendar, months, hours of either clock. The executors
fit the table: all sentences with a word are in one row, so counts stay there and only totals of words are exchanged.

Versions are found by their urls less the stated language. Copies of a version are aligned once, through their class.
The versions of a page meet in a join of pairs; no group of pages is gathered in one task.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from operator import add
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import languages as lg
from .common import cut, hash64, release

#: Pairs of words a row of the tables' fitting holds, about; a word that has more is dealt to several rows.
BLOCK = 4_000_000
#: Keys of versions that are sent to every task at most; with more, texts are joined by a shuffle.
MOST_KEYS = 100_000
#: Rounds of expectation-maximisation; least probability of a translation that is kept after them.
ROUNDS, LIKELY = 6, 0.03
#: Least share of the log-likelihood ratio a perfect translation would have: where numbers agree, where one sentence has none, where they disagree.
AGREED, WORDS, DISAGREED = 0.36, 0.42, 0.6
#: Least ratio of a pair the tables are fitted on again.
LEAST = 2.0
#: Weight of translation against noise; background probability of a number; probability that a number is kept.
TRUST, NUMBER, KEPT = 0.9, 1e-3, 0.7

_MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
_HAN = "㐀-鿿"
_ONE_HAN, _NO_HAN, _KANA_HANGUL, _ZEROS = re.compile(f"[{_HAN}]"), re.compile(f"[^{_HAN}]+"), re.compile("[ぁ-ヿ가-힣]"), re.compile(r"^#0+(?=\d)")
#: Words and pieces that cannot belong to a date, a time or a code come first; what begins none is passed at once.
_TOKEN = re.compile(
    rf"(?P<run>(?![下晚上早中])[{_HAN}]+)|(?P<plain>[a-zà-ÿ]++(?:'[a-z]+)?+(?=\s[^\d\s]|[,;:!?)]|\Z))"
    rf"|(?=[\da-zà-ÿ下晚上早中])(?:(?P<roc>\d{{2,3}})(?=(?:學年度?|年))|(?=[\d下晚上早中])(?P<pm>下午|晚上|上午|早上|中午)?(?P<hour>\d{{1,2}})(?:時(?:(?P<min>\d{{1,2}})分)?|:(?P<min2>\d\d)(?:\s*(?P<ampm>[ap])\.?m\b\.?)?)"
    rf"|(?P<month>(?=[jfmasond])\b(?:jan|feb|mar|apr|may|june?|july?|aug|sept?|oct|nov|dec)[a-z]*)\.?(?=\s*\d|\s+\d)|(?P<code>(?=[a-z])[a-z]{{1,4}}\d{{2,}})|(?P<num>\d+(?:,\d{{3}})*(?:\.\d+)*)|(?P<word>[a-zà-ÿ]+(?:'[a-z]+)?)|(?P<han>[{_HAN}]+))"
)


def tokens(sentence: str) -> list[str]:
    """Numbers in one form (``#``), words, and pieces of one script without spaces (two characters, overlapping)."""
    out: list[str] = []
    if "\n" in sentence:
        sentence = sentence.replace("\n", "" if _ONE_HAN.search(sentence) else " ")
    for m in _TOKEN.finditer(sentence.lower()):
        kind = m.lastgroup
        if kind == "plain" or kind == "word":
            out.append(m[0])
            continue
        if kind == "run" or kind == "han":
            s = m[0]
            out += map(add, s, s[1:]) if len(s) > 1 else s
            continue
        if kind == "num":
            text = m[0].replace(",", "")
            out += [f"#{int(p)}" for p in text.split(".")] if text.count(".") == 2 and len(text.split(".")[0]) == 4 else [_ZEROS.sub("#", f"#{text}") if text[0] == "0" else f"#{text}"]
            continue
        if m["hour"] is not None:
            kind = "hour"
        if kind == "roc":
            v = int(m["roc"])
            out.append(f"#{v + 1911 if v < 200 else v}")
        elif kind == "hour":
            h, mi = int(m["hour"]), int(m["min"] or m["min2"] or 0)
            if (m["pm"] in ("下午", "晚上") or m["ampm"] == "p") and h < 12:
                h += 12
            out.append(f"#{h}:{mi:02d}")
        elif kind == "month":
            out.append(f"#{_MONTHS[m['month'][:3]]}")
        elif kind == "code":
            out.append(f"#{m['code']}")
    return out


#: Numbers a matrix of a document may hold at once.
CELLS = 4_000_000


class Lexicon(dict):
    """Words as numbers, in the order they are met; ``names`` has them by number."""

    def __init__(self) -> None:
        super().__init__()
        self.names: list[str] = []
        self._signs = np.zeros(0, dtype=np.uint8)
        self._known = 0

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self.names)
        self.names.append(word)
        return n

    def code(self, sentences: list[list[str]]) -> Coded:
        return Coded(self.numbers([w for s in sentences for w in s]), np.array([*map(len, sentences)], dtype=np.int64))

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.array([*map(self.__getitem__, words)], dtype=np.int64)

    def signs(self) -> np.ndarray:
        """Of each word whether it is a number (1), Latin (2), Latin and long (4)."""
        if self._known < len(self.names):
            new = self.names[self._known :]
            self._signs = _room(self._signs, len(self.names))
            self._signs[self._known : len(self.names)] = [(w[0] == "#") | 2 * w.isascii() | 4 * (w.isascii() and len(w) > 5) for w in new]
            self._known = len(self.names)
        return self._signs


class Coded(NamedTuple):
    """Sentences behind each other: the numbers of their words, and how many words each has."""

    words: np.ndarray
    n: np.ndarray

    def places(self) -> np.ndarray:
        """Of each word its sentence."""
        return np.repeat(np.arange(len(self.n)), self.n)


def _room(a: np.ndarray, n: int) -> np.ndarray:
    """An array of at least ``n`` with what ``a`` holds."""
    if n <= len(a):
        return a
    out = np.zeros(max(n, 2 * len(a)), dtype=a.dtype)
    out[: len(a)] = a
    return out


class _Facts:
    """What a table says of each word of a lexicon: its translations, and what it counts as a target."""

    def __init__(self, table: Table, lexicon: Lexicon):
        self.table, self.lexicon, self.known = table, lexicon, 0
        self.rows = {v: i for i, v in enumerate(table.p)}
        self.n = np.array([*map(len, table.p.values()), 0], dtype=np.int64)  # the last row has no translation
        self.first = np.cumsum(self.n) - self.n
        self.ids = lexicon.numbers([w for d in table.p.values() for w in d])
        self.p = np.array([x for d in table.p.values() for x in d.values()])
        self.row, self.place = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.ground, self.miss, self.worth = np.zeros(0), np.zeros(0), np.zeros(0)

    def grow(self) -> None:
        n = len(self.lexicon.names)
        if self.known == n:
            return
        new, some = self.lexicon.names[self.known :], slice(self.known, n)
        self.row, self.place, self.ground, self.miss, self.worth = (_room(a, n) for a in (self.row, self.place, self.ground, self.miss, self.worth))
        back, number = self.table.background, [w[0] == "#" for w in new]
        self.row[some] = [self.rows.get(w, -1) for w in new]
        self.place[some] = -1
        self.ground[some] = [NUMBER if x else max(back.get(w, NUMBER), 1e-5) for w, x in zip(new, number, strict=True)]
        self.miss[some] = np.where(number, math.log(1 - TRUST), math.log(1 - TRUST) * 0.35)
        self.worth[some] = [math.log(1 - TRUST + TRUST * (KEPT if x else 0.5) / max(NUMBER if x else back.get(w, NUMBER), 1e-5)) for w, x in zip(new, number, strict=True)]
        self.known = n


@dataclass
class Table:
    """``p[v][w]``: probability that w translates v; ``background``: of w alone."""

    p: dict[str, dict[str, float]]
    background: dict[str, float]
    _facts: _Facts | None = field(default=None, init=False, repr=False, compare=False)

    def facts(self, lexicon: Lexicon) -> _Facts:
        if self._facts is None or self._facts.lexicon is not lexicon:
            self._facts = _Facts(self, lexicon)
        self._facts.grow()
        return self._facts

    def ratios(self, sources: Coded, targets: Coded, lexicon: Lexicon) -> np.ndarray:
        """Log-likelihood ratio of each target against noise, for each source."""
        return self.single_and_span(sources, targets, lexicon, spans=False)[0]

    def single_and_span(self, sources: Coded, targets: Coded, lexicon: Lexicon, spans: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The ratios for each source, and for each source together with the next (none without ``spans``)."""
        known = self.facts(lexicon)
        place, lengths = known.place, targets.n
        # the different words of the targets, and of each word of a target its place among them
        every = np.arange(len(targets.words))
        place[targets.words] = every
        words = targets.words[place[targets.words] == every]
        place[words] = np.arange(len(words))
        flat = place[targets.words]
        q = np.zeros((len(sources.n), len(words)))
        cell = q.reshape(-1)
        of, row = sources.places() * len(words), known.row[sources.words]
        n = known.n[row]
        some = _ranges(known.first[row], n)
        k = place[known.ids[some]]
        there = k >= 0
        np.maximum.at(cell, (np.repeat(of, n) + k)[there], known.p[some[there]])
        k = place[sources.words]
        there = (k >= 0) & ((lexicon.signs()[sources.words] & 3) > 0)
        kept = of[there] + k[there]
        cell[kept] = np.where(cell[kept] > 0, cell[kept], KEPT)
        place[words] = -1
        ground, miss = known.ground[words], known.miss[words]
        starts = np.cumsum(lengths) - lengths
        scale = np.sqrt(1 + lengths / 12)

        def total(q: np.ndarray) -> np.ndarray:
            out = np.zeros((q.shape[0], len(lengths)), dtype=np.float32 if q.shape[0] * len(lengths) > CELLS else np.float64)
            if not q.shape[0] or not len(flat):
                return out
            word = np.where(q > 0, np.log(1 - TRUST + TRUST * q / ground), miss)
            a = 0
            while a < len(lengths):  # so many targets at once that their words fit
                z = max(a + 1, int(np.searchsorted(starts, starts[a] + CELLS // q.shape[0])))
                some = flat[starts[a] : starts[z] if z < len(lengths) else len(flat)]
                if len(some):
                    # an empty target has no words: keep its start inside and its sum at nothing
                    part = np.add.reduceat(word[:, some], np.minimum(starts[a:z] - starts[a], len(some) - 1), axis=1)
                    out[:, a:z] = part * (lengths[a:z] > 0) / scale[a:z]
                a = z
            return out

        return total(q), total(np.maximum(q[:-1], q[1:]) if spans else q[:0])

    def perfect(self, targets: Coded, lexicon: Lexicon) -> np.ndarray:
        """The ratio of each target if every word of it were well translated."""
        total = np.bincount(targets.places(), self.facts(lexicon).worth[targets.words], minlength=len(targets.n))
        return np.maximum(total, 1e-6) / np.sqrt(1 + targets.n / 12)


def fit_table(pairs: list[tuple[list[str], list[str]]], rounds: int = ROUNDS) -> Table:
    """Expectation-maximisation over sentence pairs in memory; numbers are left to their own rule. ``fitted`` does the same over a table."""
    count = Counter(w for _, t in pairs for w in t if w[0] != "#")
    total = sum(count.values()) or 1
    back = {w: n / total for w, n in count.items()}
    vs: dict[str, int] = {}
    ws: dict[str, int] = {}
    rows_v, rows_w, rows_s = [], [], []
    n = 0
    for s, t in pairs:
        sv = [vs.setdefault(v, len(vs)) for v in set(s) if v[0] != "#"]
        for w in set(t):
            if w[0] != "#":
                k = ws.setdefault(w, len(ws))
                rows_v += sv
                rows_w += [k] * len(sv)
                rows_s += [n] * len(sv)
                n += 1
    if not rows_v:
        return Table({}, back)
    v, w, s = np.array(rows_v), np.array(rows_w), np.array(rows_s)
    pair, at = np.unique(v.astype(np.int64) * len(ws) + w, return_inverse=True)
    pv = (pair // len(ws)).astype(np.int64)
    prob = np.full(len(pair), 1.0 / len(ws))
    for _ in range(rounds):
        q = prob[at]
        q = q / np.bincount(s, q, minlength=n)[s]
        got = np.bincount(at, q, minlength=len(pair))
        prob = got / np.bincount(pv, got, minlength=len(vs))[pv]
    names_v, names_w = list(vs), list(ws)
    p: dict[str, dict[str, float]] = defaultdict(dict)
    for k in np.flatnonzero(prob > LIKELY):
        p[names_v[pv[k]]][names_w[pair[k] % len(ws)]] = float(prob[k])
    return Table(dict(p), back)


def anchored(a: Coded, b: Coded, lexicon: Lexicon) -> list[tuple[int, int]]:
    """Sentence pairs that are each other's best by shared rare numbers and names."""
    if not len(a.n) or not len(b.n):
        return []
    signs = lexicon.signs()

    def rare(c: Coded) -> tuple[np.ndarray, np.ndarray]:
        """Word and sentence of each number and long Latin word, by words, once a sentence."""
        some = np.flatnonzero(signs[c.words] & 5)
        return np.divmod(np.unique(c.words[some] * len(c.n) + c.places()[some]), len(c.n))

    (word, i), (word_b, j) = rare(a), rare(b)
    first, last = np.searchsorted(word_b, word), np.searchsorted(word_b, word, side="right")
    n = last - first
    held = np.searchsorted(word, word_b, side="right") > np.searchsorted(word, word_b)
    # a name is what both versions have
    size_a, size_b = np.bincount(i[(n > 0) | (signs[word] & 1 > 0)], minlength=len(a.n)), np.bincount(j[held | (signs[word_b] & 1 > 0)], minlength=len(b.n))
    worth = 1 / (np.searchsorted(word, word, side="right") - np.searchsorted(word, word) + n)
    score = np.zeros((len(a.n), len(b.n)))
    ends = np.cumsum(n)
    at = 0
    while at < len(n):  # so many words at once that their pairs fit
        z = max(at + 1, int(np.searchsorted(ends, ends[at] - n[at] + CELLS, side="right")))
        np.add.at(score.reshape(-1), np.repeat(i[at:z] * len(b.n), n[at:z]) + j[_ranges(first[at:z], n[at:z])], np.repeat(worth[at:z], n[at:z]))
        at = z
    score /= np.sqrt(np.maximum(1, np.maximum(size_a[:, None], size_b)))
    best, back = score.argmax(axis=1), score.argmax(axis=0)
    places = np.arange(len(a.n))
    top = score[places, best]
    second = np.partition(score, -2, axis=1)[:, -2] if len(b.n) > 1 else 0
    return [(i, int(best[i])) for i in np.flatnonzero((top >= 0.35) & (back[best] == places) & (second < 0.7 * top)).tolist()]


def decode(ratio: np.ndarray, span: np.ndarray) -> list[tuple[int, int]]:
    """The likeliest path: ``ratio[i, j]`` for state i, ``span[i, j]`` for states i and i + 1 together. Gives the pairs.

    A jump's cost depends on its distance alone, so of all states only those can be left that score, but for the dearest
    jump, as high as the best one; each place keeps the best of them. Exact; memory grows with places x sentences.
    """
    n, m = ratio.shape
    if not n or not m:
        return []
    places, jump, last, stay, every = _states(n) if n <= 85 else _states.__wrapped__(n)
    reach = float(jump.max() - jump.min())
    begin = -0.5 - 0.25 * places
    score = np.concatenate([begin + ratio[:, 0], begin[: n - 1] + span[:, 0] - 1.5, np.where(places == 0, -1.2, -np.inf), [-np.inf]])
    kind = np.int32 if 3 * n > 32767 else np.int16
    back, back_null = np.zeros((m, n), dtype=kind), np.zeros((m, n), dtype=kind)
    for j in range(1, m):
        if every is not None:  # few states: all at once
            total = score[:-1, None] + every
            came = total.argmax(axis=0)
            best = total[came, places]
        else:
            some = np.flatnonzero(score >= score.max() - reach - 1e-9)
            best, came = np.full(n, -np.inf), np.zeros(n, dtype=np.int64)
            for a in range(0, len(some), 256):
                part = some[a : a + 256]
                total = score[part][:, None] + jump[places[None, :] - last[part][:, None] + n]
                at = total.argmax(axis=0)
                value = total[at, places]
                came = np.where(value > best, part[at], came)
                best = np.maximum(value, best)
        ends = score[stay]
        which = ends.argmax(axis=0)
        back[j], back_null[j] = came, stay[which, places]
        score[:n] = best + ratio[:, j]
        score[n : 2 * n - 1] = best[: n - 1] + span[:, j] - 1.5
        score[2 * n - 1 : -1] = ends[which, places] - 1.2
    at = int(score.argmax())
    out = []
    for j in range(m - 1, -1, -1):
        if at < n:
            out.append((at, j))
            place, null = at, False
        elif at < 2 * n - 1:
            out += [(at - n, j), (at - n + 1, j)]
            place, null = at - n, False
        else:
            place, null = at - 2 * n + 1, True
        at = int((back_null if null else back)[j, place])
    return out[::-1]


@lru_cache(128)
def _states(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """Of ``n`` sentences: their places, the costs of jumps, the place each state ends at, the states that end at each place (the last state of all, which never holds, where there is none), and the costs between few states."""
    places = np.arange(n)
    last = np.r_[places, np.arange(1, n), places]  # of singles, spans, and nothing after each place
    d = np.arange(-n, n + 1)
    jump = np.where(d == 1, -0.5, np.where(d == 0, -2.0, -2.2 - 0.5 * np.log(np.abs(d) + 1)))
    stay = np.full((3, n), -1)  # what ends at a place: its single state, the span before it, nothing after it
    stay[0], stay[1, 1:], stay[2] = places, np.arange(n, 2 * n - 1), np.arange(2 * n - 1, 3 * n - 1)
    return places, jump, last, stay, jump[places[None, :] - last[:, None] + n] if len(last) <= 256 else None


def align(a: list[str], b: list[str], forth: Table, backward: Table) -> list[tuple[int, int]]:
    """Pairs ``(i, j)`` of corresponding sentences of two versions."""
    return align_tokens([tokens(s) for s in a], [tokens(s) for s in b], forth, backward)


def align_tokens(ta: list[list[str]], tb: list[list[str]], forth: Table, backward: Table, lexicon: Lexicon | None = None) -> list[tuple[int, int]]:
    """``align`` of sentences as their tokens."""
    if not ta or not tb:
        return []
    lexicon = Lexicon() if lexicon is None else lexicon
    a, b = lexicon.code(ta), lexicon.code(tb)
    r, r2 = forth.single_and_span(a, b, lexicon)
    q, q2 = backward.single_and_span(b, a, lexicon)
    found = sorted(set(decode(r, r2)) | {(i, j) for j, i in decode(q, q2)})
    if not found:
        return []
    i, j = np.array(found).T
    there, back = r[i, j] / forth.perfect(b, lexicon)[j], q[j, i] / backward.perfect(a, lexicon)[i]
    na, nb = ([{t for t in s if t[0] == "#"} for s in side] for side in (ta, tb))
    return [(i, j) for (i, j), x, y in zip(found, there.tolist(), back.tolist(), strict=True) if borne_out(na[i], nb[j], x, y)]


def borne_out(na: set[str], nb: set[str], there: float, back: float) -> bool:
    """Whether two sentences, one perhaps within the other, say the same: by their shares and their numbers ``na, nb``.

    Numbers agree if most of one sentence's are the other's; then little more is asked. Where one has none the words
    must do, and where both have and disagree the words must leave no doubt.
    """
    best = max(there, back)
    if na and nb:
        shared = len(na & nb)
        return best > (AGREED if shared >= 0.6 * min(len(na), len(nb)) else DISAGREED)
    return best > WORDS


def side_of(sentences: list[str]) -> str | None:
    """zh or en, by most of the sentences; None if neither prevails."""
    zh = en = 0
    for s in sentences:
        plain = s if s.isascii() else s.translate(_QUOTES)
        if plain.isascii():
            en += 2 * (len(plain) - len(plain.encode().translate(None, _LATIN))) > len(plain)
        else:
            zh += 3 * len(_NO_HAN.sub("", s)) > len(s) and not _KANA_HANGUL.search(s)
    return None if zh == en else "zh" if zh > en else "en"


_LATIN = string.ascii_letters.encode()
_QUOTES = str.maketrans("“”‘’–—…", "\"\"''--.")


def versions(df: DataFrame, id_col: str, text_col: str, type_col: str, url_col: str, model: lg.LanguageModel) -> DataFrame:
    """``id, key, side, class, starts, sentences`` of every record that shares its url, less the language, with another.

    A sentence is its tokens with blanks between them; records of one class have equal ones at equal places.
    """
    @F.pandas_udf("string")
    def key(urls: pd.Series) -> pd.Series:
        return urls.map(lambda u: lg.without_language(u))

    keyed = df.where(F.col(url_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), key(F.col(url_col)).alias("key"), F.col(text_col).alias("text"), F.col(type_col).alias("kind"))
    shared = cut(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "shared")
    if shared.count() <= MOST_KEYS:  # else the texts are shuffled
        shared = F.broadcast(shared)
    some = keyed.join(shared, "key", "left_semi")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, k, t, spans in zip(b["id"], b["key"], b["text"], model.sentences(list(zip(b["text"], b["kind"], strict=True))), strict=True):
                found = [t[a:z] for a, z in spans]
                if side := side_of(found):
                    rows.append((i, k, side, [a for a, _ in spans], [" ".join(tokens(s)) for s in found]))
            yield pd.DataFrame(rows, columns=["id", "key", "side", "starts", "sentences"])

    out = some.mapInPandas(read, "id long, key string, side string, starts array<int>, sentences array<string>")
    return cut(out.withColumn("class", F.xxhash64("starts", "sentences")), "versions")


def aligned(df: DataFrame, id_col: str = "ext_id", text_col: str = "text", type_col: str = "source_type", url_col: str = "url", model: lg.LanguageModel | None = None) -> DataFrame:
    """``id_1, start_1, id_2, start_2`` of each pair of corresponding sentences of a zh and an en version, ``id_1 < id_2``.

    Null urls, null and blank texts, residue records and pages of one version give no rows. Repeated rows of a page are
    versions of their own, with the pairs of their class.
    """
    model = model or lg.fit_body(df, id_col, text_col, type_col)
    v = versions(df, id_col, text_col, type_col, url_col, model)
    one = v.groupBy("key", "side", "class").agg(F.first("starts").alias("starts"), F.first("sentences").alias("sentences"))
    side = lambda d, s, n: d.where(F.col("side") == s).drop("side").select("key", *(F.col(c).alias(c + n) for c in d.columns if c not in ("key", "side")))
    pairs = cut(side(one, "zh", "_z").join(side(one, "en", "_e"), "key"), "pairs")

    forth, backward = fit_pairs(pairs.select("sentences_z", "sentences_e"))

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon()
        for b in batches:
            rows = []
            for k, cz, ce, sz, se, z, e in zip(b["key"], b["class_z"], b["class_e"], b["starts_z"], b["starts_e"], b["sentences_z"], b["sentences_e"], strict=True):
                rows += [(k, cz, ce, int(sz[i]), int(se[j])) for i, j in align_tokens(_split(z), _split(e), forth, backward, lexicon)]
            yield pd.DataFrame(rows, columns=["key", "class_z", "class_e", "start_z", "start_e"])

    found = pairs.mapInPandas(match, "key string, class_z long, class_e long, start_z int, start_e int")
    members = v.select("id", "key", "side", "class")
    found = found.join(side(members, "zh", "_z"), ["key", "class_z"]).join(side(members, "en", "_e"), ["key", "class_e"])
    z_first = F.col("id_z") < F.col("id_e")
    pick = lambda a, b: F.when(z_first, F.col(a)).otherwise(F.col(b))
    return found.select(pick("id_z", "id_e").alias("id_1"), pick("start_z", "start_e").alias("start_1"), pick("id_e", "id_z").alias("id_2"), pick("start_e", "start_z").alias("start_2")).distinct()


def fit(pairs: list[tuple[list[str], list[str]]]) -> tuple[Table, Table]:
    """Translation tables of both directions, from anchored sentences, then once more from aligned ones; of pairs in memory."""
    tok = [([tokens(s) for s in a], [tokens(s) for s in b]) for a, b in pairs]
    lexicon = Lexicon()
    coded = [(lexicon.code(a), lexicon.code(b)) for a, b in tok]
    anchors = [(a[i], b[j]) for (a, b), c in zip(tok, coded, strict=True) for i, j in anchored(*c, lexicon)]
    forth, backward = fit_table(anchors), fit_table([(t, s) for s, t in anchors])
    again = [(a[i], b[j]) for (a, b), c in zip(tok, coded, strict=True) for i, j in mutual(*c, forth, backward, lexicon)]
    return (fit_table(again), fit_table([(t, s) for s, t in again])) if len(again) > len(anchors) // 4 else (forth, backward)


def mutual(a: Coded, b: Coded, forth: Table, backward: Table, lexicon: Lexicon) -> list[tuple[int, int]]:
    """Sentence pairs that are each other's best by the mean of both ratios, if that is high enough."""
    both = (forth.ratios(a, b, lexicon) + backward.ratios(b, a, lexicon).T) / 2
    if not both.size:
        return []
    best, back = both.argmax(axis=1), both.argmax(axis=0)
    places = np.arange(len(best))
    return [(i, int(best[i])) for i in np.flatnonzero((both[places, best] > LEAST) & (back[best] == places)).tolist()]


def _split(sentences: Iterable[str]) -> list[list[str]]:
    return [s.split() for s in sentences]


def fit_pairs(pairs: DataFrame) -> tuple[Table, Table]:
    """``fit`` over all rows of ``sentences_z, sentences_e`` (tokens with blanks between them), in the executors."""
    spark = pairs.sparkSession

    def through(which: Callable[[Coded, Coded, Lexicon], list[tuple[int, int]]]) -> DataFrame:
        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            lexicon = Lexicon()
            for b in batches:
                yield pd.DataFrame([(z[i], e[j]) for z, e in zip(b["sentences_z"], b["sentences_e"], strict=True) for i, j in which(lexicon.code(_split(z)), lexicon.code(_split(e)), lexicon)], columns=["z", "e"])

        return cut(pairs.mapInPandas(each, "z string, e string"), "anchors")

    anchors = through(anchored)
    forth, backward = fitted(anchors)
    again = through(lambda a, b, lexicon: mutual(a, b, forth, backward, lexicon))
    if again.count() > anchors.count() // 4:
        forth, backward = fitted(again)
    release(spark, slice(-2, None))
    return forth, backward


def _plain(sentences: Iterable[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The different words that are no numbers; which of them stand in which sentence, once each, by sentences; how often each stands in all."""
    lexicon = Lexicon()
    c = lexicon.code(_split(sentences))
    word = np.flatnonzero(lexicon.signs()[: len(lexicon.names)] & 1 == 0)
    number = np.full(len(lexicon.names), -1)
    number[word] = np.arange(len(word))
    flat, at = number[c.words], c.places()
    at, flat = at[flat >= 0], flat[flat >= 0]
    once = np.unique(at * len(word) + flat)
    return [lexicon.names[i] for i in word.tolist()], once % max(1, len(word)), once // max(1, len(word)), np.bincount(flat, minlength=len(word))


def _dense(a: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """``np.unique`` with the places, of numbers below ``most``."""
    some = np.zeros(most, dtype=bool)
    some[a] = True
    return np.flatnonzero(some), (np.cumsum(some) - 1)[a]


def _blocks(work: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Of each word its block, by the pairs it has, and of each block the number of its parts: one, or several of a word by itself."""
    block, parts, room = [], [], 0
    for n in work:
        if n > room:
            parts.append(-(-n // BLOCK))
            room = BLOCK if n <= BLOCK else 0
        room -= min(n, room)
        block.append(len(parts) - 1)
    return np.array(block, dtype=np.int64), np.array(parts, dtype=np.int64)


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of each start, so many places from there on."""
    return np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)


def _narrow(most: int) -> type:
    return np.uint16 if most <= 1 << 16 else np.int32


def _expected(v: int, w: int, n_s: np.ndarray, s: np.ndarray, n_t: np.ndarray, t: np.ndarray, weigh: Callable[[np.ndarray], np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """Expected counts of a row's pairs of words, and the pairs as ``source * w + target``; ``weigh`` gives their probabilities.

    ``s, t``: places of the sources and targets of each sentence pair, ``n_s, n_t`` of them, with ``n_s`` ascending; ``v, w``: how
    many there are. Sentences of one length are read as a matrix.
    """
    size = np.repeat(n_s, n_t)
    pair, share = np.empty(int(size.sum(dtype=np.int64)), dtype=np.int64), np.empty(len(size))
    begin = s.astype(np.int64) * w
    first, first_t = np.r_[0, np.cumsum(n_s, dtype=np.int64)], np.r_[0, np.cumsum(n_t, dtype=np.int64)]
    parts, at = [], 0
    edges = np.flatnonzero(np.r_[True, np.diff(n_s) != 0, True])
    for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        k, some = int(n_s[a]), slice(int(first_t[a]), int(first_t[z]))
        part = pair[at : at + k * (some.stop - some.start)].reshape(-1, k)
        np.add(np.repeat(begin[first[a] : first[z]].reshape(-1, k), n_t[a:z], axis=0), t[some, None], out=part)
        parts.append((some, k, slice(at, at + part.size)))
        at += part.size
    if v * w <= 2 * len(pair):
        keys = np.arange(v * w)
    else:
        keys, pair = np.unique(pair, return_inverse=True)
    if weigh is None:
        return np.bincount(pair, np.repeat(1 / size, size), minlength=len(keys)), keys
    p = weigh(keys)
    for some, k, cells in parts:
        share[some] = 1 / p[pair[cells]].reshape(-1, k).sum(axis=1)
    return p * np.bincount(pair, np.repeat(share, size), minlength=len(keys)), keys


def _keys(v: int, w: int, n_s: np.ndarray, s: np.ndarray, n_t: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The pairs ``_expected`` counts."""
    return np.arange(v * w) if v * w <= 2 * int((n_s.astype(np.int64) * n_t).sum()) else _expected(v, w, n_s, s, n_t, t, None)[1]


def _packed(c: np.ndarray) -> bytes:
    """Counts, most of them perhaps nothing: which are more, and these."""
    some = c > 0
    return np.packbits(some).tobytes() + c[some].tobytes()


def _unpacked(b: bytes, n: int) -> np.ndarray:
    bits = -(-n // 8)
    out = np.zeros(n)
    out[np.unpackbits(np.frombuffer(b, dtype=np.uint8, count=bits), count=n).view(bool)] = np.frombuffer(b, offset=bits)
    return out


_ROW = "d int, block int, part int, word int, vs binary, ws binary, n_s binary, s binary, n_t binary, t binary, c binary, v array<int>, z array<double>"


def fitted(found: DataFrame) -> tuple[Table, Table]:
    """``fit_table`` from z to e and from e to z over all rows of ``z, e``.

    Rows hold blocks of words with all sentences that have them, so all counts of a translation are in its row; a word of
    more than ``BLOCK`` pairs is dealt to several rows, and its counts are added up between rounds. The driver holds what
    grows with the vocabulary: words, the total of each, the likely translations, and the counts of words so dealt.
    Sums are taken in an order of the sentences' own, so the layout changes nothing.
    """
    spark = found.sparkSession

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            read = [_plain(b[c]) for c in "ze"]
            size = [np.bincount(at, minlength=len(b)) for _, _, at, _ in read]
            parts = [pd.DataFrame({"k": k, "w": names, "n": n, "work": np.bincount(word, size[1 - k][at], minlength=len(names)).astype(np.int64)}) for k, (names, word, at, n) in enumerate(read)]
            yield pd.concat(parts)

    words: tuple[list, list] = ([], [])
    for r in sorted(found.mapInPandas(counted, "k int, w string, n long, work long").groupBy("k", "w").agg(F.sum("n").alias("n"), F.sum("work").alias("work")).collect()):
        words[r.k].append(r)
    totals = [sum(r.n for r in x) for x in words]
    back = [{r.w: r.n / totals[k] for r in x} for k, x in enumerate(words)]
    if not any(r.work for r in words[0]):
        return Table({}, back[1]), Table({}, back[0])
    ids = [{r.w: i for i, r in enumerate(x)} for x in words]
    block, parts = zip(*(_blocks([r.work for r in words[1 - d]]) for d in (0, 1)), strict=True)
    most = [len(x) for x in words]
    wide = [_narrow(n) for n in most]

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            key = np.array([hash64(f"{z}\t{e}") for z, e in zip(b["z"], b["e"], strict=True)], dtype=np.int64)
            size, flat = [], []
            for k, c in enumerate("ze"):
                names, word, at, _ = _plain(b[c])
                word = np.array([ids[k][w] for w in names], dtype=np.int64)[word]
                flat.append(word[np.argsort(at * len(ids[k]) + word)])
                size.append(np.bincount(at, minlength=len(b)))
            rows = []
            for d in (0, 1):
                of = np.repeat(np.arange(len(key)), size[1 - d])
                has = size[d][of] > 0
                of, t = of[has], flat[1 - d][has]
                where = block[d][t]
                part = key[of] % np.maximum(parts[d][where], 1)
                order = np.lexsort((of, part, where))
                of, t, where, part = of[order], t[order], where[order], part[order]
                edges = np.flatnonzero(np.r_[True, (np.diff(where) != 0) | (np.diff(part) != 0)]) if len(of) else np.zeros(0, dtype=np.int64)
                first = np.cumsum(size[d]) - size[d]
                for a, z in zip(edges.tolist(), [*edges[1:].tolist(), len(of)], strict=False):
                    u, n_t = np.unique(of[a:z], return_counts=True)
                    s = flat[d][_ranges(first[u], size[d][u])]
                    rows.append((d, int(where[a]), int(part[a]), key[u].tobytes(), size[d][u].astype(np.int32).tobytes(), s.astype(wide[d]).tobytes(), n_t.astype(np.int32).tobytes(), t[a:z].astype(wide[1 - d]).tobytes()))
            yield pd.DataFrame(rows, columns=["d", "block", "part", "key", "n_s", "s", "n_t", "t"])

    def gather(b: pd.DataFrame) -> pd.DataFrame:
        d, k, part = (int(b[c].iloc[0]) for c in ("d", "block", "part"))
        read = lambda c, kind: np.frombuffer(b"".join(b[c]), dtype=kind)
        key, n_s, n_t = read("key", np.int64), read("n_s", np.int32).astype(np.int64), read("n_t", np.int32).astype(np.int64)
        order = np.lexsort((key, n_s))
        vs, s = _dense(read("s", wide[d])[_ranges((np.cumsum(n_s) - n_s)[order], n_s[order])], most[d])
        ws, t = _dense(read("t", wide[1 - d])[_ranges((np.cumsum(n_t) - n_t)[order], n_t[order])], most[1 - d])
        word = int(ws[0]) if parts[d][k] > 1 else -1
        row = (d, k, part, word, vs.astype(np.int32), ws.astype(np.int32), n_s[order].astype(np.int32), s.astype(_narrow(len(vs))), n_t[order].astype(np.int32), t.astype(_narrow(len(ws))))
        return pd.DataFrame([(*row[:4], *(x.tobytes() for x in row[4:]), None, None, None)], columns=[x.split()[0] for x in _ROW.split(", ")])

    rows = cut(found.mapInPandas(spread, "d int, block int, part int, key binary, n_s binary, s binary, n_t binary, t binary").groupBy("d", "block", "part").applyInPandas(gather, _ROW), "em")
    total: list[np.ndarray] = []  # of each direction and source, after each round
    dealt: dict[tuple[int, int], np.ndarray] = {}

    def probabilities(d: int, word: int, vs: np.ndarray, w: int, c: bytes) -> Callable[[np.ndarray], np.ndarray]:
        """Of pairs of a row, after the last round."""
        def weigh(keys: np.ndarray) -> np.ndarray:
            source = vs[keys // w]
            return (dealt[d, word][source] if word >= 0 else _unpacked(c, len(keys))) / np.maximum(total[d][source], 1e-300)

        return weigh

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = []
            for i in range(b.num_rows):
                read = lambda c, kind=np.int32: np.frombuffer(b.column(c)[i].as_buffer(), dtype=kind)  # noqa: B023, E731
                vs, ws = read("vs"), read("ws")
                d, word, c = b.column("d")[i].as_py(), b.column("word")[i].as_py(), b.column("c")[i]
                weigh = probabilities(d, word, vs, len(ws), c.as_buffer() if c.is_valid else b"") if total else None
                c, keys = _expected(len(vs), len(ws), read("n_s"), read("s", _narrow(len(vs))), read("n_t"), read("t", _narrow(len(ws))), weigh)
                some.append((_packed(c), vs, np.bincount(keys // len(ws), c, minlength=len(vs))))
            ends = np.cumsum([0, *(len(vs) for _, vs, _ in some)], dtype=np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([x[k] for x in some] or [np.zeros(0)]).astype(kind))) for k, kind in ((1, np.int32), (2, np.float64))]
            yield pa.RecordBatch.from_arrays([*b.columns[:10], pa.array([c for c, _, _ in some], pa.binary()), *lists], names=b.schema.names)

    for _ in range(ROUNDS):
        rows = cut(rows.mapInArrow(turn, _ROW), "em")
        release(spark, slice(-2, -1))
        each = rows.select("d", "word", "block", "part", F.explode(F.arrays_zip("v", "z")).alias("x")).select("d", "word", F.col("x.v").alias("v"), F.struct("block", "part", F.col("x.z").alias("z")).alias("x"))
        sums = each.groupBy("d", "word", "v").agg(F.aggregate(F.array_sort(F.collect_list("x")), F.lit(0.0), lambda a, x: a + x["z"]).alias("z")).toPandas().sort_values(["d", "word", "v"])
        total = [np.bincount(x["v"], x["z"], minlength=len(words[d])) for d in (0, 1) for x in [sums[sums["d"] == d]]]
        dealt = {k: np.bincount(x["v"], x["z"], minlength=len(words[k[0]])) for k, x in sums[sums["word"] >= 0].groupby(["d", "word"])}

    def likely(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                vs, ws = np.frombuffer(r.vs, dtype=np.int32), np.frombuffer(r.ws, dtype=np.int32)
                n_s, n_t = np.frombuffer(r.n_s, dtype=np.int32), np.frombuffer(r.n_t, dtype=np.int32)
                keys = _keys(len(vs), len(ws), n_s, np.frombuffer(r.s, dtype=_narrow(len(vs))), n_t, np.frombuffer(r.t, dtype=_narrow(len(ws))))
                p = probabilities(r.d, r.word, vs, len(ws), r.c)(keys)
                k = np.flatnonzero(p > LIKELY)
                yield pd.DataFrame({"d": r.d, "v": vs[keys[k] // len(ws)], "w": ws[keys[k] % len(ws)], "p": p[k]})

    tables: list[dict[str, dict[str, float]]] = [{}, {}]
    for r in sorted(rows.mapInPandas(likely, "d int, v int, w int, p double").collect()):
        tables[r.d].setdefault(words[r.d][r.v].w, {})[words[1 - r.d][r.w].w] = r.p
    release(spark, slice(-1, None))
    return Table(tables[0], back[1]), Table(tables[1], back[0])
