"""Problem 10: text garbled by a wrong decoding.

Three stages. (1) The document frequency of every non-ASCII character over the whole corpus: right text of any script is
made of characters that many documents share, garbled text is not. (2) Lines with signs of a wrong decoding are joined
with clean lines that agree on the text stripped of non-ASCII characters, or on its digits alone (bytes of the double-byte
encodings may be ASCII letters, never digits), all different lines of each kind per key; each pair of near-twins is aligned byte by byte under all
of Python's encodings, and the transformations (shown as, was really) that turn the clean line into the garbled one are
counted. (3) The learned transformations, those with most support first, are applied to all suspicious records, and to
every record if one of them is not among the fixed ones below; a span counts as garbled if undoing one yields plausible
text. The fixed lists are tried besides what was learned, for garbled text that has no clean twin. A transformation that
no pair of Python's encodings describes is not learned.

Single-byte views are found by the shape of multi-byte sequences in that view, confirmed by what they decode to; double-
byte views by runs of characters that are rare in the corpus and become common when undone. Characters lost for good
(U+FFFD) and control characters (U+0080 to U+009F) mark a record as garbled even where it cannot be restored.
"""

from __future__ import annotations

import codecs
import encodings
import pkgutil
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import codepoints, cut
from .forest import CHARS, spans_hashed

#: A character is common if this share of the documents holds it (and at least two do).
COMMON_SHARE = 0.003
#: Digits two lines must agree on to be near-twins.
TWIN_DIGITS = 6
#: ASCII letters and digits two lines must agree on to be near-twins, where no digits tell.
TWIN_LETTERS = 24
#: Keys of garbled lines that are sent to every task at most (8 bytes each).
MOST_KEYS = 500_000
#: Sets of transformations that reach the driver at once at most; of more, the support is added up where they are.
MOST_SETS = 1000
#: Pairs of lines that must agree on a transformation outside the fixed lists.
LEAST_TWINS = 2
#: Different characters of a garbled line that bear out such a transformation.
LEAST_CHARACTERS = 2

#: Encodings text may have been shown in, and those it may really have been in.
SINGLE = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "koi8-r")
DOUBLE = ("gbk", "big5", "cp949", "cp932")
REAL = ("utf-8", "big5", "gbk", "cp932", "cp949")


#: The fixed transformations.
FIXED = tuple((v, r) for v in (*DOUBLE, *SINGLE) for r in REAL if v != r)


@lru_cache(None)
def _codecs() -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Python's encodings that keep ASCII as it is: those of one byte a character, and the others; the fixed ones first."""
    one, more = list(SINGLE), [*REAL]
    known = {codecs.lookup(x).name for x in (*one, *more)}
    for name in sorted(m.name for m in pkgutil.iter_modules(encodings.__path__)):
        if name in _NO_VIEW or name.startswith("iso2022"):
            continue
        try:
            found = codecs.lookup(name)
            if not found._is_text_encoding or found.name in known or _ASCII_TEXT.encode(name) != _ASCII_TEXT.encode("ascii"):
                continue
            known.add(found.name)
            shown = bytes(range(128, 256)).decode(name, "replace")
            (one if len(shown) == 128 and all(len(c.encode(name)) == 1 for c in shown if c != "\ufffd") else more).append(name)
        except (LookupError, UnicodeError):
            continue
    return tuple(one), tuple(more)


_NO_VIEW = ("ascii", "charmap", "hz", "idna", "punycode", "raw_unicode_escape", "unicode_escape", "undefined", "utf_7")
_ASCII_TEXT = "".join(map(chr, range(32, 127)))


@lru_cache(None)
def _single(view: str) -> bool:
    return view in _codecs()[0]


@lru_cache(None)
def _table(view: str) -> dict[int, str]:
    """Characters of a single-byte view by byte; bytes the view does not define show as control characters."""
    return {b: bytes([b]).decode(view, "replace").replace("�", chr(b)) for b in range(128, 256)}


@lru_cache(None)
def _bytes(view: str) -> dict[int, int]:
    return {ord(c): b for b, c in reversed(sorted(_table(view).items()))} | ({c: c for c in range(128, 160) if chr(c) in _table(view).values()})


@lru_cache(None)
def _utf8_shape(view: str) -> re.Pattern:
    """Multi-byte sequences of UTF-8, as the view shows them."""
    t = _table(view)
    cls = lambda a, b: "[" + "".join(re.escape(t[x]) for x in range(a, b + 1)) + "]"
    cont = cls(0x80, 0xBF)
    return re.compile(f"(?:{cls(0xC2, 0xDF)}{cont}|{cls(0xE0, 0xEF)}{cont}{{2}}|{cls(0xF0, 0xF4)}{cont}{{3}})+")


@lru_cache(None)
def _quick(views: tuple[str, ...] = SINGLE) -> re.Pattern:
    """A first and a second byte of a multi-byte sequence, as any view shows them: no text without it has one."""
    cls = lambda a, b: "[" + "".join(re.escape(c) for c in sorted({_table(v)[x] for v in views for x in range(a, b + 1)})) + "]"
    return re.compile(cls(0xC2, 0xF4) + cls(0x80, 0xBF))


def encode_view(text: str, view: str) -> bytes | None:
    """The bytes that ``view`` shows as ``text``."""
    if not _single(view):
        try:
            return text.encode(view)
        except UnicodeEncodeError:
            return None
    table = _bytes(view)
    try:
        return bytes(ord(c) if c < "\x80" else table[ord(c)] for c in text)
    except (KeyError, ValueError):
        return None


#: Letters of west and north European languages and Vietnamese, punctuation, symbols, CJK, kana, Hangul, Thai, full-width forms.
_PLAUSIBLE = re.compile(
    r"[\x20-\x7e\xa0-\xff\n\tŌōŒœŠšŸŽžĂăĐđĨĩŨũƠơƯưƒˆ˜͘Ạ-ỹΑ-ω"
    r"‐-‧‰-‾⁰-ₜ₠-₿℀-↏←-⋿①-⓿─-⛿　-〿ぁ-ヿㄅ-ㄯ一-鿿가-힣ก-๛！-￦]*"
)


def plausible(text: str) -> bool:
    return _PLAUSIBLE.fullmatch(text) is not None


_HIGH_RUN = re.compile(r"[\x80-\xffŒœŠšŽžŸƒˆ˜–—‘-•…‰‹›€™]{4,}")
_HIGH_PART = re.compile(r"[^\x00-\x7f]+")
_LOST = re.compile(r"[�\x80-\x9f]")
#: Characters the double-byte views show; those of the second class count as signs of a language, the others (full-width forms, punctuation) do not.
_WIDE_RUN = re.compile(r"[Α-ωЁ-ё‐-⋿─-◿　-鿿가-힣-￮]+")
_NEUTRAL = re.compile(r"[‐-‿　-〟＀-｠￠-￦]")


class Doctor:
    """Finds and undoes wrong decodings in a text. ``common``: characters many documents share; ``learned``: transformations by support."""

    def __init__(self, common: set[str], learned: list[tuple[str, str]] = ()):
        self.common = common
        self.chains = [*learned, *(c for c in FIXED if c not in set(learned))]
        self.shapes = [(v, _utf8_shape(v)) for v in dict.fromkeys([*(v for v, r in self.chains if r == "utf-8" and _single(v))])]
        self.quick = _quick(tuple(v for v, _ in self.shapes))
        self.doubles = [(v, r) for v, r in self.chains if not _single(v)]
        self.blocks = [(v, r) for v, r in self.chains if _single(v) and r != "utf-8"]
        self.others = [(v, r) for v, r in learned if (v, r) not in FIXED and _single(v) and r != "utf-8"]
        self.signs = frozenset(c for v, _ in self.others for c in _table(v).values()).difference(common)

    def suspicious(self, text: str) -> bool:
        """Whether ``mend`` can find anything at all in the text."""
        if text.isascii():
            return False
        odd = set(text).difference(self.common, _ASCII)
        return _LOST.search(text) is not None or self.rare("".join(odd)) >= 2 or not self.signs.isdisjoint(odd) or self.quick.search(text) is not None or _HIGH_RUN.search(text) is not None

    def rare(self, text: str) -> int:
        return sum(c not in self.common and not _NEUTRAL.match(c) for c in text if c > "\x7f")

    def mend(self, line: str) -> tuple[str, list[tuple[str, str]], bool]:
        """The line restored as far as possible, the transformations undone, and whether it was garbled."""
        used: list[tuple[str, str]] = []
        bad = _LOST.search(line) is not None
        seen = {line}
        while not line.isascii():  # text may have been garbled more than once
            if self.quick.search(line):
                line = self._shapes(line, used)
            if self.others and not self.signs.isdisjoint(line):
                line = self._others(line, used)
            line = self._high(line, used)
            if self.rare(line) >= 2:
                line = self._wide(line, used)
            if line in seen:
                break
            seen.add(line)
        return line, used, bad or bool(used)

    def _shapes(self, line: str, used: list) -> str:
        for view, shape in self.shapes:
            def undo(m: re.Match, view: str = view) -> str:
                raw = encode_view(m[0], view)
                try:
                    got = raw.decode("utf-8") if raw else ""
                except UnicodeDecodeError:
                    return m[0]
                if not got or not plausible(got) or (view not in ("cp1252", "latin-1") and not self._likely(got, m[0])) or (len(m[0]) < 8 and _HIGH_RUN.search(line) and self.rare(got)):
                    return m[0]
                used.append((view, "utf-8"))
                return got
            line = shape.sub(undo, line)
        return line

    def _others(self, line: str, used: list) -> str:
        """Learned transformations undone where that makes a rare character common and no character rare."""
        def undo(m: re.Match) -> str:
            for view, real in self.others:
                raw = encode_view(m[0], view)
                try:
                    got = raw.decode(real) if raw else ""
                except UnicodeDecodeError:
                    continue
                if not got or got == m[0]:
                    continue
                if len(got) == len(m[0]):
                    changed = [(was, c) for was, c in zip(m[0], got, strict=True) if was != c]
                else:
                    changed = [(was, c) for was in m[0] for c in got]
                if all(c in self.common for _, c in changed) and any(was not in self.common for was, _ in changed):
                    used.append((view, real))
                    return got
            return m[0]
        return _HIGH_PART.sub(undo, line)

    def _likely(self, got: str, was: str) -> bool:
        """Undoing made the characters of this span more common."""
        return self.rare(got) / len(got) < self.rare(was) / len(was) or (self.rare(got) == 0 and len(was) > 2)

    def _high(self, line: str, used: list) -> str:
        """Undoes every run of high characters, from the left; what a run becomes is not looked at again."""
        at = 0
        while m := _HIGH_RUN.search(line, at):
            at = m.end()
            if len(set(m[0])) < 3 or sum("\xa1" <= c <= "\xff" for c in m[0]) < 3:
                continue
            best = None
            for view, real in self.blocks:
                start, end = self._stretch(line, m.start(), m.end(), view)
                raw = encode_view(line[start:end], view)
                if not raw:
                    continue
                got = raw.decode(real, "replace")
                han = sum(c in self.common for c in got if c > "\x7f")
                score = han / max(1, sum(c > "\x7f" for c in got))
                if score > 0.6 and (best is None or (han, score) > best[0]):  # what restores most
                    best = ((han, score), start, end, got, (view, real))
            if best:
                used.append(best[4])
                line = line[: best[1]] + best[3] + line[best[2] :]
                at = max(best[1] + len(best[3]), best[1] + 1)
            else:
                used.append((_UNKNOWN, _UNKNOWN))
        return line

    @staticmethod
    def _stretch(line: str, a: int, b: int, view: str) -> tuple[int, int]:
        table = _bytes(view)
        ok = lambda c: c < "\x80" or ord(c) in table
        while a > 0 and ok(line[a - 1]):
            a -= 1
        while b < len(line) and ok(line[b]):
            b += 1
        return a, b

    def _wide(self, line: str, used: list) -> str:
        spans = [(m.start(), m.end()) for m in _WIDE_RUN.finditer(line)]
        for a, b in reversed(spans):
            run = line[a:b]
            if self.rare(run) < 2:
                continue
            for part_a, part_b in self._rare_parts(run):
                part = run[part_a:part_b]
                odd = self.rare(part)
                if len(part) < 3 or odd < 2 or 2 * odd < len(part):
                    continue
                best = None
                for view, real in self.doubles:
                    raw = encode_view(part, view)
                    if raw is None:
                        raw = part.encode(view, "ignore")
                        if len(raw) < 1.4 * len(part):
                            continue
                    got = raw.decode(real, "replace")
                    wide = [c for c in got if c > "\x7f"]
                    good = sum(c in self.common for c in wide)
                    if good >= 3 and good >= 0.7 * len(wide) and (best is None or good / len(wide) > best[0]):
                        best = (good / len(wide), got, (view, real))
                if best:
                    used.append(best[2])
                    run = run[:part_a] + best[1] + run[part_b:]
            line = line[:a] + run + line[b:]
        return line

    def _rare_parts(self, run: str) -> list[tuple[int, int]]:
        """Maximal parts of a run in which rare characters prevail, last first."""
        score, out, start, best, best_at = 0, [], 0, 0, 0
        for i, c in enumerate(run):
            score += -1 if c in self.common else not _NEUTRAL.match(c)
            if score <= 0:
                if best >= 2:
                    out.append((start, best_at))
                score, start, best = 0, i + 1, 0
            elif score > best:
                best, best_at = score, i + 1
        if best >= 2:
            out.append((start, best_at))
        return out[::-1]


_UNKNOWN = "unknown"


def _rare(text: str, common: set[str]) -> int:
    return sum(c > "\x7f" and c not in common for c in text)


def alphabet(docs: DataFrame, text_col: str) -> set[str]:
    """Non-ASCII characters that at least ``COMMON_SHARE`` of all documents hold, counted over whole texts.

    The counts are added up per batch before the shuffle; at most one row per code point reaches the driver.
    """
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        n = 0
        for b in batches:
            for t in b["text"]:
                n += 1
                if not t.isascii():
                    total.update(set(t))
        rows = [(ord(c), k) for c, k in total.items() if c > "\x7f"]
        yield pd.DataFrame([(-1, n), *rows], columns=["c", "n"])

    counted = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text")).mapInPandas(count, "c int, n long").groupBy("c").agg(F.sum("n").alias("n"))
    found = {r.c: r.n for r in counted.toLocalIterator()}  # bounded by the number of code points
    least = max(2, COMMON_SHARE * found.pop(-1, 0))
    return {chr(c) for c, n in found.items() if n >= least and not 0xE000 <= c <= 0xF8FF and c != 0xFFFD and not 0x80 <= c < 0xA0}


@lru_cache(4096)
def _forms(line: str, shown: bool) -> dict[bytes, list[str]]:
    """The bytes of a line in each encoding that has all of it, with the encodings; as a view shows them, or as they are."""
    one, more = _codecs()
    out: dict[bytes, list[str]] = {}
    for name in (*one, *more) if shown else (*more, *one):
        if raw := encode_view(line, name):
            out.setdefault(raw, []).append(name)
    return out


def explained(clean: str, garbled: str) -> list[tuple[str, str]]:
    """All transformations that turn the clean line into the garbled one but for one stretch of at most a fifth of its bytes."""
    out = []
    for a, names in _forms(clean, False).items():
        for b, views in _forms(garbled, True).items():
            if a == b or _agree(a, b):
                out += [(v, r) for v in views for r in names if v != r]
    return out


def _agree(a: bytes, b: bytes) -> bool:
    short, long = sorted((len(a), len(b)))
    least = int(0.39 * long)
    # of head and tail, the longer one has two fifths
    if short < 0.8 * long or (a[:least] != b[:least] and a[len(a) - least :] != b[len(b) - least :]):
        return False
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    front = np.flatnonzero(x[:short] != y[:short])
    head = int(front[0]) if len(front) else short
    back = np.flatnonzero(x[::-1][: short - head] != y[::-1][: short - head])
    tail = int(back[0]) if len(back) else short - head
    same = np.concatenate([x[:head], x[len(x) - tail :]])
    # what agrees must hold most of what a wrong decoding touches
    return head + tail >= 0.8 * long and 2 * int((same > 127).sum()) > int((x > 127).sum())


_ORDER = {c: i for i, c in enumerate(FIXED)}


def _best(support: dict[tuple[str, str], int]) -> tuple[str, str]:
    return min(support, key=lambda c: (-support[c], _ORDER.get(c, len(_ORDER)), c))


def learn(counted: Iterable[tuple[list[str], int]]) -> list[tuple[str, str]]:
    """Of the sets of transformations that explain a pair each, with the number of pairs: the fewest that explain all, by support."""
    left = [({tuple(x.split("|")) for x in options}, n) for options, n in counted]
    out: list[tuple[str, str]] = []
    while left:
        support: Counter = Counter()
        for options, n in left:
            for c in options:
                support[c] += n
        best = _best(support)
        if best in _ORDER or support[best] >= LEAST_TWINS:
            out.append(best)
        left = [x for x in left if best not in x[0]]
    return out


def learn_from(counted: DataFrame) -> list[tuple[str, str]]:
    """``learn`` of a table ``(options, count)``. Where there are many sets only the support of each transformation reaches the driver."""
    few = counted.limit(MOST_SETS + 1).collect()
    if len(few) <= MOST_SETS:
        return learn([(r.options, r["count"]) for r in few])
    out: list[tuple[str, str]] = []
    while True:
        rows = counted.select(F.explode("options").alias("c"), "count").groupBy("c").agg(F.sum("count").alias("n")).collect()  # bounded by pairs of encodings
        support = {tuple(r.c.split("|")): r.n for r in rows}
        if not support:
            return out
        best = _best(support)
        if best in _ORDER or support[best] >= LEAST_TWINS:
            out.append(best)
        counted = counted.where(~F.array_contains("options", "|".join(best)))


@lru_cache(1024)
def _all_shown(clean: str) -> list[tuple[tuple[str, str], str]]:
    """The line as each fixed transformation shows it."""
    out = []
    for real in REAL:
        try:
            raw = clean.encode(real)
        except UnicodeEncodeError:
            continue
        for view in (*SINGLE, *DOUBLE):
            if view != real:
                out.append(((view, real), raw.decode(view, "replace") if view in DOUBLE else "".join(chr(x) if x < 128 else _table(view)[x] for x in raw)))
    return out


def _align(clean: str, garbled: str) -> tuple[str, str] | None:
    """The transformation that turns the clean line into the garbled one, if one does."""
    best = (0.6, None)
    pair = SequenceMatcher(None, "", garbled, autojunk=False)
    for chain, shown in _all_shown(clean):
        pair.set_seq1(shown)
        # the quick ratios are never below the ratio itself
        if pair.real_quick_ratio() > best[0] and pair.quick_ratio() > best[0] and (r := pair.ratio()) > best[0]:
            best = (r, chain)
    return best[1]


def line_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start, end and key of the lines with characters other than ASCII: hashes of their ASCII letters and digits, and of their digits alone, where there are enough."""
    raw = codepoints("\n".join(texts) + "\n")
    breaks = np.flatnonzero(raw == 10)
    starts = np.r_[0, breaks[:-1] + 1]
    wide = np.diff(np.searchsorted(np.flatnonzero(raw > 127), np.append(starts, len(raw)))) > 0
    doc_at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    digit = (raw >= 48) & (raw <= 57)
    line, key = [], []
    for kept, least, salt in ((np.flatnonzero(digit), TWIN_DIGITS, 0), (np.flatnonzero(digit | ((raw | 32) >= 97) & ((raw | 32) <= 122)), TWIN_LETTERS, 1)):
        begin, end = np.searchsorted(kept, starts), np.searchsorted(kept, breaks)
        some = np.flatnonzero(wide & (end - begin >= least))
        line.append(some)
        key.append(spans_hashed(raw[kept], begin, end)[some] ^ salt)
    at, key = np.concatenate(line), np.concatenate(key)
    doc = np.searchsorted(doc_at, starts[at], side="right") - 1
    return doc, starts[at] - doc_at[doc], breaks[at] - doc_at[doc], key


def keyed_lines(df: DataFrame, only: np.ndarray | None = None) -> DataFrame:
    """``id, line, skeleton`` of the keyed lines of ``(id, text)``; of those whose key is among ``only``, if it is given (sorted)."""
    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, texts = b["id"].to_numpy(), b["text"].tolist()
            at = 0
            while at < len(texts):
                n, k = len(texts[at]), at + 1
                while k < len(texts) and n + len(texts[k]) <= CHARS:
                    n += len(texts[k])
                    k += 1
                part = texts[at:k]
                doc, start, end, key = line_keys(part)
                if only is not None:
                    hit = np.flatnonzero(only[np.minimum(np.searchsorted(only, key), len(only) - 1)] == key) if len(only) else np.zeros(0, np.int64)
                    doc, start, end, key = doc[hit], start[hit], end[hit], key[hit]
                if len(doc):
                    yield pd.DataFrame({"id": ids[at + doc], "line": [part[d][a:z] for d, a, z in zip(doc.tolist(), start.tolist(), end.tolist(), strict=True)], "skeleton": key})
                at = k

    return df.select("id", "text").mapInPandas(keyed, "id long, line string, skeleton long")


def mended(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text, restored, how`` of each document with any garbled text.

    ``restored`` is the text with all that could be undone undone; ``how`` names the transformations; it is empty where
    characters are lost for good. Null, empty and clean texts give no rows; repeated rows are reported repeatedly.
    """
    spark = docs.sparkSession
    common = alphabet(docs, text_col)
    picked = docs.where(F.length(text_col) > 0).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def suspect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doctor = Doctor(common)
        for b in batches:
            rows = []
            for i, t in zip(b["id"], b["text"], strict=True):
                if doctor.suspicious(t) and any(doctor.mend(x)[2] for x in t.split("\n")):
                    rows.append((i, t, True))
                elif not t.isascii() and not common.issuperset("".join(_HIGH_PART.findall(t))):
                    odd = [x for x in t.split("\n") if not x.isascii() and not common.issuperset("".join(_HIGH_PART.findall(x)))]
                    rows.append((i, "\n".join(odd), False))
            yield pd.DataFrame(rows, columns=["id", "text", "sure"])

    # records with signs of a wrong decoding, and of the others the lines with rare characters
    odd = cut(picked.mapInPandas(suspect, "id long, text string, sure boolean"), "suspects")
    suspects = odd.where("sure").select("id", "text")

    def telling(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Lines with rare characters or found garbled; no other can be the garbled one of a pair."""
        doctor = Doctor(common)
        for b in batches:
            rare = [_rare(x, common) for x in b["line"]]
            sure = [doctor.mend(x)[2] for x in b["line"]]
            yield b.assign(rare=rare, sure=sure)[[r > 0 or s for r, s in zip(rare, sure, strict=True)]]

    lines = keyed_lines(odd).select("skeleton", "line").distinct()
    theirs = cut(lines.mapInPandas(telling, "skeleton long, line string, rare int, sure boolean").withColumnRenamed("line", "garbled"), "garbled")
    keys = theirs.select("skeleton").distinct()
    if keys.count() <= MOST_KEYS:
        ours = keyed_lines(picked, np.sort(np.array([r.skeleton for r in keys.collect()], dtype=np.int64)))
    else:  # too many to send: the lines are shuffled by their keys
        ours = keyed_lines(picked).join(keys, "skeleton", "left_semi")
    ours = ours.join(suspects.select("id"), "id", "left_anti")
    ours = ours.select("skeleton", F.col("line").alias("clean")).distinct()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    twins = ours.join(theirs, "skeleton").where("clean <> garbled").select("clean", "garbled", "rare", "sure").repartition(parts, "clean", "garbled").distinct()

    def infer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = []
            for clean, garbled, rare, sure in zip(b["clean"], b["garbled"], b["rare"], b["sure"], strict=True):
                if not sure and rare <= _rare(clean, common):
                    continue
                options = explained(clean, garbled)
                fixed = [c for c in options if c in FIXED] or ([c] if not options and (c := _align(clean, garbled)) else [])
                if not fixed and len(set(garbled) - set(clean) - _ASCII) < LEAST_CHARACTERS:
                    continue
                if fixed or options:
                    got.append((sorted({"|".join(c) for c in fixed or options}),))
            yield pd.DataFrame(got, columns=["options"])

    learned = learn_from(cut(twins.mapInPandas(infer, "options array<string>").groupBy("options").count(), "options"))

    def restore(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doctor = Doctor(common, learned)
        for b in batches:
            rows = []
            for i, t in zip(b["id"], b["text"], strict=True):
                if not doctor.suspicious(t):
                    continue
                done = [doctor.mend(x) for x in t.split("\n")]
                if any(d[2] for d in done):
                    how = sorted({f"{r} shown as {v}" for d in done for v, r in d[1] if v != _UNKNOWN})
                    rows.append((i, t, "\n".join(d[0] for d in done), how))
            yield pd.DataFrame(rows, columns=["id", "text", "restored", "how"])

    # what the fixed transformations do not show may stand in any record
    whole = suspects if set(learned).issubset(FIXED) else picked
    return whole.mapInPandas(restore, "id long, text string, restored string, how array<string>")


_ASCII = frozenset(map(chr, range(128)))
