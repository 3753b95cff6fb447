"""Many texts at once as trees of blocks and lines, held in arrays.

Texts are joined and read as code points, so that what each line says about itself (length, marks, digits, scripts,
list marks, the hash of its wording) costs a few numpy passes over the batch instead of Python per line. Lines of any
length are read whole. A batch holds about ``CHARS`` characters, or one longer text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache

import ahocorasick
import numpy as np

from . import pages
from .common import codepoints, fold, mixed

#: Characters of a batch.
CHARS = 1_000_000
WS, DIGIT, EDGE, THAI, SOLID, MARK, CLOSE, BAR, BULLET, AFTER, WORD = (1 << k for k in range(11))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LEAD = np.uint64(0x5851F42D4C957F2D)


@lru_cache(None)
def classes() -> np.ndarray:
    """Class bits of every code point."""
    t = np.zeros(0x110000, dtype=np.uint16)
    low = list(map(chr, range(0x20000)))  # no white space and no decimal digit lies above; letters there are ideographs
    for bit, test in ((WS, str.isspace), (DIGIT, str.isdecimal), (WORD, str.isalnum)):
        t[: len(low)] |= np.fromiter(map(test, low), dtype=bool, count=len(low)).astype(np.uint16) * np.uint16(bit)
    for bit, chars in ((EDGE, pages._EDGES), (MARK, ".!?。！？．…؟"), (CLOSE, "\"'”’」』）)]】》"), (BAR, pages._BAR_CHARS), (BULLET, "›．•·‧▪※●○◆■*‣»>【["), (AFTER, ")）.．、")):
        for s in chars:
            t[ord(s)] |= bit
    t[0x20000:0x3FFFE] |= WORD
    t[0x0E01:0x0E5C] |= THAI
    t[0x3040:0x3100] |= SOLID
    t[0x3400:0xA000] |= SOLID
    return t


@lru_cache(None)
def _folded_codes() -> np.ndarray:
    """What ``fold`` makes of a code point alone; 0 where it makes several of it, or where its neighbours matter."""
    t = np.arange(0x110000, dtype=np.uint32)
    for c in (*range(0x3400), *range(0xA000, 0xAC00), *range(0xD7A4, 0x10000)):  # ideographs and syllables stay as they are
        s = chr(c)
        f = fold(s)
        if len(f) != 1 or unicodedata.combining(s) or unicodedata.combining(f):
            t[c] = 0
        elif f != s:
            t[c] = ord(f)
    t[0x1100:0x1200] = t[0xA960:0xA980] = t[0xD7B0:0xD800] = 0  # parts of Korean syllables
    t[0x10000:] = 0
    return t


@lru_cache(None)
def _form_index() -> np.ndarray:
    t = np.zeros(0x110000, dtype=np.uint8)
    for k, s in enumerate(pages.FORM, 1):
        t[ord(s)] = k
    return t


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """``base`` to the powers 1 to ``n``, modulo 2^64."""
    held = _POWERS.get(int(base))
    if held is None or len(held) < n:
        held = np.multiply.accumulate(np.full(1 << max(20, n.bit_length()), base, dtype=np.uint64))
        if n <= 4 * CHARS:
            _POWERS[int(base)] = held
    return held[:n]


def said_hashes(folded: np.ndarray, cls: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hash of what each line of folded text says: white space, digits, and marks at its ends left aside; 0 if nothing.

    A line is the code points from ``starts`` to its line break. The hash is a polynomial over the characters that count:
    the difference of two sums from the batch's first character, divided by the power the line begins at.
    """
    core = np.flatnonzero((cls & (WS | DIGIT | EDGE)) == 0)
    if not len(core):
        return np.zeros(len(starts), dtype=np.int64)
    a, z = np.searchsorted(core, starts), np.searchsorted(core, np.append(starts[1:], len(folded)))
    some = np.flatnonzero(z > a)
    kept = np.flatnonzero((cls & (WS | DIGIT)) == 0)
    begin, end = np.zeros(len(starts), dtype=np.int64), np.zeros(len(starts), dtype=np.int64)
    begin[some], end[some] = np.searchsorted(kept, core[a[some]]), np.searchsorted(kept, core[z[some] - 1], side="right")
    return spans_hashed(folded[kept], begin, end)


def spans_hashed(codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each stretch of code points; 0 of an empty one."""
    total = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _powers(_STEP, len(codes)), out=total[1:])
    back = np.append(np.ones(1, np.uint64), _powers(_BACK, len(codes)))
    out = mixed((total[end] - total[begin]) * back[begin] + (end - begin).astype(np.uint64))
    return np.where(end > begin, out, np.uint64(0)).view(np.int64)


def hashes_of(strings: list[str]) -> np.ndarray:
    """``said_hashes`` of strings without line breaks."""
    if not strings:
        return np.zeros(0, dtype=np.int64)
    codes = codepoints(fold("\n".join(strings)) + "\n")
    ends = np.flatnonzero(codes == 10)
    return said_hashes(codes, classes()[codes], np.r_[0, ends[:-1] + 1])


class Forest:
    """Trees of some texts. Arrays over non-blank lines, in order: ``doc``, ``no``, ``start`` and ``end`` within its text, ``block``.

    ``first`` and ``size`` describe the blocks by their lines; ``block_doc`` is the text a block belongs to.
    """

    def __init__(self, texts: list[str], kinds: list[str | None]):
        self.texts = texts
        self.pdf = np.array([(k or "").lower() == "pdf" for k in kinds], dtype=bool)
        joined = "\n".join(texts) + "\n"
        raw = codepoints(joined)
        cls = classes()[raw]
        breaks = np.flatnonzero(raw == 10)
        starts = np.r_[0, breaks[:-1] + 1]
        ink = np.flatnonzero((cls & WS) == 0)
        first, last = np.searchsorted(ink, starts), np.searchsorted(ink, breaks)
        doc_at = np.r_[0, np.cumsum([len(t) + 1 for t in texts])].astype(np.int64)
        doc = np.searchsorted(doc_at, starts, side="right") - 1
        line_of_doc = np.searchsorted(starts, doc_at[:-1])
        self.full = full = np.flatnonzero(last > first)  # non-blank lines among all
        lo, hi = ink[first[full]], ink[last[full] - 1]
        self.doc = doc[full]
        self.no = full - line_of_doc[self.doc]
        self.start, self.end = lo - doc_at[self.doc], hi + 1 - doc_at[self.doc]
        n = len(full)
        opens = np.ones(n, dtype=bool)
        opens[1:] = (np.diff(full) > 1) | (np.diff(self.doc) > 0)
        self.first = np.flatnonzero(opens)
        self.block = np.cumsum(opens) - 1
        self.size = np.diff(np.append(self.first, n))
        self.block_doc = self.doc[self.first]
        self.block_end = (breaks[full] - doc_at[self.doc])[self.first + self.size - 1] if n else np.zeros(0, np.int64)
        self.length = hi + 1 - lo
        self.joined, self._lo, self._hi = joined, lo, hi
        self.raw, self._cls, self._starts = raw, cls, starts
        codes = self._fold()
        self.folded_codes, self.folded_cls = codes, classes()[codes]
        self.folded_ends = np.flatnonzero(codes == 10)
        self.folded_starts = np.r_[0, self.folded_ends[:-1] + 1]
        self._found: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _fold(self) -> np.ndarray:
        """The code points of the folded texts: by a table, and line by line (``hard``) where that does not do."""
        codes = _folded_codes()[self.raw]
        at, ends = self._starts, np.append(self._starts[1:], len(self.raw))
        self.hard = np.unique(np.searchsorted(at, np.flatnonzero(codes == 0), side="right") - 1)
        if not len(self.hard):
            return codes
        begin, end = at[self.hard], ends[self.hard]
        folded = codepoints(fold("".join(self.joined[a:z] for a, z in zip(begin.tolist(), end.tolist(), strict=True))))
        cuts = (np.flatnonzero(folded == 10) + 1).tolist()
        pieces = []
        for a, z, x, y in zip([0, *end[:-1].tolist()], begin.tolist(), [0, *cuts[:-1]], cuts, strict=True):
            pieces += [codes[a:z], folded[x:y]]
        return np.concatenate([*pieces, codes[end[-1] :]])

    def __len__(self) -> int:
        return len(self.doc)

    def text(self, i: int) -> str:
        """Line ``i`` without outer white space."""
        return self.joined[self._lo[i] : self._hi[i] + 1]

    @cached_property
    def squashed_all(self) -> str:
        """The folded texts without white space but line breaks."""
        kept = ((self.folded_cls & WS) == 0) | (self.folded_codes == 10)
        self._squashed_ends = np.cumsum(kept)[self.folded_ends] - 1
        self.squashed_codes = self.folded_codes[kept]
        return self.squashed_codes.tobytes().decode("utf-32-le", "surrogatepass")

    @cached_property
    def squashed(self) -> list[str]:
        """Folded lines without white space."""
        lines = self.squashed_all.split("\n")
        return [lines[i] for i in self.full.tolist()]

    def read_forms(self) -> None:
        """Sets what lines say by their characters: ``stop, thai, solid, bullet, listed, digits, forms, n_parts, longest, mean_part, like``."""
        cls, raw, n = self._cls, self.raw, len(self)
        count = lambda bit: np.add.reduceat(((cls & bit) != 0).astype(np.int32), self._starts)[self.full]
        last = self._hi.copy()
        while (more := ((cls[last] & CLOSE) != 0) & (last > self._lo)).any():
            last -= more
        self.stop = (cls[last] & MARK) != 0  # ends as a sentence
        self.thai, self.solid = count(THAI), count(SOLID)
        self.bullet = (cls[self._lo] & BULLET) != 0
        near = np.zeros(n, dtype=bool)
        for k in range(1, 7):
            near |= (cls[np.minimum(self._lo + k, len(raw) - 1)] & AFTER) != 0
        self.listed = np.zeros(n, dtype=bool)
        for i in np.flatnonzero(near | self.bullet | np.isin(raw[self._lo], [ord(c) for c in "-–•‣▪*·●○"])).tolist():
            self.listed[i] = pages.LIST_MARK.match(self.joined, self._lo[i], self._hi[i] + 1) is not None
        per = lambda bits: np.add.reduceat((bits != 0).astype(np.int32), self.folded_starts)[self.full]
        digits = per(self.folded_cls & DIGIT)
        self.digits = digits / np.maximum(1, per((self.folded_cls & WS) == 0))
        kind = _form_index()[raw]
        where = np.flatnonzero(kind)
        line = np.searchsorted(self._lo, where, side="right") - 1
        self.forms = np.bincount(line * (len(pages.FORM) + 1) + kind[where], minlength=n * (len(pages.FORM) + 1)).reshape(n, -1)[:, 1:]
        self.n_parts = np.ones(n, dtype=np.int64)
        self.longest, self.mean_part = self.length.astype(np.float32), self.length.astype(np.float32)
        for i, p in self.all_parts.items():
            lens = [len(x) for x in p] or [0]
            self.n_parts[i], self.longest[i], self.mean_part[i] = len(p), max(lens), sum(lens) / len(lens)
        self.like = self.stop | (self.thai >= 15) | ((self.length >= 36) & (2 * self.solid > self.length) & (self.n_parts < 5))

    @cached_property
    def all_parts(self) -> dict[int, list[str]]:
        """Entries of the lines that may hold several, of a menu or path."""
        raw = self.raw
        blank, nxt = raw == 32, np.r_[raw[1:], np.uint32(10)]
        where = np.flatnonzero(((self._cls & BAR) != 0) | (blank & ((nxt == 32) | (nxt == 45))))
        line = np.searchsorted(self._lo, where, side="right") - 1
        ok = (line >= 0) & (where <= self._hi[line])
        return {i: pages.entries(self.text(i)) for i in np.unique(line[ok]).tolist()}

    def said(self) -> np.ndarray:
        """Hash of each line's wording."""
        if not len(self):
            return np.zeros(0, dtype=np.int64)
        return said_hashes(self.folded_codes, self.folded_cls, self.folded_starts)[self.full]

    def leads(self) -> np.ndarray:
        """Hash of what stands before the first colon of a line, or before its first gap if that is in a script without spaces; 0 if nothing does."""
        if not len(self):
            return np.zeros(0, dtype=np.int64)
        codes, cls, starts = self.folded_codes, self.folded_cls, self.folded_starts
        before = np.r_[np.uint16(0), cls[:-1]]
        gap = np.flatnonzero((codes == 58) | (((cls & WS) != 0) & ((before & SOLID) != 0)))
        gap = np.append(gap, len(codes))
        end = gap[np.searchsorted(gap, starts)]
        with_lead = np.flatnonzero(end < self.folded_ends)
        out = np.zeros(len(starts), dtype=np.int64)
        if len(with_lead):
            a, n = starts[with_lead], end[with_lead] - starts[with_lead] + 1
            at = np.cumsum(n) - n
            piece = codes[np.arange(int(n.sum())) + np.repeat(a - at, n)]
            piece[at + n - 1] = 10
            h = said_hashes(piece, classes()[piece], at)
            out[with_lead] = np.where(h == 0, 0, (h.view(np.uint64) ^ _LEAD).view(np.int64))
        return out[self.full]

    def parts_said(self) -> tuple[np.ndarray, np.ndarray]:
        """Line, and hash, of each entry of lines with more than two."""
        some = {i: p for i, p in self.all_parts.items() if len(p) > 2}
        return np.array([i for i, p in some.items() for _ in p], dtype=np.int64), hashes_of([x for p in some.values() for x in p])

    def hits(self, automaton: ahocorasick.Automaton) -> tuple[np.ndarray, np.ndarray]:
        """Line and value of each pattern of the automaton that stands in a line, without white space. Found once."""
        got = self._found.get(id(automaton))
        if got is None:
            found = list(automaton.iter(self.squashed_all))
            where, value = np.array([e for e, _ in found], dtype=np.int64), np.array([v for _, v in found], dtype=np.int64)
            of_full = np.full(len(self._squashed_ends), -1)
            of_full[self.full] = np.arange(len(self))
            got = self._found[id(automaton)] = of_full[np.searchsorted(self._squashed_ends, where)], value
        return got

    def heads(self) -> np.ndarray:
        """First code point of each squashed line."""
        self.squashed_all  # noqa: B018
        return self.squashed_codes[np.r_[0, self._squashed_ends[:-1] + 1][self.full]]

    def per_doc(self, lines: np.ndarray) -> np.ndarray:
        """Whether any line of a text is marked."""
        return np.bincount(self.doc[lines], minlength=len(self.texts)) > 0


def forests(texts: list[str], kinds: list[str | None], size: int = CHARS) -> Iterator[tuple[int, Forest]]:
    """Batches of texts, with the place of their first."""
    at = 0
    while at < len(texts):
        n, k = len(texts[at]), at + 1
        while k < len(texts) and n + len(texts[k]) <= size:
            n += len(texts[k])
            k += 1
        yield at, Forest(texts[at:k], kinds[at:k])
        at = k
