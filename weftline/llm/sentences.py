"""Problem 6: sentence units in nine languages, html or wrapped pdf text.

Candidate boundaries are end marks with what closes after them and, in scripts that part sentences by spaces or not at
all, gaps. Those that punctuation decides (a full-width stop outside quotations, a comma or small letter after a mark)
are decided; the rest are classified by a maximum-entropy model over the neighbouring tokens, case, length, digits,
script and gap. The model is fitted on reliable boundaries: line starts and ends of a bounded sample of the records tell
which tokens begin and end units, which never do although they often stand beside a candidate, and label the candidates
inside lines.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pages
from .maxent import MaxEnt

#: Records the model is fitted on: the first by a hash of their id.
SAMPLE = 2000
#: Characters on either side of a gap without which it parts no sentences.
LEAST = 6
WRAP = "\x1f"  # a wrapped line end between characters that take no space

_D = "぀-ヿ㐀-鿿ก-๛"
_DENSE = re.compile(f"[{_D}가-힣，。、：；！？」』）》]")
_CLOSE = "”’\"'」』）)\\]】》〉"
_OPEN = set("“「『（《(【[〈")
_SHUT = set("”」』）》)】]〉")
_BRACKETS = _OPEN | _SHUT
_MARK = rf"(?P<mark>[.!?。！？．｡…][.!?。！？．｡…]*)(?P<close>[{_CLOSE}{WRAP}]*)(?P<gap>[\s{WRAP}]*)(?=[^\s{WRAP}])"
_CANDIDATE = re.compile(rf"{_MARK}|(?=[ 　\t])(?P<space>(?<=[{_D}])[ 　\t]+(?=[{_D}A-Z《「(（])|(?<=[0-9A-Za-z%％）)」])[ 　\t]+(?=[{_D}]))")
_CANDIDATE_ASCII = re.compile(rf"{_MARK}(?P<space>(?!))?")  # no gap there is beside a script without spaces
_TOKEN_BEFORE = re.compile(rf"(?:[^\W{_D}]|[.'’/:-](?=[^\W{_D}]))+$|[^\s]$")
_TOKEN_AFTER = re.compile(rf"[“‘\"'「『《(（¿¡]*(?P<w>[{_D}]{{1,2}}|[^\W{_D}]+|[^\s])")
_THAI = re.compile("[ก-๛]")
_DIGITS = re.compile(r"\d+")
_CODE = re.compile(r"[A-Z]+\d+")
_LETTERED = re.compile(r"[a-z][)] ")

# Abbreviations before which or after which a sentence rarely ends.
ABBREVIATIONS = frozenset("""
dr mr mrs ms prof st jr sr no nos art arts fig figs sec rm tel ext ed eds vol pp p al etc e.g i.e vs cf approx dept univ est min max hr hrs
u.s u.k ph.d m.a b.a jan feb mar apr jun jul aug sep sept oct nov dec mon tue wed thu fri sat sun
z b z.b d.h bzw ca nr abs str usw vgl hr fr m mme mlle p.ex ex av sra dra núm pág aprox ud uds ts ths gs pgs tp
""".split())  # fmt: skip
_NEVER = frozenset("dr mr mrs ms prof no nos art arts fig figs rm ext ed eds vol pp al e.g i.e vs cf approx z z.b d.h bzw ca nr abs vgl mme mlle sra dra núm pág aprox ts ths pgs p.ex".split())


def unwrap(text: str) -> str:
    """A pdf block as one line of equal length: wraps become a space, or WRAP where none belongs."""
    if "\n" not in text:
        return text
    out = list(text)
    for m in re.finditer(r"[^\S\n]*\n[^\S\n]*", text):
        a, b = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
        tight = _DENSE.match(a or " ") and _DENSE.match(b or " ") or (_DENSE.match(a or " ") and b.isdigit()) or (a.isdigit() and _DENSE.match(b or " ")) or (a.isalnum() and b.isalnum() and _dense_around(text, m.start(), m.end()))
        if tight and not (_THAI.match(a) and _THAI.match(b)):
            out[m.start() : m.end()] = WRAP * (m.end() - m.start())
        else:
            out[m.start() : m.end()] = " " * (m.end() - m.start())
    return "".join(out)


def _dense_around(text: str, a: int, b: int) -> bool:
    near = text[max(0, a - 30) : b + 30]
    return 4 * len(_DENSE.findall(near)) > len(near)


def _before(s: str, at: int) -> str:
    near = s[max(0, at - 24) : at].replace(WRAP, "")
    if _THAI.match(near[-1:]):
        return near.rpartition(" ")[2][-6:]  # words of Thai are not parted
    m = _TOKEN_BEFORE.search(near, near.rfind(" ") + 1)  # no token holds a space
    return m[0].lower() if m else ""


def _after(s: str, at: int) -> str:
    near = s[at : at + 24].replace(WRAP, "")
    m = _TOKEN_AFTER.match(near)
    if m and _THAI.match(m["w"]):
        return near.partition(" ")[0][:6]
    return _CODE.sub("CODE", m["w"]) if m else ""


def _shape(t: str) -> str:
    c = t[:1]
    if not c:
        return "none"
    if c.isdigit():
        return "digit"
    if _DENSE.match(c):
        return "dense"
    return "upper" if c.isupper() else "lower" if c.islower() else "other" if not c.isalpha() else "letter"


@dataclass
class Splitter:
    """Splits texts into units. ``starts`` and ``ends``: how often a token begins or ends a line, and stands beside a candidate."""

    model: MaxEnt | None = None
    starts: dict[str, tuple[int, int]] = field(default_factory=dict)
    ends: dict[str, tuple[int, int]] = field(default_factory=dict)
    memo: dict[tuple, bool] = field(default_factory=dict)

    def features(self, s: str, m: re.Match, marked: bool, beside: tuple[str, str] | None = None) -> tuple[str, ...]:
        """``beside``: the tokens before and after, with digits as 0, where they are known."""
        space = m["space"] is not None
        at = m.start()
        prev, nxt = beside or (_DIGITS.sub("0", _before(s, at)), _DIGITS.sub("0", _after(s, m.end())))
        kind = ("S" if space else m["mark"][:1]) + ("w" if space and m["space"] == "　" else "" if space else ("n" if not m["gap"] else "g"))
        tail = _DIGITS.sub("0", s[max(0, at - 4) : at].replace(WRAP, ""))[-2:]
        a, b = self.starts.get(nxt, (0, 0)), self.ends.get(prev, (0, 0))
        rate = lambda x: "new" if sum(x) == 0 else "never" if x[0] == 0 else "seldom" if x[0] < 0.1 * x[1] else "often"
        before, after, short, near, far = _shape(prev), _shape(nxt), prev in ABBREVIATIONS, rate(a), rate(b)
        return (
            kind, f"{kind} {prev}", f"{kind} {nxt}", f"{kind} {before} {after}", f"{kind} {prev} {after}", f"{kind} {before} {nxt}", f"{kind} {tail}",
            f"{kind} {short} {after}", f"{kind} {near}", f"{kind} {far}", f"{kind} {near} {far} {min(len(prev), 4)}", f"{kind} {marked}", f"{kind} {len(prev) == 1} {short} {near}",
        )

    def decide(self, s: str, m: re.Match, depth: int, marked: bool) -> bool | None:
        """True or False where punctuation decides, else None."""
        nxt = s[m.end()]
        if depth > 0:
            return False
        if m["space"] is not None:
            prev = s[m.start() - 1]
            return None if _D_CHAR.match(prev) or _D_CHAR.match(nxt) else False
        if not s[: m.start()].strip():
            return False  # a bullet
        mark, close, gap = m["mark"], m["close"].replace(WRAP, ""), m["gap"]
        if nxt in ",;:，、；：.。!?！？)）」』”]】》%":
            return False
        free = bool(gap.replace(WRAP, ""))
        if not free and not close and nxt.isdigit() and s[m.start() - 1].isdigit() and mark in ".．":
            return False  # a number over a wrapped line end
        if mark[0] in "…" or mark == "..." or (mark[0] == "." and len(mark) > 1):
            return bool(free and (nxt.isupper() or _D_CHAR.match(nxt)) and not nxt.islower()) or (close and free) or False
        if close and any(c in _SHUT or c in "\"'" for c in close) and any(c in "」』”’\"'" for c in close) and not free:
            return False  # the sentence goes on after its quotation
        if mark[-1] in "。！？｡":
            return not nxt.islower() or mark[-1] == "。"
        word = nxt if nxt not in _OPEN and nxt not in "\"'“‘" else s[m.end() + 1 : m.end() + 2]
        if free and _before(s, m.start()) not in ABBREVIATIONS and _LETTERED.match(s, m.end()):
            return True  # the next row of a list
        if word.islower():
            return False
        if mark[-1] in "!?":
            return free or bool(_D_CHAR.match(word)) or bool(_DENSE.match(word))
        if not free and not close and word.isascii() and word.isalnum():
            return None if _DENSE.match(s[m.start() - 1 : m.start()] or " ") else False
        prev = _before(s, m.start())
        if prev in _NEVER or (word.isdigit() and prev in ABBREVIATIONS):
            return False
        return None

    def starts_in(self, s: str, begin: int = 0) -> list[int]:
        """First positions of the units of one line (or unwrapped block)."""
        lead = len(s) - len(s.lstrip())
        out = [lead]
        mark = pages.LIST_MARK.match(s)
        skip = mark.end() if mark else 0
        depth = at = 0
        marked = "。" in s or bool(_SENTENCE_END.search(s))
        for m in (_CANDIDATE_ASCII if s.isascii() else _CANDIDATE).finditer(s):
            if m.start() < skip or (m["space"] is not None and (m.start() - out[-1] < LEAST or len(s) - m.end() < LEAST)):
                continue
            inner = s[at : m.start()] if m["space"] is not None else s[at : m.start("gap")]
            for c in inner if not _BRACKETS.isdisjoint(inner) else "":
                if c in _OPEN:
                    depth += 1
                elif c in _SHUT:
                    depth = max(0, depth - 1)
            at = m.start() + len(m[0]) if m["space"] is not None else m.start("gap")
            if self._boundary(s, m, depth, marked):
                out.append(m.end())
                depth = 0
                mark = pages.LIST_MARK.match(s, m.end())
                skip = mark.end() if mark else 0
        return out

    def _boundary(self, s: str, m: re.Match, depth: int, marked: bool) -> bool:
        d = self.decide(s, m, depth, marked)
        if d is not None:
            return d
        f = self.features(s, m, marked)
        known = self.memo.get(f)
        if known is None:
            if len(self.memo) > 300_000:
                self.memo.clear()
            known = self.memo[f] = self.model.score(f) > 0 if self.model else m["space"] is None
        return known

    def units(self, text: str | None, source_type: str | None) -> list[tuple[int, int]]:
        """``(start, end)`` of each unit of a record, in order."""
        if not text or not text.strip():
            return []
        out: list[tuple[int, int]] = []
        for base, s, whole in pieces(text, source_type):
            found = [len(s) - len(s.lstrip())] if whole else self.starts_in(s)
            stops = [*found[1:], len(s)]
            for a, b in zip(found, stops, strict=True):
                e = len(s[a:b].rstrip(" \t　" + WRAP)) + a
                if e > a:
                    out.append((base + a, base + e))
        return out


_D_CHAR = re.compile(f"[{_D}가-힣]")
_SENTENCE_END = re.compile(r"[.!?] +[A-ZÀ-Þ¿¡]")


def pieces(text: str, source_type: str | None) -> Iterator[tuple[int, str, bool]]:
    """``(position, text, whole)`` of what holds units: html lines, pdf blocks; ``whole``: no sentence, so one unit."""
    if (source_type or "").lower() == "pdf":
        at = 0
        for m in [*pages._BLANK.finditer(text), None]:
            end = m.start() if m else len(text)
            block = text[at:end]
            if block.strip():
                s = unwrap(block)
                yield at, s, len(s) < 240 and bool(pages.tokens(s.replace(WRAP, "").strip()))
            at = m.end() if m else end
        return
    at = 0
    for line in text.split("\n"):
        s = line.strip()
        if s:
            yield at, line, bool(pages.tokens(s)) or (len(s) > 12 and len(pages.entries(s)) > 2 and not pages.ends_sentence(s) and "  " not in s and _menu(s))
        at += len(line) + 1


def _menu(s: str) -> bool:
    parts = pages.entries(s)
    return max(map(len, parts)) < 28


def train(records: list[tuple[str, str | None]]) -> Splitter:
    """A splitter fitted on ``(text, source_type)`` records."""
    init: Counter = Counter()
    final: Counter = Counter()
    mid_next: Counter = Counter()
    mid_prev: Counter = Counter()
    seen: list[tuple[str, re.Match, bool, str, str]] = []
    plain = Splitter()
    for text, kind in records:
        if not text:
            continue
        for _, s, whole in pieces(text, kind):
            if whole:
                continue
            body = s[pages.LIST_MARK.match(s).end() :] if pages.LIST_MARK.match(s) else s.lstrip()
            if len(body) < 12:
                continue
            init[_DIGITS.sub("0", _after(body, 0))] += 1
            end = re.search(rf"[.!?。！？．｡]?[{_CLOSE}]*\s*$", body)
            final[_DIGITS.sub("0", _before(body, end.start()))] += 1
            depth_at = 0
            skip = len(s) - len(body)
            marked = "。" in s or bool(_SENTENCE_END.search(s))
            for m in (_CANDIDATE_ASCII if s.isascii() else _CANDIDATE).finditer(s):
                if m.start() < skip:
                    continue
                depth_at = s.count("「", 0, m.start()) + s.count("《", 0, m.start()) - s.count("」", 0, m.start()) - s.count("》", 0, m.start())
                d = plain.decide(s, m, depth_at, marked)
                nxt, prev = _DIGITS.sub("0", _after(s, m.end())), _DIGITS.sub("0", _before(s, m.start()))
                if d and m["space"] is None and _DENSE.match(s[m.start()] if m["mark"][0] in "。！？" else " "):
                    init[nxt] += 1  # a full stop that is beyond doubt shows what begins and ends sentences
                    final[prev] += 1
                if d is None or (d is False and m["space"] is None and m["mark"] == "."):
                    mid_next[nxt] += 1
                    mid_prev[prev] += 1
                    seen.append((s, m, marked, prev, nxt))
    splitter = Splitter(None, {k: (init[k], mid_next[k]) for k in init.keys() | mid_next.keys()}, {k: (final[k], mid_prev[k]) for k in final.keys() | mid_prev.keys()})
    rows, labels = [], []
    for s, m, marked, prev, nxt in seen:
        (i, n), (e, k) = splitter.starts[nxt], splitter.ends[prev]
        small = nxt[:1].islower()
        by_form = m["space"] is None and bool(m["gap"]) and prev.isalpha() and len(prev) > 2 and prev not in ABBREVIATIONS and s[m.end()].isupper()
        if by_form:
            label = 1  # a word before the stop, a capital after the gap
        elif small or (i == 0 and n >= 4) or (e == 0 and k >= 8) or (m["space"] is None and prev in ABBREVIATIONS and i < 3):
            label = 0
        elif i >= 2 and (e >= 1 or len(prev) > 3):
            label = 1
        else:
            continue
        if m["space"] is not None and label and (i < 3 or i < 0.05 * n):
            continue
        rows.append(splitter.features(s, m, marked, (prev, nxt)))
        labels.append(label)
    splitter.model = MaxEnt.fit(rows, labels, rounds=12)
    return splitter


def sample(df: DataFrame, id_col: str, n: int, *columns: str, total: int | None = None) -> list:
    """About ``n`` rows with a first column that is not null, the ones with the least hashes of their id: the same ones, in the same order, at every layout.

    The hash is compared with a threshold first, so that hardly more than the sample is sorted or leaves the executors.
    """
    total = df.count() if total is None else total
    share = min(1.0, 1.1 * n / max(1, total))
    h = F.xxhash64(F.col(id_col), F.lit(17))
    df = df.where(F.col(columns[0]).isNotNull())
    picked = df.where(F.pmod(h, F.lit(1 << 40)) < F.lit(int(share * (1 << 40)))) if share < 1 else df
    return picked.select(*columns, h.alias("_h")).orderBy("_h", *columns).limit(n + n // 2 + 50).collect()


def sentence_units(df: DataFrame, id_col: str = "ext_id", text_col: str = "text", type_col: str = "source_type", fit_on: DataFrame | None = None) -> DataFrame:
    """``id, start, end`` of each unit of each record.

    Null and blank texts have none; unknown kinds count as html; repeated rows are split repeatedly; texts are read
    whole. One narrow stage after the model is fitted on ``SAMPLE`` records.
    """
    source = df if fit_on is None else fit_on
    splitter = train([(r[0], r[1]) for r in sample(source, id_col, SAMPLE, text_col, type_col)])
    picked = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(type_col).alias("kind"))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, a, z) for i, t, k in zip(b["id"], b["text"], b["kind"], strict=True) for a, z in splitter.units(t, k)]
            yield pd.DataFrame(rows, columns=["id", "start", "end"])

    return picked.mapInPandas(split, "id long, start int, end int")
