"""Problem 5: the language of every record and of each segment of a mixed one.

A bidirectional gated recurrent network over bytes labels every position; a sentence pools its positions' log-
probabilities, a segment its sentences', the record all of them. The network is trained in numpy, by backpropagation
through time, on sentences of a bounded sample whose language is beyond doubt: by script, by letters that only one of
the languages has, or by function words of only one. Sentences set between two of another language teach it to change its mind, and back.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boilerplate as bp
from . import pages
from .gru import BiGru
from .sentences import ABBREVIATIONS, SAMPLE, Splitter, sample, train

LANGUAGES = ("zh", "en", "ja", "ko", "fr", "de", "es", "vi", "th")
#: Sentences of one language the network is trained on, at most.
PER_LANGUAGE = 320
#: Of these, with one wording.
PER_WORDING = 12
#: Shorter units say too little to be a sentence.
LEAST = 6

WORDS = pages.WORDS
_WORDS = {k: frozenset(v.split()) for k, v in WORDS.items()}
_SCRIPTS = [("ko", re.compile("[가-힣]")), ("ja", re.compile("[ぁ-ヿ]")), ("th", re.compile("[ก-๛]")), ("vi", re.compile("[ơưđăẠ-ỹ]", re.I)), ("zh", re.compile("[㐀-鿿]"))]
_CODE = {"zh": "zh", "en": "en", "ja": "ja", "jp": "ja", "ko": "ko", "kr": "ko", "fr": "fr", "de": "de", "es": "es", "vi": "vi", "vn": "vi", "th": "th"}
_TAG = r"(zh|en|ja|ko|fr|de|es|vi|th)(?:[-_](?:[a-z]{2}|han[st]|latn|\d{3}))?"
_HOST = re.compile(rf"^(?:[a-z]+://)?{_TAG}\.", re.I)
_SEGMENT = re.compile(rf"/{_TAG}(?=[/?#]|$)", re.I)
_QUERY = re.compile(rf"[?&](?:lang|language|locale|hl|l|lng|ln|setlang)={_TAG}(?=[&#]|$)", re.I)
_FILE = re.compile(rf"[_.-]{_TAG}(?=\.[a-z0-9]{{2,5}}(?:[?#]|$))", re.I)


def stated(url: str | None) -> set[str]:
    """Languages a url states in its host, path, query or file name."""
    if not url:
        return set()
    found = {m[1].lower() for p in (_HOST, _QUERY, _FILE) if (m := p.search(url))}
    path = re.sub(r"^[a-z]+://[^/]*", "", url, flags=re.I).split("?")[0]
    return found | {m[1].lower() for m in _SEGMENT.finditer(path)}


def without_language(url: str) -> str:
    """A url less the language it states."""
    u = _HOST.sub(lambda m: m[0][: m.start(1) - m.start()], url)
    u = _QUERY.sub("", u)
    u = _FILE.sub("", u)
    head, sep, tail = u.partition("://")
    u = head + sep + _SEGMENT.sub("", tail)
    if "?" not in u and "&" in u:
        u = u.replace("&", "?", 1)
    return u


def sure_language(sentence: str) -> str | None:
    """The language of a sentence if script, letters or function words leave no doubt."""
    for lang, p in _SCRIPTS:
        n = len(p.findall(sentence))
        if n >= (4 if lang in ("ko", "th", "zh") else 2):
            return lang if lang != "zh" or 3 * n > len(sentence) else None
    words = re.findall(r"[^\W\d_]+", sentence.lower())
    hits = sorted(((sum(w in s for w in words), k) for k, s in _WORDS.items()), reverse=True)
    return hits[0][1] if hits[0][0] >= 2 and hits[0][0] >= 2 * hits[1][0] + 1 else None


def fit_network(sentences: list[tuple[str, str]], seed: int = 0, rounds: int = 11) -> BiGru:
    """A network trained on ``(sentence, language)``, and on as many sentences set between two of another language."""
    net = BiGru(len(LANGUAGES), seed=seed)
    if not sentences:
        return net
    rng = np.random.default_rng(seed)
    code = {k: i for i, k in enumerate(LANGUAGES)}
    texts, labels = [], []
    for s, lang in sentences:
        raw = s.encode("utf-8", "replace")
        texts.append(raw)
        labels.append(np.full(len(raw), code[lang]))
    of: dict[str, list[int]] = {}
    for i, (_, lang) in enumerate(sentences):
        of.setdefault(lang, []).append(i)
    for i, j in zip(rng.permutation(len(sentences)), rng.permutation(len(sentences)), strict=True):
        k = int(rng.choice(of[sentences[i][1]]))
        gap = b" " if rng.random() < 0.5 else b""
        parts = [(texts[i] + gap, labels[i][0]), (texts[j] + gap, labels[j][0]), (texts[k], labels[k][0])]
        texts.append(b"".join(t for t, _ in parts))
        labels.append(np.concatenate([np.full(len(t), y) for t, y in parts]))
    for _ in range(len(sentences) // 12):  # long runs, so that the states hold over whole blocks
        a, b = rng.choice(sorted(of), 2)
        ids = [int(rng.choice(of[k])) for k in (a,) * int(rng.integers(4, 10)) + (b,) * int(rng.integers(0, 5))]
        texts.append(b" ".join(texts[i] for i in ids))
        labels.append(np.concatenate([np.full(len(texts[i]) + 1, labels[i][0]) for i in ids])[:-1])
    for turn in range(3):  # a start that does not come down is left for another
        if net.fit(texts, labels, rounds=rounds, seed=seed + turn)[-1] < GOOD:
            break
        net = BiGru(len(LANGUAGES), seed=seed + turn + 1) if turn < 2 else net
    return net


#: Mean loss of a byte below which training has succeeded.
GOOD = 0.25


@dataclass
class LanguageModel:
    """What the body is, where sentences end, and how languages look."""

    body: bp.BodyModel
    splitter: Splitter
    net: BiGru

    def sentences(self, some: list[tuple[str, str | None]]) -> list[list[tuple[int, int]]]:
        """Full sentences of the main body of each record, as positions; none where the record is residue."""
        out: list[list[tuple[int, int]]] = []
        for _, r, keep, bad in self.body.batches([t for t, _ in some], [k for _, k in some]):
            for d, spans in enumerate(body_spans(r, keep)):
                out.append([] if bad[d] else body_sentences(r.forest.texts[d], bool(r.forest.pdf[d]), spans, self.splitter))
        return out


def body_spans(r: bp.Reading, keep: np.ndarray) -> list[list[tuple[int, int]]]:
    """Start and end of each kept line of the texts of a batch; of each block with a kept line where the text is a pdf."""
    f = r.forest
    out: list[list[tuple[int, int]]] = [[] for _ in f.texts]
    if not len(f):
        return out
    line = np.flatnonzero(keep & ~f.pdf[f.doc])
    block = np.flatnonzero(np.logical_or.reduceat(keep, f.first) & f.pdf[f.block_doc])
    for d, a, z in zip(f.doc[line].tolist(), f.start[line].tolist(), f.end[line].tolist(), strict=True):
        out[d].append((a, z))
    for d, a, z in zip(f.block_doc[block].tolist(), f.start[f.first[block]].tolist(), f.block_end[block].tolist(), strict=True):
        out[d].append((a, z))
    return out


def body_sentences(text: str, pdf: bool, spans: list[tuple[int, int]], splitter: Splitter) -> list[tuple[int, int]]:
    """Units of the kept spans that are sentences."""
    out: list[tuple[int, int]] = []
    for a, z in spans:
        for s, e in splitter.units(text[a:z], "pdf" if pdf else None):
            u = text[a + s : a + e]
            if len(u) >= LEAST and pages.sentence_like(u.replace("\n", "")):
                out.append((a + s, a + e))
    return out


def fit(df: DataFrame, id_col: str, text_col: str, type_col: str) -> LanguageModel:
    """Body model and network; sentences are parted by their marks, so the splitter is left unfitted."""
    body, rows = _sampled(df, id_col, text_col, type_col)
    return LanguageModel(body, Splitter(), fit_network(training_sentences(rows, body_parts(rows, body))))


def fit_body(df: DataFrame, id_col: str, text_col: str, type_col: str) -> LanguageModel:
    """Body and sentence models; the network is left untrained."""
    body, rows = _sampled(df, id_col, text_col, type_col)
    return LanguageModel(body, train(rows), BiGru(len(LANGUAGES)))


def _sampled(df: DataFrame, id_col: str, text_col: str, type_col: str) -> tuple[bp.BodyModel, list[tuple[str, str | None]]]:
    """Rows are ordered by the hash of their id, so the first ones are a sample at every layout."""
    total = df.count()
    known = bp.known_wordings(df, text_col, total)
    rows = [(r[0], r[1]) for r in sample(df, id_col, SAMPLE, text_col, type_col, total=total) if r[0]]
    return bp.train(rows[: bp.SAMPLE], known), rows


def body_parts(rows: list[tuple[str, str | None]], body: bp.BodyModel) -> list[list[tuple[int, int]]]:
    """Parts of the main bodies of records that are like sentences, as positions."""
    out: list[list[tuple[int, int]]] = []
    for _, r, keep, bad in body.batches([t for t, _ in rows], [k for _, k in rows]):
        for d, spans in enumerate(body_spans(r, keep)):
            found: list[tuple[int, int]] = []
            for a, z in spans if not bad[d] else []:
                at = a
                for end in parts_of(r.forest.texts[d][a:z]):
                    t = r.forest.texts[d][at : a + end].rstrip()
                    if len(t) >= LEAST and pages.sentence_like(t.replace("\n", "")):
                        found.append((at, at + len(t)))
                    at = a + end
            out.append(found)
    return out


def training_sentences(records: list[tuple[str, str | None]], spans: list[list[tuple[int, int]]]) -> list[tuple[str, str]]:
    """``(sentence, language)``, at most ``PER_LANGUAGE`` a language and ``PER_WORDING`` of one wording.

    A sentence in doubt takes the language of its line, or of its pdf block, if the sentences there that are beyond
    doubt agree and at least two letters in three are Latin in both.
    """
    by: dict[str, list[str]] = {k: [] for k in LANGUAGES}
    seen: Counter = Counter()
    for (text, kind), found in zip(records, spans, strict=True):
        gap = "\n\n" if (kind or "").lower() == "pdf" else "\n"
        group: list[tuple[str, str | None]] = []
        for j, (a, z) in enumerate(found):
            s = text[a:z].replace("\n", " ")
            group.append((s, sure_language(s)))
            if j + 1 == len(found) or gap in text[z : found[j + 1][0]]:
                sure = {k for _, k in group if k}
                for t, k in group:
                    k = k or (next(iter(sure)) if len(sure) == 1 and next(iter(sure)) in WORDS and _latin(t) else None)
                    w = pages.wording(t)
                    if k and len(by[k]) < PER_LANGUAGE and seen[w] < PER_WORDING:
                        seen[w] += 1
                        by[k].append(t)
                group = []
    return [(s, k) for k, v in by.items() for s in v]


def _latin(text: str) -> bool:
    return 3 * len(re.findall(r"[a-zà-ÿ]", text, re.I)) > 1.5 * len(text)


#: What it costs to change the language between two sentences, and what the positions of a sentence count, in nats.
CHANGE, WEIGHT = 3.0, 0.125


def smooth(score: np.ndarray) -> np.ndarray:
    """The likeliest sequence of languages of a record's sentences, by dynamic programming."""
    best = score.argmax(axis=1)
    if (best == best[0]).all():
        return best  # no other sequence can be likelier
    total, back = score[0] * WEIGHT, []
    own = np.arange(score.shape[1])
    for row in score[1:] * WEIGHT:
        stay = total.argmax()
        least = total[stay] - CHANGE
        back.append(np.where(total >= least, own, stay))
        total = np.maximum(total, least) + row
    out = [int(total.argmax())]
    for from_ in reversed(back):
        out.append(int(from_[out[-1]]))
    return np.array(out[::-1])


def segments(df: DataFrame, id_col: str = "ext_id", text_col: str = "text", type_col: str = "source_type", url_col: str = "url", model: LanguageModel | None = None) -> DataFrame:
    """``id, url, start, end, lang, confidence, record_lang, record_confidence``: each run of main-body sentences in one language.

    The confidence is the geometric mean of its positions' probabilities. Residue records, null and blank texts, and
    records without a full sentence have no segment. Repeated rows repeat. One narrow stage after the model is fitted.
    """
    model = model or fit(df, id_col, text_col, type_col)
    picked = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(text_col).alias("text"), F.col(type_col).alias("kind"))

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, urls = b["id"].tolist(), b["url"].tolist()
            rows: list[tuple] = []
            for at, r, keep, bad in model.body.batches(b["text"].tolist(), b["kind"].tolist()):
                spans = body_spans(r, keep)
                docs = [d for d in range(len(spans)) if spans[d] and not bad[d]]
                units = [r.forest.texts[d][s:e] for d in docs for s, e in spans[d]]
                cut = [parts_of(u) for u in units]
                if units:
                    score, sizes = pooled(model.net, units, cut)
                    begin = np.array([s for d in docs for s, _ in spans[d]])
                    parts = np.fromiter(map(len, cut), dtype=np.int64, count=len(cut))
                    stop = np.concatenate(cut)
                    start = np.r_[0, stop[:-1]]
                    start[np.cumsum(parts)[:-1]] = 0
                    shift = np.repeat(begin, parts)
                    of_doc = np.add.reduceat(parts, np.cumsum([0, *(len(spans[d]) for d in docs[:-1])]))
                    for d, x in _runs([r.forest.texts[d] for d in docs], of_doc, start + shift, stop + shift, score, sizes):
                        rows.append((ids[at + docs[d]], urls[at + docs[d]], *x))
            yield pd.DataFrame(rows, columns=["id", "url", "start", "end", "lang", "confidence", "record_lang", "record_confidence"])

    return picked.mapInPandas(label, "id long, url string, start int, end int, lang string, confidence double, record_lang string, record_confidence double")


_NO_SPACES = "぀-ヿ㐀-鿿ก-๛"
_SOLID = re.compile(f"[{_NO_SPACES}]")
#: Where a part of a line that is pooled by itself may end: marks with what closes after them, and gaps in lines of scripts without spaces.
_MARKS = re.compile(r"[.!?。！？．…]+[”’\"'」』）)\]]*\s*")
_MARKS_GAPS = re.compile(r"[\s.!?。！？．…]+[”’\"'」』）)\]]*\s*")
_FULL = frozenset("。！？．…")


def parts_of(unit: str) -> list[int]:
    """Ends of the parts of a line or block: after full-width marks, after others before a gap or a script without spaces, and at gaps in such a script."""
    solid = _SOLID.search(unit) is not None
    ends = [m.end() for m in (_MARKS_GAPS if solid else _MARKS).finditer(unit) if _parts_at(unit, m[0], m.start(), m.end(), solid)]
    return ends if ends and ends[-1] == len(unit) else [*ends, len(unit)]


def _parts_at(unit: str, found: str, at: int, end: int, solid: bool) -> bool:
    nxt = unit[end : end + 1]
    if found[0] in " \t\u3000\n" and found.isspace():  # a gap
        before = unit[at - 1 : at]
        return bool(_SOLID.match(before) and (_SOLID.match(nxt) or nxt.isalpha()) or before.isalpha() and _SOLID.match(nxt))
    if not _FULL.isdisjoint(found) or not nxt:
        return True
    if not found[-1].isspace() and not (solid and _SOLID.match(nxt)):
        return False
    # a sentence goes on before a small letter or a digit, or after an abbreviation
    return found.strip() != "." or not (nxt.islower() or nxt.isdigit() or unit[max(0, at - 12) : at].rpartition(" ")[2].lower() in ABBREVIATIONS)


def pooled(net: BiGru, units: list[str], cut: list[list[int]], most: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """Log-probabilities of each part of each unit, summed over its bytes, and the number of its bytes.

    The network reads whole units, so a part is judged in its context. Units of like length are read together.
    """
    whole = "".join(units).encode("utf-8", "replace")
    byte = np.append(np.flatnonzero((np.frombuffer(whole, dtype=np.uint8) & 0xC0) != 0x80), len(whole))  # of each code point
    sizes = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
    begin = np.cumsum(sizes) - sizes
    parts = np.fromiter(map(len, cut), dtype=np.int64, count=len(cut))
    stop = byte[np.concatenate(cut) + np.repeat(begin, parts)]
    first = np.cumsum(parts) - parts
    start = np.r_[0, stop[:-1]]
    start[first] = byte[begin]
    at_byte, lengths = byte[begin], byte[begin + sizes] - byte[begin]
    order = np.argsort(lengths, kind="stable")
    score = np.zeros((len(stop), len(LANGUAGES)))
    at = 0
    while at < len(order):
        k = at + 1
        while k < len(order) and (k + 1 - at) * lengths[order[k]] <= most:
            k += 1
        ids = order[at:k]
        n = parts[ids]
        where = np.repeat(first[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        bounds = np.zeros(len(where) + len(ids), dtype=np.int64)  # 0 and the ends of the parts
        inner = np.ones(len(bounds), dtype=bool)
        inner[np.cumsum(n + 1) - n - 1] = False
        bounds[inner] = stop[where] - np.repeat(at_byte[ids], n)
        texts = [whole[a : a + m] for a, m in zip(at_byte[ids].tolist(), lengths[ids].tolist(), strict=True)]
        score[where] = net.pooled(texts, bounds, n + 1)
        at = k
    return score, stop - start


def _runs(texts: list[str], parts: np.ndarray, start: np.ndarray, stop: np.ndarray, score: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, tuple[int, int, str, float, str, float]]]:
    """Place of a text, and its runs of parts in one language that hold a full sentence. ``parts``: number of parts of each text."""
    best = score.argmax(axis=1)
    first = np.cumsum(parts) - parts
    mixed = np.minimum.reduceat(best, first) < np.maximum.reduceat(best, first)
    sums, total = np.add.reduceat(score, first), np.add.reduceat(sizes, first)
    for d, (a, n) in enumerate(zip(first.tolist(), parts.tolist(), strict=True)):
        mine = best[a : a + n]
        if mixed[d]:
            mine = smooth(score[a : a + n])
        doc = int(np.bincount(mine, weights=sizes[a : a + n], minlength=len(LANGUAGES)).argmax()) if mixed[d] else int(mine[0])
        sure = float(np.exp(sums[d, doc] / max(1, total[d])))
        edges = [0, *(np.flatnonzero(np.diff(mine)) + 1).tolist(), n] if mixed[d] else [0, n]
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            for k in range(a + i, a + j):
                t = texts[d][start[k] : stop[k]].strip()
                if len(t) >= LEAST and pages.sentence_like(t.replace("\n", "")):
                    k = a + j - 1
                    end = int(start[k]) + len(texts[d][start[k] : stop[k]].rstrip())
                    lang = int(mine[i])
                    yield d, (int(start[a + i]), end, LANGUAGES[lang], float(np.exp(score[a + i : a + j, lang].sum() / max(1, sizes[a + i : a + j].sum()))), LANGUAGES[doc], sure)
                    break


#: A segment below this confidence proves no language.
CONFIDENT = 0.5


def unstated(found: DataFrame) -> DataFrame:
    """``id, lang`` of the languages of a record's segments that its url does not state."""
    @F.pandas_udf("array<string>")
    def says(urls: pd.Series) -> pd.Series:
        return urls.map(lambda u: sorted(stated(u)))

    pairs = found.where(F.col("confidence") >= CONFIDENT).select("id", "url", "lang").distinct()
    return pairs.where(~F.array_contains(says("url"), F.col("lang"))).select("id", "lang").distinct()
