"""A page's text as a tree of blocks and lines, and what its lines say about themselves.

The texts keep of a page's markup only line breaks and blank lines; the tree is page, block (lines between blank lines),
line. Line and block features stand for those of DOM nodes: attribute tokens (words that pages put into furniture),
subtree density, depth and position, and statistics of siblings.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick

from .common import fold

# Words of page furniture, on folded text without white space. Each group is one attribute token.
FURNITURE = {
    "skip": r"跳到主要|到主內容|主要內容區|skiptomain|skipto(?:the)?content|jumptocontent|tojumpto|zuminhalt|alleraucontenu|saltaral",
    "top": r"回頁首|回到頂端|回最上|▲top|backtotop|topofpage|nachoben|hautdepage",
    "back": r"^\W*\[?(?:回上一頁|goback|返回|zurück|retour)\]?\W*$|回上一頁|\[goback\]",
    "rights": r"版權所有|copyright|©|\(c\)\d{4}|allrightsreserved|著作權",
    "legal": r"本網站內容僅供參考|僅供參考,實際|書面同意,?不得轉載|不得轉載本頁|保有修改、暫停|終止本頁服務|隱私權政策|forreferenceonly|nopartofthispage|reproducedwithout|thispageisreservedby|privacypolicy",
    "cookie": r"cookie(?:設定|以提升)|使用cookie|cookies?to|cookiesettings|瀏覽偏好|接受全部|僅限必要|yourpreferences|acceptall|onlynecessary|weusecookies",
    "subscribe": r"訂閱.{0,12}電子報|newsletter|每週掌握|weeklyupdates",
    "share": r"分享本頁|分享給朋友|轉寄給|列印/轉寄|複製連結|shareonyour|sharethis|copylink|passitonto|likethisarticle|喜歡這篇",
    "view": r"最佳瀏覽解析度|資訊小組維護|bestviewedat",
    "source": r"資料來源:|最後更新:|lastupdated|^\W*source:",
    "byline": r"瀏覽人次|點閱數|發布單位:|編輯小組|供稿\(第|postedby|views:|editors-[\d,]+reads|[\d,]+reads$",
    "contact": r"服務專線[\d,]+|hotline[\d,]+|^\W*地址:.{1,20}電話:|^\W*address:.{1,40}tel",
    "print": r"列印日期|printed\d{2,4}[-/.]",
    "pageno": r"第[\d,]+頁,共|^\W*page[\d,]+of[\d,]+\W*$|^[-‐-―－]\d+[-‐-―－]",
    "related": r"^\W*(?:延伸閱讀|相關連結|熱門文章|您可能也想看|猜你喜歡|furtherreading|relatedpages|mostread|youmayalsolike|relatedlinks)\W*$",
    "step": r"^\W*(?:前一篇|後一篇|上一則|下一則|上一篇|下一篇|previous:|next:)|^[‹›«»←→<>](?=[^\d])",
    "path": r"^\W*(?:首頁|home|startseite|accueil|inicio)[>/»›:]",
}
#: Of each alternative above, letters without which it cannot match.
_KEYS = """
跳到主要 到主內容 主要內容區 skipto jumptocontent tojumpto zuminhalt alleraucontenu saltaral 回頁首 回到頂端 回最上 ▲top backtotop topofpage nachoben hautdepage 回上一頁 goback 返回 zurück retour
版權所有 copyright © (c) allrightsreserved 著作權 僅供參考 不得轉載 保有修改 終止本頁 隱私權政策 forreferenceonly nopartofthispage reproducedwithout thispageisreservedby privacypolicy cookie 瀏覽偏好 接受全部 僅限必要
yourpreferences acceptall onlynecessary 訂閱 newsletter 每週掌握 weeklyupdates 分享本頁 分享給朋友 轉寄 複製連結 shareonyour sharethis copylink passitonto likethisarticle 喜歡這篇 瀏覽解析度 資訊小組維護 bestviewedat
資料來源: 最後更新: lastupdated source: 瀏覽人次 點閱數 發布單位: 編輯小組 供稿( postedby views: editors- 服務專線 hotline 地址: address: 列印日期 printed 頁,共
延伸閱讀 相關連結 熱門文章 可能也想看 猜你喜歡 furtherreading relatedpages mostread youmayalsolike relatedlinks 前一篇 後一篇 上一則 下一則 上一篇 下一篇 previous: next: 首頁 home> home/ home» home› home: startseite accueil inicio
""".split()
# Frequent function words of the languages in Latin script.
WORDS = {
    "en": "the of and to in is for by on at with from are be should no not each when if or an was as has have must may will this that",
    "fr": "le la les des du est sont une dans pour au aux après avant cette sur par avec qui que il elle nous vous leur ne pas être",
    "de": "der die das den dem ist sind nicht mit für und von zu zum zur im ein eine bis gibt es nach wird werden auf auch oder bei wann muss",
    "es": "el los las del una está en por para con después antes que se no son al esta este más como su sus dónde fecha desde",
}
_PARTS = {k: re.compile(v) for k, v in FURNITURE.items()}
#: Beginnings and ends that no key stands for.
_HEAD = re.compile(r"\W*(?:page\d|[-‐-―－]\d|[‹›«»←→<>][^\d])")
GROUPS = tuple(FURNITURE)

_SPACE = re.compile(r"\s+")
_END = re.compile(r"[.!?。！？．…؟][\"'”’」』）)\]】》]*\s*$")
_BLANK = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
#: What parts the entries of a menu or a path on one line.
_BARS = re.compile(r"[|｜/／·‧•›»>＞　]|\s{2,}| - ")
_BAR_CHARS = frozenset("|｜/／·‧•›»>＞　\t\xa0")
_BULLET = re.compile(r"^\s*[›．•·‧▪※●○◆■*‣»>【\[]")
#: List marks; they belong to their line's unit.
LIST_MARK = re.compile(r"\s*(?:[-–•‣▪*·●○]|[(（]?(?:\d{1,3}|[a-zA-Z]|[ivx]{1,4}|[一二三四五六七八九十]{1,3})[)）]|\d{1,3}[.．、](?!\d)|[a-z]\.(?= )|[一二三四五六七八九十]{1,3}[、．.])\s*")


@lru_cache(None)
def keys() -> dict[str, int]:
    """Each key with a bit for every group in which it stands."""
    return {k: sum(1 << n for n, v in enumerate(FURNITURE.values()) if k.strip(">/»›:") in v.replace("\\", "") or k in v.replace("\\", "")) for k in _KEYS}


@lru_cache(None)
def automaton() -> ahocorasick.Automaton:
    """Finds the keys; the value of each is its groups' bits."""
    a = ahocorasick.Automaton()
    for k, bits in keys().items():
        a.add_word(k, bits)
    a.make_automaton()
    return a


def squash(line: str) -> str:
    """Folded, without white space."""
    return _SPACE.sub("", fold(line))


@lru_cache(50_000)
def tokens(line: str) -> tuple[str, ...]:
    """Attribute tokens of a line."""
    return squashed_tokens(squash(line))


def hinted(s: str) -> int:
    """Bits of the groups that a squashed line without their keys may belong to."""
    bits = _READS if s.endswith("reads") else 0
    c = s[:1]
    return bits | _HEADS if (c == "p" or not c.isalnum()) and _HEAD.match(s) else bits


_READS = 1 << GROUPS.index("byline")
_HEADS = 1 << GROUPS.index("pageno") | 1 << GROUPS.index("step")


def squashed_tokens(s: str) -> tuple[str, ...]:
    """Attribute tokens of a squashed line."""
    bits = hinted(s)
    for _, more in automaton().iter(s):
        bits |= more
    return found_tokens(s, bits)


def found_tokens(s: str, bits: int) -> tuple[str, ...]:
    """Attribute tokens of a squashed line among the groups of the bits."""
    return tuple(k for n, (k, p) in enumerate(_PARTS.items()) if bits >> n & 1 and p.search(s)) if bits else ()


_LETTER = re.compile(r"[^\W\d_]")
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def wording(text: str) -> str:
    """The letters of a piece of a line, folded."""
    return _NOT_LETTERS.sub("", fold(text))


#: Signs counted in a line.
FORM = "「(（:：–/|·,"
_EDGES = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])) + "※●○•·‧▪■◆»«›‹…。、，．「」『』【】（）《》〈〉→←▲▼★☆–—“”‘’"


def ends_sentence(line: str) -> bool:
    return _END.search(line) is not None


_THAI = re.compile("[ก-๛]")
_SOLID = re.compile("[぀-ヿ㐀-鿿]")


def sentence_like(line: str) -> bool:
    """Ends as a sentence, or is long enough for one in a script that may do without end marks."""
    return ends_sentence(line) or len(_THAI.findall(line)) >= 15 or (len(line) >= 36 and 2 * len(_SOLID.findall(line)) > len(line) and len(entries(line)) < 5)


def entries(line: str) -> list[str]:
    """Entries of a menu or path on one line; a line without bars is one entry."""
    if _BAR_CHARS.isdisjoint(line) and "  " not in line and " - " not in line:
        return [line]
    return [p for p in _BARS.split(line) if p and _LETTER.search(p)]


_RUNS = re.compile(r"[^\W\d_]+(?:[\s'’.-]*[^\W\d_]+)*")


def shape(line: str) -> str:
    """Punctuation of a line, with words as ``a`` and numbers as ``0``; a bullet before it is left out."""
    s = _RUNS.sub("a", re.sub(r"\d+", "0", _BULLET.sub("", line)))
    return _SPACE.sub("", s)
