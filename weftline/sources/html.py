"""HTML pages to text: a small tolerant tree builder over the standard parser, for use inside an Arrow batch."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What is noise, and where a page's content is, first choice first.
NOISE_TAGS = frozenset(["nav", "footer", "header", "script", "style", "aside"])
NOISE_CLASS = re.compile(r"nav|menu|breadcrumb|sidebar|footer|header", re.I)
ROOTS = [("div", "item-page"), ("main", None), ("article", None), ("body", None)]

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset(["script", "style", "template", "noscript"])
#: An opening tag of the key closes an open element of these.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SCOPE = frozenset("html body div section article main table ul ol td th nav header footer aside".split())


class Node:
    __slots__ = ("tag", "classes", "parent", "children")

    def __init__(self, tag: str, classes: str, parent: Node | None):
        self.tag, self.classes, self.parent = tag, classes, parent
        self.children: list[Node | str] = []


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html", "", None)
        self.body: Node | None = None
        self.at = self.root

    def _ensure_body(self, tag: str) -> None:
        if self.body is None and tag not in ("head", "title", "meta", "link", "base", "script", "style"):
            self.body = Node("body", "", self.root)
            self.root.children.append(self.body)
            self.at = self.body

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        classes = next((v or "" for k, v in attrs if k == "class"), "")
        if tag == "html":
            self.root.classes = classes
            return
        if tag == "body":
            if self.body is None:
                self._ensure_body("body")
            if classes and self.body is not None:
                self.body.classes = classes
            return
        if tag != "head":
            self._ensure_body(tag)
        shut = _CLOSES.get(tag, set()) | ({"p"} if tag in _BLOCKS else set())
        node = self.at
        while shut and node.parent is not None and node.tag not in _SCOPE - shut:
            if node.tag in shut:
                self.at = node.parent
                break
            node = node.parent
        new = Node(tag, classes, self.at)
        self.at.children.append(new)
        if tag not in _VOID:
            self.at = new

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and self.at.tag == tag and self.at.parent is not None:
            self.at = self.at.parent

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        node: Node | None = self.at
        while node is not None and node.parent is not None:
            if node.tag == tag:
                self.at = node.parent
                return
            if node.tag in ("body",):
                return
            node = node.parent

    def handle_data(self, data: str) -> None:
        if self.at is self.root and data.strip():
            self._ensure_body("text")
        self.at.children.append(data)


def _noise(n: Node) -> bool:
    return n.tag in NOISE_TAGS or bool(n.classes and (NOISE_CLASS.search(n.classes)))


def _walk(n: Node) -> Iterator[Node | str]:
    """Nodes and texts in document order, noise left out with all it holds."""
    stack: list[Node | str] = [n]
    while stack:
        x = stack.pop()
        if isinstance(x, Node):
            if _noise(x):
                continue
            yield x
            stack.extend(reversed(x.children))
        else:
            yield x


def extract(raw: bytes | str | None) -> str:
    """Text of a page's content root: each text node stripped, empty ones left out, joined by line breaks. Never raises."""
    if raw is None:
        return ""
    try:
        text = raw if isinstance(raw, str) else _decoded(bytes(raw))
        b = _Builder()
        b.feed(text)
        b.close()
        if _noise(b.root):
            return ""
        nodes = [x for x in _walk(b.root) if isinstance(x, Node)]
        root = next((n for tag, cls in ROOTS for n in nodes if n.tag == tag and (cls is None or cls in n.classes.split())), None)
        if root is None:
            return ""
        parts: list[str] = []
        inside: list[Node | str] = [root]
        while inside:
            x = inside.pop()
            if isinstance(x, str):
                if s := x.strip():
                    parts.append(s)
            elif not _noise(x) and x.tag not in _RAW:
                inside.extend(reversed(_merged(x.children)))
        return re.sub(r"\n{3,}", "\n\n", "\n".join(parts)).strip()
    except Exception:  # a page that cannot be read gives nothing
        return ""


def _merged(children: list[Node | str]) -> list[Node | str]:
    """Neighbouring pieces of text are one text node."""
    out: list[Node | str] = []
    for c in children:
        if isinstance(c, str) and out and isinstance(out[-1], str):
            out[-1] += c
        else:
            out.append(c)
    return out


def _decoded(raw: bytes) -> str:
    m = re.search(rb"<meta[^>]+charset=[\"']?([\w-]+)", raw[:4096], re.I)
    for name in ("utf-8-sig", m[1].decode("ascii") if m else "utf-8"):
        try:
            return raw.decode(name)
        except (UnicodeDecodeError, LookupError):
            pass
    return raw.decode("utf-8", "replace")


def extract_html(page: Column) -> Column:
    """Text of html given as string or bytes, extracted in Arrow batches."""
    @F.pandas_udf("string")
    def texts(pages: pd.Series) -> pd.Series:
        return pages.map(extract)

    return texts(page)


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, html``: the bytes of every file under a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("content").alias("html"))

