"""Problem 2: items above a size limit cut at natural boundaries.

The text is parsed into a tree: sections under headings of several ranks, within them blocks parted by blank lines, list
items nested by the rank of their marks and their indent, lines, sentences, clauses, words, characters. Packing goes
bottom-up: what lies below a node that is too large is packed first, then neighbouring siblings are merged up to the
limit; a subtree that fits is never descended into. Each piece after the first begins exactly ``overlap`` characters
before the previous one ends.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limit and overlap, in code points, by kind of source.
LIMITS = {"html": (800, 100), "pdf": (2048, 512)}

_NUM = "一二三四五六七八九十百"
#: Headings by rank: marked, chapters and sections, numbered by one, two or three numbers; other short lines that stand alone as a block rank last.
_HEADINGS = [
    (re.compile(r"(#{1,6}) "), None), (re.compile(rf"第[{_NUM}\d]+[篇章]"), 1), (re.compile(rf"第[{_NUM}\d]+節"), 2), (re.compile(rf"[{_NUM}]+、"), 2), (re.compile(rf"[（(][{_NUM}]+[)）]"), 3),
    (re.compile(r"(?:Chapter|Part) \w+", re.I), 1), (re.compile(r"Section \w+", re.I), 2), (re.compile(r"(\d+(?:\.\d+)+)\.? "), 0),
]
_ALONE = 8
#: List marks by rank, after an indent.
_MARKS = [re.compile(rf"[{_NUM}]+[、．.]"), re.compile(rf"[（(][{_NUM}]+[)）]"), re.compile(r"\d+[.．、](?!\d)"), re.compile(r"[（(]?\d+[)）]"), re.compile(r"[（(]?[a-zA-Z][)）]"), re.compile(r"[-–•‣▪*·●○›] ?")]
_BLOCK, _LINE = re.compile(r"\n[^\S\n]*\n\s*"), re.compile(r"\n")
#: Each pattern ends where a child of the next lower level may end.
_LEVELS = [re.compile(r"[.!?。！？．…؟।]+[\"'”’」』）)\]]*\s*"), re.compile(r"[;；,，、:：]\s*"), re.compile(r"\s+")]


def _rank(block: str) -> int | None:
    """Rank of the heading a block is or begins with, if it does; 1 is the highest."""
    line, _, rest = block.lstrip().partition("\n")
    if not 0 < len(line.rstrip()) < 80:
        return None
    for p, rank in _HEADINGS:
        if m := p.match(line):
            return len(m[1]) if rank is None else 1 + m[1].count(".") if rank == 0 else rank
    alone = not rest.strip() and not re.search(r"[.!?。！？．…؟।,，;；、:：][\"'”’」』）)\]]*\s*$", line) and not any(p.match(line) for p in _MARKS)
    return _ALONE if alone else None


def _mark(line: str) -> tuple[int, int] | None:
    """Indent and rank of a line's list mark."""
    s = line.lstrip(" \t　")
    for rank, p in enumerate(_MARKS):
        if p.match(s):
            return len(line) - len(s), rank
    return None


@dataclass(slots=True)
class Node:
    """A stretch of text, with what it is made of where that is known already; ``level`` is the one to part it at else.

    Up to ``glued`` it is a heading or too little to stand alone, which is not parted from what follows.
    """

    start: int
    end: int
    kids: list[Node] | None = None
    level: int = 0
    glued: int = 0


def _nested(items: list[tuple[int, Node]], start: int, end: int) -> list[Node]:
    """Nodes under those of a smaller rank before them; the rank of the first stretch without one is the lowest."""
    root = Node(start, end, [])
    open_: list[tuple[int, Node]] = [(-1, root)]
    for rank, leaf in items:
        while open_[-1][0] >= rank:
            open_.pop()
        node = Node(leaf.start, leaf.end, [leaf])
        open_[-1][1].kids.append(node)
        open_.append((rank, node))
    _close(root, end)
    return root.kids


def _close(node: Node, end: int) -> None:
    """A node of nested ones reaches to the next of its rank."""
    todo = [(node, end)]
    while todo:
        n, stop = todo.pop()
        n.end = stop
        if n.kids and n.kids[-1].kids is not None:
            stops = [k.start for k in n.kids[1:]] + [stop]
            todo += [(k, z) for k, z in zip(n.kids, stops, strict=True) if k.kids is not None]


def tree(text: str) -> Node:
    """Sections and blocks of a text; below blocks a node is parted only when it is asked for."""
    edges = [0, *(m.end() for m in _BLOCK.finditer(text) if m.end() < len(text)), len(text)]
    blocks = [Node(a, z, None, 0) for a, z in zip(edges[:-1], edges[1:], strict=True)]
    sections: list[list[Node]] = [[]]
    ranks: list[int] = [0]
    for b in blocks:
        rank = _rank(text[b.start : b.end])
        if rank is not None:
            sections.append([])
            ranks.append(rank)
        sections[-1].append(b)
    items = [(r, Node(s[0].start, s[-1].end, s)) for r, s in zip(ranks, sections, strict=True) if s]
    return Node(0, len(text), _nested(items, 0, len(text)))


def _parted(text: str, node: Node) -> list[Node]:
    """The children of a node: a block's list items or lines, then sentences, clauses, words."""
    if node.kids is not None:
        return node.kids
    if node.level == 0:
        edges = [node.start, *(m.end() for m in _LINE.finditer(text, node.start, node.end) if m.end() < node.end), node.end]
        lines = [Node(a, z, None, 1) for a, z in zip(edges[:-1], edges[1:], strict=True)]
        marks = [_mark(text[x.start : min(x.end, x.start + 40)]) for x in lines]
        if sum(m is not None for m in marks) < 2:
            return lines
        seen = sorted({m for m in marks if m})
        items: list[tuple[int, Node]] = []
        for x, m in zip(lines, marks, strict=True):
            if m is None and items:  # a line without a mark belongs to the item before it
                held = items[-1][1]
                items[-1] = (items[-1][0], Node(held.start, x.end, [*(held.kids or [held]), x], 1))
            else:
                items.append((seen.index(m) + 1 if m else 0, x))
        return _nested(items, node.start, node.end)
    if node.level <= len(_LEVELS):
        p = _LEVELS[node.level - 1]
        ends = [m.end() for m in p.finditer(text, node.start, node.end) if node.start < m.end() < node.end]
        return [Node(a, z, None, node.level + 1) for a, z in zip([node.start, *ends], [*ends, node.end], strict=True)]
    return []


def boundaries(text: str, limit: int, overlap: int) -> list[int]:
    """Ends of the pieces of ``text``: the first at most ``limit``, each other at most ``limit - overlap`` after the one before."""
    room = limit - overlap
    small = max(overlap, room // 4)  # less than this is not left alone before something that must be parted
    # units of a node, bottom-up, without recursion: (node, its children still to pack, units so far)
    stack: list[tuple[Node, list[Node], list[tuple[int, int, bool]]]] = []

    def open_(node: Node) -> None:
        stack.append((node, _glued(node, _parted(text, node))[::-1], []))

    open_(tree(text))
    while True:
        node, todo, units = stack[-1]
        if todo:
            kid = todo.pop()
            if kid.end - kid.start <= room:
                units.append((kid.start, kid.end, True))
                continue
            lead = units.pop()[0] if units and units[-1][2] and _heads(text, units[-1]) else kid.start
            units[:] = merge(units, limit, room)
            if units and kid.start - units[-1][0] < small:
                lead = units.pop()[0]
            open_(Node(lead, kid.end, kid.kids, kid.level, kid.start) if lead < kid.start else kid)
            continue
        if not units:  # nothing to part it at
            first = min(node.end, node.start + (room if node.start else limit))
            units = [(node.start, first, False), *((a, min(a + room, node.end), False) for a in range(first, node.end, room))]
        packed = merge(units, limit, room)
        stack.pop()
        if not stack:
            return [z for _, z, _ in packed]
        stack[-1][2].extend((a, z, False) for a, z, _ in packed)


def _heads(text: str, unit: tuple[int, int, bool]) -> bool:
    """Whether a unit is a heading alone."""
    return unit[1] - unit[0] < 100 and "\n" not in text[unit[0] : unit[1]].strip() and _rank(text[unit[0] : unit[1]]) is not None


def _glued(node: Node, kids: list[Node]) -> list[Node]:
    """The children, the first of them with the heading the node begins with."""
    if node.glued and kids:
        while len(kids) > 1 and kids[0].end <= node.glued:
            kids = kids[1:]
        first = kids[0]
        kids = [Node(node.start, first.end, first.kids, first.level, node.glued), *kids[1:]]
    return kids


def merge(units: list[tuple[int, int, bool]], limit: int, room: int) -> list[tuple[int, int, bool]]:
    """Neighbouring units merged, in order, as far as they fit; what begins a text may be as long as the limit.

    Whole siblings (True) join what is before them; the pieces of a sibling that was too large join no other before it.
    """
    out: list[tuple[int, int, bool]] = []
    for a, z, whole in units:
        if out and whole and z - out[-1][0] <= (limit if out[-1][0] == 0 else room):
            out[-1] = (out[-1][0], z, out[-1][2])
        else:
            out.append((a, z, whole))
    return out


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, str]]:
    """``(start, piece)`` for each piece. A text within the limit is one piece; an empty one gives none."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    if len(text) <= limit:
        return [(0, text)] if text else []
    ends = boundaries(text, limit, overlap)
    starts = [0, *(e - overlap for e in ends[:-1])]
    return [(s, text[s:e]) for s, e in zip(starts, ends, strict=True)]


def limit_of(source_type: Column, which: int) -> Column:
    """Limit (0) or overlap (1) of a kind of source; unknown and null kinds count as html."""
    return F.when(F.lower(source_type) == "pdf", LIMITS["pdf"][which]).otherwise(LIMITS["html"][which])


def split_oversized(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", type_col: str = "source_type") -> DataFrame:
    """``id, piece_no, start, text`` of the pieces of every text that is really longer than its limit.

    The stated length is not read. Null and empty texts, and texts within the limit, give no rows. A narrow stage: the
    length test runs before Python, each text is cut alone, nothing is shuffled. Repeated rows are cut repeatedly.
    """
    long = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), limit_of(F.col(type_col), 0).alias("cap"), limit_of(F.col(type_col), 1).alias("lap")).where(F.length("text") > F.col("cap"))

    def cutting(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, n, s, t) for i, text, cap, lap in zip(b["id"], b["text"], b["cap"], b["lap"], strict=True) for n, (s, t) in enumerate(split_text(text, int(cap), int(lap)))]
            yield pd.DataFrame(rows, columns=["id", "piece_no", "start", "text"])

    return long.mapInPandas(cutting, "id long, piece_no int, start int, text string")
