"""Page texts of pdf files, for the plain kind: Flate or bare streams, strings in one-byte or UTF-16 encodings.

An interface with a small reader of its own: fonts with a private encoding, encrypted files and other filters are refused
with ``PdfError``; a caller that has a full pdf library passes its page texts on instead.
"""

from __future__ import annotations

import re
import zlib


class PdfError(ValueError):
    """The file cannot be read; the message says why."""


_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_REF = re.compile(rb"(\d+)\s+\d+\s+R")
_TEXT = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|-?\d+(?:\.\d+)?|[A-Za-z'\"*]+", re.S)
_ESCAPE = re.compile(rb"\\([nrtbf()\\]|[0-7]{1,3}|\r?\n)")
_NAMED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: A gap this far to the left, in thousandths of the font's size, is a space.
_GAP = -200


def page_texts(raw: bytes) -> list[str]:
    """The texts of a file's pages, in order."""
    if not raw.startswith(b"%PDF-"):
        raise PdfError("no pdf file")
    if b"/Encrypt" in raw:
        raise PdfError("encrypted")
    objects = {int(m[1]): m[2] for m in _OBJECT.finditer(raw)}
    if not objects:
        raise PdfError("no objects")
    return [_page(objects, objects[n]) for n in _order(objects)]


def _order(objects: dict[int, bytes]) -> list[int]:
    """Numbers of the pages: from the root of the page tree down, else as they stand in the file."""
    pages = {n for n, o in objects.items() if re.search(rb"/Type\s*/Page\b(?!s)", o)}
    kids = {n: [int(k) for k in _REF.findall(m[1])] for n, o in objects.items() if (m := re.search(rb"/Kids\s*\[(.*?)\]", o, re.S))}
    below = {k for v in kids.values() for k in v}
    out, todo, seen = [], [n for n in sorted(kids, reverse=True) if n not in below], set()
    while todo:
        n = todo.pop()
        if n in seen:
            continue
        seen.add(n)
        if n in pages:
            out.append(n)
        todo.extend(reversed(kids.get(n, [])))
    return out + sorted(pages - set(out))


def _page(objects: dict[int, bytes], page: bytes) -> str:
    m = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", page)
    numbers = [int(n) for n in _REF.findall(m[1])] if m else []
    return _shown(b"\n".join(_stream(objects.get(n, b"")) for n in numbers))


def _stream(obj: bytes) -> bytes:
    m = _STREAM.search(obj)
    if not m:
        return b""
    head = obj[: m.start()]
    filters = re.findall(rb"/(\w+Decode)", head)
    if any(f != b"FlateDecode" for f in filters):
        raise PdfError(f"filter {filters[0].decode()}")
    try:
        return zlib.decompressobj().decompress(m[1]) if filters else m[1]
    except zlib.error as e:
        raise PdfError(f"broken stream: {e}") from e


def _string(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = _ESCAPE.sub(lambda m: _NAMED.get(m[1]) or (bytes([int(m[1], 8) & 255]) if m[1].isdigit() else b"" if m[1][-1:] == b"\n" else m[1]), token[1:-1])
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")


def _shown(content: bytes) -> str:
    """What the text operators of a content stream show; moves to another line break it."""
    out: list[str] = []
    held: list[bytes] = []
    for m in _TEXT.finditer(content):
        t = m[0]
        if t in (b"Tj", b"TJ", b"'", b'"'):
            if t in (b"'", b'"'):
                out.append("\n")
            for x in held:
                if x[:1] in (b"(", b"<"):
                    out.append(_string(x))
                elif t == b"TJ" and re.fullmatch(rb"-?[\d.]+", x) and float(x) < _GAP:
                    out.append(" ")
            held = []
        elif t in (b"T*", b"ET") or t in (b"Td", b"TD") and len(held) > 1 and float(held[-1]) != 0 or t == b"Tm":
            out.append("\n")
            held = []
        elif t[:1].isalpha():
            held = []
        else:
            held.append(t)
    return re.sub(r" *\n[ \n]*", "\n", "".join(out)).strip()
