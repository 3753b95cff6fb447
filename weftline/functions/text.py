"""Scalar text functions as Column expressions; all of them run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters a Unicode-aware strip removes.
WHITESPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"


def strip(c: Column) -> Column:
    """Without white space of any script at either end."""
    return F.btrim(c, F.lit(WHITESPACE))


def collapse_newlines(c: Column) -> Column:
    """Three or more line breaks become two, then strip."""
    return strip(F.regexp_replace(c, "\n{3,}", "\n\n"))


def or_default(c: Column, default: str | int) -> Column:
    return F.coalesce(c, F.lit(default))


def if_empty(c: Column, other: Column) -> Column:
    """``c`` unless it is null or empty."""
    return F.when(F.coalesce(c, F.lit("")) == "", other).otherwise(c)


def title_from_url(url: Column) -> Column:
    """What follows the last slash, or the whole url if nothing does."""
    return if_empty(F.substring_index(url, "/", -1), url)


def suffix(path: Column) -> Column:
    """The last file suffix in lower case, with its dot; empty if there is none, or if the dot begins or ends the name."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)/*$", 1))


def is_pdf(path: Column) -> Column:
    return suffix(path) == ".pdf"


def head(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def one_line(c: Column) -> Column:
    return F.translate(c, "\n", " ")


def pdf_text(joined: Column, least: int) -> Column:
    """The text of a pdf from its joined pages: too short a text means a scan and gives nothing."""
    return F.when(F.length(joined) < least, F.lit("")).otherwise(collapse_newlines(joined))


def join_pages(pages: Column) -> Column:
    """Ordered ``(page_no, text)`` structs as one text; empty pages are skipped, blank ones leave their place."""
    some = F.filter(F.array_sort(pages), lambda p: F.coalesce(p["text"], F.lit("")) != "")
    return F.array_join(F.transform(some, lambda p: strip(p["text"])), "\n\n")
