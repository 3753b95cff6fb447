"""Conversation state and the display of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import or_default, strip

#: How sources are shown.
SOURCES_HEADER, NO_SOURCES, PDF_ICON, PAGE_ICON = "**參考來源：**", "*（未找到相關來源）*", "📄", "🌐"


def _turn(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def appended(history: Column, query: Column, answer: Column) -> Column:
    """History with the question as typed and its answer; a blank question leaves it as it is."""
    h = F.coalesce(history, F.array().cast("array<struct<role:string,content:string>>"))
    return F.when(strip(or_default(query, "")) == "", h).otherwise(F.concat(h, F.array(_turn("user", query), _turn("assistant", answer))))


def asked(query: Column) -> Column:
    """What is asked: the question without outer white space; null if nothing remains."""
    return F.nullif(strip(query), F.lit(""))


def sources_view(sources: Column) -> Column:
    """Sources as Markdown: one line per url with an icon by its kind, or the fixed line for none."""
    line = lambda s: F.concat(F.when(s["source_type"] == "pdf", F.lit(PDF_ICON)).otherwise(F.lit(PAGE_ICON)), F.lit(" "), s["url"])
    return F.when(F.coalesce(F.size(sources), F.lit(0)) <= 0, F.lit(NO_SOURCES)).otherwise(F.concat(F.lit(SOURCES_HEADER + "\n"), F.array_join(F.array_distinct(F.transform(sources, line)), "\n")))


def cleared() -> tuple[list, str, str]:
    """State of an emptied conversation: history, question box, sources."""
    return [], "", ""


def histories(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "content") -> DataFrame:
    """``conv_id, history``: each conversation's turns in order; repeated rows count once, rows without role or content are left out."""
    some = turns.where(F.col(role).isNotNull() & (strip(or_default(F.col(content), "")) != "")).select(conv, turn, role, content).distinct()
    rows = some.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(content).alias("content")))).alias("h"))
    return rows.select(conv, F.transform("h", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("history"))
