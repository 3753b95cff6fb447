"""Golden cases and properties of the chunkers."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.operators import chunking as ch


def lengths(spark, texts, expr):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("t")).alias("c")).selectExpr("transform(c, x -> length(x))").collect()]


def test_paragraph_merge(spark):
    cases = {"a" * 798: [798], "a" * 799: [799], "a" * 800: [800], "a" * 1700: [800, 800, 100], "a" * 10 + "\n\n" + "b" * 900: [10, 912], "a" * 500 + "\n\n" + "b" * 400: [500, 502], "\n\n".join(["a" * 10, "b" * 3000, "c" * 10]): [10, 3012, 112], " \n　\n": [], "": []}
    assert lengths(spark, list(cases), ch.merged) == list(cases.values())


def test_windows(spark):
    cases = {1: [1], 1536: [1536], 1537: [1537, 1], 2048: [2048, 512], 2049: [2048, 513], 4000: [2048, 2048, 928]}
    assert lengths(spark, ["x" * n for n in cases], ch.windows) == list(cases.values())


def test_null_text_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "abc", 6)], "id long, text string, chunk_index int")
    assert [tuple(r) for r in ch.exploded(df, ch.merged(F.col("text")), "id").collect()] == [(2, "abc", 0, 3)]


def test_crlf_is_no_paragraph_break(spark):
    assert lengths(spark, ["a" * 500 + "\r\n\r\n" + "b" * 500], ch.merged) == [[800, 204]]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab 　字\n", max_size=6000), min_size=1, max_size=4))
def test_windows_rebuild_the_text(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("t", ch.windows(F.col("t")).alias("c")).collect()
    for r in rows:
        t = r.t.strip()
        assert list(r.c) == [w for a in range(0, len(t), 1536) if (w := t[a : a + 2048].strip())]


def test_hard_split_refuses_nothing(spark):
    assert lengths(spark, ["x" * 1601, ""], lambda c: ch.hard_split(c, 800)) == [[800, 800, 1], []]


def test_dispatch_by_kind(spark):
    df = spark.createDataFrame([("u", "pdf", "x" * 3000), ("v", "html", "x" * 3000)], "url string, source_type string, text string")
    got = sorted((r.url, r.chunk_index, r.chunk_len) for r in ch.chunk_records(df, "url").collect())
    assert got == [("u", 0, 2048), ("u", 1, 1464), ("v", 0, 800), ("v", 1, 800), ("v", 2, 800), ("v", 3, 600)]


@pytest.mark.parametrize("bad", [None])
def test_empty_table(spark, bad):
    assert ch.chunk_records(spark.createDataFrame([], "url string, source_type string, text string"), "url").count() == 0
