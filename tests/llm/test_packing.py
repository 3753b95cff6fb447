from __future__ import annotations

from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import packing as pk

pytest.importorskip("tiktoken")


def fewest(sizes, capacity):
    best = len(sizes)
    for assign in product(range(len(sizes)), repeat=len(sizes)):
        load = np.bincount(assign, sizes)
        if load.max() <= capacity:
            best = min(best, int((load > 0).sum()))
    return best


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=5))
def test_bound_and_packing(sizes):
    a = np.array(sizes)
    bins = pk.best_fit(a, 20)
    assert np.bincount(bins, a).max() <= 20
    assert pk.lower_bound(a, 20) <= fewest(sizes, 20) <= bins.max() + 1


def test_bound_beats_the_sum():
    assert pk.lower_bound(np.array([11] * 6), 20) == 6 and pk.lower_bound(np.array([7] * 9), 20) == 5 and pk.lower_bound(np.array([], dtype=int), 20) == 0


def test_pack(spark):
    docs = [(i, "word " * (i % 40 + 1)) for i in range(200)] + [(500, "嵐湖大學👩‍🎓課程 " * 400), (501, None), (502, ""), (3, "word word")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS tokens", "'c' AS container", "'r' AS row")
    rows = pk.pack(df, capacity=64, items=60).collect()
    load = {}
    for r in rows:
        load[r.container] = load.get(r.container, 0) + r.tokens
    assert max(load.values()) <= 64 and all(0 < r.tokens <= 64 for r in rows)
    assert {r.id for r in rows} == {*range(200), 500} and sum(r.id == 3 for r in rows) == 2
    cut = sorted((r.piece_no, r.start, r.end) for r in rows if r.id == 500)
    assert cut[0][1] == 0 and cut[-1][2] == len(docs[200][1]) and all(a[2] == b[1] for a, b in zip(cut, cut[1:], strict=False))
    assert len(load) <= 1.05 * sum(r.tokens for r in rows) / 64 + 3
    assert pk.pack(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pk.pack(df, capacity=1)


def test_same_at_every_layout(spark):
    df = spark.createDataFrame([(i, "word " * (i % 30 + 1)) for i in range(100)], "doc_id long, text string")
    key = lambda d: sorted((r.id, r.container) for r in pk.pack(d, capacity=64, items=40).collect())
    assert key(df.repartition(2)) == key(df.repartition(7))
