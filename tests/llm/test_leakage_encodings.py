from __future__ import annotations

import numpy as np
import pytest

from weftline.llm import encodings as en
from weftline.llm import leakage as lk

ITEMS = [
    (1, "Choose the best answer.\nThe old ferry left the harbour at dawn with forty crates of lemons, and nobody saw the captain again until the autumn fair."),
    (2, "Choose the best answer.\nSeven painters rented the mill above the river in 1903 and covered every wall with portraits of the miller's nine daughters."),
    (3, "Choose the best answer.\nWhen the comet passed, the clockmaker stopped all his clocks and counted the seconds aloud for three days and nights."),
    (4, "稻穀歉收的秋天，鯨骨涼亭只剩柳條魚籠九百件，合唱團低音部拆下了繡線樣本，燈塔志工在霧尾橋墩下連夜晾乾舊票根。"),
]


def tables(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "0 AS item_id", "'' AS similarity"), spark.createDataFrame(ITEMS, "item_id long, text string")


def test_leaks(spark):
    a, b, z = ITEMS[0][1].split("\n")[1], ITEMS[1][1].split("\n")[1], ITEMS[3][1]
    filler = "Students should hand in the form at the desk before noon and keep a copy of it for their own files. " * 5
    docs = [
        (1, filler + a + filler), (2, a.upper().replace(",", "").replace(" ", "\n")), (3, filler + b[: len(b) * 2 // 3]), (4, filler + b[: len(b) // 4]), (5, "Choose the best answer.\n" + filler), (6, None), (7, ""),
        (8, filler + z.replace("，", " ").replace("柳條", "竹條")), (9, a[:70] + " " + filler + a[70:]), (1, filler + a + filler), (10, (filler * 200) + a),
    ]
    got = sorted({(r.doc_id, r.item_id) for r in lk.leaked(*tables(spark, docs)).collect()})
    assert got == [(1, 1), (2, 1), (3, 2), (8, 4), (9, 1), (10, 1)]


def test_blocks_of_items_and_empty_tables(spark, monkeypatch):
    docs, items = tables(spark, [(1, ITEMS[0][1]), (2, ITEMS[3][1])])
    monkeypatch.setattr(lk, "BLOCK", 3)
    assert sorted((r.doc_id, r.item_id) for r in lk.leaked(docs, items).collect()) == [(1, 1), (2, 4)]
    assert lk.leaked(docs.limit(0), items).count() == 0 and lk.leaked(docs, items.limit(0)).count() == 0


def test_multi_index_finds_all_within_the_radius():
    rng = np.random.default_rng(0)
    x = lk.Index([(i, "".join(rng.choice(list("abcdefgh"), 120))) for i in range(30)], "spaced")
    base = x.prints[rng.integers(0, len(x.prints), 300)]
    flips = np.array([np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, 3, replace=False).astype(np.uint64)) for _ in base])
    queries = base ^ flips
    q, p = x.near(queries)
    got = set(zip(q.tolist(), p.tolist(), strict=True))
    for k, f in enumerate(queries):
        near = np.flatnonzero(np.bitwise_count(x.prints ^ f) <= lk.RADIUS)
        assert {(k, int(n)) for n in x.of[near]} <= got


CLEAN = ["提醒您，學生事務協調會討論課程，尚未定案。", "Prof. Núñez’s façade seminar starts at 9 – don’t miss it.", "Für den Kurs gibt es höchstens 13 Plätze.", "Coöperation with São Lindo and Malmberg–Øst goes on.", "希臘字母α、β與Ð、þ、Ã等符號見附錄。", "├必修┼3學分┤選修│", "See the “résumé” guide, 6°C ± 2°."]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_text_stays(text):
    common = set("".join(CLEAN)) - set("ÃÐþ")
    line, used, bad = en.Doctor(common).mend(text)
    assert (line, used, bad) == (text, [], False)


@pytest.mark.parametrize(("real", "view"), [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp437"), ("utf-8", "mac_roman"), ("big5", "latin-1"), ("gbk", "latin-1"), ("utf-8", "gbk")])
def test_round_trip(real, view):
    text = "提醒您學生事務協調會討論課程尚未定案請洽圖書資訊處辦理"
    raw = text.encode(real)
    shown = raw.decode(view) if view in ("latin-1", "cp437", "mac_roman") else "".join(en._table(view)[b] if b > 127 else chr(b) for b in raw) if view == "cp1252" else raw.decode(view, "ignore")
    line, used, bad = en.Doctor(set(text)).mend("A7 " + shown)
    assert bad and used
    if view != "gbk":
        assert line == "A7 " + text


def test_twice_and_lost():
    once = "São – façade".encode().decode("cp1252")
    twice = once.encode("cp1252").decode("latin-1").encode().decode("cp1252") if False else once.encode().decode("cp1252", "replace")
    d = en.Doctor(set("Sãoç–"))
    assert d.mend(once)[0] == "São – façade" and d.mend(twice)[2]
    assert d.mend("lost � here")[2]


def test_table(spark):
    clean = [(i, f"第{i}條 申請日期 2024年{i % 12 + 1}月3日 電話 123456{i:02d}，提醒您注意課程事項。", 1) for i in range(40)]
    garbled = [(100, clean[3][1].encode().decode("latin-1"), 1), (101, clean[5][1] + "\n" + clean[7][1].encode("big5").decode("latin-1"), 1), (102, None, 1), (103, "", 1), (100, clean[3][1].encode().decode("latin-1"), 1)]
    df = spark.createDataFrame(clean + garbled, "doc_id long, text string, id int").selectExpr("*", "'x' AS restored", "1 AS line", "2 AS skeleton")
    got = en.mended(df).collect()
    assert sorted(r.id for r in got) == [100, 100, 101] and all("申請日期" in r.restored for r in got)
    assert en.mended(df.limit(0)).count() == 0


def test_transformations_outside_the_lists_are_learned_from_twins(spark):
    thai, czech = "ประกาศรับสมัครนักศึกษาใหม่", "Příští přednáška začíná v říjnu"
    clean = [(i, f"2024-{i:04d} {thai}", 1) for i in range(1200)] + [(i, f"2025-{i:04d} {czech}", 1) for i in range(1200, 2400)]
    as_latin = lambda t: t.encode("cp874").decode("latin-1")
    as_western = lambda t: t.encode("cp1250").decode("cp1252")
    garbled = [(3000 + i, as_latin(clean[i][1]), 1) for i in range(3)] + [(4000 + i, as_western(clean[1200 + i][1]), 1) for i in range(3)]
    alone = [(5000, as_latin("ข่าว ประกาศ"), 1), (5001, as_western("v říjnu"), 1)]  # without a twin
    df = spark.createDataFrame(clean + garbled + alone, "doc_id long, text string, n int").repartition(3)
    got = {r.id: r.restored for r in en.mended(df).collect()}
    want = {3000 + i: clean[i][1] for i in range(3)} | {4000 + i: clean[1200 + i][1] for i in range(3)} | {5001: "v říjnu"}
    assert set(got) == {*want, 5000}
    assert {k: got[k] for k in want} == want


def test_every_twin_of_a_key_is_compared(spark):
    """Many clean lines of one key: the twins of the garbled ones are among them, wherever their hashes stand."""
    rng = np.random.default_rng(5)
    clean = [(i, "2024-0315 " + " ".join("".join(rng.choice(list("ěčřůďň"), 3)) for _ in range(8)), 1) for i in range(1000)]
    garbled = [(2000 + i, clean[i][1].encode("cp1250").decode("cp1252"), 1) for i in (7, 311)]
    df = spark.createDataFrame(clean + garbled, "doc_id long, text string, n int").repartition(3)
    assert {r.id: r.restored for r in en.mended(df).collect()} == {2007: clean[7][1], 2311: clean[311][1]}


def test_every_set_of_transformations_counts(spark, monkeypatch):
    sets = [([f"v{k}|r{k % 7}", f"w{k}|r1", "koi8-r|utf-8"][: 1 + k % 3], 1 + k % 5) for k in range(40)] + [(["last|one"], 2), (["once|only"], 1)]
    df = spark.createDataFrame(sets, "options array<string>, count long")
    want = en.learn(sets)
    assert ("last", "one") in want and ("once", "only") not in want and en.learn_from(df) == want
    monkeypatch.setattr(en, "MOST_SETS", 3)
    assert en.learn_from(df) == want


@pytest.mark.parametrize("runs", [1, 3, 4, 6])
def test_every_garbled_run_is_undone(runs):
    clean = "學生事務協調會討論課程尚未定案請於五月三日前送交註冊組辦理"
    doctor = en.Doctor(set(clean))
    line = " and then ".join([clean.encode("big5").decode("latin-1")] * runs)
    assert doctor.mend(line)[0] == " and then ".join([clean] * runs)


@pytest.mark.parametrize("block", [1, 2, 2000])
def test_blocks_do_not_change_what_leaks(spark, block):
    head = "Read the passage and choose the best answer."
    words = "river lantern market bridge copper winter garden letter harbour violet".split()
    body = lambda k: " ".join(words[(k * 3 + j * (k + 1)) % 10] + str(k * j % 7) for j in range(40))
    items = spark.createDataFrame([(k, f"{head}\n{body(k)}") for k in range(1, 5)], "item_id long, text string")
    docs = spark.createDataFrame([(1, head + " " + "nothing else here " * 30), (2, "x " + body(2)), (3, body(4)[: len(body(4)) * 3 // 4])], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in lk.leaked(docs, items, block=block).collect()) == [(2, 2), (3, 4)]
