"""Residue, body, sentences, languages, alignment: small made pages."""

from __future__ import annotations

import re
import time

import numpy as np
import pytest

from weftline.llm import alignment as al
from weftline.llm import boilerplate as bp
from weftline.llm import languages as lg
from weftline.llm import residue as rs
from weftline.llm import sentences as sn
from weftline.llm import queries
from weftline.llm.boosting import Boosted
from weftline.llm.gru import STRIDE, BiGru, frames

RESIDUE = [
    "This service opens only with JavaScript switched on", "404 錯誤\n您要找的頁面不存在或已被移除", "Lorem ipsum dolor sit amet consectetur elit.", "測試測試測試 3", "載入中，請稍候……", "Dear {{name}}:\nyour request is approved",
    "News\nRules\nStaff\nContact\n\nAccess denied: you lack permission to view this resource\n\n© 2020 X, all rights reserved", "課程於週一開始。費用：XXX元（待補）。請同學注意。", "上課地點：${student_name}\n公文範本中的{{姓名}}欄位請勿修改。",
]
REAL = [
    "公文範本中的{{姓名}}欄位請由圖資處統一填寫，勿自行修改。", "In the sample of the form, the field {{name}} is filled in by the office.", "The enrollment system needs JavaScript enabled, so update the browser first. Courses start in May and end in June.",
    "網頁若畫面顯示404，新生請清除Cookie後於12:00再試一次。", "", None, "  \n ", "[ Go back ]\n\nCourses start in May.",
]


@pytest.mark.parametrize("text", RESIDUE)
def test_residue(text):
    assert rs.is_residue(text, "html")


@pytest.mark.parametrize("text", REAL)
def test_no_residue(text):
    assert not rs.is_residue(text, "html")


def test_residue_tables(spark):
    texts = spark.createDataFrame([(1, "u", "404 錯誤\n您要找的頁面不存在或已被移除", "html"), (2, "v", "Courses start in May.", "html"), (3, None, "Down for maintenance", None), (4, "w", None, "pdf")], "ext_id long, url string, text string, source_type string").selectExpr("*", "1 AS id", "2 AS page", "3 AS residue")
    chunks = spark.createDataFrame([(10, "u", "x"), (11, "v", "y"), (12, None, "z")], "chunk_id long, url string, text string")
    assert sorted((r.table_name, r.row_id) for r in rs.found(texts, chunks).collect()) == [("chunks", 10), ("extracted_texts", 1), ("extracted_texts", 3)]
    assert rs.found(texts.limit(0), chunks.limit(0)).count() == 0
    assert [r.ext_id for r in rs.without_residue(texts, "ext_id").orderBy("ext_id").collect()] == [2, 4]


def pages_():
    zh = ["提醒您，學生停修課程須經授課教師同意，且剩餘學分不得低於{}。", "另外，申請表須於5月{}日前送交註冊組辦理。", "依規定，平均成績達{}分者得申請超修。"]
    en = ["Reminder: Dr. Dresk explains the rules at No. {} North Hill.", "In addition, bring an ID when collecting form {} at 3:15 p.m. each day.", "By rule, the fee is NT${},000 for Ph.D. students."]
    out = []
    for i in range(80):
        body = [s.format(i % 9 + 1) for s in (zh if i % 2 else en)]
        menu = "關於我們\n最新消息\n行事曆\n聯絡我們" if i % 2 else "About Us\nNews\nCalendar\nContact"
        head = f"第{i}課程說明" if i % 2 else f"Course Guide {i}"
        foot = f"© {2000 + i % 20} 大學 版權所有" if i % 2 else f"Copyright {2000 + i % 20} University"
        sep = "" if i % 2 else " "
        out.append((i, f"http://x/{'zh' if i % 2 else 'en'}/p{i // 2}", f"{menu}\n\n{head}\n{sep.join(body)}\n\n{foot}", "html"))
    return out


@pytest.fixture(scope="module")
def table(spark):
    odd = [(900, None, None, "html"), (901, "http://x/e", "", None), (902, "http://x/w", " \n ", "pdf"), (903, "http://x/l", "word " * 40000, "html"), (1, "http://x/zh/p0", pages_()[1][2], "html")]
    return spark.createDataFrame(pages_() + odd, "ext_id long, url string, text string, source_type string").selectExpr("*", "1 AS id", "2 AS start", "'k' AS kind", "'c' AS class").cache()


def test_furniture(spark, table):
    got = {}
    for r in bp.furniture_lines(table).collect():
        got.setdefault(r.id, set()).add(r.line_no)
    assert all(got.get(i) == {0, 1, 2, 3, 8} for i in range(80)), {i: got.get(i) for i in range(80) if got.get(i) != {0, 1, 2, 3, 8}}
    assert bp.furniture_lines(table.limit(0)).count() == 0
    bodies = {r.id: r.body for r in bp.main_bodies(table).collect()}
    assert bodies[2].startswith("Course Guide 2\nReminder")


def test_sentences(spark, table):
    got = {}
    for r in sn.sentence_units(table).collect():
        got.setdefault(r.id, set()).add(r.start)
    for i, _, text, _ in pages_():
        body = text.split("\n")[6]
        at = text.index(body)
        marks = ["提醒您", "另外", "依規定"] if i % 2 else ["Reminder", "In addition", "By rule"]
        assert {s for s in got[i] if at <= s < at + len(body)} == {text.index(m) for m in marks}, i
    assert sn.sentence_units(table.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "kind", "starts"),
    [
        ("他說：「先選課，再繳費。」因此不必提早。下一句。", "html", [0, 20]), ("「受け付けません。」と述べた。次です。", "html", [0, 15]), ("1. 第一項。\n2. 第二項。", "html", [0, 8]), ("Page 3.\n\nIt costs 3.97 euros, e.g. today. Next one", "html", [0, 9, 42]),
        ("提醒您，本\n課程停開。另外\n，請注意。\n\n標題", "pdf", [0, 11, 21]), ("", "html", []), (None, "pdf", []), ("  \n\n ", "pdf", []), ("《怎麼選課？手冊》第3頁。好！！再來？", "html", [0, 13, 16]),
    ],
)
def test_units(text, kind, starts):
    assert [a for a, _ in sn.Splitter().units(text, kind)] == starts


def test_stated_languages():
    s = lg.stated
    assert s("https://zh-tw.a.example/x") == {"zh"} and s("https://a.example/en-us/x") == {"en"} and s("https://a.example/x?lang=ja") == {"ja"} and s("https://a.example/f_12_de.pdf") == {"de"}
    assert s("https://lang.a.example/files/x_1.pdf") == set() and s(None) == set() and s("https://a.example/x?ref=home") == set()
    w = lg.without_language
    assert w("https://zh-tw.a.example/x") == w("https://en.a.example/x") == "https://a.example/x" and w("https://a.example/zh/x") == w("https://a.example/x?lang=en") and w("https://a.example/f_1_zh.pdf") == w("https://a.example/f_1_en-us.pdf")


def test_gradient_is_right():
    net = BiGru(3, hidden=4, seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, n = frames([b"abcdefghij", b"xyz"])
    y = np.full((*x.shape[:2], STRIDE), -1)
    y[0, 0], y[1, 0, : 10 - STRIDE], y[0, 1, :3] = 0, 2, 1  # every byte of both texts has a label of its own
    _, grad = net.gradients(x, n, y)
    rng = np.random.default_rng(0)
    e = (1, ord("b"), 2)
    for k in ("e", "if", "ib", "uf", "ub", "kf", "w", "c"):
        at = e if k == "e" else tuple(int(rng.integers(0, d)) for d in net.p[k].shape)
        old = net.p[k][at]
        net.p[k][at] = old + 1e-3
        up = net.gradients(x, n, y)[0]
        net.p[k][at] = old - 1e-3
        down = net.gradients(x, n, y)[0]
        net.p[k][at] = old
        assert abs((up - down) / 2e-3 - grad[k][at]) < 2e-4, k


WORDS = {"en": "the cat sat on a mat with some milk".split(), "de": "der hund und die katze sind nicht im haus".split(), "ko": "과목 정원은 명입니다 수강 변경은".split()}


@pytest.fixture(scope="module")
def net():
    rng = np.random.default_rng(0)
    return lg.fit_network([(" ".join(rng.choice(WORDS[k], 6)) + ".", k) for k in WORDS for _ in range(60)])


def test_network_learns(net):
    rng = np.random.default_rng(5)
    test = [(" ".join(rng.choice(WORDS[k], 6)) + ".", k) for k in WORDS for _ in range(30)]
    score, sizes = lg.pooled(net, [t for t, _ in test], [[len(t)] for t, _ in test])
    assert np.mean([lg.LANGUAGES[s.argmax()] == k for s, (_, k) in zip(score, test, strict=True)]) > 0.95
    assert sizes.tolist() == [len(t.encode()) for t, _ in test]


def test_every_byte_has_a_label(net):
    rng = np.random.default_rng(6)
    right = seen = 0
    for _ in range(30):
        keys = list(rng.permutation(list(WORDS))[:2])
        parts = [" ".join(rng.choice(WORDS[k], 6)) + ". " for k in keys]
        raw = [p.encode() for p in parts]
        lp, _ = net.log_probs([b"".join(raw)])
        by_byte = lp[:, :, :, 0].transpose(2, 0, 1).reshape(-1, len(lg.LANGUAGES))[: len(raw[0]) + len(raw[1])]
        truth = np.repeat([lg.LANGUAGES.index(k) for k in keys], [len(r) for r in raw])
        right += int((by_byte.argmax(axis=1) == truth).sum())
        seen += len(truth)
    assert right > 0.95 * seen


def test_both_ways_to_run_the_network_agree(net):
    texts = [b"the cat sat", "과목 정원은 명입니다 수강".encode() * 9, b"x"]
    native, n = net.log_probs(texts)
    held, net._session = net._session, False
    plain, _ = net.log_probs(texts)
    net._session = held
    inside = np.arange(native.shape[2])[:, None] < n[None, :]
    assert np.abs(native - plain)[:, :, inside].max() < 1e-4


@pytest.mark.parametrize(
    ("text", "parts"),
    [("One two three. Four five!", 2), ("See Prof. Dresk on Dec. 5 for Ph.D. work.", 1), ("先選課。再繳費！好", 3), ("先選課再繳費　之後再來", 2), ("請見說明.下一句", 2), ("v6.1.4 at https://x.y/z", 1), ("", 1)],
)
def test_parts(text, parts):
    ends = lg.parts_of(text)
    assert len(ends) == parts and ends[-1] == len(text)


def test_segments(spark, table):
    found = lg.segments(table)
    lang = {r.id: r.record_lang for r in found.collect()}
    assert np.mean([lang.get(i) == ("zh" if i % 2 else "en") for i in range(80)]) > 0.95
    assert lg.unstated(found).where("id < 80").count() <= 4
    assert lg.segments(table.limit(0)).count() == 0


def test_alignment(spark):
    zh = ["第{a}號申請表須於5月{b}日前送交註冊組。", "圖書館第{a}室開放{b}小時。", "學費每人{a}元，分{b}期繳納。", "宿舍尚有{a}床，月租{b}元。"]
    en = ["Form No. {a} must reach the registration office by May {b}.", "Room {a} of the library is open for {b} hours.", "Tuition is {a} each, paid in {b} parts.", "The dormitory has {a} beds left at {b} a month."]
    rng = np.random.default_rng(3)
    pairs, truth = [], []
    for _ in range(60):
        nums = [dict(a=int(rng.integers(100, 999)), b=int(rng.integers(10, 28))) for _ in zh]
        order = rng.permutation(4)
        pairs.append(([s.format(**n) for s, n in zip(zh, nums, strict=True)], [en[k].format(**nums[k]) for k in order][:3]))
        truth.append({(int(k), j) for j, k in enumerate(order[:3])})
    forth, back = al.fit(pairs)
    got = [set(al.align(a, b, forth, back)) for a, b in pairs]
    hit = sum(len(g & t) for g, t in zip(got, truth, strict=True))
    assert hit >= 0.95 * sum(map(len, truth)) and hit >= 0.95 * sum(map(len, got))
    assert al.align([], ["x"], forth, back) == [] and al.tokens("114年5月3日 下午3時15分") == ["#2025", "年", "#5", "月", "#3", "日", "#15:15"]


def test_aligned_table(spark, table):
    assert {c for c in al.aligned(table.limit(0)).columns} == {"id_1", "start_1", "id_2", "start_2"}
    rows = al.aligned(table).collect()
    assert all(r.id_1 < r.id_2 for r in rows)


def test_translation_tables_read_every_version_pair(spark):
    class Lines:  # each line is a sentence
        def sentences(self, some):
            return [[(m.start(), m.end()) for m in re.finditer(r"[^\n]+", t)] for t, _ in some]

    # the words of a page stand on three pages only: a table fitted on some of the pages has no translation for the others
    rng = np.random.default_rng(11)
    han, n = [chr(0x4E00 + i) for i in rng.permutation(9000)], 1500
    said, rows = [], []
    for i in range(n):
        z, e, x = "".join(han[i // 3 * 8 : i // 3 * 8 + 8]), f"thing{chr(97 + i // 3 % 26)}{chr(97 + i // 78)} makes", rng.integers(100, 9999)
        said.append(([f"{z}有{x}人", z], [f"{e} {x} men", e]))
        rows += [(2 * i + k, f"https://a.org/{lang}/{i}", "\n".join(said[-1][k])) for k, lang in enumerate(("zh", "en"))]
    forth, back = al.fit(said)
    want = {(2 * i, j and len(z[0]) + 1, 2 * i + 1, k and len(e[0]) + 1) for i, (z, e) in enumerate(said) for j, k in al.align(z, e, forth, back)}
    assert sum(r[1] > 0 and r[3] > 0 for r in want) > 0.9 * n
    df = spark.createDataFrame(rows, "ext_id long, url string, text string").selectExpr("*", "'html' AS source_type")
    assert {tuple(r) for r in al.aligned(df, model=Lines()).collect()} == want


def test_texts_of_versions_move_only_if_keys_are_many(spark, monkeypatch):
    class Lines:
        def sentences(self, some):
            return [[(m.start(), m.end()) for m in re.finditer(r"[^\n]+", t)] for t, _ in some]

    rows = [(2 * i + k, f"https://a.org/{lang}/{i}", text) for i in range(20) for k, (lang, text) in enumerate((("zh", "今天下午3時開會"), ("en", "We meet at 3 p.m. today"))) if i < 15 or k]
    df = spark.createDataFrame(rows, "ext_id long, url string, text string").selectExpr("*", "'html' AS source_type")
    plans, cut = [], al.cut
    monkeypatch.setattr(al, "cut", lambda d, name: (plans.append(d._jdf.queryExecution().executedPlan().toString()) if name == "versions" else None) or cut(d, name))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = []
        for most in (100, 0):
            monkeypatch.setattr(al, "MOST_KEYS", most)
            got.append(sorted(tuple(r)[:3] for r in al.versions(df, "ext_id", "text", "source_type", "url", Lines()).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got[0] == got[1] and len(got[0]) == 30
    assert "BroadcastHashJoin" in plans[0] and "SortMergeJoin" in plans[1]


def test_sentences_of_long_versions_are_anchored_by_their_words():
    n = 1500  # 2.25 million pairs of sentences, which took seconds one by one
    a, b = [["室", f"#{1000 + i}", "library"] for i in range(n)], [["room", f"#{1000 + 7 * i % n}", "library"] for i in range(n)]
    lexicon = al.Lexicon()
    began = time.process_time()
    got = al.anchored(lexicon.code(a), lexicon.code(b), lexicon)
    assert time.process_time() - began < 1.5
    assert got == sorted((7 * i % n, i) for i in range(n))
    assert al.anchored(lexicon.code([]), lexicon.code(b), lexicon) == [] and al.anchored(lexicon.code([[], ["a"]]), lexicon.code([[]]), lexicon) == []


def test_ratios_are_sums_over_words():
    table = al.Table({"甲": {"one": 0.5, "uno": 0.2}, "乙": {"two": 0.9, "one": 0.1}}, {"one": 0.3, "two": 0.2})
    a, b = [["甲", "乙", "#5"], ["乙", "nasa", "乙"], []], [["one", "two", "one"], ["#5", "nasa", "new"], [], ["#7"]]
    lexicon = al.Lexicon()
    got, spans = table.single_and_span(lexicon.code(a), lexicon.code(b), lexicon)

    def ratio(s, t):
        def word(w):
            q = max([table.p.get(v, {}).get(w, 0) for v in s] or [0]) or (al.KEPT if w in s and (w[0] == "#" or w.isascii()) else 0)
            ground = al.NUMBER if w[0] == "#" else max(table.background.get(w, al.NUMBER), 1e-5)
            return np.log(1 - al.TRUST + al.TRUST * q / ground) if q else np.log(1 - al.TRUST) * (1 if w[0] == "#" else 0.35)

        return sum(map(word, t)) / np.sqrt(1 + len(t) / 12)

    assert np.allclose(got, [[ratio(s, t) for t in b] for s in a])
    assert np.allclose(spans, [[ratio(s + x, t) for t in b] for s, x in zip(a[:-1], a[1:], strict=True)])


def test_few_states_decode_as_many():
    rng = np.random.default_rng(8)
    for n in (1, 3, 80, 90):  # 256 states lie between
        r, x = rng.normal(0, 4, (n, 7)).round(), rng.normal(0, 4, (max(0, n - 1), 7)).round()
        far = np.full((90, 7), -1e6)  # sentences that no path reaches make many states of few
        wide, span = far.copy(), far[1:].copy()
        wide[:n], span[: n - 1] = r, x
        assert al.decode(r, x) == al.decode(wide, span)


def test_counts_are_packed():
    for c in (np.zeros(0), np.zeros(9), np.array([0, 0.5, 0, 0, 0, 0, 0, 0, 3.25, 0, 1e-300])):
        assert (al._unpacked(al._packed(c), len(c)) == c).all() and len(al._packed(c)) == -(-len(c) // 8) + 8 * (c > 0).sum()


@pytest.mark.parametrize("sentences,side", [(["“Hello” – there…", "中文 mixed with many latin letters"], "en"), (["今天下午3時開會。", "ok then"], None), (["今天下午開會。", "会議は三時からです", "12 34"], "zh"), (["Ünder", "1234"], None)])
def test_side_of(sentences, side):
    assert al.side_of(sentences) == side


def test_translation_tables_are_those_of_fitting_in_memory(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = [[f"{c}{i}x" for i in map(chr, range(97, 117))] for c in "ab"]
    some = [(" ".join([*rng.choice(words[0], 6), "#3"]), " ".join([*rng.choice(words[1], 5), "bax", "bax", "#3"])) for _ in range(300)] + [("", "bbx"), ("#1", "bcx b"), ("aax", "")]
    df = spark.createDataFrame(some, "z string, e string")
    pairs = [(z.split(), e.split()) for z, e in some]
    want = al.fit_table(pairs), al.fit_table([(e, z) for z, e in pairs])
    for block, d in ((al.BLOCK, df), (400, df.repartition(7))):  # the second deals words to several rows
        monkeypatch.setattr(al, "BLOCK", block)
        for got, w in zip(al.fitted(d), want, strict=True):
            assert got.background == w.background and {v: x.keys() for v, x in got.p.items()} == {v: x.keys() for v, x in w.p.items()}
            assert all(abs(p - w.p[v][k]) < 1e-9 for v, x in got.p.items() for k, p in x.items())
    assert al.fitted(df.limit(0)) == (al.Table({}, {}), al.Table({}, {}))


def test_boosting_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    b = Boosted.fit(x[:400], y[:400], least=1)
    assert ((b.score(x[400:]) > 0) == y[400:]).mean() > 0.9


def test_boosting_fits_all_its_trees_and_scores_as_they_say():
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.normal(size=(600, 5)), rng.integers(0, 2, 600), rng.integers(0, 4, 600)]).astype(np.float32)
    b = Boosted.fit(x, (x[:, 0] + x[:, 5] * x[:, 1] > 0).astype(float))
    assert len(b.trees) == 50
    bins, want = Boosted._bin(x, b.edges), np.full(len(x), b.prior)
    for feature, cut, leaf in b.trees:
        node = np.zeros(len(x), dtype=int)
        for level in range(b.depth):
            at = 2**level - 1 + node
            node = 2 * node + ((bins[np.arange(len(x)), feature[at]] > cut[at]) & (cut[at] != 255))
        want += leaf[node]
    assert np.allclose(b.score(x), want)


def test_wordings_of_long_lines_are_counted():
    notice = "This office keeps what you send for the time the rules of the council name and for no longer, whoever asks for it, " * 3
    assert len(notice) > 300 and len(bp.wordings(notice)) == 1
    page = bp.read_page(notice, "html", {w: 0.5 for w in bp.wordings(notice)})
    assert page.shares.tolist() == [0.5]


@pytest.mark.parametrize("n", [5, 8, 11, 120])
def test_lines_are_judged_at_any_length(n):
    notice = "Copyright 2020 Lanhu University, all rights reserved by the office. " * n
    assert "rights" in bp.read_page(notice, "html", {}).tokens[0]
    assert rs.is_residue("404 錯誤，您要找的頁面不存在或已被移除。" * n, "html") and rs.is_residue("測試" * (30 * n), "html")
    thai = "ก" * 14 + "x" * (200 * n)
    assert not bp.read_page(thai, "html", {}).ends[0] and bp.read_page(thai + "ก", "html", {}).ends[0]


def crawl(n=400, seed=0):
    """Pages with bodies of their own, and furniture of some kinds; gives lines of furniture beside the text."""
    rng = np.random.default_rng(seed)
    nouns = [a + b for a in "ka ro mi tu sel dan vor lis".split() for b in "bek nor tal wim gos dra pel fun".split()]
    some = lambda k: " ".join(rng.choice(nouns, k))
    notice = "We at the institute keep what visitors send for as long as the rules of the council name and no longer than that, whoever asks for it in writing, and every request of this kind is answered by the office in the order in which it comes to hand, with a note of the day on which it was read and of the person who read it."
    kinds = [["Rules", "Staff", "Places", "Archive"], [notice], ["Stay with us by choosing yes on the small bar below"], ["Institute of Rivers, house on the hill, no. 12"]]
    out = []
    for i in range(n):
        body = [f"The {some(3)} of {some(2)} was {some(4)}, and {some(3)} came to {some(2)}. " * 1 + f"No {some(2)} went to {some(3)}." for _ in range(rng.integers(2, 5))]
        head = [f"{some(2).title()}"]
        blocks = [([*head, *body], False)]
        for k in kinds:
            if rng.random() < 0.6:
                blocks.insert(0 if len(k) > 1 or rng.random() < 0.3 else len(blocks), (k, True))
        text, lines, at = "\n\n".join("\n".join(b) for b, _ in blocks), set(), 0
        for b, furniture in blocks:
            lines |= {at + j for j in range(len(b))} if furniture else set()
            at += len(b) + 1
        out.append((text, lines))
    return out, notice


def test_trees_find_furniture_without_any_token(monkeypatch):
    from collections import Counter

    monkeypatch.setattr(bp.Reading, "_tokens", lambda self: [()] * len(self.forest))
    pages_, notice = crawl()
    assert len(notice) > 300
    counts = Counter(w for t, _ in pages_ for w in bp.wordings(t))
    known = {w: k / len(pages_) for w, k in counts.items() if k >= 3}
    model = bp.train([(t, "html") for t, _ in pages_[:200]], known)
    model = bp.BodyModel(known, model.titles, model.trees)
    right = found = true = 0
    for _, r, keep, _ in model.batches([t for t, _ in pages_[200:]], ["html"] * 200):
        f = r.forest
        got = {(int(d), int(n)) for d, n in zip(f.doc[~keep], f.no[~keep], strict=True)}
        want = {(d, n) for d, (_, lines) in enumerate(pages_[200:]) for n in lines}
        right, found, true = right + len(got & want), found + len(got), true + len(want)
    assert right >= 0.9 * true and right >= 0.9 * found
    held = bp.agreement([(t, "html") for t, _ in pages_], known)
    print(held)
    assert held["agreement"] > 0.95


def test_residue_on_one_long_line():
    text = "404 錯誤，您要找的頁面不存在或已被移除。" * 10
    assert len(text) > 160 and rs.is_residue(text, "html")
    assert not rs.is_residue("提醒您，學生停修課程須經授課教師同意，且剩餘學分不得低於九。" * 10, "html")


def test_bodies_of_chunks(spark, table, tmp_path):
    table.select(table.ext_id.alias("chunk_id"), "url", "text", "source_type").write.parquet(f"{tmp_path}/chunks.parquet")
    got = {r.chunk_id: r.body for r in queries.queries()["p7_chunk_bodies"](spark, str(tmp_path)).collect()}
    assert got[2].startswith("Course Guide 2\nReminder") and "Copyright" not in got[2]


def test_batches_fold_as_single_texts_do():
    from weftline.llm.common import codepoints, fold
    from weftline.llm.forest import Forest, hashes_of

    texts = ["Ａｂ①… x", "", "plain ASCII 12", "ก็ำน้ำ\nสระ", "가나 각", "é é ǅ ß", "中文：（全形）\n\n　", "\U00020001𠀀 😀", "tail\n"]
    f = Forest(texts, [None] * len(texts))
    assert f.folded_codes.tolist() == codepoints("\n".join(map(fold, texts)) + "\n").tolist()
    assert [f.text(i) for i in range(len(f))] == [x.strip() for t in texts for x in t.split("\n") if x.strip()]
    assert [texts[d][a:z] for d, a, z in zip(f.doc, f.start, f.end, strict=True)] == [f.text(i) for i in range(len(f))]
    assert f.said().tolist() == hashes_of([f.text(i) for i in range(len(f))]).tolist()
    assert len(set(hashes_of(["* Office 2020!", "Office 17", "office"]).tolist())) == 1 and hashes_of(["12", "", "x"])[:2].tolist() == [0, 0]
