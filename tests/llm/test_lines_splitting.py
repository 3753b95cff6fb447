from __future__ import annotations

import re
import unicodedata
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import queries
from weftline.llm import repeated_lines as rl
from weftline.llm import splitting as sp
from weftline.llm.common import minhash_bands
from weftline.llm.forest import Forest


def wording(line):
    return re.sub(r"[\W\d_]+", "", unicodedata.normalize("NFKC", line).casefold())


def brute(rows, min_pages=5, min_share=0.04):
    pages, of = defaultdict(set), defaultdict(set)
    for _, url, cat, text in rows:
        if cat is not None:
            if url is not None:
                of[cat].add(url)
            for line in (text or "").split("\n"):
                if w := wording(line):
                    if url is not None:
                        pages[cat, w].add(url)
    return sorted((i, n) for i, url, cat, text in rows if cat is not None for n, line in enumerate((text or "").split("\n")) if (w := wording(line)) and len(pages[cat, w]) >= max(min_pages, min_share * len(of[cat])))


def chunks(spark, rows):
    return spark.createDataFrame(rows, "chunk_id long, url string, category string, text string")


def some_rows():
    rows = []
    for i in range(60):
        text = f"Only here {chr(97 + i % 26) * 3}{i}\n\nCopyright {2000 + i} Dr. Name{'abc'[i % 3]}\n"
        text += ["Skip to main content", "ＳＫＩＰ to  main content!", "skip to Main-content 7"][i % 3] if i < 30 else f"plain line {'xyz'[i % 3]} number {i}"
        rows.append((i, f"u{i % 40}", "a" if i % 2 else "b", text))
    rows += [(100, None, "a", "Skip to main content"), (101, "u1", None, "Skip to main content"), (102, "u2", "a", None), (103, "u2", "a", ""), (104, "u0", "a", "12 - 34"), (105, "u1", "a", "Skip to main content"), (105, "u1", "a", "Skip to main content")]
    return rows


def test_wordings_match_brute_force(spark):
    rows = some_rows()
    df = chunks(spark, rows).withColumnsRenamed({}).selectExpr("*", "1 AS line_no", "2 AS source", "3 AS page", "4 AS id")
    got = sorted((r.id, r.line_no) for r in rl.repeated_lines(df, exact=True).collect())
    assert got == brute(rows)


def test_near_duplicates_cluster_and_are_removed(spark):
    rows = [(i, f"u{i}", "a", f"Written by Dr. {n} for the main office of the campus\nbody {n}") for i, n in enumerate(["Ada", "Bob", "Cyd", "Dan", "Eve", "Fay"])]
    df = chunks(spark, rows)
    found = rl.repeated_lines(df)
    assert {(r.id, r.line_no) for r in found.collect()} == {(i, 0) for i in range(6)}
    assert rl.repeated_lines(df, exact=True).count() == 0
    assert {r.text for r in rl.without_lines(df, found).collect()} == {f"body {n}" for n in ["Ada", "Bob", "Cyd", "Dan", "Eve", "Fay"]}


def similar_lines(n=160, seed=1):
    """Wordings in families whose members differ by some letters, and lines of their own; each on a page of its own."""
    rng = np.random.default_rng(seed)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    out = []
    for family in range(12):
        base = "".join(rng.choice(letters, 60))
        for _ in range(int(rng.integers(3, 14))):
            s = list(base)
            for at in rng.choice(60, int(rng.integers(0, 3)), replace=False):
                s[at] = str(rng.choice(letters))
            out.append("".join(s))
    out += ["".join(rng.choice(letters, 60)) for _ in range(n - len(out))]
    return [(i, f"u{i}", "a", f"{line}\n{i}") for i, line in enumerate(out)]


def test_clusters_against_brute_force(spark):
    rows = similar_lines()
    lines = [r[3].split("\n")[0] for r in rows]
    like = [[j for j, b in enumerate(lines) if rl.similarity(a, b) >= rl.SIMILAR] for a in lines]
    least = max(5, 0.04 * len(rows))
    want = {i for i, mates in enumerate(like) if any(len(like[j]) >= least for j in mates)}
    got = {r.id for r in rl.repeated_lines(chunks(spark, rows)).collect()}
    assert len(got & want) >= 0.9 * len(want) and got <= want and len(want) > 20


def shadowed_lines(band):
    """Two wordings that are not alike but share every band, so that the more frequent one represents the other."""
    rng = np.random.default_rng(4)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    keys = lambda s: minhash_bands(np.array([*map(ord, s)], dtype=np.uint32), np.array([0]), np.array([len(s)]), rl.SHINGLE, rl.ROWS, band)
    while True:
        a = [str(c) for c in rng.choice(letters, 60)]
        b = [*a]
        for at in rng.choice(60, 4, replace=False):
            b[at] = str(rng.choice(letters))
        a, b = "".join(a), "".join(b)
        if rl.similarity(a, b) < rl.SIMILAR and (keys(a) == keys(b)).all():
            return [(i, f"u{i}", "a", a if i < 9 else b) for i in range(15)]


def test_a_wording_has_a_cluster_though_another_represents_its_bands(spark, monkeypatch):
    monkeypatch.setattr(rl, "BANDS", 1)
    rows = shadowed_lines(1)
    for exact in (False, True):
        assert sorted(r.id for r in rl.repeated_lines(chunks(spark, rows), exact=exact).collect()) == [*range(15)]


def test_exact_lines_come_from_the_clusters(spark, monkeypatch, tmp_path):
    seen = []
    clusters = rl._clusters
    monkeypatch.setattr(rl, "_clusters", lambda *a: seen.append(clusters(*a)) or seen[-1])
    names = ["Ada", "Bob", "Cyd", "Dan", "Eve", "Fay"]
    rows = [(i, f"u{i}", "a", f"Written by Dr. {names[i % 6]} for the main office of the campus\nonly {'abcdefghijkl'[i] * 9}") for i in range(12)]
    rows += [(20 + i, f"v{i}", "a", "Written by Dr. Ada for the main office of the campus") for i in range(4)]
    chunks(spark, rows).write.parquet(f"{tmp_path}/chunks.parquet")
    got = sorted((r.chunk_id, r.line_no) for r in queries.p1_found(spark, str(tmp_path)).collect())
    assert got == brute(rows) and len(got) == 6  # Ada's line alone is on five pages
    wordings = {(r.wording, r.rep) for r in seen[0].collect()}
    assert len({r for w, r in wordings if w != r}) == 1 and sum(w != r for w, r in wordings) == 5  # one cluster of all names


def test_strings_are_read_for_full_clusters_alone(spark, monkeypatch):
    seen = {}
    cut = rl.cut
    monkeypatch.setattr(rl, "cut", lambda df, name: seen.update({name: cut(df, name)}) or seen[name])
    often = [(i, f"u{i}", "a", f"Written by the main office of the campus no{'abcdef'[i] * 3}") for i in range(6)]
    seldom = [(10 + i, f"v{i // 3}", "a", f"Opened for the whole summer by the town library{'abcdef'[i]}") for i in range(6)]  # on two pages
    assert sorted(r.id for r in rl.repeated_lines(chunks(spark, often + seldom)).collect()) == [*range(6)]
    assert "said" not in seen["wordings"].columns and all(r.said.startswith("written") for r in seen["said"].collect())
    assert seen["said"].count() == 6


@pytest.mark.parametrize("text", [
    "Welcome Müller and the ﬁne Anna Lee of the house…\n\nWelcome Müller and the fine Anna Lee of the house",
    "由王小明老師整理的課程資料與說明… 內容\n由王小明老師整理的課程資料與說明內容\nthe office of Anna Lee Smith",
    "Meet Dr. Who on May 3 at the İstanbul office\nthe whole programs are of Mrs. Straße and of ada. Then Bob said\nfrom Ann, Bob\nin MAY we say Dr.  Who",
])
def test_names_are_masked_as_line_by_line(text):
    f = Forest([text], [None])
    kept = rl._letters(f)
    begin, end = np.searchsorted(kept, f.folded_starts), np.searchsorted(kept, f.folded_ends)
    some = np.flatnonzero(end > begin)
    codes, ends = rl._said(f, some, kept, begin, end)
    letters = lambda s: wording(s).replace("\n", "")
    want = []
    for line in (text.split("\n")[i] for i in some):
        bare = letters(rl._NAMES.sub(lambda m: " " * len(m[0]), line))
        want.append(bare if len(bare) >= max(rl.LEFT, len(letters(line)) / 2) else letters(line))
    assert [codes[a:z].tobytes().decode("utf-32-le") for a, z in zip([0, *ends[:-1]], ends)] == want and want != [letters(x) for x in text.split("\n") if x]


def test_bands_find_pairs_at_seven_tenths():
    rng = np.random.default_rng(2)
    letters = np.arange(97, 123, dtype=np.uint32)
    hit = seen = 0
    for _ in range(400):
        a = rng.choice(letters, 60)
        b = a.copy()
        b[rng.choice(60, int(rng.integers(1, 4)), replace=False)] = rng.choice(letters)
        s = rl.similarity(*("".join(map(chr, x)) for x in (a, b)))
        if 0.65 <= s <= 0.75:
            x, y = minhash_bands(np.concatenate([a, b]), np.array([0, 60]), np.array([60, 120]), rl.SHINGLE, rl.ROWS, rl.BANDS)
            hit, seen = hit + int((x == y).any()), seen + 1
    assert seen > 40 and hit >= 0.85 * seen, (hit, seen)


def test_names_are_masked():
    mask = lambda s: rl._NAMES.sub("", s)
    assert mask("posted by Anna Lee-Smith on may 3") == mask("posted by Tom Oak on june 3")
    assert mask("Welcome to the main office") == "Welcome to the main office" and mask("由王小明老師整理") == mask("由陳大文老師整理")


def test_empty(spark):
    empty = chunks(spark, [])
    assert rl.repeated_lines(empty, exact=True).count() == 0 and rl.without_lines(empty, rl.repeated_lines(empty)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .。\n一、#x", max_size=4000), st.integers(20, 300), st.integers(0, 19))
def test_pieces_rebuild_the_text(text, limit, overlap):
    pieces = sp.split_text(text, limit, overlap)
    assert all(text[s : s + len(p)] == p and 0 < len(p) <= limit for s, p in pieces)
    rebuilt = ""
    for k, (s, p) in enumerate(pieces):
        assert k == 0 or len(rebuilt) - s == overlap
        rebuilt += p[len(rebuilt) - s :]
    assert rebuilt == text


def test_cuts_at_natural_boundaries():
    text = "\n\n".join(f"Heading {k}\nSentence one of part {k}. Sentence two." for k in range(40))
    pieces = sp.split_text(text, 300, 0)
    assert all(p.rstrip().endswith("two.") for _, p in pieces)
    with pytest.raises(ValueError):
        sp.split_text("abc", 10, 10)


def test_split_table(spark):
    rows = [(1, "x" * 800, "html"), (2, "x" * 801, "html"), (3, "x" * 801, "pdf"), (4, "𝒳" * 2049, "pdf"), (5, None, "html"), (6, "", None), (7, "y " * 600, None), (2, "x" * 801, "html")]
    df = spark.createDataFrame(rows, "chunk_id long, text string, source_type string").selectExpr("*", "1 AS id", "2 AS piece_no", "'z' AS cap")
    got = sp.split_oversized(df).collect()
    assert sorted({r.id for r in got}) == [2, 4, 7] and sum(r.id == 2 for r in got) == 4
    assert sp.split_oversized(df.limit(0)).count() == 0


def test_clean_keeps_sentences_that_share_a_template(spark, tmp_path):
    body = "If the page shows {} when you log in, clear the cookies of your browser and then try it again after twelve"
    rows = [(i, f"u{i}", "a", body.format(x) + "\nSkip to main content") for i, x in enumerate(["nothing", "an error", "old grades", "no courses", "a blank form", "two menus"])]
    chunks(spark, rows).write.parquet(f"{tmp_path}/chunks.parquet")
    got = {r.chunk_id: r.text for r in queries.p1_clean(spark, str(tmp_path)).collect()}
    assert got == {i: text.split("\n")[0] for i, _, _, text in rows}


def test_tree_of_nested_headings_and_lists():
    text = "# A\n\nintro of a.\n\n## B\n\nbody of b.\n\n### C\n\nbody of c.\n\n## D\n\nbody of d.\n\n# E\n\n1. one\n  a) two\n  b) three\n2. four"
    root = sp.tree(text)
    part = lambda n: text[n.start : n.end].split("\n")[0]
    assert [part(k) for k in root.kids] == ["# A", "# E"]
    a = root.kids[0]
    assert [part(k) for k in a.kids[1:]] == ["## B", "## D"] and [part(k) for k in a.kids[1].kids[1:]] == ["### C"]
    assert a.end == root.kids[1].start and root.kids[1].end == len(text)
    items = sp._parted(text, sp.Node(text.index("1. one"), len(text)))
    assert [part(k) for k in items] == ["1. one", "2. four"] and [part(k) for k in items[0].kids[1:]] == ["  a) two", "  b) three"]


def test_subtrees_that_fit_are_not_entered():
    sections = [f"## Part {i}\n\n" + f"Sentence {i} has some words in it. " * n + "\n\n" for i, n in enumerate((3, 3, 30, 2, 3))]
    text = "".join(sections)
    starts = [s for s, _ in sp.split_text(text, 300, 0)]
    edges = [sum(map(len, sections[:i])) for i in range(5)]
    assert starts[0] == 0 and edges[2] in starts and edges[4] in starts and len(text) - starts[-1] <= 300
    inside = [s for s in starts if edges[2] < s < edges[3]]
    assert inside and all(text[s - 2 : s] == ". " or text[s - 1] == "\n" for s in inside)


@given(st.text(alphabet="ab .\n#1)一、。-　", max_size=400), st.integers(2, 60), st.integers(0, 40))
def test_any_text_comes_back_whole(text, limit, overlap):
    overlap = min(overlap, limit - 1)
    pieces = sp.split_text(text, limit, overlap)
    assert all(len(p) <= limit for _, p in pieces)
    assert "".join(p if k == 0 else p[overlap:] for k, (_, p) in enumerate(pieces)) == text
    assert all(text[s : s + len(p)] == p for s, p in pieces)
