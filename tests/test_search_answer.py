from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import models
from weftline.operators import answer as an
from weftline.operators import chat
from weftline.operators import search
from weftline.plans import cli
from weftline.plans import pipeline as pl


def vectors(spark, n=300, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)).astype(np.float32)
    v[7] = v[3]  # a tie
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(900, None), (901, [0.0] * dim)]
    return v.astype(np.float64), spark.createDataFrame(rows, "id long, dense array<float>").repartition(5)


def brute(v, q, k):
    s = np.round(v @ q / np.linalg.norm(v, axis=1) / np.linalg.norm(q), 6)
    return [int(i) for i in np.lexsort((np.arange(len(v)), -s))[:k]]


def test_nearest_is_exact(spark, monkeypatch):
    v, df = vectors(spark)
    monkeypatch.setattr(search, "BLOCK", 3)  # several blocks
    qs = df.where("id % 50 = 0 OR id = 901").select(F.col("id").alias("qid"), "dense")
    got = search.nearest(df, qs, 10)
    by = {}
    for r in got.orderBy("qid", "rank").collect():
        by.setdefault(r.qid, []).append(r.id)
    assert sorted(by) == [0, 50, 100, 150, 200, 250]
    assert all(by[q] == brute(v, v[q], 10) for q in by)
    assert [r.id for r in search.nearest_one(df, list(map(float, v[3])), "id", k=5).collect()] == brute(v, v[3], 5)
    assert search.nearest(df, qs.limit(0), 5).count() == 0


def test_no_cross_join(spark):
    _, df = vectors(spark)
    plan = search.nearest(df, df.where("id < 3").select(F.col("id").alias("qid"), "dense"), 5)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "WindowGroupLimit" in plan


def test_rerank(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.5), (1, 3, 0.90001), (1, 4, 0.90002)], "qid long, rank int, s double")
    assert [r["rank"] for r in search.rerank(df, F.col("s"), 3).orderBy("position").collect()] == [4, 3, 1]
    assert search.rerank(df, F.col("s"), 0).count() == 4
    with pytest.raises(ValueError):
        search.rerank(df, F.col("s"), -1)


def contexts(spark, texts, urls=None):
    rows = [(1, i + 1, t, (urls or ["u"] * len(texts))[i], None, "html") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "qid long, position int, text string, url string, title string, source_type string")


@pytest.mark.parametrize(
    ("texts", "expected"),
    [(["a", " ", "b"], "[1] a\n\n[3] b"), (["x" * 1996, "y" * 996, "z"], "two"), (["x" * 1996, "y" * 1496, "z" * 6], "one"), (["x" * 2997], ""), ([None], "")],
)
def test_packing(spark, texts, expected):
    got = an.packed(contexts(spark, texts)).first().context
    assert got == {"two": f"[1] {'x' * 1996}\n\n[2] {'y' * 996}", "one": f"[1] {'x' * 1996}"}.get(expected, expected)


def test_sources(spark):
    df = contexts(spark, ["a"] * 4, ["http://x/u1", "", "http://x/u1", "http://x/u2"])
    assert [(r["index"], r.title) for r in an.cited(df).orderBy("index").collect()] == [(1, "u1"), (4, "u2")]
    s = spark.createDataFrame([([(1, "u", "t", "pdf"), (2, "v", "t", "html"), (3, "u", "t", "pdf")],), ([],), (None,)], "s array<struct<index:int,url:string,title:string,source_type:string>>")
    assert [r[0] for r in s.select(chat.sources_view(F.col("s"))).collect()] == ["**參考來源：**\n📄 u\n🌐 v", chat.NO_SOURCES, chat.NO_SOURCES]


def test_history(spark):
    df = spark.createDataFrame([(" q ", "a"), ("  ", "a")], "q string, a string").withColumn("h", F.lit(None).cast("array<struct<role:string,content:string>>"))
    rows = df.select(chat.appended(F.col("h"), F.col("q"), F.col("a")).alias("h"), chat.asked(F.col("q")).alias("k")).collect()
    assert [[(t.role, t.content) for t in r.h] for r in rows] == [[("user", " q "), ("assistant", "a")], []] and [r.k for r in rows] == ["q", None]
    assert chat.cleared() == ([], "", "")


def test_answers(spark):
    embed = pl.local_embedding(64)
    table = spark.createDataFrame([(1, "The library opens at nine. Bring a card.", "http://x/lib", "html"), (2, "Tuition is due in May.", "http://x/fee", "pdf")], "point_id long, text string, url string, source_type string")
    table = table.withColumns({"title": F.lit("t"), "category": F.lit("c"), "chunk_index": F.lit(0)}).withColumn("dense", embed(F.col("text")))
    qs = pl.questions_of(spark, "When does the library open?", "   ")
    got = {r.qid: r for r in pl.ask(qs, table, embed).collect()}
    assert got[0].answer.startswith("The library opens at nine.") and len(got[0].contexts) == 2 and got[0].sources[0].url == "http://x/lib"
    assert got[1].answer == models.NOTHING_FOUND and got[1].sources == [] and got[1].contexts == []
    text = an.report(pl.ask(qs, table, embed), verbose=True).where("qid = 0").first().report
    assert "rerank=" in text and "參考來源" in text
    failing = models.generating(lambda: models.RemoteGenerator("http://127.0.0.1:9", "m", timeout=2))
    told = pl.ask(qs, table, embed, generate=failing).where("qid = 0").first()
    assert told.answer.startswith("[錯誤]") and told.sources


def test_request(spark):
    r = json.loads(spark.range(1).select(an.chat_request(F.lit("hi"), "m")).first()[0])
    assert r["stream"] is False and [m["role"] for m in r["messages"]] == ["system", "user"] and r["options"] == {"temperature": 0.1, "num_ctx": 4096}
    assert spark.range(1).select(an.prompt(F.lit("c"), F.lit("q"))).first()[0] == "參考資料：\nc\n\n問題：q"


def test_embedder():
    e = models.HashedNgrams(32).embed(["abc", "abc", "", "另外"])
    assert np.allclose(e[0], e[1]) and np.allclose(np.linalg.norm(e[[0, 3]], axis=1), 1) and not e[2].any()
    with pytest.raises(Exception):
        models.RemoteEmbedder("http://127.0.0.1:9", "m").embed(["x"])


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "c.jsonl").write_text(json.dumps({"url": "http://x/a", "title": "a", "depth": 0, "source_type": "html", "category": "c", "fetched_at": "", "text": "Courses start in May.", "chunk_index": 0, "chunk_len": 21}) + "\n", encoding="utf-8")
    run = lambda *a: cli.main([*a, "--collection", "cli_points", "--dim", "64"], spark)
    assert run("--build-index", str(tmp_path / "c.jsonl"), "--reset") == 0
    assert run("--verify") == 0 and run("--query", " ") == 0
    assert run("--query", "When do courses start?", "--verbose") == 0
    assert "Courses start in May." in capsys.readouterr().out
    assert run("--build-index", str(tmp_path / "none.jsonl")) == 1
    spark.sql("DROP TABLE cli_points")
