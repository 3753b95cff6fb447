from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from weftline.functions import text as tx
from weftline.operators import manifest as mf
from weftline.plans import pipeline as pl
from weftline.schemas import CHUNK
from weftline.sources import files
from weftline.sources.collection import Collection, points
from weftline.streaming.chunks import chunk_stream, write_chunks

RECORDS = [
    {"status": "ok", "saved_path": "a.html", "type": "html", "url": "http://x/y/", "depth": 1, "category": "c"},
    {"status": "ok", "saved_path": "A.PDF", "type": "document", "url": "http://x/y?page=2&ref=x"},
    {"status": "ok", "saved_path": "a.docx", "type": "document", "url": "http://x/z"},
    {"status": "ok", "saved_path": "b.bin", "type": "pdf", "url": "http://x/p"},
    {"status": "ok", "saved_path": "", "type": "html"},
    {"status": "http_404", "saved_path": "c.html", "type": "html", "url": None},
    {"status": "ok", "saved_path": "gone.html", "type": "html", "url": "http://x/gone"},
]


@pytest.fixture
def manifest(spark, tmp_path):
    (tmp_path / "map.json").write_text(json.dumps(RECORDS), encoding="utf-8")
    return files.read_manifest(spark, str(tmp_path / "map.json"))


@pytest.fixture
def texts(spark):
    return spark.createDataFrame([("a.html", "html text"), ("A.PDF", "x" * 2049), ("b.bin", "raw pdf"), ("a.docx", "office")], "saved_path string, text string")


def test_manifest_rows(manifest):
    rows = manifest.orderBy("ordinal").collect()
    assert [r.ordinal for r in rows] == list(range(7)) and rows[1].depth is None
    assert mf.first_rows(manifest, "ordinal", 2).count() == 2


def test_types(manifest):
    chunks = {r.url: r.source_type for r in mf.for_chunks(manifest).collect()}
    assert chunks == {"http://x/y/": "html", "http://x/y?page=2&ref=x": "pdf", "http://x/p": "pdf", "http://x/gone": "html"}
    assert {r.url for r in mf.for_extraction(manifest).collect()} == {"http://x/y/", "http://x/y?page=2&ref=x", "http://x/gone"}
    titles = {r.url: r.title for r in mf.for_chunks(manifest).collect()}
    assert titles["http://x/y/"] == "http://x/y/" and titles["http://x/y?page=2&ref=x"] == "y?page=2&ref=x"


def test_jobs_and_reports(manifest, texts):
    chunks = pl.chunk_job(manifest, texts, "ordinal")
    assert sorted((r.url, r.chunk_index, r.chunk_len) for r in chunks.collect()) == [("http://x/p", 0, 7), ("http://x/y/", 0, 9), ("http://x/y?page=2&ref=x", 0, 2048), ("http://x/y?page=2&ref=x", 1, 513)]
    report = mf.build_report(manifest, chunks.groupBy("ordinal").agg(F.count("*").alias("chunks")), "ordinal").first().asDict()
    assert report == {"processed": 3, "html": 1, "pdf": 1, "skipped": 4, "failed": 2, "office": 1, "empty": 1, "total_chunks": 4}
    has = manifest.join(texts, "saved_path").select("ordinal")
    assert mf.extract_report(manifest, has, "ordinal").first().asDict() == {"total": 2, "html": 1, "pdf": 1, "skipped": 5}
    assert pl.extract_job(manifest, texts).count() == 2


def test_only_html_and_pdf_give_chunks(spark):
    rows = [(i, "ok", f"f{i}", kind, "u", 0, "c", "t") for i, kind in enumerate(["html", "pdf", "image", None, "office"])]
    manifest = spark.createDataFrame(rows, "ordinal int, status string, saved_path string, type string, url string, depth int, category string, fetched_at string")
    texts = spark.createDataFrame([(f"f{i}", "some text") for i in range(5)], "saved_path string, text string")
    assert sorted(r.ordinal for r in pl.chunk_job(manifest, texts, "ordinal").collect()) == [0, 1]


def test_malformed_manifest(spark, tmp_path):
    (tmp_path / "cut.json").write_text(json.dumps(RECORDS)[:-40], encoding="utf-8")
    (tmp_path / "kind.json").write_text(json.dumps([{"status": "ok", "depth": "deep"}]), encoding="utf-8")
    for name in ("cut.json", "kind.json"):
        with pytest.raises(Exception):
            files.read_manifest(spark, str(tmp_path / name)).collect()
    (tmp_path / "lines.jsonl").write_text("\n".join(map(json.dumps, RECORDS)), encoding="utf-8")
    assert [r.saved_path for r in files.read_manifest(spark, str(tmp_path / "lines.jsonl")).orderBy("ordinal").collect()] == [r["saved_path"] for r in RECORDS]


def test_missing_manifest(spark, tmp_path):
    with pytest.raises(files.MissingInput):
        files.read_manifest(spark, str(tmp_path / "none.json")).count()


def test_jsonl(spark, tmp_path):
    row = spark.createDataFrame([("u", None, 1, "html", "c", "t", "字", 0, 1)], CHUNK)
    files.write_jsonl(row, str(tmp_path / "c"))
    files.write_jsonl(row, str(tmp_path / "c"))
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "c").glob("*.json"))
    assert "字" in text and '"title":null' in text
    assert files.read_jsonl(spark, str(tmp_path / "c")).count() == 1
    (tmp_path / "bad.jsonl").write_text('{"url": "a"}\n\n{"url": \n', encoding="utf-8")
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()


def test_pdf_pages(spark):
    pages = spark.createDataFrame([("p", 2, "b" * 60), ("p", 1, " " + "a" * 60), ("p", 3, None), ("p", 4, "  "), ("q", 1, "short"), ("r", 1, "x" * 100), ("s", 1, "x" * 99)], "path string, page_no int, text string")
    got = {r.path: r.text for r in files.pdf_texts(pages).collect()}
    assert got == {"p": "a" * 60 + "\n\n" + "b" * 60, "q": "", "r": "x" * 100, "s": ""}


def test_text_functions(spark):
    df = spark.createDataFrame([("　a\xa0\x1c", "x/b.PDF", "a\n\n\n\nb"), ("", ".pdf", ""), ("b", "b.tar.pdf", "n"), ("c", "none", "n"), ("d", "x/a..pdf", "n"), ("e", "x.pdf.", "n"), ("f", "x/..pdf", "n")], "s string, p string, n string")
    rows = df.select(tx.strip(F.col("s")), tx.is_pdf(F.col("p")), tx.collapse_newlines(F.col("n"))).collect()
    assert [tuple(r) for r in rows] == [("a", True, "a\n\nb"), ("", False, ""), ("b", True, "n"), ("c", False, "n"), ("d", True, "n"), ("e", False, "n"), ("f", True, "n")]


def test_collection(spark):
    chunks = spark.createDataFrame([("u", 0, "a", [3.0, 4.0]), ("u", 1, "b", [1.0, 0.0])], "url string, chunk_index int, text string, v array<float>")
    for name in ("title", "category", "source_type", "fetched_at"):
        chunks = chunks.withColumn(name, F.lit(None).cast("string"))
    chunks = chunks.withColumn("depth", F.lit(None).cast("int")).withColumn("chunk_len", F.lit(1))
    c = Collection(spark, "test_points")
    c.prepare(reset=True)
    for _ in range(2):
        c.upsert(points(chunks, F.col("v")))
    assert c.stats().first().asDict() == {"points": 4, "dim": 2}
    c.prepare(reset=True)
    assert c.read().count() == 0
    for _ in range(2):
        c.upsert_stable(points(chunks, F.col("v"), stable_ids=True))
    assert c.read().count() == 2
    row = c.read().where("payload.chunk_index = 0").first()
    assert row.payload.depth == 0 and row.payload.title == "" and [round(x, 3) for x in row.dense] == [0.6, 0.8]
    c.drop()
    assert not c.exists()


def test_stream(spark, tmp_path):
    src = spark.createDataFrame([("u", "t", 0, "html", "c", "f", "x" * 900)], "url string, title string, depth int, source_type string, category string, fetched_at string, text string")
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    write_chunks(chunk_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
