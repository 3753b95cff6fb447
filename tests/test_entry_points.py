"""From a folder of crawled files to an answer, as a user would run it."""

from __future__ import annotations

import json
import threading
import urllib.request
import zlib
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import models
from weftline.operators.search import nearest
from weftline.plans import cli, web
from weftline.sources import files
from weftline.sources.pdf import PdfError, page_texts


def pdf(pages: list[str], extra: bytes = b"") -> bytes:
    kids = " ".join(f"{3 + 2 * i} 0 R" for i in range(len(pages)))
    body = [b"<< /Type /Catalog /Pages 2 0 R >>" + extra, f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} >>".encode()]
    for i, t in enumerate(pages):
        body.append(f"<< /Type /Page /Parent 2 0 R /Contents {4 + 2 * i} 0 R >>".encode())
        c = zlib.compress(b"BT /F1 12 Tf 72 700 Td (" + t.encode("cp1252") + b") Tj 0 -14 Td [(sec) 20 (ond) -300 (\\(line\\))] TJ ET")
        body.append(f"<< /Length {len(c)} /Filter /FlateDecode >>\nstream\n".encode() + c + b"\nendstream")
    return b"%PDF-1.4\n" + b"".join(f"{n} 0 obj\n".encode() + b + b"\nendobj\n" for n, b in enumerate(body, 1))


PAGES = ["The library of the campus opens at nine in the morning on every day of the term.", "It closes at ten in the evening, but at five on days of rest."]


@pytest.fixture
def crawl(tmp_path):
    (tmp_path / "output" / "a b").mkdir(parents=True)
    page = "<html><body><nav>Home</nav><main><h1>Dormitory</h1><p>The dormitory has 91 beds left, at 40 a month.</p></main></body></html>"
    (tmp_path / "output/a b/one.html").write_text(page, encoding="utf-8")
    (tmp_path / "output/two.PDF").write_bytes(pdf(PAGES))
    (tmp_path / "output/three.pdf").write_bytes(pdf(PAGES, b"/Encrypt 9 0 R"))
    (tmp_path / "output/four.docx").write_bytes(b"PK")
    rows = [("output/a b/one.html", "html", "http://x/one"), ("output/two.PDF", "document", "http://x/two.pdf"), ("output/three.pdf", "document", "http://x/three.pdf"), ("output/four.docx", "document", "http://x/four"), ("output/gone.html", "html", "http://x/gone")]
    records = [{"status": "ok", "saved_path": p, "type": t, "url": u, "depth": 1, "category": "c", "fetched_at": "2026"} for p, t, u in rows]
    (tmp_path / "map.json").write_text(json.dumps([*records, {"status": "http_404", "saved_path": None}]), encoding="utf-8")
    return tmp_path


def run(capsys, spark, *args: str) -> str:
    assert cli.main(list(args), spark) == 0
    return capsys.readouterr().out


def test_from_files_to_an_answer(spark, crawl, capsys):
    out = run(capsys, spark, "--build-chunks", str(crawl / "map.json"), "--base", str(crawl), "--out", str(crawl / "chunks.jsonl"), "--test")
    got = {k.strip(): v for k, v in (x.split(" : ", 1) for x in out.splitlines() if " : " in x)}
    assert [got[k] for k in ("Records processed", "office/other fmt", "fetch failed", "empty content")] == ["2", "1", "1", "2"] and "[Chunk 0]" in out
    out = run(capsys, spark, "--extract", str(crawl / "map.json"), "--base", str(crawl), "--out", str(crawl / "texts.jsonl"))
    assert "Extracted : 2" in out and "Skipped   : 4" in out, out
    texts = {r.url: r.text for r in spark.read.json(str(crawl / "texts.jsonl")).collect()}
    assert texts["http://x/one"] == "Dormitory\nThe dormitory has 91 beds left, at 40 a month." and texts["http://x/two.pdf"] == f"{PAGES[0]}\nsecond (line)\n\n{PAGES[1]}\nsecond (line)"
    assert "[HTML] http://x/one" in run(capsys, spark, "--samples", str(crawl / "map.json"), "--base", str(crawl))
    run(capsys, spark, "--build-index", str(crawl / "chunks.jsonl"), "--collection", "entry_points", "--reset", "--dim", "128")
    assert "'points': 2" in run(capsys, spark, "--verify", "--collection", "entry_points")
    out = run(capsys, spark, "--query", "How many beds has the dormitory left?", "--collection", "entry_points", "--dim", "128", "--verbose")
    assert "[1] (html) http://x/one" in out and "rerank=" in out
    assert cli.main(["--query", "  "], spark) == 0 and cli.main(["--extract", str(crawl / "no.json")], spark) == 1
    spark.sql("DROP TABLE entry_points")


def test_errors_per_file(spark, crawl):
    rows = {r.saved_path: r for r in files.file_texts(files.stored_files(spark, str(crawl / "output"))).collect()}
    assert rows["three.pdf"].error == "encrypted" and rows["three.pdf"].text == "" and rows["two.PDF"].error is None
    pages = files.pdf_pages(files.stored_files(spark, str(crawl / "output")).where("saved_path like '%pdf' OR saved_path like '%PDF'").withColumnRenamed("saved_path", "path")).collect()
    assert [(r.page_no, r.error) for r in sorted(pages, key=lambda r: (r.path, r.page_no or 0))] == [(None, "encrypted"), (1, None), (2, None)]
    for raw, why in ((b"x", "no pdf"), (b"%PDF-1.4 nothing", "no objects"), (pdf(["a"]).replace(b"FlateDecode", b"JBIG2Decode"), "filter")):
        with pytest.raises(PdfError, match=why):
            page_texts(raw)


@pytest.fixture
def service():
    seen = []

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append(body)
            got = {"results": [{"index": i, "relevance_score": len(d)} for i, d in reversed(list(enumerate(body["documents"])))]}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(got).encode())

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_address[1]}", seen
    server.shutdown()


def test_reranking_service(spark, service):
    url, seen = service
    args = cli.parser().parse_args(["--query", "q", "--reranker", "service", "--rerank-service", url, "--reranker-model", "m"])
    df = spark.createDataFrame([("q", "abc"), ("q", "a"), ("r", None)], "q string, t string")
    assert sorted(r.s for r in df.select(cli.scorer(args)(F.col("q"), F.col("t")).alias("s")).collect()) == [0.0, 1.0, 3.0]
    assert seen and all(b["model"] == "m" for b in seen)
    with pytest.raises(SystemExit):
        cli.scorer(cli.parser().parse_args(["--query", "q", "--reranker", "service"]))
    assert models.RemoteReranker(url, "m").score("q", []) == [] and models.CrossEncoder("m", "cpu").score("q", []) == []
    with pytest.raises(ImportError, match="FlagEmbedding"):
        models.CrossEncoder("m", "cpu").score("q", ["a"])


def test_web_page(spark):
    asked = []

    def ask(text):
        asked.append(text)
        return spark.createDataFrame([("An answer", [("http://x", "pdf")])], "answer string, sources array<struct<url:string,source_type:string>>")

    assert web.reply(ask, b'{"query": "  "}') == {"answer": "", "sources": ""} and not asked
    server = ThreadingHTTPServer(("127.0.0.1", 0), web.handler(ask))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_address[1]}"
    assert b"<form" in urllib.request.urlopen(f"{at}/").read()
    got = json.load(urllib.request.urlopen(urllib.request.Request(f"{at}/ask", json.dumps({"query": " hi "}).encode())))
    server.shutdown()
    assert got["answer"] == "An answer" and "http://x" in got["sources"] and asked == ["hi"]


def test_nearest_equals_brute_force_with_ties(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(-2, 3, (700, 3)).astype(float)  # many ties, some zero vectors
    points = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, dense array<double>").repartition(5)
    queries = spark.createDataFrame([(q, v[q].tolist()) for q in range(0, 40)], "qid long, dense array<double>")
    got = {(r.qid, r["rank"]): (r.id, r.score) for r in nearest(points, queries, 7).collect()}
    n = np.sqrt((v * v).sum(axis=1))
    for q in range(40):
        if n[q] == 0:
            assert (q, 1) not in got
            continue
        s = {i: round(float(v[i] @ v[q] / n[i] / n[q]), 6) for i in range(700) if n[i]}
        best = sorted(s.items(), key=lambda x: (-x[1], x[0]))[:7]
        assert [got[q, k + 1] for k in range(7)] == [(i, pytest.approx(x)) for i, x in best]
