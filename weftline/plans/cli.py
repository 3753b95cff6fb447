"""Command line: chunks and texts from a crawl, the index from a chunk file, questions against it, a small web page.

``python -m weftline.plans.cli --build-chunks map.json --base DIR --out chunks.jsonl [--test]``
``python -m weftline.plans.cli --extract map.json --base DIR --out texts.jsonl [--test]``
``python -m weftline.plans.cli --build-index chunks.jsonl --collection NAME [--reset]``
``python -m weftline.plans.cli --query Q --collection NAME [--top-n N] [--verbose]``
``python -m weftline.plans.cli --app --collection NAME [--port P]``
"""

from __future__ import annotations

import argparse
import sys
import threading
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession

from ..functions import models
from ..operators.answer import report
from ..operators.manifest import first_rows
from ..sources.collection import Collection
from ..sources.files import MissingInput, read_jsonl, read_manifest
from . import pipeline as pl

# Names of the models the commands ask for by default, and the lines of their reports.
GENERATOR, EMBEDDER, RERANKER = "granite4:3b", "bge-m3", "BAAI/bge-reranker-v2-m3"
BUILD_LINES = (("Records processed", "processed"), ("  HTML files", "html"), ("  PDF  files", "pdf"), ("Records skipped", "skipped"), ("  fetch failed", "failed"), ("  office/other fmt", "office"), ("  empty content", "empty"), ("Total chunks", "total_chunks"))
EXTRACT_LINES = (("Extracted", "total"), ("  HTML", "html"), ("  PDF", "pdf"), ("Skipped", "skipped"))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftline")
    what = p.add_mutually_exclusive_group(required=True)
    what.add_argument("--build-chunks", metavar="MANIFEST")
    what.add_argument("--extract", metavar="MANIFEST")
    what.add_argument("--samples", metavar="MANIFEST", help="show the first texts of each kind")
    what.add_argument("--build-index", metavar="CHUNKS")
    what.add_argument("--query")
    what.add_argument("--app", action="store_true", help="serve a page that takes questions")
    what.add_argument("--verify", action="store_true", help="print the collection's statistics")
    p.add_argument("--base", default=".", help="folder the manifest's paths start from")
    p.add_argument("--out", help="file to write, a folder of parts")
    p.add_argument("--test", action="store_true", help="only the first 20 records, and show what came of them")
    p.add_argument("--collection", default="weftline_points")
    p.add_argument("--reset", action="store_true")
    p.add_argument("--top-n", type=int, default=5)
    p.add_argument("--verbose", action="store_true")
    p.add_argument("--dim", type=int, default=models.DENSE_DIM)
    p.add_argument("--service", help="address of a model service; without it the stand-ins answer")
    p.add_argument("--model", default=GENERATOR)
    p.add_argument("--embedding-model", default=EMBEDDER)
    p.add_argument("--reranker", choices=["stand-in", "service", "local"], default="stand-in", help="token overlap, the service at --rerank-service, or a library on the workers")
    p.add_argument("--rerank-service", help="address of a reranking service")
    p.add_argument("--reranker-model", default=RERANKER)
    p.add_argument("--reranker-device", default="auto", choices=["auto", "cpu", "xpu", "cuda"])
    p.add_argument("--port", type=int, default=7860)
    return p


class Progress:
    """Prints how many tasks of the running stages are done, whenever that number has changed."""

    def __init__(self, spark: SparkSession, every: float = 2.0):
        self._tracker, self._every, self._stop = spark.sparkContext.statusTracker(), every, threading.Event()

    def __enter__(self) -> Progress:
        self._thread = threading.Thread(target=self._watch, daemon=True)
        self._thread.start()
        return self

    def __exit__(self, *_: object) -> None:
        self._stop.set()
        self._thread.join()

    def _watch(self) -> None:
        last = None
        while not self._stop.wait(self._every):
            some = [i for s in self._tracker.getActiveStageIds() if (i := self._tracker.getStageInfo(s))]
            now = sum(i.numCompletedTasks for i in some), sum(i.numTasks for i in some)
            if some and now != last:
                print(f"  {now[0]}/{now[1]} tasks done...", file=sys.stderr)
                last = now


def printed(row: dict, lines: tuple[tuple[str, str], ...], out: str) -> str:
    """A report as text."""
    width = max(len(label) for label, _ in lines)
    return "\n".join(["=" * 50, *(f"{label:<{width}} : {row[key]}" for label, key in lines), f"{'Output':<{width}} : {out}"])


def first_chunks(chunks: DataFrame, n: int = 3) -> str:
    """The first chunks of a chunk file, as text; of each text 200 characters."""
    rows = chunks.orderBy("ordinal", "chunk_index").limit(n).collect()
    show = lambda k, r: f"[Chunk {k}]\n  url    : {r.url}\n  type   : {r.source_type}\n  depth  : {r.depth}\n  chars  : {r.chunk_len}\n  text   : {r.text[:200]!r}"
    return "\n".join(show(k, r) for k, r in enumerate(rows))


def scorer(args: argparse.Namespace) -> Callable[[Column, Column], Column]:
    """The second score the arguments ask for."""
    if args.reranker == "service":
        if not args.rerank_service:
            raise SystemExit("--reranker service needs --rerank-service")
        return models.scoring(partial(models.RemoteReranker, args.rerank_service, args.reranker_model))
    if args.reranker == "local":
        return models.scoring(partial(models.CrossEncoder, args.reranker_model, args.reranker_device))
    return models.overlap_score


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.query is not None and not args.query.strip():
        return 0
    spark = spark or SparkSession.builder.appName("weftline").getOrCreate()
    try:
        return _run(args, spark)
    except MissingInput as e:
        print(f"not found: {e}", file=sys.stderr)
        return 1


def _run(args: argparse.Namespace, spark: SparkSession) -> int:
    source = args.build_chunks or args.extract or args.samples
    if source:
        manifest = read_manifest(spark, source)
        if args.test:
            manifest = first_rows(manifest, "ordinal", 20)
            print("[TEST MODE] first 20 records only")
        if args.samples:
            for r in pl.samples(manifest, pl.stored_texts(spark, args.base)).collect():  # six rows at most
                print(f"[{r.kind}] {r.url}\nChars: {r.chars}\n{r.text}\n")
            return 0
        out = args.out or ("chunks.jsonl" if args.build_chunks else "extracted_texts.jsonl")
        with Progress(spark):
            job, lines = (pl.build_chunks, BUILD_LINES) if args.build_chunks else (pl.extract_texts, EXTRACT_LINES)
            row = job(spark, manifest, args.base, out).first().asDict()
        print(printed(row, lines, out))
        if args.test and args.build_chunks and row["total_chunks"]:
            print(first_chunks(read_jsonl(spark, out, pl._NUMBERED)))
        return 0
    points = Collection(spark, args.collection)
    embed = models.embedding(partial(models.RemoteEmbedder, args.service, args.embedding_model)) if args.service else pl.local_embedding(args.dim)
    if args.verify:
        print(points.stats().first().asDict() if points.exists() else "no such collection")
    elif args.build_index:
        chunks = read_jsonl(spark, args.build_index)
        with Progress(spark):
            pl.index_job(chunks, points, embed, args.reset)
        print(points.stats().first().asDict())
    else:
        generate = models.generating(partial(models.RemoteGenerator, args.service, args.model)) if args.service else None
        ask = lambda text: pl.ask(pl.questions_of(spark, text), pl.searchable(points), embed, scorer(args), generate, args.top_n)
        if args.app:
            from .web import serve

            serve(ask, args.port)
            return 0
        for r in report(ask(args.query), args.verbose).collect():  # one question
            print(r.report)
    return 0


if __name__ == "__main__":
    sys.exit(main())
