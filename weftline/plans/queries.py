"""Queries of the retrieval engine over the test tables, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.models import overlap_score
from ..functions.vectors import norm
from ..operators import answer as an
from ..operators import chat
from ..operators import chunking as ch
from ..operators import manifest as mf
from ..operators.search import nearest, nearest_one, rerank
from ..schemas import MIN_PDF_TEXT
from ..sources.collection import payload, stats_of
from ..sources.html import extract_html
from . import pipeline as pl


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


# --- vectors


def dense_topk_single(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "embeddings")
    return nearest_one(e, list(e.where("vec_id = 0").first().embedding), "vec_id", "embedding")


def dense_topk_multi(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "embeddings")
    found = nearest(e, e.where("vec_id % 100 = 0"), id_col="vec_id", vector="embedding", qid="vec_id", qvector="embedding")
    return _long(found.withColumnRenamed("id", "vec_id"), "rank")


def vector_norm(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "embeddings").select("vec_id", F.round(norm(F.col("embedding")), 6).alias("norm"))


# --- text


def title_from_url(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "manifest").select("rec_id", tx.title_from_url(F.col("url")).alias("title"))


def pdf_min_length(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", tx.pdf_text(F.col("text"), MIN_PDF_TEXT).alias("text"))


def collapse_newlines(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", tx.collapse_newlines(F.regexp_replace("text", "\n", "\n\n")).alias("text"))


def pdf_pages(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.files import pdf_texts

    pages = _t(spark, d, "chunks").where("url IS NOT NULL").groupBy("url", "chunk_index").agg(F.min("text").alias("text"))
    return pdf_texts(pages.select(F.col("url").alias("path"), F.col("chunk_index").alias("page_no"), "text")).select(F.col("path").alias("url"), "text")


def extract_page(spark: SparkSession, d: str) -> DataFrame:
    safe = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = F.concat(
        F.lit('<!DOCTYPE html><html><head><title>t</title><style>p{color:red}</style></head><body><nav><a href="/">Home</a></nav><div class="SideBar x">s</div><main class="content"><p>'),
        F.replace(safe, F.lit("\n"), F.lit("</p><p>")), F.lit("</p><script>var a = '</p>';</script><aside>more</aside></main><footer>f</footer></body></html>"))
    return _t(spark, d, "extracted_texts").select("ext_id", extract_html(page).alias("text"))


# --- chunks


def window_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _long(ch.exploded(_t(spark, d, "documents"), ch.windows(F.col("text")), "doc_id"), "chunk_index", "chunk_len")


def hard_split_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _long(ch.exploded(_t(spark, d, "documents").where("text IS NOT NULL"), ch.hard_split(F.col("text"), 800), "doc_id"), "chunk_index", "chunk_len")


def paragraph_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _long(ch.exploded(_t(spark, d, "documents"), ch.merged(F.col("text")), "doc_id"), "chunk_index", "chunk_len")


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """Stored files with their text: the extracted texts under the paths the manifest gives their urls."""
    paths = _t(spark, d, "manifest").where("coalesce(saved_path, '') <> ''").select("url", "saved_path").distinct()
    texts = _t(spark, d, "extracted_texts").groupBy("url").agg(F.min("text").alias("text"))
    return paths.join(texts, "url").groupBy("saved_path").agg(F.min("text").alias("text"))


def chunk_job(spark: SparkSession, d: str) -> DataFrame:
    return _long(pl.chunk_job(_t(spark, d, "manifest"), _stored(spark, d), "rec_id"), "chunk_index", "chunk_len", "depth")


def extract_job(spark: SparkSession, d: str) -> DataFrame:
    return pl.extract_job(_t(spark, d, "manifest"), _stored(spark, d))


# --- manifest


def manifest_filter(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "manifest").where(mf.fetched()).select("rec_id", "saved_path")


def resolve_type_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _long(mf.for_chunks(_t(spark, d, "manifest"), "rec_id"), "depth")


def resolve_type_extract(spark: SparkSession, d: str) -> DataFrame:
    return _long(mf.for_extraction(_t(spark, d, "manifest"), "rec_id"), "depth")


def first20(spark: SparkSession, d: str) -> DataFrame:
    return mf.first_rows(_t(spark, d, "manifest"), "rec_id", 20).select("rec_id", "url")


def build_report(spark: SparkSession, d: str) -> DataFrame:
    manifest = _t(spark, d, "manifest")
    made = pl.chunk_job(manifest, _stored(spark, d), "rec_id").groupBy("rec_id").agg(F.count("*").alias("chunks"))
    return mf.build_report(manifest, made, "rec_id")


def extract_report(spark: SparkSession, d: str) -> DataFrame:
    manifest = _t(spark, d, "manifest")
    has = manifest.join(_stored(spark, d).where("text <> ''"), "saved_path").select("rec_id")
    return mf.extract_report(manifest, has, "rec_id")


# --- index


def payload_fields(spark: SparkSession, d: str) -> DataFrame:
    return _long(_t(spark, d, "chunks").select("chunk_id", *payload()), "depth", "chunk_index", "chunk_len")


def collection_stats(spark: SparkSession, d: str) -> DataFrame:
    return _long(stats_of(_t(spark, d, "embeddings").select(F.col("embedding").alias("dense"))), "dim")


# --- answers


def _contexts(spark: SparkSession, d: str) -> DataFrame:
    """Chunks as ranked contexts: the chunks of a page answer the question of its url."""
    w = Window.partitionBy("url").orderBy("chunk_index", "chunk_id")
    return _t(spark, d, "chunks").where("url IS NOT NULL").withColumn("position", F.row_number().over(w)).withColumn("qid", F.col("url"))


def context_pack(spark: SparkSession, d: str) -> DataFrame:
    return an.packed(_contexts(spark, d))


def prompts(spark: SparkSession, d: str) -> DataFrame:
    return context_pack(spark, d).select("qid", an.prompt(F.col("context"), F.col("qid")).alias("prompt"))


def _topics(spark: SparkSession, d: str) -> DataFrame:
    """Chunks as contexts of questions, eight neighbouring ones each: no question holds more, whatever the table."""
    at = F.col("chunk_id")
    return _t(spark, d, "chunks").where("url IS NOT NULL").withColumn("qid", F.floor(at / 8)).withColumn("position", at % 8 + 1)


def source_list(spark: SparkSession, d: str) -> DataFrame:
    return _long(an.cited(_topics(spark, d)), "index")


def sources_markdown(spark: SparkSession, d: str) -> DataFrame:
    sources = an.cited(_topics(spark, d)).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("index", "url", "title", "source_type"))).alias("s"))
    return sources.select("qid", chat.sources_view(F.col("s")).alias("view"))


def history_append(spark: SparkSession, d: str) -> DataFrame:
    turns = _t(spark, d, "chat_turns")
    h = chat.histories(turns.where("conv_id IS NOT NULL"))
    new = chat.appended(F.col("history"), F.concat(F.lit("conv "), F.col("conv_id").cast("string")), F.lit("ok"))
    return h.select("conv_id", F.array_join(F.transform(new, lambda t: F.concat(t["role"], F.lit(": "), t["content"])), "\n").alias("history"))


def rerank_topn(spark: SparkSession, d: str) -> DataFrame:
    """Each page's title as the question, its chunks as candidates."""
    some = _contexts(spark, d).withColumn("rank", F.col("position")).drop("position")
    best = rerank(some, overlap_score(F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))))
    return _long(best.select("qid", "chunk_id", "position", F.round("rerank_score", 3).alias("rerank_score")), "position")


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "benchmark").where("item_id % 100 = 0").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def _points(spark: SparkSession, d: str) -> DataFrame:
    embed = pl.local_embedding(256)
    docs = _t(spark, d, "documents").where("length(text) > 0")
    return docs.select(F.col("doc_id").alias("point_id"), embed(F.col("text")).alias("dense"), "text", "url", F.col("source").alias("title"), F.col("source").alias("category"), "source_type", F.lit(0).alias("chunk_index"))


def retrieve(spark: SparkSession, d: str) -> DataFrame:
    return pl.retrieve(_questions(spark, d), _points(spark, d), pl.local_embedding(256)).drop("text", "query")


def retrieve_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Questions with their vectors: every hundredth row of the vector table asks with its document's text, all rows answer."""
    texts = _t(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.coalesce("text", F.lit("")).alias("text"), "url", F.col("source").alias("title"), F.col("source").alias("category"), "source_type")
    rows = _t(spark, d, "embeddings").join(texts, "vec_id")
    points = rows.select(F.col("vec_id").alias("point_id"), F.col("embedding").alias("dense"), "text", "url", "title", "category", "source_type", F.lit(0).alias("chunk_index"))
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("text").alias("query"), F.col("embedding").alias("dense"))
    found = pl.retrieve(asked, points, None)
    return _long(found.select("qid", "position", "url", "title", "score", F.round("rerank_score", 3).alias("rerank_score")), "position")


def ask(spark: SparkSession, d: str) -> DataFrame:
    answers = pl.ask(_questions(spark, d), _points(spark, d), pl.local_embedding(256))
    return an.report(answers, verbose=True)


QUERIES = (
    dense_topk_single, dense_topk_multi, vector_norm, title_from_url, pdf_min_length, collapse_newlines, pdf_pages, extract_page, window_chunks, hard_split_chunks, paragraph_chunks, chunk_job, extract_job, manifest_filter,
    resolve_type_chunks, resolve_type_extract, first20, build_report, extract_report, payload_fields, collection_stats, context_pack, prompts, source_list, sources_markdown, history_append, rerank_topn, retrieve, retrieve_vectors, ask,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


# --- DuckDB

_WS = " || ".join(f"chr({ord(c)})" for c in tx.WHITESPACE)
_strip = lambda x: f"trim({x}, {_WS})"
_collapse = lambda x: _strip(f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')")
_title = "CASE WHEN list_extract(string_split(coalesce(url, ''), '/'), -1) = '' THEN coalesce(url, '') ELSE list_extract(string_split(coalesce(url, ''), '/'), -1) END"
_fetched = "status = 'ok' AND coalesce(saved_path, '') <> ''"
_pdf = "lower(regexp_extract(saved_path, '[^/](\\.[^./]+)/*$', 1)) = '.pdf'"
_chunk_type = f"CASE WHEN coalesce(type, '') <> 'document' THEN coalesce(type, '') WHEN {_pdf} THEN 'pdf' END"
_extract_type = f"CASE WHEN type = 'html' THEN 'html' WHEN type = 'document' AND {_pdf} THEN 'pdf' END"
_meta = lambda kind: f"coalesce(url, '') AS url, {_title} AS title, coalesce(depth, 0)::BIGINT AS depth, {kind} AS source_type, coalesce(category, '') AS category, coalesce(fetched_at, '') AS fetched_at"
_stored_sql = """stored AS (SELECT saved_path, min(t.text) AS text FROM (SELECT DISTINCT url, saved_path FROM manifest WHERE coalesce(saved_path, '') <> '') m
    JOIN (SELECT url, min(text) AS text FROM extracted_texts GROUP BY url) t USING (url) GROUP BY saved_path)"""
_windows = lambda t: f"list_filter(list_transform(range(0, length({t}), 1536), lambda i: {_strip(f'substr({t}, i + 1, 2048)')}), lambda w: w <> '')"
_merge = lambda source, key: f"""
    paras AS (SELECT {key}, list_filter(list_transform(regexp_split_to_array({_strip("coalesce(text, '')")}, '\\n{{2,}}'), lambda p: {_strip("p")}), lambda p: p <> '') AS ps FROM {source}),
    steps AS (
        SELECT {key}, ps, 0 AS k, '' AS cur, []::VARCHAR[] AS made FROM paras
        UNION ALL
        SELECT {key}, ps, k + 1,
            CASE WHEN length(cur) + length(ps[k + 1]) + 2 <= 800 THEN {_strip("cur || chr(10) || chr(10) || ps[k + 1]")}
                 WHEN cur <> '' THEN {_strip(_strip("right(cur, 100)") + " || chr(10) || chr(10) || ps[k + 1]")} ELSE '' END,
            CASE WHEN length(cur) + length(ps[k + 1]) + 2 <= 800 THEN []::VARCHAR[]
                 WHEN cur <> '' THEN [cur] ELSE list_transform(range(0, length(ps[k + 1]), 800), lambda i: substr(ps[k + 1], i + 1, 800)) END
        FROM steps WHERE k < len(ps)),
    emitted AS (
        SELECT {key}, k, unnest(made) AS text, unnest(range(len(made))) AS j FROM steps
        UNION ALL SELECT {key}, k + 1, cur, 0 FROM steps WHERE k = len(ps) AND cur <> ''),
    merged AS (SELECT {key}, text, row_number() OVER (PARTITION BY {key} ORDER BY k, j) - 1 AS chunk_index, length(text) AS chunk_len FROM emitted)"""  # noqa: E731
_job = f"""WITH RECURSIVE {_stored_sql},
    rows AS (SELECT rec_id, {_meta(_chunk_type)}, text FROM manifest JOIN stored USING (saved_path) WHERE {_fetched} AND {_chunk_type} IS NOT NULL AND text <> ''),
    html AS (SELECT rec_id, text FROM rows WHERE source_type = 'html'), {_merge('html', 'rec_id')},
    pdf AS (SELECT rec_id, unnest(w) AS text, unnest(range(len(w))) AS chunk_index FROM (SELECT rec_id, {_windows(_strip('text'))} AS w FROM rows WHERE source_type = 'pdf')),
    pieces AS (SELECT rec_id, text, chunk_index, chunk_len FROM merged UNION ALL SELECT rec_id, text, chunk_index, length(text) FROM pdf)"""
_ctx = "ctx AS (SELECT *, url AS qid, row_number() OVER (PARTITION BY url ORDER BY chunk_index, chunk_id) AS position FROM chunks WHERE url IS NOT NULL)"
_pack = f"""{_ctx}, entries AS (SELECT qid, position, '[' || position || '] ' || {_strip("coalesce(text, '')")} AS entry FROM ctx WHERE {_strip("coalesce(text, '')")} <> ''),
    sums AS (SELECT *, sum(length(entry)) OVER (PARTITION BY qid ORDER BY position) AS s FROM entries),
    made AS (SELECT qid, string_agg(entry, chr(10) || chr(10) ORDER BY position) AS context FROM sums WHERE s <= 3000 GROUP BY qid),
    packed AS (SELECT qid, coalesce(context, '') AS context FROM (SELECT DISTINCT qid FROM ctx) LEFT JOIN made USING (qid))"""
_cited = """placed AS (SELECT *, chunk_id // 8 AS qid, chunk_id % 8 + 1 AS position FROM chunks WHERE url IS NOT NULL),
    cited AS (SELECT qid, position AS "index", url, coalesce(title, list_extract(string_split(url, '/'), -1)) AS title, coalesce(source_type, '') AS source_type
        FROM placed WHERE url <> '' QUALIFY row_number() OVER (PARTITION BY qid, url ORDER BY position) = 1)"""


_words = lambda c: f"list_distinct(regexp_extract_all(lower({c}), '[\\x{{3400}}-\\x{{9fff}}]|[^\\s\\p{{P}}\\x{{3400}}-\\x{{9fff}}]+'))"
_overlap = lambda q, t: f"1 / (1 + exp(-((len(list_intersect({_words(q)}, {_words(t)})) / greatest(len({_words(q)}), 1)) * 8 - 4)))"


def oracle_sql() -> dict[str, str]:
    return {
        "rerank_topn": f"""WITH {_ctx}, scored AS (SELECT qid, chunk_id, position AS rank, {_overlap("coalesce(title, '')", "coalesce(text, '')")} AS s FROM ctx),
            placed AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, rank) AS position FROM scored)
            SELECT qid, chunk_id, position, round(round(s, 4), 3) AS rerank_score FROM placed WHERE position <= 5""",
        "retrieve_vectors": f"""WITH rows AS (SELECT e.vec_id, e.embedding::DOUBLE[] AS v, coalesce(d.text, '') AS text, d.url, d.source AS title FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id),
            near AS (SELECT q.vec_id AS qid, q.text AS query, p.*, round(list_cosine_similarity(p.v, q.v), 6) AS score FROM rows q, rows p WHERE q.vec_id % 100 = 0 AND trim(q.text, ' ') <> ''),
            top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM near QUALIFY rank <= 50),
            placed AS (SELECT *, {_overlap("query", "text")} AS s FROM top)
            SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY s DESC, rank) AS position, url, title, score, round(round(s, 4), 3) AS rerank_score FROM placed QUALIFY position <= 5""",
        "dense_topk_single": "SELECT vec_id, score FROM (SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) ORDER BY score DESC, vec_id LIMIT 50",
        "dense_topk_multi": """SELECT qid, vec_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM (
            SELECT q.vec_id AS qid, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q) QUALIFY rank <= 50""",
        "vector_norm": "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings",
        "title_from_url": f"SELECT rec_id, CASE WHEN url IS NULL THEN NULL ELSE {_title} END AS title FROM manifest",
        "pdf_min_length": f"SELECT doc_id, CASE WHEN length(text) < 100 THEN '' ELSE {_collapse('text')} END AS text FROM documents WHERE text IS NOT NULL",
        "collapse_newlines": f"SELECT doc_id, {_collapse('replace(text, chr(10), chr(10) || chr(10))')} AS text FROM documents WHERE text IS NOT NULL",
        "pdf_pages": f"""SELECT url, CASE WHEN length(j) < 100 THEN '' ELSE {_collapse('j')} END AS text FROM (
            SELECT url, coalesce(string_agg({_strip('text')}, chr(10) || chr(10) ORDER BY chunk_index NULLS FIRST) FILTER (WHERE coalesce(text, '') <> ''), '') AS j
            FROM (SELECT url, chunk_index, min(text) AS text FROM chunks WHERE url IS NOT NULL GROUP BY url, chunk_index) GROUP BY url)""",
        "extract_page": f"SELECT ext_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {_strip('x')}), lambda x: x <> ''), chr(10)) AS text FROM extracted_texts",
        "window_chunks": f"SELECT doc_id, unnest(w) AS text, unnest(range(len(w))) AS chunk_index, length(unnest(w)) AS chunk_len FROM (SELECT doc_id, {_windows('t')} AS w FROM (SELECT doc_id, {_strip('text')} AS t FROM documents WHERE text IS NOT NULL))",
        "hard_split_chunks": "SELECT doc_id, unnest(w) AS text, unnest(range(len(w))) AS chunk_index, length(unnest(w)) AS chunk_len FROM (SELECT doc_id, list_transform(range(0, length(text), 800), lambda i: substr(text, i + 1, 800)) AS w FROM documents WHERE text IS NOT NULL)",
        "paragraph_chunks": f"WITH RECURSIVE {_merge('documents', 'doc_id')} SELECT * FROM merged",
        "chunk_job": f"{_job} SELECT p.rec_id, url, title, depth, source_type, category, fetched_at, p.text, p.chunk_index, p.chunk_len FROM pieces p JOIN rows r ON p.rec_id = r.rec_id",
        "extract_job": f"WITH {_stored_sql} SELECT url, title, source_type, category, text FROM (SELECT {_meta(_extract_type)}, text FROM manifest JOIN stored USING (saved_path) WHERE {_fetched}) WHERE source_type IS NOT NULL AND coalesce(text, '') <> ''",
        "manifest_filter": f"SELECT rec_id, saved_path FROM manifest WHERE {_fetched}",
        "resolve_type_chunks": f"SELECT * FROM (SELECT rec_id, {_meta(_chunk_type)} FROM manifest WHERE {_fetched}) WHERE source_type IS NOT NULL",
        "resolve_type_extract": f"SELECT * FROM (SELECT rec_id, {_meta(_extract_type)} FROM manifest WHERE {_fetched}) WHERE source_type IS NOT NULL",
        "first20": "SELECT rec_id, url FROM manifest ORDER BY rec_id LIMIT 20",
        "build_report": f"""{_job}, made AS (SELECT rec_id, count(*) AS n FROM pieces GROUP BY rec_id),
            j AS (SELECT m.*, coalesce(n, 0) AS n, coalesce({_fetched}, false) AS f FROM manifest m LEFT JOIN made USING (rec_id))
            SELECT count_if(n > 0)::BIGINT AS processed, count_if(n > 0 AND type = 'html')::BIGINT AS html, count_if(n > 0 AND type = 'document')::BIGINT AS pdf, count_if(n = 0)::BIGINT AS skipped, count_if(NOT f)::BIGINT AS failed,
                count_if(f AND type = 'document' AND NOT {_pdf})::BIGINT AS office, count_if(n = 0 AND f AND NOT (coalesce(type, '') = 'document' AND NOT {_pdf}))::BIGINT AS empty, sum(n)::BIGINT AS total_chunks FROM j""",
        "extract_report": f"""WITH {_stored_sql}, j AS (SELECT m.*, coalesce({_fetched}, false) AND coalesce(s.text, '') <> '' AND {_extract_type} IS NOT NULL AS h FROM manifest m LEFT JOIN stored s USING (saved_path))
            SELECT count_if(h)::BIGINT AS total, count_if(h AND type = 'html')::BIGINT AS html, count_if(h AND type = 'document')::BIGINT AS pdf, count_if(NOT h)::BIGINT AS skipped FROM j""",
        "payload_fields": "SELECT chunk_id, coalesce(text, '') AS text, coalesce(url, '') AS url, coalesce(title, '') AS title, coalesce(depth, 0)::BIGINT AS depth, coalesce(source_type, '') AS source_type, coalesce(category, '') AS category, coalesce(fetched_at, '') AS fetched_at, coalesce(chunk_index, 0)::BIGINT AS chunk_index, coalesce(chunk_len, 0)::BIGINT AS chunk_len FROM chunks",
        "collection_stats": "SELECT count(*) AS points, max(len(embedding)) AS dim FROM embeddings",
        "context_pack": f"WITH {_pack} SELECT qid, context FROM packed",
        "prompts": f"WITH {_pack} SELECT qid, '參考資料：' || chr(10) || context || chr(10) || chr(10) || '問題：' || qid AS prompt FROM packed",
        "source_list": f"WITH {_cited} SELECT * FROM cited",
        "sources_markdown": f"""WITH {_cited} SELECT qid, '{chat.SOURCES_HEADER}' || chr(10) || string_agg(CASE WHEN source_type = 'pdf' THEN '{chat.PDF_ICON}' ELSE '{chat.PAGE_ICON}' END || ' ' || url, chr(10) ORDER BY "index") AS view FROM cited GROUP BY qid""",
        "history_append": f"""SELECT conv_id, string_agg(role || ': ' || content, chr(10) ORDER BY turn, role, content) || chr(10) || 'user: conv ' || conv_id || chr(10) || 'assistant: ok' AS history
            FROM (SELECT DISTINCT conv_id, turn, role, content FROM chat_turns WHERE conv_id IS NOT NULL AND role IS NOT NULL AND {_strip("coalesce(content, '')")} <> '') GROUP BY conv_id""",
    }
