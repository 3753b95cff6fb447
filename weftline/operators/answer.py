"""Context packing, source lists, prompts, answers and their reports, for many questions at once (key ``qid``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.models import CONTEXT_LABEL, NOTHING_FOUND, QUESTION_LABEL, system_prompt
from ..functions.text import head, if_empty, one_line, or_default, strip
from ..schemas import MAX_CTX_CHARS, NUM_CTX, TEMPERATURE


def _ordered(parts: Column, key: str, value: str, sep: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key), parts.alias(value)))), lambda s: s[value]), sep)


def packed(contexts: DataFrame, qid: str = "qid", position: str = "position", text: str = "text", budget: int = MAX_CTX_CHARS) -> DataFrame:
    """``qid, context``: numbered texts in order while their running length stays within the budget.

    A blank text is left out but keeps its number; the parting line breaks do not count; a question whose first text is
    over the budget has an empty context.
    """
    numbered = contexts.select(qid, position, strip(or_default(F.col(text), "")).alias("_t")).where("_t <> ''")
    entry = numbered.withColumn("entry", F.concat(F.lit("["), F.col(position).cast("string"), F.lit("] "), F.col("_t")))
    w = Window.partitionBy(qid).orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = entry.withColumn("_sum", F.sum(F.length("entry")).over(w)).where(F.col("_sum") <= budget)
    made = fits.groupBy(qid).agg(_ordered(F.col("entry"), position, "entry", "\n\n").alias("context"))
    return contexts.select(qid).distinct().join(made, qid, "left").select(qid, or_default(F.col("context"), "").alias("context"))


def cited(contexts: DataFrame, qid: str = "qid", position: str = "position") -> DataFrame:
    """``qid, index, url, title, source_type``: the first context of each url, under its number; empty urls are left out."""
    some = contexts.where(or_default(F.col("url"), "") != "")
    w = Window.partitionBy(qid, "url").orderBy(position)
    first = some.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return first.select(qid, F.col(position).alias("index"), "url", F.coalesce("title", F.substring_index("url", "/", -1)).alias("title"), or_default(F.col("source_type"), "").alias("source_type"))


def prompt(context: Column, question: Column) -> Column:
    return F.concat(F.lit(CONTEXT_LABEL + "\n"), context, F.lit("\n\n" + QUESTION_LABEL), question)


def chat_request(user: Column, model: str, system: str = system_prompt(), temperature: float = TEMPERATURE, num_ctx: int = NUM_CTX) -> Column:
    """The request of a chat service, as JSON."""
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    options = F.struct(F.lit(temperature).alias("temperature"), F.lit(num_ctx).alias("num_ctx"))
    return F.to_json(F.struct(F.lit(model).alias("model"), F.lit(False).alias("stream"), options.alias("options"), F.array(turn("system", F.lit(system)), turn("user", user)).alias("messages")))


def answered(questions: DataFrame, contexts: DataFrame, answer: Column | None = None, generate=None) -> DataFrame:
    """``qid, query, answer, sources, contexts`` of every question.

    ``answer``: an expression over ``context`` and ``query``; or ``generate``: a column function over the prompt. A
    question without contexts gets the fixed apology and empty lists; all contexts are cited, also those the budget left
    out.
    """
    context = packed(contexts)
    sources = cited(contexts).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("index", "url", "title", "source_type"))).alias("sources"))
    kept = contexts.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("position", "text", "url", "title", "category", "source_type", "chunk_index", "score", "rerank_score"))).alias("contexts"))
    with_context = questions.join(context, "qid", "left")
    found = with_context.where("context IS NOT NULL")
    told = generate(prompt(F.col("context"), F.col("query"))) if generate is not None else answer
    found = found.withColumn("answer", strip(told)).join(sources, "qid", "left").join(kept, "qid", "left")
    none = questions.join(contexts.select("qid").distinct(), "qid", "left_anti").select("qid", "query", F.lit(NOTHING_FOUND).alias("answer"))
    whole = found.select("qid", "query", "answer", "sources", "contexts").unionByName(none, allowMissingColumns=True)
    types = {f.name: f.dataType for f in found.schema.fields}
    return whole.select("qid", "query", "answer", *(F.coalesce(c, F.array().cast(types[c])).alias(c) for c in ("sources", "contexts")))


def report(answers: DataFrame, verbose: bool = False) -> DataFrame:
    """``qid, report``: an answer as printed text; ``verbose`` adds the contexts, 200 characters of each on one line."""
    lines = F.transform("sources", lambda s: F.format_string("  [%d] (%s) %s", s["index"], s["source_type"], s["url"]))
    body = [F.concat(F.lit(QUESTION_LABEL), F.col("query")), F.col("answer"), F.lit("參考來源："), F.array_join(lines, "\n")]
    if verbose:
        shown = F.transform("contexts", lambda c: F.concat(F.format_string("  [%d] rerank=%.4f  ", c["position"], c["rerank_score"]), or_default(c["url"], ""), F.lit("\n       "), one_line(head(c["text"], 200)), F.lit("…")))
        body += [F.lit("擷取到的 chunks："), F.array_join(shown, "\n")]
    return answers.select("qid", F.concat_ws("\n", *body).alias("report"))


def title_of(url: Column) -> Column:
    return if_empty(F.substring_index(url, "/", -1), url)
