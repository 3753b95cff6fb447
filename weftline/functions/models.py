"""The three models behind interfaces, each with a deterministic local stand-in and an adapter for a remote service.

The stand-ins are no models: they make every plan run and be tested without a network. An adapter is a plain class with
the same method; it is created once per Python worker.
"""

from __future__ import annotations

import json
import re
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import BATCH_SIZE, DENSE_DIM, NUM_CTX, TEMPERATURE

#: Texts of the answer stage. The assistant's employer is a parameter.
SYSTEM_PROMPT = """你是{organisation}的智慧助理。
請根據以下提供的參考資料回答問題。
規則：
1. 只根據參考資料中的內容回答，不要自行添加資料中沒有的資訊
2. 回答語言請與問題語言一致（問中文答中文，問英文答英文）
3. 若參考資料中找不到答案，請直接說「根據現有資料無法回答此問題」
4. 回答後請列出資料來源的編號"""
REFUSAL = "根據現有資料無法回答此問題"
NOTHING_FOUND = "抱歉，資料庫中找不到與此問題相關的內容。"
UNREACHABLE = "[錯誤] 無法連接 Ollama ({url})，請確認服務已啟動。"
CALL_FAILED = "[錯誤] LLM 呼叫失敗：{error}"
CONTEXT_LABEL, QUESTION_LABEL = "參考資料：", "問題："


def system_prompt(organisation: str = "本校") -> str:
    return SYSTEM_PROMPT.format(organisation=organisation)



class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


class Reranker(Protocol):
    def score(self, query: str, texts: list[str]) -> list[float]: ...


class Generator(Protocol):
    def generate(self, system: str, prompt: str) -> str: ...


class HashedNgrams:
    """Stand-in embedder: signed hashed character n-grams, normalised to length 1."""

    def __init__(self, dim: int = DENSE_DIM, n: tuple[int, ...] = (1, 2, 3)):
        self.dim, self.n = dim, n

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for i, t in enumerate(texts):
            codes = np.frombuffer(re.sub(r"\s+", " ", (t or "").lower()).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
            for n in self.n:
                if len(codes) >= n:
                    h = np.zeros(len(codes) - n + 1, dtype=np.uint64)
                    for k in range(n):
                        h = (h ^ codes[k : len(codes) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                        h ^= h >> np.uint64(29)
                    np.add.at(out[i], (h % np.uint64(self.dim)).astype(np.int64), np.where(h >> np.uint64(63), -1.0, 1.0))
            norm = float(np.sqrt((out[i].astype(np.float64) ** 2).sum()))
            if norm:
                out[i] /= norm
        return out


class RemoteEmbedder:
    """Batches of texts to an HTTP service: ``{"model", "input"}`` gives ``{"embeddings"}``. A failure raises."""

    def __init__(self, url: str, model: str, timeout: float = 120):
        self.url, self.model, self.timeout, self.ready = url.rstrip("/"), model, timeout, False

    def verify(self) -> None:
        with urllib.request.urlopen(f"{self.url}/api/tags", timeout=5) as r:
            names = [m["name"] for m in json.load(r)["models"]]
        if not any(self.model in n for n in names):
            raise RuntimeError(f"model {self.model} is not available")
        self.ready = True

    def embed(self, texts: list[str]) -> np.ndarray:
        if not self.ready:
            self.verify()
        return np.array(_post(f"{self.url}/api/embed", {"model": self.model, "input": texts}, self.timeout)["embeddings"], dtype=np.float32)


class RemoteReranker:
    """Pairs to an HTTP service: ``{"model", "query", "documents"}`` gives ``{"results": [{"index", "relevance_score"}]}``. A failure raises."""

    def __init__(self, url: str, model: str, timeout: float = 600):
        self.url, self.model, self.timeout = url.rstrip("/"), model, timeout

    def score(self, query: str, texts: list[str]) -> list[float]:
        if not texts:
            return []
        got = _post(f"{self.url}/rerank", {"model": self.model, "query": query, "documents": texts}, self.timeout)["results"]
        out = [0.0] * len(texts)
        for r in got:
            out[r["index"]] = float(r["relevance_score"])
        return out


class CrossEncoder:
    """A cross-encoder of the optional library ``FlagEmbedding``, loaded at its first use, in half precision unless told otherwise."""

    def __init__(self, model: str, device: str = "auto", use_fp16: bool = True):
        self.model, self.device, self.use_fp16, self._loaded = model, device, use_fp16, None

    def _load(self):
        if self._loaded is None:
            try:
                from FlagEmbedding import FlagReranker
            except ImportError as e:
                raise ImportError("the cross-encoder needs the package FlagEmbedding; name a service or use the stand-in instead") from e
            device = {} if self.device == "auto" else {"devices": self.device}
            self._loaded = FlagReranker(self.model, use_fp16=self.use_fp16, **device)
        return self._loaded

    def score(self, query: str, texts: list[str]) -> list[float]:
        if not texts:
            return []
        got = self._load().compute_score([[query, t] for t in texts], normalize=True)
        return [float(got)] if isinstance(got, float) else [float(x) for x in got]


class RemoteGenerator:
    """One chat call per prompt, not streamed. A failure becomes the answer's text."""

    def __init__(self, url: str, model: str, temperature: float = TEMPERATURE, num_ctx: int = NUM_CTX, timeout: float = 120):
        self.url, self.model, self.temperature, self.num_ctx, self.timeout = url.rstrip("/"), model, temperature, num_ctx, timeout

    def generate(self, system: str, prompt: str) -> str:
        body = {"model": self.model, "stream": False, "options": {"temperature": self.temperature, "num_ctx": self.num_ctx}, "messages": [{"role": "system", "content": system}, {"role": "user", "content": prompt}]}
        try:
            return _post(f"{self.url}/api/chat", body, self.timeout)["message"]["content"].strip()
        except urllib.error.HTTPError as e:  # the service's failure is the answer
            return CALL_FAILED.format(error=e)
        except urllib.error.URLError:
            return UNREACHABLE.format(url=self.url)
        except Exception as e:
            return CALL_FAILED.format(error=e)


def _post(url: str, body: dict, timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as r:
        return json.load(r)


def embedding(make: Callable[[], Embedder], batch: int = BATCH_SIZE) -> Callable[[Column], Column]:
    """A column function over an embedder that each worker makes once; sub-batches keep their order."""
    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in batches:
            texts = s.fillna("").tolist()
            yield pd.Series([v for a in range(0, len(texts), batch) for v in model.embed(texts[a : a + batch])], index=s.index, dtype=object)

    return embed


def scoring(make: Callable[[], Reranker]) -> Callable[[Column, Column], Column]:
    """A column function over a cross-encoder for ``(query, text)`` pairs."""
    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for q, t in batches:
            frame = pd.DataFrame({"q": q.fillna(""), "t": t.fillna("")})
            out = pd.Series(0.0, index=frame.index)
            for query, part in frame.groupby("q", sort=False):
                out[part.index] = model.score(query, part["t"].tolist())
            yield out

    return score


def generating(make: Callable[[], Generator], system: str = system_prompt()) -> Callable[[Column], Column]:
    @F.pandas_udf("string")
    def generate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in batches:
            yield s.map(lambda p: model.generate(system, p))

    return generate


def overlap_score(query: Column, text: Column) -> Column:
    """Stand-in reranker, in the JVM: a sigmoid of the share of the question's distinct words and characters the text holds."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[\s\p{P}]+|(?<=[\x{3400}-\x{9fff}])(?=.)|(?<=.)(?=[\x{3400}-\x{9fff}])"), lambda w: w != ""))
    q = words(query)
    share = F.size(F.array_intersect(q, words(text))) / F.greatest(F.size(q), F.lit(1))
    return 1 / (1 + F.exp(-(share * 8 - 4)))


def extractive_answer(context: Column) -> Column:
    """Stand-in generator, in the JVM: the first sentence of source 1 and the sources' numbers, or the refusal."""
    first = F.regexp_extract(context, r"(?s)^\[1\] (.+?(?:[。！？!?]|\.(?=\s|$)|\n|$))", 1)
    numbers = F.array_join(F.regexp_extract_all(context, F.lit(r"(?m)^\[(\d+)\] "), F.lit(1)), ", ")
    body = F.when(first != "", F.concat(F.rtrim(first), F.lit("\n"))).otherwise(F.lit(""))
    return F.when(F.coalesce(context, F.lit("")) == "", F.lit(REFUSAL)).otherwise(F.concat(body, F.lit("["), numbers, F.lit("]")))
