"""Plug-ins for models: embedders and scorers as batch functions, with plain stand-ins."""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, FloatType


def word_number(word: str) -> int:
    """A number for a word: the first 32 bits of its MD5 digest."""
    return int(hashlib.md5(word.encode()).hexdigest()[:8], 16)


def hashed_embedder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """Stand-in embedder: signed hashed word counts. Takes a batch of texts, gives a matrix."""
    memo: dict[str, int] = {}

    def embed(texts: list[str]) -> np.ndarray:
        found = [re.findall(r"[^\W_]+", (t or "").lower()) for t in texts]
        if len(memo) > 300_000:
            memo.clear()
        for w in {w for f in found for w in f}.difference(memo):
            memo[w] = word_number(w)
        h = np.fromiter((memo[w] for f in found for w in f), np.int64)
        at = np.repeat(np.arange(len(texts)) * dim, list(map(len, found))) + h % dim
        return np.bincount(at, weights=np.where(h & 0x10000, 1.0, -1.0), minlength=len(texts) * dim).reshape(-1, dim)

    return embed


def hashed_tokenizer(vocabulary: int = 30_000) -> Callable[[str], list[int]]:
    """Stand-in tokenizer: a number for each word, between a start (1) and an end (2)."""

    def tokens(text: str) -> list[int]:
        return [1, *(3 + word_number(w) % (vocabulary - 3) for w in re.findall(r"[^\W_]+", (text or "").lower())), 2]

    return tokens


def padded(ids: list[list[int]], most: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers of a batch cut at `most` (the end mark goes with the rest), filled with zeros on the right, and the mask of real ones."""
    cut = [x[:most] for x in ids]
    out = np.zeros((len(cut), max(map(len, cut), default=0)), np.int64)
    for i, x in enumerate(cut):
        out[i, : len(x)] = x
    return out, (np.arange(out.shape[1]) < np.array([len(x) for x in cut], np.int64).reshape(-1, 1)).astype(np.int64)


def model_inputs(ids: np.ndarray, mask: np.ndarray, declared: list[str]) -> dict[str, np.ndarray]:
    """What a model is fed: of numbers, mask and token types (all zero) those inputs that it declares."""
    known = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
    return {name: known[name] for name in declared if name in known}


def token_embedder(tokenizer: Callable[[], Callable[[str], list[int]]], model: Callable[[], Callable[[dict[str, np.ndarray]], np.ndarray]], declared: list[str], most: int = 1024):
    """An embedder for `embedding` from a tokenizer and a model that gives a vector for each token: cut, pad, feed, pool."""

    def make() -> Callable[[list[str]], np.ndarray]:
        tokens, run = tokenizer(), model()

        def embed(texts: list[str]) -> np.ndarray:
            ids, mask = padded([tokens(t) for t in texts], most)
            return pool(run(model_inputs(ids, mask, declared)), mask)

        return embed

    return make


def pool(tokens: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of each row's token vectors where the mask is set; rows without any give zeros."""
    m = mask[..., None].astype(np.float32)
    return (np.asarray(tokens) * m).sum(1) / np.maximum(m.sum(1), 1)


def unit(v: np.ndarray) -> np.ndarray:
    """Rows at length one; zero rows stay."""
    n = np.linalg.norm(v, axis=-1, keepdims=True)
    return v / np.where(n > 0, n, 1)


def logit(output: np.ndarray) -> np.ndarray:
    """A model's score: the only label of two-dimensional output, else its second; the value itself of one-dimensional output."""
    return output if output.ndim == 1 else output[:, 0] if output.shape[1] == 1 else output[:, 1]


def embedding(text: Column, make: Callable[[], Callable[[list[str]], np.ndarray]] = hashed_embedder) -> Column:
    """Unit vectors of texts; `make` loads the model once for each task. Null text gives null."""

    @pandas_udf(ArrayType(FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for b in batches:
            v = unit(np.asarray(model(b.fillna("").tolist()), np.float64)).astype(np.float32)
            yield pd.Series([None if t is None else x for t, x in zip(b, v)])

    return run(text)


def scorer(make: Callable[[], Callable[[list[list[str]], list[list[str]]], np.ndarray]]):
    """A scorer for rerank from a function that loads a model of (query words, window words) batches."""

    def score(query_words: Column, window: Column) -> Column:
        @pandas_udf(DoubleType())
        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            model = make()
            for q, w in batches:
                yield pd.Series(logit(np.asarray(model(q.tolist(), w.tolist()), np.float64)))

        return run(query_words, window)

    return score


def extract_chat() -> Callable[[str, list[str]], list[str | None]]:
    """Stand-in for a chat model: of each context the first sentence of its first passage, as a paragraph."""

    def reply(prompt: str, contexts: list[str]) -> list[str | None]:
        first = [re.split("(?<=[.!?]) ", c.split("\n")[1][2:])[0] if "\n- " in c else "" for c in contexts]
        return [f"<p>{html.escape(x, quote=False)}</p>" if x.strip() else None for x in first]

    return reply


def chat(context: Column, prompt: str, make: Callable[[], Callable[[str, list[str]], list[str | None]]] = extract_chat) -> Column:
    """What a chat model replies to each context: a struct of body and error. An exception fails its own contexts only."""

    @pandas_udf("body string, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            rows = []
            for c in b:
                try:
                    rows.append((model(prompt, [c])[0], None))
                except Exception as error:
                    rows.append((None, str(error) or type(error).__name__))
            yield pd.DataFrame(rows, columns=["body", "error"])

    return run(context)


def document_progress(done: Column, total: Column) -> Column:
    """Progress shown to a user: a percent between 0 and 100 while work is under way, else null."""
    p = F.floor(F.try_divide(100 * done, total)).cast("int")
    return F.when((total > 0) & (p > 0) & (p < 100), p)
