"""Pluggable models as columns: embedders and rerankers in Arrow batches, a model loaded once a task."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.functions import text as T

Encoder = Callable[[list[str]], np.ndarray]
DIM = 64


def _place(word: str) -> tuple[int, int]:
    digest = hashlib.md5(word.encode()).digest()
    return digest[0] % DIM, 1 - (digest[1] >> 4) % 2 * 2


def hashing_encoder() -> Encoder:
    """The default model, without any download: words of three characters or more, each added or subtracted at one of DIM places by its hash, at unit length."""

    def slot(word: str) -> int:
        at, sign = _place(word)
        return 2 * at + (sign < 0)

    slots = T.Known(slot)

    def encode(texts: list[str]) -> np.ndarray:
        counts = np.zeros(len(texts) * 2 * DIM, np.int64)
        for row, number, words in T.word_places(texts):
            at = np.fromiter(map(slots.__getitem__, words), np.int64, len(words))
            counts += np.bincount(row * 2 * DIM + at[number], minlength=len(counts))
        counts = counts.reshape(-1, DIM, 2)
        out = (counts[..., 0] - counts[..., 1]).astype(float)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return encode


def embedding(text: Column, load: Callable[[], Encoder] = hashing_encoder, batch: int = 256, kind: str = "array<double>") -> Column:
    """``text``'s vector; null texts have none. ``load`` runs once a task, the model sees ``batch`` texts at a time."""

    def encode(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in series:
            out, known = np.empty(len(texts), object), np.flatnonzero(texts.notna().to_numpy())
            for at in range(0, len(known), batch):
                rows = known[at : at + batch]
                for i, v in zip(rows, model(texts.iloc[rows].tolist()), strict=True):
                    out[i] = v
            yield pd.Series(out)

    encode.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(encode, kind)(text)


def pair_score(load: Callable[[], Callable[[list[str], list[str]], np.ndarray]]) -> Callable[[Column, Column], Column]:
    """A reranker for ``retrieval.rerank``: ``load`` gives a function of queries and passages to scores, once a task."""

    def make(query: Column, passage: Column) -> Column:
        def score(series: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            model = load()
            for queries, passages in series:
                yield pd.Series(np.asarray(model(queries.tolist(), passages.tolist()), float))

        score.__annotations__ = {"series": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
        return F.pandas_udf(score, "double")(query, passage)

    return make


def reembed_stale(chunks: DataFrame, model: str, load: Callable[[], Encoder] = hashing_encoder) -> DataFrame:
    """``chunks`` (text, embedding, model, ...) with new vectors where the model differs or is missing; other rows stay as they are."""
    stale = F.col("model").isNull() | (F.col("model") != model)
    fresh = chunks.where(stale).withColumn("embedding", embedding(F.col("text"), load)).withColumn("model", F.lit(model))
    return chunks.where(~stale).unionByName(fresh)
