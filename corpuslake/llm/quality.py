"""Quality: naive Bayes support vectors (n-gram indicators scaled by class log-count ratios, hinge loss).

Indicators: words and word pairs, and one to three neighbouring word shapes (lower, capitalised, upper,
digits, the same word again, punctuation as it stands), hashed to 2 ** BITS. Each is scaled by the log ratio
of its smoothed shares in the two classes; rows have unit length. The linear model minimises the hinge loss with
an L2 penalty by dual coordinate descent. A logistic curve fitted to the margins of rows
left out of the descent turns margins into scores.

Learning uses at most MAX_ROWS labelled rows (``max_rows``), the ones with the smallest id hashes, and of these the
first that hold MAX_CHARS characters together (``max_chars``), so the driver, where the descent runs, gets a bounded
number of bytes. Bins of fewer than two rows have ratio 0, so the model keeps the others only; rows travel as packed
numbers. Everything else covers all rows.

Nulls and edge cases: a null or empty text has no indicator and gets the intercept's score; null labels and
ids are not learned from; with no labelled row, or one class only, every score is that class's share (1
without rows, so nothing is rejected unlearned); repeated rows are scored once each; an empty table gives an empty
result; further columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.llm.common import ids_and_text, labelled_sample, stage

MAX_ROWS, MAX_CHARS, BITS, ALPHA, COST, EPOCHS = 6_000, 40_000_000, 20, 1.0, 1.0, 12
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def indicators(text: str) -> np.ndarray:
    """Sorted distinct feature numbers of a whole text."""
    tokens = _TOKEN.findall(text)
    if not tokens:
        return np.array([], np.int32)
    n = len(tokens)
    word = np.fromiter(map(xxhash.xxh3_64_intdigest, map(str.lower, tokens)), np.uint64, n)
    flag = lambda f: np.fromiter(map(f, tokens), bool, n)
    shape = np.where(flag(str.isalnum), np.uint64(1), word)
    shape[flag(str.islower)] = 2
    shape[flag(str.istitle)] = 3
    shape[flag(str.isupper) & (np.fromiter(map(len, tokens), np.int64, n) > 1)] = 4
    shape[flag(str.isdigit)] = 5
    shape[1:][word[1:] == word[:-1]] = 6
    shape = (shape + np.uint64(11)) * _PAIR
    two = (shape[:-1] ^ shape[1:] >> np.uint64(7)) * _PAIR
    three = (two[:-1] ^ shape[2:] >> np.uint64(13)) * _PAIR
    pairs = (word[:-1] ^ word[1:] >> np.uint64(9)) * _PAIR
    return np.unique(np.concatenate([word, pairs, shape, two, three]) >> np.uint64(64 - BITS)).astype(np.int32)


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bins of two rows or more and their ratios; all other ratios are 0."""
    counts = np.zeros((2, 1 << BITS), np.int32)
    for idx, label in zip(rows, y, strict=True):
        counts[int(label > 0), idx] += 1
    total = counts.sum(axis=1) + ALPHA * (1 << BITS)
    scale = np.log((ALPHA + np.array([(y <= 0).sum(), (y > 0).sum()])) / total)
    bins = np.flatnonzero(counts.sum(axis=0) >= 2).astype(np.int32)
    shares = (counts[:, bins] + ALPHA) / total[:, None]
    return bins, np.log(shares[1] / shares[0]) - (scale[0] - scale[1])


def dual_coordinate_descent(rows: list[np.ndarray], ratio: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and intercept of min (|w|^2 + b^2) / 2 + sum cost * max(0, 1 - y (w x + b)), one dual variable (0 to cost) at a time; x: ``ratio`` at a row's indicators, at unit length."""
    w, b, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    size = np.array([max(1e-9, float(np.linalg.norm(ratio[r]))) for r in rows])
    square = np.array([float(ratio[r] @ ratio[r]) for r in rows]) / size**2 + 1
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            idx = rows[i]
            v = ratio[idx] / size[i]
            slope = y[i] * (float(w[idx] @ v) + b) - 1
            new = min(cost[i], max(0.0, alpha[i] - slope / square[i]))
            step = (new - alpha[i]) * y[i]
            if step:
                w[idx] += step * v
                b += step
                most = max(most, abs(step))
                alpha[i] = new
        if most < 1e-4:
            break
    return w, b


def logistic_curve(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps on smoothed targets (Platt)."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, c = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + c, -30, 30)))
        g = np.array([((p - t) * margins).sum() + 1e-3 * a, (p - t).sum()])
        q = p * (1 - p) + 1e-9
        h = np.array([[(q * margins**2).sum() + 1e-3, (q * margins).sum()], [(q * margins).sum(), q.sum()]])
        step = np.linalg.solve(h, g)
        a, c = a - step[0], c - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(c)


def fit(rows: list[np.ndarray], labels: np.ndarray, ids: np.ndarray) -> tuple[tuple[np.ndarray, ...], float, float, float]:
    """Sparse model (bins, weights, ratios), intercept, and the curve's slope and offset."""
    y = np.where(labels > 0, 1.0, -1.0)
    # The curve needs margins of unseen rows: every fifth by id hash, if both classes are on both sides.
    out = np.array([xxhash.xxh3_64_intdigest(str(i)) % 5 == 0 for i in ids])
    if len(set(y[out])) < 2 or len(set(y[~out])) < 2:
        out[:] = False

    def descend(pick: np.ndarray) -> tuple[tuple[np.ndarray, ...], float]:
        chosen = [rows[i] for i in np.flatnonzero(pick)]
        bins, ratio = log_count_ratios(chosen, y[pick])
        place = np.full(1 << BITS, -1, np.int32)
        place[bins] = np.arange(len(bins), dtype=np.int32)
        chosen = [(at := place[r])[at >= 0] for r in chosen]
        share = (y[pick] > 0).mean()
        w, b = dual_coordinate_descent(chosen, ratio, y[pick], COST * np.where(y[pick] > 0, 0.5 / share, 0.5 / (1 - share)) * 2)
        return (bins, w.astype(np.float32), ratio.astype(np.float32)), b

    model, b = descend(~out)
    test = out if out.any() else ~out
    wide = spread(model)
    slope, offset = logistic_curve(np.array([margin(rows[i], wide, b) for i in np.flatnonzero(test)]), y[test])
    return model, b, slope, offset


def spread(model: tuple[np.ndarray, ...]) -> np.ndarray:
    """Weights and ratios at all 2 ** BITS bins."""
    bins, w, ratio = model
    wide = np.zeros((2, 1 << BITS), np.float32)
    wide[0, bins], wide[1, bins] = w, ratio
    return wide


def margin(idx: np.ndarray, model: np.ndarray, intercept: float) -> float:
    w, ratio = model
    r = ratio[idx]
    return float(w[idx] @ r) / max(1e-9, float(np.linalg.norm(r))) + intercept


def quality_scorer(docs: DataFrame, labels: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> Callable[[Column], Column]:
    """A function from a text column to its score; labels are read only where ``learn_from`` (over ``id``) holds."""
    texts = ids_and_text(docs, id_col, text_col)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "y": pdf["y"], "x": [indicators(t).tobytes() for t in pdf["text"]]})

    sample = stage(labelled_sample(texts.withColumnsRenamed({"id": "doc_id"}), labels, label, learn_from, max_rows))
    fits = sample.select("id", F.char_length("text").alias("n")).groupBy("id").agg(F.sum("n").alias("n")).withColumn("sum", F.sum("n").over(Window.orderBy(F.xxhash64("id", F.lit(17)), "id")))
    sample = sample.join(F.broadcast(fits.where(F.col("sum") <= max_chars).select("id")), "id", "left_semi")
    learned = sorted(sample.mapInPandas(read, "id long, y int, x binary").collect(), key=lambda r: r["id"])
    y = np.array([r["y"] for r in learned], int)
    if len(set(y.tolist())) < 2:
        return lambda text: F.lit(float(y.mean()) if len(y) else 1.0)
    model, intercept, slope, offset = fit([np.frombuffer(r["x"], np.int32) for r in learned], y, np.array([r["id"] for r in learned], np.int64))
    shared = docs.sparkSession.sparkContext.broadcast((model, intercept, slope, offset))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        model, b, slope, offset = shared.value
        model = spread(model)
        return pd.Series([1 / (1 + math.exp(-max(-30.0, min(30.0, slope * margin(indicators(t), model, b) + offset)))) for t in texts], dtype=float)

    return lambda text: score(F.coalesce(text, F.lit("")))


def score_quality(docs: DataFrame, labels: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> DataFrame:
    """``id, score`` for every row of ``docs``."""
    score = quality_scorer(docs, labels, learn_from, id_col, text_col, label, max_rows, max_chars)
    return docs.select(F.col(id_col).cast("long").alias("id"), score(F.col(text_col)).alias("score"))
