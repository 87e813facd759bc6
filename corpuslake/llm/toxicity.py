"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities and peaks of two learned lexicons (words, and word beginnings of four
and five letters, which also catch inflected and unseen forms), how near second-person words stand to
lexicon words, capitals, punctuation and obfuscation rates (letters swapped for digits and signs, lexicon
words found only after undoing that). The lexicons come from the labelled rows: terms whose presence is
associated with label 1 by a log-likelihood ratio of at least MIN_RATIO. Lexicon features of a learning row
use counts of the other folds only, so the trees don't see a row's own label in its features. A hash keeps a
quarter of the learning rows for the isotonic calibration.

Learning uses at most MAX_ROWS labelled rows (``max_rows``), the ones with the smallest id hashes; a lexicon
holds every term of these rows that passes the ratio and stands in three rows of label 1, so only the rows bound it. Everything
else covers all rows. All regular expressions read a text once, however long its runs of letters are.

Nulls and edge cases: null and empty texts have all features 0 and get a score like any other; null labels
and ids are not learned from; with no labelled row, or one class only, every score is that class's share
(0 without rows); repeated rows are scored once each; an empty table gives an empty result; further columns are
not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.common import ids_and_text, labelled_sample, stage

MAX_ROWS, MIN_RATIO, FOLDS, NEAR = 12_000, 18.0, 4, 4
TREES, DEPTH = 20, 4
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine sie ihr euch tu te toi ton ta tes vous votre tú ti tuyo usted ustedes vos".split())
_WORD = re.compile(r"[^\W\d_]+")
# A letter run is read once, from its start on: no backtracking, so time grows with the text only.
_SWAPPED = re.compile(r"(?<![^\W\d_])[^\W\d_]++(?:[@$*013457!|+.\-_][^\W\d_]++)+")
_UNDO = str.maketrans({"@": "a", "$": "s", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "!": "i", "|": "l", "+": "t", "*": None, ".": None, "-": None, "_": None})
_MARKS = re.compile(r"[^\w\s]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
N_FEATURES = 16


def terms(text: str) -> set[str]:
    """Distinct words, and their beginnings marked with a circumflex."""
    words = set(_WORD.findall(text.lower()))
    return words | {f"^{w[:n]}" for w in words for n in (4, 5) if len(w) > n}


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    words = _WORD.findall(text.lower())
    n, chars = len(words), max(1, len(text))
    distinct = set(words)
    hit = {w: lexicon[w] for w in distinct if w in lexicon}
    starts = {w: max(lexicon.get(f"^{w[:4]}", 0.0), lexicon.get(f"^{w[:5]}", 0.0)) for w in distinct if w not in hit and len(w) > 4}
    starts = {w: s for w, s in starts.items() if s > 0}
    near, count, total, start_count = 0, 0, 0.0, 0
    if hit or starts:
        last_you, last_hit = -99, -99
        for i, w in enumerate(words):
            if w in SECOND_PERSON:
                last_you = i
                near += i - last_hit <= NEAR
            if w in hit:
                count += 1
                total += hit[w]
                near += i - last_you <= NEAR
                last_hit = i
            elif w in starts:
                start_count += 1
    swapped = _SWAPPED.findall(text.lower())
    undone = [w.translate(_UNDO) for w in swapped]
    hidden = sum(1 for w in undone if w in lexicon)
    you = sum(1 for w in distinct if w in SECOND_PERSON)
    per = 1000.0 / max(1, n)
    return [
        float(len(hit)), max(hit.values(), default=0.0), count * per, total * per, float(len(starts)), max(starts.values(), default=0.0), start_count * per, sum(starts.values()),
        float(near), near * per, float(hidden), len(swapped) * per, you * per, len(_UPPER.findall(text)) / chars, len(_MARKS.findall(text)) / chars, math.log1p(n),
    ]


def _ratio(p: Column, n: Column, whole_p: int, whole_n: int) -> tuple[Column, Column]:
    """Log-likelihood ratio (0 unless the term leans to label 1) of a term present in p of whole_p and n of whole_n rows; its log odds."""
    share = (p + n) / F.lit(float(whole_p + whole_n))
    term = lambda k, of: F.when(k > 0, k * F.ln(F.try_divide(k, of))).otherwise(0.0)
    part = lambda k, m: term(k, m * share) + term(m - k, m * (1 - share))
    weight = F.ln((p + 0.5) / F.lit(whole_p + 1.0)) - F.ln((n + 0.5) / F.lit(whole_n + 1.0))
    return F.when(weight > 0, 2 * (part(p, F.lit(float(whole_p))) + part(n, F.lit(float(whole_n))))).otherwise(0.0), weight


def _term_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts by term, fold and label, added up within the task."""
    counts: Counter = Counter()
    for pdf in batches:
        for text, f, y in zip(pdf["text"], pdf["fold"], pdf["y"], strict=True):
            counts.update((t, f, y) for t in terms(text))
    rows = list(counts.items())
    for at in range(0, len(rows), 50_000):
        part = rows[at : at + 50_000]
        yield pd.DataFrame({"term": [k[0] for k, _ in part], "fold": [k[1] for k, _ in part], "y": [k[2] for k, _ in part], "n": [n for _, n in part]})


def learn_lexicons(sample: DataFrame) -> list[dict[str, float]]:
    """One lexicon without each fold's rows, and at the end one of all rows."""
    sizes = Counter({(r["fold"], r["y"]): r["n"] for r in sample.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n")).collect()})
    at = lambda f, y: F.sum(F.when((F.col("fold") == f) & (F.col("y") == y), F.col("n")).otherwise(0)).alias(f"c{f}{y}")
    wide = sample.select("text", "fold", "y").mapInPandas(_term_counts, "term string, fold int, y int, n long").groupBy("term").agg(*[at(f, y) for f in range(FOLDS) for y in (0, 1)])
    views = []
    for left_out in [*range(FOLDS), None]:
        folds = [f for f in range(FOLDS) if f != left_out]
        whole = [sum(sizes[f, y] for f in folds) for y in (0, 1)]
        n, p = (sum((F.col(f"c{f}{y}") for f in folds), F.lit(0)).cast("double") for y in (0, 1))
        views.append(F.struct(*(c.alias(k) for c, k in zip(_ratio(p, n, whole[1], whole[0]), ("ratio", "weight"), strict=True)), (p >= 3).alias("often")) if all(whole) else F.struct(F.lit(0.0).alias("ratio"), F.lit(0.0).alias("weight"), F.lit(False).alias("often")))
    scored = wide.select("term", F.array(*views).alias("v")).where(F.exists("v", lambda x: x["often"] & (x["ratio"] >= MIN_RATIO)))
    rows = scored.collect()
    return [{r["term"]: r["v"][k]["weight"] for r in rows if r["v"][k]["often"] and r["v"][k]["ratio"] >= MIN_RATIO} for k in range(FOLDS + 1)]


def _vectors(rows: DataFrame, lexicons: list[dict[str, float]], cols: str) -> DataFrame:
    """``x`` beside the columns named in ``cols`` (a schema); rows with a ``fold`` get their fold's lexicon, others the last."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicons)
    names = [c.split()[0] for c in cols.split(", ")]

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            folds = pdf["fold"] if "fold" in pdf else [-1] * len(pdf)
            yield pdf[names].assign(x=[features(t, shared.value[f]) for t, f in zip(pdf["text"], folds, strict=True)])

    return rows.mapInPandas(make, cols + ", x array<double>").withColumn("features", array_to_vector("x")).drop("x")


def score_toxicity(docs: DataFrame, labels: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS) -> DataFrame:
    """``id, score`` for every row of ``docs``; labels are read only where ``learn_from`` (over ``id``) holds."""
    texts = ids_and_text(docs, id_col, text_col)
    sample = stage(labelled_sample(texts.withColumnsRenamed({"id": "doc_id"}), labels, label, learn_from, max_rows).withColumn("fold", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(FOLDS)).cast("int")))
    shares = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(shares) < 2:
        return texts.select("id", F.lit(float(1 in shares)).alias("score"))
    lexicons = learn_lexicons(sample)
    learned = stage(_vectors(sample, lexicons, "id long, y int, fold int").withColumn("label", F.col("y").cast("double")))
    held = F.pmod(F.xxhash64("id", F.lit(29)), F.lit(4)) == 0
    fitting = learned.where(~held).repartition(4).persist()
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, minInstancesPerNode=3, seed=11, featuresCol="features", labelCol="label").fit(fitting)
    fitting.unpersist()
    raw = lambda df: trees.transform(df).withColumn("raw", vector_to_array("rawPrediction")[1])
    # many clean rows share one raw value: they meet as one weighted row, not as one task's hot key
    tied = raw(learned.where(held)).groupBy("raw").agg(F.avg("label").alias("label"), F.count(F.lit(1)).cast("double").alias("weight"))
    steps = IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="weight", predictionCol="score").fit(tied)
    return steps.transform(raw(_vectors(texts, lexicons, "id long")).select("id", "raw")).select("id", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("score"))
