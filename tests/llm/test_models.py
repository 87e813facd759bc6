"""The classifiers' parts against plain Python, and every operator on very long texts."""

import math
import re
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuslake.llm import chat, linededup, media, merkle, mixing, neardup, quality, toxicity

LONG = {"blank": "x" + " " * 1_000_000, "letters": "a" * 1_000_000, "lines": "\n" * 1_000_000, "characters": "日本" * 300_000, "marks": "!?" * 500_000, "words": "word " * 200_000, "swapped": "a.b@" * 250_000}


def test_very_long_texts_take_seconds():
    for name, text in LONG.items():
        began = time.time()
        toxicity.features(text, {"word": 1.0})
        quality.indicators(text)
        neardup.signature(neardup.shingles(text))
        merkle.Tree(text).fingerprint()
        body = text.encode().ljust(-(-len(text.encode()) // 64) * 64, b"\0")
        assert media.demux(media.mux(body))["payload"] == body
        assert time.time() - began < 30, name


def test_very_long_texts_as_rows(spark):
    rows = [(i, t, "en", "s") for i, t in enumerate(LONG.values())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(2)
    kept = {r["id"]: r["kept_text"] for r in linededup.dedup_lines(docs).select("id", "kept_text").collect()}
    assert kept == {i: t for i, t, *_ in rows} and mixing.mix(docs).count() == len(rows)
    turns = docs.select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("assistant").alias("role"), "text")
    assert {r["conv_id"]: r["loss"] for r in chat.read_back(chat.windows(turns)).collect()} == {i: t for i, t, *_ in rows}


_OLD = re.compile(r"[^\W\d_]+(?:[@$*013457!|+.\-_][^\W\d_]+)+")


@settings(max_examples=300, deadline=None)
@given(st.text("ab.@1 _é\n", max_size=40))
def test_swapped_words_by_the_plain_pattern(text):
    assert toxicity._SWAPPED.findall(text) == _OLD.findall(text)


def test_features_of_a_text():
    got = toxicity.features("You IDIOT! idiot, sc.um you", {"idiot": 2.0, "^scum": 1.0, "scum": 1.5})
    words = 6  # you, idiot, idiot, sc, um, you
    assert got[0] == 1 and got[1] == 2.0 and got[2] == 2000 / words and got[3] == 4000 / words and got[10] == 1 and got[11] == 1000 / words and got[12] == 1000 / words
    assert got[13] == 6 / 27 and got[14] == 3 / 27 and got[15] == math.log1p(words) and len(got) == toxicity.N_FEATURES
    assert toxicity.features("", {}) == [0.0] * toxicity.N_FEATURES


def test_lexicon_ratio_by_definition(spark):
    rows = [(p, n) for p in (0, 1, 5, 40) for n in (0, 3, 60)]
    df = spark.createDataFrame([(float(p), float(n)) for p, n in rows], "p double, n double")
    ratio, weight = toxicity._ratio(F.col("p"), F.col("n"), 40, 60)
    for r in df.select("p", "n", ratio.alias("ratio"), weight.alias("weight")).collect():
        share, want = (r["p"] + r["n"]) / 100, 0.0
        for k, m in ((r["p"], 40), (r["n"], 60)):
            want += k * math.log(k / (m * share)) if k else 0.0
            want += (m - k) * math.log((m - k) / (m * (1 - share))) if m > k else 0.0
        lean = math.log((r["p"] + 0.5) / 41) - math.log((r["n"] + 0.5) / 61)
        assert abs(r["weight"] - lean) < 1e-9 and abs(r["ratio"] - (2 * want if lean > 0 else 0.0)) < 1e-9


def test_dual_descent_meets_a_plain_solver():
    rng = np.random.default_rng(2)
    rows = [np.sort(rng.choice(30, rng.integers(1, 9), replace=False)) for _ in range(50)]
    y, ratio = np.where(rng.random(50) < 0.5, 1.0, -1.0), rng.normal(size=30)
    cost = np.where(y > 0, 0.7, 1.3)
    w, b = quality.dual_coordinate_descent(rows, ratio, y, cost, epochs=3000)
    x = np.zeros((50, 31))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.linalg.norm(ratio[r])
    x[:, 30] = 1.0
    q = (x * y[:, None]) @ (x * y[:, None]).T
    alpha, step = np.zeros(50), 1 / np.linalg.norm(q, 2)
    for _ in range(60_000):
        alpha = np.clip(alpha + step * (1 - q @ alpha), 0, cost)
    objective = lambda v: v @ v / 2 + (cost * np.maximum(0, 1 - y * (x @ v))).sum()
    assert objective(np.append(w, b)) <= objective((alpha * y) @ x) * (1 + 1e-3)


def test_learning_rows_are_bounded_in_characters(spark):
    docs = spark.createDataFrame([(i, "good words here " * 50 if i % 2 else "bad BAD !!! " * 50) for i in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100)], "doc_id long, quality int, toxic int")
    for chars in (5_000, 10**9):
        scored = quality.score_quality(docs, labels, F.lit(True), max_chars=chars)
        assert all((r["score"] >= 0.5) == bool(r["id"] % 2) for r in scored.collect())
    assert {r["score"] for r in quality.score_quality(docs, labels, F.lit(True), max_chars=10).collect()} == {1.0}


def test_null_and_empty_texts_have_the_empty_texts_score(spark):
    docs = spark.createDataFrame([(i, ("fine words " if i % 2 else "idiot scum you ") * 20) for i in range(120)] + [(500, None), (501, ""), (None, "x"), (7, "again")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(120)] + [(None, 1, 1), (3, None, None), (5, 7, 7)], "doc_id long, quality int, toxic int")
    for score in (quality.score_quality, toxicity.score_toxicity):
        got = score(docs, labels, F.lit(True)).collect()
        own = {r["id"]: r["score"] for r in got if r["id"] in (500, 501)}
        assert len(got) == 124 and own[500] == own[501] and all(0 <= r["score"] <= 1 for r in got)
