"""Whitening against a dense eigensolver, exact integers, and edge cases."""

from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuslake.llm import queries, whiten

VECS = "vec_id long, embedding array<float>, label int, e string, x string"


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 24), st.integers(0, 2**32 - 1), st.sampled_from(["any", "equal", "low"]))
def test_inertia(n, seed, kind):
    rng = np.random.default_rng(seed)
    values = {"any": rng.standard_normal(n), "equal": np.repeat(rng.standard_normal(1) + 3, n), "low": np.concatenate([rng.standard_normal(max(1, n // 2)), rng.standard_normal(n - max(1, n // 2)) * 1e-3])}[kind]
    q = np.linalg.qr(rng.standard_normal((n, n)))[0]
    at = float(rng.choice(values)) + 0.37
    a = (q * values) @ q.T
    assert whiten.inertia((a + a.T) / 2 - at * np.eye(n)) == (int((values > at).sum()), int((values < at).sum()))


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 40), st.integers(1, 20), st.integers(0, 2**32 - 1), st.sampled_from(["random", "equal", "pairs", "steep", "rank"]))
def test_leading_pairs(n, most, seed, kind):
    rng = np.random.default_rng(seed)
    values = {"random": rng.random(n), "equal": np.ones(n), "pairs": np.repeat(rng.random(n), 2)[:n], "steep": 10.0 ** -np.arange(n), "rank": np.where(np.arange(n) < n // 3, 1 + rng.random(n), 0.0)}[kind] * 1e3
    q = np.linalg.qr(rng.standard_normal((n, n)))[0]
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    got, vectors = whiten.leading(a, most)
    k = min(n, most)
    assert len(got) == k and np.allclose(got, np.sort(values)[::-1][:k], atol=1e-10 * 1e3)
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-9
    assert np.abs(a @ vectors - vectors * got).max() < 1e-9 * max(1.0, np.abs(a).max())


def by_hand(vectors):
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    mean = np.array([float(Fraction(int(s), n)) for s in sums])
    v = (fit - mean).T @ (fit - mean) / n
    values, q = np.linalg.eigh(v)
    return x, n, sums, mean, values[::-1], q[:, ::-1], np.trace(v)


def test_query_equals_a_dense_solver(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x, n, sums, mean, values, q, trace = by_hand([r["embedding"] for r in rows])
    at = {r["vec_id"]: i for i, r in enumerate(rows)}
    got = queries.op12_whitening(spark, sf).toPandas()
    assert len(got) == 16 * len(rows) and (got["n"] == n).all() and (got["identity_error"] < 1e-9).all()
    for c, part in got.groupby("component"):
        i = [at[v] for v in part["vec_id"]]
        want = ((x[i] - mean) @ q[:, c - 1]) / np.sqrt(values[c - 1])
        assert min(np.abs(part["whitened"] - want).max(), np.abs(part["whitened"] + want).max()) < 1e-7
        assert np.allclose(part["explained"], values[c - 1] / trace, rtol=1e-10)
        assert [int(d) for d in part["deviation"]] == [sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[k], sums, strict=True)) for k in i]


@pytest.mark.parametrize("shift", [0.0, 2.0**40])
def test_edge_cases(spark, shift):
    rng = np.random.default_rng(3)
    base = [[float(v + shift) for v in rng.integers(-99, 99, 3) * (1 if not shift else 2.0**20)] for _ in range(30)]
    rows = [(i, v) for i, v in enumerate(base)] + [(0, base[0])] * 40 + [(None, base[1])]
    bad = [(90, None), (91, []), (92, [1.0, None, 2.0]), (93, [1.0, float("nan"), 2.0]), (94, [float("inf"), 0.0, 0.0]), (95, [1.0, 2.0])]
    got = whiten.whiten(spark.createDataFrame([(*r, 1, "e", "x") for r in rows + bad], VECS)).toPandas()
    x, n, sums, mean, values, q, trace = by_hand(base)
    assert len(got) == 3 * len(rows) and not set(got["vec_id"].dropna()) & {r[0] for r in bad} and set(got["n"]) == {n}
    some = got[got["vec_id"] == 7].sort_values("component")
    assert np.allclose(np.abs(some["whitened"]), np.abs((x[7] - mean) @ q / np.sqrt(values)), atol=1e-6)
    assert set(map(int, some["deviation"])) == {sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[7], sums, strict=True))}
    assert (got["identity_error"] < 1e-6).all()


def test_few_vectors(spark):
    frame = lambda rows: spark.createDataFrame([(*r, 1, "e", "x") for r in rows], VECS)
    assert whiten.whiten(frame([])).count() == 0 and whiten.whiten(frame([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    line = whiten.whiten(frame([(i, [float(i), float(2 * i)]) for i in range(5)])).toPandas()  # one dimension of two varies
    assert set(line["component"]) == {1} and np.allclose(sorted(line["whitened"] ** 2), sorted((np.arange(5) - 2) ** 2 / 2.0)) and np.allclose(line["explained"], 1)
