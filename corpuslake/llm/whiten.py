"""Embedding whitening: the leading principal components by contour integration (FEAST), projected and scaled to unit variance.

Entries become whole numbers floor(64 * entry) + 1000000; the fit list is each distinct vector of them once. Spark makes the
list (staged, so every pass reads the same rows), its sums by dimension (exact), its covariance (centred before multiplying,
one width x width sum by task, added up in two levels) and, at the end, the covariance of the whitened list. What reaches the
driver has the size of the width alone, never of the table: two vectors and a width x width matrix.

``leading`` takes the eigenvalues of the covariance in slices. Inertia counts (signs of the pivots of a symmetric factorization of the
shifted matrix) place the slices' ends in gaps and tell how many eigenvalues each holds. In a slice, a Gauss-Legendre rule over
a half circle in the complex plane sums solves with shifted matrices: that filters a block of vectors down to the slice's
eigenspace; Rayleigh-Ritz extracts values and vectors, and the filter repeats until residuals are at rounding level. A
slice that yields fewer values than its inertia count is taken again from a larger block, and an error after that.

Nulls and edge cases: rows without a vector, or with a null or non-finite entry, are dropped; vectors of another width than the commonest
(of equally common ones the widest) have no place in the covariance and are dropped too; entries beyond 2**46 are held there; a null
id is passed on, repeated rows are whitened once each and fitted once; components whose eigenvalue is 0 to rounding can't be scaled
and are left out, so fewer than ``most`` may come; an empty table, or one distinct vector, gives an empty result; a deviation that 38
digits can't hold is null; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.common import stage

MOST, SCALE, SHIFT = 16, 64, 1_000_000
POINTS, SLICE, ROUNDS, RANK = 12, 8, 24, 1e-12
LARGEST = float(2**52)
RESULT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def inertia(a: np.ndarray) -> tuple[int, int]:
    """How many eigenvalues of a symmetric matrix are above and below 0: signs of the blocks of a factorization with complete pivoting."""
    a, above, below = np.array(a, float), 0, 0
    while (n := len(a)) > 0:
        diagonal, off = np.abs(np.diag(a)), np.abs(np.tril(a, -1))
        r, (p, q) = int(diagonal.argmax()), divmod(int(off.argmax()), n)
        if not off[p, q]:
            signs = np.sign(np.diag(a))
            return above + int((signs > 0).sum()), below + int((signs < 0).sum())
        if diagonal[r] >= 0.64 * off[p, q]:
            order = [r, *(i for i in range(n) if i != r)]
            a = a[np.ix_(order, order)]
            above, below = above + (a[0, 0] > 0), below + (a[0, 0] < 0)
            a = a[1:, 1:] - np.outer(a[1:, 0], a[1:, 0]) / a[0, 0]
        else:  # a block of two with a negative determinant: one eigenvalue on either side
            order = [q, p, *(i for i in range(n) if i not in (p, q))]
            a = a[np.ix_(order, order)]
            above, below = above + 1, below + 1
            a = a[2:, 2:] - a[2:, :2] @ np.linalg.solve(a[:2, :2], a[:2, 2:])
    return int(above), int(below)


def _above(a: np.ndarray, at: float) -> int:
    return inertia(a - at * np.eye(len(a)))[0]


def _ends(a: np.ndarray, most: int) -> list[float]:
    """Falling ends of slices: all lie in gaps, the slices hold at least the ``most`` largest eigenvalues, and few each unless there is no gap."""
    top = float(np.linalg.norm(a)) * (1 + 1e-6)
    counts: dict[float, int] = {top: 0, -top * 1e-3: len(a)}

    def gap_below(j: int) -> tuple[int, float] | None:
        """The first gap with at least j eigenvalues above it: how many, and a point in it."""
        while j < len(a):
            high, low = min(x for x, n in counts.items() if n < j), max(x for x, n in counts.items() if n > j)
            inside = [x for x, n in counts.items() if n == j]
            if inside and max(inside) - min(inside) > (high - low) / 2:  # the gap is known to a factor of two
                return j, (max(inside) + min(inside)) / 2
            if high - low < 1e-9 * top:
                j += 1  # as good as equal to the next: no end between them
                continue
            edges = sorted([low, *inside, high])
            wide = max(range(len(edges) - 1), key=lambda i: edges[i + 1] - edges[i])
            middle = (edges[wide] + edges[wide + 1]) / 2
            counts[middle] = _above(a, middle)
        return None

    ends, have = [top], 0
    while have < min(most, len(a)):
        found = gap_below(min(have + SLICE, max(most, have + 1)))
        if not found:
            return [*ends, -top * 1e-3]
        have = found[0]
        ends.append(found[1])
    return ends


def _slice(a: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """All ``count`` eigenpairs between low and high."""
    n, scale = len(a), float(np.linalg.norm(a)) or 1.0
    middle, radius = (low + high) / 2, (high - low) / 2
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    turns = np.exp(1j * (math.pi / 2) * (1 - nodes))
    for width in (min(n, count + max(4, count // 2)), min(n, 3 * count + 8), n):
        block, before = np.random.default_rng(5).standard_normal((n, width)), math.inf
        for _ in range(ROUNDS):
            filtered = np.zeros_like(block)
            for turn, weight in zip(turns, weights, strict=True):
                filtered += weight / 2 * radius * np.real(turn * np.linalg.solve((middle + radius * turn) * np.eye(n) - a, block.astype(complex)))
            basis, kept, _ = np.linalg.svd(filtered, full_matrices=False)
            basis = basis[:, kept > 1e-14 * kept[0]]
            values, small = np.linalg.eigh(basis.T @ a @ basis)
            block = basis @ small
            inside = (values > low) & (values < high)
            worst = float(np.abs(a @ block[:, inside] - block[:, inside] * values[inside]).max(initial=0.0)) / scale
            if inside.sum() == count and (worst < 1e-15 or worst < 1e-13 and worst > before / 2):
                return values[inside], block[:, inside]
            before = worst
        if inside.sum() == count and worst < 1e-10:
            return values[inside], block[:, inside]
    raise ArithmeticError(f"{int(inside.sum())} of {count} eigenvalues found between {low} and {high}")


def leading(a: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues, falling, and unit eigenvectors as columns (their largest entry positive)."""
    if not a.any():
        return np.zeros(min(most, len(a))), np.eye(len(a))[:, :most]
    ends = _ends(a, most)
    found = [_slice(a, low, high, count) for high, low in zip(ends, ends[1:], strict=False) if (count := _above(a, low) - _above(a, high))]
    values, vectors = np.concatenate([v for v, _ in found]), np.concatenate([x for _, x in found], axis=1)
    order = np.argsort(-values, kind="stable")[:most]
    vectors = vectors[:, order] / np.linalg.norm(vectors[:, order], axis=0)
    return values[order], vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), range(len(order))])


def _exact_sum(x: np.ndarray) -> list[int]:
    if len(x) and int(np.abs(x).max()) * len(x) >= 2**62:
        x = x.astype(object)
    return [int(v) for v in x.sum(axis=0)]


def _sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of rows and exact sums by dimension."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums = 0, [0] * width
        for pdf in batches:
            n += len(pdf)
            sums = [s + t for s, t in zip(sums, _exact_sum(np.stack(pdf["x"].to_list())), strict=True)] if len(pdf) else sums
        if n:
            yield pd.DataFrame({"i": range(width), "n": n, "s": [str(s) for s in sums]})

    rows = fit.mapInPandas(add, "i int, n long, s string").groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    return rows[0]["n"] if rows else 0, [int(r["s"]) for r in sorted(rows)]


def _spread(fit: DataFrame, mean: np.ndarray, onto: np.ndarray | None, n: int) -> np.ndarray:
    """Covariance of the list, or of what it becomes when projected; divisor n."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            if len(pdf):
                y = np.stack(pdf["x"].to_list()) - mean
                y = y if onto is None else y @ onto
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield pd.DataFrame({"i": range(len(total)), "v": list(total)})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": pdf["i"].iloc[:1], "part": pdf["part"].iloc[:1], "v": [np.sum(np.stack(pdf["v"].to_list()), axis=0)]})

    parts = fit.mapInPandas(add, "i int, v array<double>").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)))
    few = parts.groupBy("i", "part").applyInPandas(merge, "i int, part int, v array<double>").withColumn("part", F.lit(0))
    rows = few.groupBy("i").applyInPandas(merge, "i int, part int, v array<double>").collect()
    return np.array([r["v"] for r in sorted(rows, key=lambda r: r["i"])]) / n


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = MOST) -> DataFrame:
    """RESULT: a row for each vector and component."""
    spark = rows.sparkSession
    finite = F.forall("e", lambda c: F.coalesce(F.abs(c.cast("double")) < math.inf, F.lit(False)))
    held = lambda c: F.greatest(F.least(c.cast("double") * SCALE, F.lit(LARGEST)), F.lit(-LARGEST))
    good = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("e")).where(F.col("e").isNotNull() & finite & (F.size("e") > 0))
    common = good.groupBy(F.size("e").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).head()
    empty = spark.createDataFrame([], RESULT)
    if common is None:
        return empty
    width = common["width"]
    whole = good.where(F.size("e") == width).select("vec_id", F.transform("e", lambda c: F.floor(held(c)) + SHIFT).alias("x"))
    fit = stage(whole.select("x").distinct())
    n, sums = _sums(fit, width)
    mean = np.array([s / n for s in sums])
    covariance = _spread(fit, mean, None, n)
    values, vectors = leading(covariance, most)
    values = values[values > RANK * max(values, default=0)]
    if not len(values):
        return empty
    onto = vectors[:, : len(values)] / np.sqrt(values)
    error = float(np.abs(_spread(fit, mean, onto, n) - np.eye(len(values))).max())
    explained, k = values / np.trace(covariance), len(values)
    far = max(abs(s) for s in sums)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centre = np.array(sums, object)
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["x"].to_list())
            apart = x.astype(object) * n - centre if n * int(np.abs(x).max()) + far >= 2**62 else x * n - centre.astype(np.int64)
            apart = apart.astype(object) if int(np.abs(apart).max()) ** 2 * width >= 2**63 else apart
            yield pd.DataFrame({
                "vec_id": pdf["vec_id"].repeat(k), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(pdf)), "n": n, "deviation": [str(v) for v in (apart * apart).sum(axis=1) for _ in range(k)],
                "whitened": ((x - mean) @ onto).ravel(), "explained": np.tile(explained, len(pdf)), "identity_error": error,
            })

    out = whole.mapInPandas(project, RESULT.replace("decimal(38,0)", "string"))
    return out.withColumn("deviation", F.col("deviation").try_cast("decimal(38,0)"))
