"""Dense lists over an inverted file of cells.

``build`` fits unit centroids on a bounded sample (the SAMPLE vectors of smallest id hash), gives every vector its nearest cell and writes them by cell;
a cell of more than PART vectors is dealt in parts, so a crowd of copies is never one group. Beside stands a row for each cell: centroid,
parts, and its radius, the largest angle of a member to the centroid.

``search`` sends a query to its nearest ``probes`` cells only (other partitions aren't read). With ``exact`` a second look follows: by the
triangle inequality no member of a cell is nearer to the query than the angle to the centroid less the radius, so only cells for which that could
still beat the k-th score found are visited, and the list is the one of a full scan. Without, it's approximate. Scores are
always cosines of the vectors themselves. A cell that many queries visit has its queries dealt in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.operators.blocks import _allowed, _merged, top

SAMPLE, MOST_CELLS, ROUNDS, PART, QUERIES, TARGET, AT_ONCE = 20_000, 4096, 12, 50_000, 1024, 0.95, 2048


def _unit(e: np.ndarray) -> np.ndarray:
    return e / np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-300)


def centroids(sample: np.ndarray, cells: int) -> np.ndarray:
    """Unit centroids of unit vectors: seeds far from those before, then rounds of assignment and means; an empty cell takes the vector worst served."""
    rng = np.random.default_rng(7)
    found = sample[rng.integers(len(sample))][None, :]
    near = sample @ found[0]
    while len(found) < min(cells, len(sample)):
        weights = np.maximum(1 - near, 0)
        if weights.sum() <= 1e-12:
            break
        found = np.vstack([found, sample[rng.choice(len(sample), p=weights / weights.sum())]])
        near = np.maximum(near, sample @ found[-1])
    for _ in range(ROUNDS):
        like = sample @ found.T
        of, best = like.argmax(axis=1), like.max(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, of, sample)
        empty = np.flatnonzero(np.linalg.norm(sums, axis=1) < 1e-12)
        sums[empty] = sample[np.argsort(best)[: len(empty)]]
        found = _unit(sums)
    return found


def enough_probes(sample: np.ndarray, centre: np.ndarray, k: int = 40, share: float = TARGET) -> int:
    """In how many of its nearest cells a query finds ``share`` of its k best: measured on the sample, whose vectors ask each other."""
    asked = sample[: min(len(sample), 256)]
    like = asked @ sample.T
    like[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    best = np.argsort(-like, axis=1, kind="stable")[:, : min(k, max(len(sample) - 1, 1))]
    order = np.argsort(np.argsort(-(asked @ centre.T), axis=1, kind="stable"), axis=1)
    ranks = np.take_along_axis(order, (sample @ centre.T).argmax(axis=1)[best], axis=1)
    return int(np.quantile(ranks, share, method="higher")) + 1


def best_of_cell(ask: pd.DataFrame, rows: pd.DataFrame, keys: list[str], within: tuple[str, ...], k: int) -> pd.DataFrame:
    """``<keys>, chunk_id, score`` of each query's k best of a cell's rows, AT_ONCE of which are scored at a time: no matrix of all queries and all rows is held."""
    unit = _unit(np.stack(ask["embedding"].to_list()))
    held = [(np.empty(0, np.int64), np.empty(0)) for _ in range(len(ask))]
    for at in range(0, len(rows), AT_ONCE):
        part = rows.iloc[at : at + AT_ONCE]
        ids, found = part["chunk_id"].to_numpy(), np.round(unit @ _unit(np.stack(part["embedding"].to_list())).T, 6)
        found[~_allowed(ask, part, within)] = -np.inf
        least = np.array([s[-1] if len(s) == k else -np.inf for _, s in held])
        hits = (found >= least[:, None]) & (found > -np.inf)
        for j in np.flatnonzero(hits.any(axis=1)):
            held[j] = _merged(np.concatenate([held[j][0], ids[hits[j]]]), np.concatenate([held[j][1], found[j, hits[j]]]), k)
    of = np.repeat(np.arange(len(ask)), [len(i) for i, _ in held])
    return ask[keys].iloc[of].assign(chunk_id=np.concatenate([i for i, _ in held]), score=np.concatenate([s for _, s in held]))


def _usable(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(*columns, F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0))


@dataclass(frozen=True)
class Cells:
    path: str
    within: tuple[str, ...] = ()

    def vectors(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/vectors")

    def search(self, queries: DataFrame, k: int = 40, probes: int | None = None, exact: bool = False) -> DataFrame:
        """``query_id, <within>, chunk_id, score, rank``; ties by chunk id. ``probes``: as many cells as found TARGET of the hits of the sample, unless given. Queries: query_id, embedding, <within>; null and zero vectors ask nothing."""
        spark, within, keys = queries.sparkSession, self.within, ["query_id", *self.within]
        known = spark.read.parquet(f"{self.path}/cells").orderBy("cell").toPandas()  # at most MOST_CELLS rows
        rows = _usable(queries, *keys)
        kinds = dict(rows.dtypes)
        schema = ", ".join([*[f"{c} {kinds[c]}" for c in keys], "embedding array<double>", "cell int"])
        centre = np.stack(known["centroid"].to_list()) if len(known) else np.zeros((0, 1))
        probes = probes or (int(known["probes"].iloc[0]) if len(known) else 1)
        numbers, radius = known["cell"].to_numpy(), known["radius"].to_numpy()

        def visits(batches: Iterator[pd.DataFrame], again: bool) -> Iterator[pd.DataFrame]:
            for pdf in (whole.iloc[i : i + AT_ONCE] for whole in batches for i in range(0, len(whole), AT_ONCE)):
                if not len(numbers):
                    continue
                like = _unit(np.stack(pdf["embedding"].to_list())) @ centre.T
                nearest = np.argsort(-like, axis=1, kind="stable")[:, :probes]
                wanted = np.zeros(like.shape, bool)
                np.put_along_axis(wanted, nearest, True, axis=1)
                if again:
                    could = np.cos(np.maximum(np.arccos(np.clip(like, -1, 1)) - radius, 0))
                    wanted = ~wanted & (could >= pdf["floor"].to_numpy(float)[:, None] - 1e-5)
                q, c = np.nonzero(wanted)
                for i in range(0, len(q), AT_ONCE):
                    yield pdf[[*keys, "embedding"]].iloc[q[i : i + AT_ONCE]].assign(cell=numbers[c[i : i + AT_ONCE]])

        def scored(asked: DataFrame) -> DataFrame:
            many = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("blocks")).where("blocks > 0")
            parts = spark.read.parquet(f"{self.path}/cells").select("cell", "parts")
            left = asked.join(F.broadcast(many), "cell").join(F.broadcast(parts), "cell").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
            left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*keys, "embedding", "cell", "part", "block")
            right = self.vectors(spark).join(F.broadcast(many), "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks", "angle")

            def score(ask: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
                if not len(ask) or not len(rows):
                    return pd.DataFrame(columns=[*keys, "chunk_id", "score"])
                return best_of_cell(ask, rows, keys, within, k)

            group = ["cell", "part", "block"]
            return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(score, ", ".join([*[f"{c} {kinds[c]}" for c in keys], "chunk_id long", "score double"]))

        first = top(scored(rows.mapInPandas(lambda b: visits(b, False), schema)), within, k)
        if not exact:
            return first
        floor = first.where(F.col("rank") == k).select(*keys, F.col("score").alias("floor"))
        late = rows.join(floor, keys, "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
        return top(first.drop("rank").unionByName(scored(late.mapInPandas(lambda b: visits(b, True), schema))), within, k)


def build(vectors: DataFrame, path: str, within: tuple[str, ...] = (), cells: int | None = None, sample: int = SAMPLE) -> Cells:
    """Writes all vectors (chunk_id, embedding, <within>) by cell. ``sample`` bounds what the driver fits on; by default there are twice as many cells as its root."""
    spark, rows = vectors.sparkSession, _usable(vectors, "chunk_id", *within)
    fit = rows.select("chunk_id", "embedding").orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample).toPandas()
    centre = centroids(_unit(np.stack(fit["embedding"].to_list())), min(cells or 2 * int(len(fit) ** 0.5) + 1, MOST_CELLS)) if len(fit) else np.zeros((0, 1))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                like = _unit(np.stack(pdf["embedding"].to_list())) @ centre.T
                yield pdf.assign(cell=like.argmax(axis=1), angle=np.arccos(np.clip(like.max(axis=1), -1, 1)))

    probes = enough_probes(_unit(np.stack(fit["embedding"].to_list())), centre) if len(fit) else 1
    kinds = dict(rows.dtypes)
    assigned = rows.mapInPandas(assign, ", ".join([*[f"{c} {kinds[c]}" for c in rows.columns], "cell int", "angle double"]))
    assigned.write.mode("overwrite").parquet(f"{path}/assigned")
    staged = spark.read.parquet(f"{path}/assigned")
    table = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centre)], "cell int, centroid array<double>")
    known = staged.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).withColumn("parts", F.ceil(F.col("n") / PART).cast("int")).withColumn("probes", F.lit(probes)).join(F.broadcast(table), "cell")
    known.write.mode("overwrite").parquet(f"{path}/cells")
    dealt = staged.join(F.broadcast(spark.read.parquet(f"{path}/cells").select("cell", "parts")), "cell").withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.col("parts")).cast("int")).drop("parts")
    dealt.repartition("cell", "part").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    return Cells(path, within)
