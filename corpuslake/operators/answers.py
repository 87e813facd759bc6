"""Jobs over answers, their citations and evaluation runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUBSTANTIAL = 150


def first_substantial(chunks: DataFrame, least: int = SUBSTANTIAL) -> DataFrame:
    """For each (source, locator) the first chunk of ``least`` characters, else the longest. A least struct, so partial sums combine before the shuffle."""
    n = F.char_length("text")
    best = F.min(F.struct((n < least).alias("short"), F.when(n < least, -n).otherwise(0).alias("size"), "chunk_id")).alias("best")
    return chunks.groupBy("source_id", "locator").agg(best).select("source_id", "locator", F.col("best.chunk_id").alias("chunk_id"))


def resolve_cites(cites: DataFrame, chunks: DataFrame) -> DataFrame:
    """The best chunk for each ``cite_id, doc_id, locator, quote``: one that contains the quote, then the exact locator, then the least id."""
    found = cites.join(chunks.select("doc_id", F.col("locator").alias("at"), "chunk_id", "text"), "doc_id")
    key = F.struct((~F.contains("text", F.col("quote"))).alias("a"), (F.col("at") != F.col("locator")).alias("b"), F.col("chunk_id").alias("c"))
    return found.groupBy("cite_id").agg(F.min(key).alias("k")).select("cite_id", F.col("k.c").alias("chunk_id"), (~F.col("k.a")).alias("quoted"))


def confidence(rows: DataFrame) -> DataFrame:
    """``score, band, reasons`` from hits, agreed, named, total, verified, flags, top (a cited chunk is among the first three hits)."""
    retrieval = F.least(F.lit(1.0), 0.5 + 0.5 * F.col("agreed") / F.col("hits") + F.when(F.col("named"), 0.2).otherwise(0.0))
    coverage = F.when(F.col("total") > 0, F.col("verified") / F.col("total")).otherwise(0.0)
    score = F.when(F.col("hits") == 0, 0.0).otherwise(retrieval * coverage * (1 - F.least(F.lit(0.6), 0.2 * F.col("flags"))) * F.when(F.col("top"), 1.0).otherwise(0.8))
    verified = F.when(F.col("total") > 0, F.format_string("%d of %d citations verified", F.col("verified"), F.col("total"))).otherwise("no citations")
    reasons = F.array_compact(F.array(F.when(F.col("named"), "the provision you named was found"), verified, F.when(F.col("flags") > 0, F.format_string("%d verifier warning(s)", F.col("flags")))))
    rows = rows.withColumn("reasons", F.when(F.col("hits") == 0, F.array(F.lit("no sources found"))).otherwise(reasons))
    return rows.withColumn("score", F.round(score, 3)).withColumn("band", F.when(F.col("score") >= 0.7, "high").when(F.col("score") >= 0.45, "medium").otherwise("low"))


def decide(questions: list[tuple[str, Column, str]], fallback: str) -> Column:
    """An ordered decision list: the first yes gives its outcome, an unanswered question is asked, all no give the fallback."""
    step = lambda rest, q: F.when(q[1], q[2]).when(q[1].isNull(), f"ask {q[0]}").otherwise(rest)
    return reduce(step, reversed(questions), F.lit(fallback))


def prefer_incoming(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Replace by key: every incoming row, and the stored rows whose key has none."""
    return incoming.unionByName(stored.join(incoming.select(key), key, "left_anti"))


def drift(target: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows that a stored export lacks or has too many of, with their side."""
    return rows.exceptAll(target).withColumn("side", F.lit("missing")).unionByName(target.exceptAll(rows).withColumn("side", F.lit("stale")))


def score_band(share: Column) -> Column:
    return F.when(share >= 0.9, "gold").when(share >= 0.7, "silver").when(share >= 0.5, "bronze").otherwise("none")


def repeated_calls(calls: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Calls (run, tool, arguments as a flat JSON object) that their run has made before with the same arguments, in any order of keys."""
    pairs = F.array_sort(F.map_entries(F.from_json("arguments", "map<string,string>")))
    same = Window.partitionBy("run", "tool", F.coalesce(F.md5(F.to_json(pairs)), F.lit(""))).orderBy(*order)
    return calls.withColumn("nth", F.row_number().over(same)).where("nth > 1").drop("nth")


def compare_runs(metrics: DataFrame) -> DataFrame:
    """``metric, run, mean, before, change``: null-skipping means of (run, metric, value) beside those of the run before."""
    means = metrics.groupBy("metric", "run").agg(F.round(F.avg("value"), 3).alias("mean"))
    before = F.lag("mean").over(Window.partitionBy("metric").orderBy("run"))
    return means.withColumn("before", before).withColumn("change", F.round(F.col("mean") - F.col("before"), 3))
