"""Ingest as one change of a store: versions by content hash, former versions superseded, chunks of new ones, vectors of another model made anew.

Tables: ``hashes`` (which contents are known, by hash alone whatever their source), ``versions`` (by source; the newest is not superseded) and ``chunks``
(by source; those of superseded versions stay, for historical search). A batch reads and rewrites the buckets of its own hashes and sources only, and all
three tables change by one published manifest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslake.operators.corpus import upsert_outcome
from corpuslake.sources.store import Conflict, Store

SCHEMAS = {
    "hashes": "sha256 string, source_id string, model string",
    "versions": "source_id string, sha256 string, since long, superseded boolean, n_chunks long",
    "chunks": "source_id string, sha256 string, locator string, part int, text string, model string, embedding array<double>",
}
KEYS = {"hashes": "sha256", "versions": "source_id", "chunks": "source_id"}
Chunker = Callable[[DataFrame], DataFrame]
Embed = Callable[[Column], Column]


def corpus_store(path: str) -> Store:
    return Store(path, SCHEMAS, KEYS)


def by_lines(texts: DataFrame) -> DataFrame:
    """The plainest chunker: ``source_id, sha256, locator, part, text`` of (source_id, sha256, text), one chunk a non-blank line."""
    lines = texts.select("source_id", "sha256", F.posexplode(F.split("text", "\n")).alias("at", "text")).where(F.trim("text") != "")
    return lines.select("source_id", "sha256", F.concat(F.lit("s."), (F.col("at") + 1).cast("string")).alias("locator"), F.lit(1).alias("part"), "text")


def ingest(store: Store, texts: DataFrame, model: str, embed: Embed, chunker: Chunker = by_lines, rechunk: bool = False, token: tuple[str, int] | None = None, retries: int = 3) -> dict[str, int]:
    """Brings (source_id, text) into the store; counts by outcome. Equal texts are one version, of the smallest source id; of several new texts of a source the largest hash is the
    newest. A null text or source is left out. A token that is published already changes nothing."""
    spark: SparkSession = texts.sparkSession
    for left in range(retries, -1, -1):
        base = store.manifest(spark)
        if token and base["tokens"].get(token[0], -1) >= token[1]:
            return {}
        try:
            return _once(store, texts, model, embed, chunker, rechunk, token, base)
        except Conflict:
            if not left:
                raise
    return {}


def _once(store: Store, texts: DataFrame, model: str, embed: Embed, chunker: Chunker, rechunk: bool, token: tuple[str, int] | None, base: dict) -> dict[str, int]:
    spark = texts.sparkSession
    incoming = texts.where("source_id is not null and text is not null").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.min("source_id").alias("source_id"), F.first("text").alias("text"))
    by_hash = store.touched("hashes", incoming)
    hashes = store.read(spark, "hashes", by_hash, base)
    outcome = upsert_outcome(incoming.select("source_id", "sha256", F.lit(model).alias("model"), F.lit(rechunk).alias("rechunk")), hashes)
    known = hashes.select("sha256", F.col("source_id").alias("owner"))
    judged = incoming.join(outcome.drop("source_id"), "sha256").join(known, "sha256", "left").withColumn("source_id", F.coalesce("owner", "source_id")).drop("owner").persist()
    try:
        counts = {r["outcome"]: r["n"] for r in judged.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).collect()}
        work = judged.where("outcome <> 'unchanged'")
        by_source = store.touched("versions", work)
        if not by_source:
            return counts
        fresh = chunker(work.where("outcome <> 're_embedded'").select("source_id", "sha256", "text"))
        old = store.read(spark, "chunks", by_source, base)
        stale = work.where("outcome = 're_embedded'").select("sha256")
        kept = old.join(work.select("sha256"), "sha256", "left_anti")
        again = old.join(stale, "sha256", "left_semi").drop("model", "embedding").unionByName(fresh).withColumn("model", F.lit(model)).withColumn("embedding", embed(F.col("text")))
        chunks = kept.unionByName(again)
        sizes = again.groupBy("sha256").agg(F.count(F.lit(1)).alias("made"))
        versions = store.read(spark, "versions", by_source, base)
        number = base["number"] + 1
        new = work.where("outcome = 'new_version'").select("source_id", "sha256", F.lit(number).cast("long").alias("since"))
        every = versions.unionByName(new.withColumns({"superseded": F.lit(False), "n_chunks": F.lit(0).cast("long")})).join(sizes, "sha256", "left")
        order = Window.partitionBy("source_id").orderBy(F.desc("since"), F.desc("sha256"))
        every = every.withColumn("n_chunks", F.coalesce("made", "n_chunks")).withColumn("superseded", F.row_number().over(order) > 1)
        names = hashes.join(work.select("sha256"), "sha256", "left_anti").unionByName(work.select("sha256", "source_id", F.lit(model).alias("model")))
        store.publish(spark, base, {"chunks": (by_source, chunks), "versions": (by_source, every), "hashes": (by_hash, names)}, token)
        return counts
    finally:
        judged.unpersist()


def searchable(store: Store, spark: SparkSession, historical: bool = False, sources: DataFrame | None = None, jurisdiction: str | None = None) -> DataFrame:
    """Chunks with their versions: current ones, or all with ``historical``; with ``sources`` (source_id, jurisdiction) those of one jurisdiction, a hard filter."""
    base = store.manifest(spark)
    versions = store.read(spark, "versions", of=base).where(F.lit(historical) | ~F.col("superseded"))
    chunks = store.read(spark, "chunks", of=base).join(versions.select("source_id", "sha256", "superseded", "since"), ["source_id", "sha256"])
    if sources is not None:
        chunks = chunks.join(sources.select("source_id", "jurisdiction"), "source_id")
        chunks = chunks.where(F.col("jurisdiction") == jurisdiction) if jurisdiction else chunks
    return chunks
