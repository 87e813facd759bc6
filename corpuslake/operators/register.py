"""The register of sources: nested versions for the catalogue, and where each source stands, with totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Where a source can stand.
INGESTED, NOT_INGESTED, MISSING, CHANGED = "ingested", "file present, not ingested", "missing", "raw file changed since ingest"


def source_catalogue(sources: DataFrame, versions: DataFrame, counts: DataFrame) -> DataFrame:
    """``source_id, versions``: each source with its versions (version, sha256, retrieved, superseded, n_chunks), newest first, then by hash.

    ``versions``: source_id, version, sha256, retrieved, superseded; ``counts``: sha256, n_chunks (0 where it has none). A source without versions has an empty list; its versions are one row.
    """
    each = versions.join(counts, "sha256", "left").select("source_id", F.struct("retrieved", "sha256", "version", "superseded", F.coalesce("n_chunks", F.lit(0)).cast("long").alias("n_chunks")).alias("v"))
    nested = each.groupBy("source_id").agg(F.sort_array(F.collect_list("v"), asc=False).alias("v"))
    shown = F.transform(F.coalesce("v", F.array().cast(nested.schema["v"].dataType)), lambda x: F.struct(*[x[c].alias(c) for c in ("version", "sha256", "retrieved", "superseded", "n_chunks")]))
    return sources.select("source_id").join(nested, "source_id", "left").select("source_id", shown.alias("versions"))


def standing(manifest: DataFrame, files: DataFrame, versions: DataFrame, counts: DataFrame) -> DataFrame:
    """``source_id, jurisdiction, status, sha256, n_chunks`` of every source of the manifest (source_id, jurisdiction): its version in force, and whether its file (source_id, sha256) is that version's."""
    current = versions.where("not superseded").join(counts, "sha256", "left").select("source_id", "sha256", F.coalesce("n_chunks", F.lit(0)).cast("long").alias("n_chunks"))
    rows = manifest.join(current, "source_id", "left").join(files.select("source_id", F.col("sha256").alias("filed")), "source_id", "left")
    status = F.when(F.col("sha256").isNotNull() & (F.col("filed") != F.col("sha256")), CHANGED).when(F.col("sha256").isNotNull(), INGESTED).when(F.col("filed").isNotNull(), NOT_INGESTED).otherwise(MISSING)
    return rows.select("source_id", "jurisdiction", status.alias("status"), "sha256", F.coalesce("n_chunks", F.lit(0).cast("long")).alias("n_chunks"))


def register(stands: DataFrame) -> DataFrame:
    """``level, jurisdiction, status, source_id, sha256, n_sources, n_chunks``: sources, then totals by jurisdiction and status, by jurisdiction and of all, from one pass of grouping sets."""
    sets = [["jurisdiction", "status", "source_id", "sha256"], ["jurisdiction", "status"], ["jurisdiction"], []]
    grouped = stands.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in sets[0]])
    level = F.when(F.grouping("source_id") == 0, "source").when(F.grouping("status") == 0, "status").when(F.grouping("jurisdiction") == 0, "jurisdiction").otherwise("all")
    return grouped.agg(level.alias("level"), F.count(F.lit(1)).alias("n_sources"), F.sum("n_chunks").alias("n_chunks")).select("level", *sets[0], "n_sources", "n_chunks")
