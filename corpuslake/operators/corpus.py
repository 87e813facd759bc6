"""Corpus jobs: versions, structure, graph, integrity, evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TARGET, LONGEST = 2400, 3200


def superseded(versions: DataFrame) -> DataFrame:
    """All but the latest version of each source are superseded."""
    order = Window.partitionBy("source_id").orderBy(F.desc("first_doc"), F.desc("sha256"))
    return versions.withColumn("superseded", F.row_number().over(order) > 1)


def upsert_outcome(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """new_version, rechunked (asked for), re_embedded (another model, or none) or unchanged for each incoming (source_id, sha256, model, rechunk); versions are known by hash alone."""
    old = stored.groupBy("sha256").agg(F.min("model").alias("old_model"), F.lit(True).alias("known"))
    other = F.col("old_model").isNull() | (F.col("old_model") != F.col("model"))
    outcome = F.when(F.col("known").isNull(), "new_version").when(F.col("rechunk"), "rechunked").when(other, "re_embedded").otherwise("unchanged")
    return incoming.join(old, "sha256", "left").select("source_id", "sha256", outcome.alias("outcome"))


def seed_graph(entities: DataFrame, edges: DataFrame, stored_entities: DataFrame, stored_edges: DataFrame) -> DataFrame:
    """``what, n``: what an idempotent seeding of entities (name) and edges (subject, predicate, object) adds to the stored ones, and edges left out because an end is unknown."""
    keys = ["subject", "predicate", "object"]
    known = entities.select("name").union(stored_entities.select("name")).distinct()
    unknown = unresolved_edges(edges.select(*keys), known)
    fresh = edges.select(*keys).distinct().join(unknown, keys, "left_anti").join(stored_edges.select(*keys), keys, "left_anti")
    count = lambda rows, what: rows.agg(F.lit(what).alias("what"), F.count(F.lit(1)).alias("n"))
    added = entities.select("name").distinct().join(stored_entities.select("name"), "name", "left_anti")
    return count(added, "new entities").union(count(fresh, "new edges")).union(count(unknown, "unknown ends"))


def corpus_version(versions: DataFrame) -> DataFrame:
    return versions.where("not superseded").agg(F.coalesce(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), ""), 256), 1, 12), F.lit("empty")).alias("corpus_version"))


def pack_chunks(lines: DataFrame, target: int = TARGET) -> DataFrame:
    """Greedy packing of a unit's lines (unit, k, n_chars) into chunks of at most ``target`` characters: ``unit, k, chunk_no``.

    The fold is an ordered one over a unit's lines that holds one batch of rows, however long a unit is; units are independent, so one shuffle does.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, used, no, first = None, 0, 0, True
        for batch in batches:
            out = []
            for now, n in zip(batch["unit"].to_pylist(), batch["n_chars"].to_pylist(), strict=True):
                if first or now != unit:
                    unit, used, no, first = now, 0, 0, False
                if used > 0 and used + (n or 0) > target:
                    used, no = 0, no + 1
                used += n or 0
                out.append(no)
            yield pa.RecordBatch.from_arrays([batch["unit"], batch["k"], pa.array(out, pa.int32())], ["unit", "k", "chunk_no"])

    rows = lines.select("unit", F.col("k").cast("int").alias("k"), F.col("n_chars").cast("long").alias("n_chars"))
    schema = T.StructType([rows.schema["unit"], rows.schema["k"], T.StructField("chunk_no", T.IntegerType())])
    return rows.repartition("unit").sortWithinPartitions("unit", "k", "n_chars").mapInArrow(fold, schema)


def sections(lines: DataFrame) -> DataFrame:
    """Units of lines (doc_id, line_no, line): a heading ``N. Title.—`` opens one. ``doc_id, unit, num, title, n_lines``."""
    heading = r"^(\d{1,4}[A-Z]{0,3})\. (.{3,120}?)\.—"
    order = Window.partitionBy("doc_id").orderBy("line_no")
    marked = lines.withColumn("head", F.col("line").rlike(heading)).withColumn("unit", F.sum(F.col("head").cast("int")).over(order)).where("unit > 0")
    first = F.min_by(F.col("line"), F.col("line_no"))
    return marked.groupBy("doc_id", "unit").agg(first.alias("first"), F.count(F.lit(1)).alias("n_lines")).select("doc_id", "unit", F.regexp_extract("first", heading, 1).alias("num"), F.regexp_extract("first", heading, 2).alias("title"), "n_lines")


def kwic(chunks: DataFrame, phrase: str, before: int = 100, after: int = 300) -> DataFrame:
    at = F.locate(phrase, "text")
    return chunks.where(at > 0).select("chunk_id", F.substring(F.col("text"), F.greatest(at - before, F.lit(1)), at - F.greatest(at - before, F.lit(1)) + after).alias("context"))


def edges_of(edges: DataFrame, refs: DataFrame) -> DataFrame:
    """Edges that touch one of ``refs`` (ref) either way: two equi-joins, not an OR."""
    return edges.join(refs, F.col("subject") == F.col("ref"), "left_semi").union(edges.join(refs, F.col("object") == F.col("ref"), "left_semi")).distinct()


def neighbourhood(edges: DataFrame) -> DataFrame:
    """``entity, edge``: every entity with its labelled neighbours, one row an edge, so a hub is many rows and never one."""
    one = edges.select(F.col("subject").alias("entity"), F.concat("predicate", F.lit(" "), "object").alias("edge"))
    return one.union(edges.select(F.col("object").alias("entity"), F.concat("predicate", F.lit(" of "), "subject").alias("edge"))).distinct()


def unresolved_edges(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges whose subject or object is no entity (name)."""
    known = entities.select("name").distinct()
    return edges.join(known, F.col("subject") == F.col("name"), "left_anti").union(edges.join(known, F.col("object") == F.col("name"), "left_anti")).distinct()


def chrf(pairs: DataFrame, n: int = 6, beta: float = 2.0) -> DataFrame:
    """``pair_id, chrf``: character n-gram F-score of (pair_id, hyp, ref), blanks removed, precision and recall averaged over 1 to ``n``; 0 if a side is empty."""
    bare = pairs.select("pair_id", *[F.regexp_replace(c, r"\s+", "").alias(c) for c in ("hyp", "ref")])

    def counts(c: str, name: str) -> DataFrame:
        size = F.char_length(c)
        each = bare.select("pair_id", c, F.explode(F.sequence(F.lit(1), F.lit(n))).alias("k")).where(size >= F.col("k"))
        grams = each.select("pair_id", "k", F.explode(F.transform(F.sequence(F.lit(1), size - F.col("k") + 1), lambda i: F.substring(F.col(c), i, F.col("k")))).alias("g"))
        return grams.groupBy("pair_id", "k", "g").agg(F.count(F.lit(1)).alias(name))

    both = counts("hyp", "h").join(counts("ref", "r"), ["pair_id", "k", "g"], "full_outer").fillna(0, ["h", "r"])
    per = both.groupBy("pair_id", "k").agg(F.sum(F.least("h", "r")).alias("m"), F.sum("h").alias("h"), F.sum("r").alias("r"))
    mean = per.groupBy("pair_id").agg(F.avg(F.when(F.col("h") > 0, F.col("m") / F.col("h"))).alias("p"), F.avg(F.when(F.col("r") > 0, F.col("m") / F.col("r"))).alias("q"))
    score = F.when(F.coalesce(F.col("p") + F.col("q"), F.lit(0.0)) > 0, (1 + beta**2) * F.col("p") * F.col("q") / (beta**2 * F.col("p") + F.col("q"))).otherwise(0.0)
    return pairs.select("pair_id").join(mean, "pair_id", "left").select("pair_id", F.round(score, 6).alias("chrf"))
