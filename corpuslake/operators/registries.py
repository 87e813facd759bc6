"""Registries: their cites resolved to stored chunks, pointers for questions, listings; shelves of the catalogue."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.functions import text as T
from corpuslake.operators.retrieval import base

POINTERS, PREFIX, QUOTES, CHARS = 3, 32, 20_000, 20_000_000


def _folded(text: Column) -> Column:
    """Single blanks and no case: by way of capitals, so that an eszett equals the two letters that stand for it there; one sigma.

    Blanks are seen to in between: Spark drops capitals that are made small at once.
    """
    return F.translate(F.lower(T.flat(F.upper(text))), "ς", "σ")


def _blocks(needles: DataFrame) -> Iterator[pd.DataFrame]:
    """Rows (s, wanted, needle) in blocks of about CHARS characters and QUOTES rows."""
    n, chars = needles.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.char_length("needle")), F.lit(0))).first()
    parts = max(1, -(-n // QUOTES), -(-chars // CHARS))
    for k in range(parts):
        block = needles.where(F.pmod(F.xxhash64("s", "wanted", "needle"), F.lit(parts)) == k).toPandas()
        if len(block):
            yield block


def _first_holding(rows: DataFrame, needles: DataFrame) -> DataFrame:
    """``s, wanted, needle, k``: of the rows (s, wanted, other, chunk_id, flat) at a provision the first that holds a needle, those at the exact locator (``other`` false) before others.

    One automaton over the needles' first PREFIX characters reads each text once; a needle that begins there is compared as a whole. A task gives
    at most one row for each needle, however many texts hold it.
    """
    import ahocorasick

    parts = []
    for block in _blocks(needles):
        wanted = list(block[["s", "wanted", "needle"]].itertuples(index=False, name=None))

        def find(batches: Iterator[pd.DataFrame], wanted: list[tuple[str, str, str]] = wanted) -> Iterator[pd.DataFrame]:
            automaton, heads, best = ahocorasick.Automaton(), {}, {}
            for i, (s, at, needle) in enumerate(wanted):
                heads.setdefault(needle[:PREFIX], {}).setdefault((s, at), []).append(i)
            for head, held in heads.items():
                automaton.add_word(head, (len(head), held))
            automaton.make_automaton()
            for pdf in batches:
                for s, at, other, chunk, text in zip(pdf["s"], pdf["wanted"], pdf["other"], pdf["chunk_id"], pdf["flat"], strict=True):
                    for end, (n, held) in automaton.iter(text):
                        for i in held.get((s, at), ()):
                            if best.get(i, (True, chunk + 1)) > (other, chunk) and text.startswith(wanted[i][2], end + 1 - n):
                                best[i] = (other, chunk)
            yield pd.DataFrame([(*wanted[i], bool(other), chunk) for i, (other, chunk) in best.items()], columns=["s", "wanted", "needle", "other", "chunk_id"]).astype({"other": "bool", "chunk_id": "int64"})

        parts.append(rows.mapInPandas(find, "s string, wanted string, needle string, other boolean, chunk_id long"))
    found = reduce(DataFrame.union, parts) if parts else needles.limit(0).selectExpr("s", "wanted", "needle", "false as other", "0L as chunk_id")
    return found.groupBy("s", "wanted", "needle").agg(F.min(F.struct("other", "chunk_id")).alias("k"))


def resolve_cites(cites: DataFrame, chunks: DataFrame) -> DataFrame:
    """``cites`` (cite_id, source_id, locator, quote) with ``chunk_id`` and ``quoted``: of the chunks at the cite's base provision one that holds the quote, then one at the exact locator, then the first; null if there is none.

    Quotes are compared without case and with single blanks. Only chunks at a provision that some cite names are looked at, each once for all cites; texts are read where some cite of the provision has a quote.
    """
    asked = cites.select("cite_id", F.col("source_id").alias("s"), F.col("locator").alias("wanted"), F.coalesce(_folded(F.col("quote")), F.lit("")).alias("needle"))
    named = asked.groupBy("s", "wanted").agg(F.bool_or(F.col("needle") != "").alias("quoting"))
    rows = chunks.select("chunk_id", F.col("source_id").alias("s"), F.col("locator").alias("l"), F.explode(F.array_distinct(F.array("locator", base(F.col("locator"))))).alias("wanted"), "text")
    at = rows.join(named, ["s", "wanted"]).withColumn("other", F.col("l") != F.col("wanted"))
    place = at.groupBy("s", "wanted").agg(F.min(F.struct("other", "chunk_id")).alias("first"))
    needles = asked.where("needle != ''").select("s", "wanted", "needle").distinct()
    best = _first_holding(at.where("quoting and text is not null").select("s", "wanted", "other", "chunk_id", _folded(F.col("text")).alias("flat")), needles)
    found = asked.join(best, ["s", "wanted", "needle"], "left").join(place, ["s", "wanted"], "left")
    out = found.select("cite_id", F.coalesce("k.chunk_id", "first.chunk_id").alias("chunk_id"), F.col("k").isNotNull().alias("quoted"))
    return cites.join(out, "cite_id")


def pointers(questions: DataFrame, registries: DataFrame, k: int = POINTERS) -> DataFrame:
    """``query_id, registry_id, place``: the first ``k`` registries by name (registry_id, name, regimes, chunk_id) that share a regime with a question (query_id, regimes) and have a resolved cite."""
    named = registries.where("chunk_id is not null").select("registry_id", "name", F.explode("regimes").alias("regime"))
    heads = named.withColumn("at", F.row_number().over(Window.partitionBy("regime").orderBy("name", "registry_id"))).where(F.col("at") <= k).drop("at")
    found = questions.select("query_id", F.explode("regimes").alias("regime")).join(heads, "regime").select("query_id", "registry_id", "name").distinct()
    return found.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("name", "registry_id"))).where(F.col("place") <= k).select("query_id", "registry_id", "place")


def listing(registries: DataFrame, chunks: DataFrame, regime: str | None = None, jurisdiction: str | None = None) -> DataFrame:
    """Registries with the source and locator of their cite; an unresolved cite keeps its registry."""
    rows = registries.where(F.array_contains("regimes", regime)) if regime else registries
    rows = rows.where(F.col("jurisdiction") == jurisdiction) if jurisdiction else rows
    at = chunks.select("chunk_id", F.col("source_id").alias("cite_source"), F.col("locator").alias("cite_locator"))
    return rows.join(at, "chunk_id", "left")


def shelfmates(items: DataFrame) -> DataFrame:
    """``item_id, shelf, mates``: an item's shelf and how many others stand on it. Mates are the shelf's members; pairs aren't spelled out."""
    counts = items.groupBy("shelf").agg((F.count(F.lit(1)) - 1).alias("mates"))
    return items.join(counts, "shelf").select("item_id", "shelf", "mates")
