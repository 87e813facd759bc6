"""The knowledge graph: entities that a question touches, and the chunks that their edges cite."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.operators.retrieval import base

LINKED, PER_EDGE, SHOWN = 6, 2, 8


def link_entities(questions: DataFrame, entities: DataFrame, k: int = LINKED) -> DataFrame:
    """``query_id, ref, place``: the entities (ref, aliases) one of whose aliases stands in the question (query_id, text) on word borders.

    An entity's evidence is the length of its first alias that does, longest first, then the later ref. The entities are a
    curated dimension; one automaton of their aliases reads each question once. Null texts link nothing.
    """
    import ahocorasick

    known = entities.select("ref", "aliases").collect()

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = ahocorasick.Automaton()
        for alias in {a.lower() for e in known for a in e["aliases"] or [] if a}:
            automaton.add_word(alias, alias)
        automaton.make_automaton()
        border = lambda c: not (c.isalnum() or c in "_-")
        for pdf in batches:
            rows = []
            for query, text in zip(pdf["query_id"], pdf["text"], strict=True):
                low = f" {text.lower()} "
                held = {a for end, a in automaton.iter(low) if border(low[end - len(a)]) and border(low[end + 1])} if len(automaton) else set()
                hits = [(len(first), e["ref"]) for e in known if (first := next((a for a in e["aliases"] or [] if a.lower() in held), None))]
                rows += [(query, ref, place) for place, (_, ref) in enumerate(sorted(hits, reverse=True)[:k], 1)]
            yield pd.DataFrame(rows, columns=["query_id", "ref", "place"]).astype({"query_id": "int64", "place": "int64"})

    return questions.where("text is not null").select("query_id", "text").mapInPandas(find, "query_id long, ref string, place long")


def graph_chunks(links: DataFrame, edges: DataFrame, chunks: DataFrame, k: int = SHOWN) -> DataFrame:
    """``query_id, jurisdiction, chunk_id, rank``: what the edges (edge_id, subject, object, cite_source, cite_locator) of a query's entities (query_id, ref) cite.

    An edge gives its first two chunks at its locator's base provision, or of its whole source if it names none; a chunk
    counts once, for the first edge; ``k`` chunks a query. As many for each entity are enough, so entities
    are cut to them before they meet queries, however many edges one has.
    """
    narrow = chunks.select("jurisdiction", F.col("source_id").alias("cite_source"), base(F.col("locator")).alias("base"), "chunk_id")
    nth = lambda *by: F.row_number().over(Window.partitionBy("jurisdiction", "cite_source", *by).orderBy("chunk_id"))
    at = narrow.withColumn("n", nth("base")).where(F.col("n") <= PER_EDGE)
    opening = narrow.withColumn("n", nth()).where(F.col("n") <= PER_EDGE).drop("base")
    cited = edges.where("cite_source is not null").withColumn("base", base(F.col("cite_locator")))
    shown = cited.where("base is not null").join(at, ["cite_source", "base"]).select("edge_id", "jurisdiction", "n", "chunk_id")
    shown = shown.union(cited.where("base is null").join(opening, "cite_source").select("edge_id", "jurisdiction", "n", "chunk_id"))
    sides = edges.select("edge_id", F.explode(F.array_distinct(F.array("subject", "object"))).alias("ref"))

    def first(rows: DataFrame, key: str) -> DataFrame:
        once = rows.groupBy(key, "jurisdiction", "chunk_id").agg(F.min(F.struct("edge_id", "n")).alias("by"))
        order = Window.partitionBy(key, "jurisdiction").orderBy("by", "chunk_id")
        return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    per_entity = first(sides.join(shown, "edge_id"), "ref").select("ref", "jurisdiction", "chunk_id", "by.edge_id", "by.n")
    return first(links.select("query_id", "ref").join(per_entity, "ref"), "query_id").select("query_id", "jurisdiction", "chunk_id", "rank")
