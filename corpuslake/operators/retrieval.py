"""Batch retrieval: fusion of ranked lists, one hit a locator, reranking, slots for graph hits, recall."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.functions import text as T
from corpuslake.operators import blocks as K
from corpuslake.operators.models import Encoder
from corpuslake.operators.postings import Index
from corpuslake.sources.files import staged

RRF_K, CANDIDATES, SHOWN = 60, 40, 8


def top(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query; ties by id. Spark cuts each task's rows to k before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def fuse(lists: dict[str, DataFrame], within: tuple[str, ...] = ()) -> DataFrame:
    """Reciprocal rank fusion: ``query_id, <within>, chunk_id, score, first, <a flag for each list>``; ``first`` (list, rank) breaks ties."""
    keys = ["query_id", *within, "chunk_id"]
    marked = [df.select(*keys, "rank", F.lit(i).alias("list")) for i, df in enumerate(lists.values())]
    flags = [F.bool_or(F.col("list") == i).alias(name) for i, name in enumerate(lists)]
    return reduce(DataFrame.unionByName, marked).groupBy(*keys).agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 9).alias("score"), F.min(F.struct("list", "rank")).alias("first"), *flags)


def one_per_locator(hits: DataFrame, chunks: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """The best hit for each (query, source, locator), the k best of those."""
    placed = hits.join(chunks.select("chunk_id", "source_id", "locator"), "chunk_id")
    best = placed.withColumn("at", F.row_number().over(Window.partitionBy("query_id", "source_id", "locator").orderBy(F.desc("score"), "chunk_id"))).where("at = 1")
    return top(best.drop("at", "rank"), k)


def overlap(query: Column, passage: Column) -> Column:
    """The default pair score: the share of the query's words that the passage has."""
    q = T.words3(query)
    return F.round(F.size(F.array_intersect(q, T.words3(passage))) / F.greatest(F.size(q), F.lit(1)), 6)


def rerank(hits: DataFrame, within: tuple[str, ...] = (), k: int = SHOWN, score: Callable[[Column, Column], Column] = overlap) -> DataFrame:
    """``hits`` (query_id, <within>, query, passage, locator, pos) by pair score, those that the query names (``locator``) on top, ties by
    ``pos``; ``place`` is the new order. ``score`` may be any function of two columns, a pandas UDF of a model too."""
    scored = hits.withColumn("rerank", score(F.col("query"), F.col("passage")))
    order = Window.partitionBy("query_id", *within).orderBy(F.desc("locator"), F.desc_nulls_last("rerank"), "pos")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def reserve_graph_slots(ranked: DataFrame, within: tuple[str, ...] = (), k: int = SHOWN, slots: int = 2, ratio: float = 0.1) -> DataFrame:
    """The first ``k`` of ``ranked`` (query_id, <within>, place, chunk_id, graph, locator, rerank), up to two of them open to graph hits from
    further down. Each takes the place of the weakest hit that is neither a graph nor a named one, unless it scores under ``ratio`` of it; a hit
    without a score gives way. A query has a bounded number of candidates, so its list is one row."""
    if slots != 2:
        raise ValueError("two slots are what the closed form covers")
    keys = ["query_id", *within]
    one = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "chunk_id", "graph", "locator", "rerank"))).alias("all"))
    one = one.select(*keys, F.filter("all", lambda x: x["place"] <= k).alias("head"), F.filter("all", lambda x: (x["place"] > k) & x["graph"]).alias("late"))
    free = F.reverse(F.filter("head", lambda x: ~x["graph"] & ~x["locator"]))
    room = F.lit(slots) - F.size(F.filter("head", lambda x: x["graph"]))
    one = one.select(*keys, "head", *[F.when(room > i, F.get("late", F.lit(i))).alias(f"w{i + 1}") for i in range(2)], *[F.get(free, F.lit(i)).alias(f"e{i + 1}") for i in range(2)])
    beats = lambda w, e: w.isNotNull() & e.isNotNull() & ~F.coalesce(w["rerank"] < ratio * e["rerank"], F.lit(False))
    one = one.withColumn("t1", beats(F.col("w1"), F.col("e1")))
    one = one.withColumn("e2", F.when(F.col("t1"), F.col("e2")).otherwise(F.col("e1")))
    one = one.withColumn("t2", beats(F.col("w2"), F.col("e2")))
    given = F.transform("head", lambda h: F.struct(h["place"].alias("rank"), F.when(F.col("t1") & (h["place"] == F.col("e1.place")), F.col("w1.chunk_id")).when(F.col("t2") & (h["place"] == F.col("e2.place")), F.col("w2.chunk_id")).otherwise(h["chunk_id"]).alias("chunk_id")))
    return one.select(*keys, F.explode(given).alias("h")).select(*keys, "h.rank", "h.chunk_id")


def base(locator: Column) -> Column:
    """The provision that a finer locator belongs to: what precedes its first bracket."""
    return F.substring_index(locator, "(", 1)


def by_locator(queries: DataFrame, chunks: DataFrame, within: tuple[str, ...] = (), k: int = 10) -> DataFrame:
    """Chunks at the provisions that a question names, in the order named; after them, others of the same base provision by id.

    Only the first ``k`` chunks of a locator and of a base can be shown, so chunks at bases that some question names are cut to those before they meet a question.
    """
    wanted = staged(queries.select("query_id", *within, F.posexplode(T.locators(F.col("text"))).alias("at", "wanted")).withColumn("base", base(F.col("wanted"))), "wanted")
    narrow = chunks.select(*within, "chunk_id", "locator", base(F.col("locator")).alias("base")).join(wanted.select("base").distinct(), "base", "left_semi")
    first = lambda c: F.row_number().over(Window.partitionBy(*within, c).orderBy("chunk_id"))
    heads = narrow.withColumn("n", first("locator")).where(F.col("n") <= k).drop("n").union(narrow.withColumn("n", first("base")).where(F.col("n") <= k).drop("n")).distinct()
    found = wanted.join(heads, [*within, "base"]).groupBy("query_id", *within, "chunk_id").agg(F.min(F.when(F.col("wanted") == F.col("locator"), F.col("at"))).alias("at"))
    order = Window.partitionBy("query_id", *within).orderBy(F.asc_nulls_last("at"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", *within, "chunk_id", "rank")


def hybrid(queries: DataFrame, chunks: DataFrame, graph: DataFrame, index: Index | None = None, k: int = SHOWN, candidates: int = CANDIDATES, load: Callable[[], Encoder] | None = None) -> DataFrame:
    """``query_id, jurisdiction, rank, chunk_id``: the best ``k`` chunks for each (query, jurisdiction); jurisdictions never mix.

    ``queries``: query_id, jurisdiction, text, regimes, embedding, model. ``chunks``: chunk_id, jurisdiction, source_id, locator, regimes, header,
    text, model, and embedding, unless ``load`` gives the model that reads their texts. ``graph``: query_id, jurisdiction, chunk_id, rank, the list of the knowledge graph. ``index``: the chunks' words within jurisdictions; without one they are
    read once for the words asked. The dense, lexical, locator and graph
    lists are fused, a shared regime adds what a tenth place is worth, one hit stays for each locator; the first ``candidates`` are reranked, and
    graph hits get their slots. Texts are joined to the few fused hits only.
    """
    within = ("jurisdiction",)
    lists = {
        "dense": K.cosine(queries, chunks, ("model", "jurisdiction"), candidates, load), "lexical": index.search(queries, candidates) if index else K.bm25(queries, chunks, within, candidates),
        "locator": by_locator(queries, chunks, within), "graph": graph,
    }
    asked = queries.select("query_id", "jurisdiction", F.col("text").alias("query"), F.col("regimes").alias("asked"))
    about = chunks.select("chunk_id", "source_id", F.col("locator").alias("provision"), "regimes", F.concat("header", F.lit("\n"), "text").alias("passage"))
    fused = staged(fuse(lists, within), "fused")  # its size is known then, so few hits go to the chunks and no text is moved
    hits = about.join(fused, "chunk_id").join(asked, ["query_id", "jurisdiction"])
    hits = hits.withColumn("score", F.round(F.col("score") + F.when(F.arrays_overlap("regimes", "asked"), 1.0 / (RRF_K + 10)).otherwise(0.0), 9))
    order = lambda *by: F.row_number().over(Window.partitionBy("query_id", "jurisdiction", *by).orderBy(F.desc("score"), "first", "chunk_id"))
    cut = hits.withColumn("at", order("source_id", "provision")).where("at = 1").withColumn("pos", order()).where(F.col("pos") <= candidates)
    return reserve_graph_slots(rerank(cut, within, candidates), within, k)


def recall(hits: DataFrame, relevant: DataFrame, k: int = SHOWN) -> DataFrame:
    """The share of queries that have, for every jurisdiction expected (``relevant``: query_id, jurisdiction, doc_id), a relevant document among that jurisdiction's first k hits."""
    keys = ["query_id", "jurisdiction"]
    shown = hits.where(F.col("rank") <= k).select(*keys, "doc_id").distinct().withColumn("hit", F.lit(True))
    per = relevant.join(shown, [*keys, "doc_id"], "left").groupBy(*keys).agg(F.bool_or(F.coalesce("hit", F.lit(False))).alias("hit"))
    return per.groupBy("query_id").agg(F.bool_and("hit").alias("hit")).agg(F.round(F.avg(F.col("hit").cast("double")), 6).alias("recall"))
