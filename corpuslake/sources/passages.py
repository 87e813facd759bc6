"""Driver tables as a legal corpus: passages with provisions, regimes and vectors, questions about them, entities, cited edges, drafts of answers.

The tables have no such columns, so they are derived by rule from ids, and every one of them grows with its table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.operators import evidence as E
from corpuslake.operators import models as M
from corpuslake.sources.views import LINE_IDS, table

DOC_TYPES = ("statute", "rules", "notification", "monograph", "manual", "leaflet")
REGIMES, KINDS = tuple(E.REGIME_WORDS), tuple(E.MATERIAL_WORDS)
ASKS = ("", " See section 2(a) and Art. 4.", " Is a patent or a seed variety open under Rule 7?", " Does the food rule on milk and ghee apply?", " What of a trade mark under s. 5?")
MODEL = "hash-64"


def pick(values: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


def passages(spark: SparkSession, sf_dir: str, first: int | None = None) -> DataFrame:
    """Every non-blank line of ``documents``; articles, sections, clause ranges and rules take turns. ``first``: of each document's first so many lines only, without a look at others."""
    split = F.split("text", "\n") if first is None else F.slice(F.split("text", "\n", first + 1), 1, first)
    lines = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("source_id"), "lang", F.posexplode(split).alias("at", "text")).where(F.trim("text") != "")
    i = (F.col("at") + 1).cast("string")
    kind = F.col("at") % 4
    locator = F.when(kind == 3, F.concat(F.lit("Art. "), i)).when(kind == 0, F.concat(F.lit("s."), i)).when(kind == 1, F.concat(F.lit("s."), i, F.lit("(a)–(c)"))).otherwise(F.concat(F.lit("Rule "), i))
    doc_type = pick(DOC_TYPES, F.col("doc_id"))
    return lines.select(
        (F.col("doc_id") * LINE_IDS + F.col("at") + 1).alias("chunk_id"), "doc_id", F.when(F.col("lang") == "en", "IN").otherwise("INTL").alias("jurisdiction"), "source_id", locator.alias("locator"),
        F.array(pick(REGIMES, F.col("doc_id"))).alias("regimes"), doc_type.alias("doc_type"), F.concat_ws(" — ", F.concat_ws(" ", doc_type, "source_id"), locator).alias("header"), "text",
    )


def embedded(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("embedding", M.embedding(F.col("text"))).withColumn("model", F.lit(MODEL))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``benchmark`` passages with a question after them, asked of both jurisdictions."""
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat("text", pick(ASKS, F.col("item_id"))).alias("text"))
    known = rows.withColumn("low", E.padded(F.col("text"))).select("query_id", "text", E.routed(F.col("low")).alias("regimes"))
    return embedded(known).select("query_id", F.explode(F.array(F.lit("IN"), F.lit("INTL"))).alias("jurisdiction"), "text", "regimes", "embedding", "model")


def entities(spark: SparkSession) -> DataFrame:
    """Regimes and kinds of material with the words that name them."""
    rows = [(f"regime:{k}", [w.strip() for w in words]) for k, words in E.REGIME_WORDS.items()] + [(f"material:{k}", words) for k, words in E.MATERIAL_WORDS.items()]
    return spark.createDataFrame(rows, "ref string, aliases array<string>")


def cited_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One edge for each document: its regime governs a kind of material, by a provision of its source or the whole of it."""
    d = F.col("doc_id")
    locator = F.when(d % 3 == 1, F.concat(F.lit("s."), (d % 7 + 1).cast("string"))).when(d % 3 == 2, F.concat(F.lit("Art. "), (d % 5 * 4).cast("string")))
    return table(spark, sf_dir, "documents").select(d.alias("edge_id"), F.concat(F.lit("regime:"), pick(REGIMES, d)).alias("subject"), pick(("governs", "exempts", "lists"), d).alias("predicate"), F.concat(F.lit("material:"), pick(KINDS, d)).alias("object"), F.col("source").alias("cite_source"), locator.alias("cite_locator"))


LEAKS = ("", "TRIPS and the PCT apply.", "The Patents Act and FSSAI apply.", "The NBA decides.", "Nothing else does.")


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as drafted answers: the text, then provisions, a name of some jurisdiction's law, and an assertion."""
    d = F.col("doc_id")
    says = F.concat(F.lit(" Under section "), (d % 9 + 1).cast("string"), F.lit(" and Rule "), (d % 4 * 3).cast("string"), F.lit(" approval is required.\n\n"), pick(LEAKS, d), F.lit("\n\nA licence must be held."))
    return table(spark, sf_dir, "documents").select(d.alias("answer_id"), F.when(F.col("lang") == "en", "IN").otherwise("INTL").alias("jurisdiction"), F.concat("text", says).alias("markdown"))


def retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was retrieved for an answer: the first five lines of its document, and the first line of the next one."""
    line = F.col("chunk_id") % LINE_IDS
    shown = lambda first: passages(spark, sf_dir, first).select("doc_id", line.alias("line"), "chunk_id", "jurisdiction", "source_id", "locator", "header", "text")
    own, after = shown(5), shown(1)
    return own.select(F.col("doc_id").alias("answer_id"), F.col("line").alias("rank"), *own.columns[2:]).union(after.select((F.col("doc_id") - 1).alias("answer_id"), F.lit(9).cast("long").alias("rank"), *own.columns[2:]))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven citations of each document with a first line: right, of the next line, of what wasn't retrieved, repeated, of the next document, with an omission, invented."""
    rows = passages(spark, sf_dir, 2).select("doc_id", (F.col("chunk_id") % LINE_IDS).alias("line"), "chunk_id", "text")
    one, two = rows.where("line = 1"), rows.where("line = 2").select("doc_id", F.col("text").alias("second"))
    after = one.select((F.col("doc_id") - 1).alias("doc_id"), F.col("chunk_id").alias("next_id"), F.col("text").alias("next"))
    all_ = one.join(two, "doc_id", "left").join(after, "doc_id", "left")
    n = F.char_length("text")
    made = [(F.col("chunk_id"), F.col("text")), (F.col("chunk_id"), F.col("second")), (F.col("doc_id") * LINE_IDS + 99, F.lit("x")), (F.col("chunk_id"), F.col("text")), (F.col("next_id"), F.col("next"))]
    made += [(F.col("chunk_id"), F.concat(F.substring(F.col("text"), F.lit(1), F.floor(n / 3).cast("int")), F.lit("…"), F.substring(F.col("text"), F.floor(n / 2).cast("int"), n))), (F.col("chunk_id"), F.lit("words that nobody wrote here"))]
    each = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("pos"), c.alias("chunk_id"), q.alias("quote")) for i, (c, q) in enumerate(made, 1)]))
    return all_.select(F.col("doc_id").alias("answer_id"), each.alias("c")).select("answer_id", "c.*").where("chunk_id is not null and quote is not null")
