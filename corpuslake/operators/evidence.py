"""Clauses, printed rows, citation markers, routing and the choice of documents that an answer may use."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that route a question to a regime, and words that name a kind of material.
REGIME_WORDS = {
    "patent": ["patent", "invention", "prior art", "tkdl", "3(p)", "novelty", "pct"],
    "gi": ["geographical indication", " gi ", "gi tag", "gi registry"],
    "trademark": ["trade mark", "trademark", "brand", "logo name"],
    "copyright": ["copyright", "book", "text of", "manuscript"],
    "design": ["design registration", "packaging design", "industrial design"],
    "trade_secret": ["trade secret", "confidential", "secret formula", "know-how"],
    "pvp": ["plant variety", "farmers' rights", "farmers rights", "ppvfr", "seed variety"],
    "abs": ["biodiversity", "benefit sharing", "nba", "state biodiversity board", "nagoya", "access and benefit", "biological resource"],
    "drug_licensing": ["licence", "license", "classical", "proprietary", "ayush", "asu drug", "phytopharmaceutical", "new drug", "clinical trial", "rule 158"],
    "advertising": ["advertis", "claim", "magic remed", "promotion"],
    "labelling": ["label", "packaging", "pack"],
    "food": ["fssai", "aahar", "nutraceutical", "food", "supplement"],
    "cosmetic": ["cosmetic", "skin care", "shampoo", "soap"],
    "treaty": ["trips", "treaty", "wipo", "convention", "gratk", "budapest"],
    "market_access": ["export", "eu ", "europe", "usfda", "fda", "canada", "australia", "uk "],
    "wildlife": ["wildlife", "cites", "musk", "animal part", "coral", "shankha"],
}
MATERIAL_WORDS = {
    "microbe": ["microbe", "micro-organism", "microorganism", "bacteria", "yeast", "strain", "ferment", "probiotic", "fungus", "culture"],
    "animal": ["honey", "ghee", "milk", "pearl", "conch", "coral", "musk", "animal", "shilajit"],
    "mineral": ["bhasma", "mineral", "metal", "mercury", "gold", "iron", "mica", "rasa"],
    "plant": ["plant", "herb", "leaf", "root", "bark", "seed", "flower", "fruit", "extract"],
}
# Rank of a document type, 0 the most binding; types that aren't listed have 5.
AUTHORITY = {"statute": 0, "treaty": 0, "rules": 1, "regulations": 1, "regulation": 1, "notification": 2, "registry_record": 2, "case_law": 2, "monograph": 3, "manual": 4, "guideline": 4}
# Clause and paragraph starts, and citation markers as answers carry them.
CLAUSE = r"^(?:\d{1,3}\[\s*)?\(([a-z]{1,4}|\d{1,3}[A-Z]?)\)\s"
PARAGRAPH = r"^(\d{1,2})\.$"
MARKER = r'(?s)(?:\[\[|【)\s*(?:c:)?([^|\]】]+?)\s*\|\s*["“](.*?)["”]\s*(?:\]{1,2}|】)'
TITLE_LEAST, TERMS, PRIMARY_KEPT, SHOWN = 2, 6, 4, 8


def row_lines(words: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Printed rows from ``page, x, y, word``: words whose heights round to one step form a row, read left to right."""
    row = F.bround(F.col("y") / tolerance).cast("long").alias("row")
    in_order = F.array_sort(F.collect_list(F.struct("x", "word")))
    return words.groupBy("page", row).agg(F.array_join(F.transform(in_order, lambda w: w["word"]), " ").alias("line"))


def page_lines(pages: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """``row_lines`` of pages that come as one row each, ``page, words`` (an array of x, y, word). Words are ordered by row where they are, so none of them moves."""
    placed = F.transform("words", lambda w: F.struct(F.bround(w["y"] / tolerance).cast("long").alias("row"), w["x"].alias("x"), w["word"].alias("word")))
    rows = pages.where(F.size("words") > 0).select("page", F.array_sort(placed).alias("words"))
    opens = lambda i: (i == 0) | ~F.get("words", i)["row"].eqNullSafe(F.get("words", i - 1)["row"])
    rows = rows.withColumn("starts", F.filter(F.sequence(F.lit(0), F.size("words") - 1), opens))
    words = lambda s, i: F.slice("words", s + 1, F.coalesce(F.get("starts", i + 1), F.size("words")) - s)
    line = lambda s, i: F.struct(F.get("words", s)["row"].alias("row"), F.array_join(F.transform(words(s, i), lambda w: w["word"]), " ").alias("line"))
    return rows.select("page", F.explode(F.transform("starts", line)).alias("r")).select("page", "r.*")


def skip_to(lines: Column, first: Column) -> Column:
    """The lines from the first one that equals ``first``; null if there is none."""
    at = F.array_position(lines, first)
    return F.when(at > 0, F.slice(lines, at.cast("int"), F.greatest(F.size(lines) - at + 1, F.lit(1)).cast("int")))


def clauses(lines: DataFrame) -> DataFrame:
    """Pieces of ``unit, k, line``: a line that begins a clause or paragraph opens one; what precedes has an empty id."""
    found = lines.withColumn("id", F.greatest(F.regexp_extract("line", CLAUSE, 1), F.regexp_extract("line", PARAGRAPH, 1)))
    piece = F.sum((F.col("id") != "").cast("int")).over(Window.partitionBy("unit").orderBy("k"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n")
    return found.withColumn("piece", piece).groupBy("unit", "piece").agg(F.max("id").alias("clause_id"), F.count(F.lit(1)).alias("n_lines"), text.alias("text"))


def clause_locator(base: Column, first: Column, last: Column, pieces: Column) -> Column:
    """``base`` with its first and last clause; articles take a point, others brackets."""
    form = lambda i: F.when(base.startswith("Art."), F.concat(F.lit("."), i)).otherwise(F.concat(F.lit("("), i, F.lit(")")))
    return F.when(pieces == 0, base).when(pieces == 1, F.concat(base, form(first))).otherwise(F.concat(base, form(first), F.lit("–"), form(last)))


def prose(answer: Column) -> Column:
    """The answer without citation markers, and without the blanks that they leave."""
    bare = F.regexp_replace(F.regexp_replace(answer, MARKER, ""), r"[ \t]+([.,;:])", "$1")
    return F.regexp_replace(F.regexp_replace(bare, r"[ \t]{2,}", " "), r"^[ \t\n\r\f]+|[ \t\n\r\f]+$", "")


def citations(answers: DataFrame, key: str, text: str) -> DataFrame:
    """One row for each marker: its place, the cited id and the quoted span."""
    ids, spans = (F.regexp_extract_all(text, F.lit(MARKER), F.lit(i)) for i in (1, 2))
    each = answers.select(key, F.posexplode(F.arrays_zip(ids.alias("id"), spans.alias("span"))).alias("at", "c"))
    return each.select(key, "at", F.trim("c.id").alias("cited"), F.col("c.span").alias("span"))


def padded(question: Column) -> Column:
    return F.concat(F.lit(" "), F.lower(question), F.lit(" "))


def routed(low: Column, table: dict[str, list[str]] = REGIME_WORDS) -> Column:
    """Keys of ``table`` of whose words a ``padded`` question holds one, in the table's order. Give a column of its own, so that it's made once."""
    named = [F.when(reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in words]), F.lit(r)) for r, words in table.items()]
    return F.array_compact(F.array(*named))


def search_query(names: Column) -> Column:
    """Up to six names joined by OR: split, bracketed parts dropped, Latin script only, one spelling (the last) each."""
    parts = F.flatten(F.transform(names, lambda n: F.split(n, "[,/;]")))
    clean = F.filter(F.transform(parts, lambda n: F.trim(F.regexp_replace(n, r"\(.*?\)", ""))), lambda n: (F.char_length(n) > TITLE_LEAST) & n.rlike(r"^[A-Za-z][A-Za-z .'-]*$"))
    keys = F.slice(F.array_distinct(F.transform(clean, F.lower)), 1, TERMS)
    spelt = F.transform(keys, lambda k: F.element_at(F.filter(clean, lambda n: F.lower(n) == k), -1))
    return F.array_join(F.transform(spelt, lambda n: F.when(n.rlike(r"\s"), F.concat(F.lit('"'), n, F.lit('"'))).otherwise(n)), " OR ")


def authority(doc_type: Column) -> Column:
    return reduce(lambda step, kv: step.when(doc_type == kv[0], kv[1]), AUTHORITY.items(), F.when(F.lit(False), 5)).otherwise(5)


def select_documents(hits: DataFrame, k: int = SHOWN) -> DataFrame:
    """From ``query_id, rank, named, authority``: every named hit, the best four of primary law, others up to ``k`` in all, ordered by authority."""
    kind = F.when(F.col("named"), 0).when(F.col("authority") <= 1, 1).otherwise(2)
    placed = hits.withColumn("kind", kind).withColumn("at", F.row_number().over(Window.partitionBy("query_id", "kind").orderBy("rank")))
    first = (F.col("kind") == 0) | ((F.col("kind") == 1) & (F.col("at") <= PRIMARY_KEPT))
    sure = placed.withColumn("kind", F.when(first, F.col("kind")).otherwise(2)).withColumn("n_sure", F.count_if(F.col("kind") < 2).over(Window.partitionBy("query_id")))
    fill = sure.withColumn("at", F.row_number().over(Window.partitionBy("query_id", "kind").orderBy("rank"))).where("kind < 2 or at <= greatest(0, {} - n_sure)".format(k))
    return fill.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("authority", "kind", "rank"))).select("query_id", "rank", "position")


def abs_route(resource: Column, foreign: Column, traded: Column, patent: Column) -> Column:
    """A route, or the question to ask next; the last two questions don't matter without a resource."""
    unasked = F.when(foreign.isNull(), "ask foreign").when(resource.isNull(), "ask indian_bioresource")
    unasked = unasked.when(resource & traded.isNull(), "ask normally_traded").when(resource & patent.isNull(), "ask patent_intended")
    return unasked.when(~resource, "not_applicable").when(traded, "exempt_check").when(foreign, "nba_approval").otherwise("sbb_intimation")


def near_locators(missing: DataFrame, chunks: DataFrame, k: int = 6) -> DataFrame:
    """For each ``item_id, doc_id`` the first ``k`` locators that its document has; null if it has none."""
    order = Window.partitionBy("item_id").orderBy("chunk_id")
    near = missing.join(chunks.select("doc_id", "chunk_id", F.col("locator").alias("has")), "doc_id").withColumn("at", F.row_number().over(order)).where(F.col("at") <= k)
    listed = near.groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "has"))), lambda x: x["has"]), ",").alias("suggestions"))
    return missing.join(listed, "item_id", "left")
