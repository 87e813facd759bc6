"""Checks of drafted answers against what was retrieved for them: citations, provisions, leaks, assertions, and the verdict over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.functions import passages as P
from corpuslake.functions import text as T

# Names of one jurisdiction's law that another's answer must not use without a source, and their long forms.
FOREIGN = {
    "IN": r"\b(TRIPS|WIPO|Nagoya|Convention on Biological Diversity|CBD|PCT|Patent Cooperation Treaty|Budapest Treaty|GRATK|Paris Convention|European Union|EU Directive|FDA|Health Canada|TGA|MHRA)\b",
    "INTL": r"\b(Patents Act|Biological Diversity Act|Drugs and Cosmetics|Trade Marks Act|Designs Act|Copyright Act|FSSAI|National Biodiversity Authority|NBA|CDSCO|AYUSH|Indian Patent Office|Controller of Patents)\b",
}
LONG_FORMS = {
    "PCT": "Patent Cooperation Treaty", "CBD": "Convention on Biological Diversity", "TRIPS": "Trade-Related Aspects of Intellectual Property",
    "NBA": "National Biodiversity Authority", "WIPO": "World Intellectual Property Organization",
}


def verify_citations(answers: DataFrame, citations: DataFrame, retrieved: DataFrame) -> DataFrame:
    """``answer_id, pos, outcome, chunk_id, verified`` for every citation (answer_id, pos, chunk_id, quote) but repeated ones.

    ``answers``: answer_id, jurisdiction. ``retrieved``: answer_id, rank, chunk_id, jurisdiction, text. A chunk that wasn't retrieved is unknown; a quote
    that its chunk hasn't is moved to the first other chunk of the answer's jurisdiction that has it, or not found; a chunk of
    another jurisdiction is a leak, whatever it says. An answer's retrieved list, which is bounded, is one row, so a text is brought into
    the form that is compared once, as is a quote, and neither meets the other by a join of its own.
    """
    shown = F.struct("rank", "chunk_id", F.col("jurisdiction").alias("of"), T.for_match(F.col("text")).alias("hay"))
    lists = retrieved.groupBy("answer_id").agg(F.array_sort(F.collect_list(shown)).alias("shown"))
    asked = citations.join(answers.select("answer_id", "jurisdiction"), "answer_id").join(lists, "answer_id", "left")
    again = F.row_number().over(Window.partitionBy("answer_id", "chunk_id", "quote").orderBy("pos")) > 1
    asked = asked.withColumn("again", again).withColumn("own", F.get(F.filter("shown", lambda x: (x["chunk_id"] == F.col("chunk_id")) & x["of"].isNotNull()), F.lit(0)))
    asked = asked.where("own is null or not again").withColumn("pieces", T.pieces(F.col("quote")))
    asked = asked.withColumn("holds", F.coalesce(T.held(F.col("pieces"), F.col("own.hay")), F.lit(False)))
    elsewhere = F.get(F.filter("shown", lambda x: (x["of"] == F.col("jurisdiction")) & T.held(F.col("pieces"), x["hay"])), F.lit(0))
    judged = asked.withColumn("there", F.when(F.col("own").isNotNull() & ~F.col("holds"), elsewhere["chunk_id"]))
    leak = (F.col("own.of") != F.col("jurisdiction")) & F.col("there").isNull()
    outcome = F.when(F.col("own").isNull(), "unknown").when(leak, "leak").when(F.col("holds"), "verified").when(F.col("there").isNotNull(), "moved").otherwise("not found")
    out = judged.select("answer_id", "pos", outcome.alias("outcome"), F.coalesce("there", "chunk_id").alias("chunk_id"))
    return out.withColumn("verified", F.col("outcome").isin("verified", "moved"))


def cited_texts(citations: DataFrame, retrieved: DataFrame) -> DataFrame:
    """``answer_id, locator, text`` (header and text) of every retrieved chunk that an answer cites."""
    return retrieved.join(citations.select("answer_id", "chunk_id").distinct(), ["answer_id", "chunk_id"], "left_semi").select("answer_id", "locator", F.concat_ws(" ", "header", "text").alias("text"))


def unbacked_provisions(answers: DataFrame, cited: DataFrame) -> DataFrame:
    """``answer_id, provision``: provisions that the prose (``markdown``) names and no cited chunk has."""
    own = F.upper(F.substring_index(F.substring_index(F.regexp_replace("locator", r"^\D+", ""), "(", 1), ".", 1))
    backed = cited.select("answer_id", F.explode(F.array_union(T.provisions(F.concat_ws(" ", "locator", "text")), F.array(own))).alias("provision")).distinct()
    return answers.select("answer_id", F.explode(T.provisions(F.col("markdown"))).alias("provision")).join(backed, ["answer_id", "provision"], "left_anti")


def jurisdiction_leaks(answers: DataFrame, cited: DataFrame) -> DataFrame:
    """``answer_id, term``: names of the other jurisdiction's law in the prose that no cited chunk holds, in short or long form."""
    pattern = F.lit(None).cast("string")
    for jurisdiction, terms in FOREIGN.items():
        pattern = F.when(F.col("jurisdiction") == jurisdiction, F.lit(terms)).otherwise(pattern)
    found = answers.withColumn("pattern", pattern).where("pattern is not null")
    named = found.select("answer_id", F.explode(F.array_distinct(F.regexp_extract_all("markdown", F.col("pattern"), F.lit(1)))).alias("term"))
    long_form = F.create_map(*[F.lit(x) for kv in LONG_FORMS.items() for x in kv])
    low = F.lower("text")
    sourced = named.join(cited, "answer_id").where(F.contains(low, F.lower("term")) | F.coalesce(F.contains(low, F.lower(F.try_element_at(long_form, F.col("term")))), F.lit(False)))
    return named.join(sourced.select("answer_id", "term").distinct(), ["answer_id", "term"], "left_anti")


def asserting_paragraphs(markdown: Column) -> Column:
    """How many paragraphs (between blank lines) assert a duty or permission."""
    return F.size(F.filter(F.split(markdown, r"\n\s*\n"), lambda p: p.rlike(P.ASSERTION))).cast("long")


def _tallied(verdicts: DataFrame) -> DataFrame:
    """``answer_id, verified, citations, flagged, cited_leak``: an answer's verdicts, counted in one go."""
    said = F.col("outcome")
    return verdicts.groupBy("answer_id").agg(F.count_if("verified").alias("verified"), F.count_if(said != "unknown").alias("citations"), F.count_if(said.isin("unknown", "not found", "leak")).alias("flagged"), F.bool_or(said == "leak").alias("cited_leak"))


def _claims(answers: DataFrame, tallied: DataFrame) -> DataFrame:
    rows = answers.select("answer_id", asserting_paragraphs(F.col("markdown")).alias("asserting")).join(tallied, "answer_id", "left").fillna(0, ["verified"])
    flag = F.when((F.col("asserting") > 0) & (F.col("verified") == 0), "none").when(F.col("asserting") > 2 * F.greatest("verified", F.lit(1)), "few").otherwise("enough")
    return rows.withColumn("flag", flag)


def unsupported_assertions(answers: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``answer_id, asserting, verified, flag``: legal statements without any verified citation, or more than two for each."""
    return _claims(answers, _tallied(verdicts)).select("answer_id", "asserting", "verified", "flag")


def verify(answers: DataFrame, citations: DataFrame, retrieved: DataFrame) -> DataFrame:
    """``answer_id, citations, verified, flags, leaked``: the verifier's verdict on every answer."""
    cited = cited_texts(citations, retrieved)
    claims = _claims(answers, _tallied(verify_citations(answers, citations, retrieved)))
    bare = unbacked_provisions(answers, cited).groupBy("answer_id").agg(F.count(F.lit(1)).alias("bare"))
    stray = jurisdiction_leaks(answers, cited).groupBy("answer_id").agg(F.count(F.lit(1)).alias("stray"))
    rows = claims.join(bare, "answer_id", "left").join(stray, "answer_id", "left").fillna(0, ["citations", "flagged", "bare", "stray"]).fillna(False, ["cited_leak"])
    flags = F.col("flagged") + F.col("bare") + F.when(F.col("stray") > 0, 1).otherwise(0) + F.when(F.col("flag") != "enough", 1).otherwise(0)
    return rows.select("answer_id", "citations", "verified", flags.alias("flags"), (F.col("cited_leak") | (F.col("stray") > 0)).alias("leaked"))
