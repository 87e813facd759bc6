"""Lists of treaty parties: rows read from printed status lists, and questions settled by them. A negative needs a list that is provably complete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslake.operators import blocks as K

# How the lists print a row, a date and their total; the treaties, the date column that decides, and the words that mean them.
ROW = r"^(\S[^.]*?)\s*\.{2,}\s*(.*\S)\s*$"
DATE = r"[A-Z][a-z]+ \d{1,2}, \d{4}"
TOTAL = r"\(Total:\s*(\d+)\)"
STATUS = r"^Status on (.+?)\s*$"
NOTES = r"\d+(,\s*\d+)*$"
LISTS = (
    ("intl-madrid-parties", "the Madrid Protocol", 1, ("madrid", "madrid protocol", "madrid system", "international registration of marks")),
    ("intl-hague-parties", "the Hague Agreement", 0, ("hague", "hague system", "hague agreement", "geneva act", "international registration of industrial designs")),
)
ASKER, MOST = "India", 2


def treaties(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, t, c, list(a)) for s, t, c, a in LISTS], "source_id string, treaty string, column int, aliases array<string>")


def status_rows(lines: DataFrame) -> DataFrame:
    """``source_id, country, dates, line, line_no, page`` of lines (source_id, line_no, page, line): a name, a dotted leader, date columns ('' for a dash)."""
    text = F.trim("line")
    rest = F.regexp_extract(text, ROW, 2)
    dates = F.transform(F.regexp_extract_all(rest, F.lit(f"({DATE}|[–—-])"), F.lit(1)), lambda d: F.when(d.rlike("^[–—-]$"), "").otherwise(d))
    name = F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.regexp_extract(text, ROW, 1), NOTES, "")), r",+$", ""))
    return lines.where(text.rlike(ROW) & rest.rlike(DATE)).select("source_id", name.alias("country"), dates.alias("dates"), text.alias("line"), "line_no", "page")


def status_heads(lines: DataFrame) -> DataFrame:
    """``source_id, status, declared``: the day a list speaks of and the total that it declares, each as first printed."""
    first = lambda pattern: F.min_by(F.when(F.trim("line").rlike(pattern), F.regexp_extract(F.trim("line"), pattern, 1)), F.when(F.trim("line").rlike(pattern), F.col("line_no")))
    return lines.groupBy("source_id").agg(first(STATUS).alias("status"), first(TOTAL).cast("int").alias("declared"))


def complete_lists(lines: DataFrame) -> DataFrame:
    """``source_id, status, declared, page`` (of the first row) of the lists whose rows are as many as they declare."""
    counts = status_rows(lines).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("page", "line_no").alias("page"))
    return status_heads(lines).join(counts, "source_id").where("n = declared").select("source_id", "status", "declared", "page")


def known_countries(lines: DataFrame) -> DataFrame:
    """``country``: every name that a complete list prints."""
    return status_rows(lines).join(complete_lists(lines).select("source_id"), "source_id", "left_semi").select("country").distinct()


def keys(country: Column) -> Column:
    """What a printed name answers to, in lower case: itself, what precedes a bracket, the parts around brackets."""
    low = F.lower(country)
    parts = F.split(low, r" \(")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), " ("))
    return F.array_distinct(F.concat(F.array(low), heads, parts))


def checks(questions: DataFrame, lines: DataFrame, lists: DataFrame) -> DataFrame:
    """``query_id, treaty, country, listed, date, page, total``: for each treaty that a question (query_id, text) names and has a complete list, up to two
    of the countries that it names, longest first (India if none). A question is read once for all countries, not held against every name.
    """
    complete, rows = complete_lists(lines), status_rows(lines)
    low = questions.select("query_id", F.lower("text").alias("text"))
    named = low.join(F.broadcast(lists.select("source_id", "treaty", "column", F.explode("aliases").alias("alias"))), F.contains("text", F.col("alias"))).select("query_id", "source_id", "treaty", "column").distinct()
    asked = low.join(named.select("query_id").distinct(), "query_id", "left_semi")
    names = known_countries(lines).select("country", F.lower("country").alias("needle"), F.xxhash64("country").alias("country_id"))
    held = K.containing(asked, "query_id", "text", names, "country_id", "needle").join(names, "country_id")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.char_length("country")), "country")
    first = held.withColumn("at", F.row_number().over(order)).where(F.col("at") <= MOST).select("query_id", "country")
    wanted = named.join(first, "query_id", "left").withColumn("country", F.coalesce("country", F.lit(ASKER))).join(complete, "source_id")
    printed = rows.select("source_id", "line_no", F.col("page").alias("at_page"), "dates", F.col("country").alias("printed"), F.explode(keys(F.col("country"))).alias("key"))
    found = wanted.withColumn("key", F.lower("country")).join(printed, ["source_id", "key"], "left").groupBy("query_id", "treaty", "country", "column", "page", "declared").agg(F.min_by(F.struct("printed", "dates", "at_page"), "line_no").alias("r"))
    date = F.coalesce(F.get("r.dates", F.col("column")), F.lit(""))
    listed = F.col("r").isNotNull() & ((date != "") | (F.size("r.dates") == 0))
    return found.select("query_id", "treaty", F.coalesce("r.printed", "country").alias("country"), F.coalesce(listed, F.lit(False)).alias("listed"), F.when(F.col("r").isNull(), "").otherwise(date).alias("date"), F.coalesce("r.at_page", "page").alias("page"), F.col("declared").alias("total"))
