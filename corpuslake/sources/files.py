"""Sources and sinks: manifests, landing zones, golden items, nested profiles, patent-search responses; partitioned chunk tables and run files."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What a manifest entry may say.
MANIFEST = "id string, title string, jurisdiction string, regime array<string>, doc_type string, issuer string, url string, fetch string, fetch_url string, format string, licence string, language string, version_label string"
DOMAINS = {"jurisdiction": ("IN", "INTL"), "fetch": ("auto", "manual"), "format": ("pdf", "html"), "doc_type": ("statute", "rules", "regulations", "notification", "treaty", "regulation", "manual", "guideline", "monograph", "case_law", "registry_record")}
PREFIXES = {"IN": "in-", "INTL": "intl-"}
GOLDEN = "id string, question string, category string, twin_of string, expected map<string,struct<sources:array<string>,locators:array<string>>>"
LENS = "total long, data array<struct<lens_id:string,jurisdiction:string,doc_number:string,kind:string,date_published:string,biblio:struct<invention_title:array<struct<text:string,lang:string>>>>>"


def read_manifest(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """Manifest entries, one JSON object a line, with ``unknown``: keys that the schema hasn't (null: not an object). Nothing is dropped."""
    keys = F.json_object_keys(F.col(text_col))
    rows = lines.select(F.from_json(text_col, MANIFEST).alias("m"), F.array_except(keys, F.array(*[F.lit(c.split()[0]) for c in MANIFEST.split(", ")])).alias("unknown"))
    return rows.select("m.*", "unknown")


def validate_manifest(entries: DataFrame) -> DataFrame:
    """``id, violation``: unknown keys, values outside their domain, a prefix that belies the jurisdiction, automatic fetching without an address, no regime, a repeated id."""
    prefix = F.create_map(*[F.lit(x) for kv in PREFIXES.items() for x in kv])
    rules = {f"{c}": ~F.coalesce(F.col(c), F.lit("")).isin(*values) for c, values in DOMAINS.items()} | {
        "unknown key": F.size("unknown") > 0, "prefix": ~F.startswith("id", F.coalesce(F.try_element_at(prefix, F.col("jurisdiction")), F.lit(""))), "fetch_url": (F.col("fetch") == "auto") & F.col("fetch_url").isNull(),
        "regime": F.coalesce(F.size("regime"), F.lit(0)) < 1,
    }
    broken = F.array_compact(F.array(*[F.when(when, name) for name, when in rules.items()]))
    twice = entries.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit("repeated id").alias("violation"))
    return entries.select("id", F.explode(broken).alias("violation")).union(twice)


def looks_like(kind: Column, content: Column) -> Column:
    """Is the content of that kind? Sites answer for a missing file with a page and no error."""
    head = F.lower(F.decode(F.substring(content, 1, 2048), "ISO-8859-1"))
    pdf = F.regexp_extract(F.decode(F.substring(content, 1, 2048), "ISO-8859-1"), r"^\s*(.{0,5})", 1) == "%PDF-"
    return F.when(kind == "pdf", pdf).otherwise(F.contains(head, F.lit("<html")) | F.contains(head, F.lit("<!doctype html")))


def scan_raw(files: DataFrame, kind: Column) -> DataFrame:
    """``path, sha256, ok`` of a landing zone read with ``spark.read.format('binaryFile')``."""
    return files.select("path", F.sha2("content", 256).alias("sha256"), looks_like(kind, F.col("content")).alias("ok"))


def detect_changes(expected: DataFrame, landing: DataFrame, stored: DataFrame) -> DataFrame:
    """``id, outcome`` for every expected source (id, fetch) from what lies in the landing zone (id, sha256, ok) and what is stored (id, sha256)."""
    rows = expected.join(landing.select("id", F.col("sha256").alias("new"), "ok"), "id", "left").join(stored.select("id", F.col("sha256").alias("old")), "id", "left")
    manual = F.when(F.col("old").isNotNull(), "manual_present").otherwise("manual_missing")
    auto = F.when(F.col("new").isNull() | ~F.col("ok"), "failed").when(F.col("new") == F.col("old"), "unchanged").otherwise("downloaded")
    return rows.select("id", F.when(F.col("fetch") == "manual", manual).otherwise(auto).alias("outcome"))


def read_golden(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """``id, category, jurisdiction, sources, locators, repeated``: one row for each expectation of each golden item; ids that occur twice are marked."""
    rows = lines.select(F.from_json(text_col, GOLDEN).alias("g")).select("g.*")
    seen = rows.groupBy("id").agg((F.count(F.lit(1)) > 1).alias("repeated"))
    return rows.join(seen, "id").select("id", "category", F.explode_outer("expected").alias("jurisdiction", "e"), "repeated").select("id", "category", "jurisdiction", "e.sources", "e.locators", "repeated")


def read_profiles(lines: DataFrame, profile: str, text_col: str = "value") -> DataFrame:
    """``kind, id, profile, misfiled``: nested JSON (kind, then id, then a profile of schema ``profile`` with a ``kind`` of its own) as rows."""
    by_kind = lines.select(F.explode(F.from_json(text_col, f"map<string,map<string,{profile}>>")).alias("kind", "items"))
    return by_kind.select("kind", F.explode("items").alias("id", "profile")).withColumn("misfiled", ~F.coalesce(F.col("profile.kind") == F.col("kind"), F.lit(False)))


def lens_hits(responses: DataFrame, text_col: str = "value") -> DataFrame:
    """``lens_id, jurisdiction, doc_number, kind, date_published, title, url`` of patent-search responses: the first English title, else the first, else ''."""
    each = responses.select(F.inline(F.from_json(text_col, LENS)["data"]))
    titles = F.coalesce(F.col("biblio.invention_title"), F.array().cast("array<struct<text:string,lang:string>>"))
    english = F.filter(titles, lambda t: F.lower(F.coalesce(t["lang"], F.lit(""))) == "en")
    title = F.coalesce(F.when(F.size(english) > 0, F.get(english, F.lit(0))["text"]).otherwise(F.get(titles, F.lit(0))["text"]), F.lit(""))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return each.select(*[blank(c) for c in ("lens_id", "jurisdiction", "doc_number", "kind", "date_published")], title.alias("title"), F.concat(F.lit("https://www.lens.org/lens/patent/"), F.coalesce("lens_id", F.lit(""))).alias("url"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: under ``spark.checkpoint.dir``, or a new one of its own where that is unset and all run on one machine (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks partitioned by source; a source that is written again replaces its own partition only."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_id").parquet(path)


def write_run(results: DataFrame, path: str) -> None:
    """Results of finished items, appended as JSON; a run that breaks off keeps what it has."""
    results.write.mode("append").json(path)


def unfinished(items: DataFrame, results: DataFrame) -> DataFrame:
    """Items (item) without a result, or with one whose notes tell of an error."""
    done = results.where(~F.exists("notes", lambda n: F.startswith(n, F.lit("error:")))).select("item")
    return items.join(done, "item", "left_anti")


Loader = Callable[[SparkSession, str], DataFrame]


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a shared folder of its own and read again, so that what reads it twice doesn't make it twice."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
