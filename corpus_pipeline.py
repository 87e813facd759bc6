"""The corpus pipeline: quality filter, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept; all but the last
return the columns of ``documents``. Each stage's result is written and read again, so no stage's lineage
reaches into another's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.llm import linededup, mixing, neardup, packing, quality
from corpuslake.llm.common import fold, stage, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least 0.5; the classifier is the one of query op3. Rows are judged one by one: a null text like an
    empty one, repeated rows alike. Without labels of both classes nothing is rejected unless all labels are bad."""
    score = quality.quality_scorer(docs, table(spark, sf_dir, "labels"), fold("id", 3) != 1)
    return docs.where(score(F.col("text")) >= 0.5).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, without the lines that a document of smaller id holds; n_chars is counted anew. A null text becomes an empty one;
    rows without an id keep their lines; repeated rows of one id lose the same lines."""
    kept = linededup.dedup_lines(docs)
    return kept.select(F.col("row.doc_id").alias("doc_id"), F.col("kept_text").alias("text"), "row.lang", "row.source", F.char_length("kept_text").cast("long").alias("n_chars"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the document of smallest id of each class of near duplicates, and all rows without words or without an id.
    An id with several texts is one document, linked by any of them; its rows stay or go together."""
    gone = neardup.near_duplicates(docs).where(~F.col("kept")).select(F.col("id").alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows drawn by their cells' calibrated probabilities, each judged by itself; a null source or language is a value of its own."""
    return mixing.sample(docs).select(*COLUMNS)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows with their places in sequences of 1024 tokens; a row without text is its end token alone."""
    return packing.pack(docs)


STAGES = [("quality classifier", quality_stage), ("line dedup", line_stage), ("near-dedup", near_stage), ("mixing", mix_stage), ("packing", pack_stage)]

#: The classifier and the tokenizer have no SQL form; tests/llm/test_pipeline.py holds the stages against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs)
    return docs
