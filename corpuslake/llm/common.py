"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as every contract of this subpackage understands it.
BLANKS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a new one where it is unset and all run on one machine (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def stage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends there and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ids_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``id long, text string`` (null text: empty), so that no other column can clash."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def fold(id_col: str, modulus: int) -> F.Column:
    """crc32 of the id as text, modulo ``modulus``: the split into learning and held-out rows."""
    return F.crc32(F.col(id_col).cast("string")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: F.Column, max_rows: int) -> DataFrame:
    """``id, text, y`` of at most ``max_rows`` labelled documents for which ``keep`` (over ``id``) holds.

    The rows are the ones with the smallest hash of their id, so the choice doesn't depend on partitioning.
    Only ids and labels are ranked; the texts are joined to the bounded list of ids.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("y"))
        .where(F.col("y").isin(0, 1) & F.col("id").isNotNull())
        .groupBy("id").agg(F.max("y").alias("y"))
        .where(keep)
        .orderBy(F.xxhash64("id", F.lit(17)), "id")
        .limit(max_rows)
    )
    return ids_and_text(docs).join(F.broadcast(chosen), "id")
