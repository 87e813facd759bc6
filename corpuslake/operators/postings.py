"""An inverted index on disk, and BM25 over it.

``postings/version=v/bucket=b`` holds (salt, term, <within>, chunk_id, tf, dl) ordered by term, ``terms/version=v/bucket=b`` a row for each term (df), ``sizes/version=v`` the number of chunks and words. A version is
written once, its ``sizes`` last: a version without is not there for readers, and writing it again replaces it. Chunks are added, replaced and
dropped by version; nothing of other versions is read or written for that.

A search reads the buckets of its terms only (partitions are pruned while it runs) and is one plan of JVM operators, however many
queries there are (in blocks of about QUERIES, whose weights go to every task): postings of query terms move once, to the task of their chunk, which
adds up its scores for all queries; what stays under a query's floor isn't ordered. A term that most chunks have is dealt in SALTS parts on disk.
Lists are exact, ties by chunk id.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.functions import text as T
from corpuslake.operators.blocks import K1, B, top

BUCKETS, SALTS, QUERIES, SAMPLE = 64, 8, 4096, 32


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def lanes(spark: SparkSession) -> int:
    """As many tasks as shuffles have: small rows are joined to many queries here, or sorted and written, so their bytes tell too little for fewer tasks."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def counted(chunks: DataFrame, within: tuple[str, ...]) -> DataFrame:
    """``bucket, salt, term, <within>, chunk_id, tf, dl``, dealt by bucket and salt: the one move of an insertion. Null texts have no words."""
    words = chunks.where("text is not null").select("chunk_id", *within, F.regexp_extract_all("text", F.lit(T.WORD3), F.lit(0)).alias("w"))
    # an outer explode: a plain one has Spark ask first whether there are words, which looks for all of them twice
    each = words.select("chunk_id", *within, F.size("w").alias("dl"), F.explode_outer("w").alias("term")).where("term is not null").withColumn("term", F.lower("term"))
    each = each.withColumn("bucket", bucket(F.col("term"))).withColumn("salt", F.pmod(F.xxhash64("chunk_id"), F.lit(SALTS)).cast("int"))
    return each.repartition(lanes(chunks.sparkSession), "bucket", "salt").groupBy("bucket", "salt", "term", *within, "chunk_id").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.max("dl").alias("dl"))


def sized(chunks: DataFrame) -> DataFrame:
    """``chunk_id, dl`` of the chunks with words, by the chunks themselves: they are far fewer rows than their postings."""
    return chunks.select("chunk_id", F.regexp_count("text", F.lit(T.WORD3)).alias("dl")).groupBy("chunk_id").agg(F.max("dl").alias("dl")).where("dl > 0")


@dataclass(frozen=True)
class Index:
    path: str
    within: tuple[str, ...] = ()

    def add(self, chunks: DataFrame, version: int) -> Index:
        """The chunks (chunk_id, text, <within>) as a version; a version that is there is replaced."""
        self.drop(chunks.sparkSession, version)
        at = lambda table: f"{self.path}/{table}/version={version}"
        rows = counted(chunks, self.within)
        rows.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(at("postings"))
        written = chunks.sparkSession.read.schema(rows.schema).parquet(at("postings"))
        df = written.groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df"))
        df.repartition(BUCKETS, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(at("terms"))  # a file a bucket, not one for each task and bucket
        sized(chunks).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words")).write.mode("overwrite").parquet(at("sizes"))
        return self

    def drop(self, spark: SparkSession, version: int) -> None:
        for table in ("sizes", "terms", "postings"):
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}/version={version}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    def _read(self, spark: SparkSession, table: str, asked: DataFrame) -> DataFrame:
        """A table's rows in the buckets asked for (at most BUCKETS of them) and of the versions that are whole."""
        wanted = asked.select("bucket").where(F.col("bucket") >= 0).distinct()
        whole = spark.read.parquet(f"{self.path}/sizes").select("version").where(F.col("version") >= 0).distinct()
        rows = spark.read.parquet(f"{self.path}/{table}")
        return rows.join(F.broadcast(wanted), "bucket", "left_semi").join(F.broadcast(whole), "version", "left_semi")

    def terms(self, spark: SparkSession) -> DataFrame:
        """``term, df`` over all whole versions."""
        whole = spark.read.parquet(f"{self.path}/sizes").select("version").distinct()
        return spark.read.parquet(f"{self.path}/terms").join(F.broadcast(whole), "version", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))

    def search(self, queries: DataFrame, k: int = 40, within: tuple[str, ...] | None = None) -> DataFrame:
        """``query_id, <within>, chunk_id, score, rank`` of queries (query_id, text, <within>): the k best by BM25 over words of three characters or more. ``within`` may be fewer columns than the index has."""
        within = self.within if within is None else within
        n = max(1, -(-queries.count() // QUERIES))
        parts = [self._best(queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i) if n > 1 else queries, within, k) for i in range(n)]
        return reduce(DataFrame.union, parts)

    def _best(self, queries: DataFrame, within: tuple[str, ...], k: int) -> DataFrame:
        """The lists of at most about QUERIES queries, whose weights every task gets.

        Postings move once, to their chunk's task, where all sums of a chunk begin and end. A query's k-th best score in one SAMPLE-th of the chunks is a floor
        for its k-th best of all, so of other sums only those that reach it are ordered.
        """
        spark, keys = queries.sparkSession, ["query_id", *within]
        asked = queries.where("text is not null").select(*keys, F.explode(T.words3(F.col("text"))).alias("term")).withColumn("bucket", bucket(F.col("term")))
        one = spark.read.parquet(f"{self.path}/sizes").agg(F.sum("n").alias("chunks"), (F.sum("words") / F.sum("n")).alias("mean"))
        known = self._read(spark, "terms", asked).groupBy("bucket", "term").agg(F.sum("df").alias("df"))
        weights = asked.join(known, ["bucket", "term"]).crossJoin(F.broadcast(one)).withColumn("idf", F.log(1 + (F.col("chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
        weights = weights.select(*keys, "term", F.col("idf"), "mean")
        given = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("mean")))
        postings = self._read(spark, "postings", asked).join(F.broadcast(asked.select("term").distinct()), "term", "left_semi").select(*within, "chunk_id", "term", "tf", "dl")

        def scores(rows: DataFrame) -> DataFrame:
            hits = rows.repartition(lanes(spark), "chunk_id").join(F.broadcast(weights), ["term", *within])
            return hits.groupBy(*keys, "chunk_id").agg(F.round(F.sum(given), 6).alias("score"))

        seen = F.pmod(F.xxhash64("chunk_id", F.lit(1)), F.lit(SAMPLE)) == 0
        floor = top(scores(postings.where(seen)), within, k).where(F.col("rank") == k).select(*keys, F.col("score").alias("floor"))
        found = scores(postings).join(F.broadcast(floor), keys, "left").where("floor is null or score >= floor").drop("floor")
        return top(found, within, k)
