"""A store of tables that change together: staged data, then one published manifest.

A table's rows lie in folders by bucket (a hash of its key column). A change writes the buckets it touches anew into a folder of its own, and then a
manifest that names every table's folder for every bucket. A bucket is written by as many tasks as its size asks for (Spark's rebalancing). Publishing is one rename that fails if another writer has taken the number: readers see
all of a change or nothing, a writer that dies before leaves folders that nobody names, and a reader keeps the manifest it opened. A
change may carry a token (a stream's name and batch number); one that was published before is not applied again.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 16


class Conflict(RuntimeError):
    """Another change was published first; read again and retry."""


@dataclass(frozen=True)
class Store:
    path: str
    schemas: dict[str, str] = field(hash=False)  # by table: its columns
    keys: dict[str, str] = field(hash=False)  # by table: what its rows are dealt by

    def bucket(self, table: str, key: Column | None = None) -> Column:
        return F.pmod(F.xxhash64(F.col(self.keys[table]) if key is None else key), F.lit(BUCKETS)).cast("int")

    def _files(self, spark: SparkSession):
        jvm = spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, at.getFileSystem(spark._jsc.hadoopConfiguration()), lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def number(self, spark: SparkSession) -> int:
        """Of the newest manifest; 0 before the first."""
        _, fs, path = self._files(spark)
        if not fs.exists(path("manifests")):
            return 0
        return max((int(f.getPath().getName()[:-5]) for f in fs.listStatus(path("manifests")) if f.getPath().getName()[0] != "."), default=0)

    def manifest(self, spark: SparkSession, number: int | None = None) -> dict:
        number = self.number(spark) if number is None else number
        if not number:
            return {"number": 0, "tables": {t: {} for t in self.schemas}, "tokens": {}}
        return json.loads("\n".join(r["value"] for r in spark.read.text(f"{self.path}/manifests/{number:010d}.json").collect()))

    def read(self, spark: SparkSession, table: str, buckets: list[int] | None = None, of: dict | None = None) -> DataFrame:
        """A table's rows, all or those of some buckets, as of a manifest (the newest unless given)."""
        places = (of or self.manifest(spark))["tables"][table]
        paths = [p for b, p in sorted(places.items()) if buckets is None or int(b) in buckets]
        return spark.read.schema(self.schemas[table]).parquet(*paths) if paths else spark.createDataFrame([], self.schemas[table])

    def touched(self, table: str, rows: DataFrame, key: Column | None = None) -> list[int]:
        """The buckets that rows belong to, BUCKETS at most."""
        return sorted(r[0] for r in rows.select(self.bucket(table, key)).distinct().collect())

    def publish(self, spark: SparkSession, base: dict, changed: dict[str, tuple[list[int], DataFrame]], token: tuple[str, int] | None = None) -> int:
        """Replaces, by table, the rows of the given buckets by new ones, on top of the manifest that they were read from."""
        tables, mark = {t: dict(p) for t, p in base["tables"].items()}, uuid.uuid4().hex
        for table, (buckets, rows) in changed.items():
            folder = f"{self.path}/data/{table}-{mark}"
            rows.select(*spark.createDataFrame([], self.schemas[table]).columns).withColumn("bucket", self.bucket(table)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(folder)
            _, fs, _ = self._files(spark)
            for b in buckets:
                tables[table].pop(str(b), None)
                if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/bucket={b}")):
                    tables[table][str(b)] = f"{folder}/bucket={b}"
        jvm, fs, path = self._files(spark)
        number, staged = base["number"] + 1, f"data/manifest-{mark}.json"
        out = fs.create(path(staged))
        out.write(bytearray(json.dumps({"number": number, "tables": tables, "tokens": base["tokens"] | ({token[0]: token[1]} if token else {})}).encode()))
        out.close()
        fs.mkdirs(path("manifests"))
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        none = spark.sparkContext._gateway.new_array(rename, 1)
        none[0] = rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path("manifests").toUri(), spark._jsc.hadoopConfiguration())
        try:
            context.rename(path(staged), path(f"manifests/{number:010d}.json"), none)
        except Exception as e:
            if "AlreadyExists" in str(e):
                raise Conflict(f"{number} was published by another writer") from e
            raise
        return number

    def vacuum(self, spark: SparkSession, keep: int = 2) -> int:
        """Deletes folders that none of the newest ``keep`` manifests names, and older manifests; how many folders went."""
        _, fs, path = self._files(spark)
        newest = self.number(spark)
        held = {p.rpartition("/bucket=")[0].rpartition("/")[2] for n in range(max(1, newest - keep + 1), newest + 1) for t in self.manifest(spark, n)["tables"].values() for p in t.values()}
        gone = [f.getPath() for f in fs.listStatus(path("data")) if f.getPath().getName() not in held]
        for p in gone:
            fs.delete(p, True)
        for n in range(newest - keep, 0, -1):
            if not fs.delete(path(f"manifests/{n:010d}.json"), False):
                break
        return len(gone)
