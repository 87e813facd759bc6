"""Session logs in batch: rate limits, windows, consent in force, repeated questions, retention, erasure. Stateful streaming forms are in ``streams``."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def audit_rollup(log: DataFrame, every: str = "1 hour", late: str | None = None) -> DataFrame:
    """Events for each kind and tumbling window; with ``late``, under a watermark (streams)."""
    log = log.withWatermark("ts", late) if late else log
    return log.groupBy(F.window("ts", every), "kind").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "kind", "n")


def session_activity(log: DataFrame, gap: str = "6 hours", late: str | None = None) -> DataFrame:
    log = log.withWatermark("ts", late) if late else log
    return log.groupBy(F.session_window("ts", gap).alias("w"), "session_id").agg(F.count(F.lit(1)).alias("n")).select("session_id", F.col("w.start").alias("start"), "n")


def latest_consent(log: DataFrame) -> DataFrame:
    """Each session's last grant or revocation decides: ``session_id, active``."""
    marks = log.where("kind in ('grant', 'revoke')").groupBy("session_id").agg(F.max_by("kind", F.struct("ts", "event_id")).alias("last"))
    return marks.select("session_id", (F.col("last") == "grant").alias("active"))


def consent_gate(log: DataFrame) -> DataFrame:
    """Each ask with the consent in force at its time: the latest mark at or before it (an as-of join as one window). Without a time nothing is in force, and a mark without one is none."""
    order = Window.partitionBy("session_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    state = F.last(F.when((F.col("kind") != "ask") & F.col("ts").isNotNull(), F.col("kind")), ignorenulls=True).over(order)
    return log.withColumn("state", state).where("kind = 'ask'").select("event_id", F.coalesce(F.col("state") == "grant", F.lit(False)).alias("allowed"))


def revoke(log: DataFrame) -> DataFrame:
    """Each grant with the time of the first revocation after it."""
    order = Window.partitionBy("session_id").orderBy("ts", "event_id").rowsBetween(1, Window.unboundedFollowing)
    until = F.first(F.when(F.col("kind") == "revoke", F.col("ts")), ignorenulls=True).over(order)
    return log.withColumn("revoked_at", until).where("kind = 'grant'").select("event_id", "revoked_at")


def rate_limit(log: DataFrame, per_day: float = 2.0, burst: float = 2.0) -> DataFrame:
    """Token bucket for each session: ``event_id, allowed``. An ordered fold that holds one bucket and one batch of rows, however long a session is. Events without a time are not allowed and cost nothing."""
    rate = per_day / 86_400e6

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, tokens, last, fresh = None, burst, None, True
        for batch in batches:
            out = []
            for now, us in zip(batch["session_id"].to_pylist(), batch["us"].to_pylist(), strict=True):
                if fresh or now != session:
                    session, tokens, last, fresh = now, burst, None, False
                if us is None:
                    out.append(False)
                    continue
                have = min(burst, tokens + (0.0 if last is None else (us - last) * rate))
                out.append(have >= 1)
                tokens, last = have - out[-1], us
            yield pa.RecordBatch.from_arrays([batch["event_id"], pa.array(out, pa.bool_())], ["event_id", "allowed"])

    rows = log.select("session_id", F.unix_micros("ts").alias("us"), F.col("event_id").cast("long").alias("event_id"))
    return rows.repartition("session_id").sortWithinPartitions("session_id", "us", "event_id").mapInArrow(fold, "event_id long, allowed boolean")


def dedupe_questions(log: DataFrame, key: str, horizon_us: int = 86_400_000_000) -> DataFrame:
    """``event_id, answered_by``: equal questions are answered once within the horizon, by the first; the next one after it is answered anew. An ordered fold that holds one question."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        question, since, by, fresh = None, 0, None, True
        for batch in batches:
            out = []
            for now, us, event in zip(batch["key"].to_pylist(), batch["us"].to_pylist(), batch["event_id"].to_pylist(), strict=True):
                if fresh or now != question or us - since >= horizon_us:
                    question, since, by, fresh = now, us, event, False
                out.append(by)
            yield pa.RecordBatch.from_arrays([batch["event_id"], pa.array(out, pa.int64())], ["event_id", "answered_by"])

    rows = log.select(F.col(key).cast("string").alias("key"), F.unix_micros("ts").alias("us"), F.col("event_id").cast("long").alias("event_id"))
    return rows.repartition("key").sortWithinPartitions("key", "us", "event_id").mapInArrow(fold, "event_id long, answered_by long")


def expired(now: Column, days: int, audit_days: int) -> dict[str, Column]:
    """What each table loses: answers, closed escalations and revoked grants past the window, audit rows past a longer one. Open escalations and grants in force stay."""
    old, older = now - F.make_dt_interval(F.lit(days)), now - F.make_dt_interval(F.lit(audit_days))
    past = {"answers": F.col("created_at") < old, "escalations": (F.col("created_at") < old) & (F.col("status") == "closed"), "consent_grants": F.col("revoked_at") < old, "audit_events": F.col("created_at") < older}
    return {name: F.coalesce(when, F.lit(False)) for name, when in past.items()}


def purge(tables: dict[str, DataFrame], now: Column, days: int = 30, audit_days: int = 180) -> tuple[dict[str, DataFrame], DataFrame]:
    """What stays of each table, and ``table_name, purged, kept``: the counts alone are the dry run."""
    past = expired(now, days, audit_days)
    counts = [df.agg(F.lit(name).alias("table_name"), F.count_if(past[name]).alias("purged"), F.count_if(~past[name]).alias("kept")) for name, df in tables.items()]
    return {name: df.where(~past[name]) for name, df in tables.items()}, reduce(DataFrame.union, counts)


def erase(tables: dict[str, DataFrame], gone: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables without the rows of erased sessions (session_id), and ``table_name, erased, kept``, which names no session."""
    ids = gone.select("session_id").distinct()
    counts = [df.join(ids.withColumn("gone", F.lit(True)), "session_id", "left").agg(F.lit(name).alias("table_name"), F.count("gone").alias("erased"), F.count_if(F.col("gone").isNull()).alias("kept")) for name, df in tables.items()]
    return {name: df.join(ids, "session_id", "left_anti") for name, df in tables.items()}, reduce(DataFrame.union, counts)


def audit(counts: DataFrame, now: Column, what: str) -> DataFrame:
    """The one audit row of a purge or erasure: its counts, and no id."""
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(counts.columns[0], counts.columns[1])))).alias("m")).select(F.lit("system").alias("session_id"), F.lit("purge").alias("kind"), now.alias("created_at"), F.to_json(F.create_map(F.lit(what), F.col("m"))).alias("payload"))


def read_stream(spark, path: str, schema, **options) -> DataFrame:
    """Parquet files as they arrive."""
    return spark.readStream.schema(schema).options(**options).parquet(path)
