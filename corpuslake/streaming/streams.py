"""Streaming forms: rate limit, consent gate, repeated questions, retention, continuous ingest.

Rate limit and consent gate keep their state by ``transformWithState``: a session's events wait in a list until the watermark has passed them, so
they are folded in the order of their times however they arrive, and on any split into micro-batches the result is the batch form's. Events later than the
watermark are dropped by Spark, as always. State that no longer tells anything is cleared: a bucket that is full again, a session without a grant. Both need
the RocksDB state store, which is set here where the session doesn't set one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corpuslake.operators import upsert
from corpuslake.sources.store import Store

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Ordered(StatefulProcessor):
    """Events of a key in the order of (us, event_id), once the watermark has passed them. Subclasses fold them and say until when (ms) their state matters."""

    state_schema = "us long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, event_id long, kind string")
        self.state = handle.getValueState("state", self.state_schema)

    def fold(self, state: tuple | None, us: int, kind: str | None) -> tuple[tuple | None, bool | None]:
        raise NotImplementedError

    def matters_until(self, state: tuple) -> int | None:
        """The time from which a fresh state would give the same (None: never)."""
        raise NotImplementedError

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802 (Spark's name)
        for pdf in rows:
            if len(pdf):
                self.waiting.appendList([(int(u), int(e), k) for u, e, k in zip(pdf["us"], pdf["event_id"], pdf["kind"], strict=True)])
                self.handle.registerTimer(int(pdf["us"].min()) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802 (Spark's name)
        # Every call on a state is a round trip to the JVM, so what is known already isn't asked, and nothing is cleared that isn't there.
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting, before, out = sorted(self.waiting.get()), self.state.get(), []
        state = before
        for us, event, kind in (w for w in waiting if w[0] < passed):
            state, allowed = self.fold(state, us, kind)
            if allowed is not None:
                out.append((event, allowed))
        late = [tuple(w) for w in waiting if w[0] >= passed]
        if late and len(late) < len(waiting):
            self.waiting.put(late)
        elif waiting and not late:
            self.waiting.clear()
        if late:
            self.handle.registerTimer(late[0][0] // 1000 + 1)
        until = self.matters_until(state) if state is not None else 0
        if until is not None and until * 1000 <= passed:
            if before is not None:
                self.state.clear()
        else:
            if state != before:
                self.state.update(state)
            if until is not None and not late:
                self.handle.registerTimer(until)
        if out:
            yield pd.DataFrame(out, columns=["event_id", "allowed"])


class Bucket(Ordered):
    state_schema = "tokens double, us long"

    def __init__(self, rate: float, burst: float):
        self.rate, self.burst = rate, burst

    def fold(self, state: tuple | None, us: int, kind: str | None) -> tuple[tuple | None, bool | None]:
        have = self.burst if state is None else min(self.burst, state[0] + (us - state[1]) * self.rate)
        return (float(have - (have >= 1)), us), have >= 1

    def matters_until(self, state: tuple) -> int | None:
        return int((state[1] + (self.burst - state[0]) / self.rate) // 1000) + 1


class Gate(Ordered):
    state_schema = "granted boolean, us long"

    def __init__(self, lapse_ms: int | None):
        self.lapse_ms = lapse_ms

    def fold(self, state: tuple | None, us: int, kind: str | None) -> tuple[tuple | None, bool | None]:
        if kind == "ask":
            held = state is not None and bool(state[0]) and (self.lapse_ms is None or us - state[1] < self.lapse_ms * 1000)
            return state, held
        return (kind == "grant", us), None

    def matters_until(self, state: tuple) -> int | None:
        return 0 if not state[0] else None if self.lapse_ms is None else state[1] // 1000 + self.lapse_ms


def _folded(log: DataFrame, processor: Ordered, late: str, unplaced: str) -> DataFrame:
    """Events with a time through the processor; those without can't be put in order and are not allowed (``unplaced``: which of them are answered)."""
    spark = log.sparkSession
    if spark.conf.get(PROVIDER, "").rpartition(".")[2] != "RocksDBStateStoreProvider":
        spark.conf.set(PROVIDER, ROCKS)
    kind = F.col("kind") if "kind" in log.columns else F.lit(None).cast("string")
    rows = log.where("ts is not null").withWatermark("ts", late).select("session_id", "ts", F.unix_micros("ts").alias("us"), F.col("event_id").cast("long").alias("event_id"), kind.alias("kind"))
    out = rows.groupBy("session_id").transformWithStateInPandas(processor, "event_id long, allowed boolean", "Append", "EventTime")
    return out.unionByName(log.where("ts is null").where(unplaced).select(F.col("event_id").cast("long").alias("event_id"), F.lit(False).alias("allowed")))


def rate_limit(log: DataFrame, per_day: float = 2.0, burst: float = 2.0, late: str = "1 hour") -> DataFrame:
    """``event_id, allowed``: a token bucket for each session; events wait ``late`` for those before them. A bucket's state goes when it's full again."""
    return _folded(log, Bucket(per_day / 86_400e6, burst), late, "true")


def consent_gate(log: DataFrame, late: str = "1 hour", lapse_ms: int | None = None) -> DataFrame:
    """``event_id, allowed`` of every ask: is the session's latest mark so far a grant (and, with ``lapse_ms``, not older than that)? No state is kept of sessions without a grant."""
    return _folded(log, Gate(lapse_ms), late, "kind = 'ask'")


def dedupe_questions(log: DataFrame, key: str = "cache_key", horizon: str = "1 day") -> DataFrame:
    """The first of equal questions within the horizon; state older than it is dropped."""
    return log.withWatermark("ts", horizon).dropDuplicatesWithinWatermark([key])


def retain(path: str, days: int, stream: str = "log") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: keeps the last ``days`` days before the newest row. A batch is written to ``data/day=d/batch=<stream>-<number>``, so a replay replaces it; days that the newest one leaves behind are
    counted and deleted as folders, each with a row (day, purged) in ``audit/batch=<stream>-<number>``. Late rows of such a day go with it again. Rows without a time are not kept."""

    def write(batch: DataFrame, number: int) -> None:
        spark, mark = batch.sparkSession, f"{stream}-{number}"
        batch.where("ts is not null").withColumns({"day": F.to_date("ts"), "batch": F.lit(mark)}).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(f"{path}/data")
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/data")
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/audit"))  # there for readers, also when nothing has expired
        held = {date.fromisoformat(f.getPath().getName()[4:]): f.getPath() for f in fs.listStatus(at) if f.getPath().getName().startswith("day=")}
        gone = sorted(d for d in held if d <= max(held) - timedelta(days=days)) if held else []
        if gone:
            counts = spark.read.option("basePath", f"{path}/data").parquet(*[f"{path}/data/day={d}" for d in gone])
            counts.groupBy("day").agg(F.count(F.lit(1)).alias("purged")).write.mode("overwrite").parquet(f"{path}/audit/batch={mark}")
            for d in gone:
                fs.delete(held[d], True)

    return write


def continuous_ingest(files: DataFrame, store: Store, model: str, embed: upsert.Embed, checkpoint: str, chunker: upsert.Chunker = upsert.by_lines, stream: str = "ingest") -> StreamingQuery:
    """Normalised files (source_id, text) as they arrive, to versions and chunks: every batch is one published change, and a batch that comes again changes nothing."""

    def take(batch: DataFrame, number: int) -> None:
        upsert.ingest(store, batch, model, embed, chunker, token=(stream, number))

    return files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
