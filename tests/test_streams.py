"""Stateful streams on shuffled, late and timeless events, retention that deletes, and ingest as one published change."""

import json
import os
import random
from types import SimpleNamespace

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpuslake.operators import models as M
from corpuslake.operators import upsert as U
from corpuslake.plans import registry
from corpuslake.sources.store import Conflict
from corpuslake.streaming import sessions as L
from corpuslake.streaming import streams as Z

LOG = "event_id long, ts string, session_id long, kind string"
DONE = (10**6, "2024-03-01 00:00:00", 77, "ask")  # far ahead: the watermark passes all others


def stream_of(spark, batches, folder, schema=LOG):
    """One file, so one micro-batch, for each list of rows."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{folder}/{i:03d}")
        for name in os.listdir(f"{folder}/{i:03d}"):
            os.utime(f"{folder}/{i:03d}/{name}", (10**9 + i, 10**9 + i))
    kinds = spark.read.parquet(f"{folder}/000").schema
    return spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def run(df, name, folder):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{folder}/c-{name}").trigger(availableNow=True).start()
    query.awaitTermination(150)
    return {tuple(r) for r in df.sparkSession.table(name).collect()}, query.lastProgress


def test_stateful_streams_equal_their_batch_forms_in_any_order(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, f"2024-01-01 {i // 6:02d}:{i % 6}0:00", i % 3, ("grant", "ask", "ask", "revoke", "ask")[i % 5]) for i in range(60)]
    near = [rows[i : i + 20] for i in range(0, 60, 20)]
    for part in near:
        rng.shuffle(part)
    swapped = [near[0][:15], near[0][15:] + near[1][:10], near[1][10:] + near[2], [(500, None, 1, "ask"), (501, None, 1, "grant")], [DONE], [(10**6 + 1, "2024-03-09 00:00:00", 78, "ask")]]
    batch = spark.createDataFrame([r for part in swapped for r in part], LOG).withColumn("ts", F.col("ts").cast("timestamp"))
    for name, want, make in (("limited", L.rate_limit(batch, 20.0, 2.0), lambda s: Z.rate_limit(s, 20.0, 2.0, late="6 hours")), ("gated", L.consent_gate(batch), lambda s: Z.consent_gate(s, late="6 hours"))):
        got, progress = run(make(stream_of(spark, swapped, str(tmp_path / name))), name, tmp_path)
        assert got == {tuple(r) for r in want.collect() if r["event_id"] != 10**6 + 1}  # the last one waits for the watermark
        assert progress["stateOperators"][0]["numRowsTotal"] <= 6, "full buckets and sessions without a grant keep no state"


def test_events_behind_the_watermark_are_dropped(spark, tmp_path):
    batches = [[(1, "2024-01-02 00:00:00", 1, "ask")], [(2, "2024-01-05 00:00:00", 2, "ask")], [(3, "2024-01-01 00:00:00", 1, "ask")], [DONE], [(4, "2024-03-09 00:00:00", 5, "ask")]]
    got, _ = run(Z.rate_limit(stream_of(spark, batches, str(tmp_path / "late")), late="1 hour"), "late", tmp_path)
    assert {e for e, _ in got} == {1, 2, 10**6}


def test_retention_deletes_days_and_says_so(spark, tmp_path):
    day = lambda e, d: (e, f"2024-01-{d:02d} 10:00:00", 1, "x")
    batches = [[day(1, 1), day(2, 2), day(3, 2)], [day(4, 9), (5, None, 1, "x")], [day(6, 2), day(7, 10)]]
    path, write = str(tmp_path / "kept"), Z.retain(str(tmp_path / "kept"), 7)
    stream_of(spark, batches, str(tmp_path / "log")).writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    kept = lambda: sorted(r["event_id"] for r in spark.read.parquet(f"{path}/data").collect())
    assert kept() == [4, 7] and sorted(x for x in os.listdir(f"{path}/data") if x.startswith("day")) == ["day=2024-01-09", "day=2024-01-10"]
    audit = spark.read.parquet(f"{path}/audit")
    assert sorted((r["batch"], str(r["day"]), r["purged"]) for r in audit.collect()) == [("log-1", "2024-01-01", 1), ("log-1", "2024-01-02", 2), ("log-2", "2024-01-02", 1)]
    write(spark.createDataFrame(batches[1], LOG).withColumn("ts", F.col("ts").cast("timestamp")), 1)  # the same batch again
    assert kept() == [4, 7]


@pytest.mark.parametrize("days", [30, 3, 0])
def test_retention_queries_equal_their_sql(spark, tmp_path, days):
    """Also with nothing expired, and with no events at all."""
    sql = f"SELECT id AS event_id, timestampadd(HOUR, CAST(id * 7 % {max(days, 1) * 24} AS INT), timestamp'2024-01-01') AS ts FROM range({days * 20})"
    spark.sql(sql).union(spark.sql("SELECT -1L, CAST(NULL AS TIMESTAMP)")).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT event_id, ts::TIMESTAMP AS ts FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("s6_retention_stream", "s6_retention_audit"):
        want = sorted(con.execute(registry.oracle_sql()[name]).fetchall())
        assert sorted(tuple(r) for r in registry.queries()[name](spark, str(tmp_path)).collect()) == want
        assert bool(want) == (days > 7 or (days > 0 and name == "s6_retention_stream"))


def texts(spark, rows):
    return spark.createDataFrame(rows, "source_id string, text string")


def state(store, spark):
    rows = store.read(spark, "versions").collect()
    chunks = {(r["source_id"], r["text"]) for r in U.searchable(store, spark).collect()}
    return {(r["source_id"], r["superseded"], r["n_chunks"]) for r in rows}, chunks


def test_ingest_is_one_change(spark, tmp_path):
    store, embed = U.corpus_store(str(tmp_path / "s")), M.embedding
    assert U.ingest(store, texts(spark, [("a", "one\n\ntwo"), ("b", "three"), ("c", "three"), ("d", None)]), "m", embed) == {"new_version": 2}
    assert state(store, spark) == ({("a", False, 2), ("b", False, 1)}, {("a", "one"), ("a", "two"), ("b", "three")})
    assert U.ingest(store, texts(spark, [("a", "one\n\ntwo"), ("b", "four")]), "m", embed) == {"unchanged": 1, "new_version": 1}
    assert state(store, spark) == ({("a", False, 2), ("b", True, 1), ("b", False, 1)}, {("a", "one"), ("a", "two"), ("b", "four")})
    assert {r["text"] for r in U.searchable(store, spark, historical=True).collect()} == {"one", "two", "three", "four"}
    where = spark.createDataFrame([("a", "IN"), ("b", "INTL")], "source_id string, jurisdiction string")
    assert {r["text"] for r in U.searchable(store, spark, True, where, "INTL").collect()} == {"three", "four"}
    assert U.ingest(store, texts(spark, [("a", "one\n\ntwo")]), "other", embed) == {"re_embedded": 1}
    assert {(r["source_id"], r["model"]) for r in U.searchable(store, spark).collect()} == {("a", "other"), ("b", "m")}
    assert U.ingest(store, texts(spark, [("b", "four")]), "m", embed, rechunk=True) == {"rechunked": 1} and store.number(spark) == 4
    assert U.ingest(store, texts(spark, []), "m", embed) == {} and store.number(spark) == 4


def test_readers_see_all_of_a_change_or_nothing(spark, tmp_path, monkeypatch):
    store, embed = U.corpus_store(str(tmp_path / "s")), M.embedding
    U.ingest(store, texts(spark, [("a", "one"), ("b", "two")]), "m", embed)
    before, opened = state(store, spark), store.manifest(spark)
    with monkeypatch.context() as m:  # a writer that dies when all data is written and nothing published
        m.setattr("corpuslake.sources.store.json", SimpleNamespace(loads=json.loads, dumps=lambda _: 1 / 0))
        with pytest.raises(ZeroDivisionError):
            U.ingest(store, texts(spark, [("a", "new"), ("c", "three")]), "m", embed)
    assert state(store, spark) == before and store.number(spark) == 1
    U.ingest(store, texts(spark, [("a", "new")]), "m", embed)
    assert {r["text"] for r in store.read(spark, "chunks", of=opened).collect()} == {"one", "two"}  # a reader keeps what it opened
    with pytest.raises(Conflict):
        store.publish(spark, opened, {})
    assert store.number(spark) == 2 and store.vacuum(spark, keep=1) > 0
    assert {t for _, t in state(store, spark)[1]} == {"new", "two"}
    untouched = {b: p for b, p in opened["tables"]["chunks"].items() if store.manifest(spark)["tables"]["chunks"].get(b) == p}
    assert len(untouched) == len({store.touched("chunks", texts(spark, [(x, "")]))[0] for x in "ab"}) - 1


def test_continuous_ingest_survives_a_replay(spark, tmp_path):
    store = U.corpus_store(str(tmp_path / "s"))
    inbox = str(tmp_path / "inbox")
    for i, rows in enumerate(([("a", "one"), ("b", "two")], [("a", "one more\nline"), ("b", "two")])):
        texts(spark, rows).coalesce(1).write.parquet(f"{inbox}/{i}")
    files = lambda: spark.readStream.schema("source_id string, text string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(inbox)
    Z.continuous_ingest(files(), store, "m", M.embedding, str(tmp_path / "c")).awaitTermination(150)
    want, number = state(store, spark), store.number(spark)
    assert want[1] == {("a", "one more"), ("a", "line"), ("b", "two")} and number == 2
    Z.continuous_ingest(files(), store, "m", M.embedding, str(tmp_path / "c2")).awaitTermination(150)  # all batches come again
    assert state(store, spark) == want and store.number(spark) == number


def test_a_look_at_a_session_is_few_calls_on_its_state():
    calls = []

    class State:
        def __init__(self):
            self.held = []

        def __getattr__(self, name):
            def call(*given):
                calls.append(name)
                if name == "appendList":
                    self.held += given[0]
                elif name == "appendValue":
                    self.held.append(given[0])
                return iter(self.held) if name == "get" and self.held else bool(self.held) if name == "exists" else None

            return call

    class Handle(State):
        def getListState(self, *_):  # noqa: N802
            return State()

        def getValueState(self, *_):  # noqa: N802
            return State()

    class Times:
        def getCurrentWatermarkInMs(self):  # noqa: N802
            return 10

    gate = Z.Gate(None)
    gate.init(Handle())
    list(gate.handleInputRows((1,), iter([pd.DataFrame({"us": [1, 0], "event_id": [7, 8], "kind": ["ask", "ask"]})]), None))
    out = pd.concat(gate.handleExpiredTimer((1,), Times(), None))
    assert calls == ["appendList", "registerTimer", "get", "get", "clear"]
    assert out.to_dict("list") == {"event_id": [8, 7], "allowed": [False, False]}
