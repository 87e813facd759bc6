"""Reversible line dedup: exact reference counts behind sharded cuckoo filters.

Three tables make an index. ``postings`` has one row for each (line key, document). ``references`` counts them
exactly: key, number of documents, smallest document (the owner, which keeps the line). Before the stored
references stand cuckoo filters, some for each shard of the key space: 16-bit fingerprints, four slots
in a bucket, two buckets for each key, one entry for each key that a document holds. Documents are inserted in
batches: a batch's keys meet their shard's filters in that shard's task; keys that miss are certainly new and
go to the references as they are, only hits are looked up and added up. Deleting documents takes
their postings away, lowers the counts, finds new owners and takes keys that nobody holds out of the filters.
So a deletion brings back the lines that the deleted document had taken from others, and inserting it again
gives the first state back. Both return the ids of documents whose kept lines may have changed.

``dedup_lines`` loads all documents in WAVES insertions and drops the lines that another document owns. Texts
are read twice and never exploded back: lines travel as (id, line number, 128-bit MD5 of the key).

A line's key is the line with ASCII blanks stripped at both ends and A-Z in lower case. Keys under MIN_CHARS code
points are never dropped.

Nulls and edge cases: a null or empty text is one empty line; a null id neither holds nor loses lines;
repeated rows of one id count as one document and all lose the lines that another document owns; an empty
table gives an empty result; further columns are passed on in ``row``, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.llm.common import ids_and_text, stage

MIN_CHARS, SLOTS, SHARD_KEYS, WAVES = 10, 4, 200_000, 2
_UPPER, _LOWER, _BLANK = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """``lower`` is the same as ``translate`` on ASCII alone, and much faster."""
    bare = F.btrim(line, F.lit(_BLANK))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


class CuckooFilter:
    """A multiset of 64-bit hashes with deletions: no false negatives, false positives with probability below 2^-12."""

    def __init__(self, buckets: int, table: np.ndarray | None = None):
        self.mask = buckets - 1
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table

    @staticmethod
    def for_keys(n: int) -> CuckooFilter:
        return CuckooFilter(1 << max(4, int(np.ceil(np.log2(max(n, 1) / (SLOTS * 0.8))))))

    @staticmethod
    def _spread(prints: np.ndarray) -> np.ndarray:
        return (prints.astype(np.uint64) * np.uint64(0x5BD1E995)) >> np.uint64(8)

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = hashes.astype(np.uint64)
        prints = ((h >> np.uint64(48)) | np.uint64(1)).astype(np.uint16)
        first = h & np.uint64(self.mask)
        return prints, first.astype(np.int64), ((first ^ self._spread(prints)) & np.uint64(self.mask)).astype(np.int64)

    def _fill(self, prints: np.ndarray, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Puts prints[rows] into free slots of their buckets, all at once; returns the rows that found none."""
        rows = rows[np.argsort(at[rows], kind="stable")]
        bucket = at[rows]
        rank = np.arange(len(rows)) - np.searchsorted(bucket, bucket)
        free = self.table[bucket] == 0
        ok = rank < free.sum(axis=1)
        slot = np.argsort(~free, axis=1, kind="stable")[np.arange(len(rows)), np.minimum(rank, SLOTS - 1)]
        self.table[bucket[ok], slot[ok]] = prints[rows[ok]]
        return rows[~ok]

    def add(self, hashes: np.ndarray) -> np.ndarray:
        """Adds the hashes; returns those for which there is no place (they are not in the filter then)."""
        prints, a, b = self.places(hashes)
        left = self._fill(prints, b, self._fill(prints, a, np.arange(len(prints))))
        rng = np.random.default_rng(5)
        for n, i in enumerate(left.tolist()):
            p, at, path = int(prints[i]), int(b[i]), []
            for _ in range(500):
                slot = int(rng.integers(SLOTS))
                path.append((at, slot, int(self.table[at, slot])))
                p, self.table[at, slot] = int(self.table[at, slot]), p
                at = (at ^ ((p * 0x5BD1E995) >> 8)) & self.mask
                free = np.flatnonzero(self.table[at] == 0)
                if len(free):
                    self.table[at, free[0]] = p
                    break
            else:
                for at, slot, held in reversed(path):
                    self.table[at, slot] = held
                return hashes[left[n:]]
        return hashes[:0]

    def remove(self, hashes: np.ndarray) -> None:
        for p, a, b in zip(*(x.tolist() for x in self.places(hashes)), strict=True):
            for at in (a, b):
                held = np.flatnonzero(self.table[at] == p)
                if len(held):
                    self.table[at, held[0]] = 0
                    break

    def has(self, hashes: np.ndarray) -> np.ndarray:
        prints, a, b = self.places(hashes)
        return ((self.table[a] == prints[:, None]) | (self.table[b] == prints[:, None])).any(axis=1)

SCHEMA_POSTINGS, SCHEMA_REFERENCES, SCHEMA_FILTERS = "key binary, id long", "key binary, n_docs long, owner long", "shard int, buckets long, cells binary"


@dataclass(frozen=True)
class LineIndex:
    postings: DataFrame
    references: DataFrame
    filters: DataFrame
    shards: int


def empty_index(spark: SparkSession, keys: int = SHARD_KEYS) -> LineIndex:
    """An index meant for about ``keys`` keys; it holds more, with more filters to a shard."""
    return LineIndex(*[spark.createDataFrame([], s) for s in (SCHEMA_POSTINGS, SCHEMA_REFERENCES, SCHEMA_FILTERS)], max(1, -(-keys // SHARD_KEYS)))


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, t, at, key``: the lines that can be dropped, with their number in the text whose hash is ``t``."""
    lines = ids_and_text(docs, id_col, text_col).where("id is not null").select("id", F.xxhash64("text").alias("t"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    keyed = lines.select("id", "t", "at", line_key(F.col("line")).alias("key"))
    return keyed.where(F.char_length("key") >= MIN_CHARS).withColumn("key", F.unhex(F.md5("key")))


def _hashed(keys: DataFrame, shards: int) -> DataFrame:
    h = F.xxhash64("key")
    return keys.select("key", h.alias("h"), F.pmod(h, F.lit(shards)).cast("int").alias("shard"))


def _read(rows: pd.DataFrame) -> list[CuckooFilter]:
    return [CuckooFilter(n, np.frombuffer(c, np.uint16).reshape(-1, SLOTS).copy()) for n, c in zip(rows["buckets"], rows["cells"], strict=True)]


def probe(keys: DataFrame, index: LineIndex) -> DataFrame:
    """The keys that may be among the index's: every shard's keys meet that shard's filters in one task."""

    def hits(mine: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        h, found = mine["h"].to_numpy().view(np.uint64), np.zeros(len(mine), bool)
        for f in _read(held):
            found |= f.has(h)
        return mine.loc[found, ["key"]]

    return _hashed(keys, index.shards).groupBy("shard").cogroup(index.filters.groupBy("shard")).applyInPandas(hits, "key binary")


def edit_filters(index: LineIndex, added: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """The index's filters with one entry more for each added key (none of them in it yet) and without those of removed keys."""

    def edit(rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        shard, filters = (rows if len(rows) else held)["shard"].iloc[0], _read(held)
        h = rows["h"].to_numpy(np.int64).view(np.uint64)
        for gone in h[~rows["more"].to_numpy(bool)]:
            next(f for f in filters if f.has(np.array([gone])).any()).remove(np.array([gone]))
        new = h[rows["more"].to_numpy(bool)]
        for f in filters:
            new = f.add(new)
        while len(new):
            filters.append(CuckooFilter.for_keys(len(new)))
            new = filters[-1].add(new)
        return pd.DataFrame({"shard": [shard] * len(filters), "buckets": [f.mask + 1 for f in filters], "cells": [f.table.tobytes() for f in filters]})

    changes = _hashed(added, index.shards).withColumn("more", F.lit(True))
    if removed is not None:
        changes = changes.union(_hashed(removed, index.shards).withColumn("more", F.lit(False)))
    return changes.drop("key").groupBy("shard").cogroup(index.filters.groupBy("shard")).applyInPandas(edit, SCHEMA_FILTERS)


def insert_postings(index: LineIndex, new: DataFrame) -> tuple[LineIndex, DataFrame]:
    """The index with further (key, id), and ``id`` of documents whose kept lines may have changed. Counts are partly added up before the shuffle, so a line of a third of all documents is no hot spot."""
    new = stage(new.select("key", "id").distinct().join(index.postings, ["key", "id"], "left_anti"))
    batch = stage(new.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low")))
    hits = stage(probe(batch.select("key"), index))
    fresh = batch.join(hits, "key", "left_anti").select("key", F.col("n").alias("n_docs"), F.col("low").alias("owner"))
    met = stage(batch.join(hits, "key", "left_semi").join(index.references, "key", "left"))
    added_up = met.select("key", (F.col("n") + F.coalesce("n_docs", F.lit(0))).alias("n_docs"), F.least("low", "owner").alias("owner"))
    untouched = index.references.join(met.select("key"), "key", "left_anti")
    references = stage(fresh.union(added_up).union(untouched.select("key", "n_docs", "owner")))
    filters = edit_filters(index, fresh.select("key").union(met.where("owner is null").select("key")))
    changed = new.select("id").union(met.where("low < owner").select(F.col("owner").alias("id"))).distinct()
    return LineIndex(index.postings.union(new), references, filters, index.shards), changed


def insert_documents(index: LineIndex, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[LineIndex, DataFrame]:
    made, changed = insert_postings(index, lines_of(docs, id_col, text_col))
    return LineIndex(made.postings, made.references, stage(made.filters), made.shards), changed


def delete_documents(index: LineIndex, ids: DataFrame) -> tuple[LineIndex, DataFrame]:
    """The index without the documents named in the first column of ``ids``, and ``id`` of documents that get lines back."""
    gone_ids = ids.select(F.col(f"`{ids.columns[0]}`").cast("long").alias("id")).distinct()
    gone, left = stage(index.postings.join(gone_ids, "id", "left_semi").select("key", "id")), stage(index.postings.join(gone_ids, "id", "left_anti").select("key", "id"))
    less = gone.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    met = stage(index.references.join(less, "key").select("key", (F.col("n_docs") - F.col("n")).alias("n_docs"), F.col("owner").alias("old")))
    owners = left.join(met.where("n_docs > 0").select("key"), "key", "left_semi").groupBy("key").agg(F.min("id").alias("owner"))
    lowered = stage(met.join(owners, "key").select("key", "n_docs", "owner", "old"))
    references = stage(index.references.join(met.select("key"), "key", "left_anti").select("key", "n_docs", "owner").union(lowered.drop("old")))
    filters = stage(edit_filters(index, met.limit(0).select("key"), met.where("n_docs = 0").select("key")))
    return LineIndex(left, references, filters, index.shards), lowered.where("owner <> old").select(F.col("owner").alias("id")).distinct()


def _without(text: pd.Series, lost: pd.Series) -> pd.Series:
    def kept(t: str, gone: set[int]) -> str:
        return "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)

    return pd.Series([None if t is None else kept(t, set(at)) for t, at in zip(text, lost, strict=True)], dtype=object)


def kept_texts(docs: DataFrame, references: DataFrame, lines: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_lines, n_dropped, kept_text, row`` for every row of ``docs`` (``row``: the input row): lines that a smaller id owns are dropped."""
    lines = lines_of(docs, id_col, text_col) if lines is None else lines
    dropped = lines.join(references.where("n_docs > 1").select("key", "owner"), "key").where("id <> owner")
    lost = stage(dropped.groupBy("id", "t").agg(F.collect_set("at").alias("lost")))
    # a text travels once, in its row
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("t"), F.struct("*").alias("row"))
    out = rows.join(lost, ["id", "t"], "left").withColumn("text", F.coalesce(F.col("row")[text_col], F.lit(""))).withColumn("cut", F.pandas_udf(_without, "string")(F.when(F.col("lost").isNotNull(), F.col("text")), F.col("lost")))
    return out.select("id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.when(F.col("lost").isNull(), 0).otherwise(F.size("lost")).cast("long").alias("n_dropped"), F.coalesce("cut", "text").alias("kept_text"), "row")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", waves: int = WAVES) -> DataFrame:
    """``kept_texts`` of all documents against an index of them, loaded in ``waves`` insertions."""
    lines = stage(lines_of(docs, id_col, text_col))
    index = empty_index(docs.sparkSession, lines.count())
    for k in range(waves):
        index, _ = insert_postings(index, lines.where(F.pmod(F.xxhash64("id"), F.lit(waves)) == k))
        if k + 1 < waves:
            index = LineIndex(index.postings, index.references, stage(index.filters), index.shards)
    return kept_texts(docs, index.references, lines, id_col, text_col)
