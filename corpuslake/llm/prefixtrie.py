"""Trie of conversation prefixes, by adaptive radix trees over fixed-width turn ids.

A turn's id is 16 big-endian bytes (the MD5 of role and text, the role's length first); a conversation's key is its turns' ids one
after the other. Conversations with one key are counted once, under their ids' list. Keys are dealt to shards by ranges of
their order, so a prefix that a third of all conversations share is spread over as many shards as its share asks for.

Each shard grows one adaptive radix tree: nodes hold 4, 16, 48 or 256 children in a layout of their own and grow from one to the
next, and a path without branches is one node (path compression). Only byte depths that are whole turns give trie nodes, several
ones of a compressed path, none of a branch within an id.

A trie node lies in several shards only if it is a prefix of a shard's first key and of the key before that, or of its last key and the key after
that. Such nodes are given in parts that add up: a shard knows from the two shared lengths which nodes another shard has begun,
so each distinct node, leaf and child is counted by one shard, and subtree sums need no look at other shards. All other nodes are whole.

``ends`` hashes the sorted ids of the conversations that end at a node. Ids are dealt by ranges of (key, id) and sorted there; lists within one range are
hashed there, others go as pieces of PIECE ids to one stream for each key that holds one piece at a time. SHA-256 can be taken in
order only, so the ids (not the rows) of a list pass one task.

Nulls and edge cases: rows without a conversation id are left out; a null turn comes first; turns with equal numbers are ordered by role, then by id;
repeated rows are repeated turns; null roles and texts are empty; a conversation's ids and word counts (20 bytes a turn) are one row; an empty table gives an
empty result, without a root; further columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.llm.common import WORD, stage

BYTES, SHARE, MOST_SHARED = 16, 20, 4
SHARD_TURNS, PIECE = 200_000, 10_000
NONE = hashlib.sha256(b"").hexdigest()
PARTS = "shard int, node string, parent string, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


class Art:
    """A node of an adaptive radix tree: the bytes below its edge, the row whose key ends here (or -1), and its children by their next byte."""

    __slots__ = ("path", "row", "room", "bytes", "kids")

    def __init__(self, path: bytes = b"", row: int = -1):
        self.path, self.row, self.room, self.bytes, self.kids = path, row, 4, bytearray(), []

    def find(self, byte: int) -> Art | None:
        if self.room == 256:
            return self.kids[byte]
        if self.room == 48:
            at = self.bytes[byte]
            return self.kids[at - 1] if at else None
        at = bisect_left(self.bytes, byte)
        return self.kids[at] if at < len(self.bytes) and self.bytes[at] == byte else None

    def add(self, byte: int, kid: Art) -> None:
        """A child under a byte that has none; a full node takes the next layout first."""
        if self.room < 256 and len(self.kids) == self.room:
            self._grow()
        if self.room == 256:
            self.kids[byte] = kid
        elif self.room == 48:
            self.kids.append(kid)
            self.bytes[byte] = len(self.kids)
        else:
            at = bisect_left(self.bytes, byte)
            self.bytes.insert(at, byte)
            self.kids.insert(at, kid)

    def _grow(self) -> None:
        if self.room == 4:
            self.room = 16
        elif self.room == 16:
            table = bytearray(256)
            for at, byte in enumerate(self.bytes):
                table[byte] = at + 1
            self.room, self.bytes = 48, table
        else:
            self.kids = [self.kids[at - 1] if at else None for at in self.bytes]
            self.room, self.bytes = 256, bytearray()

    def children(self) -> list[Art]:
        return [k for k in self.kids if k is not None]

    def cut(self, at: int) -> None:
        """Splits the path: this node ends after ``at`` bytes of it, and all it had hangs below the next byte."""
        rest = Art(self.path[at + 1 :], self.row)
        rest.room, rest.bytes, rest.kids = self.room, self.bytes, self.kids
        edge, self.path = self.path[at], self.path[:at]
        self.row, self.room, self.bytes, self.kids = -1, 4, bytearray(), []
        self.add(edge, rest)


def shared(a: bytes, b: bytes) -> int:
    """Length of the common beginning, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return low


def insert(root: Art, key: bytes, row: int) -> None:
    node, at = root, 0
    while True:
        if not key.startswith(node.path, at):
            node.cut(shared(node.path, key[at : at + len(node.path)]))
        at += len(node.path)
        if at == len(key):
            node.row = row
            return
        below = node.find(key[at])
        if below is None:
            node.add(key[at], Art(key[at + 1 :], row))
            return
        node, at = below, at + 1


def shard_nodes(keys: list[bytes], words: list[list[int]], counts: list[int], firsts: list[int], ends: list[str], before: int, after: int) -> list[tuple]:
    """Trie nodes of sorted distinct keys as (row of a member, depth, smallest conversation, conversations, children, leaves, saved, ends,
    place of the parent or -1, prefix of the key before, prefix of the key after). ``before`` and ``after``: turns that the first key shares with the key before it, and the last with the next; -1 without one."""
    root, last = Art(), len(keys) - 1
    for row, key in enumerate(keys):
        insert(root, key, row)
    order, tops = [(root, -1, 0)], [-1]  # node, bytes above it, bytes down to its end
    for place, (node, _, end) in enumerate(order):
        for kid in node.children():
            order.append((kid, end, end + 1 + len(kid.path)))
            tops.append(place)
    n, low, high, least = [0] * len(order), [last] * len(order), [0] * len(order), [None] * len(order)
    saved, leaves, waiting, fresh = [0] * len(order), [0] * len(order), [[] for _ in order], [0] * len(order)
    out: list[list] = []
    for place in range(len(order) - 1, -1, -1):
        node, above, end = order[place]
        if node.row >= 0:
            n[place] += counts[node.row]
            least[place] = firsts[node.row] if least[place] is None else min(least[place], firsts[node.row])
            low[place], high[place] = min(low[place], node.row), max(high[place], node.row)
        for depth in range(end // BYTES, above // BYTES, -1):
            begun, goes_on = low[place] == 0 and depth <= before, high[place] == last and depth <= after
            if not waiting[place] and not goes_on:
                leaves[place] += 1
            cost = words[low[place]][depth - 1] if depth else 0
            saved[place] += n[place] * cost - (0 if begun else cost)
            for child in waiting[place]:
                out[child][8] = len(out)
            ended = ends[node.row] if node.row >= 0 and depth * BYTES == end else None
            out.append([low[place], depth, least[place], n[place], fresh[place], leaves[place], saved[place], ended, -1, begun, goes_on])
            waiting[place], fresh[place] = [len(out) - 1], 0 if begun else 1
        if place:
            up = tops[place]
            n[up] += n[place]
            least[up] = least[place] if least[up] is None else min(least[up], least[place])
            low[up], high[up] = min(low[up], low[place]), max(high[up], high[place])
            saved[up], leaves[up], fresh[up] = saved[up] + saved[place], leaves[up] + leaves[place], fresh[up] + fresh[place]
            waiting[up].extend(waiting[place])
            waiting[place] = []
    return [tuple(r) for r in out]


def _names(key: bytes, most: int) -> list[str]:
    """A name for each prefix of up to ``most`` turns."""
    state, names = hashlib.md5(usedforsecurity=False), []
    for depth in range(most + 1):
        state.update(key[max(depth - 1, 0) * BYTES : depth * BYTES])
        names.append(f"{depth}:{state.hexdigest()}")
    return names


def _grow_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("key")
    keys, shard, before, after = [bytes(k) for k in pdf["key"]], pdf["shard"].iloc[0], int(pdf["before"].iloc[0]), int(pdf["after"].iloc[0])
    found = shard_nodes(keys, [list(map(int, w)) for w in pdf["words"]], pdf["n"].tolist(), pdf["conv_id"].tolist(), pdf["ends"].tolist(), before, after)
    first, final = _names(keys[0], before), _names(keys[-1], after)
    name = [first[r[1]] if r[9] else final[r[1]] if r[10] else None for r in found]
    up = [r[8] for r in found]
    return pd.DataFrame({
        "shard": shard, "node": name, "parent": [name[p] if p >= 0 else None for p in up], "depth": [r[1] for r in found], "conv_id": [r[2] for r in found],
        "parent_conv_id": pd.array([found[p][2] if p >= 0 else None for p in up], "Int64"), "n_convs": [r[3] for r in found], "n_children": [r[4] for r in found],
        "n_leaves": [r[5] for r in found], "saved_tokens": [r[6] for r in found], "ends_sha256": [r[7] for r in found],
    })


def rebuilt(turns: DataFrame) -> DataFrame:
    """``conv_id, key binary, words array<int>``: each conversation behind the first turns of its family's head."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").isNotNull().alias("given"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)).alias("id"), F.regexp_count(text, F.lit(WORD)).alias("words")).alias("t"),
    ).withColumn("head", F.col("conv_id") - F.col("conv_id") % SHARE)
    own = rows.repartition("head").groupBy("head", "conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words"))).alias("own"))
    lead = F.max(F.when(F.col("conv_id") == F.col("head"), F.slice("own", 1, MOST_SHARED - 1))).over(Window.partitionBy("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % MOST_SHARED).cast("int")
    both = own.withColumn("lead", lead).withColumn("h", h).select("conv_id", F.concat(F.slice(F.coalesce("lead", F.array().cast(own.schema["own"].dataType)), F.lit(1), F.col("h")), F.slice("own", F.col("h") + 1, F.size("own"))).alias("all"))
    return both.select("conv_id", F.unhex(F.array_join(F.transform("all", lambda t: t["id"]), "")).alias("key"), F.transform("all", lambda t: t["words"]).alias("words"))


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of one key in a sorted range: the first and the last in pieces, as they may go on elsewhere; those between hashed."""
    name, ids, count, least, state, opened, out = None, [], 0, 0, None, True, []

    def piece() -> None:
        if ids:
            out.append((name, ids[0], len(ids), ",".join(map(str, ids)), None))
            ids.clear()

    for pdf in batches:
        for key, conv in zip(pdf["name"], pdf["conv_id"], strict=True):
            if key != name:
                if name is not None and opened:
                    piece()
                elif name is not None:
                    state.update(",".join(map(str, ids)).encode())
                    out.append((name, least, count, None, state.hexdigest()))
                opened, name, count, least, state = name is None, key, 0, conv, hashlib.sha256()
                ids.clear()
            ids.append(conv)
            count += 1
            if len(ids) >= PIECE and opened:
                piece()
        if len(out) >= PIECE:
            yield pd.DataFrame(out, columns=["name", "first", "n", "piece", "ends"])
            out = []
    if name is not None:
        for at in range(0, len(ids), PIECE):
            part = ids[at : at + PIECE]
            out.append((name, part[0], len(part), ",".join(map(str, part)), None))
    if out:
        yield pd.DataFrame(out, columns=["name", "first", "n", "piece", "ends"])


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces in order, one at a time, to one hash for each key."""
    name, least, count, state = None, 0, 0, None
    for pdf in batches:
        out = []
        for key, first, n, piece in zip(pdf["name"], pdf["first"], pdf["n"], pdf["piece"], strict=True):
            if key != name:
                if name is not None:
                    out.append((name, least, count, state.hexdigest()))
                name, least, count, state = key, first, 0, hashlib.sha256()
            state.update(("," * (count > 0) + piece).encode())
            count += n
        yield pd.DataFrame(out, columns=["name", "first", "n", "ends"])
    if name is not None:
        yield pd.DataFrame([(name, least, count, state.hexdigest())], columns=["name", "first", "n", "ends"])


def key_ends(named: DataFrame) -> DataFrame:
    """``name, first, n, ends``: of each key the smallest conversation, how many, and the hash of their list."""
    parts = stage(named.select("name", "conv_id").repartitionByRange("name", "conv_id").sortWithinPartitions("name", "conv_id").mapInPandas(_runs, "name string, first long, n long, piece string, ends string"))
    pieces = parts.where(F.col("piece").isNotNull()).select("name", "first", "n", "piece").repartition("name").sortWithinPartitions("name", "first")
    return parts.where(F.col("piece").isNull()).select("name", "first", "n", "ends").unionByName(pieces.mapInPandas(_joined, "name string, first long, n long, ends string"))


def _shared_turns(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([-1 if x is None or y is None else shared(bytes(x), bytes(y)) // BYTES for x, y in zip(a, b, strict=True)], dtype="int32")


def prefix_trie(turns: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """COLUMNS, one row for each distinct prefix of whole turns."""
    spark = turns.sparkSession
    named = stage(rebuilt(turns).withColumn("name", F.md5("key")))
    ends = key_ends(named).withColumnRenamed("first", "conv_id")
    keys = named.join(ends, ["name", "conv_id"]).select("key", "words", "conv_id", "n", "ends")
    total = named.agg(F.sum(F.size("words"))).head()[0] or 0
    n_shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // shard_turns + 1)
    dealt = stage(keys.repartitionByRange(n_shards, "key").withColumn("shard", F.spark_partition_id()))
    # a row for each shard: their number is bounded by n_shards, and only two numbers of each are sent on
    span, beside = dealt.groupBy("shard").agg(F.min("key").alias("low"), F.max("key").alias("high")), Window.orderBy("shard")
    near = F.pandas_udf(_shared_turns, "int")
    edges = stage(span.select("shard", "low", "high", F.lag("high").over(beside).alias("last"), F.lead("low").over(beside).alias("next")).select("shard", near("low", "last").alias("before"), near("high", "next").alias("after")))
    parts = stage(dealt.join(F.broadcast(edges), "shard").groupBy("shard").applyInPandas(_grow_shard, PARTS))
    whole, split = parts.where(F.col("node").isNull()), parts.where(F.col("node").isNotNull())
    merged = split.groupBy("node").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max("ends_sha256").alias("ends_sha256"))
    merged = stage(merged)
    least = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    tops = merged.join(least, "parent", "left")
    # a shard's nodes below a split one look it up among the shard's own split nodes: no key has more rows than a shard
    of_shard = split.select("shard", F.col("node").alias("parent")).join(least, "parent")
    below = whole.where(F.col("parent").isNotNull()).drop("parent_conv_id").join(of_shard, ["shard", "parent"])
    out = whole.where(F.col("parent").isNull()).select(*COLUMNS).unionByName(below.select(*COLUMNS)).unionByName(tops.select(*COLUMNS))
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NONE)))
