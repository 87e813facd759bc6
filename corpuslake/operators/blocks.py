"""Rankings of all rows against a stated set of queries.

A block of queries (at most BLOCK rows) goes to every task as one matrix; tasks score a batch of rows against the whole
block by matrix products and hold the k best of each query, so a task gives at most k rows a query and no pair of query
and row is ever shuffled. More queries are more blocks, each one pass over the rows. Results are exact; ties go to the
smaller chunk id.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.functions import text as T
from corpuslake.sources.files import staged

BLOCK, ROWS, POSTINGS, K1, B = 1024, 1000, 1 << 18, 1.2, 0.75
Scorer = Callable[[pd.DataFrame, np.ndarray], np.ndarray]


def blocks_of(queries: DataFrame, size: int = BLOCK) -> Iterator[pd.DataFrame]:
    """The queries in blocks of about ``size`` rows, dealt by a hash of their id."""
    n = max(1, -(-queries.count() // size))
    for k in range(n):
        block = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == k).toPandas() if n > 1 else queries.toPandas()
        if len(block):
            yield block


def _allowed(rows: pd.DataFrame, block: pd.DataFrame, within: tuple[str, ...]) -> np.ndarray:
    same = np.ones((len(rows), len(block)), bool)
    for c in within:
        same &= rows[c].to_numpy()[:, None] == block[c].to_numpy()[None, :]
    return same


def _merged(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    best = np.lexsort((ids, -scores))[:k]
    return ids[best], scores[best]


def best_rows(rows: DataFrame, block: pd.DataFrame, score: Scorer, within: tuple[str, ...], k: int) -> DataFrame:
    """``query_id, <within>, chunk_id, score``: every task's k best rows of each query. ``score`` gives a matrix of rows and of those queries whose places in the block it is given, -inf for no hit."""
    keys, places = ["query_id", *within], {}
    for j, value in enumerate(zip(*[block[c] for c in within], strict=True) if within else [()] * len(block)):
        places.setdefault(value, []).append(j)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, least = [(np.empty(0, np.int64), np.empty(0)) for _ in range(len(block))], np.full(len(block), -np.inf)
        groups = [(value, np.array(own)) for value, own in places.items()]
        for pdf in batches:
            for whole in (pdf.iloc[at : at + ROWS] for at in range(0, len(pdf), ROWS)):
                for value, own in groups:
                    same = np.ones(len(whole), bool)
                    for c, v in zip(within, value, strict=True):
                        same &= (whole[c] == v).to_numpy(bool)
                    if not same.any():
                        continue
                    part = whole[same]
                    ids, found = part["chunk_id"].to_numpy(), np.round(score(part, own), 6)
                    good = (found >= least[own]) & (found > -np.inf)
                    for i in np.flatnonzero(good.any(axis=0)):
                        hit, j = np.flatnonzero(good[:, i]), own[i]
                        held[j] = _merged(np.concatenate([held[j][0], ids[hit]]), np.concatenate([held[j][1], found[hit, i]]), k)
                        least[j] = held[j][1][-1] if len(held[j][1]) == k else -np.inf
        counts = [len(i) for i, _ in held]
        out = {c: np.repeat(block[c].to_numpy(), counts) for c in keys}
        yield pd.DataFrame({**out, "chunk_id": np.concatenate([i for i, _ in held]), "score": np.concatenate([s for _, s in held])})

    kinds = dict(rows.dtypes)
    schema = ", ".join(["query_id long", *[f"{c} {kinds[c]}" for c in within], "chunk_id long", "score double"])
    return rows.mapInPandas(run, schema)


def top(scored: DataFrame, within: tuple[str, ...], k: int) -> DataFrame:
    order = Window.partitionBy("query_id", *within).orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def cosine(queries: DataFrame, chunks: DataFrame, within: tuple[str, ...] = ("model",), k: int = 40, load: Callable[[], Callable[[list[str]], np.ndarray]] | None = None) -> DataFrame:
    """``query_id, <within>, chunk_id, score, rank``: exact cosine list of queries and chunks with equal ``within`` columns. Null and zero vectors are no hits.

    Chunks have an ``embedding``, or a ``text`` that the model of ``load`` reads where it's scored: vectors that one batch of queries needs once are then neither moved nor written.
    """
    of, parts = "text" if load else "embedding", []
    rows = chunks.where(F.col(of).isNotNull()).select("chunk_id", of, *within)
    for block in blocks_of(queries.where("embedding is not null").select("query_id", "embedding", *within)):
        q = np.stack(block["embedding"].to_list()).astype(float)
        parts.append(best_rows(rows, block.drop(columns="embedding"), _cosine_score(q, load), within, k))
    return _lists(parts, rows, within, k)


def _cosine_score(q: np.ndarray, load: Callable[[], Callable[[list[str]], np.ndarray]] | None) -> Scorer:
    size, loaded = np.linalg.norm(q, axis=1), []

    def score(pdf: pd.DataFrame, own: np.ndarray) -> np.ndarray:
        if load and not loaded:
            loaded.append(load())
        e = loaded[0](pdf["text"].to_list()) if load else np.stack(pdf["embedding"].to_list()).astype(float)
        both = np.linalg.norm(e, axis=1)[:, None] * size[own][None, :]
        return np.where(both > 0, (e @ q[own].T) / np.where(both > 0, both, 1), -np.inf)

    return score


def _lists(parts: list[DataFrame], rows: DataFrame, within: tuple[str, ...], k: int) -> DataFrame:
    return top(reduce(DataFrame.union, parts), within, k) if parts else top(rows.limit(0).selectExpr("chunk_id as query_id", *within, "chunk_id", "0d as score"), within, k)


def _tallied(number: dict[str, int], columns: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``<columns>, dl, terms, tfs`` of every row (<columns>, text) with words: how many it has, and how often each of those that have a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = max(len(number), 1)
        for whole in batches:
            for batch in (whole.slice(at, ROWS) for at in range(0, len(whole), ROWS)):
                dl, pairs = np.zeros(len(batch), np.int64), [(np.empty(0, np.int64), np.empty(0, np.int64))]
                for row, at, words in T.word_places(batch.column("text").to_pylist()):
                    dl += np.bincount(row, minlength=len(dl))
                    term = np.array([number.get(w, -1) for w in words], np.int64)[at]
                    pairs.append(np.unique((row * base + term)[term >= 0], return_counts=True))
                found, tf = (np.concatenate(x) for x in zip(*pairs, strict=True))
                row, term = np.divmod(found, base)
                ends = pa.array(np.searchsorted(row, np.arange(len(batch) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (term, tf)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(dl), *lists], names=[*columns, "dl", "terms", "tfs"]).filter(pa.array(dl > 0))

    return run


def bm25(queries: DataFrame, chunks: DataFrame, within: tuple[str, ...] = (), k: int = 40) -> DataFrame:
    """``query_id, <within>, chunk_id, score, rank``: the lists that ``postings.Index.search`` gives, without an index, for questions that are asked of a corpus once. Ids of chunks are unique.

    A chunk is read once for a block of queries: its length and how often it has their words are staged, which tells how many chunks have a word. Nothing is shuffled but that
    count and every task's k best of a query. A word that many of the block ask is a column of a matrix, others are added up by pair of row and query.
    """
    rows, parts = chunks.where("text is not null").select("chunk_id", *within, "text"), []
    columns, kinds, words = ["chunk_id", *within], dict(rows.dtypes), re.compile(T.WORD3).findall
    for block in blocks_of(queries.where("text is not null").select("query_id", "text", *within)):
        asked = [sorted({w.lower() for w in words(text)}) for text in block["text"]]
        number = {w: i for i, w in enumerate(sorted(set().union(*asked)))}
        held = staged(rows.mapInArrow(_tallied(number, columns), ", ".join([*[f"{c} {kinds[c]}" for c in columns], "dl long, terms array<int>, tfs array<int>"])), "tallies")
        whole, df = held.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("mean")).first(), np.zeros(len(number))
        for r in held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect():
            df[r["term"]] = r["df"]
        idf = np.log(1 + (whole["n"] - df + 0.5) / (df + 0.5))
        parts.append(best_rows(held, block.drop(columns="text"), _bm25_score([np.array([number[w] for w in ws], np.int64) for ws in asked], idf, whole["mean"]), within, k))
    return _lists(parts, rows, within, k)


def _bm25_score(asked: list[np.ndarray], idf: np.ndarray, mean: float) -> Scorer:
    """Of rows (dl, terms, tfs) and queries by the numbers of their words."""
    made = {}

    def prepared(own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The column of each word that many ask, a matrix of such words and queries; of others the number of queries, where they begin, and the queries."""
        term, query = np.concatenate([asked[j] for j in own]), np.repeat(np.arange(len(own)), [len(asked[j]) for j in own])
        order = np.argsort(term, kind="stable")
        term, query = term[order], query[order]
        many = np.bincount(term, minlength=len(idf))
        often = np.flatnonzero(many > max(4, len(own) // 32))
        column = np.full(len(idf), -1)
        column[often] = np.arange(len(often))
        ask, dense = np.zeros((len(often), len(own))), column[term] >= 0
        ask[column[term[dense]], query[dense]] = 1
        return column, ask, np.where(column < 0, many, 0), np.cumsum(many) - many, query

    def score(part: pd.DataFrame, own: np.ndarray) -> np.ndarray:
        if own[0] not in made:
            made[own[0]] = prepared(own)
        column, ask, many, begin, query = made[own[0]]
        size = np.fromiter(map(len, part["terms"]), np.int64, len(part))
        row, term, tf = np.repeat(np.arange(len(part)), size), np.concatenate(part["terms"].to_list()), np.concatenate(part["tfs"].to_list())
        given = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * part["dl"].to_numpy()[row] / mean))
        dense, often = np.zeros((len(part), len(ask))), column[term] >= 0
        dense[row[often], column[term[often]]] = given[often]
        found = dense @ ask
        for at in range(0, len(term), POSTINGS):
            n = many[term[at : at + POSTINGS]]
            i = np.repeat(np.arange(at, at + len(n)), n)
            of = query[begin[term[i]] + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)]
            found += np.bincount(row[i] * len(own) + of, weights=given[i], minlength=found.size).reshape(found.shape)
        return np.where(found > 0, found, -np.inf)

    return score


_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


def _windows(codes: np.ndarray) -> Iterator[np.ndarray]:
    """For k = 0, 1, ...: a hash of the 2 ** k code points from every place, made from the one before."""
    h, width = (codes.astype(np.uint64) + _MIX[2]) * _MIX[0], 1
    while len(h):
        h ^= h >> np.uint64(29)
        yield h
        h, width = h[:-width] * _MIX[1] + (h[width:] ^ _MIX[2]) * _MIX[0], 2 * width


def _bit(h: np.ndarray, width: int, size: int) -> np.ndarray:
    """Where a hash stands in a bitmap of ``size`` words of 64 bits."""
    x = (h ^ np.uint64(width)) * _MIX[2]
    return ((x ^ (x >> np.uint64(31))) * _MIX[0] >> np.uint64(20)) % np.uint64(64 * size)


def _ends(first: np.ndarray, last: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """A hash of a needle by its first and its last 2 ** k code points, which overlap or touch, so nothing is left out."""
    return first * _MIX[2] ^ (last + np.asarray(length, np.uint64)) * _MIX[1]


def _spans(texts: list[str], most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``codes, starts, numbers`` of texts end to end, about ``most`` code points at a time; a text is never cut."""
    held, n = [], 0
    for i, text in enumerate(texts):
        held.append(i)
        n += len(text)
        if n >= most or i == len(texts) - 1:
            starts = np.cumsum([0, *(len(texts[j]) for j in held)])
            yield np.frombuffer("".join(texts[j] for j in held).encode("utf-32-le", "surrogatepass"), np.uint32), starts, np.array(held)
            held, n = [], 0


def _marked(size: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A bitmap of needles: for each its first 2 ** k code points, the largest power that it has, and its ``_ends``."""

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(size, np.uint64)
        for pdf in batches:
            for codes, starts, _ in _spans(pdf["needle"].tolist()):
                length = np.diff(starts)
                for k, h in enumerate(_windows(codes)):
                    own = (length >> k) == 1
                    first, last = h[starts[:-1][own]], h[(starts[1:] - (1 << k))[own]]
                    for at in (_bit(first, k, size), _bit(_ends(first, last, length[own]), 64 + k, size)):
                        np.bitwise_or.at(bits, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        full = np.flatnonzero(bits)
        yield pd.DataFrame({"word": full, "bits": bits[full].view(np.int64)})

    return mark


def _candidates(bits: np.ndarray, lengths: list[int]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """``doc, needle``: pieces of every text that the bitmap lets through, each once; all needles are among them."""
    has = lambda at: bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1) == 1

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            docs, texts = pdf["doc"].to_numpy(), pdf["text"].tolist()
            for codes, starts, numbers in _spans(texts):
                found = set()
                for k, h in enumerate(_windows(codes)):
                    if lengths[-1] < 1 << k:
                        break
                    wanted = [n for n in lengths if n >> k == 1]
                    places = np.flatnonzero(has(_bit(h, k, len(bits)))) if wanted else np.empty(0, np.int64)
                    text = np.searchsorted(starts, places, "right") - 1
                    for n in wanted:
                        inside = places + n <= starts[text + 1]
                        at, own = places[inside], text[inside]
                        hit = has(_bit(_ends(h[at], h[at + n - (1 << k)], n), 64 + k, len(bits)))
                        found.update((numbers[t], texts[numbers[t]][p : p + n]) for p, t in zip((at[hit] - starts[own[hit]]).tolist(), own[hit].tolist(), strict=True))
                yield pd.DataFrame({"doc": docs[[i for i, _ in found]] if found else docs[:0], "needle": [piece for _, piece in found]}).astype({"needle": object})

    return find


def containing(docs: DataFrame, id_col: str, text_col: str, needles: DataFrame, needle_id: str, needle_col: str, size: int = 1 << 20) -> DataFrame:
    """``<id_col>, <needle_id>`` of all pairs whose text contains the needle as it stands. Empty needles are in no text.

    Each text is read once, however many needles there are: a bitmap of ``size`` words of 64 bits, of a size that doesn't grow, tells which of its pieces
    can be needles, by hashes of windows; these pieces meet the needles by equality. A full bitmap lets more pieces through, with the same result.
    """
    wanted = staged(needles.where(F.length(needle_col) > 0).select(F.col(needle_id).alias("query_id"), F.col(needle_col).alias("needle")), "needles")
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    lengths = sorted(r["n"] for r in wanted.select(F.char_length("needle").alias("n")).distinct().collect())
    marks = wanted.select("needle").mapInPandas(_marked(size), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    bits = np.zeros(size, np.uint64)
    bits[marks["word"].to_numpy(np.int64)] = marks["bits"].to_numpy(np.int64).view(np.uint64)
    kind = dict(rows.dtypes)["doc"]
    found = rows.mapInPandas(_candidates(bits, lengths), f"doc {kind}, needle string") if lengths else rows.select("doc", F.col("text").alias("needle")).limit(0)
    return found.join(wanted, "needle").select(F.col("doc").alias(id_col), F.col("query_id").alias(needle_id))
