"""Best-fit decreasing packing of tokenised documents into fixed windows.

Overlong documents are first cut into full windows; only their remainders and the short documents are
packed. A task sorts its pieces by length, longest first, and puts each into the tightest open window; a
segment tree indexed by remaining capacity finds that window in ten steps. Tasks pack separate groups of
documents, dealt by a hash of the id: with some ten thousand pieces in a group, what could be gained by
packing across groups is far below one percent of a window for each document. Only piece lengths are
shuffled, never token ids.

Nulls and edge cases: a null text is empty and gives the end token alone; a null id is packed like any
other; repeated rows are packed once each; an empty table gives an empty result; further columns are not read.
A run of white space that is too long for the rank file's regular expression goes to the tokenizers file.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpuslake.llm.common import ids_and_text, stage

WINDOW, END, GROUP_DOCS = 1024, 0, 20_000
SEQUENCES_PER_GROUP = 1 << 40
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


@lru_cache(2)
def encoding(path: str) -> tiktoken.Encoding:
    """The byte_bpe_50k vocabulary. Its rank file gives the same ids as its tokenizers file (tested), several times as fast."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": 50256})


@lru_cache(2)
def whole_tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def token_ids(text: str, path: str) -> np.ndarray:
    """The text's ids and the end token, as little-endian 32-bit numbers. ``path``: the rank file; the tokenizers file lies beside it."""
    try:
        ids = encoding(path).encode(text, allowed_special="all")
    except ValueError:  # white space beyond the stack of the rank file's regular expression
        ids = whole_tokenizer(path.removesuffix(".tiktoken") + ".json").encode(text, add_special_tokens=False).ids
    return np.array([*ids, END], dtype="<u4")


class OpenWindows:
    """Windows by remaining capacity, under a segment tree of how many each capacity has."""

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1).bit_length()
        self.tree = [0] * (2 * self.size)
        self.at: list[list[tuple[int, int]]] = [[] for _ in range(self.size)]

    def _count(self, room: int, step: int) -> None:
        i = room + self.size
        while i:
            self.tree[i] += step
            i >>= 1

    def put(self, room: int, window: tuple[int, int]) -> None:
        self.at[room].append(window)
        self._count(room, 1)

    def tightest(self, need: int) -> int | None:
        """The least capacity of at least ``need`` that an open window has."""
        i = need + self.size
        if self.tree[i]:
            return need
        while i > 1 and (i & 1 or not self.tree[i + 1]):
            i >>= 1
        if i <= 1:
            return None
        i += 1
        while i < self.size:
            i = 2 * i if self.tree[2 * i] else 2 * i + 1
        return i - self.size

    def take(self, room: int) -> tuple[int, int]:
        self._count(room, -1)
        return self.at[room].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """For each piece its window and offset. Equal lengths keep their order."""
    windows, where, offsets, n = OpenWindows(capacity), [0] * len(lengths), [0] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[i]
        room = windows.tightest(need)
        if room is None:
            window, room, n = n, capacity, n + 1
        else:
            window = windows.take(room)
        where[i], offsets[i] = window, capacity - room
        if room > need:
            windows.put(room - need, window)
    return where, offsets


def pieces(docs: DataFrame, vocabulary: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents cut into full windows and a remainder: PIECES."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["id"], pdf["text"], strict=True):
                ids = token_ids(text, vocabulary)
                for at in range(0, len(ids), window):
                    part = ids[at : at + window]
                    rows.append((doc, at, len(part), zlib.crc32(part.tobytes()), len(ids)))
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"]).astype({"doc_id": "Int64"})

    return ids_and_text(docs, id_col, text_col).mapInPandas(cut, PIECES)


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """PIECES with ``sequence_id long, offset long``: where each piece lies."""
    cut = stage(pieces(docs, vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), window, id_col, text_col))
    groups = max(1, cut.count() // GROUP_DOCS)

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
        where, offsets = best_fit_decreasing(pdf["length"].tolist(), window)
        first = int(pdf["bucket"].iloc[0]) * SEQUENCES_PER_GROUP
        return pdf.drop(columns="bucket").assign(sequence_id=np.array(where, np.int64) + first, offset=offsets).astype({"doc_id": "Int64"})

    # The start of a piece takes part in the hash: a document of any length is spread over all groups.
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)).cast("int"))
    return dealt.groupBy("bucket").applyInPandas(place, PIECES + ", sequence_id long, offset long")


def sequences(docs: DataFrame, packed: DataFrame, vocabulary: str | None = None, window: int = WINDOW, pad: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The packed windows themselves: ``sequence_id, input_ids array<int>``, padded to ``window``. Ids must be unique."""
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc, text in zip(pdf["id"], pdf["text"], strict=True):
                ids = token_ids(text, path).astype(np.int32)
                parts = [ids[at : at + window] for at in range(0, len(ids), window)]
                yield pd.DataFrame({"doc_id": [doc] * len(parts), "start": range(0, len(ids), window), "ids": parts})

    tokens = ids_and_text(docs, id_col, text_col).mapInPandas(cut, "doc_id long, start long, ids array<int>")
    laid = packed.join(tokens, ["doc_id", "start"]).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    flat = laid.select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"))
    return flat.select("sequence_id", F.concat("ids", F.array_repeat(F.lit(pad), F.lit(window) - F.size("ids"))).alias("input_ids"))
