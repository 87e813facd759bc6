"""Document fingerprints: a Merkle tree over phrases, paragraphs and sections.

A paragraph is a line; its node hashes the whole line (128 bits). A section is a run of paragraphs that ends after
one whose hash is divisible by SECTION (or at a blank line), so an insertion moves one section's border
only; its node hashes its paragraphs' nodes, the root the sections' nodes: equal roots, equal texts. Where roots
differ, ``locate_edits`` follows the differing branches down to the paragraphs. Below the paragraphs lie phrases of up
to six words, so that an edit inside one long line still leaves most leaves equal.

Fingerprint: ``root|sections|paragraphs|phrases``, hex: the whole tree. A section or paragraph is 16 digits of
hash and 8 of how many children it has, a phrase 8 digits; children come in the order of their parents.
Likeness: 1 for equal roots; else the share of common phrases, counted as often as they occur, of both texts'
phrases. Equal sections, then equal paragraphs leave in pairs; only phrases below differing paragraphs are
compared. Where roots differ at least one phrase counts as different, so it is 1 for equal texts only.

Nulls and edge cases: a null text is empty, with one empty paragraph; the next document is the next row by
(id, text), a null id coming first; after the last row comes the first; a single row is its own next one;
repeated rows follow one another; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.common import ids_and_text

SECTION = 4
_NODE = np.dtype([("hash", ">u8"), ("children", ">u4")])
_PHRASE = re.compile(r"(?:[^\s.,;:!?]{1,40}\s*){1,6}[.,;:!?]*|[.,;:!?]+")
Levels = tuple[np.ndarray, np.ndarray, np.ndarray]


class Tree:
    """Nodes of one text: ``root`` (hex) and ``levels``: sections, paragraphs, phrases."""

    __slots__ = ("text", "root", "levels")

    def __init__(self, text: str):
        self.text = text
        lines = text.split("\n")
        wide = [xxhash.xxh3_128_digest(x) for x in lines]
        hashes = np.frombuffer(b"".join(wide), ">u8")[::2]
        ends = (hashes % SECTION == 0) | np.array([not x for x in lines])
        ends[-1] = True
        ends = np.flatnonzero(ends) + 1
        starts = [0, *ends[:-1].tolist()]
        nodes = [xxhash.xxh3_128_digest(b"".join(wide[a:b])) for a, b in zip(starts, ends.tolist(), strict=True)]
        self.root = hashlib.blake2b(b"".join(nodes), digest_size=16).hexdigest()
        sections, paragraphs = np.empty(len(nodes), _NODE), np.empty(len(lines), _NODE)
        sections["hash"], sections["children"] = np.frombuffer(b"".join(nodes), ">u8")[::2], np.diff([0, *ends])
        found = [_PHRASE.findall(x) for x in lines]
        paragraphs["hash"], paragraphs["children"] = hashes, [len(x) for x in found]
        self.levels = sections, paragraphs, np.array([xxhash.xxh32_intdigest(x.strip()) for line in found for x in line], ">u4")

    def fingerprint(self) -> str:
        return "|".join((self.root, *(x.tobytes().hex() for x in self.levels)))


def read_fingerprint(fingerprint: str) -> tuple[str, Levels]:
    root, *levels = fingerprint.split("|")
    return root, tuple(np.frombuffer(bytes.fromhex(t), d) for t, d in zip(levels, (_NODE, _NODE, ">u4"), strict=True))


def _unpaired(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which nodes of ``x`` are left when each of ``y`` takes an equal one away."""
    have, left = Counter(y["hash"].tolist()), np.ones(len(x), bool)
    for i, h in enumerate(x["hash"].tolist()):
        if have[h] > 0:
            have[h] -= 1
            left[i] = False
    return left


def differing(a: Levels, b: Levels) -> tuple[np.ndarray, np.ndarray]:
    """Both trees' paragraphs (as masks) under differing sections that differ themselves."""
    below = [np.repeat(_unpaired(x[0], y[0]), x[0]["children"]) for x, y in ((a, b), (b, a))]
    mine, others = (np.flatnonzero(x) for x in below)
    below[0][mine], below[1][others] = _unpaired(a[1][mine], b[1][others]), _unpaired(b[1][others], a[1][mine])
    return below[0], below[1]


def share(a: Levels, b: Levels) -> float:
    """Of two trees with different roots."""
    total = len(a[2]) + len(b[2])
    if not total:
        return 0.0
    (x, n), (y, m) = (np.unique(t[2][np.repeat(mask, t[1]["children"])], return_counts=True) for t, mask in zip((a, b), differing(a, b), strict=True))
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return 1 - max(1, int(n.sum() + m.sum() - 2 * np.minimum(n[i], m[j]).sum())) / total


def likeness(a: str, b: str) -> float:
    """0 to 1, from two fingerprints alone."""
    (ra, x), (rb, y) = read_fingerprint(a), read_fingerprint(b)
    return 1.0 if ra == rb else share(x, y)


def _ranges(mask: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))).reshape(-1, 2)
    return [(int(i), int(j)) for i, j in edges]


def locate_edits(a: str, b: str) -> list[tuple[int, int]]:
    """From two fingerprints: ranges of paragraphs of ``a``'s text under branches that ``b``'s hasn't: [(first, last + 1)]."""
    (ra, x), (rb, y) = read_fingerprint(a), read_fingerprint(b)
    return [] if ra == rb else _ranges(differing(x, y)[0])


def tree_nodes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The trees as a table: ``id, level (root, section, paragraph), first long, last long, node string``."""

    def nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc, text in zip(pdf["id"], pdf["text"], strict=True):
                t = Tree(text)
                sections, paragraphs, _ = t.levels
                last = np.cumsum(sections["children"]).tolist()
                rows = [(doc, "root", 0, len(paragraphs), t.root)] + [(doc, "section", a, b, f"{h:016x}") for a, b, h in zip([0, *last], last, sections["hash"].tolist())]
                rows += [(doc, "paragraph", i, i + 1, f"{h:016x}") for i, h in enumerate(paragraphs["hash"].tolist())]
                yield pd.DataFrame(rows, columns=["id", "level", "first", "last", "node"]).astype({"id": "Int64"})

    return ids_and_text(docs, id_col, text_col).mapInPandas(nodes, "id long, level string, first long, last long, node string")


def edited_text(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many from the start of the following text."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edits string"


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (part, order): each row meets the next one of its part; the last row of a part is only a neighbour."""
    held: tuple | None = None
    near = lambda x, y: 1.0 if x.root == y.root else share(x.levels, y.levels)
    for pdf in batches:
        rows = []
        for part, doc, text in zip(pdf["part"], pdf["id"], pdf["text"], strict=True):
            now = (part, doc, Tree(text))
            if held is not None and held[0] == part:
                _, at, own = held
                edited = edited_text(own.text, text)
                new = Tree(edited)
                where = [] if own.root == new.root else _ranges(differing(own.levels, new.levels)[0])
                rows.append((at, len(own.text), hashlib.sha256(edited.encode("utf-8")).hexdigest(), own.fingerprint(), new.fingerprint(), near(own, new), near(own, now[2]), ",".join(f"{a}-{b}" for a, b in where)))
            held = now
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _OUT.split(", ")]).astype({"doc_id": "Int64", "n_chars": "int64", "near_edited": "float64", "near_next": "float64"})


def fingerprints(docs: DataFrame, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's fingerprint, its likeness to its edited text and to the next document, and the paragraph ranges that the edit changed.

    Texts move once. Range borders come from the ids alone, and a row finds its range by binary search; the first document of a
    range (one each, so as many as there are partitions) is also sent to the range before, where it is the last one's neighbour.
    """
    texts, spark = ids_and_text(docs, id_col, text_col), docs.sparkSession
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    borders = sorted(set(texts.approxQuantile("id", [i / parts for i in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    if borders:
        ranges = Bucketizer(splits=[-float("inf"), *borders, float("inf")], inputCol="at", outputCol="range")
        placed = ranges.transform(texts.withColumn("at", F.coalesce("id", F.lit(0)).cast("double")))
        dealt = placed.select(F.when(F.col("id").isNull(), 0).otherwise(F.col("range").cast("int")).alias("part"), "id", "text")
    else:
        dealt = texts.select(F.lit(0).alias("part"), "id", "text")
    heads = dealt.groupBy("part").agg(F.min("id").alias("id")).orderBy("part").collect()
    before = spark.createDataFrame([(h["part"], heads[i - 1]["part"]) for i, h in enumerate(heads)], "part int, before int")
    # Only rows with a head's id (or none) can be the least of their part by (id, text).
    least = F.col("id").isin([h["id"] for h in heads if h["id"] is not None]) | F.col("id").isNull()
    first = dealt.where(least).groupBy("part").agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), "id", "text")).alias("h"))
    again = first.join(F.broadcast(before), "part").select(F.col("before").alias("part"), F.lit(1).alias("tail"), "h.id", "h.text")
    laid = dealt.select("part", F.lit(0).alias("tail"), "id", "text").union(again).repartitionById(parts, "part")
    return laid.sortWithinPartitions("part", "tail", F.col("id").asc_nulls_first(), "text").select("part", "id", "text").mapInPandas(_walk, _OUT)
