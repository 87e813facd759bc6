"""Near-duplicate classes by a chosen-path set similarity join.

A document's set holds its distinct five-word shingles (64-bit hashes of them). Documents with equal
sets are collapsed into one class first. Every class has a minwise signature; a tree sends a class from a
node to the children named by the tokens at the positions which that node selects, so two sets of
similarity s stay together along one edge with probability s. ``trees`` independent trees are grown. A root is
named by the tokens at two positions, so texts that share a common line or passage and no more rarely meet;
deeper nodes have two children each. A pair of similarity 0.75 meets in a root with probability 0.5625 and is lost below
it with probability at most 1/9 at any depth, so one tree loses it with probability at most 1/2 and 26 trees with at most
1.5e-8. Pairs must also agree in LIKELY of their signature positions
before their sets are compared, which loses 1.0e-7 of the pairs at 0.75 (binomial, 64 positions).

Links are confirmed on full 64-bit sets before anything is built on them. Small nodes are compared pair by
pair. In a crowded node every member is first held against the node's least member: that unites a mass of
near copies with one pair a member. A node whose members are united is done; only nodes that still mix
components go on. Up to ``block`` members meet in one task: first their signatures (a byte a position), which leave
the members with a likely partner in another component, then the sets of these, across components only, which gives at
most one link a member. Larger nodes branch again. What is still larger at the last level is compared in pairs of
chunks, so nothing is capped; so are members of more than ``weight`` shingles together.

Sets are made for the documents that need them only, by one plan at every size: a bitmap of WORDS_OF_BITS words of 64 bits, so of
a size that doesn't grow, tells every task which ids can be needed; the texts of these alone meet the ids themselves. What share of other
texts the bitmap lets through is at most the needed ids over its bits; a full one lets all through, with the same result.

Hot groups: a member that many others are held against is replicated to slices of SLICE pairs each; counts
and least members are partly aggregated before the shuffle; joins on a node's or a component's number carry
narrow rows and are split by Spark's skew handling.

Nulls: a null text is empty; an empty set is linked with nothing; a null id is never linked, is kept and
has a null class. Repeated ids and rows: one output row for each input row; an id with several texts is
linked by any of them. An empty table gives an empty result; further columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.common import ids_and_text, stage

WORDS, POSITIONS, ROOT, BRANCHES, LIKELY, SLICE, WORDS_OF_BITS = 5, 64, 2, 2, 0.45, 2000, 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _splitmix(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * _MIX
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


_FLIP, _ODD = _splitmix(POSITIONS, 1), _splitmix(POSITIONS, 1000) | np.uint64(1)


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's five-word shingles; bytes.split() knows the same blanks as the contract."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b"\n".join(words), seed=7)] if words else [], dtype=np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter(map(digest, words), np.uint64, len(words))
    n = len(h) - WORDS + 1
    acc = np.zeros(n, np.uint64)
    for k in range(WORDS):
        acc = (acc ^ h[k : k + n]) * _MIX
        acc ^= acc >> np.uint64(29)
    return np.unique(acc)


def signature(tokens: np.ndarray) -> np.ndarray:
    """The least 32-bit value of every permutation."""
    low = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(tokens), 512):
        np.minimum(low, ((tokens[at : at + 512, None] ^ _FLIP) * _ODD).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _key(tokens: np.ndarray) -> tuple[int | None, int | None]:
    """128 bits that name a set, as two signed numbers."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(tokens.tobytes()), np.int64).tolist()) if len(tokens) else (None, None)


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        n, key, sig = [], [], []
        for text in pdf["text"]:
            s = shingles(text)
            n.append(len(s))
            key.append(_key(s))
            sig.append(signature(s) if len(s) else None)
        whole = lambda at: pd.array([k[at] for k in key], dtype="Int64")  # noqa: E731  (a missing key would make floats of all)
        yield pd.DataFrame({"id": pdf["id"].astype("Int64"), "n_shingles": n, "key": whole(0), "key2": whole(1), "sig": pd.Series(sig, dtype=object)})


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sets of classes, from the texts of their least ids; another text of the same id is passed over."""
    for pdf in batches:
        made = [shingles(t) for t in pdf["text"]]
        own = np.array([_key(s)[0] == key for s, key in zip(made, pdf["key"], strict=True)], bool)
        yield pd.DataFrame({"c": pdf["c"].to_numpy()[own], "tokens": pd.Series([s.view(np.int64) for s, ok in zip(made, own, strict=True) if ok], dtype=object)})


def connected_components(edges: DataFrame) -> DataFrame:
    """``id, root`` for every id of ``edges`` (a, b): root is the smallest id reachable. Large-star and small-star rounds."""
    work, before = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()), None
    while True:
        both = work.union(work.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.where("m < u")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        work = stage(large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least).distinct())
        now = work.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return work.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before = now


def _alike(percent: int) -> F.Column:
    """Of sides a and b: sizes that admit ``percent`` (no pair is lost by that), and signatures that agree in at least LIKELY of the positions."""
    agree = F.expr(f"aggregate(zip_with(mark_a, mark_b, (x, y) -> int(x = y)), 0, (s, x) -> s + x) / {POSITIONS}D") >= LIKELY
    return (100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b")) & agree


def _meet(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join of two sides that grow with the corpus: one plan at every size, so neither is ever sent to all tasks, however small it is in a test."""
    return left.join(right.hint("merge"), on, how)


def _side(rows: DataFrame, side: str) -> DataFrame:
    return rows.withColumnsRenamed({"c": side, "size": f"size_{side}", "mark": f"mark_{side}"})


def _likely(marks: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs that ``_alike`` admits. ``marks``: c, size, mark."""
    return _meet(_meet(pairs.distinct(), _side(marks, "a"), "a"), _side(marks, "b"), "b").where(_alike(percent)).select("a", "b")


def _likely_within(rows: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """``_likely`` of all pairs inside small nodes (c, node): signatures go to the nodes, so pairs that don't agree are never moved."""
    signed = _meet(rows, marks, "c")
    return _meet(_side(signed, "a"), _side(signed, "b"), "node").where("a < b").where(_alike(percent)).select("a", "b").distinct()


def likely_across(comp: np.ndarray, sizes: np.ndarray, marks: np.ndarray, percent: int) -> np.ndarray:
    """Which members have a partner in another component that ``_alike`` admits."""
    out, (_, group) = np.zeros(len(comp), bool), np.unique(comp, return_inverse=True)
    others = np.flatnonzero(group != np.bincount(group).argmax())  # the largest component's members only meet these
    least = int(np.ceil(LIKELY * marks.shape[1]))
    for at in range(0, len(others), 64):
        rows = others[at : at + 64]
        agree = (marks[rows, None, :] == marks[None, :, :]).view(np.uint8).sum(axis=2, dtype=np.uint8) >= least
        agree &= (group[rows, None] != group[None, :]) & (100 * np.minimum(sizes[rows, None], sizes[None, :]) >= percent * np.maximum(sizes[rows, None], sizes[None, :]))
        out[rows] |= agree.any(axis=1)
        out |= agree.any(axis=0)
    return out


def _close(rows: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The ``rows`` (c, comp, node) that have a likely partner in another component of their node, with ``size``."""

    def close(pdf: pd.DataFrame) -> pd.DataFrame:
        alike = likely_across(pdf["comp"].to_numpy(), pdf["size"].to_numpy(), np.stack(pdf["mark"].to_list()).astype(np.int8), percent)
        return pdf.loc[alike, ["c", "size", "comp", "node"]]

    return _meet(rows.select("c", "comp", "node"), marks, "c").groupBy("node").applyInPandas(close, "c long, size long, comp long, node long")


def _confirm(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b; staged) with 100 * |intersection| >= percent * |union| on the full sets. An ``a`` of many pairs is replicated to slices."""
    slices = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("slices"))
    # both sides meet ``sets`` as they are, columns unnamed anew, so that Spark moves the sets once and reads that shuffle twice
    own = _meet(slices.withColumnRenamed("a", "c"), sets, "c")
    left = own.select(F.col("c").alias("a"), F.col("tokens").alias("x"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    dealt = _meet(pairs, slices, "a").select("a", F.col("b").alias("c"), F.pmod(F.xxhash64("b"), F.col("slices").cast("long")).cast("int").alias("slice"))
    both = _meet(_meet(dealt, sets, "c").select("a", "slice", F.col("c").alias("b"), F.col("tokens").alias("y")), left, ["a", "slice"])
    common = F.size(F.array_intersect("x", "y"))
    return both.withColumn("common", common).where(100 * F.col("common") >= percent * (F.size("x") + F.size("y") - F.col("common"))).select("a", "b").distinct()


def links_across(comp: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between members of different components, compared exhaustively; each one unites two components, so there are fewer than members.

    Members of the largest component aren't compared among themselves: all others are held against everyone.
    """
    _, group = np.unique(comp, return_inverse=True)
    most = np.bincount(group).argmax()
    sizes = np.array([len(x) for x in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    mark, out = np.zeros(int(code.max()) + 1, np.int32), []
    for i in np.flatnonzero(group != most):
        own = code[starts[i] : starts[i + 1]]
        mark[own] = 1
        common = np.add.reduceat(mark[code], starts[:-1])
        mark[own] = 0
        for j in np.flatnonzero((100 * common >= percent * (sizes[i] + sizes - common)) & (group != group[i])):
            if group[j] != group[i]:
                out.append((i, j))
                group[group == group[j]] = group[i]
    return out


def _compare(percent: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("c")
        ids, found = pdf["c"].to_numpy(), links_across(pdf["comp"].to_numpy(), list(pdf["tokens"]), percent)
        return pd.DataFrame({"a": [min(ids[i], ids[j]) for i, j in found], "b": [max(ids[i], ids[j]) for i, j in found]}, dtype="int64")

    return compare


def _crowds(level: DataFrame) -> DataFrame:
    """``level`` (c, node) with each node's members ``n`` and least member ``lead``; nodes of one member go."""
    return _meet(level, level.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("lead")).where("n > 1"), "node")


def _mixed(level: DataFrame, comps: DataFrame) -> DataFrame:
    """The rows of nodes whose members aren't all of one component, with ``comp``."""
    placed = _meet(level.drop("comp"), comps.select(F.col("id").alias("c"), "root"), "c", "left").withColumn("comp", F.coalesce("root", "c")).drop("root")
    return _meet(placed, placed.groupBy("node").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("node"), "node", "left_semi")


def _cut(rows: DataFrame, block: int, weight: int) -> DataFrame:
    """``rows`` (c, size, comp, node) of nodes beyond ``block`` members or ``weight`` shingles dealt to pairs of chunks; each pair is a node of its own."""
    over = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("w"))
    chunks = F.when((F.col("n") <= block) & (F.col("w") <= weight), 1).otherwise(F.greatest(F.ceil(F.col("n") * 2 / block), F.ceil(F.col("w") * 2 / weight))).cast("int")
    dealt = _meet(rows, over.select("node", chunks.alias("chunks")), "node").withColumn("mine", F.pmod(F.xxhash64("c"), F.col("chunks").cast("long")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    return dealt.withColumn("other", other).select("c", "comp", F.xxhash64("node", F.least("mine", "other"), F.greatest("mine", "other")).alias("node"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, trees: int = 26, leaf: int = 24, block: int = 2000, weight: int = 2_000_000, depth: int = 8, bit_words: int = WORDS_OF_BITS) -> DataFrame:
    """``id, n_shingles, component_id, kept`` for every row of ``docs``."""
    texts = ids_and_text(docs, id_col, text_col)
    signed = stage(texts.mapInPandas(_sign, "id long, n_shingles long, key long, key2 long, sig array<int>"))
    known = signed.where("key is not null and id is not null")
    first = F.min(F.struct("id", "n_shingles", "sig")).alias("r")
    mark = F.transform("r.sig", lambda x: (F.pmod(x, F.lit(256)) - 128).cast("tinyint")).alias("mark")
    classes = stage(known.groupBy("key", "key2").agg(first).select("key", "key2", "r.id", F.col("r.n_shingles").alias("size"), "r.sig", mark, F.monotonically_increasing_id().alias("c")))
    marks = classes.select("c", "size", "mark")

    keys = F.array(*[F.xxhash64(F.lit(t), *[F.col("sig")[(ROOT * t + p) % POSITIONS] for p in range(ROOT)]) for t in range(trees)])
    level = stage(_crowds(classes.select("c", F.explode(keys).alias("node"))))
    stars = lambda rows: rows.where("c <> lead").select(F.col("lead").alias("a"), F.col("c").alias("b"))
    small, crowd = level.where(F.col("n") <= leaf).select("c", "node"), level.where(F.col("n") > leaf)
    likely = stage(_likely_within(small, marks, percent).union(_likely(marks, stars(crowd), percent)).distinct())

    def sets_of(ids: DataFrame) -> DataFrame:
        wanted = stage(_meet(ids, classes.select("c", "id", "key"), "c"))
        placed = lambda rows: rows.withColumn("bit", F.pmod(F.xxhash64("id"), F.lit(64 * bit_words))).withColumn("word", F.floor(F.col("bit") / 64)).withColumn("bit", (F.col("bit") % 64).cast("int"))
        bitmap = placed(wanted.select("id")).groupBy("word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("bits"))
        possible = placed(texts).join(F.broadcast(bitmap), "word").where(F.getbit("bits", F.col("bit")) == 1)
        needed = _meet(possible.select("id", "text"), wanted, "id")
        return stage(needed.select("c", "key", "text").mapInPandas(_sets, "c long, tokens array<bigint>"))

    paired = stage(likely.select("a").union(likely.select("b")).distinct().withColumnRenamed("a", "c"))
    sets = sets_of(paired)
    named = classes.select("key", "key2", "c")
    several = known.join(named, ["key", "key2"]).groupBy("id").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a <> b")
    again = known.select("id", "key", "key2").join(several.select("id", "a"), "id").join(named.withColumnRenamed("c", "b"), ["key", "key2"]).where("a <> b").select("a", "b")
    comps = connected_components(_confirm(sets, likely, percent).union(again))
    crowd = stage(_mixed(crowd, comps))
    middle, large = stage(_close(crowd.where(F.col("n") <= block), marks, percent)), crowd.where(F.col("n") > block)
    others = stage(middle.select("c").union(large.select("c")).distinct().join(paired, "c", "left_anti"))
    if not others.isEmpty():
        sets = sets.union(sets_of(others))
    for step in range(depth):
        more = not large.isEmpty()
        if more and step == depth - 1:
            middle = middle.union(large.join(marks.select("c", "size"), "c").select("c", "size", "comp", "node"))
        found = stage(_meet(_cut(middle, block, weight), sets, "c").groupBy("node").applyInPandas(_compare(percent), "a long, b long"))
        if not more or step == depth - 1:
            break
        chosen = [F.pmod(F.xxhash64("node", F.lit(b)), F.lit(POSITIONS)).cast("int") for b in range(BRANCHES)]
        children = F.explode(F.array_distinct(F.array(*[F.xxhash64("node", p, F.col("sig")[p]) for p in chosen])))
        crowd = stage(_crowds(stage(large.select("c", "node").join(classes.select("c", "sig"), "c").select("c", children.alias("node")))))
        crowd = stage(_mixed(crowd, comps))
        found = found.union(_confirm(sets, stage(_likely(marks, stars(crowd), percent)), percent))
        comps = connected_components(comps.select(F.col("id").alias("a"), F.col("root").alias("b")).union(found))
        crowd = stage(_mixed(crowd, comps))
        middle, large = stage(_close(crowd.where(F.col("n") <= block), marks, percent)), crowd.where(F.col("n") > block)
    if not found.isEmpty():
        comps = connected_components(comps.select(F.col("id").alias("a"), F.col("root").alias("b")).union(found))

    rooted = _meet(classes.select("key", "key2", "c", F.col("id").alias("first")), comps.withColumnRenamed("id", "c"), "c", "left").select("key", "key2", "first", F.coalesce("root", "c").alias("root"))
    members = stage(_meet(rooted, rooted.groupBy("root").agg(F.min("first").alias("component")), "root").select("key", "key2", "component"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return _meet(signed.select("id", "n_shingles", "key", "key2"), members, ["key", "key2"], "left").select("id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
