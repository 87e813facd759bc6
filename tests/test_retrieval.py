"""Ranked lists against brute force, fusion, slots, entities and graph hits on literal rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslake.functions import text as T
from corpuslake.operators import blocks as K
from corpuslake.operators import graph as G
from corpuslake.operators import ivf as N
from corpuslake.operators import models as M
from corpuslake.operators import postings as I
from corpuslake.operators import retrieval as R
from corpuslake.plans import search


def words(t):
    return [w.lower() for w in re.findall(r"[A-Za-z][A-Za-z0-9]{2,}", t or "")]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(5)
    pool = ["river", "stone", "river bank", "a", "Tree", "of", "leaf"]
    rows = [(i, " ".join(rng.choice(pool, rng.integers(0, 9))), [float(x) for x in rng.integers(-2, 3, 4)], int(i % 2)) for i in range(120)]
    rows += [(120, None, None, 0), (121, "river", [0.0] * 4, 1)]
    return rows, spark.createDataFrame(rows, "chunk_id long, text string, embedding array<double>, model int").repartition(5)


@pytest.mark.parametrize("size", [2, 1000])
def test_lists_equal_brute_force_in_any_blocks(spark, corpus, monkeypatch, tmp_path, size):
    rows, chunks = corpus
    asked = [(1, "River stone", [1.0, 0.0, 1.0, 0.0], 0), (2, "leaf leaf tree", [0.0, 1.0, 0.0, 0.0], 1), (3, "of a", [0.0] * 4, 1), (4, None, None, 0)]
    queries = spark.createDataFrame(asked, "query_id long, text string, embedding array<double>, model int")
    monkeypatch.setattr(K, "blocks_of", lambda q, s=size, _old=K.blocks_of: _old(q, size))
    monkeypatch.setattr(K, "ROWS", 7)
    known = [(i, words(t)) for i, t, *_ in rows if words(t)]
    mean, df = sum(len(w) for _, w in known) / len(known), Counter(x for _, w in known for x in set(w))
    want = set()
    for q, text, *_ in asked:
        scored = []
        for i, w in known:
            s = sum(math.log(1 + (len(known) - df[x] + 0.5) / (df[x] + 0.5)) * w.count(x) * 2.2 / (w.count(x) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for x in set(words(text)) if x in w)
            scored += [(-round(s, 6), i)] * (s > 0)
        want |= {(q, i, rank) for rank, (_, i) in enumerate(sorted(scored)[:10], 1)}
    index = I.Index(str(tmp_path / "index"))
    index.add(chunks.where("chunk_id < 40"), 1).add(chunks.where("chunk_id >= 40"), 2).add(chunks, 3).drop(spark, 3)
    assert {(r["query_id"], r["chunk_id"], r["rank"]) for r in index.search(queries, 10).collect()} == want
    assert index.search(queries.limit(0)).count() == 0
    plan = index.search(queries)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and not re.search("Python|Pandas|Arrow", plan)
    want = set()
    for q, _, e, m in asked:
        if e and any(e):
            scored = sorted((-round(float(np.dot(e, v) / np.linalg.norm(e) / np.linalg.norm(v)), 6), i) for i, _, v, n in rows if v and any(v) and n == m)
            want |= {(q, i, rank) for rank, (_, i) in enumerate(scored[:10], 1)}
    assert {(r["query_id"], r["chunk_id"], r["rank"]) for r in K.cosine(queries, chunks, k=10).collect()} == want
    assert K.cosine(queries, chunks.limit(0)).count() == 0


@pytest.mark.parametrize("block", [3, 4096])
def test_sums_of_a_chunk_stay_in_its_task(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(I, "QUERIES", block)
    rng = np.random.default_rng(3)
    pool = [f"word{c}" for c in "abcdefghijkl"]
    rows = [(i, " ".join(rng.choice(pool, 6)), "IN" if i % 3 else "INTL") for i in range(400)]
    chunks = spark.createDataFrame(rows, "chunk_id long, text string, jurisdiction string").repartition(4)
    index = I.Index(str(tmp_path / "i"), ("jurisdiction",)).add(chunks, 1)
    ask = spark.createDataFrame([(q, " ".join(rng.choice(pool, 5)), "IN") for q in range(8)], "query_id long, text string, jurisdiction string")
    mean, df = 6.0, Counter(x for _, t, _ in rows for x in set(words(t)))
    want = set()
    for q, text, _ in ask.collect():
        scored = []
        for i, t, j in rows:
            w = words(t)
            s = sum(math.log(1 + (400 - df[x] + 0.5) / (df[x] + 0.5)) * w.count(x) * 2.2 / (w.count(x) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for x in set(words(text)) if x in w)
            scored += [(-round(s, 6), i)] * (s > 0 and j == "IN")
        want |= {(q, i, rank) for rank, (_, i) in enumerate(sorted(scored)[:3], 1)}
    found = index.search(ask, 3)
    assert {(r["query_id"], r["chunk_id"], r["rank"]) for r in found.collect()} == want
    if block == 4096:
        # No row of a query and a chunk moves before its sum is whole: between the last Exchange by chunk and the order by query there is none.
        plan = found._jdf.queryExecution().sparkPlan().toString()
        moved = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(" in line]
        assert any("hashpartitioning(chunk_id" in line for line in moved) and not any("query_id" in line and "chunk_id" in line for line in moved), plan


def test_index_versions(spark, tmp_path):
    rows = spark.createDataFrame([(i, t, j) for i, (t, j) in enumerate([("river stone", "IN"), ("river river", "INTL"), (None, "IN"), ("of a", "IN")])], "chunk_id long, text string, jurisdiction string")
    index = I.Index(str(tmp_path / "i"), ("jurisdiction",)).add(rows, 7).add(rows.where("chunk_id = 0"), 7).add(rows.where("chunk_id = 1"), 8)
    assert {tuple(r) for r in index.terms(spark).collect()} == {("river", 2), ("stone", 1)}
    ask = spark.createDataFrame([(1, "the river", "INTL"), (2, "a stone", "INTL")], "query_id long, text string, jurisdiction string")
    assert [(r["query_id"], r["chunk_id"]) for r in index.search(ask).collect()] == [(1, 1)]
    assert sorted((r["query_id"], r["chunk_id"]) for r in index.search(ask.drop("jurisdiction"), within=()).collect()) == [(1, 0), (1, 1), (2, 0)]
    (tmp_path / "i/postings/version=9/bucket=0").mkdir(parents=True)  # a version whose insertion broke off
    (tmp_path / "i/terms/version=9").mkdir(parents=True)
    assert index.terms(spark).count() == 2
    index.drop(spark, 8)
    assert {tuple(r) for r in index.terms(spark).collect()} == {("river", 1), ("stone", 1)}


@pytest.mark.parametrize("exact", [True, False])
def test_cells_find_what_brute_force_finds(spark, tmp_path, monkeypatch, exact):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((6, 8)) * 3
    rows = [(i, [float(x) for x in centres[i % 6] + rng.standard_normal(8)], i % 2) for i in range(900)] + [(900 + i, [1.0] * 8, 0) for i in range(400)] + [(2000, None, 0), (2001, [0.0] * 8, 1)]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<double>, model int")
    monkeypatch.setattr(N, "PART", 100)
    index = N.build(df, str(tmp_path / "cells"), ("model",), sample=500)
    assert index.vectors(spark).select("chunk_id").distinct().count() == 1300  # all but the null and the zero vector
    ask = spark.createDataFrame([(i, rows[i * 37][1], rows[i * 37][2]) for i in range(20)] + [(50, None, 0), (51, [0.0] * 8, 0)], "query_id long, embedding array<double>, model int")
    want = {(r["query_id"], r["rank"]): (r["chunk_id"], r["score"]) for r in K.cosine(ask, df, k=10).collect()}
    got = {(r["query_id"], r["rank"]): (r["chunk_id"], r["score"]) for r in index.search(ask, k=10, probes=3 if exact else None, exact=exact).collect()}
    if exact:
        assert got == want
    else:
        assert len({(q, c) for (q, _), (c, _) in got.items()} & {(q, c) for (q, _), (c, _) in want.items()}) >= 0.9 * len(want)


def test_containing_equals_plain_search(spark):
    docs = [(1, "abcabc"), (2, ""), (3, None), (4, "xbcx"), (5, "日本語abc")]
    needles = [(10, "abc"), (11, "bc"), (12, ""), (13, "本"), (14, "zz"), (15, "bc")]
    got = K.containing(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", spark.createDataFrame(needles, "item_id long, needle string"), "item_id", "needle")
    assert {tuple(r) for r in got.collect()} == {(d, n) for d, t in docs for n, x in needles if x and t and x in t}


@pytest.mark.parametrize("size", [1, 1 << 20])
def test_containing_with_a_full_and_an_ample_bitmap(spark, size):
    rng = random.Random(5)
    docs = [(i % 200, "".join(rng.choices("ab日\U0001f33f \0", k=rng.randrange(90)))) for i in range(210)]
    needles = [(i, t[at : at + rng.randrange(1, 70)]) for i, (_, t) in enumerate(docs[:120]) for at in [rng.randrange(len(t) + 1)]] + [(500 + n, "a" * n) for n in range(9)]
    got = K.containing(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", spark.createDataFrame(needles, "item_id long, needle string"), "item_id", "needle", size)
    assert sorted(tuple(r) for r in got.collect()) == sorted((d, n) for d, t in docs for n, x in needles if x and x in t)


def test_containing_reads_texts_once_for_many_needles(spark, capsys):
    docs = spark.range(50).select("id", F.concat(F.lit("no "), F.col("id") * 2000, F.lit(".")).alias("text"))
    needles = spark.range(100_001).select(F.col("id").alias("n"), F.concat(F.lit(" "), F.col("id"), F.lit(".")).alias("needle"))
    got = K.containing(docs, "id", "text", needles, "n", "needle")
    got.explain()
    assert capsys.readouterr().out.count("MapInPandas") == 1
    assert {tuple(r) for r in got.collect()} == {(i, i * 2000) for i in range(50)}


def test_an_index_has_a_file_of_terms_a_bucket_and_the_sizes_of_its_chunks(spark, tmp_path):
    rows = [(i, " ".join(f"word{i * 7 + k}" for k in range(60))) for i in range(40)] + [(50, None), (51, ""), (52, "a b"), (53, "same same"), (53, "same")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as many tasks as a large table has
    try:
        index = I.Index(str(tmp_path / "index")).add(spark.createDataFrame(rows, "chunk_id long, text string").repartition(4), 3)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(len(list(b.glob("*.parquet"))) for b in (tmp_path / "index/terms/version=3").iterdir() if b.is_dir()) == 1
    assert [(r["n"], r["words"]) for r in spark.read.parquet(f"{index.path}/sizes").collect()] == [(41, 2402)]
    assert {r["term"]: r["df"] for r in index.terms(spark).collect()} == {**Counter(w for i, t in rows[:40] for w in t.split()), "same": 1}


def test_locators_exact_then_same_base(spark):
    chunks = spark.createDataFrame([(1, "IN", "s.3(k)–(p)"), (2, "IN", "s.30"), (3, "IN", "s.3"), (4, "INTL", "s.3"), (5, "IN", "s.3(p)"), (6, "IN", "Art. 3")], "chunk_id long, jurisdiction string, locator string")
    ask = spark.createDataFrame([(1, "IN", "what of section 3(p)?"), (2, "IN", "nothing")], "query_id long, jurisdiction string, text string")
    assert [(r["query_id"], r["chunk_id"]) for r in R.by_locator(ask, chunks, ("jurisdiction",)).orderBy("rank").collect()] == [(1, 5), (1, 3), (1, 1)]


def test_fusion_is_monotone_and_breaks_ties_by_list(spark):
    rows = lambda *ids: spark.createDataFrame([(1, i, n) for n, i in enumerate(ids, 1)], "query_id long, chunk_id long, rank int")
    one, two = R.fuse({"a": rows(7, 8), "b": rows(9, 7)}), R.fuse({"a": rows(7, 8), "b": rows(9, 7), "c": rows(8)})
    assert [r["chunk_id"] for r in one.orderBy(F.desc("score"), "first").collect()] == [7, 9, 8]
    before, after = ({r["chunk_id"]: r["score"] for r in df.collect()} for df in (one, two))
    assert all(after[i] >= before[i] for i in before) and after[8] > before[8]


def plain_slots(ranked, k):
    """ranked: (chunk_id, graph, locator, score) best first."""
    head = ranked[:k]
    waiting = [h for h in ranked[k:] if h[1]][: max(0, 2 - sum(h[1] for h in head))]
    for hit in waiting:
        for i in range(len(head) - 1, -1, -1):
            if head[i][1] or head[i][2]:
                continue
            if head[i][3] is not None and hit[3] is not None and hit[3] < head[i][3] * 0.1:
                break
            head[i] = hit
            break
    return [h[0] for h in head]


def test_graph_slots_equal_the_plain_loop(spark):
    rng, rows, want = np.random.default_rng(8), [], {}
    for q in range(60):
        ranked = [(i, bool(rng.random() < 0.3), bool(rng.random() < 0.2), None if rng.random() < 0.1 else float(rng.choice([0.001, 0.05, 0.5, 0.9]))) for i in range(int(rng.integers(1, 9)))]
        rows += [(q, place, *h) for place, h in enumerate(ranked, 1)]
        want[q] = plain_slots(ranked, 4)
    df = spark.createDataFrame(rows, "query_id long, place int, chunk_id long, graph boolean, locator boolean, rerank double")
    got = {}
    for r in R.reserve_graph_slots(df, k=4).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    assert got == want


def test_entities_by_first_alias_on_word_borders(spark):
    entities = spark.createDataFrame([("kind:culture", ["strain", "culture"]), ("act:wild", ["wild life"]), ("act:musk", ["musk"]), ("x:none", None)], "ref string, aliases array<string>")
    ask = spark.createDataFrame([(1, "A culture of the strain"), (2, "agriculture and musk-deer"), (3, "Musk under the Wild Life act"), (4, None), (5, "")], "query_id long, text string")
    got = [(r["query_id"], r["ref"], r["place"]) for r in G.link_entities(ask, entities).orderBy("query_id", "place").collect()]
    assert got == [(1, "kind:culture", 1), (3, "act:wild", 1), (3, "act:musk", 2)]


def test_graph_chunks_two_an_edge_and_eight_in_all(spark):
    chunks = spark.createDataFrame([(i, "IN", "a", f"s.{i // 3}(x{i})" if i % 2 else f"s.{i // 3}") for i in range(40)] + [(99, "INTL", "a", "s.1")], "chunk_id long, jurisdiction string, source_id string, locator string")
    edges = spark.createDataFrame([(n, "r:one" if n % 2 else "r:two", "m:x", "a", f"s.{n}" if n else None) for n in range(12)] + [(12, "r:one", "m:x", None, None)], "edge_id long, subject string, object string, cite_source string, cite_locator string")
    links = spark.createDataFrame([(1, "m:x"), (2, "r:one"), (2, "m:x"), (3, "gone")], "query_id long, ref string")
    want = [c for n in range(12) for c in (range(0, 2) if n == 0 else range(3 * n, 3 * n + 2))][:8]
    got = G.graph_chunks(links, edges, chunks)
    for q in (1, 2):
        assert [r["chunk_id"] for r in got.where(f"query_id = {q} and jurisdiction = 'IN'").orderBy("rank").collect()] == want
    assert [r["chunk_id"] for r in got.where("query_id = 1 and jurisdiction = 'INTL'").collect()] == [99] and got.where("query_id = 3").count() == 0


def test_hybrid_keeps_jurisdictions_apart_and_named_provisions_on_top(spark, tmp_path):
    rows = [(i, "IN", "a", f"s.{i}", ["patent"], "h", "many rare words about rivers here", [0.0, 1.0], "m") for i in range(10, 20)]
    rows += [(3, "IN", "a", "s.3", ["food"], "h", "nothing alike", [0.0, 1.0], "m"), (50, "IN", "a", "s.50", ["gi"], "h", "rare tale", [1.0, 0.0], "m"), (60, "INTL", "b", "s.3", ["gi"], "h", "rare words about rivers", [1.0, 0.0], "m")]
    chunks = spark.createDataFrame(rows, "chunk_id long, jurisdiction string, source_id string, locator string, regimes array<string>, header string, text string, embedding array<double>, model string")
    ask = spark.createDataFrame([(1, j, "rare words about rivers under section 3", ["patent"], [1.0, 0.0], "m") for j in ("IN", "INTL")], "query_id long, jurisdiction string, text string, regimes array<string>, embedding array<double>, model string")
    none = spark.createDataFrame([], "query_id long, jurisdiction string, chunk_id long, rank int")
    index = I.Index(str(tmp_path / "index"), ("jurisdiction",)).add(chunks, 1)
    got = {j: [r["chunk_id"] for r in R.hybrid(ask, chunks, none, index).where(F.col("jurisdiction") == j).orderBy("rank").collect()] for j in ("IN", "INTL")}
    assert got == {"IN": [3, *range(10, 17)], "INTL": [60]}
    graph = spark.createDataFrame([(1, "IN", 50, 1)], none.schema)
    assert 50 in [r["chunk_id"] for r in R.hybrid(ask, chunks, graph, index).where("jurisdiction = 'IN'").collect()]


def test_cells_hold_no_matrix_of_all_queries_and_rows():
    import tracemalloc

    import pandas as pd

    rng = np.random.default_rng(3)
    ask = pd.DataFrame({"query_id": range(200), "model": np.arange(200) % 2, "embedding": list(rng.normal(size=(200, 8)))})
    rows = pd.DataFrame({"chunk_id": rng.permutation(30_000), "model": np.arange(30_000) % 2, "embedding": list(rng.integers(-2, 3, (30_000, 8)).astype(float) + 0.5)})
    tracemalloc.start()
    got = N.best_of_cell(ask, rows, ["query_id", "model"], ("model",), 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 * 30_000 * 8 / 2
    full = np.round(N._unit(np.stack(ask["embedding"].to_list())) @ N._unit(np.stack(rows["embedding"].to_list())).T, 6)
    ids = rows["chunk_id"].to_numpy()
    for q in range(200):
        own = np.flatnonzero(rows["model"].to_numpy() == q % 2)
        best = own[np.lexsort((ids[own], -full[q, own]))[:5]]
        mine = got[got["query_id"] == q].sort_values(["score", "chunk_id"], ascending=[False, True])
        assert mine["chunk_id"].tolist() == ids[best].tolist() and mine["score"].tolist() == full[q, best].tolist()


@pytest.mark.parametrize("size", [3, 1024])
def test_lists_of_one_scan_equal_those_of_the_index(spark, corpus, monkeypatch, tmp_path, size):
    rng, pool = random.Random(8), [f"word{i}" for i in range(12)]
    rows = [(i, " ".join(rng.choices(pool, weights=range(1, 13), k=rng.randrange(0, 30))) + (" UNIQUE" if i == 9 else ""), "AB"[i % 2]) for i in range(150)] + [(150, None, "A"), (151, "to be", "B"), (152, "Word1 wörd2 Kelvin 2word3", "A")]
    chunks = spark.createDataFrame(rows, "chunk_id long, text string, side string").repartition(3)
    asked = [(q, " ".join(rng.choices(["Word11", "WORD10", "word3", "unique", "nowhere", "an", "word1"], k=5)), side) for q in range(14) for side in "AB"] + [(90, None, "A"), (91, "of", "B"), (92, "word1", "C")]
    queries = spark.createDataFrame(asked, "query_id long, text string, side string")
    monkeypatch.setattr(K, "blocks_of", lambda q, s=size, _old=K.blocks_of: _old(q, size))
    monkeypatch.setattr(K, "ROWS", 7)
    monkeypatch.setattr(K, "POSTINGS", 5)
    index = I.Index(str(tmp_path / "index"), ("side",)).add(chunks, 1)
    rows_of = lambda df: sorted(tuple(r[c] for c in ("query_id", "chunk_id", "score", "rank")) for r in df.collect())
    for within, ask in ((("side",), queries), ((), queries.where("side = 'A'"))):
        found = rows_of(K.bm25(ask, chunks, within, 10))
        assert found == rows_of(index.search(ask, 10, within)) and len(found) > 100
    assert K.bm25(queries.limit(0), chunks, ("side",)).count() == 0 and K.bm25(queries, chunks.limit(0), ("side",)).count() == 0


def test_vectors_made_where_they_are_scored_give_the_same_list(spark, corpus):
    chunks = corpus[1].drop("embedding")
    queries = spark.createDataFrame([(1, "River stone", 0), (2, "leaf leaf tree", 1), (3, "of a", 1)], "query_id long, text string, model int").withColumn("embedding", M.embedding(F.col("text")))
    want = {tuple(r) for r in K.cosine(queries, chunks.withColumn("embedding", M.embedding(F.col("text")))).collect()}
    assert len(want) > 60 and {tuple(r) for r in K.cosine(queries, chunks, load=M.hashing_encoder).collect()} == want


def test_hashing_encoder_adds_words_up_whatever_is_remembered(monkeypatch):
    texts = ["River river STONE", "", "ab 12", "wörd river2 2stone"] * 3
    want = np.zeros((len(texts), M.DIM))
    for i, text in enumerate(texts):
        for word in words(text):
            at, sign = M._place(word)
            want[i, at] += sign
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-12)
    assert np.array_equal(M.hashing_encoder()(texts), want) and M.hashing_encoder()([]).shape == (0, M.DIM)
    known = T.Known(len, most=2)
    assert [known[w] for w in ("a", "bb", "ccc", "a")] == [1, 2, 3, 1] and len(known) <= 2


@pytest.mark.parametrize("most", [1, 7, 1 << 20])
def test_words_found_by_bytes_are_those_of_the_pattern(most):
    rng, pieces = random.Random(1), ["a", "B", "z", "0", "9", " ", "\n", "é", "\u212a", "İ", "-", "longword", "ABCDEFGHI", "\0", "x1", "\ud800", "日"]
    for _ in range(400):
        texts = ["".join(rng.choices(pieces, k=rng.randrange(14))) for _ in range(rng.randrange(6))]
        found = [(int(r), held[n]) for row, number, held in T.word_places(texts, most) for r, n in zip(row, number, strict=True)]
        assert found == [(i, w) for i, text in enumerate(texts) for w in words(text)]


def test_hybrid_search_writes_no_index_and_moves_no_text(spark, monkeypatch):
    """Questions that are asked once: chunks are read for their words, and few hits go to the texts."""
    monkeypatch.setattr(I.Index, "add", lambda *_: pytest.fail("an index for one batch of questions"))
    monkeypatch.setattr(search, "_STORED", {})
    shown = search.r7_hybrid_search(spark, "/root/testdata/sf0.001")
    plan = shown._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert "embedding" not in search.stored_passages(spark, "/root/testdata/sf0.001").columns and shown.count() > 0


def test_search_tool_moves_no_text(spark):
    found = search.x5_search_corpus(spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    rows = {(r["query_id"], r["jurisdiction"], r["rank"]): (r["chunk_id"], r["snippet"]) for r in found.collect()}
    texts = {r["chunk_id"]: r["text"] for r in search.S.passages(spark, "/root/testdata/sf0.001").select("chunk_id", "text").collect()}
    assert rows and all(rank <= 6 and snippet == texts[chunk][:900] for (_, _, rank), (chunk, snippet) in rows.items())


def test_stored_passages_of_no_documents(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert search.stored_passages(spark, str(tmp_path)).count() == 0
