"""Pipeline stages against plain Python on a small corpus with repeated rows, missing ids and missing texts."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from corpuslake.llm import mixing, neardup, packing, quality
from corpuslake.llm.common import fold
from test_llm import plain_line_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = np.random.default_rng(11)
    word = lambda: f"w{int(rng.integers(0, 400))}"
    rows = []
    for i in range(60):
        lines = [" ".join(word() for _ in range(12)) for _ in range(4)] + ["a line that many documents share"] * (i % 3 == 0)
        rows.append((i, "\n".join(lines)))
    rows += [(100 + i, rows[i][1].replace("w1 ", "w2 ", 1) + " more") for i in range(0, 20, 2)]
    rows += [(3, rows[3][1]), (3, "another text of number three " + " ".join(word() for _ in range(20))), (None, "no number"), (None, rows[5][1]), (200, None), (201, "")]
    return [(i, t, ("en", "de", None)[k % 3], f"s{k % 4}" if k % 7 else None, len(t or "")) for k, (i, t) in enumerate(rows)]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    docs.write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 2), 0) for i in range(60)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_quality_stage_keeps_rows_by_their_score(spark, docs, folder):
    score = quality.quality_scorer(docs, spark.read.parquet(f"{folder}/labels.parquet"), fold("id", 3) != 1)
    scored = docs.withColumn("score", score(F.col("text"))).collect()
    assert rows_of(P.quality_stage(spark, docs, folder)) == sorted((tuple(r)[:5] for r in scored if r["score"] >= 0.5), key=repr)
    assert 0 < sum(r["score"] >= 0.5 for r in scored) < len(scored)


def test_line_stage(spark, docs, folder):
    want = plain_line_dedup([r[:2] for r in ROWS])
    assert rows_of(P.line_stage(spark, docs, folder)) == sorted(((i, want[i, t], lang, source, len(want[i, t])) for i, t, lang, source, _ in ROWS), key=repr)


def test_near_stage(spark, docs, folder):
    sets = {}
    for i, t, *_ in ROWS:
        if i is not None:
            sets.setdefault(i, []).append(set(neardup.shingles(t or "").tolist()))
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[i] for y in sets[j]):
                a, b = root[i], root[j]
                root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
    assert rows_of(P.near_stage(spark, docs, folder)) == sorted((r for r in ROWS if r[0] is None or root[r[0]] == r[0]), key=repr)
    assert any(i != r for i, r in root.items())


def test_mix_stage_keeps_the_rows_that_mixing_keeps(spark, docs, folder):
    mixed = mixing.mix(docs)
    kept = rows_of(P.mix_stage(spark, docs, folder))
    assert len(kept) == mixed.where("kept").count() and set(kept) <= set(ROWS)
    count = lambda rows: {k: sum(r == k for r in rows) for k in rows}
    want = {(r["id"], r["source"], r["lang"], r["tokens"]) for r in mixed.where("kept").collect()}
    assert {(i, s or "", lang or "", len((t or "").split())) for i, t, lang, s, _ in kept} == want and all(n in (1, 2) for n in count(kept).values())


def test_pack_stage_holds_every_token(spark, docs, folder):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    assert P.pack_stage(spark, docs, folder).agg(F.sum("length")).first()[0] == sum(len(packing.token_ids(t or "", path)) for _, t, *_ in ROWS)


def test_run_and_empty_tables(spark, docs, folder):
    assert [n for n, _ in P.STAGES] == ["quality classifier", "line dedup", "near-dedup", "mixing", "packing"]
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(P.run(spark, folder).columns)
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs.withColumn("row", F.lit(1)).withColumn("key", F.lit("x")), folder).columns == list(P.COLUMNS)
