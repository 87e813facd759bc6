"""The training-data operators on small fixtures: brute force, exact round trips, edge cases."""

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuslake.llm import chat, html, linededup, media, merkle, mixing, neardup, packing, quality, toxicity
from corpuslake.llm.common import fold

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, id string, key string"
BASE = " ".join(f"w{i}" for i in range(60))
ROWS = [
    (1, BASE + "\nshared line of some length\nend", "en", "a"), (2, BASE + "\nshared line of some length\nother", "en", "a"), (3, None, "en", None), (4, "", None, "a"),
    (5, "Tiny", "fr", "b"), (6, "tiny ", "fr", "b"), (7, " ".join(f"v{i}" for i in range(3000)), "en", "b"), (7, " ".join(f"v{i}" for i in range(3000)), "en", "b"), (None, "no id here at all, no id", "en", "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", "y", "z") for r in ROWS], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_near_duplicates(docs, none):
    got = {r["id"]: (r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs).collect()}
    assert got[1] == (1, True) and got[2] == (1, False) and got[5] == (5, True) and got[6] == (5, False)
    assert got[3] == (3, True) and got[4] == (4, True) and got[7] == (7, True) and got[None] == (None, True)
    assert neardup.near_duplicates(none).count() == 0


def test_near_duplicates_equal_brute_force_through_every_kind_of_node(spark):
    rng = np.random.default_rng(1)
    words = [f"x{i}" for i in range(150)]
    rows = []
    for i in range(120):
        text = list(words)
        for at in rng.choice(150, rng.integers(0, 9), replace=False):
            text[at] = f"e{i}_{at}"
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: set(neardup.shingles(t).tolist()) for i, t in rows}
    root = {i: i for i in sets}
    for i in sets:
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
    # nodes in a task; deeper levels; chunks of what is too large at the last level
    for leaf, block, weight, depth, bit_words in ((4, 2000, 900, 2, 1), (4, 10, 10**6, 3, 1 << 20), (4, 10, 10**6, 1, 3)):
        got = {r["id"]: r["component_id"] for r in neardup.near_duplicates(df, leaf=leaf, block=block, weight=weight, depth=depth, bit_words=bit_words).collect()}
        assert got == root


def test_texts_with_a_common_passage_alone_rarely_meet(spark, monkeypatch):
    common = " ".join(f"c{i}" for i in range(16))
    df = spark.createDataFrame([(i, common + " " + " ".join(f"p{i}_{j}" for j in range(50))) for i in range(300)], "doc_id long, text string")
    rows, crowds = [], neardup._crowds
    monkeypatch.setattr(neardup, "_crowds", lambda level: rows.append(crowds(level).where("n > 24").count()) or crowds(level))
    assert neardup.near_duplicates(df).where("kept").count() == 300
    assert sum(rows) <= 2 * 300  # each text has 26 keys


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 12), min_size=1, max_size=12), min_size=2, max_size=25), st.data())
def test_links_across_unite_what_brute_force_unites(raw, data):
    sets = [np.unique(np.array(x, np.int64)) for x in raw]
    n = len(sets)
    linked = {(i, j) for i in range(n) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))}
    given_links = data.draw(st.sets(st.sampled_from(sorted(linked)))) if linked else set()

    def classes(edges):
        root = list(range(n))
        for i, j in edges:
            root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
        return root

    found = neardup.links_across(np.array(classes(given_links)), sets, 75)
    assert len(found) < n and all((max(x), min(x)) in linked for x in found)
    assert classes([*given_links, *found]) == classes(linked)


@settings(max_examples=30, deadline=None)
@given(st.integers(2, 150), st.integers(1, 6), st.integers(0, 2**32 - 1))
def test_likely_across(n, k, seed):
    rng = np.random.default_rng(seed)
    comp, sizes, marks = rng.integers(0, k, n), rng.integers(1, 9, n), rng.integers(0, 3, (n, neardup.POSITIONS)).astype(np.int8)
    fits = lambda i, j: 100 * min(sizes[i], sizes[j]) >= 75 * max(sizes[i], sizes[j])
    want = [any(comp[i] != comp[j] and fits(i, j) and (marks[i] == marks[j]).mean() >= neardup.LIKELY for j in range(n)) for i in range(n)]
    assert neardup.likely_across(comp, sizes, marks, 75).tolist() == want


def test_near_duplicates_of_an_id_with_several_texts(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(50))
    text_of_many = lambda i: text(f"m{i}_")
    rows = [(1, text("a")), (2, text("b") + " x"), (2, text("a") + " y"), (3, text("b")), (4, text("c")), (4, text("c")), (5, " "), (6, None)]
    more = [(100 + i, text_of_many(i // 2) + " z" * (i % 2)) for i in range(20)]
    got = sorted(tuple(r) for r in neardup.near_duplicates(spark.createDataFrame(rows + more, "doc_id long, text string").coalesce(1)).collect())
    assert [r for r in got if r[0] >= 100] == [(100 + i, 46 + i % 2, 100 + i - i % 2, i % 2 == 0) for i in range(20)]
    assert [r for r in got if r[0] < 100] == sorted([(1, 46, 1, True), (2, 47, 1, False), (2, 47, 1, False), (3, 46, 1, False), (4, 46, 4, True), (4, 46, 4, True), (5, 0, 5, True), (6, 0, 6, True)])


def test_line_dedup_moves_a_text_once(docs):
    plan = linededup.dedup_lines(docs).select("kept_text", "row")._jdf.queryExecution().optimizedPlan().toString()
    moved = plan[plan.index("Join LeftOuter") :].splitlines()[1]
    assert "struct(" in moved and " AS text#" not in moved, moved


def plain_line_dedup(rows):
    """Kept texts by plain Python: {(id, text): kept}."""
    blank = " \t\n\x0b\x0c\r"
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(blank))
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(i)
    lost = lambda i, line: i is not None and len(holders.get(key(line), ())) > 1 and min(holders[key(line)]) != i
    return {(i, text): "\n".join(x for x in (text or "").split("\n") if not lost(i, x)) for i, text in rows}


def test_line_dedup(spark, docs, none):
    got = {r["id"]: r["kept_text"] for r in linededup.dedup_lines(docs).collect()}
    assert got[1] == ROWS[0][1] and got[2] == "other" and got[3] == "" and got[None] == ROWS[-1][1]
    assert linededup.dedup_lines(none).count() == 0
    pool = ["A line of text", "\ta LINE of text \x0b", "ÜBER line of TEXT", "über line of text", "short", "", " ", "exactly 10", "x\ry z of ten", "日本語の行はここにあります"]
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(0, 12)) or None, "\n".join(rng.choice(pool, rng.integers(0, 7)))) for _ in range(40)] + [(3, None), (5, pool[0]), (5, pool[0])]
    clash = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "`doc_id` long, text string, `a.b` string, row string, t int")
    for waves in (1, 3):
        got = linededup.dedup_lines(clash, waves=waves).collect()
        want = plain_line_dedup(rows)
        assert len(got) == len(rows) and all(r["kept_text"] == want[r["id"], r["row"]["text"]] for r in got)
        assert all(r["n_lines"] - r["n_dropped"] == (0 if r["n_lines"] == r["n_dropped"] else r["kept_text"].count("\n") + 1) for r in got)


def test_line_index_is_reversible(spark):
    text = {1: "line number one of all\nline number two of all", 2: "line number two of all\nline number three", 3: "LINE number two of all\nline number three", 4: "only the fourth has this"}
    frame = lambda ids: spark.createDataFrame([(i, text[i]) for i in ids], "doc_id long, text string")
    rows = lambda df: sorted((bytes(r[0]), *r[1:]) for r in df.collect())
    ids = lambda df: sorted(r["id"] for r in df.collect())
    kept = lambda index, i: linededup.kept_texts(frame([i]), index.references).first()["kept_text"]
    whole, _ = linededup.insert_documents(linededup.empty_index(spark), frame([1, 2, 3, 4]))
    part, changed = linededup.insert_documents(linededup.empty_index(spark), frame([2, 3]))
    assert ids(changed) == [2, 3] and kept(part, 3) == "" and kept(part, 2) == text[2]
    more, changed = linededup.insert_documents(part, frame([1, 4]))
    assert ids(changed) == [1, 2, 4] and kept(more, 2) == "line number three" and rows(more.references) == rows(whole.references)
    less, changed = linededup.delete_documents(more, frame([1, 4]).select("doc_id"))
    assert ids(changed) == [2] and kept(less, 2) == text[2] and rows(less.references) == rows(part.references) and rows(less.postings) == rows(part.postings)
    again, _ = linededup.insert_documents(less, frame([4, 1]))
    assert rows(again.references) == rows(whole.references) and rows(again.postings) == rows(whole.postings)
    cells = lambda index: sum(int(np.count_nonzero(np.frombuffer(r["cells"], np.uint16))) for r in index.filters.collect())
    assert cells(whole) == cells(again) == 4 and cells(part) == cells(less) == 2
    bare, _ = linededup.delete_documents(again, frame([1, 2, 3, 4]).select("doc_id"))
    assert cells(bare) == 0 and bare.references.count() == 0
    assert linededup.probe(again.references.select("key"), again).count() == 4 and linededup.probe(again.references.select("key"), bare).count() == 0


def test_cuckoo_filter():
    keys = np.random.default_rng(3).integers(0, 2**63, 5000, dtype=np.uint64)
    f = linededup.CuckooFilter.for_keys(len(keys))
    assert len(f.add(keys)) == 0 and f.has(keys).all() and np.count_nonzero(f.table) == len(keys)
    f.remove(keys)
    assert not f.table.any()
    small = linededup.CuckooFilter(16)
    left = small.add(keys[:100])
    assert 30 < len(left) < 60 and small.has(np.setdiff1d(keys[:100], left)).all() and np.count_nonzero(small.table) == 100 - len(left)


def test_packing(docs, none):
    rows = packing.pack(docs).collect()
    assert packing.pack(none).count() == 0
    assert sum(r["length"] for r in rows) == sum(len(packing.token_ids(t or "", public_tokenizers.path("byte_bpe_50k.tiktoken"))) for _, t, *_ in ROWS)
    for s in {r["sequence_id"] for r in rows}:
        parts = sorted((r["offset"], r["length"]) for r in rows if r["sequence_id"] == s)
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= packing.WINDOW


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit_equals_plain_search(lengths):
    room, want = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [r for r in room if r >= lengths[i]]
        if fits:
            room.remove(min(fits))
            want[i] = 50 - min(fits)
            room.append(min(fits) - lengths[i])
        else:
            want[i] = 0
            room.append(50 - lengths[i])
    where, offsets = packing.best_fit_decreasing(lengths, 50)
    assert len(set(where)) == len(room) and [want[i] for i in range(len(lengths))] == offsets


def test_ids_equal_the_tokenizers_file():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("Hello  world\n\n x", "a<|endoftext|>b", "ümläut ñ 日本 🙂", "", "  \t\r\n "):
        assert t.encode(text, add_special_tokens=False).ids == packing.token_ids(text, public_tokenizers.path("byte_bpe_50k.tiktoken"))[:-1].tolist()


def test_ids_of_very_long_runs():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("x" + " " * 1_000_000, "\n" * 300_000 + "b", "a" * 300_000, "漢字" * 100_000):
        assert t.encode(text, add_special_tokens=False).ids == packing.token_ids(text, public_tokenizers.path("byte_bpe_50k.tiktoken"))[:-1].tolist()


def test_sequences_hold_the_documents_ids(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    texts = {i: f"word{i} " * (1 + i * i % 700) for i in range(60)}
    rows = spark.createDataFrame([(i, t, 0) for i, t in texts.items()], "doc_id long, text string, start int")
    packed = packing.pack(rows)
    laid = {r["sequence_id"]: r["input_ids"] for r in packing.sequences(rows, packed).collect()}
    got = {i: [] for i in texts}
    for r in sorted(packed.collect(), key=lambda r: (r["doc_id"], r["start"])):
        assert len(laid[r["sequence_id"]]) == packing.WINDOW and len(got[r["doc_id"]]) == r["start"]
        got[r["doc_id"]] += laid[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]
    assert all(got[i] == packing.token_ids(t, path).tolist() for i, t in texts.items())


def test_mixing_marginals_and_both_ways(docs, none):
    assert mixing.mix(none).count() == 0 and mixing.mix(docs).count() == len(ROWS)
    rows = docs.select(F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), F.lit("t").alias("topic"), F.lit(10).cast("long").alias("tokens"))
    cells = rows.groupBy(*mixing.AXES).agg(F.sum("tokens").alias("tokens"))
    targets = {a: mixing.tempered_targets(cells, a) for a in mixing.AXES}
    one = {tuple(r)[:3]: r["factor"] for r in mixing.rake(cells, targets).collect()}
    two = {tuple(r)[:3]: r["factor"] for r in mixing.rake(cells, targets, sent_cells=0).collect()}
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-9 for k in one)
    left = mixing.residual(cells, mixing.rake(cells, targets), targets).collect()
    assert {r["axis"] for r in left} == set(mixing.AXES) and all(abs(r["target"] - r["fitted"]) < 1e-3 for r in left)


def test_mixing_judges_rows_and_meets_targets_and_budgets(spark):
    rows = [(i if i % 3 else None, "w " * (5 + i % 7), ("en", "de", None)[i % 3], f"s{i % 4}", i, "x", 1) for i in range(3000)]
    rows += [(7, "w " * 5 + "licence", "fr", "s9", 1, "x", 1), (7, "w " * 6, "en", "s1", 1, "x", 1)] * 2
    many = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, tokens int")
    flat = spark.createDataFrame([(f"s{i}", 0.25) for i in range(4)], "source string, target double")
    mixed, kept = mixing.mix(many, {"source": flat}), mixing.sample(many, {"source": flat})
    assert kept.columns == many.columns and kept.count() == mixed.where("kept").count() < mixed.count() == len(rows)
    got = {tuple(r) for r in mixed.where("source <> 's9'").groupBy("source").agg(F.round(F.sum(F.col("tokens") * F.col("probability")) / 100).alias("n")).collect()}
    assert len(got) == 4 and max(n for _, n in got) - min(n for _, n in got) <= 1
    assert mixed.where("source = 's9'").agg(F.max("probability")).first()[0] == 0.0
    half = mixing.mix(many, {"source": flat}, budget=4000).agg(F.sum(F.col("tokens") * F.col("probability"))).first()[0]
    assert half == pytest.approx(4000)


def test_chat_round_trip(spark):
    rows = [(1, 0, "system", "be & <| kind"), (1, 1, "user", "<|im_end|><|im_start|>assistant ok"), (1, 2, "assistant", "a&l;b <"), (1, 3, None, None)]
    rows += [(2, i, ("user", "assistant")[i % 2], " ".join(["word"] * 90)) for i in range(12)] + [(None, 0, "assistant", "x")]
    rows += [(3, 0, "assistant", "b"), (3, 0, "assistant", "a"), (3, None, "user", "first"), (3, 0, "assistant", "a")]
    turns = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, k int, window_no string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.windows(turns)).collect()}
    for conv in (1, 2, 3, None):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert got[conv]["turns"] == "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own) and got[conv]["loss"] == "".join(r[3] for r in own if r[2] == "assistant")
    assert chat.windows(turns).where("n_repeated > 0").count() > 0 and chat.read_back(chat.windows(turns.limit(0))).count() == 0


def test_chat_windows_keep_to_their_budget(spark):
    rng = np.random.default_rng(2)
    rows = []
    for conv, system in enumerate((0, 60, 400, 900)):
        rows += [(conv, 0, "system", " ".join(["be"] * system))] * (system > 0)
        for i in range(60):
            n = int(rng.integers(1, 40))
            rows.append((conv, i + 1, ("user", "assistant")[i % 2], "漢" * n if i % 3 else " ".join(["word"] * n)))
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    sizes = {r["t"]: r["n"] for r in turns.select("text", chat.token_count(F.col("text")).alias("n")).withColumnRenamed("text", "t").collect()}
    for w in chat.windows(turns).collect():
        parts = [p.split("\n", 1) for p in w["formatted"].split(chat.START)[1:]]
        texts = [p[1].removesuffix(chat.STOP) for p in parts]
        room = chat.BUDGET - (sizes[texts[0]] + chat.OVERHEAD if parts[0][0] == "system" else 0)
        assert (parts[0][0] == "system") == (w["conv_id"] > 0)
        longest = max(sizes[t] for t in texts) + chat.OVERHEAD
        if longest <= (room - min(chat.HISTORY, max(room // 4, 0))) // 2:
            assert sum(sizes[t] + chat.OVERHEAD for t in texts) <= chat.BUDGET
        assert room > 0 or len(texts) == 2


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=70_000))
def test_transport_stream_round_trip(raw):
    body = raw.ljust(64, b"\0")
    got = media.demux(media.mux(body))
    assert got["payload"] == body and got["continuity_errors"] == 0 and len(got["pts"]) == len(got["random_access"])


def test_transport_stream_sees_a_lost_packet():
    stream = media.mux(b"x" * 20_000)
    with pytest.raises(ValueError):
        media.demux(stream[: 188 * 5] + stream[188 * 6 :])


def test_media_and_merkle_rows(docs, none):
    rows = media.read_media(media.to_media(docs)).collect()
    assert {r["payload_sha256"] for r in rows if r["doc_id"] in (3, 4)} == {hashlib.sha256(bytes(64)).hexdigest()} and len(rows) == len(ROWS)
    prints = merkle.fingerprints(docs).collect()
    assert len(prints) == len(ROWS) and len({r["fingerprint"] for r in prints if r["doc_id"] in (3, 4)}) == 1
    assert merkle.fingerprints(none).count() == 0 and media.read_media(media.to_media(none)).count() == 0
    ordered = [(r[0], r[1] or "") for r in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))]
    want = {(i, hashlib.sha256(merkle.edited_text(t, ordered[(k + 1) % len(ordered)][1]).encode()).hexdigest()) for k, (i, t) in enumerate(ordered)}
    assert {(r["doc_id"], r["edited_sha256"]) for r in prints} == want


def test_merkle_locates_edits():
    print_ = lambda lines: merkle.Tree("\n".join(lines)).fingerprint()
    lines = [f"paragraph number {i} with words" for i in range(40)]
    edited = [*lines[:7], "changed", *lines[8:20], "new", "new too", *lines[20:]]
    assert merkle.locate_edits(print_(lines), print_(edited)) == [(7, 8)] and merkle.locate_edits(print_(edited), print_(lines)) == [(7, 8), (20, 22)]
    assert merkle.locate_edits(print_(lines), print_(lines)) == [] and merkle.likeness(print_(["a b"]), print_(["a b"])) == 1.0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["", "a b c", "d, e. f", "x" * 50, "a b c d e f g h i"]), min_size=1, max_size=14), st.lists(st.sampled_from(["", "a b c", "d, e. f", "q"]), min_size=1, max_size=14))
def test_merkle_against_whole_texts(x, y):
    a, b = merkle.Tree("\n".join(x)), merkle.Tree("\n".join(y))
    assert (a.root == b.root) == (x == y)
    near = merkle.likeness(a.fingerprint(), b.fingerprint())
    count = lambda t: Counter(p.strip() for line in t for p in merkle._PHRASE.findall(line))
    both, common = count(x).total() + count(y).total(), 2 * (count(x) & count(y)).total()
    assert near == pytest.approx(1.0 if x == y else 0.0 if not both else min(common, both - 1) / both)
    where = merkle.locate_edits(a.fingerprint(), b.fingerprint())
    assert not where or all(0 <= i < j <= len(x) for i, j in where)
    if not set(x) & set(y):
        assert where == [(0, len(x))]


def test_merkle_rows_with_more_partitions_than_rows(spark):
    rows = [(i * 7 % 40, f"text {i % 5}\nof {i}" if i % 9 else None) for i in range(40)] + [(None, "x"), (3, "again"), (3, "again")]
    got = merkle.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), parts=1000).collect()
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for k, (i, t) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        edited = merkle.edited_text(t, following)
        a, b, c = (merkle.Tree(v).fingerprint() for v in (t, edited, following))
        want.append((i, len(t), a, b, merkle.likeness(a, b), merkle.likeness(a, c), ",".join(f"{x}-{y}" for x, y in merkle.locate_edits(a, b))))
    key = lambda r: (r[0] is not None, *map(str, r))
    assert sorted(((r["doc_id"], r["n_chars"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"], r["edits"]) for r in got), key=key) == sorted(want, key=key)


def test_html_main_text():
    page = """<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav><header>Top</header><div class="cookie-notice">We use cookies</div>
    <div id=content><h1>Title &amp; more</h1><p>First paragraph of the story with enough words<br>to count.<p>Be.<p>Last one of the paragraphs.</div><div class="comments"><p>Reader says hi and many more words than needed</p></div><footer>&copy; x</footer>"""
    assert html.main_text(page) == "Title & more\n\nFirst paragraph of the story with enough words to count.\n\nBe.\n\nLast one of the paragraphs."
    assert html.main_text("") == "" and html.main_text("<p") == "<p"


def test_classifiers_learn_and_bear_edges(spark, docs, none):
    text = lambda i, bad: " ".join(f"w{(i * 7 + k) % 50}" for k in range(30)) + (" Scum! idiot you" if bad else " fine day")
    many = spark.createDataFrame([(i, text(i, i % 3 == 0)) for i in range(240)], "doc_id long, text string")
    marks = labels(spark, [(i, int(i % 3 > 0), int(i % 3 == 0)) for i in range(240)])
    for score, good in ((quality.score_quality, lambda i: i % 3 > 0), (toxicity.score_toxicity, lambda i: i % 3 == 0)):
        held = [r for r in score(many, marks, fold("id", 4) != 2).where(fold("id", 4) == 2).collect()]
        assert sum((r["score"] >= 0.5) == good(r["id"]) for r in held) >= 0.95 * len(held)
        assert score(docs, labels(spark, []), fold("id", 4) != 2).count() == len(ROWS)
        assert score(none, marks, fold("id", 4) != 2).count() == 0


def test_quality_of_a_very_long_text_sees_few_words_that_are_not_there():
    learned = quality.indicators(" ".join(f"known{i}" for i in range(2000)))
    wide = quality.indicators(" ".join(f"other{i}" for i in range(60_000)))
    assert len(np.intersect1d(learned, wide)) < 0.2 * len(learned)


def test_quality_model_keeps_the_bins_of_two_rows():
    rows = [np.array(r, np.int32) for r in ([1, 2, 9], [1, 3], [2, 3, 7], [1, 5])]
    bins, ratio = quality.log_count_ratios(rows, np.array([1, 1, -1, -1]))
    assert bins.tolist() == [1, 2, 3] and np.allclose(ratio[1:], ratio[1]) and ratio[0] > ratio[1]
    wide = quality.spread((bins, ratio, ratio))
    assert np.count_nonzero(wide[1]) <= 3 and np.allclose(wide[1, bins], ratio)


def test_merkle_likeness_counts_every_phrase():
    lines = [f"paragraph number {i} with words, and some more of them; the end of {i % 9}" for i in range(400)]
    text = "\n".join(lines)
    print_ = merkle.Tree(text).fingerprint()

    def flat(x, y):
        x, y = (Counter(p.strip() for line in t.split("\n") for p in merkle._PHRASE.findall(line)) for t in (x, y))
        return 2 * (x & y).total() / (x.total() + y.total())

    for i in range(0, 400, 40):
        edited = "\n".join([*lines[:i], "changed here", *lines[i + 1 :]])
        assert 0.99 < merkle.likeness(print_, merkle.Tree(edited).fingerprint()) < 1.0
    for other in (text[: len(text) // 2], "\n".join(lines[::2]), "\n".join(lines + lines[:50]), "\n".join(lines[::-1]).replace("words", "terms", 100), "a b"):
        assert merkle.likeness(print_, merkle.Tree(other).fingerprint()) == pytest.approx(flat(text, other))
    assert merkle.likeness(print_, merkle.Tree("\n".join(lines[::-1])).fingerprint()) < 1.0
    assert merkle.likeness(merkle.Tree("").fingerprint(), merkle.Tree(" ").fingerprint()) == 0.0


def test_html_keeps_all_of_a_marked_article():
    links = "".join(f"<li><a href=/{i}>Source {i}</a></li>" for i in range(6))
    page = f"""<body><nav><a href=/>Home</a></nav><article><h2 class="search">Search methods</h2><section id="legal"><p>Long text of the section.</p></section>
    <div class="ad"><p>Buy now and save a lot of money today</p></div><figure><img src=x><figcaption>A caption.</figcaption></figure><p>Energy is <math><mi>E</mi></math>.</p>
    <ul>{links}</ul><p><a href=/next>Read the whole report</a></p></article><footer>&copy; x</footer></body>"""
    want = ["Search methods", "Long text of the section.", "A caption.", "Energy is E.", *(f"Source {i}" for i in range(6)), "Read the whole report"]
    assert html.main_text(page).split("\n\n") == want


def surges_and_dives(weights, surge, heads):
    """Stretches straight from the definition: every window is summed anew."""
    window = lambda i: sum(weights[i : i + html.WIDTH])
    out, i = [], 0
    while i < len(weights):
        if window(i) >= surge and (weights[i] >= html.SELF * surge or heads[i]):
            j = i + 1
            while j < len(weights) and window(j) >= html.DIVE * surge:
                j += 1
            out.append((i, j))
            i = j
        i += 1
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0, 0, 0, 1, 5, 90]), st.booleans()), max_size=40), st.sampled_from([1.0, 9.0, 60.0]))
def test_html_stretches_by_definition(lines, surge):
    weights, heads = [w for w, _ in lines], [h for _, h in lines]
    assert html.stretches(weights, surge, heads) == surges_and_dives(weights, surge, heads)


def test_html_lengths_decide():
    page = lambda n: "<body><div><p>Short note that stands apart.</p></div><div><p>" + "story " * n + "</p><p>" + "more " * n + "</p></div>"
    assert html.main_text(page(10)).startswith("Short note") and html.main_text(page(200)).startswith("story")


def test_html_without_any_hint(spark):
    """Pages of sf0.01 without article, main, class, id and role against what is extracted with them: lines' precision and recall."""
    bare = lambda h: re.sub(r"(?i)\s(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", "", re.sub(r"(?i)<(/?)(article|main)\b", r"<\1div", h))
    both = kept = want = 0
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        got, right = set(html.main_text(bare(r["html"] or "")).split("\n\n")), set(html.main_text(r["html"] or "").split("\n\n"))
        both, kept, want = both + len(got & right), kept + len(got), want + len(right)
    assert both / kept >= 0.95 and both / want >= 0.95


_WORDS = st.text("ab &<c", min_size=1, max_size=12).map(lambda t: t.replace("&", "&amp;").replace("<", "&lt;"))
_BLOCK = st.one_of(_WORDS.map(lambda t: f"<p>{t}</p>"), _WORDS.map(lambda t: f"<div><p>{t * 30}<p>{t}</div>"), st.just('<div class="ad"><p>Buy now</p></div>'), st.just("<ul><li><a href=/>Home<li><a href=/>News</a></ul>"), st.just("<script>x='<p>'</script>"))


@settings(max_examples=80, deadline=None)
@given(st.lists(_BLOCK, max_size=8), st.lists(_BLOCK, max_size=8), st.booleans())
def test_html_main_text_by_definition(before, body, marked):
    page = "<body><nav><li>Menu</nav>" + "".join(before) + ("<article>" if marked else "<div>") + "".join(body) + ("</article>" if marked else "</div>") + "<footer>end</footer>"
    lines = html.lines_of(page)
    has = any(x.text and x.inside for x in lines)
    weigh = lambda x: (x.size if x.inside else x.unlinked * html.OUTSIDE) if has else x.unlinked
    weights = [float(weigh(x)) for x in lines]
    surge = html.SURGE * max((sum(weights[i : i + html.WIDTH]) for i in range(len(weights))), default=0.0)
    raised = [w + surge if x.inside and x.text else w for x, w in zip(lines, weights, strict=True)]
    runs, of, total = [], {}, Counter()
    for k, (a, b) in enumerate(surges_and_dives(raised, surge, [x.heading for x in lines]) if surge else []):
        held = Counter()
        for i in range(a, b):
            held[lines[i].group] += weights[i]
            runs.append((k, i))
        of[k] = max(held, key=lambda g: (held[g], -g))
        total[of[k]] += sum(held.values())
    strong = {g for g in total if total[g] >= html.SHARE * max(total.values())}
    kept = {i for r, i in runs if of[r] in strong}
    want = [x.text for i, x in enumerate(lines) if x.text and (i in kept or weights[i] and x.group in strong)]
    assert html.main_text(page).split("\n\n") == (want or [""])
    if has:
        assert want == [x.text for x in lines if x.text and x.inside]


def test_html_table_and_long_pages(spark):
    pages = spark.createDataFrame([(1, "u", "<p>Some text &amp; more of it</p>", 1), (None, None, None, 2), (2, "v", "", 3), (1, "u", "<p>Some text &amp; more of it</p>", 4)], "page_id long, url string, html string, text int")
    got = sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in html.extract_pages(pages).collect()), key=str)
    assert got == sorted([(1, "u", "Some text & more of it", 22), (None, None, "", 0), (2, "v", "", 0), (1, "u", "Some text & more of it", 22)], key=str)
    assert html.extract_pages(pages.limit(0)).count() == 0
    for part in ("<svg ", '<a "x ', "<div>", "</span><div>", "<p>x", "<b>", "<!--", "<", "&", "word ", "<p class='ad", "<table><tr><td>"):
        assert isinstance(html.main_text(part * 40_000), str)


def test_html_joins_stretches_of_one_parent():
    story, end = "<p>" + "Many words of the story. " * 40 + "</p>", "<p>Short closing words.</p>"
    page = f"<body><div>{story}<div class=ad><p>Buy now</p></div>{end}</div><nav>x</nav><div><p>Elsewhere.</p></div></body>"
    assert html.main_text(page).endswith("story.\n\nShort closing words.")


def test_confirming_moves_the_sets_once(spark, tmp_path, capsys):
    spark.createDataFrame([(1, [1, 2, 3, 4]), (2, [1, 2, 3, 4, 5]), (3, [7]), (4, [2, 3, 4])], "c long, tokens array<bigint>").write.parquet(str(tmp_path / "sets"))
    spark.createDataFrame([(1, 2), (1, 3), (1, 4), (2, 4)], "a long, b long").write.parquet(str(tmp_path / "pairs"))
    found = neardup._confirm(spark.read.parquet(str(tmp_path / "sets")), spark.read.parquet(str(tmp_path / "pairs")), 75)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 2), (1, 4)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # only then a plan shows what is used again before it runs
    try:
        found.select("a", "b").explain()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    shown = capsys.readouterr().out
    assert any("ReusedExchange" in line and "tokens" in line for line in shown.splitlines())
