"""From marked lines to units and chunks, tables, sources and sinks, on literal rows."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuslake.operators import ingest as I
from corpuslake.sources import files as S
from corpuslake.sources.store import Store

ACT = """<<page 1>>
THE ACT
1. Short title.—(1) This Act may be called so.
CHAPTER II
INVENTIONS
2. A heading that wraps
over two lines.—The following are not inventions:
3
(a) one thing
3. Subs. by Act 5 of 1999, ibid., s. 2 (w.e.f. 1-4-2024).
<<page 2>>
16.
Procedure for grant.- It is granted.
1[SCHEDULE - H
1. An item of the schedule
STATEMENT OF OBJECTS AND REASONS
4. Not law.—never"""


def units(df):
    return [(r["locator"], r["heading"], r["chapter"], r["page"], r["text"]) for r in df.orderBy("unit").collect()]


@pytest.fixture(scope="module")
def act(spark):
    return I.scan_normalised(spark.createDataFrame([("x", ACT), ("empty", "")], "source_id string, text string"))


def test_read_normalised(spark, tmp_path):
    (tmp_path / "in-act.txt").write_text("one\n<<page 2>>\ntwo")
    rows = I.scan_normalised(I.read_normalised(spark, str(tmp_path))).orderBy("line_no").collect()
    assert [tuple(r) for r in rows] == [("in-act", 0, 1, "one"), ("in-act", 2, 2, "two")]


def test_lines_are_cleaned_and_joined(act):
    plain = [r["line"] for r in I.iter_lines(act).orderBy("line_no").collect()]
    assert plain == ["THE ACT", "1. Short title.—(1) This Act may be called so.", "CHAPTER II", "INVENTIONS", "2. A heading that wraps over two lines.—The following are not inventions:", "(a) one thing", "16.", "Procedure for grant.- It is granted.", "1[SCHEDULE - H", "1. An item of the schedule"]
    assert "16. Procedure for grant.- It is granted." in [r["line"] for r in I.iter_lines(act, bare=True).collect()]


def test_sections_chapters_and_schedules(act):
    got = units(I.sections(I.iter_lines(act, bare=True), F.lit("s.")))
    assert got == [("s.1", "Short title", "", 1, "(1) This Act may be called so."), ("s.2", "A heading that wraps over two lines", "CHAPTER II Inventions", 1, "The following are not inventions:\n(a) one thing"), ("s.16", "Procedure for grant", "CHAPTER II Inventions", 2, "It is granted."), ("Schedule H", "Schedule H", "CHAPTER II Inventions", 2, "1. An item of the schedule")]


def test_bare_headings_only_in_sequence(spark):
    lines = ["SCHEDULE A", "1. Title here", "body", "3. Third heading", "9. Out of order", "SCHEDULE B", "4. Inside a schedule", "tail"]
    df = spark.createDataFrame([("x", i, 1, t) for i, t in enumerate(lines)], "source_id string, line_no int, page int, line string")
    assert [(u[0], u[4]) for u in units(I.bare_headings(df, F.lit("Rule ")))] == [("Rule 1", "body"), ("Rule 3", "9. Out of order"), ("Schedule B", "4. Inside a schedule\ntail")]


def test_articles_and_references(spark):
    lines = ["Preamble", "Article 1", "Purpose", "(1) Text of it.", "as set out in", "Article 10", "(hereinafter so)", "Article 2bis", "A first line that ends as a sentence does.", "Article 3"]
    df = spark.createDataFrame([("x", i, 1, t) for i, t in enumerate(lines)], "source_id string, line_no int, page int, line string")
    assert [(u[0], u[1], u[4]) for u in units(I.articles(df))] == [("Art. 1", "Purpose", "(1) Text of it.\nas set out in\nArticle 10\n(hereinafter so)"), ("Art. 2bis", "", "A first line that ends as a sentence does."), ("Art. 3", "", "")]


def test_parse_is_chosen_by_type_and_yield(spark):
    long = "words enough for a unit of its own"
    texts = {"dashed": f"1. One.—{long}\n2. Two.—{long}", "bare": f"1. First heading\n{long}\n2. Second heading\n{long}", "treaty": f"Article 1\nName\n{long}", "manual": f"{long}\n<<page 2>>\n{long}", "odd": long, "hindi": "1. One.—" + "हिन्दी " * 20 + f"\n2. Two.—{long}", "short": "x"}
    kinds = {"treaty": "treaty", "manual": "manual"}
    sources = spark.createDataFrame([(k, t, kinds.get(k, "rules")) for k, t in texts.items()], "source_id string, text string, doc_type string")
    got = {}
    for r in I.choose_parse(I.scan_normalised(sources), sources).collect():
        got.setdefault(r["source_id"], (r["style"], set()))[1].add(r["locator"])
    assert got == {"dashed": ("dashed", {"Rule 1", "Rule 2"}), "bare": ("bare", {"Rule 1", "Rule 2"}), "treaty": ("articles", {"Art. 1"}), "manual": ("pages", {"p.1", "p.2"}), "odd": ("pages", {"p.1"}), "hindi": ("dashed", {"Rule 2"})}


def test_choice_of_parse_looks_at_lines_once(spark):
    sources = spark.createDataFrame([(1, "statute", "1. Short title.—This Act may be called so."), (2, "manual", "हिन्दी पाठ जो बहुत लम्बा है और यहाँ रहता है"), (3, "manual", "A plain page of some length 12345.")], "source_id long, doc_type string, text string")
    units = I.choose_parse(I.scan_normalised(sources), sources)
    assert "Renumbered" not in units._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["source_id"], r["style"], r["locator"]) for r in units.collect()} == {(1, "dashed", "s.1"), (3, "pages", "p.1")}


def test_first_substantial_or_longest(spark):
    rows = [(1, "Art. 1", "a" * 30), (2, "Art. 1", "b" * 200), (3, "Art. 1", "c" * 300), (4, "Art. 2", "d" * 40), (5, "Art. 2", "e" * 50), (6, "Art. 2", "f" * 50)]
    df = spark.createDataFrame([("x", u, loc, "", "", 1, t) for u, loc, t in rows], "source_id string, unit long, locator string, heading string, chapter string, page int, text string")
    assert sorted(r["unit"] for r in I.tidy(df, F.lit(False)).collect()) == [2, 5] and sorted(r["unit"] for r in I.tidy(df, F.lit(True)).collect()) == [1, 4]


def chunked(spark, texts, base="s.1"):
    df = spark.createDataFrame([(f"x{i}", i, base, t) for i, t in enumerate(texts)], "source_id string, unit int, locator string, text string")
    out = {}
    for r in I.chunk_units(df).orderBy("unit", "part").collect():
        out.setdefault(r["unit"], []).append((r["locator"], r["text"]))
    return [out[i] for i in range(len(texts))]


def test_units_are_cut_at_clauses_then_lines(spark):
    clauses = "head\n" + "\n".join(f"({c}) " + "x" * 1100 for c in "abcd")
    lines = "\n".join(["y" * 1000] * 5)
    short, packed, wide, whole, blank = chunked(spark, [" short ", clauses, lines, "z" * 9000, ""])
    assert short == [("s.1", "short")] and whole == [("s.1", "z" * 9000)] and blank == [("s.1", "")]
    assert [loc for loc, _ in packed] == ["s.1(a)–(b)", "s.1(c)–(d)"] and "\n".join(t for _, t in packed) == clauses
    assert [len(t) for _, t in wide] == [2001, 2001, 1000]
    one = chunked(spark, ["(a) " + "x" * 3000 + "\n" + "w" * 600 + "\n1.\nshort"], "Art. 2")[0]
    assert [loc for loc, _ in one] == ["Art. 2.a", "Art. 2.a", "Art. 2.1"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0, 1, 30, 700, 1199, 1200, 2399, 2400, 2401, 3300]), st.booleans()), min_size=1, max_size=14))
def test_spans_are_as_long_as_the_rules_let_them(lines):
    """Every chunk obeys the limits, no next clause or line would still have fitted, and all text is in one chunk, in order."""
    sizes, opens = np.array([n for n, _ in lines]), np.array([o and n > 0 for n, o in lines])
    got = I.spans(sizes, opens)
    size = lambda a, b: int(sizes[a:b].sum()) + max(b - a - 1, 0)
    if size(0, len(lines)) <= I.LONGEST:
        assert got == [{"start": 0, "n": len(lines), "first": -1, "last": -1}]
        return
    held = [i for s in got for i in range(s["start"], s["start"] + s["n"])]
    assert held == sorted(set(held)) and all(sizes[i] == 0 for i in set(range(len(lines))) - set(held))
    bounds = sorted({0, len(lines), *np.flatnonzero(opens).tolist()})
    for s in got:
        a, b = s["start"], s["start"] + s["n"]
        inside = [i for i in np.flatnonzero(opens) if a <= i < b]
        assert not inside or s["first"] <= inside[0] and s["last"] >= inside[-1]
        later = [x for x in bounds if x > b]
        if a in bounds and b in bounds:  # whole clauses
            assert size(a, b) <= I.TARGET + 1 or len([x for x in bounds if a < x < b]) == 0
            assert not later or size(a, later[0]) > I.TARGET + 1
        else:
            assert size(a, b) <= I.TARGET or s["n"] == 1 or size(a, b) == size(a, a + 1) + s["n"] - 1


def test_clauses_have_their_text(spark):
    df = spark.createDataFrame([("x", 1, "lead\nmore\n(a) one\n1.\ntwo\n"), ("y", 2, "(b) all"), ("z", 3, "")], "source_id string, unit int, text string")
    assert sorted(tuple(r) for r in I.split_clauses(df).collect()) == [("x", 1, 0, "", "lead\nmore"), ("x", 1, 1, "a", "(a) one"), ("x", 1, 2, "1", "1.\ntwo\n"), ("y", 2, 0, "b", "(b) all"), ("z", 3, 0, "", "")]


def test_joined_lines_in_a_row(spark):
    """A line that another one has taken doesn't take a third; a bare number looks at the line after its heading."""
    rows = ["1. Wraps", "2. Wraps —too", "3. And —on", "Article", "12", "13", "16.", "Procedure that", "goes—on", "17.", "lower", "Article", "7bis"]
    df = spark.createDataFrame([("x", i, 1, t) for i, t in enumerate(rows)], "source_id string, line_no int, page int, line string")
    lines = lambda bare: [(r["line_no"], r["line"]) for r in I.iter_lines(df, bare).orderBy("line_no").collect()]
    assert lines(False) == [(0, "1. Wraps 2. Wraps —too"), (2, "3. And —on"), (3, "Article 12"), (6, "16."), (7, "Procedure that"), (8, "goes—on"), (9, "17."), (10, "lower"), (11, "Article 7bis")]
    assert lines(True) == [(0, "1. Wraps 2. Wraps —too"), (2, "3. And —on"), (3, "Article 12"), (6, "16. Procedure that goes—on"), (9, "17."), (10, "lower"), (11, "Article 7bis")]


def test_table_rows_keep_their_headers(spark):
    grid = [["Category", "x" * 61, "", ""], ["", "", "Study", ""], ["1", "2.", "3)", "4"], ["(A)\nAqueous", "No", "Yes", None], ["", "", "", ""], ["Only", "", "", ""]]
    cells = spark.createDataFrame([(1, r, c, t) for r, row in enumerate(grid) for c, t in enumerate(row)] + [(2, 0, 0, "")], "table_id int, row int, col int, text string")
    got = [(r["table_id"], r["row"], r["line"]) for r in I.render_table(cells).orderBy("row").collect()]
    assert got == [(1, 3, "Category: (A) Aqueous | column 2: No | Study: Yes"), (1, 5, "Category: Only")]


def test_manifest_lines_and_rules(spark):
    good = '{"id":"in-a","jurisdiction":"IN","regime":["patent"],"doc_type":"statute","fetch":"manual","format":"pdf"}'
    lines = [good, good.replace("in-a", "in-b").replace('"fetch":"manual"', '"fetch":"auto"'), good.replace("in-a", "xx").replace('"pdf"', '"doc"').replace("}", ',"colour":1}'), good]
    got = {tuple(r) for r in S.validate_manifest(S.read_manifest(spark.createDataFrame([(x,) for x in lines], "value string"))).collect()}
    assert got == {("in-b", "fetch_url"), ("xx", "prefix"), ("xx", "format"), ("xx", "unknown key"), ("in-a", "repeated id")}


def test_landing_zone(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b" %PDF-1.7 x")
    (tmp_path / "b.pdf").write_bytes(b"<!DOCTYPE html><p>gone")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert {r["path"][-5:]: r["ok"] for r in S.scan_raw(files, F.lit("pdf")).collect()} == {"a.pdf": True, "b.pdf": False}


def test_chunks_replace_their_own_partition(spark, tmp_path):
    df = lambda rows: spark.createDataFrame(rows, "source_id string, chunk_id long, text string")
    path = str(tmp_path / "chunks")
    S.write_chunks(df([("a", 1, "x"), ("b", 2, "y")]), path)
    S.write_chunks(df([("a", 3, "z")]), path)
    assert {(r["source_id"], r["chunk_id"]) for r in spark.read.parquet(path).collect()} == {("a", 3), ("b", 2)}


def test_a_hot_bucket_is_written_by_several_tasks(spark, tmp_path):
    store, was = Store(str(tmp_path), {"t": "k string, v long"}, {"t": "k"}), spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    rows = spark.range(0, 200_000, 1, 8).select(F.lit("hot").alias("k"), F.xxhash64("id").alias("v"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "300k")
    try:
        store.publish(spark, store.manifest(spark), {"t": (store.touched("t", rows), rows)})
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", was)
    assert store.read(spark, "t").count() == 200_000 and len(list(tmp_path.glob("data/*/bucket=*/part-*.parquet"))) > 2
