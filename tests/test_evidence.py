"""Clauses, rows, markers, routing and document choice on literal rows."""

from pyspark.sql import functions as F

from corpuslake.operators import evidence as E
from corpuslake.plans import registry


def test_row_lines_read_left_to_right(spark):
    words = spark.createDataFrame([(1, 50.0, 10.2, "2013"), (1, 5.0, 9.8, "India"), (1, 5.0, 22.0, "Japan")], "page int, x double, y double, word string")
    assert [r["line"] for r in E.row_lines(words).orderBy("row").collect()] == ["India 2013", "Japan"]


def test_skip_to_keeps_from_the_first_equal_line(spark):
    lines = F.array(*[F.lit(x) for x in "abab"])
    row = spark.range(1).select(E.skip_to(lines, F.lit("b")).alias("b"), E.skip_to(lines, F.lit("z")).alias("z")).first()
    assert row["b"] == ["b", "a", "b"] and row["z"] is None


def test_clauses_and_their_locator(spark):
    lines = spark.createDataFrame([(1, 1, "head"), (1, 2, "(a) one"), (1, 3, "more"), (1, 4, "2[(b) two"), (2, 1, "")], "unit int, k int, line string")
    got = [(r["unit"], r["clause_id"], r["n_lines"]) for r in E.clauses(lines).orderBy("unit", "piece").collect()]
    assert got == [(1, "", 1), (1, "a", 2), (1, "b", 1), (2, "", 1)]
    at = lambda base, n: E.clause_locator(F.lit(base), F.lit("a"), F.lit("c"), F.lit(n))
    assert list(spark.range(1).select(at("s.3", 2).alias("w"), at("Art. 9", 1).alias("x"), at("s.3", 0).alias("y"), at("Art. 9", 3).alias("z")).first()) == ["s.3(a)–(c)", "Art. 9.a", "s.3", "Art. 9.a–.c"]


def test_markers_in_their_variants(spark):
    df = spark.createDataFrame([(1, 'One [[c:39|"a span"]]. Two 【40 | “b”】 and [[41|"c"] end'), (2, "none"), (3, None)], "id int, a string")
    cited = [(r["id"], r["at"], r["cited"], r["span"]) for r in E.citations(df, "id", "a").orderBy("id", "at").collect()]
    assert cited == [(1, 0, "39", "a span"), (1, 1, "40", "b"), (1, 2, "41", "c")]
    assert [r["p"] for r in df.orderBy("id").select(E.prose(F.col("a")).alias("p")).collect()] == ["One. Two and end", "none", None]


def test_routing_search_and_authority(spark):
    row = spark.range(1).select(
        E.routed(E.padded(F.lit("A patent on food, GI tag"))).alias("r"), E.routed(E.padded(F.lit("Root and honey")), E.MATERIAL_WORDS).alias("m"), E.search_query(F.array(F.lit("Aloe vera (old), ab"), F.lit("aloe; ALOE VERA / x1 /ghee"))).alias("q"),
        E.authority(F.lit("rules")).alias("a"), E.authority(F.lit("poster")).alias("b"), E.authority(F.lit(None).cast("string")).alias("c"),
    ).first()
    assert row["r"] == ["patent", "gi", "food"] and row["m"] == ["animal", "plant"] and row["q"] == '"ALOE VERA" OR aloe OR ghee' and (row["a"], row["b"], row["c"]) == (1, 5, 5)


def test_select_documents_keeps_named_and_primary(spark):
    hits = [(1, r, r == 20, 0 if r in (9, 10, 11, 12, 13) else 5) for r in range(1, 21)]
    got = {r["rank"] for r in E.select_documents(spark.createDataFrame(hits, "query_id int, rank int, named boolean, authority int")).collect()}
    assert got == {20, 9, 10, 11, 12, 1, 2, 3}


def test_abs_route_asks_then_decides(spark):
    b = lambda x: F.lit(x).cast("boolean")
    cases = [((None, None, None, None), "ask foreign"), ((False, True, None, None), "not_applicable"), ((True, False, None, True), "ask normally_traded"), ((True, False, True, True), "exempt_check"), ((True, True, False, True), "nba_approval"), ((True, False, False, False), "sbb_intimation")]
    row = spark.range(1).select(*[E.abs_route(*map(b, args)).alias(str(i)) for i, (args, _) in enumerate(cases)]).first()
    assert list(row) == [want for _, want in cases]


def test_near_locators_and_a_document_without_any(spark):
    chunks = spark.createDataFrame([(7, i, f"s.{i}") for i in range(9)], "doc_id int, chunk_id int, locator string")
    missing = spark.createDataFrame([(1, 7), (2, 8)], "item_id int, doc_id int")
    assert {r["item_id"]: r["suggestions"] for r in E.near_locators(missing, chunks).collect()} == {1: "s.0,s.1,s.2,s.3,s.4,s.5", 2: None}


def test_lines_of_a_page_move_nothing(spark):
    words = [(1, 5.0, 0.0, "b"), (1, 1.0, 0.4, "a"), (1, 2.0, 12.0, "c"), (1, 2.0, None, "z"), (2, 1.0, 3.1, "d"), (2, 1.0, 2.9, "d"), (2, 0.0, 3.0, None)]
    flat = spark.createDataFrame(words, "page long, x double, y double, word string")
    pages = flat.groupBy("page").agg(F.collect_list(F.struct("x", "y", "word")).alias("words")).union(spark.createDataFrame([(3, []), (4, None)], "page long, words array<struct<x:double,y:double,word:string>>"))
    got = E.page_lines(pages)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in E.row_lines(flat).collect()} and got.columns == ["page", "row", "line"]


def test_row_lines_query_moves_nothing(spark):
    plan = registry.queries()["n5_row_lines"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
