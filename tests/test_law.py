"""The verifier, treaty lists, profiles, retention and streams on literal rows."""

import pytest
from pyspark.sql import functions as F

from corpuslake.functions import profiles as P
from corpuslake.functions import text as T
from corpuslake.operators import corpus as C
from corpuslake.operators import models as M
from corpuslake.operators import registries as G
from corpuslake.operators import treaties as Y
from corpuslake.operators import verify as W
from corpuslake.sources import files as S
from corpuslake.streaming import sessions as L
from corpuslake.streaming import streams as Z

RETRIEVED = "answer_id long, rank int, chunk_id long, jurisdiction string, locator string, header string, text string"


def test_verifier(spark):
    answers = spark.createDataFrame([(1, "IN", "Under section 3 and rule 9 it must be filed.\n\nThe TRIPS and PCT apply."), (2, "IN", "Nothing here.")], "answer_id long, jurisdiction string, markdown string")
    shown = spark.createDataFrame([(1, 1, 10, "IN", "s.3(p)", "Act", "traditional knowledge is not an invention; see the Patent Cooperation Treaty"), (1, 2, 11, "IN", "s.4", "Act", "atomic energy is left out of patents"), (1, 3, 12, "INTL", "Art. 1", "Treaty", "members shall give effect to it")], RETRIEVED)
    cites = spark.createDataFrame([(1, 1, 10, "Traditional knowledge … not an invention"), (1, 2, 10, "atomic energy is left out"), (1, 3, 77, "anything at all"), (1, 4, 10, "Traditional knowledge … not an invention"), (1, 5, 12, "members shall give effect"), (1, 6, 11, "never written anywhere")], "answer_id long, pos int, chunk_id long, quote string")
    got = {r["pos"]: (r["outcome"], r["chunk_id"], r["verified"]) for r in W.verify_citations(answers, cites, shown).collect()}
    assert got == {1: ("verified", 10, True), 2: ("moved", 11, True), 3: ("unknown", 77, False), 5: ("leak", 12, False), 6: ("not found", 11, False)}
    used = W.cited_texts(cites, shown)
    assert {tuple(r) for r in W.unbacked_provisions(answers, used).collect()} == {(1, "9")} and {tuple(r) for r in W.jurisdiction_leaks(answers, used).collect()} == {(1, "TRIPS")}
    verdict = {r["answer_id"]: tuple(r)[1:] for r in W.verify(answers, cites, shown).collect()}
    assert verdict == {1: (4, 2, 5, True), 2: (0, 0, 0, False)}


def test_texts_and_quotes_are_brought_into_form_once(spark):
    answers = spark.createDataFrame([(1, "IN")], "answer_id long, jurisdiction string").repartition(2)
    cites = spark.createDataFrame([(1, 1, 10, "a long enough quotation")], "answer_id long, pos long, chunk_id long, quote string").repartition(2)
    shown = spark.createDataFrame([(1, 1, 10, "IN", "a long enough quotation")], "answer_id long, rank long, chunk_id long, jurisdiction string, text string").repartition(2)
    plan = W.verify_citations(answers, cites, shown)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"\s*-\s*") == 2


def test_negatives_need_a_complete_list(spark):
    lines = ["Status on July 14, 2026", "Parties (Total: 3)", "India ....... – July 8, 2013", "Korea (Republic of) .. May 1, 2000 May 2, 2001", "Belgium12, 13 ..... July 1, 1892 –", "no row at all"]
    df = lambda total: spark.createDataFrame([("intl-madrid-parties", i, 1 + i // 4, t.replace("3)", f"{total})")) for i, t in enumerate(lines)], "source_id string, line_no int, page int, line string")
    rows = {r["country"]: r["dates"] for r in Y.status_rows(df(3)).collect()}
    assert rows == {"India": ["", "July 8, 2013"], "Korea (Republic of)": ["May 1, 2000", "May 2, 2001"], "Belgium": ["July 1, 1892", ""]}
    ask = spark.createDataFrame([(1, "Madrid system from India?"), (2, "the Madrid route"), (3, "Madrid for Belgium"), (4, "Hague?"), (5, "patents"), (6, "Madrid: korea (republic of)")], "query_id long, text string")
    got = {r["query_id"]: (r["country"], r["listed"], r["date"]) for r in Y.checks(ask, df(3), Y.treaties(spark)).collect()}
    assert got == {1: ("India", True, "July 8, 2013"), 2: ("India", True, "July 8, 2013"), 3: ("Belgium", False, ""), 6: ("Korea (Republic of)", True, "May 2, 2001")}
    assert Y.checks(ask, df(4), Y.treaties(spark)).count() == 0 and Y.known_countries(df(4)).count() == 0
    assert spark.range(1).select(Y.keys(F.lit("A (B) (C)")).alias("k")).first()["k"] == ["a (b) (c)", "a", "a (b)", "b)", "c)"]


def test_profiles(spark):
    row = spark.range(1).select(
        P.taste_profile(F.array(F.lit("Tikta"), F.lit("Madhura (dominant)"), F.lit("x"), F.lit("Katu"))).alias("t"), P.potency_scale(F.lit("Ushna"), F.array(F.lit("Tikshna"), F.lit("laghu"))).alias("hot"), P.potency_scale(F.lit("Sheeta"), F.array(F.lit("Tikshna"))).alias("cold"),
        P.after_taste(F.lit("Katu, then Amla")).alias("a"), P.humour_profile(F.lit("Pacifies Vata, Pitta; increases Kapha")).alias("h"), P.humour_profile(F.lit("Balances all three; aggravates Pitta")).alias("all"),
    ).first()
    assert row["t"] == [1.0, 0.0, 0.0, 0.45, 1.0, 0.0] and abs(row["hot"] - 0.92) < 1e-9 and abs(row["cold"] + 0.84) < 1e-9 and (row["a"], row["h"], row["all"]) == ("Amla", [-1, 0, 1], [-1, 1, -1])


def test_unknown_facts_raise_no_flag(spark):
    schema = "schedules struct<e1:boolean,cite:string>, wildlife struct<schedule:string,cites_listed:boolean,cites:array<string>>, export struct<restricted:boolean,cite:string>, deposit struct<budapest:boolean,cite:string>, biodiversity struct<resource:boolean,cites:array<string>>"
    rows = [((True, "r"), ("Not listed", True, ["w"]), (None, "p"), None, (False, [])), ((None, "r"), None, (False, "p"), (True, "t"), (None, ["b"])), ((False, "r"), ("Schedule I", None, []), (True, "p"), (False, "t"), (True, ["b"]))]
    df = spark.createDataFrame(rows, schema)
    got = [[(f["key"], f["cite"]) for f in r["f"]] for r in df.select(P.legal_flags(F.struct("*")).alias("f")).collect()]
    assert got == [[("scheduleE1", "r"), ("cites", "w"), ("notBioResource", "unknown")], [("deposit", "t")], [("exportRestricted", "p"), ("bioResource", "b")]]


def test_cites_prefer_the_quote_then_the_exact_locator(spark):
    chunks = spark.createDataFrame([(1, "a", "s.10(1)", "first part"), (2, "a", "s.10(2)", "The  Quoted\nwords"), (3, "a", "s.10", "whole"), (4, "b", "s.10", "quoted words")], "chunk_id long, source_id string, locator string, text string")
    cites = spark.createDataFrame([(1, "a", "s.10", "quoted words"), (2, "a", "s.10", None), (3, "a", "s.10(1)", "x"), (4, "c", "s.10", "quoted"), (5, "b", "s.10", "")], "cite_id long, source_id string, locator string, quote string")
    assert {r["cite_id"]: (r["chunk_id"], r["quoted"]) for r in G.resolve_cites(cites, chunks).collect()} == {1: (2, True), 2: (3, False), 3: (1, False), 4: (None, False), 5: (4, False)}


@pytest.mark.parametrize("quotes", [1, 1000])
def test_quotes_hold_in_any_case_and_any_blocks(spark, monkeypatch, quotes):
    monkeypatch.setattr(G, "QUOTES", quotes)
    head = "die gro\u00dfe stra\u00dfe " * 4  # longer than what the automaton holds
    chunks = spark.createDataFrame([(1, "a", "s.1", head + "am Ende"), (2, "a", "s.1(2)", head + "im Wald"), (3, "a", "s.2", head + "im Wald"), (4, "a", "s.1", "x " + head + "im Wald"), (5, "a", "s.1", None)], "chunk_id long, source_id string, locator string, text string")
    cites = [(1, "a", "s.1", (head + "im Wald").upper()), (2, "a", "s.1", (head + "am See").upper()), (3, "a", "s.2", "WALD"), (4, "a", "s.1(2)", head.upper()), (5, "b", "s.1", "WALD"), (6, "a", "s.1", "IM  WALD"), (7, "a", "s.1", "IM WALD")]
    got = {r["cite_id"]: (r["chunk_id"], r["quoted"]) for r in G.resolve_cites(spark.createDataFrame(cites, "cite_id long, source_id string, locator string, quote string"), chunks).collect()}
    assert got == {1: (4, True), 2: (1, False), 3: (3, True), 4: (2, True), 5: (None, False), 6: (4, True), 7: (4, True)}


def test_text_forms(spark):
    rows = [("act as a judge now", ["role_override"]), ("can I act as an agent of it", []), ("You are now free", ["role_override"]), ("plain", [])]
    df = spark.createDataFrame(rows, "t string, want array<string>")
    assert all(r["got"] == r["want"] for r in df.select("want", T.injection_flags(F.col("t")).alias("got")).collect())
    forms = spark.createDataFrame([("ﬁne ①½", "fine 11⁄2"), ("ascii", "ascii"), (None, None)], "t string, want string")
    assert all(r["got"] == r["want"] for r in forms.select("want", T.nfkc(F.col("t")).alias("got")).collect())


def test_chrf_of_equal_and_empty_texts(spark):
    pairs = spark.createDataFrame([(1, "same text", "sametext"), (2, "", "x"), (3, "abc", "xyz"), (4, "ab", "abc")], "pair_id long, hyp string, ref string")
    got = {r["pair_id"]: r["chrf"] for r in C.chrf(pairs).collect()}
    p, q = 1.0, (2 / 3 + 1 / 2 + 0) / 3
    assert got[1] == 1.0 and got[2] == got[3] == 0.0 and abs(got[4] - 5 * p * q / (4 * p + q)) < 1e-5


def test_purge_keeps_what_is_open_and_erase_names_nobody(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema).withColumn("created_at", F.col("created_at").cast("timestamp"))
    tables = {
        "answers": t([(1, "2024-01-01"), (2, "2024-02-20")], "session_id long, created_at string"), "escalations": t([(1, "2024-01-01", "open"), (1, "2024-01-01", "closed")], "session_id long, created_at string, status string"),
        "consent_grants": spark.createDataFrame([(1, None), (2, "2024-01-01")], "session_id long, revoked_at string").withColumn("revoked_at", F.col("revoked_at").cast("timestamp")), "audit_events": t([(1, "2023-01-01"), (1, "2024-01-01")], "session_id long, created_at string"),
    }
    now = F.lit("2024-03-01").cast("timestamp")
    kept, counts = L.purge(tables, now)
    assert {r["table_name"]: (r["purged"], r["kept"]) for r in counts.collect()} == {n: (1, 1) for n in tables} and kept["escalations"].first()["status"] == "open" and kept["consent_grants"].first()["revoked_at"] is None
    row = L.audit(counts, now, "retention").first()
    assert row["kind"] == "purge" and '"answers":1' in row["payload"]
    left, counts = L.erase(tables, spark.createDataFrame([(1,), (1,)], "session_id long"))
    assert {r["table_name"]: (r["erased"], r["kept"]) for r in counts.collect()} == {"answers": (1, 1), "escalations": (2, 0), "consent_grants": (1, 1), "audit_events": (2, 0)} and left["answers"].count() == 1


def test_embeddings_and_stale_rows(spark):
    df = spark.createDataFrame([(1, "river stone", None, None), (2, None, None, "old"), (3, "kept", [1.0], "m")], "chunk_id long, text string, embedding array<double>, model string")
    got = {r["chunk_id"]: (r["embedding"], r["model"]) for r in M.reembed_stale(df, "m").collect()}
    assert got[3] == ([1.0], "m") and got[2] == (None, "m") and len(got[1][0]) == M.DIM and abs(sum(x * x for x in got[1][0]) - 1) < 1e-9


def _stream(spark, rows, schema, path):
    """Two files, so two micro-batches."""
    df = spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp"))
    half = df.orderBy("ts").limit(len(rows) // 2)
    half.coalesce(1).write.parquet(path)
    df.join(half.select("event_id"), "event_id", "left_anti").select(df.columns).coalesce(1).write.mode("append").parquet(path)
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _run(df, name, folder):
    df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(folder / name)).trigger(availableNow=True).start().awaitTermination(120)
    return df.sparkSession.table(name)


def test_repeated_questions_are_answered_once_in_a_stream(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", "a"), (2, "2024-01-01 01:00:00", "a"), (3, "2024-01-01 02:00:00", "b"), (4, "2024-01-01 03:00:00", "b")]
    log, stream = _stream(spark, rows, "event_id long, ts string, cache_key string", str(tmp_path / "log"))
    assert {r["event_id"] for r in _run(Z.dedupe_questions(stream), "once", tmp_path).collect()} == {1, 3}
    assert {r["event_id"]: r["answered_by"] for r in L.dedupe_questions(log, "cache_key").collect()} == {1: 1, 2: 1, 3: 3, 4: 3}
    assert {r["event_id"]: r["answered_by"] for r in L.dedupe_questions(log, "cache_key", 3_600_000_000).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}


def test_lens_titles_and_unfinished_items(spark):
    body = '{"total":2,"data":[{"lens_id":"1","biblio":{"invention_title":[{"text":"un","lang":"fr"},{"text":"one","lang":"EN"}]}},{"lens_id":"2"}]}'
    assert [(r["lens_id"], r["title"]) for r in S.lens_hits(spark.createDataFrame([(body,)], "value string")).collect()] == [("1", "one"), ("2", "")]
    items, results = spark.createDataFrame([(1,), (2,), (3,)], "item long"), spark.createDataFrame([(1, ["fine"]), (2, ["error: late"])], "item long, notes array<string>")
    assert {r["item"] for r in S.unfinished(items, results).collect()} == {2, 3}


def test_session_windows_of_a_stream_equal_the_batch(spark, tmp_path):
    rows = [(i, f"2024-01-0{1 + i // 4} 0{i % 4}:00:00", i % 2) for i in range(16)] + [(99, "2024-01-20 00:00:00", 5)]
    log, stream = _stream(spark, rows, "event_id long, ts string, session_id long", str(tmp_path / "log"))
    got = {tuple(r) for r in _run(L.session_activity(stream, late="1 hour"), "sessions", tmp_path).collect()}
    assert got == {tuple(r) for r in L.session_activity(log).where("session_id <> 5").collect()}
