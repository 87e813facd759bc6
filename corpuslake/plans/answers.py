"""More queries over the driver's tables: passages, answers, catalogue checks, evaluation, merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslake.functions import passages as G
from corpuslake.functions import text as T
from corpuslake.operators import answers as A
from corpuslake.operators import catalogue as C
from corpuslake.operators import classify as Y
from corpuslake.operators import corpus as P
from corpuslake.operators import register as N
from corpuslake.plans.queries import CHUNKS, EDGES, ITEMS, LOG, QUESTIONS, VERSIONS, query
from corpuslake.sources import views as V

LINES = "lines AS (SELECT doc_id, line, line_no FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents))"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).select("doc_id", "line", (F.col("at") + 1).alias("line_no"))


def _html_sql() -> str:
    out = "html"
    for tag in G.SKIPPED:
        out = rf"regexp_replace({out}, '(?is)<{tag}\b[^>]*>.*?</{tag}>', ' ', 'g')"
    out = rf"regexp_replace(regexp_replace({out}, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
    for reference, char in G.REFERENCES:
        out = f"replace({out}, '{reference}', '{char.replace(chr(39), chr(39) * 2)}')"
    return rf"SELECT page_id, trim(regexp_replace({out}, '[ \t\r\n\f]+', ' ', 'g'), ' ') AS text FROM pages"


@query(_html_sql())
def n2_html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "pages").select("page_id", G.html_text(F.col("html")).alias("text"))


@query(f"WITH {LINES}, c AS (SELECT doc_id, string_split(line, ' | ') AS cells FROM lines WHERE contains(line, ' | ')), t AS (SELECT doc_id, max(len(cells)) AS n_cols, count(*) AS n_rows, sum(list_sum([length(x) FOR x IN cells])) / sum(len(cells)) AS mean FROM c GROUP BY 1) SELECT doc_id, n_cols, n_rows FROM t WHERE n_cols >= 3 AND n_rows >= 3 AND mean < 60")
def n4_is_tabular(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _lines(spark, sf_dir).where(F.contains("line", F.lit(" | "))).select("doc_id", F.split("line", r" \| ").alias("cells"))
    chars = F.aggregate("cells", F.lit(0), lambda n, x: n + F.char_length(x))
    tables = cells.groupBy("doc_id").agg(F.max(F.size("cells")).alias("n_cols"), F.count(F.lit(1)).alias("n_rows"), (F.sum(chars) / F.sum(F.size("cells"))).alias("mean"))
    return tables.where("n_cols >= 3 AND n_rows >= 3 AND mean < 60").select("doc_id", "n_cols", "n_rows")


@query(f"WITH {LINES} SELECT doc_id, line_no FROM lines WHERE length(trim(line, ' ')) < 40")
def n7_needs_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines stand for pages."""
    return _lines(spark, sf_dir).where(F.char_length(F.trim("line")) < 40).select("doc_id", "line_no")


@query(rf"WITH {QUESTIONS} SELECT question_id, round(CASE WHEN length(regexp_replace(text, '[^\pL\pM]', '', 'g')) > 0 THEN length(regexp_replace(text, '[^\x{{0B80}}-\x{{0BFF}}]', '', 'g')) / length(regexp_replace(text, '[^\pL\pM]', '', 'g')) ELSE 0 END, 6) AS share FROM questions")
def n8_script_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.questions(spark, sf_dir).select("question_id", F.round(G.script_share(F.col("text"), r"\x{0B80}-\x{0BFF}"), 6).alias("share"))


@query(r"""WITH p AS (SELECT doc_id, text, substr(text, 1, 660) AS h, right(text, 540) AS t FROM documents)
SELECT doc_id, CASE WHEN length(text) <= 1500 THEN text ELSE regexp_replace(CASE WHEN regexp_matches(h, '(?s)^.+\n') THEN regexp_replace(h, '\n[^\n]*$', '') ELSE h END, '[ \t\r\n\f]+$', '') || chr(10) || '[…]' || chr(10) || regexp_replace(CASE WHEN regexp_matches(t, '(?s)\n.') THEN regexp_replace(t, '^[^\n]*\n', '') ELSE t END, '^[ \t\r\n\f]+', '') END AS text FROM p""")
def n11_shorten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").select("doc_id", G.shorten(F.col("text"), 1200).alias("text"))


@query(f"WITH {LINES} SELECT doc_id, (line_no - 1) // 20 + 1 AS page, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY line_no)) AS unit FROM lines GROUP BY ALL")
def p5_parse_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty lines make a page."""
    paged = _lines(spark, sf_dir).withColumn("page", F.floor((F.col("line_no") - 1) / 20) + 1)
    unit = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return paged.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n_lines"), unit.alias("u")).select("doc_id", "page", "n_lines", F.md5(F.array_join("u.line", "\n")).alias("unit"))


@query(f"WITH {CHUNKS} SELECT source_id, locator, chunk_id FROM chunks QUALIFY row_number() OVER (PARTITION BY source_id, locator ORDER BY length(text) < 150, CASE WHEN length(text) < 150 THEN -length(text) ELSE 0 END, chunk_id) = 1")
def p8_keep_first_substantial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.first_substantial(V.chunks(spark, sf_dir))


@query(f"WITH {CHUNKS} SELECT chunk_id, concat_ws(' > ', nullif(source_id, ''), nullif(jurisdiction, ''), locator) AS header FROM chunks")
def p12_context_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.filter(F.array("source_id", "jurisdiction", "locator"), lambda x: x != "")
    return V.chunks(spark, sf_dir).select("chunk_id", F.concat_ws(" > ", parts).alias("header"))


@query(f"WITH {ITEMS}, m AS (SELECT item_id, lower(name) AS name, regexp_extract(lower(name), 'a[^e]*e[^r]*r') AS found FROM items) SELECT item_id, round(CASE WHEN found = '' THEN 0 ELSE 1 - (length(found) - 3) / (length(name) + 1) END, 6) AS score FROM m")
def f16_subsequence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.catalogue(spark, sf_dir).select("item_id", F.round(G.subsequence_score(F.lower("name"), "aer"), 6).alias("score"))


@query(f"WITH {ITEMS} SELECT item_id FROM items WHERE contains(lower(concat_ws(' ', name, family, type)), 'brand') AND contains(lower(concat_ws(' ', name, family, type)), 'e')")
def f15_material_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    hay = F.lower(F.concat_ws(" ", "name", "family", "type"))
    return V.catalogue(spark, sf_dir).where(F.forall(F.split(F.lit("brand e"), " "), lambda w: F.contains(hay, w))).select("item_id")


@query(f"WITH {ITEMS} SELECT item_id FROM items WHERE difficulty IN (1, 3) AND list_has_any(tags, (SELECT list(tag) FROM (SELECT string_split(name, ' ')[1] AS tag FROM items GROUP BY 1 HAVING count(*) % 2 = 0)))")
def f14_facet_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any of the values within a facet, and across facets; the tags asked for are the first words that an even number of items has."""
    items = V.catalogue(spark, sf_dir)
    wanted = items.groupBy(F.col("tags")[0].alias("tag")).agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 0").select("tag")
    return items.where("difficulty IN (1, 3)").select("item_id", F.explode("tags").alias("tag")).join(wanted, "tag", "left_semi").select("item_id").distinct()


@query("SELECT page_id, CASE WHEN ends_with(lower(url), '.pdf') THEN url || '#page=' || (page_id % 9) ELSE url END AS link FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url || '.PDF' ELSE url END AS url FROM pages)")
def f26_deep_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.when(F.col("page_id") % 2 == 0, F.concat("url", F.lit(".PDF"))).otherwise(F.col("url"))
    return V.table(spark, sf_dir, "pages").select("page_id", G.deep_link(url, F.col("page_id") % 9).alias("link"))


@query("SELECT c_custkey, coalesce(n, 0) AS n_orders, coalesce(last, TIMESTAMP '1970-01-01') AS last FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderdate) AS last FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def j13_attach_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = V.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.max("o_orderdate").alias("last"))
    joined = V.table(spark, sf_dir, "customer").select("c_custkey").join(profile, "c_custkey", "left")
    return joined.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.coalesce("last", F.lit("1970-01-01").cast("timestamp_ntz")).alias("last"))


@query(f"WITH {ITEMS} SELECT item_id FROM items WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = item_id AND l_returnflag = 'R')")
def j15_in_tours(spark: SparkSession, sf_dir: str) -> DataFrame:
    stops = V.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("item_id"))
    return V.catalogue(spark, sf_dir).select("item_id").join(stops, "item_id", "left_semi")


@query(f"WITH {ITEMS} SELECT item_id, unnest(tags) AS bed FROM items")
def j18_bed_by_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.catalogue(spark, sf_dir).select("item_id", F.explode("tags").alias("bed"))


@query("SELECT item_id, CASE WHEN d.doc_id IS NULL THEN 'unknown source' WHEN contains(trim(regexp_replace(d.text, '\\s+', ' ', 'g'), ' '), trim(regexp_replace(b.text, '\\s+', ' ', 'g'), ' ')) THEN 'ok' ELSE 'quote missing' END AS state FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id")
def v3_check_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("body"))
    joined = V.table(spark, sf_dir, "benchmark").join(docs, "item_id", "left")
    return joined.select("item_id", F.when(F.col("body").isNull(), "unknown source").when(F.contains(T.flat(F.col("body")), T.flat(F.col("text"))), "ok").otherwise("quote missing").alias("state"))


@query("SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, coalesce((props::JSON->>'k')::BIGINT, -1) ORDER BY ts, event_id) > 1")
def v13_repeated_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tool calls of a run with JSON arguments; the same call again is one too many, whatever the order of its arguments."""
    calls = V.table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("run"), F.col("event_type").alias("tool"), F.col("props").alias("arguments"))
    return A.repeated_calls(calls, ("ts", "event_id")).select("event_id")


@query("SELECT p_partkey, p_brand FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def v14_coverage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = V.table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return V.table(spark, sf_dir, "part").select("p_partkey", "p_brand").join(asked, "p_partkey", "left_anti")


@query("SELECT d.i AS size, count(*) AS n FROM range(0, 100) d(i) JOIN part ON p_size = d.i GROUP BY 1")
def a2_fixed_domain_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = V.table(spark, sf_dir, "part").groupBy(F.col("p_size").cast("long").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    return spark.range(100).withColumnRenamed("id", "size").join(counts, "size", "left").where("n > 0")


_ANSWERS = "ans AS (SELECT l_orderkey AS answer_id, count(*) AS hits, count(*) FILTER (l_quantity > 25) AS agreed, bool_or(l_returnflag = 'R') AS named, count(*) AS total, count(*) FILTER (l_linestatus = 'F') AS verified, count(*) FILTER (l_discount > 0.08) AS flags, bool_or(l_linenumber <= 3 AND l_tax > 0.05) AS top FROM lineitem GROUP BY 1)"


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as answers and their lines as citations."""
    line = V.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("answer_id"))
    return line.agg(F.count(F.lit(1)).alias("hits"), F.count_if(F.col("l_quantity") > 25).alias("agreed"), F.bool_or(F.col("l_returnflag") == "R").alias("named"), F.count(F.lit(1)).alias("total"), F.count_if(F.col("l_linestatus") == "F").alias("verified"), F.count_if(F.col("l_discount") > 0.08).alias("flags"), F.bool_or((F.col("l_linenumber") <= 3) & (F.col("l_tax") > 0.05)).alias("top"))


@query(f"WITH {_ANSWERS}, s AS (SELECT answer_id, round(least(1.0::DOUBLE, 0.5::DOUBLE + 0.5::DOUBLE * agreed / hits + CASE WHEN named THEN 0.2::DOUBLE ELSE 0 END) * (verified / total) * (1 - least(0.6::DOUBLE, 0.2::DOUBLE * flags)) * CASE WHEN top THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END, 3) AS score, concat_ws('; ', CASE WHEN named THEN 'the provision you named was found' END, verified || ' of ' || total || ' citations verified', CASE WHEN flags > 0 THEN flags || ' verifier warning(s)' END) AS reasons FROM ans) SELECT answer_id, score, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.45 THEN 'medium' ELSE 'low' END AS band, reasons FROM s")
def f24_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.confidence(_answers(spark, sf_dir)).select("answer_id", "score", "band", F.array_join("reasons", "; ").alias("reasons"))


@query(f"WITH {_ANSWERS} SELECT o_orderpriority AS category, round(avg((verified = total AND named)::INT), 6) AS correct FROM ans JOIN orders ON o_orderkey = answer_id GROUP BY 1")
def a13_citation_correctness(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("answer_id"), F.col("o_orderpriority").alias("category"))
    right = ((F.col("verified") == F.col("total")) & F.col("named")).cast("int")
    return _answers(spark, sf_dir).join(orders, "answer_id").groupBy("category").agg(F.round(F.avg(right), 6).alias("correct"))


@query("SELECT o_orderpriority AS category, round(avg(CASE WHEN o_orderstatus = 'F' THEN (o_orderkey % 3 = 0)::INT END), 6) AS abstention, round(avg(CASE WHEN o_orderstatus <> 'F' THEN (o_orderkey % 3 = 0)::INT END), 6) AS false_abstention FROM orders GROUP BY 1")
def a14_abstention(spark: SparkSession, sf_dir: str) -> DataFrame:
    gave_up = (F.col("o_orderkey") % 3 == 0).cast("int")
    unanswerable = F.col("o_orderstatus") == "F"
    return V.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("category")).agg(F.round(F.avg(F.when(unanswerable, gave_up)), 6).alias("abstention"), F.round(F.avg(F.when(~unanswerable, gave_up)), 6).alias("false_abstention"))


@query("SELECT a.o_orderpriority AS category, count(*) AS pairs, round(avg((a.o_orderstatus = b.o_orderstatus)::INT), 6) AS agreement FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 GROUP BY 1")
def a15_twin_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = V.table(spark, sf_dir, "orders")
    twins = o.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("o_orderstatus").alias("twin"))
    return o.join(twins, "o_orderkey").groupBy(F.col("o_orderpriority").alias("category")).agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg((F.col("o_orderstatus") == F.col("twin")).cast("int")), 6).alias("agreement"))


@query("SELECT user_id, floor(100 * count(DISTINCT event_type) / 5 + 0.5)::BIGINT AS percent FROM events GROUP BY 1")
def a18_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "events").groupBy("user_id").agg(F.floor(100 * F.countDistinct("event_type") / 5 + 0.5).alias("percent"))


@query("WITH s AS (SELECT user_id, avg((event_type <> 'error')::INT) AS share FROM events GROUP BY 1) SELECT user_id, round(share, 6) AS share, CASE WHEN share >= 0.9 THEN 'gold' WHEN share >= 0.7 THEN 'silver' WHEN share >= 0.5 THEN 'bronze' ELSE 'none' END AS medal FROM s")
def a19_quiz_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg((F.col("event_type") != "error").cast("int")).alias("share"))
    return s.select("user_id", F.round("share", 6).alias("share"), A.score_band(F.col("share")).alias("medal"))


@query("SELECT l_orderkey AS answer_id, count(*) FILTER (l_linestatus = 'F') AS verified, coalesce(string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) FILTER (l_discount > 0.08), '') AS reasons FROM lineitem GROUP BY 1")
def a20_verify_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    reasons = F.collect_set(F.when(F.col("l_discount") > 0.08, F.col("l_returnflag")))
    return V.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("answer_id")).agg(F.count_if(F.col("l_linestatus") == "F").alias("verified"), F.array_join(F.array_sort(reasons), ",").alias("reasons"))


@query(f"WITH {CHUNKS} SELECT count(DISTINCT locator) AS locators, count(DISTINCT source_id) AS sources FROM chunks WHERE doc_id IN (SELECT item_id FROM benchmark)")
def a22_expected_locator_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    golden = V.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"))
    return V.chunks(spark, sf_dir).join(golden, "doc_id", "left_semi").agg(F.countDistinct("locator").alias("locators"), F.countDistinct("source_id").alias("sources"))


@query("SELECT l_orderkey AS answer_id, l_returnflag AS source_id, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS quotes FROM lineitem GROUP BY ALL")
def a23_group_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    grouped = V.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("answer_id"), F.col("l_returnflag").alias("source_id")).agg(quotes.alias("q"))
    return grouped.select("answer_id", "source_id", F.array_join(F.col("q.l_partkey").cast("array<string>"), ",").alias("quotes"))


@query("SELECT l_partkey AS item_id, min(l_shipdate) AS first_at, arg_min(l_orderkey, (l_shipdate, l_orderkey)) AS first_order FROM lineitem GROUP BY 1")
def r13_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.min(F.struct("l_shipdate", "l_orderkey")).alias("f")
    return V.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("item_id")).agg(first).select("item_id", F.col("f.l_shipdate").alias("first_at"), F.col("f.l_orderkey").alias("first_order"))


@query("WITH n AS (SELECT user_id, arg_max(CASE WHEN event_type = 'error' THEN '' ELSE coalesce(props, '') END, (ts, event_id)) AS note FROM events GROUP BY 1) SELECT * FROM n WHERE trim(note, ' ') <> ''")
def r17_latest_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An error event stands for a blank note, which deletes."""
    body = F.when(F.col("event_type") == "error", "").otherwise(F.coalesce("props", F.lit("")))
    return V.table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by(body, F.struct("ts", "event_id")).alias("note")).where(F.trim("note") != "")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def u5_seed_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = V.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return A.prefer_incoming(stored, stored.where("c_custkey % 3 = 0").withColumn("c_mktsegment", F.lit("NEW")), "c_custkey")


@query("SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'ask size' WHEN p_size > 40 THEN 'large' WHEN p_retailprice > 1500 THEN 'dear' WHEN p_partkey % 5 = 0 THEN 'ask stock' WHEN p_partkey % 5 = 1 THEN 'stocked' ELSE 'general' END AS class FROM part")
def u10_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey") % 5
    rules = [("size", F.when(F.col("p_size") % 7 != 0, F.col("p_size") > 40), "large"), ("price", F.col("p_retailprice") > 1500, "dear"), ("stock", F.when(key != 0, key == 1), "stocked")]
    return V.table(spark, sf_dir, "part").select("p_partkey", A.decide(rules, "general").alias("class"))


@query("SELECT 'source' AS kind, source AS key FROM documents UNION SELECT 'lang', lang FROM documents UNION SELECT 'nation', n_name FROM nation")
def u12_graph_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, nation = V.table(spark, sf_dir, "documents"), V.table(spark, sf_dir, "nation")
    return docs.select(F.lit("source").alias("kind"), F.col("source").alias("key")).union(docs.select(F.lit("lang"), "lang")).union(nation.select(F.lit("nation"), "n_name")).distinct()


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 4 <> 0)")
def u14_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers stand for items; a closed order finishes one unless its number marks an error."""
    done = V.table(spark, sf_dir, "orders").where("o_orderstatus = 'F' AND o_orderkey % 4 <> 0").select(F.col("o_custkey").alias("c_custkey"))
    return V.table(spark, sf_dir, "customer").select("c_custkey").join(done, "c_custkey", "left_anti")


@query("SELECT side, c_mktsegment, count(*) AS n FROM (SELECT 'missing' AS side, 'NEW' AS c_mktsegment FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT 'stale', c_mktsegment FROM customer WHERE c_custkey % 5 = 0) GROUP BY ALL")
def io9_export_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = V.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    now = stored.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 5 == 0, "NEW").otherwise(F.col("c_mktsegment")))
    return A.drift(stored, now).groupBy("side", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {LOG} SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS latency_us FROM log")
def s8_stage_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = F.unix_micros("ts")
    return V.sessions(spark, sf_dir).select("event_id", (us - F.lag(us).over(Window.partitionBy("session_id").orderBy("ts", "event_id"))).alias("latency_us"))


_HERBS = """herbs AS (SELECT p_partkey AS item_id, lower(p_name) AS name, lower(p_brand) AS botanical, 'alias' || (p_partkey % 50) AS aliases, lower(p_type) AS themes, CASE WHEN p_partkey % 4 = 0 THEN lower(p_type) ELSE '' END AS headline,
  lower(p_name || ' ' || p_type || ' ' || p_name) AS body, string_split(p_name, ' ') AS f_themes, p_type, p_brand, p_size % 3 + 1 AS difficulty, p_partkey % 200 - 100 AS year, p_size % 5 AS rarity FROM part),
asks AS (SELECT p_partkey AS query_id, CASE p_partkey % 7 WHEN 0 THEN split_part(p_name, ' ', 1) WHEN 1 THEN substr(p_name, 1, 1) || substr(p_name, 3, 4) WHEN 2 THEN upper(p_name) WHEN 3 THEN split_part(p_type, ' ', 1) || ' ' || split_part(p_name, ' ', 1) WHEN 4 THEN 'brand alias7' WHEN 5 THEN '' ELSE ' zz qq' END AS text,
  ['relevance', 'alpha', 'easiest', 'oldest', 'rarest'][p_partkey // 20 % 5 + 1] AS sort, p_partkey // 20 % 3 = 0 AS by_type, p_partkey // 20 % 4 = 0 AS by_brand, p_type AS want_type, p_brand AS want_brand FROM part WHERE p_partkey % 20 = 0)"""


@query(rf"""WITH {_HERBS}, tokens AS (SELECT query_id, unnest(list_filter(regexp_split_to_array(lower(trim(text)), '\s+'), lambda w: w <> '')) AS word FROM asks), words AS (SELECT DISTINCT word FROM tokens),
formed AS (SELECT word, array_to_string(list_transform(string_split(word, ''), lambda c, i: CASE WHEN i = 1 THEN regexp_escape(c) ELSE '[^' || regexp_escape(c) || ']*' || regexp_escape(c) END), '') AS form FROM words),
exact AS (SELECT item_id, word, name, form, CASE WHEN name = word THEN 1000 WHEN starts_with(name, word) THEN 620 WHEN contains(name, word) THEN 380 ELSE 0 END + CASE WHEN contains(botanical, word) THEN 320 ELSE 0 END + CASE WHEN contains(aliases, word) THEN 280 ELSE 0 END
  + CASE WHEN contains(themes, word) THEN 150 ELSE 0 END + CASE WHEN contains(headline, word) THEN 240 ELSE 0 END + CASE WHEN contains(body, word) THEN 45 + 22 * least(6, (length(body) - length(replace(body, word, ''))) / length(word)) ELSE 0 END AS points FROM formed, herbs),
valued AS (SELECT item_id, word, CASE WHEN points > 0 THEN points WHEN length(word) >= 3 AND regexp_matches(name, form) THEN 220 * greatest(0, 1 - (length(regexp_extract(name, form)) - length(word)) / (length(name) + 1)::DOUBLE) ELSE 0 END AS points FROM exact),
scored AS (SELECT query_id, item_id, sum(points) AS score FROM tokens JOIN valued USING (word) GROUP BY ALL HAVING min(points) > 0 UNION ALL SELECT query_id, item_id, 0 FROM asks, herbs WHERE query_id NOT IN (SELECT query_id FROM tokens))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE sort WHEN 'easiest' THEN difficulty WHEN 'oldest' THEN year WHEN 'rarest' THEN rarity WHEN 'alpha' THEN 0 ELSE -round(score, 6) END, name, item_id) AS INT) AS place, item_id, round(score, 6)::DOUBLE AS score
FROM scored JOIN asks USING (query_id) JOIN herbs USING (item_id) WHERE (NOT by_type OR p_type = want_type) AND (NOT by_brand OR p_brand = want_brand) QUALIFY place <= 10""")
def r10_catalogue_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth part asks: words, words with gaps, whole names, two words, nothing, or what nobody has; five orders and two filters take turns."""
    k, first = F.col("p_partkey"), F.split("p_name", " ")[0]
    turn = F.floor(k / 20)
    text = F.when(k % 7 == 0, first).when(k % 7 == 1, F.concat(F.substring("p_name", 1, 1), F.substring("p_name", 3, 4))).when(k % 7 == 2, F.upper("p_name")).when(k % 7 == 3, F.concat_ws(" ", F.split("p_type", " ")[0], first)).when(k % 7 == 4, "brand alias7").when(k % 7 == 5, "").otherwise(" zz qq")
    pick = lambda on, c: F.when(on, F.array(c)).otherwise(F.array().cast("array<string>"))
    filters = F.create_map(F.lit("types"), pick(turn % 3 == 0, F.col("p_type")), F.lit("parts"), pick(turn % 4 == 0, F.col("p_brand")))
    asked = V.table(spark, sf_dir, "part").where(k % 20 == 0).select(k.alias("query_id"), text.alias("text"), F.element_at(F.array(*[F.lit(m) for m in C.SORTS]), (turn % 5 + 1).cast("int")).alias("sort"), filters.alias("filters"), F.lit(False).alias("saved_only"))
    return C.catalogue_search(asked, V.herbarium(spark, sf_dir))


_CASES = "cases AS (SELECT c_custkey AS case_id, " + ", ".join(f"CASE c_custkey // {3**i} % 3 WHEN 1 THEN false WHEN 2 THEN {'true' if i else 'c_custkey % 2 = 0'} END AS a{i}" for i in range(len(Y.FORMULATION))) + " FROM customer)"
_DECIDED = f"""{_CASES}, decided AS (SELECT case_id, CASE {" ".join(f"WHEN a{i} IS NULL THEN NULL WHEN a{i} THEN '{r.outcome}'" for i, r in enumerate(Y.FORMULATION))} ELSE '{Y.OTHERWISE}' END AS outcome,
  CASE {" ".join(f"WHEN a{i} IS NULL THEN NULL WHEN a{i} THEN '{r.question}'" for i, r in enumerate(Y.FORMULATION))} ELSE 'all answers no' END AS decided_by, CASE {" ".join(f"WHEN a{i} IS NULL THEN '{r.question}' WHEN a{i} THEN NULL" for i, r in enumerate(Y.FORMULATION))} END AS next_question,
  CAST(CASE {" ".join(f"WHEN a{i} IS NULL THEN {i} WHEN a{i} THEN {i + 1}" for i in range(len(Y.FORMULATION)))} ELSE {len(Y.FORMULATION)} END AS INT) AS asked FROM cases)"""


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as cases: a question has no answer, no or yes by the digits of their number."""
    k = F.col("c_custkey")
    pairs = []
    for i, r in enumerate(Y.FORMULATION):
        digit = F.floor(k / 3**i) % 3
        pairs.append(F.struct(F.lit(r.question).alias("key"), F.when(digit == 1, F.lit(False)).when(digit == 2, (k % 2 == 0) if i == 0 else F.lit(True)).alias("value")))
    return Y.classify(V.table(spark, sf_dir, "customer").select(k.alias("case_id"), F.map_from_entries(F.array(*pairs)).alias("answers")))


@query(f"WITH {_DECIDED} SELECT * FROM decided")
def u10_classify_formulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir)


@query(f"WITH {_DECIDED}, lines AS (SELECT *, CAST(row_number() OVER (PARTITION BY outcome, kind ORDER BY i) AS INT) AS position FROM (VALUES " + ", ".join(f"({i}, '{o}', '{k}', '{s}', '{loc}', {str(v).lower()})" for i, (o, k, s, loc, v) in enumerate(Y.CITES)) + ") t(i, outcome, kind, source_id, locator, verified)) SELECT case_id, outcome, kind, position, source_id, locator, verified FROM decided JOIN lines USING (outcome)")
def u10_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each decided case has to meet, line by line, with the provision."""
    return Y.requirements(_classified(spark, sf_dir), Y.cited_lines(spark))


_REGISTER = f"""{VERSIONS}, {CHUNKS}, counts AS (SELECT sha256, count(*) AS n_chunks FROM versions v JOIN (SELECT c.*, d.lang FROM chunks c JOIN documents d USING (doc_id)) c ON c.source_id = v.source_id AND c.lang = v.lang GROUP BY 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY first_doc DESC, sha256 DESC) > 1 AS superseded FROM versions),
manifest AS (SELECT DISTINCT source AS source_id, CASE WHEN length(source) % 2 = 0 THEN 'IN' ELSE 'INTL' END AS jurisdiction FROM documents UNION ALL SELECT 'n' || n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'IN' ELSE 'INTL' END FROM nation),
files AS (SELECT source_id, CASE WHEN first_doc % 4 = 1 THEN 'other' ELSE sha256 END AS filed FROM placed WHERE NOT superseded AND first_doc % 5 <> 2 UNION ALL SELECT 'n' || n_nationkey, 'x' FROM nation WHERE n_nationkey % 3 = 0),
stands AS (SELECT m.*, CASE WHEN p.sha256 IS NOT NULL AND filed <> p.sha256 THEN '{N.CHANGED}' WHEN p.sha256 IS NOT NULL THEN '{N.INGESTED}' WHEN filed IS NOT NULL THEN '{N.NOT_INGESTED}' ELSE '{N.MISSING}' END AS status, p.sha256, coalesce(n_chunks, 0) AS n_chunks
  FROM manifest m LEFT JOIN placed p ON p.source_id = m.source_id AND NOT p.superseded LEFT JOIN counts c ON c.sha256 = p.sha256 LEFT JOIN files f ON f.source_id = m.source_id)"""


def _register(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Sources of documents, a version for each language, and nations as sources that nobody ingested; some files are gone, some are others than the version in force."""
    docs, versions = V.table(spark, sf_dir, "documents"), P.superseded(V.versions(spark, sf_dir))
    place = lambda even: F.when(even, "IN").otherwise("INTL").alias("jurisdiction")
    nation = V.table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("source_id"), "n_nationkey")
    manifest = docs.select(F.col("source").alias("source_id")).distinct().select("source_id", place(F.char_length("source_id") % 2 == 0)).union(nation.select("source_id", place(F.col("n_nationkey") % 2 == 0)))
    d = F.col("first_doc")
    files = versions.where(~F.col("superseded") & (d % 5 != 2)).select("source_id", F.when(d % 4 == 1, "other").otherwise(F.col("sha256")).alias("sha256")).union(nation.where("n_nationkey % 3 = 0").select("source_id", F.lit("x")))
    lines = V.chunks(spark, sf_dir).select("doc_id", "source_id").join(docs.select("doc_id", "lang"), "doc_id")
    counts = versions.select("source_id", "lang", "sha256").join(lines, ["source_id", "lang"]).groupBy("sha256").agg(F.count(F.lit(1)).alias("n_chunks"))
    return {"manifest": manifest, "files": files, "versions": versions.select("source_id", F.col("lang").alias("version"), "sha256", d.alias("retrieved"), "superseded"), "counts": counts}


@query(f"WITH {_REGISTER} SELECT CASE WHEN grouping(source_id) = 0 THEN 'source' WHEN grouping(status) = 0 THEN 'status' WHEN grouping(jurisdiction) = 0 THEN 'jurisdiction' ELSE 'all' END AS level, jurisdiction, status, source_id, sha256, count(*) AS n_sources, CAST(sum(n_chunks) AS BIGINT) AS n_chunks FROM stands GROUP BY GROUPING SETS ((jurisdiction, status, source_id, sha256), (jurisdiction, status), (jurisdiction), ())")
def a10_register_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every source stands, its version in force, and totals of states and jurisdictions."""
    return N.register(N.standing(**_register(spark, sf_dir)))


@query(f"WITH {_REGISTER} SELECT m.source_id, count(p.sha256) AS n_versions, coalesce(string_agg(concat_ws(':', p.lang, substr(p.sha256, 1, 8), p.first_doc, CASE WHEN superseded THEN 'old' ELSE 'now' END, coalesce(n_chunks, 0)), ',' ORDER BY first_doc DESC, p.sha256 DESC) FILTER (p.sha256 IS NOT NULL), '') AS versions FROM manifest m LEFT JOIN placed p USING (source_id) LEFT JOIN counts c ON c.sha256 = p.sha256 GROUP BY 1")
def a9_nested_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue's nested versions, newest first with their chunks, told as one text."""
    t = _register(spark, sf_dir)
    nested = N.source_catalogue(t["manifest"], t["versions"], t["counts"])
    told = F.transform("versions", lambda v: F.concat_ws(":", v["version"], F.substring(v["sha256"], 1, 8), v["retrieved"].cast("string"), F.when(v["superseded"], "old").otherwise("now"), v["n_chunks"].cast("string")))
    return nested.select("source_id", F.size("versions").cast("long").alias("n_versions"), F.array_join(told, ",").alias("versions"))
