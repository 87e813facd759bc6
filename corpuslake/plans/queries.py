"""Queries over the driver's tables and their SQL twins. Names begin with the inventory's operator id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslake.functions import text as T
from corpuslake.operators import catalogue as C
from corpuslake.operators import corpus as P
from corpuslake.operators import retrieval as R
from corpuslake.sources import views as V
from corpuslake.streaming import sessions as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

CHUNKS = """chunks AS (SELECT doc_id * 2147483648 + i AS chunk_id, doc_id, source_id, 's.' || i AS locator, CASE WHEN lang = 'en' THEN 'IN' ELSE 'INTL' END AS jurisdiction, line AS text
  FROM (SELECT doc_id, source AS source_id, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(line, ' ') <> '')"""
QUESTIONS = "questions AS (SELECT conv_id * 2147483648 + turn AS question_id, text || (CASE conv_id % " + str(len(V.SUFFIXES)) + " " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(V.SUFFIXES)) + " END) AS text FROM conversations WHERE role = 'user')"
VERSIONS = """versions AS (SELECT source_id, lang, first_doc, n_docs, sha256(concat_ws('|', source_id, lang, n_docs, s)) AS sha256 FROM (SELECT source AS source_id, lang, min(doc_id) AS first_doc, count(*) AS n_docs, sum(('0x' || substr(md5(doc_id || ':' || text), 1, 15))::BIGINT) AS s FROM documents GROUP BY ALL))"""
EDGES = """edges AS (SELECT DISTINCT p_brand AS subject, 'supplied_from' AS predicate, n_name AS object FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT n_name, 'belongs_to_region', r_name FROM nation JOIN region ON n_regionkey = r_regionkey)"""
ITEMS = "items AS (SELECT p_partkey AS item_id, p_name AS name, p_brand AS family, p_type AS type, string_split(p_name, ' ') AS tags, p_size % 3 + 1 AS difficulty FROM part)"
LOG = "log AS (SELECT event_id, ts, user_id AS session_id, CASE event_type WHEN 'signup' THEN 'grant' WHEN 'error' THEN 'revoke' ELSE 'ask' END AS kind FROM events)"
TERMS = "list_distinct([lower(x) FOR x IN regexp_extract_all({}, '[A-Za-z][A-Za-z0-9]{{2,}}')])"


#: The injection patterns for an engine without look-ahead: what follows a role is tested by itself.
INJECTED = [f"regexp_matches(text, '{p}')" for n, p in T.INJECTIONS.items() if n != "role_override"] + [
    r"(regexp_matches(text, '(?i)\b(you are now|from now on,? you|pretend (to be|you are))') OR len(list_filter(regexp_extract_all(text, '(?i)\bact as (an? |if you)(.{0,40})', 2), lambda t: NOT regexp_matches(t, '(?i)^.{0,20}\b(licen[cs]|agent|authority|distributor)'))) > 0)"
]


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _text_query(name: str, expr: Callable, sql: str, view: str = "documents", key: str = "doc_id") -> None:
    """A scalar function over every text of documents or questions."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = V.questions(spark, sf_dir) if view == "questions" else V.table(spark, sf_dir, view)
        return rows.select(key, expr(F.col("text")).alias("value"))

    run.__name__ = name
    QUERIES[name] = run
    SQL[name] = (f"WITH {QUESTIONS} " if view == "questions" else "") + f"SELECT {key}, {sql} AS value FROM {view}"


_trim = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_text_query("n1_clean_text", lambda c: T.clean(T.nfkc(c)), _trim.format(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(text, '[\x00-\x08\x0b-\x1f\x7f-\x9f\x{ad}\x{200b}-\x{200f}\x{2060}\x{feff}]', '', 'g'), chr(9), ' '), '([\pL\pN_])-\n([\pL\pN_])', '\1\2', 'g'), '[ ]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')"))
_text_query("n9_norm_for_match", lambda c: T.for_match(T.nfkc(c)), r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '[“”"''‘’`\[\]\x{ad}]', '', 'g'), '[‐‑‒–—―−-]', '-', 'g'), '\s*-\s*', '-', 'g'), '\s+', ' ', 'g'), '^[ .;:,]+|[ .;:,]+$', '', 'g')""")
_text_query("n10_flat", T.flat, r"trim(regexp_replace(text, '\s+', ' ', 'g'), ' ')")
_text_query("f3_or_query", lambda c: F.array_join(F.array_sort(T.words3(c)), " | "), f"array_to_string(list_sort({TERMS.format('text')}), ' | ')")
_text_query("f4_provisions_in", lambda c: F.array_join(F.array_sort(T.provisions(c)), ","), r"coalesce(array_to_string(list_sort(list_distinct([upper(x) FOR x IN regexp_extract_all(text, '(?i)\b(sections?|secs?\.|s\.|rules?|articles?|art\.)\s*(\d{1,4}[A-Z]{0,3})(?:\.\d{1,2})?(?:\s?\([a-z0-9]{1,4}\))*', 2)])), ','), '')", "questions", "question_id")
_text_query("f6_injection_flags", lambda c: F.size(T.injection_flags(c)).cast("long"), "(" + " + ".join(f"{p}::BIGINT" for p in INJECTED) + ")", "questions", "question_id")
_text_query("f7_scrub_pii", T.scrub, "regexp_replace(" * 4 + "text" + "".join(f", '{p}', '{label}', 'g')" for p, label in T.PERSONAL), "questions", "question_id")
_text_query("f8_screen", T.screen, f"CASE WHEN length(text) > 2000 THEN 'too_long' WHEN trim(text, ' ') = '' THEN 'empty' WHEN {' OR '.join(INJECTED)} THEN 'unsafe' WHEN regexp_matches(text, '{T.MEDICAL}') THEN 'medical_advice' ELSE 'ok' END", "questions", "question_id")
_text_query("f9_detect_language", T.language, "CASE " + " ".join(f"WHEN len(regexp_extract_all(text, '{s}')) >= 3 THEN '{c}'" for s, c in T.SCRIPTS) + " ELSE 'en' END", "questions", "question_id")
_text_query("f12_question_hash", T.question_hash, "substr(sha256(lower(trim(text, ' '))), 1, 32)", "questions", "question_id")
_text_query("f17_occurrences", lambda c: T.occurrences(c, F.lit("the")), "(length(text) - length(replace(text, 'the', ''))) // 3")


@query(f"WITH {QUESTIONS}, k AS (SELECT question_id, md5(concat_ws('|', regexp_replace(lower(trim(text, ' ')), '\\s+', ' ', 'g'), ['ask', 'agent'][question_id % 2 + 1], ['maker', 'citizen', 'official'][question_id % 3 + 1], CASE {' '.join(f"WHEN len(regexp_extract_all(text, '{s}')) >= 3 THEN '{c}'" for s, c in T.SCRIPTS)} ELSE 'en' END, '', 'v1')) AS cache_key FROM questions) SELECT cache_key, count(*) AS n, min(question_id) AS first_id FROM k GROUP BY 1")
def f13_cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal questions in one mode, for one kind of person, in one language, without context, over one version of the corpus."""
    n = F.col("question_id")
    mode, person = (F.element_at(F.array(*[F.lit(v) for v in vs]), (n % len(vs) + 1).cast("int")) for vs in (("ask", "agent"), ("maker", "citizen", "official")))
    key = T.cache_key(F.col("text"), mode, person, T.language(F.col("text")), F.lit(""), F.lit("v1"))
    return V.questions(spark, sf_dir).groupBy(key.alias("cache_key")).agg(F.count(F.lit(1)).alias("n"), F.min("question_id").alias("first_id"))


@query(f"WITH {QUESTIONS} SELECT question_id, CASE WHEN question_id % 3 = 0 THEN 'hi' {' '.join(f"WHEN len(regexp_extract_all(text, '{s}')) >= 3 THEN '{c}'" for s, c in T.SCRIPTS)} ELSE 'en' END AS language FROM questions")
def f9_chosen_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the questions come with a language chosen, a third with 'auto', the others without a choice."""
    chosen = F.when(F.col("question_id") % 3 == 0, "hi").when(F.col("question_id") % 3 == 1, "auto")
    return V.questions(spark, sf_dir).select("question_id", T.language(F.col("text"), chosen).alias("language"))


_STATUTE = "lines AS (SELECT doc_id, line_no, CASE WHEN line_no % 5 = 1 THEN line_no || '. ' || split_part(line, ' ', 1) || ' unit.—' || line ELSE line END AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents) WHERE trim(line, ' ') <> '')"


def _statute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents; every fifth becomes a heading."""
    lines = V.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).where(F.trim("line") != "").withColumn("line_no", F.col("at") + 1)
    head = F.concat(F.col("line_no").cast("string"), F.lit(". "), F.split("line", " ")[0], F.lit(" unit.—"), "line")
    return lines.select("doc_id", "line_no", F.when(F.col("line_no") % 5 == 1, head).otherwise(F.col("line")).alias("line"))


@query(rf"""WITH {_STATUTE}, marked AS (SELECT *, sum(regexp_matches(line, '^(\d{{1,4}}[A-Z]{{0,3}})\. (.{{3,120}}?)\.—')::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS unit FROM lines)
SELECT doc_id, unit, regexp_extract(min_by(line, line_no), '^(\d{{1,4}}[A-Z]{{0,3}})\. (.{{3,120}}?)\.—', 1) AS num, regexp_extract(min_by(line, line_no), '^(\d{{1,4}}[A-Z]{{0,3}})\. (.{{3,120}}?)\.—', 2) AS title, count(*) AS n_lines FROM marked WHERE unit > 0 GROUP BY doc_id, unit""")
def p2_parse_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.sections(_statute(spark, sf_dir))


@query(f"WITH {CHUNKS} SELECT source_id, locator, min(chunk_id) AS chunk_id FROM chunks GROUP BY ALL")
def p7_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("source_id", "locator").orderBy("chunk_id")
    return V.chunks(spark, sf_dir).withColumn("at", F.row_number().over(order)).where("at = 1").select("source_id", "locator", "chunk_id")


@query(f"""WITH RECURSIVE {_STATUTE}, ordered AS (SELECT doc_id AS unit, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k, length(line) AS n FROM lines),
packed AS (SELECT unit, k, n AS used, 0 AS chunk_no FROM ordered WHERE k = 1
  UNION ALL SELECT o.unit, o.k, CASE WHEN p.used > 0 AND p.used + o.n > {P.TARGET} THEN o.n ELSE p.used + o.n END, p.chunk_no + CASE WHEN p.used > 0 AND p.used + o.n > {P.TARGET} THEN 1 ELSE 0 END FROM packed p JOIN ordered o ON o.unit = p.unit AND o.k = p.k + 1)
SELECT unit, k, chunk_no FROM packed""")
def p10_pack_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _statute(spark, sf_dir)
    order = Window.partitionBy("doc_id").orderBy("line_no")
    return P.pack_chunks(lines.select(F.col("doc_id").alias("unit"), F.row_number().over(order).alias("k"), F.char_length("line").alias("n_chars")))


@query(f"WITH {CHUNKS} SELECT chunk_id, substr(text, greatest(strpos(text, 'licen') - 100, 1), strpos(text, 'licen') - greatest(strpos(text, 'licen') - 100, 1) + 300) AS context FROM chunks WHERE contains(text, 'licen')")
def p15_grep_kwic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.kwic(V.chunks(spark, sf_dir), "licen")


@query(f"WITH {VERSIONS} SELECT source_id, lang, n_docs, first_doc <> max(first_doc) OVER (PARTITION BY source_id) AS superseded FROM versions")
def u2_supersede(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.superseded(V.versions(spark, sf_dir)).select("source_id", "lang", "n_docs", "superseded")


@query(f"WITH {VERSIONS}, {CHUNKS}, counts AS (SELECT source_id, count(*) AS n_chunks FROM chunks GROUP BY 1) SELECT v.source_id, count(*) AS n_versions, any_value(coalesce(n_chunks, 0)) AS n_chunks, array_to_string(list(lang ORDER BY first_doc DESC), ',') AS newest_first FROM versions v LEFT JOIN counts c ON c.source_id = v.source_id GROUP BY v.source_id")
def a9_source_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = V.chunks(spark, sf_dir).groupBy("source_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    v = V.versions(spark, sf_dir).groupBy("source_id").agg(F.count(F.lit(1)).alias("n_versions"), F.sort_array(F.collect_list(F.struct("first_doc", "lang")), asc=False).alias("v"))
    return v.join(counts, "source_id", "left").select("source_id", "n_versions", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.array_join(F.col("v.lang"), ",").alias("newest_first"))


@query(f"WITH {CHUNKS} SELECT jurisdiction, source_id, count(*) AS n FROM chunks GROUP BY ROLLUP (jurisdiction, source_id)")
def a10_sources_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.chunks(spark, sf_dir).rollup("jurisdiction", "source_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CHUNKS}, {VERSIONS}, now AS (SELECT source_id, lang FROM versions QUALIFY first_doc = max(first_doc) OVER (PARTITION BY source_id)) SELECT c.chunk_id, c.source_id FROM chunks c JOIN documents d ON d.doc_id = c.doc_id JOIN now n ON n.source_id = c.source_id AND n.lang = d.lang WHERE c.jurisdiction = 'IN'")
def j1_chunk_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = P.superseded(V.versions(spark, sf_dir)).where("not superseded").select("source_id", "lang")
    docs = V.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return V.chunks(spark, sf_dir).where("jurisdiction = 'IN'").join(docs, "doc_id").join(now, ["source_id", "lang"]).select("chunk_id", "source_id")


@query(f"""WITH {CHUNKS}, {QUESTIONS}, wanted AS (SELECT question_id AS query_id, w, i FROM (SELECT question_id, unnest(['s.3(p)', 's.3']) AS w, unnest([0, 1]) AS i FROM questions WHERE contains(text, 'section 3(p)')))
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY i, chunk_id) AS rank FROM wanted JOIN chunks ON locator = w QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY i, chunk_id) <= 10""")
def j2_by_locator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.by_locator(V.questions(spark, sf_dir).withColumnRenamed("question_id", "query_id"), V.chunks(spark, sf_dir))


@query(f"WITH {EDGES}, refs AS (SELECT n_name AS ref FROM nation WHERE n_regionkey = 1) SELECT DISTINCT e.* FROM edges e, refs WHERE subject = ref OR object = ref")
def j5_edges_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.edges_of(V.edges(spark, sf_dir), V.table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_name").alias("ref")))


@query(f"WITH {EDGES}, sides AS (SELECT subject AS entity, predicate || ' ' || object AS edge FROM edges UNION ALL SELECT object, predicate || ' of ' || subject FROM edges) SELECT DISTINCT entity, edge FROM sides")
def j7_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.neighbourhood(V.edges(spark, sf_dir))


@query(f"WITH {EDGES}, ends AS (SELECT subject AS node, 'tag' AS side FROM edges UNION ALL SELECT object, 'item' FROM edges) SELECT node, side, count(*) AS degree FROM ends GROUP BY ALL")
def a8_bipartite_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.edges(spark, sf_dir)
    return e.select(F.col("subject").alias("node"), F.lit("tag").alias("side")).union(e.select(F.col("object").alias("node"), F.lit("item").alias("side"))).groupBy("node", "side").agg(F.count(F.lit(1)).alias("degree"))


@query(f"WITH {ITEMS}, x AS (SELECT 'family' AS facet, family AS value FROM items UNION ALL SELECT 'type', type FROM items UNION ALL SELECT 'difficulty', difficulty::VARCHAR FROM items UNION ALL SELECT 'tag', unnest(tags) FROM items) SELECT facet, value, count(*) AS n FROM x GROUP BY ALL")
def a1_facet_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.facet_tally(V.catalogue(spark, sf_dir), ["family", "type", "difficulty"])


@query(f"WITH {ITEMS} SELECT count(*) AS items, count(DISTINCT family) AS families, count(*) FILTER (difficulty = 3) AS hard, count(DISTINCT name) AS names FROM items")
def a3_atlas_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.catalogue(spark, sf_dir).agg(F.count(F.lit(1)).alias("items"), F.countDistinct("family").alias("families"), F.count_if(F.col("difficulty") == 3).alias("hard"), F.countDistinct("name").alias("names"))


@query(f"WITH {ITEMS} SELECT family, count(*) FILTER (difficulty = 1) AS easy, count(*) FILTER (difficulty = 2) AS medium, count(*) FILTER (difficulty = 3) AS hard FROM items GROUP BY family")
def a7_law_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = V.catalogue(spark, sf_dir).groupBy("family").pivot("difficulty", [1, 2, 3]).count()
    return wide.select("family", *[F.coalesce(F.col(str(i)), F.lit(0)).alias(n) for i, n in ((1, "easy"), (2, "medium"), (3, "hard"))])


@query("SELECT r_name, count(DISTINCT n_nationkey) AS members, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def a4_region_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = V.table(spark, sf_dir, "nation").join(V.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name").agg(F.countDistinct("n_nationkey").alias("members"), F.array_join(F.array_sort(F.collect_set("n_name")), ",").alias("names"))


@query(f"WITH {ITEMS} SELECT type, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS ids FROM items WHERE difficulty = 3 GROUP BY 1")
def a21_profiled_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.catalogue(spark, sf_dir).where("difficulty = 3").groupBy("type").agg(F.array_join(F.transform(F.array_sort(F.collect_list("item_id")), lambda x: x.cast("string")), ",").alias("ids"))


@query(f"""WITH {ITEMS}, s AS (SELECT a.item_id, b.item_id AS other, 3 * len(list_intersect(list_distinct(a.tags), list_distinct(b.tags))) + CASE WHEN a.family = b.family THEN 4 ELSE 0 END AS weight FROM items a JOIN items b ON a.item_id <> b.item_id)
SELECT item_id, other, weight, row_number() OVER w AS rank FROM s WHERE weight > 0 WINDOW w AS (PARTITION BY item_id ORDER BY weight DESC, other) QUALIFY rank <= 4""")
def j14_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.related(V.catalogue(spark, sf_dir))


@query(f"WITH {ITEMS}, pool AS (SELECT name AS entry FROM items UNION SELECT unnest(tags) FROM items) SELECT entry FROM pool WHERE contains(lower(entry), 'al') ORDER BY strpos(lower(entry), 'al'), length(entry), entry LIMIT 6")
def r11_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.suggest(V.catalogue(spark, sf_dir), "al")


@query(f"WITH {ITEMS}, s AS (SELECT item_id, CASE WHEN lower(name) = 'al' THEN 1000 WHEN starts_with(lower(name), 'al') THEN 620 WHEN contains(lower(name), 'al') THEN 380 WHEN list_contains(tags, 'al') THEN 240 WHEN contains(lower(family), 'al') THEN 150 ELSE 0 END AS a, CASE WHEN lower(name) = 'brand' THEN 1000 WHEN starts_with(lower(name), 'brand') THEN 620 WHEN contains(lower(name), 'brand') THEN 380 WHEN list_contains(tags, 'brand') THEN 240 WHEN contains(lower(family), 'brand') THEN 150 ELSE 0 END AS b FROM items) SELECT item_id, (a + b)::BIGINT AS score FROM s WHERE a > 0 AND b > 0")
def r10_catalogue_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.search(V.catalogue(spark, sf_dir), "al Brand")


@query(f"WITH {LOG} SELECT date_trunc('hour', ts) AS start, kind, count(*) AS n FROM log GROUP BY ALL")
def s2_audit_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.audit_rollup(V.sessions(spark, sf_dir))


@query(f"WITH {LOG}, g AS (SELECT *, coalesce(ts - lag(ts) OVER w >= INTERVAL 6 HOURS, true) AS fresh FROM log WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id)), n AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS no FROM g) SELECT session_id, min(ts) AS start, count(*) AS n FROM n GROUP BY session_id, no")
def s3_session_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.session_activity(V.sessions(spark, sf_dir))


@query(f"WITH {LOG} SELECT session_id, arg_max(kind, (ts, event_id)) = 'grant' AS active FROM log WHERE kind <> 'ask' GROUP BY 1")
def r14_latest_consent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.latest_consent(V.sessions(spark, sf_dir))


@query(f"WITH {LOG}, x AS (SELECT *, last_value(CASE WHEN kind <> 'ask' THEN kind END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS state FROM log) SELECT event_id, coalesce(state = 'grant', false) AS allowed FROM x WHERE kind = 'ask'")
def s5_consent_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.consent_gate(V.sessions(spark, sf_dir))


@query(f"WITH {LOG}, x AS (SELECT *, first_value(CASE WHEN kind = 'revoke' THEN ts END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS revoked_at FROM log) SELECT event_id, revoked_at FROM x WHERE kind = 'grant'")
def u8_consent_revoke(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.revoke(V.sessions(spark, sf_dir))


@query(f"""WITH RECURSIVE {LOG}, o AS (SELECT event_id, session_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS k FROM log),
b AS (SELECT event_id, session_id, us, k, true AS allowed, 1.0::DOUBLE AS tokens FROM o WHERE k = 1
  UNION ALL SELECT o.event_id, o.session_id, o.us, o.k, least(2.0, b.tokens + (o.us - b.us) * (2.0::DOUBLE / 86400e6)) >= 1, least(2.0, b.tokens + (o.us - b.us) * (2.0::DOUBLE / 86400e6)) - CASE WHEN least(2.0, b.tokens + (o.us - b.us) * (2.0::DOUBLE / 86400e6)) >= 1 THEN 1.0 ELSE 0.0 END FROM b JOIN o ON o.session_id = b.session_id AND o.k = b.k + 1)
SELECT event_id, allowed FROM b""")
def s1_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.rate_limit(V.sessions(spark, sf_dir))


@query("WITH b AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, event_type FROM b WHERE n % 2 = 1")
def r16_bookmark_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1").select("user_id", "event_type")


@query("WITH m AS (SELECT user_id, event_type, max(ts) AS seen FROM events GROUP BY ALL) SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seen DESC, event_type) <= 3")
def r15_recently_visited(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = V.table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("seen"))
    return seen.withColumn("at", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("seen"), "event_type"))).where("at <= 3").drop("at")


@query("SELECT vec_id FROM embeddings WHERE len(embedding) <> 64")
def v7_embedding_dim_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "embeddings").where(F.size("embedding") != 64).select("vec_id")
