"""Queries on treaty lists, profiles and their flags, statutes, registries and shelves, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.functions import profiles as P
from corpuslake.operators import blocks as K
from corpuslake.operators import registries as G
from corpuslake.operators import treaties as Y
from corpuslake.plans.queries import query
from corpuslake.plans.search import ASKED, PASSAGES, listed, quoted
from corpuslake.sources import passages as S
from corpuslake.sources import views as V

MONTHS = ("January", "May", "July", "October")
#: A customer as a country: no digits in its name, a bracket or a footnote number for some.
LAND = "'Land ' || translate(CAST(c_custkey AS STRING), '0123456789', 'abcdefghij') || CASE WHEN c_custkey % 11 = 0 THEN ' (Republic of)' ELSE '' END"
_NOTED = f"{LAND} || CASE WHEN c_custkey % 7 = 0 THEN '12, 13' ELSE '' END"
_DAY = "CASE c_custkey % 4 WHEN 0 THEN 'January' WHEN 1 THEN 'May' WHEN 2 THEN 'July' ELSE 'October' END || ' ' || CAST(c_custkey % 28 + 1 AS STRING) || ', ' || CAST(1950 + c_custkey % 70 AS STRING)"
_MADRID = f"CASE WHEN c_custkey % 3 = 0 THEN '–' ELSE {_DAY} || CASE WHEN c_custkey % 6 = 1 THEN '5,6' ELSE '' END END || ' ' || CASE WHEN c_custkey % 5 = 0 AND c_custkey % 3 <> 0 THEN '–' ELSE {_DAY} END"
_LISTS = f"""SELECT 'intl-madrid-parties' AS source_id, c_custkey + 9 AS line_no, {_NOTED} || ' ........ ' || {_MADRID} AS line FROM customer WHERE c_custkey % 2 = 0
  UNION ALL SELECT 'intl-hague-parties', c_custkey + 9, {_NOTED} || ' .... ' || {_DAY} FROM customer WHERE c_custkey % 3 = 0
  UNION ALL SELECT 'intl-madrid-parties', 1, 'Status on July 14, 2026 ' UNION ALL SELECT 'intl-hague-parties', 1, 'Status on May 2, 2025'
  UNION ALL SELECT 'intl-madrid-parties', 2, 'Parties (Total: ' || CAST(count(*) AS STRING) || ')' FROM customer WHERE c_custkey % 2 = 0
  UNION ALL SELECT 'intl-hague-parties', 2, 'Parties (Total: ' || CAST(count(*) + {{missing}} AS STRING) || ')' FROM customer WHERE c_custkey % 3 = 0"""


def _lists(spark: SparkSession, sf_dir: str, missing: int = 0) -> DataFrame:
    """Customers as parties to two treaties, forty lines a page; ``missing`` rows make the second list incomplete."""
    rows = spark.sql(_LISTS.format(missing=missing).replace("FROM customer", "FROM {customer}"), customer=V.table(spark, sf_dir, "customer"))
    return rows.select("source_id", F.col("line_no").cast("int").alias("line_no"), (F.floor(F.col("line_no") / 40) + 1).cast("int").alias("page"), "line")


def _lists_sql(missing: int = 0) -> str:
    return rf"""lines AS (SELECT source_id, line_no::INT AS line_no, (line_no // 40 + 1)::INT AS page, trim(line, ' ') AS line FROM ({_LISTS.format(missing=missing)})),
rows AS (SELECT source_id, trim(regexp_replace(trim(regexp_replace(regexp_extract(line, '{Y.ROW}', 1), '{Y.NOTES}', ''), ' '), ',+$', ''), ' ') AS country, list_transform(regexp_extract_all(regexp_extract(line, '{Y.ROW}', 2), '({Y.DATE}|[–—-])', 1), lambda d: CASE WHEN regexp_matches(d, '^[–—-]$') THEN '' ELSE d END) AS dates, line, line_no, page FROM lines WHERE regexp_matches(line, '{Y.ROW}') AND regexp_matches(regexp_extract(line, '{Y.ROW}', 2), '{Y.DATE}')),
heads AS (SELECT source_id, max(regexp_extract(line, '{Y.STATUS}', 1)) AS status, max(CASE WHEN regexp_matches(line, '{Y.TOTAL}') THEN regexp_extract(line, '{Y.TOTAL}', 1)::INT END) AS declared FROM lines GROUP BY 1),
complete AS (SELECT h.*, r.n, r.page FROM heads h JOIN (SELECT source_id, count(*) AS n, min_by(page, line_no) AS page FROM rows GROUP BY 1) r ON r.source_id = h.source_id WHERE r.n = h.declared)"""


@query(f"WITH {_lists_sql()} SELECT source_id, country, array_to_string(dates, ';') AS dates, line, page FROM rows")
def p13_parse_status_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.status_rows(_lists(spark, sf_dir)).select("source_id", "country", F.array_join("dates", ";").alias("dates"), "line", "page")


@query(f"WITH {_lists_sql(1)} SELECT h.source_id, h.status, h.declared, c.source_id IS NOT NULL AS complete FROM heads h LEFT JOIN complete c ON c.source_id = h.source_id")
def v8_complete_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second list declares one party more than it has."""
    lines = _lists(spark, sf_dir, missing=1)
    return Y.status_heads(lines).join(Y.complete_lists(lines).select("source_id", F.lit(True).alias("complete")), "source_id", "left").fillna(False, ["complete"])


@query(f"WITH {_lists_sql(1)} SELECT DISTINCT country, length(country) AS n FROM rows JOIN complete USING (source_id)")
def u13_known_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.known_countries(_lists(spark, sf_dir, missing=1)).select("country", F.char_length("country").alias("n"))


_ROUTES = ("", " Is the Madrid system open to Land bc and Land d?", " Can I use the Hague route?", " Hague or Madrid from Land bb (Republic of), Land cd or Land e?", " May Land zz file under the Geneva Act?")
_TREATY = f"""asked AS (SELECT query_id, lower(text) AS low FROM (SELECT conv_id * 2147483648 + turn AS query_id, text || {listed(_ROUTES)}[(conv_id + turn) % {len(_ROUTES)} + 1] AS text FROM conversations WHERE role = 'user')),
treaties AS (SELECT * FROM (VALUES {", ".join(f"({quoted(s)}, {quoted(t)}, {c}, {listed(a)})" for s, t, c, a in Y.LISTS)}) t(source_id, treaty, col, aliases)),
named AS (SELECT DISTINCT query_id, source_id, treaty, col FROM asked, treaties WHERE len(list_filter(aliases, lambda a: contains(low, a))) > 0),
countries AS (SELECT DISTINCT country FROM rows JOIN complete USING (source_id)),
held AS (SELECT query_id, country FROM asked JOIN countries ON contains(low, lower(country)) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY length(country) DESC, country) <= {Y.MOST}),
wanted AS (SELECT n.*, coalesce(h.country, '{Y.ASKER}') AS country, c.declared, c.page FROM named n LEFT JOIN held h USING (query_id) JOIN complete c ON c.source_id = n.source_id),
matched AS (SELECT w.query_id, w.treaty, w.country, any_value(w.col) AS col, any_value(w.declared) AS declared, any_value(w.page) AS page, min_by(r.country, r.line_no) AS printed, min_by(r.dates, r.line_no) AS dates, min_by(r.page, r.line_no) AS at_page FROM wanted w LEFT JOIN rows r ON r.source_id = w.source_id AND (lower(r.country) = lower(w.country) OR starts_with(lower(r.country), lower(w.country) || ' (') OR list_contains(string_split(lower(r.country), ' ('), lower(w.country))) GROUP BY 1, 2, 3)"""


@query(f"WITH {_lists_sql()}, {_TREATY} SELECT query_id, treaty, coalesce(printed, country) AS country, printed IS NOT NULL AND (coalesce(dates[col + 1], '') <> '' OR len(dates) = 0) AS listed, CASE WHEN printed IS NULL THEN '' ELSE coalesce(dates[col + 1], '') END AS date, coalesce(at_page, page) AS page, declared AS total FROM matched")
def j12_treaty_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = V.table(spark, sf_dir, "conversations").where("role = 'user'")
    asked = turns.select((F.col("conv_id") * V.LINE_IDS + F.col("turn")).alias("query_id"), F.concat("text", S.pick(_ROUTES, F.col("conv_id") + F.col("turn"))).alias("text"))
    return Y.checks(asked, _lists(spark, sf_dir), Y.treaties(spark))


_VIRYA = ("Ushna (heating)", "Sheeta", "Anushna")
_GUNA = ("Laghu (light), Tikshna (sharp)", "Guru (heavy)", "Snigdha (unctuous)", "Ruksha", "Laghu, Snigdha")
_VIPAKA = ("Katu", "Madhura (sweet)", "turns to Amla", "none named")
_DOSHA = ("Pacifies Vata and Kapha; increases Pitta", "Balances all three", "Tridosha, but may aggravate Kapha", "Calms Pitta, aggravates Vata", "Reduces Kapha; pacifies Kapha, increases Kapha", "Unknown effect")


def _k() -> Column:
    return F.col("p_partkey")


def _tastes(k: Column) -> Column:
    dominant = lambda m: F.when(k % m == 0, " (dominant)").otherwise("")
    return F.array(F.concat(S.pick(P.TASTES, k), dominant(7)), F.concat(S.pick(P.TASTES, F.floor(k / 6)), dominant(9)), S.pick(P.TASTES, F.floor(k / 11)))


_TASTES = f"tasted AS (SELECT p_partkey AS item_id, [{listed(P.TASTES)}[p_partkey % 6 + 1] || CASE WHEN p_partkey % 7 = 0 THEN ' (dominant)' ELSE '' END, {listed(P.TASTES)}[p_partkey // 6 % 6 + 1] || CASE WHEN p_partkey % 9 = 0 THEN ' (dominant)' ELSE '' END, {listed(P.TASTES)}[p_partkey // 11 % 6 + 1]] AS tastes FROM part)"
_WEIGHT = lambda t: f"CASE WHEN contains(tastes[1], '{t}') THEN 1.0 WHEN contains(tastes[2], '{t}') THEN CASE WHEN contains(tastes[2], 'dominant') THEN 1.0 ELSE 0.78 END WHEN contains(tastes[3], '{t}') THEN 0.56 ELSE 0 END"


@query(f"WITH {_TASTES} SELECT item_id, {', '.join(f'round(({_WEIGHT(t)})::DOUBLE, 4) AS {t.lower()}' for t in P.TASTES)} FROM tasted")
def f19_rasa_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = P.taste_profile(F.col("tastes"))
    rows = V.table(spark, sf_dir, "part").select(_k().alias("item_id"), _tastes(_k()).alias("tastes")).select("item_id", weights.alias("w"))
    return rows.select("item_id", *[F.round(F.get("w", F.lit(i)), 4).alias(t.lower()) for i, t in enumerate(P.TASTES)])


_NUDGE = " + ".join(f"CASE WHEN regexp_matches(g, '{p}') THEN {v} ELSE 0 END" for p, v in (("tikshna|sharp", "0.22"), ("laghu|light", "0.08"), ("guru|heavy", "-0.08"), ("snigdha|unctuous|oily", "-0.12")))


@query(f"WITH p AS (SELECT p_partkey AS item_id, lower({listed(_VIRYA)}[p_partkey % 3 + 1]) AS v, lower({listed(_GUNA)}[p_partkey % 5 + 1]) AS g FROM part), h AS (SELECT *, contains(v, 'ushna') OR contains(v, 'heating') AS hot FROM p) SELECT item_id, CASE WHEN hot THEN 'heating' ELSE 'cooling' END AS virya, round(greatest(-1, least(1, CASE WHEN hot THEN 0.62 + ({_NUDGE}) ELSE -0.62 - ({_NUDGE}) END))::DOUBLE, 4) AS scale FROM h")
def f20_virya(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, qualities = S.pick(_VIRYA, _k()), F.split(S.pick(_GUNA, _k()), ", ")
    return V.table(spark, sf_dir, "part").select(_k().alias("item_id"), P.potency(text).alias("virya"), F.round(P.potency_scale(text, qualities), 4).alias("scale"))


@query(f"SELECT p_partkey AS item_id, ['Katu', 'Madhura', 'Amla', 'Madhura'][p_partkey % 4 + 1] AS vipaka FROM part")
def f21_vipaka(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "part").select(_k().alias("item_id"), P.after_taste(S.pick(_VIPAKA, _k())).alias("vipaka"))


_EFFECT = "CASE WHEN regexp_matches(c, '(?i)aggravat|increase') THEN 1 WHEN regexp_matches(c, '(?i)pacif|balanc|calm|reduce') THEN -1 END"


@query(f"""WITH p AS (SELECT p_partkey AS item_id, {listed(_DOSHA)}[p_partkey % {len(_DOSHA)} + 1] AS t FROM part), c AS (SELECT item_id, unnest(regexp_split_to_array(t, '[;,]')) AS c, generate_subscripts(regexp_split_to_array(t, '[;,]'), 1) AS i FROM p), e AS (SELECT *, {_EFFECT} AS effect FROM c),
v AS (SELECT item_id, i, {', '.join(f"CASE WHEN effect IS NULL THEN NULL WHEN effect = -1 AND regexp_matches(c, '(?i)all three|tridosha') THEN -1 WHEN contains(c, '{h}') THEN effect END AS {h.lower()}" for h in P.HUMOURS)} FROM e)
SELECT item_id, {', '.join(f"coalesce(max_by({h.lower()}, i) FILTER ({h.lower()} IS NOT NULL), 0)::INT AS {h.lower()}" for h in P.HUMOURS)} FROM v GROUP BY 1""")
def f22_dosha_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.table(spark, sf_dir, "part").select(_k().alias("item_id"), P.humour_profile(S.pick(_DOSHA, _k())).alias("e"))
    return rows.select("item_id", *[F.get("e", F.lit(i)).alias(h.lower()) for i, h in enumerate(P.HUMOURS)])


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with nested legal profiles; a third of all facts are unknown."""
    fact = lambda m: F.when(_k() % m == 0, True).when(_k() % m == 1, False)
    cites = lambda m, name: F.when(_k() % m == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit(name), (_k() % 10).cast("string"))))
    schedule = F.when(_k() % 5 == 1, "Schedule I").when(_k() % 5 == 2, "unknown").when(_k() % 5 == 3, "Not listed").when(_k() % 5 == 4, "Schedule II")
    wildlife = F.when(_k() % 13 != 0, F.struct(schedule.alias("schedule"), fact(4).alias("cites_listed"), cites(6, "w").alias("cites")))
    profile = F.struct(
        F.struct(fact(3).alias("e1"), F.lit("rules").alias("cite")).alias("schedules"), wildlife.alias("wildlife"), F.struct(fact(7).alias("restricted"), F.lit("policy").alias("cite")).alias("export"),
        F.when(_k() % 2 == 0, F.struct(fact(8).alias("budapest"), F.lit("treaty").alias("cite"))).alias("deposit"), F.struct(fact(3).alias("resource"), cites(5, "b").alias("cites")).alias("biodiversity"),
    )
    return V.table(spark, sf_dir, "part").select(_k().alias("item_id"), profile.alias("profile"))


_FLAGGED = """flagged AS (SELECT p_partkey AS item_id, k, CASE k WHEN 'scheduleE1' THEN 'rules' WHEN 'exportRestricted' THEN 'policy' WHEN 'deposit' THEN 'treaty' WHEN 'wildlife' THEN 'w' || p_partkey % 10 WHEN 'cites' THEN CASE WHEN p_partkey % 6 = 0 THEN 'unknown' ELSE 'w' || p_partkey % 10 END ELSE CASE WHEN p_partkey % 5 = 0 THEN 'unknown' ELSE 'b' || p_partkey % 10 END END AS cite
  FROM part, (SELECT unnest(['scheduleE1', 'wildlife', 'cites', 'exportRestricted', 'deposit', 'bioResource', 'notBioResource']) AS k)
  WHERE CASE k WHEN 'scheduleE1' THEN p_partkey % 3 = 0 WHEN 'wildlife' THEN p_partkey % 13 <> 0 AND p_partkey % 5 IN (1, 4) AND p_partkey % 6 <> 0 WHEN 'cites' THEN p_partkey % 13 <> 0 AND p_partkey % 4 = 0 WHEN 'exportRestricted' THEN p_partkey % 7 = 0 WHEN 'deposit' THEN p_partkey % 8 = 0 WHEN 'bioResource' THEN p_partkey % 3 = 0 ELSE p_partkey % 3 = 1 END)"""


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profiles(spark, sf_dir).select("item_id", F.explode(P.legal_flags(F.col("profile"))).alias("f")).select("item_id", "f.key", "f.label", "f.cite")


@query(f"WITH {_FLAGGED} SELECT item_id, k AS key, CASE k {' '.join(f'WHEN {quoted(k)} THEN {quoted(v)}' for k, v in P.FLAGS.items())} END AS label, cite FROM flagged")
def f23_legal_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flagged(spark, sf_dir)


@query(f"WITH {_FLAGGED} SELECT p_partkey AS item_id, {', '.join(f'count(*) FILTER (k = {quoted(k)}) > 0 AS {quoted(k).strip(chr(39))}' for k in P.FLAGS)} FROM part LEFT JOIN flagged f ON f.item_id = p_partkey GROUP BY 1")
def a7_material_law_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which law reaches which material; one without flags has a row too."""
    wide = _flagged(spark, sf_dir).groupBy("item_id").pivot("key", list(P.FLAGS)).count()
    return V.table(spark, sf_dir, "part").select(_k().alias("item_id")).join(wide, "item_id", "left").select("item_id", *[F.col(k).isNotNull().alias(k) for k in P.FLAGS])


@query(f"WITH {_FLAGGED}, n AS (SELECT p_brand AS kind, p_partkey, count(k) AS flags FROM part LEFT JOIN flagged f ON f.item_id = p_partkey GROUP BY ALL) SELECT kind, count(*) AS items, count(*) FILTER (flags > 0) AS flagged, sum(flags)::BIGINT AS flags FROM n GROUP BY 1")
def a6_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _profiles(spark, sf_dir).select("item_id", F.size(P.legal_flags(F.col("profile"))).alias("n"))
    rows = V.table(spark, sf_dir, "part").select(_k().alias("item_id"), F.col("p_brand").alias("kind")).join(counts, "item_id")
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("n") > 0).alias("flagged"), F.sum("n").alias("flags"))


def short_title(title: Column) -> Column:
    return F.lower(F.regexp_replace(title, r"(?i)^the\s+|,?\s*\d{4}$|\s*\(.*?\)", ""))


@query(rf"""WITH s AS (SELECT DISTINCT source AS source_id, lower(regexp_replace('The ' || source || ' Matters Act (No. 5), 1999', '(?i)^the\s+|,?\s*\d{{4}}$|\s*\(.*?\)', '', 'g')) AS short FROM documents),
q AS (SELECT conv_id * 2147483648 + turn AS query_id, lower(text || ' Under the SRC' || (conv_id % 25) || ' Matters Act?') AS low FROM conversations WHERE role = 'user') SELECT query_id, source_id FROM q JOIN s ON contains(low, short) WHERE length(short) > 6""")
def f11_link_statutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = V.table(spark, sf_dir, "documents").select(F.col("source").alias("source_id")).distinct()
    short = sources.select("source_id", short_title(F.concat(F.lit("The "), "source_id", F.lit(" Matters Act (No. 5), 1999"))).alias("short"), F.xxhash64("source_id").alias("n")).where(F.char_length("short") > 6)
    asked = V.table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * V.LINE_IDS + F.col("turn")).alias("query_id"), F.lower(F.concat("text", F.lit(" Under the SRC"), (F.col("conv_id") % 25).cast("string"), F.lit(" Matters Act?"))).alias("low"))
    return K.containing(asked, "query_id", "low", short, "n", "short").join(short, "n").select("query_id", "source_id")


def _registries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as registries with two regimes and a cite each; every third cite has a quotation, some name no known source."""
    k = F.col("s_suppkey")
    quotes = S.passages(spark, sf_dir).where(F.col("chunk_id") % V.LINE_IDS == 1).select((F.col("doc_id") + 1).alias("s_suppkey"), F.col("source_id").alias("of"), F.upper("text").alias("first"))
    rows = V.table(spark, sf_dir, "supplier").join(quotes, "s_suppkey", "left")
    return rows.select(
        k.alias("registry_id"), F.col("s_name").alias("name"), F.when(k % 2 == 0, "IN").otherwise("INTL").alias("jurisdiction"), F.array(S.pick(S.REGIMES, k), S.pick(S.REGIMES, k * 3 + 1)).alias("regimes"),
        F.when(k % 4 == 0, "nowhere").otherwise(F.coalesce("of", F.lit("src1"))).alias("source_id"), F.when(k % 3 == 0, "s.1").otherwise(F.concat(F.lit("s."), (k % 6 + 1).cast("string"))).alias("locator"), F.when(k % 3 == 0, F.col("first")).alias("quote"),
    )


_REGISTRIES = rf"""quotes AS (SELECT doc_id + 1 AS s_suppkey, source_id AS src, upper(text) AS first FROM passages WHERE chunk_id % 2147483648 = 1),
registries AS (SELECT s.s_suppkey AS registry_id, s_name AS name, CASE WHEN s.s_suppkey % 2 = 0 THEN 'IN' ELSE 'INTL' END AS jurisdiction, [{listed(S.REGIMES)}[s.s_suppkey % 16 + 1], {listed(S.REGIMES)}[(s.s_suppkey * 3 + 1) % 16 + 1]] AS regimes,
  CASE WHEN s.s_suppkey % 4 = 0 THEN 'nowhere' ELSE coalesce(q.src, 'src1') END AS source_id, CASE WHEN s.s_suppkey % 3 = 0 THEN 's.1' ELSE 's.' || (s.s_suppkey % 6 + 1) END AS locator, CASE WHEN s.s_suppkey % 3 = 0 THEN q.first END AS quote FROM supplier s LEFT JOIN quotes q USING (s_suppkey)),
cites AS (SELECT r.registry_id, p.chunk_id, r.quote IS NOT NULL AND r.quote <> '' AND contains(lower(trim(regexp_replace(p.text, '\s+', ' ', 'g'), ' ')), lower(trim(regexp_replace(r.quote, '\s+', ' ', 'g'), ' '))) AS holds, p.locator = r.locator AS exact FROM registries r JOIN passages p ON p.source_id = r.source_id AND (p.locator = r.locator OR split_part(p.locator, '(', 1) = r.locator)),
best AS (SELECT registry_id, chunk_id, holds FROM cites QUALIFY row_number() OVER (PARTITION BY registry_id ORDER BY holds DESC, exact DESC, chunk_id) = 1),
stored AS (SELECT r.*, b.chunk_id, coalesce(b.holds, false) AS quoted FROM registries r LEFT JOIN best b USING (registry_id))"""


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.resolve_cites(_registries(spark, sf_dir).withColumnRenamed("registry_id", "cite_id"), S.passages(spark, sf_dir)).withColumnRenamed("cite_id", "registry_id")


@query(f"WITH {PASSAGES}, {_REGISTRIES} SELECT registry_id, chunk_id, quoted FROM stored")
def j11_resolve_cite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir).select("registry_id", "chunk_id", "quoted")


@query(f"WITH {PASSAGES}, {_REGISTRIES} SELECT registry_id FROM stored WHERE quote IS NOT NULL AND NOT quoted")
def v5_check_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registries whose quotation doesn't stand at the provision that they cite."""
    return _stored(spark, sf_dir).where("quote is not null and not quoted").select("registry_id")


@query(f"WITH {PASSAGES}, {_REGISTRIES} SELECT count(*) AS registries, count(*) FILTER (chunk_id IS NULL) AS unresolved FROM stored")
def u5_seed_registries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir).agg(F.count(F.lit(1)).alias("registries"), F.count_if(F.col("chunk_id").isNull()).alias("unresolved"))


@query(f"""WITH {PASSAGES}, {_REGISTRIES}, {ASKED}, both_ways AS (SELECT DISTINCT query_id, registry_id, name FROM asked, stored WHERE chunk_id IS NOT NULL AND list_has_any(asked.regimes, stored.regimes))
SELECT query_id, registry_id, row_number() OVER (PARTITION BY query_id ORDER BY name, registry_id) AS place FROM both_ways QUALIFY place <= {G.POINTERS}""")
def j9_registry_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = S.asked(spark, sf_dir).where("jurisdiction = 'IN'").select("query_id", "regimes")
    return G.pointers(asked, _stored(spark, sf_dir))


@query(f"WITH {PASSAGES}, {_REGISTRIES} SELECT registry_id, name, p.source_id AS cite_source, p.locator AS cite_locator FROM stored s LEFT JOIN passages p USING (chunk_id) WHERE list_contains(regimes, 'abs') AND s.jurisdiction = 'IN'")
def j10_list_registries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.listing(_stored(spark, sf_dir), S.passages(spark, sf_dir), "abs", "IN").select("registry_id", "name", "cite_source", "cite_locator")


@query("SELECT p_partkey AS item_id, p_type AS shelf, count(*) OVER (PARTITION BY p_type) - 1 AS mates FROM part")
def j16_shelfmates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.shelfmates(V.table(spark, sf_dir, "part").select(_k().alias("item_id"), F.col("p_type").alias("shelf")))
