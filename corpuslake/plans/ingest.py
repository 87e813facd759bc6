"""Queries from normalised text to chunks, with their SQL twins. Documents stand for statutes and treaties: by its number, a line gets the marks that such texts have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.operators import evidence as E
from corpuslake.operators import ingest as I
from corpuslake.plans.queries import query
from corpuslake.plans.search import listed
from corpuslake.sources import passages as S
from corpuslake.sources import views as V

TYPES = ("statute", "treaty", "rules", "manual", "regulation", "notification")
#: What line ``{i}`` becomes; the same words in both dialects.
MARKED = """CASE {i} % 12 WHEN 1 THEN '<<page ' || CAST({i} AS STRING) || '>>' || chr(10) || line
  WHEN 2 THEN 'CHAPTER ' || CAST({i} AS STRING) || chr(10) || 'GENERAL MATTERS' || chr(10) || line
  WHEN 3 THEN CAST({i} AS STRING) || '. Scope of part ' || CAST({i} AS STRING) || '.—' || line
  WHEN 4 THEN CAST({i} % 10 - 2 AS STRING) || '. Heading of its own' || chr(10) || line
  WHEN 5 THEN 'Article ' || CAST({i} AS STRING) || chr(10) || 'Title of the article' || chr(10) || line
  WHEN 6 THEN '(a) ' || line || chr(10) || '(b) ' || line
  WHEN 7 THEN CAST({i} AS STRING) || chr(10) || line
  WHEN 8 THEN '3. Subs. by Act 5 of 1999, ibid., s. 2.' || chr(10) || line
  WHEN 9 THEN 'IndiaCode' || chr(10) || line
  WHEN 10 THEN 'SCHEDULE - H' || chr(10) || line
  WHEN 11 THEN 'Article' || chr(10) || CAST({i} AS STRING) || chr(10) || line
  ELSE CAST({i} AS STRING) || '. A heading that wraps' || chr(10) || 'over two lines.— ' || line || CASE WHEN {i} = 36 THEN chr(10) || 'STATEMENT OF OBJECTS AND REASONS' ELSE '' END END"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.expr(f"array_join(transform(split(text, chr(10)), (line, k) -> {MARKED.format(i='(k + 1)')}), chr(10))")
    return V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), S.pick(TYPES, F.col("doc_id")).alias("doc_type"), marked.alias("text"))


def _lines(spark: SparkSession, sf_dir: str, bare: bool = False) -> DataFrame:
    return I.iter_lines(I.scan_normalised(texts(spark, sf_dir)), bare)


_SCANNED = f"""texts AS (SELECT doc_id AS source_id, {listed(TYPES)}[doc_id % {len(TYPES)} + 1] AS doc_type, array_to_string(list_transform(string_split(text, chr(10)), lambda line, i: {MARKED.format(i='i')}), chr(10)) AS text FROM documents),
split AS (SELECT source_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM texts),
paged AS (SELECT *, regexp_extract(line, '{I.PAGE}', 1) AS mark FROM split),
scanned AS (SELECT source_id, line_no, coalesce(last_value(nullif(mark, '')::INT IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), 1) AS page, line, mark FROM paged QUALIFY mark = '')"""
_LINES = rf"""{_SCANNED}, stripped AS (SELECT source_id, line_no, page, regexp_replace(line, '^\s+|\s+$', '', 'g') AS line FROM scanned),
stopped AS (SELECT *, min(line_no) FILTER (regexp_matches(line, '{I.END}')) OVER (PARTITION BY source_id) AS stop FROM stripped),
raw AS (SELECT *, lead(line) OVER (PARTITION BY source_id ORDER BY line_no) AS after FROM stopped WHERE (stop IS NULL OR line_no < stop) AND line <> '' AND NOT regexp_matches(line, '{I.NOISE}') AND NOT regexp_matches(line, '{I.FOOTNOTE}')),
paired AS (SELECT *, coalesce(regexp_matches(line, '(?i)^Article$') AND regexp_matches(after, '^\d{{1,3}}\w{{0,6}}$') OR NOT regexp_matches(line, '{I.PAGE_NUMBER}') AND regexp_matches(line, '{I.HEADING_START}') AND NOT regexp_matches(line, '{I.DASH}') AND NOT regexp_matches(line, '[.;:,]$') AND regexp_matches(after, '{I.DASH}') AND length(regexp_extract(after, '^(.*?)(?:{I.DASH})', 1)) < {I.DASH_BEFORE}, false) AS joins FROM raw),
taken AS (SELECT *, coalesce(lag(joins) OVER (PARTITION BY source_id ORDER BY line_no), false) AS used FROM paired),
lines AS (SELECT source_id, line_no, page, CASE WHEN joins THEN line || ' ' || after ELSE line END AS line FROM taken WHERE NOT used AND (joins OR NOT regexp_matches(line, '{I.PAGE_NUMBER}')))"""


@query(f"WITH {_SCANNED} SELECT source_id, line_no, page, line FROM scanned")
def io2_scan_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.scan_normalised(texts(spark, sf_dir))


@query(f"WITH {_LINES} SELECT * FROM lines")
def p1_iter_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir)


_STRIP = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_SCHEDULE_NAME = f"regexp_replace(trim(concat_ws(' ', nullif(trim(regexp_extract(line, '{I.SCHEDULE}', 1)), ''), 'Schedule', nullif(trim(regexp_extract(line, '{I.SCHEDULE}', 2)), ''))), '^schedule', 'Schedule')"
_SECTIONS = rf"""chaptered AS (SELECT *, regexp_matches(line, '{I.CHAPTER}') AS is_chapter, lag(line) OVER w AS before FROM lines WINDOW w AS (PARTITION BY source_id ORDER BY line_no)),
opened AS (SELECT *, NOT is_chapter AND coalesce(regexp_matches(before, '{I.CHAPTER}'), false) AS opens FROM chaptered),
titled AS (SELECT *, opens AND line = upper(line) AND regexp_matches(line, '\p{{Lu}}') AND length(line) < 120 AS is_title FROM opened),
placed AS (SELECT *, coalesce(last_value(CASE WHEN is_title THEN regexp_extract(before, '{I.CHAPTER}', 1) || ' ' || array_to_string(list_transform(string_split(lower(line), ' '), lambda w: upper(w[1]) || w[2:]), ' ') WHEN opens THEN regexp_extract(before, '{I.CHAPTER}', 1) END IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), '') AS chapter FROM titled),
told AS (SELECT source_id, line_no, page, line, chapter, regexp_matches(line, '{I.SECTION}') AS is_section, regexp_matches(line, '{I.SCHEDULE}') AS like_schedule FROM placed WHERE NOT is_chapter AND NOT is_title),
begun AS (SELECT *, like_schedule AND coalesce(bool_or(is_section) OVER (PARTITION BY source_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS is_schedule FROM told),
section_heads AS (SELECT *, CASE WHEN is_schedule THEN {_SCHEDULE_NAME} WHEN is_section THEN '#' || regexp_replace(regexp_extract(line, '{I.SECTION}', 1), '[-()]', '', 'g') END AS locator, CASE WHEN is_schedule THEN {_SCHEDULE_NAME} WHEN is_section THEN regexp_replace(regexp_extract(line, '{I.SECTION}', 2), '^[ .\]]+|[ .\]]+$', '', 'g') END AS heading,
  CASE WHEN is_schedule THEN NULL WHEN is_section THEN nullif({_STRIP(f"regexp_replace(line, '{I.SECTION}', '')")}, '') ELSE line END AS body FROM begun)"""


def _units_sql(heads: str, name: str) -> str:
    return f"""{name}_numbered AS (SELECT *, count(locator) OVER (PARTITION BY source_id ORDER BY line_no) AS unit FROM {heads}),
{name} AS (SELECT source_id, unit, max(locator) AS locator, max(heading) AS heading, coalesce(max(chapter) FILTER (locator IS NOT NULL), '') AS chapter, max(page) FILTER (locator IS NOT NULL) AS page, {_STRIP("coalesce(string_agg(body, chr(10) ORDER BY line_no), '')")} AS text FROM {name}_numbered WHERE unit > 0 GROUP BY 1, 2)"""


_DASHED = f"{_SECTIONS}, {_units_sql('section_heads', 'dashed')}"
_SHOW = "SELECT source_id, unit, locator, heading, chapter, page, md5(text) AS text_md5, length(text) AS n_chars FROM "


def _show(units: DataFrame) -> DataFrame:
    return units.select("source_id", "unit", "locator", "heading", "chapter", "page", F.md5("text").alias("text_md5"), F.char_length("text").alias("n_chars"))


@query(f"WITH {_LINES}, {_DASHED} {_SHOW} dashed")
def p2_sections_and_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _show(I.sections(_lines(spark, sf_dir, bare=True), F.lit("#")))


_OK = f"(CASE WHEN c.schedule THEN r.begun ELSE r.last <= c.n AND c.n <= r.last + {I.GAP} OR c.n = 1 AND r.last > {I.GAP} END)"
_BARE = rf"""candidates AS (SELECT source_id, line_no, line, regexp_matches(line, '{I.SCHEDULE}') AS schedule, coalesce(try_cast(regexp_extract(line, '^(\d+)', 1) AS INT), 0) AS n, row_number() OVER (PARTITION BY source_id ORDER BY line_no) AS k FROM lines WHERE regexp_matches(line, '{I.BARE_HEADING}') OR regexp_matches(line, '{I.SCHEDULE}')),
walked AS (SELECT DISTINCT source_id, 0::BIGINT AS k, 0 AS last, false AS begun, NULL::BIGINT AS line_no, false AS ok FROM candidates
  UNION ALL SELECT c.source_id, c.k, CASE WHEN {_OK} THEN CASE WHEN c.schedule THEN {I.AFTER_SCHEDULE} ELSE c.n END ELSE r.last END, r.begun OR {_OK}, c.line_no, {_OK} FROM walked r JOIN candidates c ON c.source_id = r.source_id AND c.k = r.k + 1),
bare_heads AS (SELECT l.source_id, l.line_no, l.page, CASE WHEN w.ok THEN CASE WHEN regexp_matches(line, '{I.SCHEDULE}') THEN {_SCHEDULE_NAME} ELSE '#' || regexp_extract(line, '{I.BARE_HEADING}', 1) END END AS locator,
  CASE WHEN w.ok THEN CASE WHEN regexp_matches(line, '{I.SCHEDULE}') THEN {_SCHEDULE_NAME} ELSE trim(regexp_extract(line, '{I.BARE_HEADING}', 2)) END END AS heading, '' AS chapter, CASE WHEN w.ok THEN NULL ELSE line END AS body FROM lines l LEFT JOIN (SELECT * FROM walked WHERE ok) w ON w.source_id = l.source_id AND w.line_no = l.line_no), {_units_sql('bare_heads', 'bare')}"""


@query(f"WITH RECURSIVE {_LINES}, {_BARE} {_SHOW} bare")
def p3_bare_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _show(I.bare_headings(_lines(spark, sf_dir), F.lit("#")))


_SHORT_LINE = lambda c: f"(length({c}) < 120 AND NOT regexp_matches({c}, '[.;:]$'))"
_ARTICLES = f"""seen AS (SELECT *, coalesce(lead(line) OVER w, '') AS after FROM lines WINDOW w AS (PARTITION BY source_id ORDER BY line_no)),
headed AS (SELECT *, regexp_matches(line, '{I.ARTICLE}') AND NOT regexp_matches(after, '{I.CONTINUATION}') AS head FROM seen),
near AS (SELECT *, coalesce(lag(head) OVER w, false) AS after_head, coalesce(lead(head) OVER w, false) AS before_head FROM headed WINDOW w AS (PARTITION BY source_id ORDER BY line_no)),
article_heads AS (SELECT source_id, line_no, page, CASE WHEN head THEN 'Art. ' || lower(regexp_extract(line, '{I.ARTICLE}', 1)) END AS locator, CASE WHEN head THEN CASE WHEN NOT before_head AND after <> '' AND {_SHORT_LINE('after')} THEN after ELSE '' END END AS heading, '' AS chapter,
  CASE WHEN head OR after_head AND {_SHORT_LINE('line')} THEN NULL ELSE line END AS body FROM near), {_units_sql('article_heads', 'articles')}"""


@query(f"WITH {_LINES}, {_ARTICLES} {_SHOW} articles")
def p4_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _show(I.articles(_lines(spark, sf_dir)))


def _tidy_sql(units: str, name: str, statute: str) -> str:
    return rf"""{name} AS (SELECT * EXCLUDE (letters) FROM (SELECT *, regexp_replace(text, '[^\pL]', '', 'g') AS letters FROM {units}) WHERE length(text) >= {I.SHORTEST} AND (letters = '' OR length(regexp_replace(letters, '[^ऀ-ॿ]', '', 'g')) / length(letters) < 0.3)
  QUALIFY row_number() OVER (PARTITION BY source_id, locator ORDER BY ({statute} OR length(text) >= {I.SUBSTANTIAL}) DESC, CASE WHEN {statute} OR length(text) >= {I.SUBSTANTIAL} THEN 0 ELSE -length(text) END, unit) = 1)"""


_PREFIXED = "CASE WHEN starts_with(u.locator, '#') THEN CASE t.doc_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in I.PREFIX.items()) + " END || u.locator[2:] ELSE u.locator END AS locator"
_STATUTES = ", ".join(f"'{k}'" for k in I.PREFIX)
_CHOSEN = f"""{_DASHED}, {_BARE}, {_ARTICLES},
dashed_named AS (SELECT u.source_id, unit, {_PREFIXED}, heading, chapter, page, u.text FROM dashed u JOIN texts t USING (source_id) WHERE doc_type IN ({_STATUTES})), {_tidy_sql('dashed_named', 'dashed_kept', 'true')},
bare_named AS (SELECT u.source_id, unit, {_PREFIXED}, heading, chapter, page, u.text FROM bare u JOIN texts t USING (source_id) WHERE doc_type IN ({_STATUTES})), {_tidy_sql('bare_named', 'bare_kept', 'true')},
treaty_units AS (SELECT u.* FROM articles u JOIN texts t USING (source_id) WHERE doc_type IN ('treaty', 'regulation')), {_tidy_sql('treaty_units', 'treaties_kept', 'false')},
two AS (SELECT *, 'dashed' AS style FROM dashed_kept UNION ALL SELECT *, 'bare' FROM bare_kept),
won AS (SELECT source_id, max_by(style, (n, style = 'dashed')) AS style FROM (SELECT source_id, style, count(*) AS n FROM two GROUP BY ALL) GROUP BY 1),
structured AS (SELECT two.* FROM two JOIN won USING (source_id, style) UNION ALL SELECT *, 'articles' FROM treaties_kept),
page_units AS (SELECT l.source_id, min(line_no) AS unit, 'p.' || page AS locator, '' AS heading, '' AS chapter, page, string_agg(line, chr(10) ORDER BY line_no) AS text, any_value(doc_type) IN ({_STATUTES}) AS statute FROM lines l JOIN texts t USING (source_id) WHERE NOT EXISTS (SELECT 1 FROM structured s WHERE s.source_id = l.source_id) GROUP BY l.source_id, page), {_tidy_sql('page_units', 'pages_kept', 'statute')},
chosen AS (SELECT * FROM structured UNION ALL SELECT source_id, unit, locator, heading, chapter, page, text, 'pages' FROM pages_kept)"""


@query(f"WITH RECURSIVE {_LINES}, {_CHOSEN} SELECT source_id, unit, locator, heading, chapter, page, md5(text) AS text_md5, length(text) AS n_chars, style FROM chosen")
def p6_choose_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = texts(spark, sf_dir)
    units = I.choose_parse(I.scan_normalised(sources), sources)
    return units.select("source_id", "unit", "locator", "heading", "chapter", "page", F.md5("text").alias("text_md5"), F.char_length("text").alias("n_chars"), "style")


@query(rf"""WITH RECURSIVE base AS (SELECT doc_id AS source_id, doc_id % 3 AS unit, CASE WHEN doc_id % 2 = 0 THEN 'Art. ' ELSE 's.' END || doc_id AS locator, text FROM (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda line, i: CASE i % 4 WHEN 0 THEN '(' || chr((97 + i % 26)::INT) || ') ' || line WHEN 3 THEN (i % 90) || '.' || chr(10) || line ELSE line END), chr(10)) AS text FROM documents)),
long_lines AS (SELECT source_id, unit, locator, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM base WHERE length(text) > {I.LONGEST}),
ided AS (SELECT *, greatest(regexp_extract(line, '{E.CLAUSE}', 1), regexp_extract(line, '{E.PARAGRAPH}', 1)) AS id FROM long_lines),
pieced AS (SELECT *, sum((id <> '')::INT) OVER (PARTITION BY source_id ORDER BY k) AS piece FROM ided),
pieces AS (SELECT source_id, piece, max(id) AS id, sum(length(line)) + count(*) - 1 AS n, row_number() OVER (PARTITION BY source_id ORDER BY piece) AS j FROM pieced GROUP BY 1, 2),
packed AS (SELECT source_id, j, piece, n AS used, 0 AS grp FROM pieces WHERE j = 1 UNION ALL SELECT p.source_id, p.j, p.piece, CASE WHEN r.used + p.n > {I.TARGET} THEN p.n ELSE r.used + 1 + p.n END, CASE WHEN r.used + p.n > {I.TARGET} THEN r.grp + 1 ELSE r.grp END FROM packed r JOIN pieces p ON p.source_id = r.source_id AND p.j = r.j + 1),
grouped AS (SELECT l.*, g.grp, row_number() OVER (PARTITION BY l.source_id, g.grp ORDER BY k) AS m, sum(length(line) + 1) OVER (PARTITION BY l.source_id, g.grp) - 1 AS size FROM pieced l JOIN packed g ON g.source_id = l.source_id AND g.piece = l.piece),
cut AS (SELECT source_id, grp, m, length(line) AS used, 0 AS sub FROM grouped WHERE m = 1 AND size > {I.LONGEST} UNION ALL SELECT g.source_id, g.grp, g.m, CASE WHEN c.used > 0 AND c.used + length(g.line) + 1 <= {I.TARGET} THEN c.used + 1 + length(g.line) ELSE length(g.line) END, CASE WHEN c.used > 0 AND c.used + length(g.line) + 1 > {I.TARGET} THEN c.sub + 1 ELSE c.sub END FROM cut c JOIN grouped g ON g.source_id = c.source_id AND g.grp = c.grp AND g.m = c.m + 1),
named AS (SELECT source_id, grp, min_by(id, k) FILTER (id <> '') AS a, max_by(id, k) FILTER (id <> '') AS z, count(*) FILTER (id <> '') AS n FROM grouped GROUP BY 1, 2),
parts AS (SELECT g.source_id, any_value(unit) AS unit, any_value(locator) AS base, g.grp, coalesce(c.sub, 0) AS sub, string_agg(line, chr(10) ORDER BY k) AS text FROM grouped g LEFT JOIN cut c ON c.source_id = g.source_id AND c.grp = g.grp AND c.m = g.m GROUP BY g.source_id, g.grp, coalesce(c.sub, 0)),
shown AS (SELECT p.source_id, unit, row_number() OVER (PARTITION BY p.source_id ORDER BY p.grp, sub) AS part, base || CASE WHEN n = 0 THEN '' WHEN starts_with(base, 'Art.') THEN '.' || a || CASE WHEN n > 1 THEN '–.' || z ELSE '' END ELSE '(' || a || ')' || CASE WHEN n > 1 THEN '–(' || z || ')' ELSE '' END END AS locator, text FROM parts p JOIN named m ON m.source_id = p.source_id AND m.grp = p.grp
  UNION ALL SELECT source_id, unit, 1, locator, text FROM base WHERE length(text) <= {I.LONGEST})
SELECT source_id, unit, part, locator, md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS text_md5 FROM shown""")
def p10_chunk_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as units with clauses and numbered paragraphs."""
    marked = F.expr("array_join(transform(split(text, chr(10)), (line, k) -> CASE (k + 1) % 4 WHEN 0 THEN '(' || chr(97 + (k + 1) % 26) || ') ' || line WHEN 3 THEN CAST((k + 1) % 90 AS STRING) || '.' || chr(10) || line ELSE line END), chr(10))")
    base = F.concat(F.when(F.col("doc_id") % 2 == 0, "Art. ").otherwise("s."), F.col("doc_id").cast("string"))
    units = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), (F.col("doc_id") % 3).alias("unit"), base.alias("locator"), marked.alias("text"))
    return I.chunk_units(units).select("source_id", "unit", "part", "locator", F.md5("text").alias("text_md5"))


@query(r"""WITH r AS (SELECT p_size AS table_id, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) + 3 AS row, p_name, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END AS brand, p_type, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_partkey::VARCHAR END AS size FROM part)
SELECT table_id, row, concat_ws(' | ', 'Name: ' || nullif(trim(p_name), ''), 'Brand: ' || nullif(brand, ''), 'Kind: ' || nullif(p_type, ''), 'column 4: ' || size) AS line FROM r QUALIFY row >= min(row) FILTER (brand <> '' OR size IS NOT NULL) OVER (PARTITION BY table_id)""")
def n3_render_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one size as a printed table: a header that names two columns, a second line of it that names the third, a row of column numbers, a blank row, then one row a part."""
    from pyspark.sql import Window

    part = V.table(spark, sf_dir, "part")
    row = (F.row_number().over(Window.partitionBy("p_size").orderBy("p_partkey")) + 3).alias("row")
    body = part.select(F.col("p_size").alias("table_id"), row, F.array("p_name", F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_brand")), "p_type", F.when(F.col("p_partkey") % 4 != 0, F.col("p_partkey").cast("string"))).alias("cells"))
    top = [["Name", "Brand", "", "x" * 61], ["", "Other", "Kind", ""], ["1", "2.", "3)", "4"], ["", "", None, ""]]
    heads = part.select(F.col("p_size").alias("table_id")).distinct().select("table_id", F.posexplode(F.array(*[F.array(*[F.lit(c).cast("string") for c in cells]) for cells in top])).alias("row", "cells"))
    return I.render_table(body.union(heads).select("table_id", "row", F.posexplode("cells").alias("col", "text")))
