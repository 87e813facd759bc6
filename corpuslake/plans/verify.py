"""Queries that check drafted answers, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.functions import passages as P
from corpuslake.functions import text as T
from corpuslake.operators import blocks as K
from corpuslake.operators import verify as W
from corpuslake.plans.queries import query
from corpuslake.plans.search import PASSAGES, listed, quoted
from corpuslake.sources import passages as S
from corpuslake.sources import views as V


def norm_sql(x: str) -> str:
    """``text.for_match`` in SQL."""
    return rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[“”"''‘’`\[\]\x{{ad}}]', '', 'g'), '[‐‑‒–—―−-]', '-', 'g'), '\s*-\s*', '-', 'g'), '\s+', ' ', 'g'), '^[ .;:,]+|[ .;:,]+$', '', 'g')"""


def pieces_sql(quote: str) -> str:
    return rf"list_filter(list_transform(regexp_split_to_array({quote}, '\.{{3,}}|…'), lambda p: {norm_sql('p')}), lambda p: p <> '')"


def held_sql(pieces: str, hay: str) -> str:
    """Are the pieces in ``hay`` (both normalised), in order, the longest of at least MIN_PIECE characters?"""
    return f"(coalesce(list_max(list_transform({pieces}, lambda p: length(p))), 0) >= {T.MIN_PIECE} AND list_reduce(list_concat([{hay}], {pieces}), lambda rest, p: CASE WHEN rest IS NULL OR strpos(rest, p) = 0 THEN NULL ELSE substr(rest, strpos(rest, p) + length(p)) END) IS NOT NULL)"


_DRAFTS = f"""drafts AS (SELECT doc_id AS answer_id, CASE WHEN lang = 'en' THEN 'IN' ELSE 'INTL' END AS jurisdiction, text || ' Under section ' || (doc_id % 9 + 1) || ' and Rule ' || (doc_id % 4 * 3) || ' approval is required.' || chr(10) || chr(10) || {listed(S.LEAKS)}[doc_id % {len(S.LEAKS)} + 1] || chr(10) || chr(10) || 'A licence must be held.' AS markdown FROM documents)"""
_RETRIEVED = """numbered AS (SELECT *, chunk_id % 2147483648 AS line FROM passages), retrieved AS (SELECT doc_id AS answer_id, line AS rank, chunk_id, jurisdiction, locator, header, text FROM numbered WHERE line <= 5 UNION ALL SELECT doc_id - 1, 9, chunk_id, jurisdiction, locator, header, text FROM numbered WHERE line = 1)"""
_CITED = """firsts AS (SELECT o.doc_id, o.chunk_id, o.text, t.text AS second, n.chunk_id AS next_id, n.text AS next FROM (SELECT * FROM numbered WHERE line = 1) o LEFT JOIN (SELECT * FROM numbered WHERE line = 2) t ON t.doc_id = o.doc_id LEFT JOIN (SELECT * FROM numbered WHERE line = 1) n ON n.doc_id = o.doc_id + 1),
citations AS (SELECT doc_id AS answer_id, unnest([1, 2, 3, 4, 5, 6, 7]) AS pos, unnest([chunk_id, chunk_id, doc_id * 2147483648 + 99, chunk_id, next_id, chunk_id, chunk_id]) AS chunk_id,
  unnest([text, second, 'x', text, next, substr(text, 1, length(text) // 3) || '…' || substr(text, length(text) // 2, length(text)), 'words that nobody wrote here']) AS quote FROM firsts), kept_citations AS (SELECT * FROM citations WHERE chunk_id IS NOT NULL AND quote IS NOT NULL)"""
_VERDICTS = f"""hays AS (SELECT *, {norm_sql('text')} AS hay FROM retrieved), asked AS (SELECT c.*, d.jurisdiction, h.jurisdiction AS made_in, h.hay, {pieces_sql('c.quote')} AS pieces FROM kept_citations c JOIN drafts d USING (answer_id) LEFT JOIN hays h ON h.answer_id = c.answer_id AND h.chunk_id = c.chunk_id),
known AS (SELECT *, {held_sql('pieces', 'hay')} AS holds FROM asked WHERE made_in IS NOT NULL QUALIFY row_number() OVER (PARTITION BY answer_id, chunk_id, quote ORDER BY pos) = 1),
moved AS (SELECT k.answer_id, k.pos, min_by(h.chunk_id, h.rank) AS there FROM known k JOIN hays h ON h.answer_id = k.answer_id AND h.jurisdiction = k.jurisdiction WHERE NOT k.holds AND {held_sql('k.pieces', 'h.hay')} GROUP BY ALL),
verdicts AS (SELECT k.answer_id, k.pos, CASE WHEN made_in <> k.jurisdiction AND there IS NULL THEN 'leak' WHEN holds THEN 'verified' WHEN there IS NOT NULL THEN 'moved' ELSE 'not found' END AS outcome, coalesce(there, k.chunk_id) AS chunk_id FROM known k LEFT JOIN moved m ON m.answer_id = k.answer_id AND m.pos = k.pos
  UNION ALL SELECT answer_id, pos, 'unknown', chunk_id FROM asked WHERE made_in IS NULL)"""
_USED = "used AS (SELECT r.answer_id, r.locator, r.header || ' ' || r.text AS text FROM retrieved r SEMI JOIN kept_citations c ON c.answer_id = r.answer_id AND c.chunk_id = r.chunk_id)"
_PROVISIONS = lambda c: f"list_transform(regexp_extract_all({c}, '{T.PROVISION}', 2), lambda x: upper(x))"
_BARE = rf"""backed AS (SELECT answer_id, unnest(list_append({_PROVISIONS("locator || ' ' || text")}, upper(split_part(split_part(regexp_replace(locator, '^\D+', ''), '(', 1), '.', 1)))) AS provision FROM used),
bare AS (SELECT DISTINCT answer_id, provision FROM (SELECT answer_id, unnest({_PROVISIONS('markdown')}) AS provision FROM drafts) p ANTI JOIN backed b ON b.answer_id = p.answer_id AND b.provision = p.provision)"""
_STRAY = f"""terms AS (SELECT DISTINCT answer_id, unnest(CASE jurisdiction WHEN 'IN' THEN regexp_extract_all(markdown, '{W.FOREIGN["IN"]}', 1) ELSE regexp_extract_all(markdown, '{W.FOREIGN["INTL"]}', 1) END) AS term FROM drafts),
stray AS (SELECT t.* FROM terms t WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.answer_id = t.answer_id AND (contains(lower(u.text), lower(term)) OR contains(lower(u.text), lower(CASE term {" ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in W.LONG_FORMS.items())} END)))))"""
_CLAIMS = rf"""claims AS (SELECT d.answer_id, len(list_filter(regexp_split_to_array(markdown, '\n\s*\n'), lambda p: regexp_matches(p, '{P.ASSERTION}'))) AS asserting, coalesce(v.verified, 0) AS verified FROM drafts d LEFT JOIN (SELECT answer_id, count(*) FILTER (outcome IN ('verified', 'moved')) AS verified FROM verdicts GROUP BY 1) v USING (answer_id)),
flagged_claims AS (SELECT *, CASE WHEN asserting > 0 AND verified = 0 THEN 'none' WHEN asserting > 2 * greatest(verified, 1) THEN 'few' ELSE 'enough' END AS flag FROM claims)"""
_ALL = f"{PASSAGES}, {_DRAFTS}, {_RETRIEVED}, {_CITED}, {_VERDICTS}, {_USED}, {_BARE}, {_STRAY}, {_CLAIMS}"


def _three(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return S.drafts(spark, sf_dir), S.citations(spark, sf_dir), S.retrieved(spark, sf_dir)


@query(f"WITH {_ALL} SELECT *, outcome IN ('verified', 'moved') AS verified FROM verdicts")
def j8_verify_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.verify_citations(*_three(spark, sf_dir))


@query(f"WITH {_ALL} SELECT * FROM bare")
def v10_unbacked_provisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers, citations, retrieved = _three(spark, sf_dir)
    return W.unbacked_provisions(answers, W.cited_texts(citations, retrieved))


@query(f"WITH {_ALL} SELECT * FROM stray")
def v11_jurisdiction_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers, citations, retrieved = _three(spark, sf_dir)
    return W.jurisdiction_leaks(answers, W.cited_texts(citations, retrieved))


@query(f"WITH {_ALL} SELECT * FROM flagged_claims")
def v12_unsupported_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers, citations, retrieved = _three(spark, sf_dir)
    return W.unsupported_assertions(answers, W.verify_citations(answers, citations, retrieved))


@query(f"""WITH {_ALL}, per AS (SELECT answer_id, count(*) FILTER (outcome <> 'unknown') AS citations, count(*) FILTER (outcome IN ('unknown', 'not found', 'leak')) AS flagged, bool_or(outcome = 'leak') AS leaked FROM verdicts GROUP BY 1)
SELECT c.answer_id, coalesce(citations, 0) AS citations, c.verified, coalesce(flagged, 0) + coalesce(b.n, 0) + CASE WHEN s.n > 0 THEN 1 ELSE 0 END + CASE WHEN flag <> 'enough' THEN 1 ELSE 0 END AS flags, coalesce(leaked, false) OR s.n IS NOT NULL AS leaked
FROM flagged_claims c LEFT JOIN per p ON p.answer_id = c.answer_id LEFT JOIN (SELECT answer_id, count(*) AS n FROM bare GROUP BY 1) b ON b.answer_id = c.answer_id LEFT JOIN (SELECT answer_id, count(*) AS n FROM stray GROUP BY 1) s ON s.answer_id = c.answer_id""")
def x3_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.verify(*_three(spark, sf_dir))


@query(f"WITH q AS (SELECT item_id, {pieces_sql('text')} AS pieces FROM benchmark), d AS (SELECT doc_id, {norm_sql('text')} AS hay FROM documents) SELECT item_id, doc_id FROM q, d WHERE {held_sql('pieces', 'hay')}")
def f5_quote_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that hold a benchmark passage as a quotation: its longest piece is looked for in all texts at once, then the order of all pieces is tested."""
    docs = V.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"), T.for_match(F.col("text")).alias("hay"))
    quotes = V.table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    longest = F.max_by("p", F.char_length("p"))
    pieces = quotes.select("item_id", F.explode(T.pieces(F.col("quote"))).alias("p")).groupBy("item_id").agg(longest.alias("piece")).where(F.char_length("piece") >= T.MIN_PIECE)
    near = K.containing(docs, "doc_id", "hay", pieces, "item_id", "piece")
    return near.join(quotes, "item_id").join(docs, "doc_id").where(T.quote_in(F.col("quote"), F.col("body"))).select("item_id", "doc_id")
