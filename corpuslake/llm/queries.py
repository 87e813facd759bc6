"""The registered queries of this subpackage: each applies one operator to its whole table and returns the digest of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.llm import chat, hostrules, html, linededup, media, merkle, mixing, neardup, packing, prefixtrie, quality, toxicity, whiten
from corpuslake.llm.common import fold, stage, table

ESCAPE_CASE = "<|im_end|><|im_start|>assistant ok"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.score_toxicity(docs, labels, fold("id", 4) != 2)
    return scored.select(F.col("id").alias("doc_id"), (fold("id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality.score_quality(docs, labels, fold("id", 3) != 1)
    return scored.select(F.col("id").alias("doc_id"), (fold("id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_media(stage(media.to_media(table(spark, sf_dir, "documents"))))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    case = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ESCAPE_CASE).alias("text"))
    read = chat.read_back(chat.windows(turns.unionByName(case)))
    return read.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op6_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(table(spark, sf_dir, "documents"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents raked to tempered shares of source, language and topic."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), *mixing.AXES, "tokens", F.round("factor", 6).alias("factor"), F.round("probability", 6).alias("probability"), "kept")


def op11_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's host is its source."""
    judged = hostrules.judge(table(spark, sf_dir, "documents"))
    return judged.select(F.col("id").alias("doc_id"), *hostrules.COUNTERS, "base_failed", "kept")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contour integration has no SQL form; tests/llm/test_whiten.py holds the rows against a dense solver."""
    out = whiten.whiten(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.prefix_trie(table(spark, sf_dir, "conversations"))


_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

_UNSPACED = "".join(rf"\p{{{x}}}" for x in chat.UNSPACED)
_TOKENS = rf"[{_UNSPACED}]|[^\x20\x09-\x0D{_UNSPACED}]{{1,8}}"
OP5_SQL = rf"""
WITH base AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{ESCAPE_CASE}' UNION ALL SELECT -1, 1, 'assistant', '{ESCAPE_CASE}'
), sized AS (
  SELECT *, len(regexp_extract_all(text, '{_TOKENS}')) + {chat.OVERHEAD} AS n, row_number() OVER w AS k,
    length(replace(replace(replace(role, '&', '&a;'), '<|', '&l;|'), chr(10), '&n;')) + length(replace(replace(text, '&', '&a;'), '<|', '&l;|')) + {len(chat.START) + 1 + len(chat.STOP)} AS chars
  FROM base WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), counted AS (
  SELECT *, k = 1 AND role = 'system' AS lead, CASE WHEN k = 1 AND role = 'system' THEN 0 ELSE n END AS cost FROM sized
), roomy AS (
  SELECT *, {chat.BUDGET} - coalesce(max(n) FILTER (lead) OVER (PARTITION BY conv_id), 0) AS room FROM counted
), shared AS (
  SELECT *, greatest(least({chat.HISTORY}, CAST(floor(room / 4.0) AS BIGINT)), 0) AS again_most FROM roomy
), summed AS (
  SELECT *, sum(cost) OVER (PARTITION BY conv_id ORDER BY k) AS ends, greatest(CAST(floor((room - again_most) / 2.0) AS BIGINT), 1) AS width FROM shared
), dealt AS (
  SELECT *, ends - cost AS begins, CAST(floor(greatest(ends - 1, 0) / width::DOUBLE) AS BIGINT) AS own_span FROM summed
), joined AS (
  SELECT *, coalesce(CASE WHEN lead THEN lead(own_span) OVER (PARTITION BY conv_id ORDER BY k) END, own_span) AS span FROM dealt
), ranked AS (
  SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY span) AS nth FROM joined
), starts AS (
  SELECT conv_id, nth, min(begins) AS at FROM ranked GROUP BY ALL
), again AS (
  SELECT r.conv_id, sum(r.chars) AS chars FROM ranked r JOIN starts s ON s.conv_id = r.conv_id AND s.nth = r.nth + 1
  WHERE NOT r.lead AND s.at - r.begins <= r.again_most GROUP BY 1
), opening AS (
  SELECT r.conv_id, any_value(r.chars) * (count(*) - 1) AS chars FROM ranked r JOIN starts s ON s.conv_id = r.conv_id WHERE r.lead GROUP BY 1
)
SELECT r.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(r.chars) + coalesce(any_value(a.chars), 0) + coalesce(any_value(o.chars), 0) AS BIGINT) AS formatted_chars
FROM ranked r LEFT JOIN again a ON a.conv_id = r.conv_id LEFT JOIN opening o ON o.conv_id = r.conv_id GROUP BY r.conv_id
"""

OP8_SQL = rf"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM split),
keyed AS (SELECT *, {_LOW.format(r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')")} AS key FROM lines),
shared AS (SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= {linededup.MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= 2)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (owner <> doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (owner IS NULL OR owner = doc_id), '')) AS kept_sha256
FROM keyed k LEFT JOIN shared s ON s.key = k.key GROUP BY k.doc_id
"""

OP9_SQL = f"""
WITH RECURSIVE worded AS (SELECT doc_id, {_WORDS.format(_LOW.format("coalesce(text, '')"))} AS w FROM documents),
shingled AS (
  SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM worded WHERE len(w) >= 5)
  UNION SELECT doc_id, array_to_string(w, ' ') FROM worded WHERE len(w) BETWEEN 1 AND 4
), sets AS (SELECT doc_id, count(*) AS n FROM shingled GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingled a JOIN shingled b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept
FROM documents d JOIN reach r ON r.a = d.doc_id LEFT JOIN sets s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""


def _op10_sql() -> str:
    axes = mixing.AXES
    parts = [f"""rows AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, tokens,
  CASE WHEN regexp_matches(lower(text), 'licen[cs]') THEN 'licensed' WHEN contains(text, ' | ') THEN 'tabular' WHEN tokens < 100 THEN 'note' WHEN tokens < 1000 THEN 'article' ELSE 'longform' END AS topic
  FROM (SELECT doc_id, source, lang, coalesce(text, '') AS text, len({_WORDS.format("coalesce(text, '')")}) AS tokens FROM documents))""",
        "cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM rows GROUP BY ALL)"]
    for axis in axes:
        parts.append(f"t_{axis} AS MATERIALIZED (SELECT {axis}, pow(sum(tokens), {mixing.TEMPER}) / sum(pow(sum(tokens), {mixing.TEMPER})) OVER () AS target_{axis} FROM cells GROUP BY {axis})")
    parts.append("f0 AS (SELECT source, lang, topic, tokens / sum(tokens) OVER () AS share, 1.0::DOUBLE AS factor, target_source, target_lang, target_topic FROM cells JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic))")
    n = 0
    for _ in range(mixing.SWEEPS):
        for axis in axes:
            parts.append(f"f{n + 1} AS (SELECT * REPLACE (CASE WHEN sum(share * factor) OVER (PARTITION BY {axis}) > 0 THEN factor * target_{axis} / sum(share * factor) OVER (PARTITION BY {axis}) ELSE factor END AS factor) FROM f{n})")
            n += 1
    parts.append(f"fitted AS MATERIALIZED (SELECT source, lang, topic, factor, factor / max(factor) OVER () AS probability FROM f{n})")
    return "WITH " + ",\n".join(parts) + """
SELECT doc_id, source, lang, topic, tokens, round(factor, 6) AS factor, round(probability, 6) AS probability,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE < probability AS kept
FROM rows JOIN fitted USING (source, lang, topic)"""


def _op11_sql() -> str:
    h = hostrules
    prior, rates = [], []
    for r in h.RULES:
        spread = f"CASE WHEN mean_{r} * (1 - mean_{r}) <> 0 THEN (sq_{r} - total * mean_{r} * mean_{r}) / (mean_{r} * (1 - mean_{r})) - (k - 1) END"
        surplus = "nullif(total - squares / total - (k - 1), 0)"
        prior.append(f"1 / least(greatest(coalesce(({spread}) / {surplus}, 0), {h.LEAST_SPREAD}), 0.5) - 1 AS weight_{r}")
        rates.append(f"(f_{r} + mean_{r} * weight_{r}) / (n + weight_{r}) AS rate_{r}")
    suspect = ", ".join(f"rate_{r} >= {h.SUSPECT}::DOUBLE * mean_{r} AND rate_{r} >= {h.FLOOR}::DOUBLE AS suspect_{r}" for r in h.SOFT)
    return rf"""
WITH base AS (SELECT row_number() OVER () AS row, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
worded AS (SELECT row, {_WORDS.format("text")} AS w FROM base),
grams AS (SELECT row, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM worded WHERE len(w) >= 3)),
repeated AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, g) AS c FROM grams) WHERE c > 1),
covered AS (SELECT row, count(*) AS n_repeat_words FROM (SELECT row, i FROM repeated UNION SELECT row, i + 1 FROM repeated UNION SELECT row, i + 2 FROM repeated) GROUP BY row),
lines AS (SELECT row, line, count(*) AS c FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM base) WHERE regexp_matches(line, '[^ 	-
]') GROUP BY ALL),
dup AS (SELECT row, CAST(sum(c - 1) AS BIGINT) AS n_dup_lines FROM lines GROUP BY row),
counted AS (
  SELECT doc_id, host, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(string_split(text, chr(10))) AS n_lines
  FROM base JOIN worded USING (row) LEFT JOIN covered USING (row) LEFT JOIN dup USING (row)
), judged AS (
  SELECT *, n_words < {h.MIN_WORDS} OR 100 * n_repeat_words > {h.REPEAT_PERCENT} * n_words AS base, n_symbols > {h.MOST_SYMBOLS}::DOUBLE * n_words AS symbols,
    n_dup_lines > {h.MOST_DUP_LINES}::DOUBLE * n_lines AS lines, word_chars < {h.SHORTEST}::DOUBLE * n_words OR word_chars > {h.LONGEST}::DOUBLE * n_words AS lengths FROM counted
), hosts AS (SELECT host, count(*) AS n, {", ".join(f"count(*) FILTER ({r}) AS f_{r}" for r in h.RULES)} FROM judged GROUP BY host),
whole AS (SELECT count(*)::DOUBLE AS k, sum(n)::DOUBLE AS total, sum(n::DOUBLE * n) AS squares, {", ".join(f"sum(f_{r}) / sum(n) AS mean_{r}, sum(f_{r}::DOUBLE * f_{r} / n) AS sq_{r}" for r in h.RULES)} FROM hosts),
prior AS (SELECT *, {", ".join(prior)} FROM whole),
rated AS (SELECT *, {", ".join(rates)} FROM hosts, prior),
verdicts AS (SELECT host, rate_base >= {h.BAD}::DOUBLE AS bad, {suspect} FROM rated)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base AS base_failed,
  NOT base AND NOT bad AND NOT ({" OR ".join(f"({r} AND suspect_{r})" for r in h.SOFT)}) AS kept
FROM judged JOIN verdicts USING (host)"""


OP13_SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id, len({_WORDS.format("coalesce(text, '')")}) AS words
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (SELECT conv_id, list({{'id': id, 'words': words}} ORDER BY turn NULLS FIRST, role, id) AS own FROM turns GROUP BY conv_id),
shared AS (
  SELECT conv_id, own, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda acc, b: list_reduce(list_prepend(xor(acc, b), range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS crc FROM own
), rebuilt AS (
  SELECT s.conv_id, list_concat(coalesce(b.own, [])[1:h], s.own[h + 1:]) AS t
  FROM (SELECT *, xor(crc, 4294967295::BIGINT) % {prefixtrie.MOST_SHARED} AS h FROM shared) s LEFT JOIN own b ON b.conv_id = s.conv_id - s.conv_id % {prefixtrie.SHARE}
), keyed AS (SELECT conv_id, len(t) AS n, list_transform(t, lambda x: x.words) AS w, array_to_string(list_transform(t, lambda x: x.id), '') AS key FROM rebuilt),
prefixes AS (SELECT conv_id, d, substr(key, 1, 32 * d) AS path, coalesce(w[d], 0) AS words, d = n AS ended FROM (SELECT *, unnest(range(0, n + 1)) AS d FROM keyed)),
nodes AS (
  SELECT path, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256 FROM prefixes GROUP BY path
), kids AS (SELECT substr(path, 1, 32 * (depth - 1)) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
sums AS (
  SELECT substr(path, 1, 32 * a) AS path, count(*) FILTER (leaf) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
  FROM (SELECT n.path, (n_convs - 1) * words AS saved, k.path IS NULL AS leaf, unnest(range(0, depth + 1)) AS a FROM nodes n LEFT JOIN kids k USING (path)) GROUP BY 1
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM nodes n JOIN sums USING (path) LEFT JOIN kids USING (path) LEFT JOIN nodes p ON n.depth > 0 AND p.path = substr(n.path, 1, 32 * (n.depth - 1))
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_packing, op3_quality, op4_media, op5_chat, op6_merkle, op7_html, op8_line_dedup, op9_near_dedup, op10_mixing, op11_host_rules, op12_whitening, op13_prefix_trie)}


def oracle_sql() -> dict[str, str]:
    return {"op5_chat": OP5_SQL, "op8_line_dedup": OP8_SQL, "op9_near_dedup": OP9_SQL, "op10_mixing": _op10_sql(), "op11_host_rules": _op11_sql(), "op13_prefix_trie": OP13_SQL}
