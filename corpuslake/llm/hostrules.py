"""Quality rules at the level of hosts. DataFrame functions only.

Counters of a whole text are taken in one pass. Two base rules judge a document alone (too few words; most words in repeated
windows of three). Three soft rules are too noisy to judge one document: symbols for each word, repeated lines, mean length of
a word. For each rule the failures are counted by host, and a host's rate is shrunk by a beta prior whose mean and concentration
are fitted to all hosts by moments (between-host variance beyond what binomial noise explains), so that a host of few documents
keeps near the corpus and one of many speaks for itself.

Verdict of a host: ``bad`` if its shrunk base rate is at least BAD, all its documents go; for each soft rule ``suspect`` if the
shrunk rate is at least SUSPECT times the prior's mean and at least FLOOR, then its documents that fail this rule go.

Plan: the counters are staged (a few numbers a row), texts are read once. Failures are summed by host before they are
shuffled. Hosts with at least one document in HOT of all are at most HOT many and are sent to every task; all
other hosts meet their documents by a join on the host, in which no host has more than that share of the rows.

Nulls and edge cases: a null or empty text has no words and fails; a null host is a host of its own; a null id is passed on;
repeated rows are judged once each and count once each; equal rates need no order; an empty table gives an empty result; of
further columns none is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.common import BLANKS, WORD, stage

MIN_WORDS, REPEAT_PERCENT = 50, 50
BAD, SUSPECT, FLOOR, HOT = 0.5, 2.0, 0.05, 1000
MOST_SYMBOLS, MOST_DUP_LINES, SHORTEST, LONGEST = 0.1, 0.3, 2.5, 12.0
LEAST_SPREAD = 1e-6
SOFT = ("symbols", "lines", "lengths")
RULES = ("base", *SOFT)
COUNTERS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# Fixed value: the characters that count as symbols.
SYMBOLS = r"[#*$%&|<>]"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body or a lambda in it reads it."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """How many words stand in a window of three words that the text holds twice or more. Windows are sorted by half of a hash
    with their place in the low bits; only those that meet an equal half are spelled out, sorted and compared as text. Each
    repeated start covers three words up to the next start."""
    spelled = lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    packed = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(F.lit(-(1 << 32))) + i)
    near = lambda x, y: F.coalesce(F.shiftrightunsigned(x.bitwiseXOR(y), 32) == 0, F.lit(False))
    place = lambda x: x.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    likely = lambda s: F.transform(F.filter(s, lambda x, i: near(x, F.get(s, i - 1)) | near(x, F.get(s, i + 1))), lambda x: F.struct(spelled(place(x)).alias("g"), place(x).alias("i")))
    same = lambda s, x, j: F.coalesce(F.get(s, j)["g"] == x["g"], F.lit(False))
    starts = lambda s: F.sort_array(F.transform(F.filter(s, lambda x, i: same(s, x, i - 1) | same(s, x, i + 1)), lambda x: x["i"]))
    cover = lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    exact = lambda c: F.when(F.size(c) == 0, 0).otherwise(_let(F.sort_array(c), lambda s: _let(starts(s), cover)))
    return _let(F.sort_array(packed), lambda s: _let(likely(s), exact))


def counters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``id, host`` and COUNTERS of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    parts = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.when(F.size(w) > 3, repeated_words(w)).otherwise(0).cast("long").alias("n_repeat_words")))
    dup = _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    lengths = ((F.char_length(text) - F.regexp_count(text, F.lit(BLANKS))).cast("long").alias("word_chars"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"), dup.cast("long").alias("n_dup_lines"))
    n_lines = F.size(F.split(text, "\n")).cast("long").alias("n_lines")
    return rows.select("id", "host", parts.alias("parts"), *lengths, n_lines).select("id", "host", "parts.*", "word_chars", "n_symbols", "n_dup_lines", "n_lines")


def failures() -> dict[str, Column]:
    """Each rule over COUNTERS; an integer comparison wherever one decides."""
    words = F.col("n_words")
    return {
        "base": (words < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * words),
        "symbols": F.col("n_symbols") > MOST_SYMBOLS * words,
        "lines": F.col("n_dup_lines") > MOST_DUP_LINES * F.col("n_lines"),
        "lengths": (F.col("word_chars") < SHORTEST * words) | (F.col("word_chars") > LONGEST * words),
    }


def host_verdicts(judged: DataFrame) -> DataFrame:
    """``host, n, rate_<rule>, bad, suspect_<soft rule>`` and ``total`` (of all documents) by host. ``judged`` has ``host`` and a boolean by rule."""
    hosts = judged.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(r).cast("long")).alias(f"f_{r}") for r in RULES])
    sums = [F.sum(F.col(f"f_{r}")).alias(f"all_{r}") for r in RULES] + [F.sum(F.col(f"f_{r}") * F.col(f"f_{r}") / F.col("n")).alias(f"sq_{r}") for r in RULES]
    whole = hosts.agg(F.count(F.lit(1)).cast("double").alias("k"), F.sum("n").cast("double").alias("total"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"), *sums)
    prior = [F.col("k"), F.col("total")]
    for r in RULES:
        mean = F.col(f"all_{r}") / F.col("total")
        # sum of n (p - mean)^2, in units of mean (1 - mean); its surplus over k - 1 is due to hosts that differ
        spread = F.try_divide(F.col(f"sq_{r}") - F.col("total") * mean * mean, mean * (1 - mean)) - (F.col("k") - 1)
        rho = F.least(F.greatest(F.coalesce(F.try_divide(spread, F.col("total") - F.col("squares") / F.col("total") - (F.col("k") - 1)), F.lit(0.0)), F.lit(LEAST_SPREAD)), F.lit(0.5))
        prior += [mean.alias(f"mean_{r}"), (1 / rho - 1).alias(f"weight_{r}")]
    both = hosts.crossJoin(whole.select(*prior))
    rate = {r: (F.col(f"f_{r}") + F.col(f"mean_{r}") * F.col(f"weight_{r}")) / (F.col("n") + F.col(f"weight_{r}")) for r in RULES}
    suspect = [((rate[r] >= SUSPECT * F.col(f"mean_{r}")) & (rate[r] >= FLOOR)).alias(f"suspect_{r}") for r in SOFT]
    return both.select("host", "n", "total", *[rate[r].alias(f"rate_{r}") for r in RULES], (rate["base"] >= BAD).alias("bad"), *suspect)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``id, host``, COUNTERS, ``base_failed, host_bad, soft_failed, kept`` of every row."""
    rows = stage(counters(docs, id_col, text_col, host_col))
    judged = rows.select("*", *[c.alias(r) for r, c in failures().items()])
    verdicts = stage(host_verdicts(judged)).withColumn("v", F.struct("bad", *[f"suspect_{r}" for r in SOFT])).select("host", "v", (F.col("n") * HOT >= F.col("total")).alias("hot"))
    hot = verdicts.where("hot").select("host", F.col("v").alias("hot_v"))  # at most HOT rows
    cold = verdicts.where(~F.col("hot")).select(F.col("host").alias("cold_host"), F.lit(0).alias("cold_salt"), F.col("v").alias("cold_v"))
    met = judged.join(F.broadcast(hot), "host", "left")
    # rows of hot hosts have their verdict; they pass the second join in even shares, under keys that meet nothing
    met = met.withColumn("cold_host", F.when(F.col("hot_v").isNull(), F.col("host"))).withColumn("cold_salt", F.when(F.col("hot_v").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.lit(1 << 20)).cast("int")))
    met = met.join(cold.hint("merge"), ["cold_host", "cold_salt"], "left").withColumn("v", F.coalesce("hot_v", "cold_v"))
    soft = F.lit(False)
    for r in SOFT:
        soft = soft | (F.col(r) & F.col(f"v.suspect_{r}"))
    out = met.select("id", "host", *COUNTERS, F.col("base").alias("base_failed"), F.col("v.bad").alias("host_bad"), soft.alias("soft_failed"))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_bad") & ~F.col("soft_failed"))
