"""Host-level rules on small tables: counters by plain Python, the prior by plain arithmetic, verdicts that take effect, edge cases."""

import re
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuslake.llm import hostrules

DOCS = "doc_id long, text string, lang string, source string, n_chars long, host string, v string, id string"
WORDS = " ".join(f"word{i}" for i in range(60))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", h, 0, "x", "y", "z") for i, t, h in rows], DOCS)


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


@settings(max_examples=25, deadline=None)
@given(texts=st.lists(st.one_of(st.text(alphabet="ab \n#é \t|", max_size=60), st.lists(st.sampled_from("a b c d".split()), max_size=40).map(" ".join)), min_size=1, max_size=12))
def test_counters(spark, texts):
    got = {r["id"]: tuple(r[c] for c in hostrules.COUNTERS) for r in hostrules.counters(frame(spark, [(i, t, "h") for i, t in enumerate(texts)])).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_edge_cases(spark):
    long = " ".join(f"w{i % 40000}" for i in range(90_000))
    rows = [(1, None, None), (2, "", ""), (3, WORDS, "a"), (3, WORDS, "a"), (None, WORDS, "a"), (4, " \n\t ", None), (5, long, "b"), (6, "x" * 100_000, "b"), (7, "a a a a", "b")]
    got = sorted((r["id"] or -1, r["n_words"], r["n_repeat_words"], r["base_failed"], r["kept"]) for r in hostrules.judge(frame(spark, rows)).collect())
    assert got == [(-1, 60, 0, False, True), (1, 0, 0, True, False), (2, 0, 0, True, False), (3, 60, 0, False, True), (3, 60, 0, False, True), (4, 0, 0, True, False), (5, 90_000, plain(long)[4], True, False), (6, 1, 0, True, False), (7, 4, 4, True, False)]
    assert hostrules.judge(frame(spark, [])).count() == 0


def test_verdicts_of_hosts(spark):
    good, odd, short = WORDS, WORDS.replace("word", "#word", 30), "too short"
    rows = [(f"h{h}", good) for h in range(30) for _ in range(20)] + [(f"h{h}", odd) for h in range(30)]
    rows += [("farm", short)] * 90 + [("farm", good)] * 10  # most fail: its ten good documents go too
    rows += [("shop", odd)] * 30 + [("shop", good)] * 30  # suspect by its symbols: only documents that fail this rule go
    rows += [("new", short)]  # one failure is too little to condemn
    rows += [("new", good)]
    judged = hostrules.judge(frame(spark, [(i, t, h) for i, (h, t) in enumerate(rows)])).select("id", "host", "kept", "host_bad", "soft_failed").collect()
    kept = Counter((r["host"], rows[r["id"]][1] == good) for r in judged if r["kept"])
    assert kept[("farm", True)] == 0 and kept[("new", True)] == 1 and kept[("shop", True)] == 30 and kept[("shop", False)] == 0
    assert all(kept[(f"h{h}", True)] == 20 and kept[(f"h{h}", False)] == 1 for h in range(30))
    assert {r["host"] for r in judged if r["host_bad"]} == {"farm"} and {r["host"] for r in judged if r["soft_failed"]} == {"shop"}


def test_rates_shrink_to_the_prior_by_moments(spark):
    sizes = {"a": (100, 30), "b": (50, 5), "c": (10, 9), "d": (2, 0), "e": (400, 60)}
    rows = [(h, i < f, False, False, False) for h, (n, f) in sizes.items() for i in range(n)]
    got = {r["host"]: r["rate_base"] for r in hostrules.host_verdicts(spark.createDataFrame(rows, "host string, base boolean, symbols boolean, lines boolean, lengths boolean")).collect()}
    total, k = sum(n for n, _ in sizes.values()), len(sizes)
    mean = sum(f for _, f in sizes.values()) / total
    scatter = sum(n * (f / n - mean) ** 2 for n, f in sizes.values()) / (mean * (1 - mean))
    rho = (scatter - (k - 1)) / (total - sum(n * n for n, _ in sizes.values()) / total - (k - 1))
    weight = 1 / rho - 1
    assert all(abs(got[h] - (f + weight * mean) / (n + weight)) < 1e-9 for h, (n, f) in sizes.items())
    assert mean < got["c"] < 0.9 and 0 < got["d"] < mean


def test_hot_and_many_small_hosts(spark):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit(WORDS).alias("text"), F.when(F.col("id") < 2000, "hot").otherwise(F.concat(F.lit("h"), F.col("id").cast("string"))).alias("source"))
    judged = hostrules.judge(rows)
    assert judged.where("kept").count() == 6000 and judged.select("id").distinct().count() == 6000
    counts = defaultdict(int, {r["host"]: r["count"] for r in judged.groupBy("host").count().collect()})
    assert counts["hot"] == 2000 and len(counts) == 4001


def test_main_path_is_native(spark):
    plan = hostrules.judge(frame(spark, [(1, WORDS, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
