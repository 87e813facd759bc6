"""Decision lists as tables: an ordered list of questions with skip rules, folded once over each case's answers, and the cited lines of an outcome."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Rule(NamedTuple):
    question: str
    outcome: str | None = None  # of a yes; None: a yes only goes on
    skip_if: tuple[str, bool] | None = None  # not asked when this question has this answer


# The questions in their order, what a yes to each means, and what all no means.
FORMULATION = (
    Rule("external_no_claim", "cosmetic"), Rule("food_positioning", "ayurveda_aahar"), Rule("exact_classical", "classical"),
    Rule("classical_ingredients", "patent_proprietary"), Rule("standardised_fraction", "phytopharmaceutical"),
)
OTHERWISE = "new_drug"
# The provisions of each outcome (kind of line, source, locator, checked against its text).
CITES = (
    ("cosmetic", "requires", "in-dc-act-1940", "s.3(aaa)", True), ("cosmetic", "requires", "in-cosmetics-rules-2020", "Rule 3", False),
    ("cosmetic", "posture", "in-trade-marks-act-1999", "s.9", True), ("cosmetic", "posture", "intl-trips", "Art. 39", True),
    ("ayurveda_aahar", "requires", "in-fss-act-2006", "s.22", True), ("ayurveda_aahar", "requires", "in-fssai-ayurveda-aahara-2022", "Reg. 3", True), ("ayurveda_aahar", "requires", "in-fssai-ayurveda-aahara-2022", "Reg. 8", True),
    ("ayurveda_aahar", "posture", "in-trade-marks-act-1999", "s.9", True), ("ayurveda_aahar", "posture", "intl-trips", "Art. 39", True),
    ("classical", "requires", "in-dc-act-1940", "s.3(a)", True), ("classical", "requires", "in-dc-rules-1945", "Rule 158B", False), ("classical", "requires", "in-dc-rules-1945", "Rule 157", True), ("classical", "requires", "in-dc-rules-1945", "Rule 161", True),
    ("classical", "posture", "in-patents-act-1970", "s.3(p)", True), ("classical", "posture", "in-trade-marks-act-1999", "s.9", True),
    ("patent_proprietary", "requires", "in-dc-act-1940", "s.3(h)", True), ("patent_proprietary", "requires", "in-dc-rules-1945", "Rule 158B", False), ("patent_proprietary", "requires", "in-dc-rules-1945", "Rule 157", True),
    ("patent_proprietary", "posture", "in-patents-act-1970", "s.2(1)(j)", True), ("patent_proprietary", "posture", "in-patents-act-1970", "s.3(p)", True), ("patent_proprietary", "posture", "in-trade-marks-act-1999", "s.9", True), ("patent_proprietary", "posture", "intl-trips", "Art. 39", True),
    ("phytopharmaceutical", "requires", "in-ndct-rules-2019", "Rule 2(1)(w)", True), ("phytopharmaceutical", "requires", "in-ndct-rules-2019", "Rule 2", False),
    ("phytopharmaceutical", "posture", "in-patents-act-1970", "s.2(1)(j)", True), ("phytopharmaceutical", "posture", "in-patents-act-1970", "s.3(p)", True), ("phytopharmaceutical", "posture", "in-trade-marks-act-1999", "s.9", True),
    ("new_drug", "requires", "in-ndct-rules-2019", "Rule 2(1)(w)", True), ("new_drug", "requires", "in-ndct-rules-2019", "Rule 2", False),
    ("new_drug", "posture", "in-patents-act-1970", "s.2(1)(j)", True), ("new_drug", "posture", "in-patents-act-1970", "s.3(p)", True), ("new_drug", "posture", "in-trade-marks-act-1999", "s.9", True),
)
STATE = "struct<outcome:string,decided_by:string,next_question:string,asked:int,done:boolean>"


def decided(answers: Column, rules: tuple[Rule, ...] = FORMULATION, otherwise: str = OTHERWISE) -> Column:
    """STATE of a case (``answers``: map of question to boolean): one fold over the rules. The first yes decides, a question without an answer is
    the next to ask, a skipped one counts as neither asked nor answered, all no give ``otherwise``."""
    text = lambda x: F.lit(x).cast("string")
    table = F.array(*[F.struct(F.lit(r.question).alias("question"), text(r.outcome).alias("outcome"), text(r.skip_if and r.skip_if[0]).alias("skip"), F.lit(r.skip_if and r.skip_if[1]).cast("boolean").alias("when")) for r in rules])
    start = F.struct(text(None).alias("outcome"), text(None).alias("decided_by"), text(None).alias("next_question"), F.lit(0).alias("asked"), F.lit(False).alias("done"))
    state = lambda outcome, by, following, asked, done: F.struct(outcome.alias("outcome"), by.alias("decided_by"), following.alias("next_question"), asked.alias("asked"), F.lit(done).alias("done"))

    def step(now: Column, rule: Column) -> Column:
        answer = F.element_at(answers, rule["question"])
        skipped = F.coalesce(F.element_at(answers, rule["skip"]) == rule["when"], F.lit(False))
        go_on = state(text(None), text(None), text(None), now["asked"] + 1, False)
        return F.when(now["done"] | skipped, now).when(answer.isNull(), state(text(None), text(None), rule["question"], now["asked"], True)).when(answer & rule["outcome"].isNotNull(), state(rule["outcome"], rule["question"], text(None), now["asked"] + 1, True)).otherwise(go_on)

    end = lambda s: F.when(s["done"], s).otherwise(state(F.lit(otherwise), F.lit("all answers no"), text(None), s["asked"], True))
    return F.aggregate(table, start, step, end)


def classify(cases: DataFrame, rules: tuple[Rule, ...] = FORMULATION, otherwise: str = OTHERWISE) -> DataFrame:
    """``case_id, outcome, decided_by, next_question, asked`` of cases (case_id, answers). Null answers are none."""
    answers = F.coalesce("answers", F.create_map().cast("map<string,boolean>"))
    return cases.select("case_id", decided(answers, rules, otherwise).alias("s")).select("case_id", "s.outcome", "s.decided_by", "s.next_question", "s.asked")


def cited_lines(spark: SparkSession, cites: tuple[tuple, ...] = CITES) -> DataFrame:
    """``outcome, kind, position, source_id, locator, verified``: the lines of each outcome in order."""
    rows, n = [], {}
    for outcome, kind, source, locator, verified in cites:
        n[outcome, kind] = n.get((outcome, kind), 0) + 1
        rows.append((outcome, kind, n[outcome, kind], source, locator, verified))
    return spark.createDataFrame(rows, "outcome string, kind string, position int, source_id string, locator string, verified boolean")


def requirements(classified: DataFrame, lines: DataFrame) -> DataFrame:
    """One row for each line of each decided case: ``case_id, outcome, kind, position, source_id, locator, verified``."""
    return classified.where("outcome is not null").select("case_id", "outcome").join(lines, "outcome")
