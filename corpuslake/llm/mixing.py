"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed for every cell of (source, language, topic). Raking multiplies the cells by one factor
for each source, each language and each topic, in turn, until the fitted marginals meet the targets; a
document is then kept with a probability in proportion to its cell's factors, scaled so that the largest is
1. Kept tokens so have the target marginals in expectation, and no document is repeated.

Only the three small tables of factors change from sweep to sweep; cells and factors stay DataFrames, and
the cells are summed before any shuffle, so a source that holds a third of all rows is one cell more.
A draw is a hash of the document's id: the same documents are kept on every run and partitioning.

Nulls and edge cases: null source, language or topic form a cell value of their own (empty string); null
texts have no tokens and a document without tokens is kept with its cell's probability; targets that name
no present value are ignored; an empty table gives an empty result; rows are judged one by one, so repeated rows
are all kept or all dropped, and all rows without an id share one draw; further columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.common import WORD, stage

AXES = ("source", "lang", "topic")
SWEEPS, TEMPER, SENT_CELLS = 8, 0.9, 100_000


def topic_of(text: Column) -> Column:
    """A coarse topic read off the whole text, for tables that bring none: licensed, tabular, note, article or longform."""
    words = F.regexp_count(text, F.lit(WORD))
    return (
        F.when(F.lower(text).rlike("licen[cs]"), "licensed").when(F.contains(text, F.lit(" | ")), "tabular")
        .when(words < 100, "note").when(words < 1000, "article").otherwise("longform")
    )


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def draw(doc_id: Column) -> Column:
    """Uniform in [0, 1): the first eight hex digits of the id's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def tempered_targets(cells: DataFrame, axis: str, power: float = TEMPER) -> DataFrame:
    """Shares in proportion to tokens ** power: large values give way to small ones. The default targets."""
    sums = cells.groupBy(axis).agg(F.sum("tokens").alias("tokens")).select(axis, F.pow(F.col("tokens").cast("double"), F.lit(power)).alias("share"))
    return sums.crossJoin(F.broadcast(sums.agg(F.sum("share").alias("whole")))).select(axis, (F.col("share") / F.col("whole")).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS, sent_cells: int = SENT_CELLS) -> DataFrame:
    """``source, lang, topic, factor``: cells (with ``tokens``) fitted to ``targets`` (axis, target) by ``sweeps`` rounds over the axes.

    Up to ``sent_cells`` cells (sums, not rows) are raked on the driver; more by joins. Both give the same factors.
    """
    if cells.count() <= sent_cells and all(t.count() <= sent_cells for t in targets.values()):
        return _rake_here(cells, {axis: dict(t.select(axis, "target").collect()) for axis, t in targets.items()}, sweeps)
    whole = cells.agg(F.sum("tokens").cast("double").alias("whole"))
    fitted = stage(cells.crossJoin(F.broadcast(whole)).select(*AXES, (F.col("tokens") / F.col("whole")).alias("share"), F.lit(1.0).alias("factor")))
    for _ in range(sweeps):
        for axis in AXES:
            now = fitted.groupBy(axis).agg(F.sum(F.col("share") * F.col("factor")).alias("now"))
            step = now.join(targets[axis], axis, "left").select(axis, F.when(F.col("now") > 0, F.coalesce(F.col("target"), F.lit(0.0)) / F.col("now")).otherwise(F.lit(1.0)).alias("step"))
            fitted = fitted.join(step, axis).select(*AXES, "share", (F.col("factor") * F.col("step")).alias("factor"))
        fitted = stage(fitted)
    return fitted.select(*AXES, "factor")


def _rake_here(cells: DataFrame, targets: dict[str, dict[str, float]], sweeps: int) -> DataFrame:
    pdf = cells.orderBy(*AXES).toPandas()
    share = pdf["tokens"].astype(float) / max(1.0, float(pdf["tokens"].sum()))
    factor = share * 0 + 1.0
    for _ in range(sweeps):
        for axis in AXES:
            now = (share * factor).groupby(pdf[axis]).transform("sum")
            factor = factor * (pdf[axis].map(targets[axis]).fillna(0.0).astype(float) / now).where(now > 0, 1.0)
    return cells.sparkSession.createDataFrame([(*key, float(f)) for key, f in zip(pdf[list(AXES)].itertuples(index=False), factor, strict=True)], "source string, lang string, topic string, factor double")


def residual(cells: DataFrame, factors: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """``axis, value, target, fitted``: what raking has left between the marginals and their targets."""
    whole = cells.agg(F.sum("tokens").alias("whole"))
    fitted = cells.join(factors, list(AXES)).crossJoin(F.broadcast(whole)).withColumn("share", F.col("tokens") / F.col("whole") * F.col("factor"))
    parts = [fitted.groupBy(a).agg(F.sum("share").alias("fitted")).join(targets[a], a).select(F.lit(a).alias("axis"), F.col(a).alias("value"), "target", "fitted") for a in AXES]
    return reduce(DataFrame.union, parts)


def described(docs: DataFrame, text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None) -> list[Column]:
    """The columns ``source, lang, topic, tokens`` of a document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    topic = F.coalesce(F.col(topic_col), F.lit("")) if topic_col else topic_of(text)
    return [F.coalesce(F.col(source_col), F.lit("")).alias("source"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), topic.alias("topic"), token_count(text).alias("tokens")]


def probabilities(rows: DataFrame, targets: dict[str, DataFrame] | None = None, sweeps: int = SWEEPS, budget: float | None = None) -> DataFrame:
    """``source, lang, topic, factor, probability`` for every cell of ``rows`` (with AXES and ``tokens``).

    Without a budget the largest factor has probability 1. A budget of tokens scales the probabilities so that it is met
    in expectation; a budget beyond what the factors admit gives the same as none, so the marginals always hold.
    """
    cells = stage(rows.groupBy(*AXES).agg(F.sum("tokens").alias("tokens")))
    fitted = rake(cells, {axis: (targets or {}).get(axis) or tempered_targets(cells, axis) for axis in AXES}, sweeps)
    scale = fitted.join(cells, list(AXES)).agg(F.max("factor").alias("top"), F.sum(F.col("factor") * F.col("tokens")).alias("expected"))
    most = F.when(F.col("top") > 0, F.col("factor") / F.col("top")).otherwise(F.lit(1.0))
    least = F.lit(1.0) if budget is None else F.least(F.lit(1.0), F.coalesce(F.try_divide(F.lit(float(budget)) * F.col("top"), F.col("expected")), F.lit(1.0)))
    return fitted.crossJoin(F.broadcast(scale)).select(*AXES, "factor", (most * least).alias("probability"))


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None, sweeps: int = SWEEPS, budget: float | None = None) -> DataFrame:
    """``id, source, lang, topic, tokens, factor, probability, kept`` for every row of ``docs``."""
    rows = stage(docs.select(F.col(id_col).cast("long").alias("id"), *described(docs, text_col, source_col, lang_col, topic_col)))
    return rows.join(probabilities(rows, targets, sweeps, budget), list(AXES)).select("id", *AXES, "tokens", "factor", "probability", (draw(F.col("id")) < F.col("probability")).alias("kept"))


def sample(docs: DataFrame, targets: dict[str, DataFrame] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None, sweeps: int = SWEEPS, budget: float | None = None) -> DataFrame:
    """The rows of ``docs`` that ``mix`` keeps, each judged by itself, so rows of equal or missing ids never stand for one another. Texts aren't shuffled."""
    about = described(docs, text_col, source_col, lang_col, topic_col)
    cells = stage(docs.select(*about))
    whole = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), *about[:3])
    chosen = whole.join(probabilities(cells, targets, sweeps, budget), list(AXES)).where(draw(F.col("id")) < F.col("probability"))
    return chosen.select("row.*")
