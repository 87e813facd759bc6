"""Chat formatting into budgeted, turn-aligned windows. DataFrame functions only.

A turn costs its tokens (counted natively: one for each character of scripts that are written without blanks, one
for every eight other characters of a word or less) and a fixed overhead. What the budget leaves beside the
conversation's leading system turn is its room; up to HISTORY of it, a quarter at most, is for repeated turns. Prefix sums
over the other turns deal them into spans of half of the rest, so a window (system turn, history, own turns) stays
within BUDGET unless one turn is longer than a span. A window has the leading system turn, then as many of the
latest turns of the span before as the history admits, then the span's own turns. Repeated turns are masked: each
assistant text is a target in exactly one window.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts ``&`` becomes ``&a;``, ``<|`` becomes
``&l;|`` and, in roles, a line feed becomes ``&n;``; so no text can hold a control string, and undoing the
three in reverse order gives back any text.

Nulls and edge cases: null roles and texts are empty; a null conversation id is a conversation of its own;
turns with equal numbers are ordered by role, then text; repeated rows are repeated turns; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET, HISTORY, OVERHEAD = 512, 128, 4
# Scripts that are written without blanks.
UNSPACED = ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar", "Tibetan")
START, STOP = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&a;")), F.lit("<|"), F.lit("&l;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&l;"), F.lit("<")), F.lit("&a;"), F.lit("&"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&n;"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&n;"), F.lit("\n")))


def token_count(text: Column) -> Column:
    scripts = "".join(rf"\p{{Is{x}}}" for x in UNSPACED)
    return F.regexp_count(text, F.lit(rf"[{scripts}]|[^\x20\x09-\x0D{scripts}]{{1,8}}"))


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """``conv_id, window_no, n_repeated, formatted, loss_spans array<struct<start, length>>`` (code points, from 0)."""
    base = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    sized = base.withColumn("n", token_count(F.col("text")) + OVERHEAD).withColumn("k", F.row_number().over(order))
    sized = sized.withColumn("lead", (F.col("k") == 1) & (F.col("role") == "system"))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    room = F.lit(budget) - F.coalesce(F.first(F.when(F.col("lead"), F.col("n"))).over(so_far), F.lit(0))
    repeat = F.greatest(F.least(F.lit(history), F.floor(room / 4)), F.lit(0)).cast("long")
    sized = sized.withColumn("repeat", repeat).withColumn("span", F.greatest(F.floor((room - F.col("repeat")) / 2), F.lit(1)).cast("long"))
    ends = F.sum(F.when(F.col("lead"), 0).otherwise(F.col("n"))).over(so_far)
    sized = sized.withColumn("ends", ends).withColumn("window_no", F.floor(F.greatest(F.col("ends") - 1, F.lit(0)) / F.col("span")).cast("long"))
    sized = sized.withColumn("window_no", F.coalesce(F.when(F.col("lead"), F.lead("window_no").over(order)), "window_no"))
    head, body = F.concat(F.lit(START), _escape_role(F.col("role")), F.lit("\n")), escape(F.col("text"))
    cut = sized.select(
        "conv_id", "window_no", "repeat", "k", "lead", (F.col("ends") - F.when(F.col("lead"), 0).otherwise(F.col("n"))).alias("begins"), (F.col("role") == "assistant").alias("target"),
        F.char_length(head).alias("skip"), F.char_length(body).alias("size"), F.concat(head, body, F.lit(STOP)).alias("piece"),
    )
    spans = cut.groupBy("conv_id", "window_no").agg(F.array_sort(F.collect_list(F.struct("k", "begins", "target", "skip", "size", "piece", "lead"))).alias("own"), F.max("repeat").alias("repeat"))
    before = Window.partitionBy("conv_id").orderBy("window_no")
    first = F.first("own").over(before.rowsBetween(Window.unboundedPreceding, 0))
    spans = spans.select("conv_id", "window_no", "own", "repeat", F.coalesce(F.lag("own").over(before), F.array().cast(spans.schema["own"].dataType)).alias("last"), first[0].alias("opening"), F.row_number().over(before).alias("nth"))
    tail = F.filter("last", lambda x: ~x["lead"] & (F.col("own")[0]["begins"] - x["begins"] <= F.col("repeat")))
    opening = F.when((F.col("nth") > 1) & F.col("opening")["lead"], F.array("opening")).otherwise(F.array().cast(spans.schema["own"].dataType))
    laid = spans.select("conv_id", "window_no", F.concat(opening, tail).alias("again"), "own")
    laid = laid.select("conv_id", "window_no", F.size("again").alias("n_repeated"), F.concat("again", "own").alias("all"))
    # A window has at most budget / OVERHEAD turns of its own, so the quadratic offset sum stays small.
    placed = F.transform("all", lambda x, i: F.struct((F.aggregate(F.slice("all", F.lit(1), i), F.lit(0), lambda s, y: s + F.char_length(y["piece"])) + x["skip"]).alias("start"), x["size"].alias("length"), ((i >= F.col("n_repeated")) & x["target"]).alias("loss")))
    return laid.select(
        "conv_id", "window_no", "n_repeated", F.array_join(F.transform("all", lambda x: x["piece"]), "").alias("formatted"),
        F.transform(F.filter(placed, lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns and targets of each conversation, parsed from ``windows``' output alone: ``conv_id, n_turns, turns, loss, formatted_chars``."""
    pieces = F.filter(F.split("formatted", r"<\|im_start\|>"), lambda p: p != "")
    own = F.slice(pieces, F.col("n_repeated") + 1, F.greatest(F.size(pieces) - F.col("n_repeated"), F.lit(0)))
    role = lambda p: F.substring_index(p, "\n", 1)
    text = lambda p: F.substring(p, F.char_length(role(p)) + 2, F.char_length(p) - F.char_length(role(p)) - 1 - len(STOP))
    parsed = F.array_join(F.transform(own, lambda p: F.concat(_unescape_role(role(p)), F.lit("\n"), unescape(text(p)), F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    per = formatted.select("conv_id", F.size(own).alias("n"), F.struct("window_no", parsed.alias("turns"), loss.alias("loss")).alias("w"), F.char_length("formatted").alias("chars"))
    whole = per.groupBy("conv_id").agg(F.sum("n").cast("long").alias("n_turns"), F.array_sort(F.collect_list("w")).alias("w"), F.sum("chars").cast("long").alias("formatted_chars"))
    join = lambda part: F.array_join(F.transform("w", lambda x: x[part]), "")
    return whole.select("conv_id", "n_turns", join("turns").alias("turns"), join("loss").alias("loss"), "formatted_chars")
