"""Columns over catalogue profiles: tastes, potency, after-taste, humours, and the legal facts worth a flag."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tastes and humours in their order, and the flags with their labels.
TASTES = ("Madhura", "Amla", "Lavana", "Katu", "Tikta", "Kashaya")
HUMOURS = ("Vata", "Pitta", "Kapha")
FLAGS = {
    "scheduleE1": "Schedule E(1)", "wildlife": "Wildlife schedule", "cites": "CITES listed", "exportRestricted": "Export restricted",
    "deposit": "Deposit route", "bioResource": "Biological resource", "notBioResource": "Not a biological resource",
}


def taste_profile(listed: Column) -> Column:
    """A weight for each taste: 1 for the first listed or a dominant one, 0.22 less for each place after, 0.45 at least; 0 if it isn't listed. An array in the order of TASTES."""
    weight = lambda t: F.filter(F.transform(listed, lambda x, i: F.when(F.contains(x, F.lit(t)), F.when(x.rlike("(?i)dominant"), 1.0).otherwise(F.greatest(F.lit(0.45), 1 - 0.22 * i)))), lambda w: w.isNotNull())
    return F.array(*[F.coalesce(F.get(weight(t), F.lit(0)), F.lit(0.0)) for t in TASTES])


def potency(text: Column) -> Column:
    return F.when(text.rlike("(?i)ushna|heating"), "heating").otherwise("cooling")


def potency_scale(text: Column, qualities: Column) -> Column:
    """-1 (cooling) to 1 (heating): the class, moved by the qualities."""
    low = F.lower(F.array_join(qualities, " "))
    moves = (("tikshna|sharp", 0.22), ("laghu|light", 0.08), ("guru|heavy", -0.08), ("snigdha|unctuous|oily", -0.12))
    nudge = sum((F.when(low.rlike(p), F.lit(v)).otherwise(0.0) for p, v in moves), F.lit(0.0))
    hot = potency(text) == "heating"
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.when(hot, 0.62 + nudge).otherwise(-0.62 - nudge)))


def after_taste(text: Column) -> Column:
    return F.coalesce(*[F.when(F.contains(text, F.lit(t)), t) for t in TASTES], F.lit(TASTES[0]))


def humour_profile(text: Column) -> Column:
    """-1 (pacifies), 0 or 1 (aggravates) for each humour, in the order of HUMOURS. Clauses are read in turn, a later one has the last word."""
    none = F.array(*[F.lit(0) for _ in HUMOURS])

    def read(state: Column, clause: Column) -> Column:
        worse, better = clause.rlike("(?i)aggravat|increase"), clause.rlike("(?i)pacif|balanc|calm|reduce")
        effect = F.when(worse, 1).otherwise(-1)
        each = F.array(*[F.when(F.contains(clause, F.lit(h)), effect).otherwise(F.get(state, F.lit(i))) for i, h in enumerate(HUMOURS)])
        return F.when(~worse & ~better, state).when(clause.rlike("(?i)all three|tridosha") & ~worse, F.array(*[F.lit(-1) for _ in HUMOURS])).otherwise(each)

    return F.aggregate(F.split(text, "[;,]"), none, read)


def legal_flags(profile: Column) -> Column:
    """Flags (key, label, cite) of a profile, raised only where it says true or false; null is unknown and raises none."""
    p = lambda path: profile[path.split(".")[0]] if "." not in path else profile[path.split(".")[0]][path.split(".")[1]]
    cite = lambda cites: F.coalesce(F.get(cites, F.lit(0)), F.lit("unknown"))
    schedule = p("wildlife.schedule")
    named = schedule.isNotNull() & (schedule != "") & (schedule != "unknown") & (F.size(p("wildlife.cites")) > 0) & ~schedule.rlike(r"(?i)^not\b")
    bio = p("biodiversity.resource")
    raised = {
        "scheduleE1": (p("schedules.e1"), p("schedules.cite")), "wildlife": (named, cite(p("wildlife.cites"))), "cites": (p("wildlife.cites_listed"), cite(p("wildlife.cites"))),
        "exportRestricted": (p("export.restricted"), p("export.cite")), "deposit": (p("deposit.budapest"), p("deposit.cite")), "bioResource": (bio, cite(p("biodiversity.cites"))), "notBioResource": (~bio, cite(p("biodiversity.cites"))),
    }
    return F.array_compact(F.array(*[F.when(when, F.struct(F.lit(k).alias("key"), F.lit(FLAGS[k]).alias("label"), c.alias("cite"))) for k, (when, c) in raised.items()]))
