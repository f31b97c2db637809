"""Scores and levels of the domain as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """The nearest whole number, halves up."""
    return F.floor(x + 0.5).cast("long")


def confidence(n: Column) -> Column:
    return F.when(F.coalesce(n, F.lit(0)) == 0, "none").when(n < 3, "low").when(n < 10, "medium").otherwise("high")


def blended(level: Column, crowd: Column, woz: Column) -> Column:
    """The market value from the crowd's estimate and the tax value, by confidence; null where both are missing."""
    known = F.coalesce(woz, F.lit(0)) > 0
    value = (
        F.when(level == "none", F.coalesce(woz, F.lit(0)))
        .when(~known, crowd)
        .when(level == "low", half_up(woz * 0.7 + crowd * 0.3))
        .when(level == "medium", half_up(woz * 0.3 + crowd * 0.7))
        .otherwise(crowd)
    )
    return F.nullif(value, F.lit(0)).cast("long")


def divergence(value: Column, asking: Column) -> Column:
    """Percent that the value is above the asking price, two digits."""
    return F.when((value > 0) & (asking > 0), F.floor((value - asking) / asking * 10000 + 0.5) / 100.0)


def accuracy_points(deviation: Column) -> Column:
    return F.when(deviation <= 0.05, 10).when(deviation <= 0.10, 5).when(deviation <= 0.20, 2).when(deviation <= 0.50, 0).otherwise(-3)


def rank(karma: Column) -> Column:
    """The name of a user's standing (fixed values)."""
    out = F.lit("Nieuwkomer")
    for least, name in ((10, "Bewoner"), (50, "Kenner"), (100, "Specialist"), (200, "Meester"), (500, "Legende")):
        out = F.when(karma >= least, name).otherwise(out)
    return out


RANK_SQL = "CASE WHEN {k} >= 500 THEN 'Legende' WHEN {k} >= 200 THEN 'Meester' WHEN {k} >= 100 THEN 'Specialist' WHEN {k} >= 50 THEN 'Kenner' WHEN {k} >= 10 THEN 'Bewoner' ELSE 'Nieuwkomer' END"


def detail_level(views: Column, comments: Column, guesses: Column) -> Column:
    """How lively a property is, from the views of a week and all comments and guesses."""
    return F.when((views > 50) | (comments > 10) | (guesses > 5), "hot").when((views > 10) | (comments > 3) | (guesses > 1), "warm").otherwise("cold")


def feed_level(score: Column, last: Column, as_of: Column) -> Column:
    """How lively a property is in a feed, from its trending score and its last activity."""
    return F.when(score >= 5, "hot").when((score > 0) | (last >= as_of - F.expr("INTERVAL 30 DAYS")), "warm").otherwise("cold")


def recency_bonus(created: Column, as_of: Column) -> Column:
    return F.when(created > as_of - F.expr("INTERVAL 1 HOUR"), 10).when(created > as_of - F.expr("INTERVAL 24 HOURS"), 5).when(created > as_of - F.expr("INTERVAL 7 DAYS"), 2).otherwise(0)


def guess_outcome(guess: Column, sold: Column) -> Column:
    """How close a guess came to the price at sale."""
    off = F.abs(guess - sold) / F.nullif(sold, F.lit(0))
    return F.when(sold.isNull(), "pending").when(off <= 0.05, "accurate").when(off <= 0.20, "close").otherwise("inaccurate")


def is_meme(guess: Column, woz: Column) -> Column:
    """A guess far out of range of the tax value; never so without one."""
    return F.coalesce((woz > 0) & ((guess / woz < 0.2) | (guess / woz > 5.0)), F.lit(False))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
