"""Numbers and probabilities as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


def to_float(c: Column) -> Column:
    """A number from text; null if it is none. Thousands commas are dropped; Unicode minus and en dash are minus signs."""
    return F.regexp_replace(F.translate(c, "−–", "--"), r"[,\s]", "").try_cast("double")


def to_positive(c: Column) -> Column:
    return F.abs(to_float(c))


def ln(c: Column) -> Column:
    """Natural logarithm with ln(0) = -infinity, which Spark gives as null."""
    c = c.cast("double")
    return F.when(c == 0, F.lit(-INFINITY)).otherwise(F.ln(c))


def log_likelihood_ratio(p_if_same: Column, p_if_different: Column) -> Column:
    return ln(p_if_same) - ln(p_if_different)


def log_odds(p: Column) -> Column:
    return ln(p) - ln(1 - p)


def probability(odds: Column) -> Column:
    return F.when(odds > 0, 1 / (1 + F.exp(-odds))).otherwise(F.exp(odds) / (1 + F.exp(odds)))


def round_significant(c: Column, figures: int) -> Column:
    """To so many significant figures; 0, null and infinities stay."""
    power = F.lit(figures - 1) - F.floor(F.log10(F.abs(c)))
    scale = F.pow(F.lit(10.0), power)
    return F.when(c.isNull() | (c == 0) | (F.abs(c) == INFINITY), c).otherwise(F.round(c * scale) / scale)
