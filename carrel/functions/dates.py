"""Dates as Catalyst expressions, and the blurring of dates found in texts."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a blurred date may show.
BLUR_PARTS = frozenset(("%b", "%B", "%m", "%Y", "%y"))
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def first_of_month(c: Column) -> Column:
    """The month's first day; what is no date gives null."""
    return F.trunc(c.try_cast("date"), "MM")


def is_iso_date(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^\d{4}-\d{2}-\d{2}$") & c.try_cast("date").isNotNull(), F.lit(False))


def blurred_keys(c: Column) -> dict[str, Column]:
    """The three ways to leave out one part of a date of birth."""
    return {"md": F.date_format(c, "MM-dd"), "yd": F.date_format(c, "yyyy-dd"), "ym": F.date_format(c, "yyyy-MM")}


def age(born: Column, at: Column) -> Column:
    """Completed years."""
    return (F.year(at) - F.year(born) - F.when(F.date_format(at, "MMdd") < F.date_format(born, "MMdd"), 1).otherwise(0)).cast("int")


def check_blur(pattern: str) -> None:
    left = pattern
    for part in BLUR_PARTS:
        left = left.replace(part, "")
    if "%" in left:
        raise ValueError(f"a blurred date may show month and year only: {pattern!r}")


def full_year(text: str) -> int:
    """Two-digit years 00 to 68 are of this century, 69 to 99 of the last."""
    y = int(text)
    return y if len(text) > 2 else 2000 + y if y <= 68 else 1900 + y


def month_number(text: str) -> int | None:
    return int(text) if text.isdigit() else next((i + 1 for i, m in enumerate(MONTHS) if text.lower().startswith(m)), None)


def blurred(day: str, month: str, year: str, pattern: str) -> str | None:
    """The date as ``pattern`` says, or None if there is no such date."""
    try:
        return datetime.date(full_year(year), month_number(month) or 0, int(day)).strftime(pattern)
    except ValueError:
        return None
