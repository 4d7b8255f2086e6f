"""Patterns that find identifying values in texts (third-party ``regex`` syntax, verbose; and Java's for constant ones)."""

from __future__ import annotations

import datetime

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from carrel.functions.dates import MONTHS
from carrel.functions.strings import escape, first_letters

FLAGS = regex.IGNORECASE | regex.VERBOSE | regex.UNICODE | regex.MULTILINE
FULL_MONTHS = "January February March April May June July August September October November December".split()
#: An e-mail address, a UK postcode.
EMAIL = r"[a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)+"
POSTCODE = r"[A-Z]{1,2}[0-9][A-Z0-9]?\s*[0-9][A-Z]{2}"
ORDINAL = r"(?:st|nd|rd|th)?"


def _edges(pattern: str, words: bool, digits: bool = False) -> str:
    if words:
        return rf"\b(?:{pattern})\b"
    return rf"(?<!\d)(?:{pattern})(?!\d)" if digits else pattern


def date(value: datetime.date, at_words: bool = True) -> str:
    """One date in day-month-year, month-day-year and year-month-day order, months as numbers or three letters and more."""
    name = FULL_MONTHS[value.month - 1]
    day = rf"0?{value.day}{ORDINAL}"
    month = rf"(?:0?{value.month}|{first_letters(name, 3)})"
    year = rf"(?:{value.year // 100:02d})?{value.year % 100:02d}"
    gap = r"\W*"
    orders = (day, month, year), (month, day, year), (year, month, day)
    return _edges("|".join(gap.join(o) for o in orders), at_words)


def any_date(at_words: bool = True) -> str:
    """Any date with separators, or as YYYYMMDD; groups day, month and year serve blurring."""
    month = "(?P<month>0?[1-9]|1[0-2]|" + "|".join(first_letters(m, 3) for m in FULL_MONTHS) + ")"
    day = rf"(?P<day>0?[1-9]|[12]\d|3[01]){ORDINAL}"
    year = r"(?P<year>\d{4}|\d{2})"
    gap = r"[^\w\r\n:]+"
    iso = r"(?P<year>\d{4})(?P<month>0[1-9]|1[0-2])(?P<day>0[1-9]|[12]\d|3[01])"
    return _edges("|".join((day + gap + month + gap + year, month + gap + day + gap + year, year + gap + month + gap + day, iso)), at_words)


def code(value: str, at_words: bool = True, at_digits: bool = False) -> str:
    """A code's letters and digits with anything but word characters between them."""
    return _edges(r"\W*".join(escape(ch) for ch in str(value) if ch.isalnum()), at_words, at_digits)


def number(value, at_words: bool = False, at_digits: bool = True) -> str:
    """The digits of a number, likewise."""
    return code("".join(ch for ch in str(value) if ch.isdigit()), at_words, at_digits)


def n_digits(n: int, at_words: bool = False) -> str:
    """Any number of ``n`` digits, blanks and tabs between them allowed."""
    return _edges(r"[\ \t]*".join([r"\d"] * n), at_words, True)


def postcode(at_words: bool = True) -> str:
    return _edges(POSTCODE.replace(r"\s*", r"\s*"), at_words)


def words(value: str, suffixes: tuple[str, ...] = (), typos: int = 0, least_for_typos: int = 3, at_words: bool = True) -> str:
    """A word, perhaps with a suffix, with up to so many typos if it is long enough."""
    end = "(?:" + "|".join(map(escape, suffixes)) + ")?" if suffixes else ""
    body = rf"(?:{escape(value)}){{e<={typos}}}" if typos and len(value) >= least_for_typos else escape(value)
    return _edges(body + end, at_words)


def phrase(value: str, alternatives: list[list[str]] = (), typos: int = 0, at_words: bool = True) -> str:
    """The words of a phrase with anything but word characters between them; a word may be any of its alternatives."""
    parts = []
    for w in value.split():
        group = next((g for g in alternatives if any(w.lower() == a.lower() for a in g)), None)
        if group:
            parts.append("(?:" + "|".join(escape(a) for a in sorted(set(group), key=lambda a: (-len(a), a))) + ")")
        else:
            body = escape(w)
            parts.append(rf"(?:{body}){{e<={typos}}}" if typos else body)
    return _edges(r"\W+".join(parts), at_words)


def email(at_words: bool = True) -> str:
    return _edges(EMAIL.replace("#", r"\#"), False)


def compiled(patterns: list[str]):
    """One pattern of all, or None of none."""
    unique = list(dict.fromkeys(p for p in patterns if p))
    return regex.compile("|".join(unique), FLAGS) if unique else None


def month_names() -> list[str]:
    return list(MONTHS)


def found(text: Column, patterns: list[str]) -> Column:
    """What the first match of any of the patterns is in a text column, null if there is none; worked out in Arrow batches."""
    patterns = list(patterns)

    @F.pandas_udf("string")
    def first(texts: pd.Series) -> pd.Series:
        pattern = compiled(patterns)
        return pd.Series([None if t is None or (m := pattern.search(t)) is None else m[0] for t in texts], dtype=object)

    return first(text)
