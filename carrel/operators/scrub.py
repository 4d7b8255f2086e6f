"""Removing identifying details from free text.

The nonspecific scrubber uses patterns that are the same for every row; where they are simple it is one ``regexp_replace`` in the JVM.
The personal scrubber's patterns differ by patient: the values to be removed are grouped by patient into one row, joined to
the notes, and applied in Arrow batches, a patient's pattern compiled once per batch.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carrel.functions.dates import blurred, check_blur
from carrel.functions.hashing import hmac
from carrel.operators import patterns as rx

#: What replaces details of the patient, of third parties, and details of no one in particular.
PATIENT, THIRD_PARTY, NONSPECIFIC = "[__PPP__]", "[__TTT__]", "[~~~]"
WORDS, PHRASE, PHRASE_UNLESS_NUMERIC, NUMBER, CODE, DATE = "words", "phrase", "phrase_unless_numeric", "number", "code", "date"
METHODS = (WORDS, PHRASE, PHRASE_UNLESS_NUMERIC, NUMBER, CODE, DATE)


def default_method(data_type: T.DataType, length: int | None = None) -> str:
    """How values of a column are looked for, if nothing is said: dates as dates, texts as words, the rest as numbers."""
    if isinstance(data_type, T.DateType | T.TimestampType):
        return DATE
    if isinstance(data_type, T.StringType) and (length is None or length > 1):
        return WORDS
    return NUMBER


class WordList:
    """Whole words or phrases, in any case; the longest that fits is replaced. Word characters are letters, digits and _."""

    def __init__(self, words, suffixes=(), replacement: str = NONSPECIFIC, typos: int = 0, flexible: bool = False):
        self.replacement = replacement
        self.words = frozenset(w.strip().lower() + s for w in words if w.strip() for s in ("", *suffixes))
        self.pattern = rx.compiled([rx.phrase(w, typos=typos) for w in sorted(self.words)]) if flexible or typos else None
        self.longest = max((w.count(" ") + 1 for w in self.words), default=0)
        self.starts: dict[str, list[str]] = {}
        for w in sorted(self.words, key=lambda w: (-len(w), w)):
            self.starts.setdefault(regex.match(r"\w*", w)[0], []).append(w)

    def __contains__(self, word: str) -> bool:
        return word.lower() in self.words

    def scrub(self, text: str) -> str:
        if self.pattern:
            return self.pattern.sub(self.replacement, text)
        out, at, low = [], 0, text.lower()
        if len(low) != len(text):
            low = "".join(ch.lower() if len(ch.lower()) == 1 else ch for ch in text)
        for m in regex.finditer(r"\w+", low):
            if m.start() < at:
                continue
            for w in self.starts.get(m[0], ()):
                end = m.start() + len(w)
                if low.startswith(w, m.start()) and not (end < len(low) and regex.match(r"\w", low[end]) and regex.match(r"\w", low[end - 1])):
                    out += [text[at : m.start()], self.replacement]
                    at = end
                    break
        return "".join(out) + text[at:]


@dataclass(frozen=True)
class Nonspecific:
    """Details that any text may hold. All patterns are one alternation, so what one has replaced no other sees."""

    replacement: str = NONSPECIFIC
    date_replacement: str | None = None
    postcodes: bool = False
    digits: tuple[int, ...] = ()
    dates: bool = False
    emails: bool = False
    extra: tuple[str, ...] = ()
    denylist: tuple[str, ...] = ()
    allow: tuple[str, ...] = ()

    def __post_init__(self):
        if self.date_replacement and "%" in self.date_replacement:
            check_blur(self.date_replacement)

    def pattern(self):
        parts = [rx.email()] if self.emails else []
        parts += [f"(?P<date>{rx.any_date()})"] if self.dates else []
        parts += [rx.postcode()] if self.postcodes else []
        parts += [rx.n_digits(n) for n in self.digits] + list(self.extra)
        return rx.compiled(parts)

    def scrub(self, text: str) -> str:
        if self.denylist:
            text = _word_list(self.denylist, self.replacement).scrub(text)
        pattern = _nonspecific_pattern(self)
        if pattern is None:
            return text

        def put(m) -> str:
            if self.dates and m["date"]:
                if not self.date_replacement:
                    return self.replacement
                if "%" in self.date_replacement:
                    return blurred(m["day"], m["month"], m["year"], self.date_replacement) or self.replacement
                return self.date_replacement
            return self.replacement

        return pattern.sub(put, text)

    def column(self, text: Column) -> Column:
        """The same in the JVM, where no dates, word lists or extra patterns are asked for."""
        if self.dates or self.denylist or self.extra:
            raise ValueError("needs the Python path")
        parts = [rx.EMAIL] if self.emails else []
        parts += [rf"\b{rx.POSTCODE}\b"] if self.postcodes else []
        parts += [r"(?<!\d)" + r"[ \t]*".join([r"\d"] * n) + r"(?!\d)" for n in self.digits]
        return F.regexp_replace(text, "(?iU)" + "|".join(parts), self.replacement.replace("\\", "\\\\").replace("$", "\\$")) if parts else text

    def settings(self) -> str:
        return json.dumps({k: getattr(self, k) for k in sorted(self.__dataclass_fields__)}, sort_keys=True)


@lru_cache(maxsize=64)
def _nonspecific_pattern(n: Nonspecific):
    return n.pattern()


@lru_cache(maxsize=64)
def _word_list(words: tuple[str, ...], replacement: str) -> WordList:
    return WordList(words, replacement=replacement)


@dataclass(frozen=True)
class Options:
    """Settings of the personal scrubber; defaults as the data model states them."""

    patient: str = PATIENT
    third_party: str = THIRD_PARTY
    least: int = 2
    typos: int = 0
    least_for_typos: int = 3
    suffixes: tuple[str, ...] = ()
    words_at_edges: bool = True
    codes_at_edges: bool = True
    dates_at_edges: bool = True
    numbers_at_edges: bool = False
    numbers_at_digits: bool = True
    alternatives: tuple[tuple[str, ...], ...] = ()
    allow: frozenset[str] = field(default_factory=frozenset)
    nonspecific: Nonspecific | None = None
    nonspecific_first: bool = False


def elements(value, method: str, o: Options) -> list[str]:
    """Patterns for one value to be removed; none if it is null, too short or allowed."""
    if value is None or (text := str(value).strip()) == "":
        return []
    if method == DATE:
        try:
            day = value if isinstance(value, datetime.date) else datetime.date.fromisoformat(text[:10])
        except ValueError:
            return []
        return [rx.date(day, o.dates_at_edges)]
    if method == PHRASE_UNLESS_NUMERIC:
        method = NUMBER if text.isdigit() else PHRASE
    if method in (NUMBER, CODE):
        kept = [ch for ch in text if (ch.isdigit() if method == NUMBER else ch.isalnum())]
        if len(kept) < o.least:
            return []
        return [rx.number(text, o.numbers_at_edges, o.numbers_at_digits) if method == NUMBER else rx.code(text, o.codes_at_edges)]
    if method == PHRASE:
        return [rx.phrase(text, [list(a) for a in o.alternatives], o.typos, o.words_at_edges)] if len(text) >= o.least and text.lower() not in o.allow else []
    parts = [p for p in regex.split(r"\W+", text) if len(p) >= o.least and p.lower() not in o.allow]
    return [rx.words(p, o.suffixes, o.typos, o.least_for_typos, o.words_at_edges) for p in parts]


def needle(value, method: str, o: Options) -> list[tuple[str, str]]:
    """For each pattern of ``elements``: a text that a note must hold for the pattern to match, and which form of the note must hold it."""
    text = str(value).strip().lower()
    if method == PHRASE_UNLESS_NUMERIC:
        method = NUMBER if text.isdigit() else PHRASE
    if not text.isascii() or (o.typos and method in (PHRASE, WORDS)) or (o.alternatives and method == PHRASE):
        return [("any", "")] * len(elements(value, method, o))
    if method == DATE:
        return [("digits", text[2:4])]
    if method == NUMBER:
        return [("digits", "".join(ch for ch in text if ch.isdigit()))]
    if method == CODE:
        return [("letters", "".join(ch for ch in text if ch.isalnum()))]
    if method == PHRASE:
        return [("text", text.split()[0])]
    return [("text", p) for p in regex.split(r"\W+", text) if len(p) >= o.least and p not in o.allow]


class Personal:
    """Scrubber of one patient, from (kind, method, value): kind ``patient`` or ``third_party``.

    A note is searched for those values alone whose needle it holds, so most notes of most patients need no pattern at all.
    """

    def __init__(self, values: list[tuple[str, str, object]], options: Options):
        self.o = options
        by_kind: dict[str, dict[str, tuple[str, str]]] = {"patient": {}, "third_party": {}}
        for kind, method, value in values:
            if patterns := elements(value, method, options):
                by_kind[kind].update(zip(patterns, needle(value, method, options), strict=True))
        # Longer patterns first, so that a whole name goes before its parts.
        self.patterns = {k: sorted(v.items(), key=lambda p: (-len(p[0]), p[0])) for k, v in by_kind.items()}

    def scrub(self, text: str | None) -> str | None:
        if text is None:
            return None
        if self.o.nonspecific and self.o.nonspecific_first:
            text = self.o.nonspecific.scrub(text)
        for kind, mark in (("patient", self.o.patient), ("third_party", self.o.third_party)):
            forms = _forms(text)
            held = tuple(p for p, (form, n) in self.patterns[kind] if forms is None or n in forms[form])
            if held:
                text = _held_pattern(held).sub(mark, text)
        if self.o.nonspecific and not self.o.nonspecific_first:
            text = self.o.nonspecific.scrub(text)
        return text


_ALL = bytes(range(256))
_DIGITS = b"0123456789"
_LETTERS = _DIGITS + b"abcdefghijklmnopqrstuvwxyz"


def _forms(text: str) -> dict[str, str] | None:
    """A note in lower case, its digits, and its letters and digits; None beyond ASCII, where case is not that simple."""
    if not text.isascii():
        return None
    low = text.lower().encode()
    keep = lambda kept: low.translate(None, _ALL.translate(None, kept)).decode()
    return {"any": "", "text": low.decode(), "digits": keep(_DIGITS), "letters": keep(_LETTERS)}


@lru_cache(maxsize=4096)
def _held_pattern(patterns: tuple[str, ...]):
    return rx.compiled(list(patterns))


def scrub_source(df: DataFrame, pid: str, columns: dict[str, str], kind: str = "patient") -> DataFrame:
    """pid, kind, method, value of the columns to be removed; ``columns`` maps names to methods."""
    rows = [F.struct(F.lit(kind).alias("kind"), F.lit(m).alias("method"), F.col(c).cast("string").alias("value")) for c, m in columns.items()]
    return df.select(F.col(pid).alias("pid"), F.explode(F.array(*rows)).alias("x")).select("pid", "x.*").where("value IS NOT NULL AND trim(value) <> ''").distinct()


def patient_values(sources: DataFrame) -> DataFrame:
    """One row per patient with its distinct values in order; bounded by what is known of one person."""
    return sources.groupBy("pid").agg(F.array_sort(F.collect_set(F.struct("kind", "method", "value"))).alias("scrub_values"))


def scrubber_hash(values: DataFrame, options: Options, key: str) -> DataFrame:
    """pid and scrubber_hash: changes when a value or a setting does."""
    settings = json.dumps({k: sorted(v) if isinstance(v, frozenset) else v.settings() if isinstance(v, Nonspecific) else v for k, v in options.__dict__.items()}, sort_keys=True, default=str)
    return values.select("pid", hmac(F.concat(F.lit(settings), F.to_json("scrub_values")), key).alias("scrubber_hash"))


def scrub_notes(notes: DataFrame, pid: str, texts: list[str], sources: DataFrame, options: Options | None = None) -> DataFrame:
    """``notes`` with the text columns scrubbed of the values of each row's patient; other columns as they are."""
    o = options or Options()
    kind = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("kind", "method", "value")]))
    values = patient_values(sources)
    d = notes.join(values, notes[pid] == values["pid"], "left").drop(values["pid"]).withColumn("scrub_values", F.coalesce("scrub_values", F.array().cast(kind)))
    known = F.to_json("scrub_values")

    @F.pandas_udf(T.StringType())
    def scrub(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        @lru_cache(maxsize=20_000)
        def of_patient(values: str) -> Personal:
            return Personal([(x["kind"], x["method"], x["value"]) for x in json.loads(values)], o)

        for text, of in batches:
            yield pd.Series([of_patient(v).scrub(t) for t, v in zip(text, of, strict=True)], dtype=object)

    return d.select(*(scrub(F.col(c), known).alias(c) if c in texts else F.col(c) for c in notes.columns))


def related(links: DataFrame, pid: str, related_pid: str, depth: int = 1) -> DataFrame:
    """pid and related: everyone reached by links in at most ``depth`` steps, each once, never oneself."""
    edges = links.select(F.col(pid).alias("pid"), F.col(related_pid).alias("related")).where("related IS NOT NULL AND pid <> related").distinct()
    out = step = edges
    for _ in range(depth - 1):
        step = step.alias("a").join(edges.alias("b"), F.col("a.related") == F.col("b.pid")).select("a.pid", "b.related").where("pid <> related").distinct()
        out = out.unionByName(step).distinct()
    return out


def scrub_dicts(texts: dict[str, str], patient: dict[str, list], third_party: dict[str, list] | None = None, options: Options | None = None) -> dict[str, str]:
    """Scrubs named texts of one person without any table; values by method."""
    values = [("patient", m, v) for m, vs in patient.items() for v in vs] + [("third_party", m, v) for m, vs in (third_party or {}).items() for v in vs]
    scrubber = Personal(values, options or Options())
    return {k: scrubber.scrub(v) for k, v in texts.items()}


def compare(raw: DataFrame, clean: DataFrame, key: str, text: str) -> DataFrame:
    """Raw and scrubbed texts side by side with counts of replacements of each kind."""
    times = lambda mark: F.size(F.split(F.col("clean"), rx.escape(mark), -1)) - 1
    d = raw.select(key, F.col(text).alias("raw")).join(clean.select(key, F.col(text).alias("clean")), key)
    return d.select(key, "raw", "clean", times(PATIENT).alias("n_patient"), times(THIRD_PARTY).alias("n_third_party"), times(NONSPECIFIC).alias("n_nonspecific"))
