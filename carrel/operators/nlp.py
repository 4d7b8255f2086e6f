"""Numeric results from notes: text in, rows out.

A note is cut into tokens: runs of letters, numbers, and single marks. What a quantity, a unit or a statement on drinking is called stands in plain
tables of spellings, which are cut into tokens the same way, so that finding one is a look-up and no pattern is searched. One walk over the tokens finds the
names of all processors; from each name a small grammar reads fillers, tense, relation, value and units, in three layouts: ``name (units) value``,
``name (value units)`` and ``name value units``. Hyphens between the words of a name are passed over.

All processors run over a note in one pass of Arrow batches; rows without a digit or a word on drinking never leave the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carrel.operators.read_names import READ_NAMES

_TOKEN = regex.compile(r"(?P<word>\p{L}+)|(?P<number>\d{1,3}(?:,\d{3})+(?:\.\d+)?(?!\d)|\d+(?:\.\d+)?)|[^\s\p{L}\d]")
WORD, NUMBER, MARK = "word", "number", "mark"
MINUS = "-−–"
#: The kind of a run of words that are no name of a quantity, but could be part of one.
NO_NAME = "none of it"
HYPHENS = frozenset("-‐–—−")


@dataclass(frozen=True)
class Tokens:
    """The tokens of a text: lower-case forms, kinds, and where each starts and ends."""

    text: str
    form: list[str]
    kind: list[str]
    start: list[int]
    end: list[int]

    def glued(self, i: int) -> bool:
        """Whether token ``i`` follows the one before it without a gap."""
        return 0 < i < len(self.form) and self.start[i] == self.end[i - 1]

    def inside_word(self, i: int) -> bool:
        """Whether letters or digits run on across the edge before token ``i``."""
        return self.glued(i) and self.kind[i] != MARK and self.kind[i - 1] != MARK

    def between(self, i: int, j: int) -> str:
        return self.text[self.start[i] : self.end[j - 1]] if j > i else ""


def tokens(text: str | None) -> Tokens:
    out = Tokens(text or "", [], [], [], [])
    for m in _TOKEN.finditer(out.text):
        out.form.append(m[0].lower().replace("µ", "μ"))
        out.kind.append(m.lastgroup or MARK)
        out.start.append(m.start())
        out.end.append(m.end())
    return out


class Spellings:
    """A set of spellings, found by their first token; the longest that stands at a place counts."""

    def __init__(self, spellings: Sequence[str]):
        self.first: dict[str, list[tuple[str, ...]]] = {}
        for s in dict.fromkeys(spellings):
            form = tuple(f for f in tokens(s).form if f not in HYPHENS) or tuple(tokens(s).form)
            self.first.setdefault(form[0], []).append(form)
        for forms in self.first.values():
            forms.sort(key=len, reverse=True)

    def at(self, t: Tokens, i: int, open_end: bool = False) -> int | None:
        """Where the spelling that stands at token ``i`` ends; ``open_end``: also inside a run of letters and digits."""
        for form in self.first.get(t.form[i], ()) if i < len(t.form) else ():
            j = i + 1
            for f in form[1:]:
                while j < len(t.form) and t.form[j] in HYPHENS and f not in HYPHENS:
                    j += 1
                if j >= len(t.form) or t.form[j] != f:
                    break
                j += 1
            else:
                if open_end or not t.inside_word(j):
                    return j
        return None


def _each(*parts: str) -> tuple[str, ...]:
    """All ways to put the parts together, a part being its alternatives parted by bars; an empty alternative leaves it out."""
    out = [""]
    for part in parts:
        out = [" ".join(x for x in (a, b.strip()) if x) for a in out for b in part.split("|")]
    return tuple(out)


# How units are spelled.
def _prefixed(short: str, long: str, units: str) -> str:
    short_units, long_units = (x.split() for x in units.split(";"))
    return "|".join([s + u for s in short.split() for u in short_units] + [x + u for x in long.split() for u in long_units])


LITRE = "l|lit|lits|litre|litres|liter|liters"
_LITRES = "l;l litre litres liter liters"
DL, ML, MICROLITRE = _prefixed("d", "deci", _LITRES), _prefixed("m", "milli", _LITRES), _prefixed("u μ", "micro", _LITRES)
G = "g|gram|grams|gramme|grammes"
MG = "mg|mgs|milligram|milligrams|milligramme|milligrammes"
KG = "kg|kgs|kilo|kilos|kilogram|kilograms|kilogramme|kilogrammes"
POUND, STONE = "lb|lbs|pound|pounds", "st|st.|stone|stones"
METRE, CM, MM = "m|metre|metres|meter|meters", "cm|centimetre|centimetres|centimeter|centimeters", "mm|millimetre|millimetres|millimeter|millimeters"
FOOT, INCH = "ft|foot|feet|'|’|′", 'in|ins|inch|inches|"|”|″'
MOLE = "mol|mols|mole|moles"
_MOLES = "mol mols mole moles;mol mols mole moles"
MMOL, UMOL = _prefixed("m", "milli", _MOLES), _prefixed("u μ", "micro", _MOLES)
MEQ, UEQ = "meq|millieq", "ueq|μeq|microeq"
MMOLAR, UMOLAR = "mm", "um|μm|micromolar"
UNIT = "u|u.|iu|iu.|i.u|i.u.|unit|units"
_UNITS = "u iu;u units unit iu"
MILLIUNIT, MICROUNIT = _prefixed("m", "milli", _UNITS), _prefixed("u μ", "micro", _UNITS)
CELLS = "cell|cells"
CUBIC_MM = "|".join(["cmm", *(f"cubic {x}" for x in MM.split("|")), *(f"{x}{up}3" for x in MM.split("|") for up in ("", "^", "**", "⋅"))])
SQUARE_M = "|".join(f"{a}{x}{b}" for x in METRE.split("|") for a, b in (("sq ", ""), ("square ", ""), ("", " sq"), ("", " squared"), ("", "2"), ("", "^2"), ("", "**2")))
HOUR, DAY, WEEK = "h|hr|hrs|hour|hours", "d|dy|day", "w|wk|week"
MONTH, YEAR = "month", "y|yr|year"
PERCENT = "%|percent|per cent|pct|pcnt"
TEN_9, TEN_12 = ("|".join(f"{x} 10 {up} {n}" for x in ("", "x", "*", "×", "⋅") for up in ("^", "**", "*", "e")) for n in (9, 12))
#: Sizes of units.
KG_PER = {"stone": 14 * 0.45359237, "pound": 0.45359237, "ounce": 0.45359237 / 16}
METRES_PER = {"foot": 0.3048, "inch": 0.0254}
CREATININE_G_PER_MOL, GLUCOSE_G_PER_MOL = 113.12, 180.156
DAYS_PER_WEEK, WEEKS_PER_MONTH, WEEKS_PER_YEAR = 7, 4.35, 52
HBA1C_OFFSET, HBA1C_FACTOR = 2.152, 10.93135
#: Words between a name and its value.
FILLERS = frozenset("| : * — h hh l ll --".split())
IN_BRACKETS = frozenset("h hh l ll *".split())
TENSES = {"is": "present", "was": "past"}
RELATIONS = {"<=": "<=", ">=": ">=", "<": "<", ">": ">", "=": "="}
SAID_RELATIONS = {"less than": "<", "under": "<", "below": "<", "equals": "=", "equal to": "=", "more than": ">", "greater than": ">", "over": ">", "above": ">"}
CONDITIONS = ("if", "when")
_RELATION: dict[str, list[tuple[tuple[str, ...], str]]] = {}
for _said_as, _meaning in {**RELATIONS, **SAID_RELATIONS}.items():
    _RELATION.setdefault(tokens(_said_as).form[0], []).append((tuple(tokens(_said_as).form), _meaning))
_OUT_OF = Spellings(("/", "out of"))


def total(amounts: dict, per: dict[str, float]):
    """Amounts in several units in the one that ``per`` gives the size of each in; numbers or Columns."""
    parts = [n * per[unit] for unit, n in amounts.items()]
    return sum(parts[1:], parts[0])


_PLAIN_NUMBER = regex.compile(r"[0-9]+(\.[0-9]+)?")


def to_float(text: str | None) -> float | None:
    """A number from its text, with commas between thousands and any dash as minus; None if it is none."""
    if text is None:
        return None
    sign = -1.0 if text[:1] and text[0] in MINUS else 1.0
    digits = text.lstrip("+" + MINUS).replace(",", "")
    return sign * float(digits) if _PLAIN_NUMBER.fullmatch(digits) else None


def hba1c_mmol_mol(percent: float) -> float | None:
    return (abs(percent) - HBA1C_OFFSET) * HBA1C_FACTOR if percent else None


# Grammar: each function takes tokens and a place, and gives the place behind what it has read.


def _fillers(t: Tokens, i: int) -> int:
    while i < len(t.form):
        f = t.form[i]
        if f in FILLERS and not t.inside_word(i) and not t.inside_word(i + 1):
            i += 1
        elif f == "(" and i + 2 < len(t.form) and t.form[i + 1] in IN_BRACKETS and t.form[i + 2] == ")":
            i += 3
        elif f in HYPHENS and (not t.glued(i + 1) or t.form[i + 1] in HYPHENS):
            i += 1
        else:
            break
    return i


def _value(t: Tokens, i: int) -> tuple[int, str] | None:
    """A number, with its sign if that touches it."""
    if i < len(t.form) and t.kind[i] == NUMBER:
        return i + 1, t.between(i, i + 1)
    if i + 1 < len(t.form) and (t.form[i] in MINUS or t.form[i] == "+") and t.kind[i + 1] == NUMBER and t.glued(i + 1):
        return i + 2, t.between(i, i + 2)
    return None


def _tense(t: Tokens, i: int) -> tuple[int, str | None]:
    return (i + 1, t.between(i, i + 1)) if i < len(t.form) and t.form[i] in TENSES else (i, None)


def _relation(t: Tokens, i: int) -> tuple[int, str | None, str]:
    for form, meaning in _RELATION.get(t.form[i], ()) if i < len(t.form) else ():
        j = i + len(form)
        if tuple(t.form[i:j]) == form and not t.inside_word(j) and all(t.glued(k) for k in range(i + 1, j) if t.kind[k] == MARK):
            return j, t.between(i, j), meaning
    return i, None, "="


@dataclass(frozen=True)
class Said:
    """Tense and relation as they stand between a name and its value."""

    next: int
    tense_text: str | None
    tense: str | None
    relation_text: str | None
    relation: str


def _said(t: Tokens, i: int) -> Said:
    i, tense = _tense(t, _fillers(t, i))
    i, relation, meaning = _relation(t, _fillers(t, i))
    return Said(_fillers(t, i), tense, TENSES[tense.lower()] if tense else None, relation, meaning)


@dataclass(frozen=True)
class Unit:
    """What stands above and, for a ratio, below; ``bare``: the upper part may be missing."""

    top: str
    bottom: str | None = None
    bare: bool = False
    compiled: list = field(default_factory=list, compare=False, repr=False)

    def at(self, t: Tokens, i: int) -> int | None:
        if not self.compiled:
            self.compiled.extend((Spellings(self.top.split("|")), Spellings(self.bottom.split("|")) if self.bottom else None))
        top, bottom = self.compiled
        above = top.at(t, i, open_end=bottom is not None)
        if bottom is None:
            return above
        for j in (above, i if self.bare else None):
            if j is None or j >= len(t.form):
                continue
            if t.form[j] in ("/", "per") and (k := bottom.at(t, j + 1)) is not None:
                return k
            if (k := bottom.at(t, j, open_end=True)) is not None and t.form[k : k + 2] in (["-", "1"], ["^", "-"]):
                k += 2 if t.form[k] == "-" else 3
                return k if t.form[k - 1 : k] == ["1"] else None
        return None


@dataclass(frozen=True)
class Found:
    content: str
    start: int
    end: int
    variable_text: str | None
    relation_text: str | None
    relation: str | None
    value_text: str | None
    units: str | None
    tense_text: str | None
    tense: str | None
    value: float | None = None
    value2: float | None = None
    denominator: float | None = None


@dataclass(frozen=True)
class Name:
    """A quantity's name in a note: its first token, the one behind it, and what kind of name it is."""

    start: int
    end: int
    kind: str = ""


@dataclass(frozen=True)
class Processor:
    """A quantity: its spellings, its target column, and its units with a factor or a function of the number."""

    name: str
    spellings: tuple[str, ...]
    target: str
    units: tuple[tuple[Unit, float | Callable[[float], float | None]], ...] = ()
    not_after: tuple[str, ...] = ()
    compiled: dict = field(default_factory=dict, compare=False, repr=False)

    #: Whether "if the CRP is 5" is left out.
    unconditional = True

    def table(self) -> dict[str, tuple[Spellings, str]]:
        """First token -> spellings and kind of name."""
        if "table" not in self.compiled:
            s = Spellings(self.spellings + tuple(phrase for _, phrase in READ_NAMES.get(self.name, ())))
            self.compiled["table"] = dict.fromkeys(s.first, ((s, ""),))
            self.compiled["codes"] = Spellings([code for code, _ in READ_NAMES.get(self.name, ())] or ["\x00"])
        return self.compiled["table"]

    def first_tokens(self) -> set[str]:
        return set(self.table())

    def name_at(self, t: Tokens, i: int) -> Name | None:
        if t.inside_word(i):
            return None
        ends = [(j, kind) for s, kind in self.table().get(t.form[i], ()) if (j := s.at(t, i)) is not None]
        if not ends:
            return None
        j, kind = max(ends)
        if self.not_after and i:
            k = i - 1
            while k and t.form[k] in HYPHENS:
                k -= 1
            if t.form[k] in self.not_after:
                return None
        if self.unconditional:
            k = i - 2 if i and t.form[i - 1] == "the" else i - 1
            if k >= 0 and t.form[k] in CONDITIONS:
                return None
        return Name(i, self._behind(t, j), kind)

    def _behind(self, t: Tokens, j: int) -> int:
        """Behind what may follow a name: a note that it was observed, and a code in brackets."""
        if (k := j + 1) < len(t.form) and t.form[j] in HYPHENS and t.form[k] == "observation":
            j = k + 1
        if j < len(t.form) and t.form[j] == "(" and "codes" in self.compiled and (k := self.compiled["codes"].at(t, j + 1, open_end=True)) is not None and t.form[k : k + 1] == [")"]:
            j = k + 1
        return j

    def unit_at(self, t: Tokens, i: int):
        """The place behind the longest unit at ``i``, and its factor."""
        ends = [(k, n) for n, (unit, _) in enumerate(self.units) if (k := unit.at(t, i)) is not None]
        if not ends:
            return None
        k, n = max(ends, key=lambda x: (x[0], -x[1]))
        return k, self.units[n][1]

    def read(self, t: Tokens, name: Name) -> tuple[int, Found] | None:
        """The result that follows a name, and the place behind it."""
        i = name.end
        if (k := i + (t.form[i : i + 1] == [","])) < len(t.form) and t.form[k] == "poc":
            i = k + 1
        i = _fillers(t, i)
        if t.form[i : i + 1] == ["("]:
            if (u := self.unit_at(t, i + 1)) and t.form[u[0] : u[0] + 1] == [")"]:
                said = _said(t, u[0] + 1)
                if v := _value(t, said.next):
                    return self._found(t, name, said, v[1], v[0], (i + 1, u[0], u[1]))
            if (v := _value(t, i + 1)) and (u := self.unit_at(t, v[0])) and t.form[u[0] : u[0] + 1] == [")"]:
                return self._found(t, name, Said(i, None, None, None, "="), v[1], u[0] + 1, (v[0], *u))
        said = _said(t, i)
        if v := _value(t, said.next):
            j = v[0]
        elif t.form[said.next : said.next + 1] == ["("] and (v := _value(t, said.next + 1)) and t.form[v[0] : v[0] + 1] == [")"]:
            j = v[0] + 1
        else:
            return None
        k = _fillers(t, j)
        if u := self.unit_at(t, k):
            return self._found(t, name, said, v[1], u[0], (k, *u))
        return self._found(t, name, said, v[1], j, None)

    def _found(self, t: Tokens, name: Name, said: Said, number: str, end: int, unit) -> tuple[int, Found]:
        value = to_float(number)
        if unit:
            factor = unit[2]
            value = factor(value) if callable(factor) else value * factor
        return end, self.row(t, name, said, end, number, t.between(unit[0], unit[1]) if unit else None, None if value is None else abs(value))

    def row(self, t: Tokens, name: Name, said: Said, end: int, number: str, units: str | None, *values) -> Found:
        return Found(t.between(name.start, end), t.start[name.start], t.end[end - 1], t.between(name.start, name.end), said.relation_text, said.relation, number, units, said.tense_text, said.tense, *values)

    def parse(self, text: str | None) -> Iterator[Found]:
        return (f for _, f in parse(tokens(text), [self]))

    def mentions(self, text: str | None) -> Iterator[tuple[int, int, str]]:
        """Where the quantity is named, with a value or not: for recall checks."""
        t, i = tokens(text), 0
        while i < len(t.form):
            name = self.name_at(t, i)
            if name and name.kind != NO_NAME:
                yield t.start[name.start], t.end[name.end - 1], t.between(name.start, name.end)
            i = name.end if name else i + 1


@dataclass(frozen=True)
class OutOf(Processor):
    """A score out of a known maximum; another denominator leaves the value unknown."""

    most: int = 30
    #: Last words of a name that are none where ``out of`` follows, as in "ACE 3/100".
    not_before_out_of: tuple[str, ...] = ()
    unconditional = False

    def name_at(self, t: Tokens, i: int) -> Name | None:
        name = super().name_at(t, i)
        if name and t.form[name.end - 1] in self.not_before_out_of and _OUT_OF.at(t, name.end, open_end=True) is not None:
            return Name(i, name.end - 1)
        return name

    def read(self, t: Tokens, name: Name) -> tuple[int, Found] | None:
        i = _fillers(t, name.end)
        if t.form[i : i + 1] in (["score"], ["scored"]):
            i += 1
        said = _said(t, i)
        if not (v := _value(t, said.next)):
            return None
        end, top, of = v[0], abs(to_float(v[1])), None
        if (k := _OUT_OF.at(t, end, open_end=True)) is not None and k < len(t.form) and t.kind[k] == NUMBER and "." not in t.form[k]:
            end, of = k + 1, to_float(t.form[k])
        good = top <= self.most and of in (None, self.most)
        return end, self.row(t, name, said, end, v[1], None, top if good else None, top, of)


@dataclass(frozen=True)
class Measure(Processor):
    """Height or weight: one number with one unit, or two with two."""

    #: Each a row of units and what one of it is; more than one make a compound.
    forms: tuple[tuple[tuple[str, float], ...], ...] = ()
    signed: bool = False
    unconditional = False

    def read(self, t: Tokens, name: Name) -> tuple[int, Found] | None:
        said = _said(t, name.end)
        for form in self.forms:
            i, value, units, numbers = said.next, 0.0, [], 0
            for spellings, one in form:
                v = _value(t, _fillers(t, i) if numbers else i)
                u = _spelled(spellings).at(t, k) if v and (k := _fillers(t, v[0])) < len(t.form) else None
                if u is None:
                    break
                number = to_float(v[1])
                value += (number if self.signed else abs(number)) * one
                units.append(t.between(k, u))
                i, numbers = u, numbers + 1
            if numbers == len(form):
                return i, self.row(t, name, said, i, t.between(said.next, i), " ".join(units), value)
        return None


@lru_cache(maxsize=256)
def _spelled(spellings: str) -> Spellings:
    return Spellings(spellings.split("|"))


@dataclass(frozen=True)
class BloodPressure(Processor):
    """Systolic over diastolic, or one of them if the text says which; a lone number of neither kind is left out."""

    unconditional = False

    def table(self):
        if "table" not in self.compiled:
            self.compiled["table"] = {}
            # Names of pressures.
            plain = ("blood pressure", "bp", "b.p", "b.p.")
            for kind, names in (("", plain), ("s", (*(f"systolic {n}" for n in plain), "sbp", "s.b.p", "s.b.p.")), ("d", (*(f"diastolic {n}" for n in plain), "dbp", "d.b.p", "d.b.p."))):
                s = Spellings(names)
                for first in s.first:
                    self.compiled["table"][first] = (*self.compiled["table"].get(first, ()), (s, kind))
        return self.compiled["table"]

    def read(self, t: Tokens, name: Name) -> tuple[int, Found] | None:
        said = _said(t, name.end)
        if not (v := _value(t, said.next)):
            return None
        end, a, b = v[0], abs(to_float(v[1])), None
        if t.form[end : end + 1] in (["/"], ["over"]) and (w := _value(t, end + 1)):
            end, b = w[0], abs(to_float(w[1]))
        if not name.kind and b is None:
            return None
        high, low = (a, None) if name.kind == "s" else (None, a) if name.kind == "d" else (a, b)
        number, u = t.between(said.next, end), _spelled("mmhg|mm hg").at(t, k) if (k := _fillers(t, end)) < len(t.form) else None
        return u or end, self.row(t, name, said, u or end, number, t.between(k, u) if u else None, high, low)


# Words of statements on drinking.
ALCOHOL = "alcohol|ethanol|etoh"
DRANK = ("used to drink", "drank", "has drunk", *_each("formerly|once|peak|previously|was", "drank|drinking"), *_each("has", "formerly|once|peak|previously|was", "drunk"))
DRINKS = ("drinks", "drinking", "is drinking")
PAST_WORDS = ("formerly", "once", "peak", "previously", "was")
NOW_WORDS = ("at present", "currently", "has been", "now", "nowadays", "presently", "these days")
NONE_WORDS = ("0", "abstinent", "abstinant", "abstinent from", "abstinant from", "never", "no", "none", "zero")
TEETOTAL = ("teetotal", "teetotaler", "teetotaller", "tee total", "tee totaler", "tee totaller", "teatotal", "teatotaler", "teatotaller", "tea total", "tea totaler", "tea totaller")
DRINKS_NOT = (*_each("does n't|doesn't|doesn’t|does not", "drink", ALCOHOL), *_each("has never drunk", ALCOHOL))
UK_UNIT = "|".join(_each("|uk|u.k.|united kingdom", f"|{ALCOHOL}", UNIT))
_CUES = {"drank": Spellings(DRANK), "drinks": Spellings(DRINKS), "past": Spellings(PAST_WORDS), "now": Spellings(NOW_WORDS), "alcohol": Spellings(_each(ALCOHOL, "|consumption")), "none": Spellings(NONE_WORDS)}
_ZERO = Spellings((*TEETOTAL, *DRINKS_NOT))
_LINKS = (":", "at")


@dataclass(frozen=True)
class Alcohol(Processor):
    """UK units a week, from amounts by day, week, month or year, and 0 from statements of drinking none.

    A name is a run of cues: words on drinking, on alcohol, on when, and, in statements of none, on nothing.
    """

    unconditional = False

    def first_tokens(self) -> set[str]:
        return {f for s in (*_CUES.values(), _ZERO) for f in s.first}

    def _run(self, t: Tokens, i: int) -> tuple[int, list[str]]:
        """The cues that follow one another from token ``i`` on, and the place behind them."""
        kinds: list[str] = []
        end = j = i
        while j < len(t.form):
            best = max(((k, c) for c, s in _CUES.items() if not t.inside_word(j) and (k := s.at(t, j)) is not None), default=None)
            if best and best[1] == "none" and t.kind[j] == NUMBER and self.unit_at(t, best[0]):
                best = None
            if best:
                j, end = best[0], best[0]
                kinds.append(best[1])
            elif kinds and t.form[j] in _LINKS:
                j += 1
            else:
                break
        return end, kinds

    def name_at(self, t: Tokens, i: int) -> Name | None:
        if t.inside_word(i):
            return None
        if (j := _ZERO.at(t, i)) is not None:
            return Name(i, j, "none")
        end, kinds = self._run(t, i)
        if "none" in kinds:
            return Name(i, end, "none" if "alcohol" in kinds else NO_NAME)
        return Name(i, end, "" if {"drank", "drinks", "alcohol"} & set(kinds) else NO_NAME) if kinds else None

    def _when(self, t: Tokens, i: int, j: int) -> str | None:
        kinds = self._run(t, i)[1] if j > i else []
        if "never" in t.form[i:j]:
            return "ever"
        return "past" if {"drank", "past"} & set(kinds) else "present" if {"drinks", "now"} & set(kinds) else None

    def read(self, t: Tokens, name: Name) -> tuple[int, Found] | None:
        if name.kind == "none":
            said = t.between(name.start, name.end)
            tense = self._when(t, name.start, name.end)
            return name.end, Found(said, t.start[name.start], t.end[name.end - 1], said, None, None, said, None, said if tense else None, tense, 0.0)
        got = super().read(t, name) if name.kind != NO_NAME else None
        if got is None or got[1].units is None:
            return None
        end, f = got
        # What follows says when, too.
        behind = max((k for c in ("past", "now") if end < len(t.form) and (k := _CUES[c].at(t, end)) is not None), default=end)
        tense, text = f.tense, f.tense_text
        for i, j in ((name.start, name.end), (end, behind)):
            if tense is None and (tense := self._when(t, i, j)):
                text = t.between(i, j)
        return behind, Found(t.between(name.start, behind), f.start, t.end[behind - 1], f.variable_text, f.relation_text, f.relation, f.value_text, f.units, text, tense, f.value)


@lru_cache(maxsize=64)
def _starts(names: tuple[str, ...]) -> dict[str, list[int]]:
    """First token of a name -> the places of the processors that have such a name."""
    out: dict[str, list[int]] = {}
    for k, name in enumerate(names):
        for form in PROCESSORS[name].first_tokens():
            out.setdefault(form, []).append(k)
    return out


def parse(t: Tokens, processors: Sequence[Processor]) -> Iterator[tuple[Processor, Found]]:
    """The results of all processors in one walk from left to right; those of one processor do not overlap."""
    starts = _starts(tuple(p.name for p in processors))
    free = [0] * len(processors)
    for i, form in enumerate(t.form):
        for k in starts.get(form, ()):
            if i < free[k]:
                continue
            p = processors[k]
            if (name := p.name_at(t, i)) is None:
                continue
            got = p.read(t, name)
            free[k] = got[0] if got else name.end
            if got:
                yield p, got[1]


_MMOL_L = ((Unit(MMOLAR), 1.0), (Unit(MMOL, LITRE), 1.0))
_MMOL_MEQ = (*_MMOL_L, (Unit(MEQ, LITRE), 1.0))
_UMOL_L = ((Unit(UMOLAR), 1.0), (Unit(UMOL, LITRE), 1.0))
_U_L, _G_L, _MG_DL = ((Unit(UNIT, LITRE), 1.0),), (Unit(G, LITRE), 1.0), Unit(MG, DL)
_LIPID = (*_MMOL_L, (_MG_DL, 0.02586))
_WHITE = ((Unit(TEN_9, LITRE), 1.0), (Unit(CELLS, MICROLITRE + "|" + CUBIC_MM, bare=True), 0.001))


def _count(*names: str) -> tuple[str, ...]:
    return _each("|absolute", "|".join(names), "|count")


def _score(*names: str) -> tuple[str, ...]:
    return tuple(names)


_ACE = ("ace", *_each("addenbrooke's|addenbrookes|addenbrooke’s", "cognitive", "evaluation|exam|examination"))
_FOOT, _INCH = METRES_PER["foot"], METRES_PER["inch"]
_STONE, _POUND = KG_PER["stone"], KG_PER["pound"]

#: What the quantities are called, their target columns, units and factors.
PROCESSORS: dict[str, Processor] = {
    p.name: p
    for p in (
        Processor("CRP", ("CRP", "C reactive protein"), "value_mg_L", ((_MG_DL, 10.0), (Unit(MG, LITRE), 1.0))),
        Processor("Sodium", ("Na", "sodium"), "value_mmol_L", _MMOL_MEQ),
        Processor("Potassium", ("K", "potassium"), "value_mmol_L", _MMOL_MEQ),
        Processor("Urea", ("U", "Ur", "urea"), "value_mmol_L", _MMOL_MEQ),
        Processor("Creatinine", ("Cr", "creat", "creatinine"), "value_micromol_L", (*_UMOL_L, (Unit(UEQ, LITRE), 1.0), (_MG_DL, 10_000 / CREATININE_G_PER_MOL))),
        Processor("Lithium", ("Li", "lithium"), "value_mmol_L", _MMOL_MEQ),
        Processor("TSH", ("TSH", "thyroid stimulating hormone"), "value_mU_L", ((Unit(MILLIUNIT, LITRE), 1.0), (Unit(MICROUNIT, ML), 1.0))),
        Processor("AlkPhos", ("ALP", "ALP.", "ALkP", "ALkP.", "alkphos", "alkphos.", *_each("alk|alk.|alkaline", "phos|phos.|phosphatase")), "value_U_L", _U_L),
        Processor("ALT", ("ALT", "alanine aminotransferase", "alanine transaminase"), "value_U_L", _U_L),
        Processor("GammaGT", ("GGT", "γGT", *_each("G|γ|gamma", "GT|glutamyl transferase")), "value_U_L", _U_L),
        Processor("Bilirubin", _each("|t|t.|tot|tot.|total", "bil|bil.|bili|bili.|bilirubin"), "value_micromol_L", _UMOL_L),
        Processor("Albumin", _each("alb|alb.|albumin", "|level"), "value_g_L", (_G_L,)),
        Processor("Glucose", ("glu", "gluc", "glucose"), "value_mmol_L", (*_MMOL_L, (_MG_DL, 10 / GLUCOSE_G_PER_MOL))),
        Processor("LDLCholesterol", ("LDLchol", "LDLcholesterol", *_each("LDL", "|chol|chol.|cholesterol")), "value_mmol_L", _LIPID),
        Processor("HDLCholesterol", ("HDLchol", "HDLcholesterol", *_each("HDL", "|chol|chol.|cholesterol")), "value_mmol_L", _LIPID),
        Processor("TotalCholesterol", _each("|total", "chol|chol.|cholesterol"), "value_mmol_L", _LIPID, ("hdl", "ldl")),
        Processor("Triglycerides", ("TG", "triglyceride", "triglycerides"), "value_mmol_L", (*_MMOL_L, (_MG_DL, 0.01129))),
        Processor("HbA1c", ("HbA1c", *_each("glycated|glycosylated", "haemoglobin|hemoglobin|Hb")), "value_mmol_mol", ((Unit(MMOL, MOLE), 1.0), (Unit(PERCENT), hba1c_mmol_mol))),
        Measure("Height", ("height",), "value_m", forms=(((METRE, 1.0), (CM, 0.01)), ((METRE, 1.0),), ((CM, 0.01),), ((FOOT, _FOOT), (INCH, _INCH)), ((FOOT, _FOOT),), ((INCH, _INCH),))),
        Measure("Weight", ("weight", "weighs"), "value_kg", forms=(((KG, 1.0),), ((STONE, _STONE), (POUND, _POUND)), ((STONE, _STONE),), ((POUND, _POUND),)), signed=True),
        Processor("BMI", ("BMI", "body mass index"), "value_kg_per_sq_m", ((Unit(KG, SQUARE_M), 1.0), (Unit("|".join(f"{k} {x} {m}{up}-2" for k in KG.split("|") for x in ("", "x", "*", "×", "⋅") for m in METRE.split("|") for up in ("^", "**"))), 1.0))),
        BloodPressure("BP", ("blood pressure", "BP"), "systolic_bp_mmhg"),
        Processor("Haemoglobin", ("haemoglobin", "hemoglobin", "Hb", "HGB"), "value_g_L", (_G_L, (Unit(G, DL), 10.0))),
        Processor("Haematocrit", ("haematocrit", "hematocrit", "Hct"), "value_L_L", ((Unit(LITRE, LITRE), 1.0),)),
        Processor("RBC", ("RBC", "RBCs", *_each("red", "|blood", "cell|cells", "|(RBC)", "|count")), "value_trillion_per_l", ((Unit(TEN_12, LITRE), 1.0), (Unit(CELLS, CUBIC_MM, bare=True), 1e-6))),
        Processor("ESR", ("ESR", *_each("erythrocyte", "sed|sed.|sedimentation", "rate")), "value_mm_h", ((Unit(MM, HOUR), 1.0),)),
        Processor("WBC", ("WBC", "WBCs", "WBCC", "WCC", *_each("white", "|blood", "cell|cells", "|count", "|WBC|WBCC|WCC|(WBC)|(WBCC)|(WCC)")), "value_billion_per_l", _WHITE),
        Processor("Neutrophils", _count("neut", "neuts", "neutr", "neutrs", "neutro", "neutros", "neutrophil", "neutrophils", "N0"), "value_billion_per_l", _WHITE),
        Processor("Lymphocytes", _count("lymph", "lymphs", "lympho", "lymphos", "lymphocyte", "lymphocytes"), "value_billion_per_l", _WHITE),
        Processor("Monocytes", _count("mono", "monos", "monocyte", "monocytes"), "value_billion_per_l", _WHITE),
        Processor("Basophils", _count("baso", "basos", "basophil", "basophils"), "value_billion_per_l", _WHITE),
        Processor("Eosinophils", _count("eo", "eos", "eosin", "eosins", "eosino", "eosinos", "eosinophil", "eosinophils"), "value_billion_per_l", _WHITE),
        Processor("Platelets", _each("platelet|platelets|plt|plts", "|count"), "value_billion_per_l", _WHITE),
        OutOf("MMSE", ("MMSE", *_each("mini mental|minimental", "|state", "|exam|examination")), "out_of_30", most=30),
        OutOf("ACE", tuple(f"{a} {b}".strip() for a in _ACE for b in ("", "R", "III", "111", "3")), "out_of_100", most=100, not_before_out_of=("3",)),
        OutOf("MiniACE", ("MACE", "miniACE", *(f"{m} {a}" for m in ("mini", "M") for a in _ACE)), "out_of_30", most=30),
        OutOf("MOCA", ("MOCA", "Montreal cognitive assessment"), "out_of_30", most=30),
        Alcohol("AlcoholUnits", (), "value_uk_units_per_week", tuple((Unit(UK_UNIT, t), f) for t, f in ((WEEK, 1.0), (DAY, DAYS_PER_WEEK), (MONTH, 1 / WEEKS_PER_MONTH), (YEAR, 1 / WEEKS_PER_YEAR)))),
    )
}
#: Parts of names: a note that holds none of them holds no result.
CUES = r"(?iu)\d|alcohol|ethanol|etoh|te[ea][- ]?total"
OUTPUT = "processor string, target string, pk long, content string, start int, end int, variable_text string, relation_text string, relation string, value_text string, units string, tense_text string, tense string, value double, value2 double, denominator double"
_ARROW = pa.schema([("processor", pa.string()), ("target", pa.string()), ("pk", pa.int64()), ("content", pa.string()), ("start", pa.int32()), ("end", pa.int32()), *((c, pa.string()) for c in ("variable_text", "relation_text", "relation", "value_text", "units", "tense_text", "tense")), *((c, pa.float64()) for c in ("value", "value2", "denominator"))])


def relevant(text):
    """A text that can be parsed: it has a word character and a printable ASCII character; a Column."""
    return text.rlike(r"(?U)\w") & text.rlike("[!-~]")


#: Notes that a task reads, about, and those whose rows are put out at once.
TASK_NOTES, PUT_OUT = 20_000, 1000


def _rows(batch: pa.RecordBatch, chosen: Sequence[Processor]) -> Iterator[pa.RecordBatch]:
    """The rows of a batch of keys and notes; notes that are equal are read once."""
    texts = batch.column(1).dictionary_encode()
    rows, ends = [], [0]
    for text in texts.dictionary:
        for p, f in parse(tokens(text.as_py()), chosen):
            rows.append((p.name, p.target, None, f.content, f.start, f.end, f.variable_text, f.relation_text, f.relation, f.value_text, f.units, f.tense_text, f.tense, f.value, f.value2, f.denominator))
        ends.append(len(rows))
    if not rows:
        return
    read = pa.RecordBatch.from_arrays([pa.array(c, s.type) for c, s in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)
    first, number, which = np.array(ends[:-1]), np.diff(ends), texts.indices.to_numpy()
    for at in range(0, batch.num_rows, PUT_OUT):
        w = which[at : at + PUT_OUT]
        n = number[w]
        if n.sum():
            # Row i of a note is the first row of its text and i.
            places = np.repeat(first[w] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            keys = batch.column(0).slice(at, PUT_OUT).take(pa.array(np.repeat(np.arange(len(w)), n)))
            out = read.take(pa.array(places))
            yield out.set_column(2, _ARROW.field("pk"), keys)


def run(notes: DataFrame, pk: str, text: str, processors: list[str] | None = None) -> DataFrame:
    """Rows of all named processors (default: all) over a text column, in one pass; ``OUTPUT`` is the schema.

    Notes that are null, empty or hold no digit and no word on drinking are skipped before any Python. The others are counted and dealt
    evenly: reading one takes about a ms, so a small file of many short notes is the work of many tasks.
    """
    names = list(PROCESSORS) if processors is None else processors

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = [PROCESSORS[n] for n in names]
        for batch in batches:
            yield from _rows(batch, chosen)

    t = F.col(text)
    d = notes.where(relevant(t) & t.rlike(CUES)).select(F.col(pk).cast("long"), t)
    if not notes.isStreaming and (tasks := -(-d.count() // TASK_NOTES)) > 1:
        d = d.repartition(max(tasks, int(notes.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return d.mapInArrow(parsed, OUTPUT)


def missed(notes: DataFrame, pk: str, text: str, processor: str) -> DataFrame:
    """Recall check: notes that name the quantity and give no row of its processor."""

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = PROCESSORS[processor]
        for batch in batches:
            keys = [k for k, note in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if next(p.mentions(note), None) and not next(p.parse(note), None)]
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64())], names=["pk"])

    return notes.where(relevant(F.col(text))).select(F.col(pk).cast("long"), F.col(text)).mapInArrow(names, "pk long")


def external(notes: DataFrame, pk: str, text: str, program, schema: str) -> DataFrame:
    """Hook for a program outside: ``program`` maps an iterator of pandas batches (pk, text) to result batches, in the executors."""
    return notes.where(relevant(F.col(text))).select(pk, text).mapInPandas(program, schema)


def remote(notes: DataFrame, pk: str, text: str, queue, batch: str, client: str = "notes") -> Callable[[str], DataFrame]:
    """Sends notes to a processor elsewhere by a ``carrel.streaming.requests.Queue``, whose folder a service or another cluster reads and answers.

    Replies are JSON objects, or arrays of them, by the note's key. What is returned gives, for a schema of a reply's fields, pk and these
    fields of all replies so far; a note without a result has none.
    """
    queue.put(notes.where(relevant(F.col(text))).select(F.col(pk).cast("string").alias("request_id"), F.lit(client).alias("client"), F.col(text).alias("text")), batch)

    def replies(schema: str) -> DataFrame:
        d = queue.fetch(client)
        many = F.when(F.col("result").startswith("["), F.col("result")).otherwise(F.concat(F.lit("["), F.col("result"), F.lit("]")))
        return d.select(F.col("request_id").cast("long").alias("pk"), F.explode(F.from_json(many, f"array<struct<{schema.replace(' ', ':', 1)}>>")).alias("x")).select("pk", "x.*")

    return replies
