"""Text functions as Catalyst expressions."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Name parts that say nothing of a family by themselves.
NONSPECIFIC = frozenset("AF AL AUF AV AW D DA DAI DAL DALLA DAS DE DEI DEL DELL DELLA DER DES DI DO DOS DU EL I II III IV IX JNR JR L LA LE NA OF PHRA SNR SR SRI THOE TOT V VAN VI VII VIII VON X ZU".split())
#: Accents with a spelling of their own.
TRANSLITERATED = {"Ä": "AE", "Ö": "OE", "Ü": "UE", "ẞ": "SS"}
#: Curly and other marks as plain ones.
PLAIN_MARKS = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "‐": "-", "−": "-", "\t": " ", "\n": " ", "\r": " ", " ": " "}
POSTCODE = r"[A-Z]{1,2}[0-9][A-Z0-9]?\s*[0-9][A-Z]{2}"
NO_FIXED_ABODE = "ZZ993VZ"
PSEUDO_START = "ZZ99"


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\D", "")


def alphanumeric_only(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{N}]", "")


def without_whitespace(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s", "")


def fragments(c: Column) -> Column:
    """Words of a value, as they are looked for in texts: ``D'Souza`` gives D and Souza."""
    return F.filter(F.split(c, r"(?U)\W+"), lambda x: x != "")


def simple_marks(c: Column) -> Column:
    return F.translate(c, "".join(PLAIN_MARKS), "".join(PLAIN_MARKS.values()))


def single_spaced(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def safe_upper(c: Column) -> Column:
    """Upper case in which ß becomes ẞ, not SS."""
    return F.upper(F.translate(c, "ß", "ẞ"))


def to_ascii(text: str | None) -> str:
    """ASCII letters for accented ones; what has none is dropped."""
    if text is None:
        return ""
    text = unicodedata.normalize("NFKD", str(text)).translate({ord("ß"): "ss", ord("ẞ"): "SS", ord("Æ"): "AE", ord("æ"): "ae", ord("Ø"): "O", ord("ø"): "o"})
    return text.encode("ascii", "ignore").decode()


@F.pandas_udf(T.StringType())
def ascii_udf(s: pd.Series) -> pd.Series:
    return s.map(to_ascii)


def standard_name(text: str | None) -> str:
    """Upper-case ASCII letters and digits alone."""
    return "".join(ch for ch in to_ascii((text or "").replace("ß", "ẞ")).upper() if ch.isalnum())


def standard_name_ascii(c: Column) -> Column:
    """``standard_name`` for text that is ASCII already, without a UDF."""
    return F.regexp_replace(F.upper(c), r"[^A-Z0-9]", "")


def surname_fragments(name: str | None) -> list[str]:
    """The whole name, then in order its parts and their plain and transliterated spellings, without nonspecific parts."""
    if not name:
        return []
    upper = name.translate(str.maketrans(PLAIN_MARKS)).replace("ß", "ẞ").upper()
    parts = [p for p in "".join(ch if ch.isalnum() or ch == "_" else " " for ch in upper).split() if p]
    whole, found = "".join(parts), set()
    for part in [whole, *(p for p in parts if p not in NONSPECIFIC)]:
        found |= {part, to_ascii(part), part.translate(str.maketrans(TRANSLITERATED))}
    return [whole, *sorted(found - {whole, ""})]


@F.pandas_udf(T.ArrayType(T.StringType()))
def surname_fragments_udf(s: pd.Series) -> pd.Series:
    return s.map(surname_fragments)


def surname_fragments_ascii(c: Column) -> Column:
    """``surname_fragments`` for ASCII names, without a UDF."""
    parts = F.filter(F.split(F.upper(simple_marks(c)), r"\W+"), lambda x: x != "")
    whole = F.array_join(parts, "")
    own = F.filter(parts, lambda p: ~p.isin(*sorted(NONSPECIFIC)))
    rest = F.array_sort(F.array_distinct(F.filter(own, lambda p: p != whole)))
    return F.when(whole == "", F.array().cast("array<string>")).otherwise(F.concat(F.array(whole), rest))


def standard_postcode(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), r"[^A-Z0-9]", "")


def postcode_sector(c: Column) -> Column:
    p = standard_postcode(c)
    return F.substring(p, F.lit(1), F.greatest(F.length(p) - 2, F.lit(0)))


def is_pseudo_postcode(c: Column) -> Column:
    return F.startswith(standard_postcode(c), F.lit(PSEUDO_START))


def is_postcode(c: Column) -> Column:
    return c.rlike(f"(?i)^{POSTCODE}$")


def untag(c: Column) -> Column:
    """Without HTML tags."""
    return F.regexp_replace(c, "<[^>]*>", "")


@F.pandas_udf(T.StringType())
def unescape_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else html.unescape(x))


def highlight(c: Column, words: list[str], colour: int = 0, colours: int = 4) -> Column:
    """The words, in any case, in a span whose class is the colour's number modulo ``colours``."""
    if not words:
        return c
    quoted = "|".join(escape(w) for w in words)
    return F.regexp_replace(c, f"(?iu)({quoted})", f'<span class="highlight{colour % colours}">$1</span>')


def escape(text: str) -> str:
    """The text as a regular expression that matches it alone."""
    return "".join("\\" + ch if ch in r"\.^$*+?{}[]()|&~#-" or ch.isspace() else ch for ch in text)


def first_letters(text: str, n: int) -> str:
    """A pattern for the first ``n`` letters of a word with any more of them in order: Sep, Sept, Septe ..."""
    out = ""
    for ch in reversed(text[n:]):
        out = f"(?:{escape(ch)}{out})?"
    return escape(text[:n]) + out


def has_nhs_checksum(c: Column) -> Column:
    """Ten digits whose weighted sum modulo 11 gives the last."""
    d = F.regexp_replace(c.cast("string"), r"[\s-]", "")
    weighted = sum((F.substring(d, i, 1).try_cast("int") * (11 - i) for i in range(2, 10)), F.substring(d, 1, 1).try_cast("int") * 10)
    check = 11 - weighted % 11
    check = F.when(check == 11, 0).otherwise(check)
    return F.coalesce(d.rlike("^[0-9]{10}$") & (check != 10) & (check == F.substring(d, 10, 1).try_cast("int")), F.lit(False))


def is_nhs_number(c: Column) -> Column:
    """A valid number that is not a test number, which begins with 999."""
    return has_nhs_checksum(c) & ~F.startswith(F.regexp_replace(c.cast("string"), r"[\s-]", ""), F.lit("999"))


def to_map(c: Column) -> Column:
    """``key:value;...`` as a map."""
    return F.str_to_map(c, F.lit(";"), F.lit(":"))


def perfect_id(pair):
    """Key and value of ``key:value``: the key in lower case, the value in upper case; two Columns."""
    return F.lower(F.trim(F.substring_index(pair, ":", 1))), F.upper(F.trim(F.substring_index(pair, ":", -1)))
