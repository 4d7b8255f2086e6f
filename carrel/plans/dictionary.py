"""The data dictionary: what becomes of each source column, and the plan that it stands for."""

from __future__ import annotations

import csv
import json
from dataclasses import asdict, dataclass, fields
from fnmatch import fnmatch

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carrel.functions.dates import first_of_month
from carrel.functions.hashing import hmac, row_hash
from carrel.functions.strings import unescape_udf, untag
from carrel.operators import scrub as sc

#: Names that the engine gives to columns of its own.
RESERVED = ("_src_hash", "_when_processed_utc", "trid", "_addition_only")
EXTRACTING = ("binary_to_text", "filename_to_text", "filename_format_to_text")


@dataclass(frozen=True)
class Rule:
    """One source column. ``alter`` holds steps such as ``truncate_date``, ``scrub``, ``hash=key``, ``html_untag``."""

    table: str
    column: str
    data_type: str = "string"
    length: int | None = None
    dest_table: str = ""
    dest_column: str = ""
    omit: bool = False
    pk: bool = False
    pid: bool = False
    mpid: bool = False
    third_party_pid: bool = False
    defines: bool = False
    opt_out: bool = False
    add_hash: bool = False
    constant: bool = False
    addition_only: bool = False
    scrub_source: str = ""  # "", patient, third_party
    scrub_method: str = ""
    required_scrubber: bool = False
    include: tuple[str | None, ...] = ()
    exclude: tuple[str | None, ...] = ()
    alter: tuple[str, ...] = ()
    index: str = ""

    @property
    def to_table(self) -> str:
        return self.dest_table or self.table

    @property
    def to_column(self) -> str:
        return self.dest_column or self.column

    def steps(self) -> tuple[str, ...]:
        """Extraction first, the others in their order; ``skip_if_extract_fails`` only modifies extraction."""
        first = [a for a in self.alter if a.split("=")[0] in EXTRACTING]
        return tuple(first + [a for a in self.alter if a.split("=")[0] not in EXTRACTING and a != "skip_if_extract_fails"])

    def errors(self) -> list[str]:
        out, ids = [], self.pid + self.mpid + self.third_party_pid
        where = f"{self.table}.{self.column}: "
        if ids > 1:
            out.append("at most one of pid, mpid, third_party_pid")
        if ids and self.alter:
            out.append("no alteration of an id")
        if (self.add_hash or self.constant) and not (self.pk and self.index == "unique"):
            out.append("hash and constant need a primary key with a unique index")
        if self.add_hash and self.constant:
            out.append("hash and constant exclude each other")
        if self.addition_only and not self.pk:
            out.append("addition_only needs a primary key")
        if self.to_column in RESERVED:
            out.append(f"{self.to_column} is reserved")
        if len([a for a in self.alter if a.split("=")[0] in EXTRACTING]) > 1:
            out.append("at most one extraction")
        if "truncate_date" in self.alter and (len(self.alter) > 1 or self.data_type not in ("date", "timestamp", "string")):
            out.append("truncate_date stands alone, on dates and texts")
        if self.scrub_method and self.scrub_method not in sc.METHODS:
            out.append(f"unknown scrub method {self.scrub_method}")
        if self.defines and not self.pid:
            out.append("only a pid defines patients")
        return [where + e for e in out]


class Dictionary:
    def __init__(self, rules: list[Rule]):
        self.rules = list(rules)

    def tables(self) -> list[str]:
        return list(dict.fromkeys(r.table for r in self.rules))

    def of(self, table: str) -> list[Rule]:
        return [r for r in self.rules if r.table == table]

    def one(self, table: str, attribute: str) -> Rule | None:
        return next((r for r in self.of(table) if getattr(r, attribute)), None)

    def errors(self, need_definer: bool = True) -> list[str]:
        if not self.rules:
            return ["empty dictionary"]
        out = [e for r in self.rules for e in r.errors()]
        for key, what in (((lambda r: (r.table, r.column)), "source"), ((lambda r: (r.to_table, r.to_column) if not r.omit else (r.table, r.column, "")), "destination")):
            seen = [key(r) for r in self.rules]
            out += [f"{what} column occurs twice: {'.'.join(k)}" for k in dict.fromkeys(k for k in seen if seen.count(k) > 1)]
        for t in self.tables():
            if len({r.to_table for r in self.of(t) if not r.omit}) > 1:
                out.append(f"{t} has several destinations")
            if sum(r.pk for r in self.of(t)) > 1:
                out.append(f"{t} has several primary keys")
            if any("scrub" in r.alter or r.scrub_source for r in self.of(t)) and not self.one(t, "pid"):
                out.append(f"{t} needs a pid")
            if any(r.omit and (r.add_hash or r.constant) for r in self.of(t)) and any(not r.omit for r in self.of(t)):
                out.append(f"{t}: hash or constant on an omitted key")
        if need_definer and not any(r.defines for r in self.rules):
            out.append("nothing defines patients")
        return out

    def check_against(self, tables: dict[str, DataFrame]) -> list[str]:
        out = []
        for r in self.rules:
            if r.table not in tables:
                out.append(f"no table {r.table}")
            elif r.column not in tables[r.table].columns:
                out.append(f"no column {r.table}.{r.column}")
        kinds = {tables[r.table].schema[r.column].dataType.simpleString() for r in self.rules if r.pid and r.table in tables and r.column in tables[r.table].columns}
        if any(k == "string" for k in kinds) and len(kinds) > 1:
            out.append(f"ids of several types: {sorted(kinds)}")
        return list(dict.fromkeys(out))

    def id_types(self, tables: dict[str, DataFrame]) -> list[tuple[str, str, bool]]:
        """Field, type and compatibility of every id column: whether it can be joined with the first that defines patients, as numbers or as texts."""
        family = lambda kind: "text" if kind in ("string", "varchar", "char") else "integer" if kind in ("tinyint", "smallint", "int", "bigint") or kind.startswith("decimal") and kind.endswith(",0)") else kind
        ids = [(f"{r.table}.{r.column}", tables[r.table].schema[r.column].dataType.simpleString(), r.defines) for r in self.rules if (r.pid or r.third_party_pid) and r.table in tables]
        first = next((family(kind) for _, kind, defines in ids if defines), family(ids[0][1]) if ids else "")
        return [(field, kind, family(kind) == first) for field, kind, _ in ids]

    def summary(self) -> list[dict]:
        return [{"table": t, "columns": len(self.of(t)), "omitted": sum(r.omit for r in self.of(t)), "has_pid": bool(self.one(t, "pid")), "has_mpid": bool(self.one(t, "mpid")), "pk": (self.one(t, "pk") or Rule("", "")).column, "scrubbed": sum("scrub" in r.alter for r in self.of(t)), "scrub_sources": sum(bool(r.scrub_source) for r in self.of(t))} for t in self.tables()]

    def filtered(self, omit: list[str] = (), drop: list[str] = ()) -> Dictionary:
        """Rows whose table.column matches a pattern of ``drop`` left out, of ``omit`` marked as omitted."""
        name = lambda r: f"{r.table}.{r.column}"
        kept = [r for r in self.rules if not any(fnmatch(name(r), p) for p in drop)]
        return Dictionary([Rule(**{**{f.name: getattr(r, f.name) for f in fields(r)}, "omit": True}) if any(fnmatch(name(r), p) for p in omit) else r for r in kept])

    def save(self, path: str) -> None:
        with open(path, "w", newline="", encoding="utf-8") as f:
            w = csv.DictWriter(f, [x.name for x in fields(Rule)], delimiter="\t")
            w.writeheader()
            for r in sorted(self.rules, key=lambda r: (r.table, r.column)):
                w.writerow({k: json.dumps(v) for k, v in asdict(r).items()})

    @classmethod
    def load(cls, path: str) -> Dictionary:
        with open(path, newline="", encoding="utf-8") as f:
            rows = [{k: json.loads(v) for k, v in row.items()} for row in csv.DictReader(f, delimiter="\t")]
        return cls([Rule(**{k: tuple(v) if isinstance(v, list) else v for k, v in row.items()}) for row in rows])


@dataclass(frozen=True)
class DraftSettings:
    """Patterns by which a draft classifies columns; scrub methods are tried in the order number, date, code, phrase, words."""

    pid: tuple[str, ...] = ("*.patient_id", "*.pid")
    mpid: tuple[str, ...] = ("*.nhsnum",)
    pk: tuple[str, ...] = ()
    definers: tuple[str, ...] = ("patient.*",)
    opt_out: tuple[str, ...] = ("*.optout",)
    patient_sources: tuple[str, ...] = ()
    third_party_sources: tuple[str, ...] = ()
    methods: tuple[tuple[str, tuple[str, ...]], ...] = ((sc.NUMBER, ("*phone*", "*num")), (sc.DATE, ("*dob*", "*date*")), (sc.CODE, ("*postcode*",)), (sc.PHRASE, ("*address*",)), (sc.WORDS, ("*name*",)))
    truncate: tuple[str, ...] = ("*.dob",)
    hashed: tuple[str, ...] = ()
    scrub_from: int = 50
    never_scrub: tuple[str, ...] = ()
    suffix: str = ""


def is_text(kind: T.DataType, length: int | None = None, least: int = 0) -> bool:
    """Whether a column is textual and may hold at least ``least`` characters; of unknown length it may."""
    return isinstance(kind, T.StringType) and (length is None or length >= least)


#: What columns of common record systems mean, by the pattern of their names: note and settings of the draft that they call for.
RECORD_SYSTEM_HINTS = (
    ("idpatient|patientid|clientid|patient_id|client_id", "patient number of the source system", "pid"),
    ("nhs*num*|nhsnum*|*nhs_number", "national number: a master id", "mpid"),
    ("rowidentifier|row_id|sequenceid|*_pk", "row number: a key", "pk"),
    ("*forename*|*firstname*|*surname*|*lastname*|*givenname*|*familyname*|*middlename*", "a name of the patient", "patient"),
    ("*addressline*|*houseno*|*nameofroad*|*postcode*|*full_address*", "an address of the patient", "patient"),
    ("*telephone*|*mobile*|*email*", "a way to reach the patient", "patient"),
    ("*nextofkin*|*carername*|*relationname*|*gpname*", "someone else's name", "third_party"),
    ("*freetext*|*notes|*note|*narrative*|*comment*", "free text", "scrub"),
    ("idorganisation|idprofile*|*staffid*|idstaff*", "who wrote it: of no use to research", "omit"),
)


def hints(table: str, column: str) -> list[tuple[str, str]]:
    """(note, what it calls for) of a column of a record system, by its name."""
    name = column.lower()
    return [(note, use) for patterns, note, use in RECORD_SYSTEM_HINTS if any(fnmatch(name, p) for p in patterns.split("|"))]


def annotated(tables: dict[str, DataFrame], settings: DraftSettings | None = None) -> tuple[Dictionary, list[tuple[str, str]]]:
    """A draft in which the hints of record systems are followed, and (field, note) of each column that has one."""
    drafted, notes, rules = draft(tables, settings or DraftSettings()), [], []
    for r in drafted.rules:
        values = {f.name: getattr(r, f.name) for f in fields(r)}
        for note, use in hints(r.table, r.column):
            notes.append((f"{r.table}.{r.column}", note))
            if use in ("pid", "mpid", "pk"):
                values |= {use: True, "alter": (), "omit": False, "scrub_source": "", "scrub_method": ""}
                values |= {"pid": {"dest_column": "rid", "index": "normal"}, "mpid": {"dest_column": "mrid", "index": "normal"}, "pk": {"index": "unique"}}[use]
            elif use in ("patient", "third_party"):
                values |= {"scrub_source": use, "scrub_method": sc.WORDS if "name" in note else sc.PHRASE if "address" in note else sc.CODE, "omit": True, "alter": ()}
            elif use == "scrub" and not values["alter"] and not values["omit"]:
                values["alter"] = ("scrub",)
            elif use == "omit":
                values["omit"] = True
        rules.append(Rule(**values))
    return Dictionary(rules), notes


def draft(tables: dict[str, DataFrame], settings: DraftSettings, lengths: dict[str, int] | None = None, known: Dictionary | None = None) -> Dictionary:
    """A first dictionary from the schemas; columns that ``known`` has are not drafted again."""
    have = {(r.table, r.column) for r in known.rules} if known else set()
    any_of = lambda name, patterns: any(fnmatch(name, p) for p in patterns)
    out = []
    for t, df in tables.items():
        has_pid = any(any_of(f"{t}.{c}", settings.pid) for c in df.columns)
        for i, f in enumerate(df.schema.fields):
            if (t, f.name) in have:
                continue
            name = f"{t}.{f.name}"
            pid, mpid = any_of(name, settings.pid), any_of(name, settings.mpid)
            pk = any_of(name, settings.pk) if settings.pk else i == 0 and not pid
            source = "patient" if any_of(name, settings.patient_sources) else "third_party" if any_of(name, settings.third_party_sources) else ""
            method = next((m for m, ps in settings.methods if any_of(f.name, ps)), "") if source else ""
            length = (lengths or {}).get(name)
            text = isinstance(f.dataType, T.StringType)
            alter: tuple[str, ...] = ()
            if not (pid or mpid):
                if any_of(name, settings.truncate):
                    alter = ("truncate_date",)
                elif any_of(name, settings.hashed):
                    alter = ("hash=extra",)
                elif has_pid and text and (length is None or length >= settings.scrub_from) and not any_of(name, settings.never_scrub) and not pk:
                    alter = ("scrub",)
            dest = f.name.removesuffix(settings.suffix) if settings.suffix else f.name
            out.append(Rule(t, f.name, f.dataType.simpleString(), length, t, {True: "rid"}.get(pid, "mrid" if mpid else dest), omit=bool(source) and not (pid or mpid), pk=pk, pid=pid, mpid=mpid, defines=pid and any_of(name, settings.definers), opt_out=any_of(name, settings.opt_out), scrub_source=source, scrub_method=method or (sc.default_method(f.dataType, length) if source else ""), alter=alter, index="unique" if pk else "normal" if pid or mpid else ""))
    return Dictionary(out)


def passes(column: Column, include: tuple, exclude: tuple) -> Column:
    """Inclusion and exclusion values, among which null is a value like others."""
    one_of = lambda values: F.coalesce(column.cast("string").isin([str(v) for v in values if v is not None]), F.lit(False)) | (column.isNull() if None in values else F.lit(False))
    keep = one_of(include) if include else F.lit(True)
    return keep & ~one_of(exclude) if exclude else keep


def altered(column: Column, steps: tuple[str, ...], keys: dict[str, str]) -> Column:
    """The steps that need the row alone; ``scrub`` is a step of the whole table."""
    for step in steps:
        name, _, arg = step.partition("=")
        if name == "truncate_date":
            column = first_of_month(column)
        elif name == "hash":
            column = hmac(column, keys[arg])
        elif name == "html_untag":
            column = untag(column)
        elif name == "html_unescape":
            column = unescape_udf(column)
        elif name != "scrub":
            raise ValueError(f"unknown step {step}")
    return column


@dataclass(frozen=True)
class Keys:
    pid: str = "pid-key"
    mpid: str = "mpid-key"
    change: str = "change-key"
    extra: dict[str, str] | None = None


def anonymised(df: DataFrame, rules: list[Rule], keys: Keys, scrub_sources: DataFrame | None = None, options: sc.Options | None = None) -> DataFrame:
    """A source table as its rules say: filtered, scrubbed, altered, with pseudonyms for ids; null mpids stay null, rows with a null pid go."""
    for r in rules:
        if r.include or r.exclude:
            df = df.where(passes(F.col(r.column), r.include, r.exclude))
    pid = next((r for r in rules if r.pid), None)
    if pid:
        df = df.where(F.col(pid.column).isNotNull())
    hashed = any(r.add_hash for r in rules)
    if hashed:
        df = df.withColumn("_src_hash", row_hash([F.col(r.column) for r in rules], keys.change))
    texts = [r.column for r in rules if "scrub" in r.alter and not r.omit]
    if texts and scrub_sources is not None:
        df = sc.scrub_notes(df, pid.column, texts, scrub_sources, options)
    out = []
    for r in rules:
        if r.omit:
            continue
        c = F.col(r.column)
        if r.pid or r.third_party_pid:
            c = hmac(c, keys.pid)
        elif r.mpid:
            c = hmac(c, keys.mpid)
        else:
            c = altered(c, r.steps(), keys.extra or {})
        out.append(c.alias(r.to_column))
    return df.select(*out, *([F.col("_src_hash")] if hashed else []))


def extracted_format(template: str) -> Column:
    """A file name from a template with {column} placeholders."""
    parts, at = [], 0
    import re

    for m in re.finditer(r"\{(\w+)\}", template):
        parts += [F.lit(template[at : m.start()]), F.col(m[1]).cast("string")]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))
