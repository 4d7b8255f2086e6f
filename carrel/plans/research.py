"""The research layer: queries built on linked tables, with joins inferred from how the tables are related."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Table:
    """A table with the columns that identify patients: within a database (trid), within a family of databases (rid), and for all (mrid)."""

    name: str
    database: str
    columns: tuple[str, ...]
    trid: str | None = "trid"
    rid: str | None = "rid"
    mrid: str | None = None
    date: str | None = None
    family: str = "main"


@dataclass
class Catalog:
    tables: dict[str, Table]
    default_dates: tuple[str, ...] = ("created_at", "date", "ts")

    def get(self, name: str) -> Table:
        if name not in self.tables:
            raise KeyError(f"unknown table {name}")
        return self.tables[name]

    def mrid_table(self, database: str) -> Table | None:
        return next((t for t in self.tables.values() if t.database == database and t.mrid), None)

    def date_of(self, name: str) -> str | None:
        t = self.get(name)
        return t.date or next((d for d in self.default_dates if d in t.columns), None)

    def with_column(self, column: str) -> list[str]:
        return sorted(t.name for t in self.tables.values() if column in t.columns)

    def listing(self) -> list[tuple[str, str, str]]:
        return [(t.database, t.name, c) for t in sorted(self.tables.values(), key=lambda t: (t.database, t.name)) for c in t.columns]


@dataclass
class Select:
    """A SELECT that grows: columns, tables with joins, conditions, DISTINCT."""

    catalog: Catalog
    columns: list[str] = field(default_factory=list)
    tables: list[str] = field(default_factory=list)
    joins: list[str] = field(default_factory=list)
    where: str = ""
    distinct: bool = False

    def add_table(self, name: str, join: str | None = None, on: str | None = None) -> Select:
        """Joins a table that is not there yet: as told, or by how it is related to those that are."""
        if name in self.tables:
            return self
        new = self.catalog.get(name)
        if not self.tables:
            self.tables.append(name)
            return self
        if join:
            self.joins.append(f"{join} {name}" + (f" ON {on}" if on else ""))
            self.tables.append(name)
            return self
        old = self.catalog.get(self.tables[0])
        if old.database == new.database and old.trid and new.trid:
            self.joins.append(f"INNER JOIN {name} ON {name}.{new.trid} = {old.name}.{old.trid}")
        elif old.family == new.family and old.rid and new.rid:
            self.joins.append(f"INNER JOIN {name} ON {name}.{new.rid} = {old.name}.{old.rid}")
        else:
            a, b = self.catalog.mrid_table(old.database), self.catalog.mrid_table(new.database)
            if not a or not b:
                raise ValueError(f"{old.name} and {name} cannot be linked")
            if a.name not in self.tables:
                self.joins.append(f"INNER JOIN {a.name} ON {a.name}.{a.trid} = {old.name}.{old.trid}")
                self.tables.append(a.name)
            if b.name not in self.tables:
                self.joins.append(f"INNER JOIN {b.name} ON {b.name}.{b.mrid} = {a.name}.{a.mrid}")
                self.tables.append(b.name)
            if b.name != name:
                self.joins.append(f"INNER JOIN {name} ON {name}.{new.trid} = {b.name}.{b.trid}")
        if name not in self.tables:
            self.tables.append(name)
        return self

    def add_column(self, table: str, column: str, alias: str | None = None) -> Select:
        self.add_table(table)
        self.columns.append(f"{table}.{column}" + (f" AS {alias}" if alias else ""))
        return self

    def add_where(self, condition: str, table: str | None = None, how: str = "AND", bracket: bool = False) -> Select:
        if table:
            self.add_table(table)
        condition = f"({condition})" if bracket else condition
        self.where = f"{self.where} {how} {condition}" if self.where else condition
        return self

    def set_distinct(self, on: bool | None = None) -> Select:
        self.distinct = (not self.distinct) if on is None else on
        return self

    def sql(self) -> str:
        out = f"SELECT {'DISTINCT ' if self.distinct else ''}{', '.join(self.columns) or '*'} FROM {self.tables[0]}"
        out += "".join(f" {j}" for j in self.joins)
        return out + (f" WHERE {self.where}" if self.where else "")

    def run(self, spark: SparkSession) -> DataFrame:
        return spark.sql(self.sql())


def literal(value, kind: str = "string") -> str:
    """A value as SQL: texts and dates quoted, numbers as they are."""
    if value is None:
        return "NULL"
    if kind in ("int", "float", "number"):
        float(value)
        return str(value)
    quoted = "'" + str(value).replace("'", "''") + "'"
    return f"DATE {quoted}" if kind == "date" else quoted


#: Comparisons that a query may use.
OPERATORS = ("<", "<=", "=", "<>", ">=", ">", "IN", "NOT IN", "LIKE", "REGEXP", "IS NULL", "IS NOT NULL")


def condition(column: str, operator: str, value=None, kind: str = "string") -> str:
    if operator not in OPERATORS:
        raise ValueError(f"unknown operator {operator}")
    if operator.startswith("IS"):
        return f"{column} {operator}"
    if operator.endswith("IN"):
        return f"{column} {operator} ({', '.join(literal(v, kind) for v in value)})"
    return f"{column} {'RLIKE' if operator == 'REGEXP' else operator} {literal(value, kind)}"


def identity(sql: str) -> str:
    """Equal queries have equal identities."""
    return hashlib.sha256(" ".join(sql.split()).encode()).hexdigest()


def filled(template: str, values: dict[str, str]) -> str:
    """A template with [[name]] placeholders filled in; unknown ones are an error."""
    return re.sub(r"\[\[(\w+)\]\]", lambda m: values[m[1]], template)


def privileged(sql: str, ids: dict[str, str]) -> str:
    """``~pid = value`` and ``~pid IN (...)`` as conditions on rid through a secret map; unknown ids match nothing."""

    def rid(v: str) -> str:
        return literal(ids.get(v.strip().strip("'"), ""))

    sql = re.sub(r"~pid\s*=\s*('[^']*'|\w+)", lambda m: f"rid = {rid(m[1])}", sql)
    return re.sub(r"~pid\s+IN\s*\(([^)]*)\)", lambda m: "rid IN (" + ", ".join(rid(v) for v in m[1].split(",")) + ")", sql, flags=re.I)
