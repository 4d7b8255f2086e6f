"""Files in and out: delimited texts, spreadsheets in zips, id lists, documents, person files."""

from __future__ import annotations

import html
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carrel.operators.relational import cast_inferred, infer_types


def delimited(spark: SparkSession, path: str, sep: str = "\t", comment: str = "#") -> DataFrame:
    """A file with a header row, all columns as texts; blank and comment rows are skipped."""
    return spark.read.csv(path, sep=sep, header=True, comment=comment, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).na.drop("all")


def xlsx_rows(data: bytes) -> Iterator[tuple[str, list[list[str | None]]]]:
    """Sheets of a workbook as (name, rows of texts), without a spreadsheet library."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        names = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).find("m:sheets", ns)]
        for i, name in enumerate(names, 1):
            rows = []
            for row in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{i}.xml")).iter(f"{{{ns['m']}}}row"):
                cells: dict[int, str | None] = {}
                for c in row.findall("m:c", ns):
                    letters = re.match(r"[A-Z]+", c.get("r") or "A")[0]
                    at = 0
                    for ch in letters:
                        at = at * 26 + ord(ch) - 64
                    v = c.find("m:v", ns)
                    if c.get("t") == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t"))
                    elif v is not None:
                        cells[at] = shared[int(v.text)] if c.get("t") == "s" else v.text
                rows.append([cells.get(k) for k in range(1, max(cells, default=0) + 1)])
            yield name, rows


def xlsx_bytes(sheets: dict[str, list[list]]) -> bytes:
    """A workbook of texts and numbers."""
    out = io.BytesIO()
    escape = lambda v: html.escape(str(v), quote=False)

    def column(i: int) -> str:
        s = ""
        while i:
            i, r = divmod(i - 1, 26)
            s = chr(65 + r) + s
        return s

    def cell(v, r: int, c: int) -> str:
        at = f"{column(c)}{r}"
        if v is None:
            return ""
        if isinstance(v, int | float) and not isinstance(v, bool):
            return f'<c r="{at}"><v>{v}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t>{escape(v)}</t></is></c>'

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData>' + "".join(f'<row r="{r}">' + "".join(cell(v, r, c) for c, v in enumerate(row, 1)) + "</row>" for r, row in enumerate(rows, 1)) + "</sheetData></worksheet>")
    return out.getvalue()


def zip_members(data: bytes) -> Iterator[tuple[str, bytes]]:
    """Files of a zip, and of zips in it."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for name in z.namelist():
            if name.endswith("/"):
                continue
            inner = z.read(name)
            if name.lower().endswith(".zip"):
                yield from zip_members(inner)
            else:
                yield name, inner


def auto_import(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of a csv, tsv, xlsx or zip of them, with types inferred from all values. For files that one machine can hold."""
    binary = spark.read.format("binaryFile").load(path).select("path", "content").collect()
    out: dict[str, DataFrame] = {}

    def add(name: str, rows: list[list]) -> None:
        rows = [r for r in rows if any(v not in (None, "") for v in r) and not str(r[0] or "").startswith("#")]
        if not rows:
            return
        head = [str(h) for h in rows[0]]
        body = [tuple((str(r[i]) if i < len(r) and r[i] is not None else None) for i in range(len(head))) for r in rows[1:]]
        df = spark.createDataFrame(body, T.StructType([T.StructField(h, T.StringType()) for h in head]))
        out[name] = cast_inferred(df, infer_types(df)) if body else df

    for row in binary:
        name = row["path"].rsplit("/", 1)[-1]
        members = zip_members(bytes(row["content"])) if name.lower().endswith(".zip") else [(name, bytes(row["content"]))]
        for member, data in members:
            stem, _, ext = member.rsplit("/", 1)[-1].rpartition(".")
            if ext.lower() in ("csv", "tsv", "txt"):
                import csv

                add(stem, list(csv.reader(io.StringIO(data.decode("utf-8-sig")), delimiter="," if ext.lower() == "csv" else "\t")))
            elif ext.lower() == "xlsx":
                for sheet, rows in xlsx_rows(data):
                    add(sheet, rows)
    return out


def ids(spark: SparkSession, path: str, kind: str = "string") -> DataFrame:
    """id: words of a text file."""
    return spark.read.text(path).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("id")).where("id <> ''").select(F.col("id").try_cast(kind).alias("id")).where("id IS NOT NULL").distinct()


_RTF_GROUP = re.compile(r"\{\\\*?\\?(?:fonttbl|colortbl|stylesheet|info|pict|\*)[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", re.S)


def document_text(data: bytes | None, extension: str) -> str | None:
    """Text of a document; None if the kind is not known or the document cannot be read."""
    if data is None:
        return None
    ext = extension.lower().lstrip(".")
    try:
        if ext in ("txt", "csv", "tsv", "md", "log"):
            return data.decode("utf-8", "replace")
        if ext in ("htm", "html", "xml"):
            return html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"(?is)<(script|style).*?</\1>", " ", data.decode("utf-8", "replace")))).strip()
        if ext == "rtf":
            t = _RTF_GROUP.sub("", data.decode("latin-1"))
            t = re.sub(r"\\par[d]?\b ?", "\n", t)
            t = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes.fromhex(m[1]).decode("cp1252", "replace"), t)
            t = re.sub(r"\\u(-?\d+) ?\??", lambda m: chr(int(m[1]) % 65536), t)
            return re.sub(r"[{}]", "", re.sub(r"\\[a-zA-Z]+-?\d* ?", "", t)).strip()
        if ext in ("docx", "odt"):
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                x = z.read("word/document.xml" if ext == "docx" else "content.xml").decode("utf-8", "replace")
            return html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</(?:w:p|text:p|text:h)>", "\n", x))).strip()
    except (zipfile.BadZipFile, KeyError, ValueError):
        return None
    return None


def document_texts(df: DataFrame, content: str, extension: str, dest: str = "text", skip_failed: bool = False) -> DataFrame:
    """``df`` with the text of a binary column; failed extractions are null, or their rows dropped."""

    @F.pandas_udf(T.StringType())
    def extract(data: pd.Series, ext: pd.Series) -> pd.Series:
        return pd.Series([document_text(None if d is None else bytes(d), e or "") for d, e in zip(data, ext, strict=True)], dtype=object)

    out = df.withColumn(dest, extract(F.col(content), F.col(extension)))
    return out.where(F.col(dest).isNotNull()) if skip_failed else out


#: Columns of a person file; names and postcodes hold ``;``-lists of ``name/from/to``.
PERSON = "local_id string, forenames string, surnames string, dob string, gender string, postcodes string, perfect_id string, other_info string"


def people(spark: SparkSession, path: str) -> DataFrame:
    """Persons from CSV (plain text) or JSON lines (plain text or hashed)."""
    if path.endswith(".csv"):
        return spark.read.csv(path, header=True, schema=PERSON)
    return spark.read.json(path)


def temporal(c) -> object:
    """A ``;``-list of ``name/from/to`` as an array of structs; a Column."""
    part = lambda x, i: F.nullif(F.trim(F.get(F.split(x, "/"), F.lit(i))), F.lit(""))
    return F.transform(F.filter(F.split(c, ";"), lambda x: F.trim(x) != ""), lambda x: F.struct(part(x, 0).alias("name"), part(x, 1).try_cast("date").alias("from"), part(x, 2).try_cast("date").alias("to")))


def tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True)


def tsv_zip(tables: dict[str, DataFrame], path: str) -> None:
    """Query results as a zip of TSV files, each streamed row by row through the driver."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, df in tables.items():
            with z.open(f"{name}.tsv", "w") as f:
                f.write(("\t".join(df.columns) + "\n").encode())
                for row in df.toLocalIterator():
                    f.write(("\t".join("" if v is None else str(v).replace("\t", " ").replace("\n", " ") for v in row) + "\n").encode())


def xlsx(tables: dict[str, DataFrame], most_rows: int = 1_048_575) -> bytes:
    """Query results as a workbook, a sheet each, with a header row. A sheet has no room for more than ``most_rows``: beyond it a ValueError."""
    sheets = {}
    for name, df in tables.items():
        rows = df.limit(most_rows + 1).collect()
        if len(rows) > most_rows:
            raise ValueError(f"{name} has more rows than a sheet holds: export it as TSV")
        sheets[name[:31]] = [df.columns, *([v if v is None or isinstance(v, int | float) and not isinstance(v, bool) else str(v) for v in r] for r in rows)]
    return xlsx_bytes(sheets)


def zipped(df: DataFrame, name: str, member_rows: int = 1_000_000) -> DataFrame:
    """member and content (the bytes of a zip with one TSV in it): a row for each partition of at most ``member_rows`` rows, made in the executors."""

    def run(batches):
        held, size, part = [], 0, 0

        def packed():
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr(f"{name}.tsv", "\t".join(columns) + "\n" + "".join(held))
            return pd.DataFrame({"member": [f"{name}-{spark_partition()}-{part}.zip"], "content": [out.getvalue()]})

        for b in batches:
            rows = b.astype(object).where(b.notna(), "").itertuples(index=False)
            held += ["\t".join(str(v).replace("\t", " ").replace("\n", " ") for v in r) + "\n" for r in rows]
            size += len(b)
            if size >= member_rows:
                yield packed()
                held, size, part = [], 0, part + 1
        if held:
            yield packed()

    def spark_partition() -> int:
        from pyspark import TaskContext

        return TaskContext.get().partitionId()

    columns = df.columns
    return df.mapInPandas(run, "member string, content binary")


def unzipped(zips: DataFrame) -> DataFrame:
    """member and line of every text line in the zips of the column ``content``."""

    def run(batches):
        for b in batches:
            rows = [(m, line) for content in b["content"] for m, data in zip_members(bytes(content)) for line in data.decode("utf-8", "replace").splitlines()]
            yield pd.DataFrame(rows, columns=["member", "line"])

    return zips.select("content").mapInPandas(run, "member string, line string")


#: Columns of a postcode directory that are dates and numbers; all others are texts.
POSTCODE_DATES, POSTCODE_NUMBERS = ("dointr", "doterm"), ("oseast1m", "osnrth1m", "osgrdind", "lat", "long", "imd")


def postcode_directory(spark: SparkSession, path: str, dates: tuple[str, ...] = POSTCODE_DATES, numbers: tuple[str, ...] = POSTCODE_NUMBERS) -> DataFrame:
    """A postcode directory in CSV: blank values are null, dates (YYYYMM or ISO) and numbers are cast, and the compact postcode is added as ``pcd_nospace``."""
    raw = spark.read.csv(path, header=True)
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    month = lambda c: blank(c).rlike("^[0-9]{6}$")
    day = lambda c: F.when(month(c), F.try_to_timestamp(F.concat(blank(c), F.lit("01")), F.lit("yyyyMMdd")).cast("date")).otherwise(blank(c).try_cast("date"))
    out = [day(c).alias(c) if c in dates else blank(c).try_cast("double").alias(c) if c in numbers else blank(c).alias(c) for c in raw.columns]
    return raw.select(*out, F.upper(F.regexp_replace(F.col(raw.columns[0]), r"\s", "")).alias("pcd_nospace"))
