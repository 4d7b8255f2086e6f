"""Numeric results from notes. The notes are made of numbers of the tables, so that SQL can make and read them too."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from carrel.operators import nlp
from carrel.registry import Tables, query

c = F.col
#: Per processor: a text with {n} for a number, the value that a number n gives, and whether a whole number is meant.
SHAPES: dict[str, list[tuple[str, str]]] = {
    "CRP": [("CRP was {n} mg/L", "{n}"), ("C-reactive protein = {n} mg/dL.", "{n} * 10"), ("CRP (mg/L) {n}", "{n}")],
    "Sodium": [("Na {n} mM", "{n}"), ("sodium (mmol/L) {n}", "{n}"), ("Sodium {n} mEq/L", "{n}")],
    "Potassium": [("K {n}", "{n}"), ("potassium: {n} mmol/L", "{n}")],
    "Urea": [("urea {n} mmol/L", "{n}"), ("U {n}", "{n}")],
    "Creatinine": [("creatinine {n} micromol/L", "{n}"), ("Cr {n} mg/dL", "{n} * 10000 / 113.12")],
    "Lithium": [("Li {n} mmol/L", "{n}"), ("lithium level", "")],
    "TSH": [("TSH {n} mU/L", "{n}"), ("TSH {n} microU/mL", "{n}")],
    "AlkPhos": [("ALP {n} U/L", "{n}"), ("alkaline phosphatase {n} IU/L", "{n}")],
    "ALT": [("ALT {n} U/L", "{n}"), ("alanine aminotransferase {n}", "{n}")],
    "GammaGT": [("GGT {n} U/L", "{n}"), ("gamma GT {n}", "{n}")],
    "Bilirubin": [("bilirubin {n} micromol/L", "{n}"), ("total bilirubin {n}", "{n}")],
    "Albumin": [("albumin {n} g/L", "{n}"), ("alb {n}", "{n}")],
    "Glucose": [("glucose {n} mmol/L", "{n}"), ("glu {n} mg/dL", "{n} * 10 / 180.156")],
    "LDLCholesterol": [("LDL {n} mmol/L", "{n}"), ("LDL cholesterol {n} mg/dL", "{n} * 0.02586")],
    "HDLCholesterol": [("HDL {n} mmol/L", "{n}"), ("HDL chol {n} mg/dL", "{n} * 0.02586")],
    "TotalCholesterol": [("cholesterol {n} mmol/L", "{n}"), ("HDL cholesterol {n} mmol/L", "")],
    "Triglycerides": [("triglycerides {n} mmol/L", "{n}"), ("TG {n} mg/dL", "{n} * 0.01129")],
    "HbA1c": [("HbA1c {n} mmol/mol", "{n}"), ("HbA1c {n}%", "abs(({n} - 2.152) * 10.93135)")],
    "Height": [("height {n} cm", "{n} * 0.01"), ("height was {n} m", "{n}"), ("height {n} ft 2 in", "({n} * 12 + 2) * 0.0254")],
    "Weight": [("weight {n} kg", "{n}"), ("weight {n} st 3 lb", "({n} * 14 + 3) * 0.45359237"), ("weight {n}", "")],
    "BMI": [("BMI {n}", "{n}"), ("body mass index {n} kg/m^2", "{n}")],
    "Haemoglobin": [("Hb {n} g/L", "{n}"), ("haemoglobin {n} g/dL", "{n} * 10")],
    "Haematocrit": [("haematocrit {n} L/L", "{n}"), ("Hct {n}", "{n}")],
    "RBC": [("RBC {n} x 10^12/L", "{n}"), ("red blood cells {n} per cubic mm", "{n} * 0.000001")],
    "ESR": [("ESR {n} mm/h", "{n}"), ("ESR was {n}", "{n}")],
    "WBC": [("WBC {n} x 10^9/L", "{n}"), ("white cell count {n} /mm3", "{n} * 0.001")],
    "Neutrophils": [("neutrophils {n} x 10^9/L", "{n}"), ("absolute neutrophil count {n}", "{n}")],
    "Lymphocytes": [("lymphocytes {n} x 10^9/L", "{n}"), ("lymph {n}", "{n}")],
    "Monocytes": [("monocytes {n} x 10^9/L", "{n}"), ("mono {n}", "{n}")],
    "Basophils": [("basophils {n} x 10^9/L", "{n}"), ("baso {n}", "{n}")],
    "Eosinophils": [("eosinophils {n} x 10^9/L", "{n}"), ("eos {n}", "{n}")],
    "Platelets": [("platelets {n} x 10^9/L", "{n}"), ("plts {n}", "{n}")],
    "MMSE": [("MMSE {n}/30", "CASE WHEN {n} <= 30 THEN {n} END"), ("MMSE {n} out of 100", "NULL"), ("mini-mental state {n}", "CASE WHEN {n} <= 30 THEN {n} END")],
    "ACE": [("ACE-R {n}/100", "CASE WHEN {n} <= 100 THEN {n} END"), ("ACE-III {n}/50", "NULL")],
    "MiniACE": [("mini-ACE {n}/30", "CASE WHEN {n} <= 30 THEN {n} END"), ("M-ACE {n}", "CASE WHEN {n} <= 30 THEN {n} END")],
    "MOCA": [("MOCA {n}/30", "CASE WHEN {n} <= 30 THEN {n} END"), ("Montreal cognitive assessment {n}", "CASE WHEN {n} <= 30 THEN {n} END")],
    "AlcoholUnits": [("Drinks {n} units per week", "{n}"), ("alcohol {n} units/day", "{n} * 7"), ("Alcohol: none", "0"), ("used to drink {n} u/w", "{n}")],
}


def _oracle(shapes: list[tuple[str, str]]) -> str:
    rows = []
    for i, (_, value) in enumerate(shapes):
        if value:
            rows.append(f"SELECT p_partkey AS pk, round(({value.format(n='n')})::DOUBLE, 9) AS value FROM x WHERE p_partkey % {len(shapes)} = {i}")
    return "WITH x AS (SELECT p_partkey, (p_size + p_partkey % 10 / 10.0)::DOUBLE AS n FROM part) " + " UNION ALL ".join(rows)


def _notes(t: Tables, shapes: list[tuple[str, str]]):
    k = c("p_partkey")
    n = F.concat(F.col("p_size").cast("string"), F.lit("."), (k % 10).cast("string"))
    text = None
    for i, (shape, _) in enumerate(shapes):
        before, _, after = shape.partition("{n}")
        one = F.concat(F.lit("Seen today. " + before), n, F.lit(after)) if "{n}" in shape else F.lit("Seen today. " + shape)
        text = F.when(k % len(shapes) == i, one) if text is None else text.when(k % len(shapes) == i, one)
    return t.part.select(k, text.alias("note"))


def _register(name: str, shapes: list[tuple[str, str]]) -> None:
    @query(f"np_{name.lower()}", _oracle(shapes))
    def _(t: Tables):
        return nlp.run(_notes(t, shapes), "p_partkey", "note", [name]).select("pk", F.round("value", 9).alias("value"))


for _name, _shapes in SHAPES.items():
    _register(_name, _shapes)


@query("np_bp", "SELECT p_partkey AS pk, CASE p_partkey % 3 WHEN 2 THEN NULL ELSE (p_size + 80)::DOUBLE END AS systolic, CASE p_partkey % 3 WHEN 1 THEN NULL WHEN 0 THEN (p_size + 40)::DOUBLE ELSE (p_size + 80)::DOUBLE END AS diastolic FROM part")
def _(t: Tables):
    k, s = c("p_partkey"), c("p_size")
    high = (s + 80).cast("string")
    note = F.when(k % 3 == 0, F.concat(F.lit("BP "), high, F.lit("/"), (s + 40).cast("string"), F.lit(" mmHg"))).when(k % 3 == 1, F.concat(F.lit("systolic BP was "), high)).otherwise(F.concat(F.lit("DBP: "), high))
    return nlp.run(t.part.select(k, note.alias("note")), "p_partkey", "note", ["BP"]).select("pk", c("value").alias("systolic"), c("value2").alias("diastolic"))


@query("nlp_02_details", "SELECT p_partkey AS pk, 'CRP' AS variable_text, CASE p_partkey % 3 WHEN 0 THEN '<' WHEN 1 THEN '>=' ELSE '=' END AS relation, CASE WHEN p_partkey % 3 = 2 THEN 'past' END AS tense, 'mg/L' AS units, 5::INT AS start FROM part")
def _(t: Tables):
    k = c("p_partkey")
    how = F.when(k % 3 == 0, "less than ").when(k % 3 == 1, ">= ").otherwise("was ")
    note = F.concat(F.lit("Seen CRP "), how, c("p_size").cast("string"), F.lit(" mg/L"))
    return nlp.run(t.part.select(k, note.alias("note")), "p_partkey", "note", ["CRP"]).select("pk", "variable_text", "relation", "tense", "units", "start")


@query("nlp_01_conditional", "SELECT p_partkey AS pk, p_size::DOUBLE AS value FROM part WHERE p_partkey % 3 = 0")
def _(t: Tables):
    k = c("p_partkey")
    note = F.concat(F.when(k % 3 == 0, "and the CRP ").when(k % 3 == 1, "if the CRP ").otherwise("when CRP "), c("p_size").cast("string"))
    return nlp.run(t.part.select(k, note.alias("note")), "p_partkey", "note", ["CRP"]).select("pk", "value")


@query("nlp_09_recall", "SELECT p_partkey AS pk FROM part WHERE p_partkey % 4 = 1")
def _(t: Tables):
    k = c("p_partkey")
    note = F.when(k % 4 == 1, "CRP raised").when(k % 4 == 2, F.concat(F.lit("CRP "), c("p_size").cast("string"))).otherwise("well")
    return nlp.missed(t.part.select(k, note.alias("note")), "p_partkey", "note", "CRP")


def _all() -> str:
    """Every part's note holds a result of every processor."""
    n = "(p_size + p_partkey % 10 / 10.0)::DOUBLE"
    values = {name: shapes[0][1].format(n=n) for name, shapes in SHAPES.items()}
    rows = [f"SELECT p_partkey AS pk, '{name}' AS processor, round(({value})::DOUBLE, 9) AS value FROM part" for name, value in values.items()]
    rows.append("SELECT p_partkey, 'BP', 120.0::DOUBLE FROM part")
    return "SELECT * FROM (" + " UNION ALL ".join(rows) + ") WHERE value IS NOT NULL"


@query("nlp_all_processors", _all())
def _(t: Tables):
    n = F.concat(F.col("p_size").cast("string"), F.lit("."), (c("p_partkey") % 10).cast("string"))
    said = []
    for shapes in SHAPES.values():
        before, _, after = shapes[0][0].partition("{n}")
        said += [F.lit(before), n, F.lit(after + ". ")]
    notes = t.part.select("p_partkey", F.concat(*said, F.lit("BP 120/80 today.")).alias("note"))
    return nlp.run(notes, "p_partkey", "note").where("value IS NOT NULL").select("pk", "processor", F.round("value", 9).alias("value"))


@query("nlp_documents")
def _(t: Tables):
    """All processors over all documents; invented prose holds no results, so tests hold it against a walk by hand."""
    return nlp.run(t.documents, "doc_id", "text")


@query("inc_04_reprocess", "SELECT conv_id, turn FROM conversations WHERE conv_id % 5 IN (0, 1)")
def _(t: Tables):
    """Notes to be processed: those without progress, or with another text since."""
    notes = t.conversations.select("conv_id", "turn", F.xxhash64("text").alias("h"))
    done = notes.where("conv_id % 5 <> 0").withColumn("h", F.when(c("conv_id") % 5 == 1, F.lit(0).cast("long")).otherwise(c("h")))
    return notes.join(done, ["conv_id", "turn", "h"], "left_anti").select("conv_id", "turn")


@query("inc_05_vanished_sources", "SELECT conv_id, turn FROM conversations WHERE conv_id % 4 <> 2")
def _(t: Tables):
    from carrel.operators.relational import keep_existing

    results = t.conversations.select("conv_id", F.when(c("conv_id") % 3 != 0, c("turn")).alias("key2"), "turn")
    source = t.conversations.where("conv_id % 4 <> 2").select(c("conv_id").alias("k"), F.when(c("conv_id") % 3 != 0, c("turn")).alias("k2"))
    return keep_existing(results, source, [("conv_id", "k"), ("key2", "k2")]).select("conv_id", "turn")


@query("np_39_external_program")
def _(t: Tables):
    """The hook for external programs: a function from batches to rows; here the sizes of texts stand for a program's output."""

    def program(batches):
        for b in batches:
            yield pd.DataFrame({"pk": b["doc_id"], "n": b["text"].fillna("").str.len()})

    return nlp.external(t.documents, "doc_id", "text", program, "pk long, n long")
