import pytest

from carrel.operators import nlp

CASES = [
    # Layouts, signs, fillers.
    ("CRP", "Bloods back: CRP 41.5 mg/L today.", [41.5]),
    ("CRP", "c-reactive  protein | 7", [7]),
    ("CRP", "CRP (mg per litre): 12", [12]),
    ("CRP", "CRP (8.2 mg/L)", [8.2]),
    ("CRP", "CRP (19) mg / L", [19]),
    ("CRP", "CRP 2.5 mg/dL, then CRP 31 mg L-1", [25, 31]),
    ("CRP", "CRP (H) * 2,048", [2048]),
    ("CRP", "CRP − 14", [14]),
    ("CRP", "CRP awaited", []),
    ("CRP", "CRPs 5", []),
    ("CRP", "If the CRP 90 we would admit. When CRP 80 call.", []),
    ("CRP", "Serum C reactive protein level (XaINL) 3 mg/L", [3]),
    ("CRP", "CRP POC 22", [22]),
    # Units and factors.
    ("Sodium", "Na (mmol/L) 139 and sodium 141 mEq per litre", [139, 141]),
    ("Creatinine", "Creat 0.9 mg/dl", [0.9 * 10_000 / 113.12]),
    ("Creatinine", "creatinine 88 µmol/L; Cr 70 uM", [88, 70]),
    ("TSH", "TSH 2.1 mIU/L, thyroid-stimulating hormone 3 microunits/ml", [2.1, 3]),
    ("AlkPhos", "alk. phos. 95 IU/L", [95]),
    ("GammaGT", "gamma-glutamyl transferase 33 U/L; γGT 12", [33, 12]),
    ("Glucose", "30 minute plasma glucose level 11.1 mmol/L", [11.1]),
    ("HbA1c", "glycated haemoglobin 6.5 per cent", [(6.5 - 2.152) * 10.93135]),
    ("HbA1c", "HbA1c 0 %", [None]),
    ("LDLCholesterol", "LDL-cholesterol 3.1 mmol/L, HDL 1.2", [3.1]),
    ("TotalCholesterol", "HDL chol. 1.2, LDL-chol 2.2, total cholesterol 4.9 mmol/L", [4.9]),
    ("Platelets", "plt count 250 x 10^9/L; platelets 180*10**9 / l", [250, 180]),
    ("RBC", "red blood cells (RBC) 4.7 x10e12/L", [4.7]),
    ("WBC", "white cell count 7200 cells/mm^3, WCC 7400 per cubic mm", [7.2, 7.4]),
    ("Neutrophils", "absolute neutrophil count 3.3", [3.3]),
    ("BMI", "body mass index 24.2 kg m^-2, BMI 25 kg/m2", [24.2, 25]),
    ("ESR", "ESR 14 mm/hr", [14]),
    # Measures.
    ("Height", "height 1 m 82 cm; height 1.74 metres; height was 160cm", [1.82, 1.74, 1.6]),
    ("Height", "height 6 ft 1 in, later height 6'", [73 * 0.0254, 72 * 0.0254]),
    ("Weight", "weighs 12 stone 5 pounds", [173 * 0.45359237]),
    ("Weight", "weight change: weight -2 kg", [-2]),
    ("Weight", "weight 80", []),
    # Scores.
    ("MMSE", "mini-mental state examination scored 28 out of 30", [28]),
    ("MMSE", "MMSE 21/27", [None]),
    ("MMSE", "MMSE 44", [None]),
    ("ACE", "ACE 3/100; ACE-3 91/100; ACE III 82; Addenbrooke's cognitive examination 77", [3, 91, 82, 77]),
    ("MiniACE", "M-ACE 24/30", [24]),
    ("MOCA", "Montreal Cognitive Assessment was 19/30", [19]),
    # Drinking.
    ("AlcoholUnits", "Currently drinking 3 units per day", [21]),
    ("AlcoholUnits", "alcohol: 12 u/wk", [12]),
    ("AlcoholUnits", "used to drink 40 UK units a month, now none", []),
    ("AlcoholUnits", "used to drink 87 UK units per month", [87 / 4.35]),
    ("AlcoholUnits", "Tee-total. Drinks no alcohol. Abstinent from alcohol. Does not drink alcohol.", [0, 0, 0, 0]),
    ("AlcoholUnits", "insulin 6 units per day", []),
    ("AlcoholUnits", "alcohol gel used", []),
]


@pytest.mark.parametrize(("name", "text", "values"), CASES)
def test_values(name, text, values):
    assert [f.value for f in nlp.PROCESSORS[name].parse(text)] == pytest.approx(values)


@pytest.mark.parametrize(
    ("text", "pairs"),
    [("BP to be taken", []), ("Blood pressure is 131/84 mmHg", [(131, 84)]), ("SBP 118, DBP: 71", [(118, None), (None, 71)]), ("systolic blood pressure was 144", [(144, None)]), ("BP 126 over 79", [(126, 79)]), ("B.P. 101", [])],
)
def test_blood_pressure(text, pairs):
    assert [(f.value, f.value2) for f in nlp.PROCESSORS["BP"].parse(text)] == pairs


@pytest.mark.parametrize(
    ("text", "tense", "relation", "said"),
    [("urea was 4", "past", "=", None), ("urea is >= 9", "present", ">=", ">="), ("urea greater than 30", None, ">", "greater than"), ("urea < 2", None, "<", "<"), ("urea 3", None, "=", None), ("urea equal to 6", None, "=", "equal to")],
)
def test_tense_and_relation(text, tense, relation, said):
    (f,) = nlp.PROCESSORS["Urea"].parse(text)
    assert (f.tense, f.relation, f.relation_text) == (tense, relation, said)


def test_where_results_stand():
    text = "Seen. Na was <= 130 mmol/L (low)."
    (f,) = nlp.PROCESSORS["Sodium"].parse(text)
    assert text[f.start : f.end] == f.content == "Na was <= 130 mmol/L" and (f.variable_text, f.value_text, f.units) == ("Na", "130", "mmol/L")


@pytest.mark.parametrize(("text", "tense"), [("previously drank 10 units per week", "past"), ("drinks 10 units per week", "present"), ("alcohol 10 units per week at present", "present"), ("alcohol was 10 units per week", "past"), ("never alcohol", "ever")])
def test_when_alcohol_was_drunk(text, tense):
    assert [f.tense for f in nlp.PROCESSORS["AlcoholUnits"].parse(text)] == [tense]


def test_numbers():
    assert [nlp.to_float(x) for x in ("12,345.5", "−7", "–0.5", "+4", "4.", "", None, "x")] == [12345.5, -7, -0.5, 4, None, None, None, None]
    assert nlp.total({"stone": 1, "pound": 2, "ounce": 8}, nlp.KG_PER) == pytest.approx(16.5 * 0.45359237)


def test_every_processor_reads_its_own_names():
    for p in nlp.PROCESSORS.values():
        for s in p.spellings:
            if isinstance(p, nlp.Measure | nlp.BloodPressure | nlp.Alcohol):
                continue
            found = [f.value for f in p.parse(f"The {s} 11 today")]
            assert found == [11], (p.name, s)


def test_all_processors_in_one_pass(spark):
    rows = spark.createDataFrame([(1, "Hb 131 g/L, K 4.4 and BP 122/76; teetotal"), (2, None), (3, ""), (4, "well"), (5, "字")], "pk long, note string")
    got = {(r.processor, r.value, r.value2) for r in nlp.run(rows, "pk", "note").collect()}
    assert got == {("Haemoglobin", 131.0, None), ("Potassium", 4.4, None), ("BP", 122.0, 76.0), ("AlcoholUnits", 0.0, None)}


def test_odd_texts_take_no_time():
    for text in ("CRP " + " " * 200_000 + "x", "CRP " + "-" * 50_000, "alcohol at " * 20_000, "CRP " * 50_000, "9" * 100_000):
        for p in nlp.PROCESSORS.values():
            assert list(p.parse(text)) == []
