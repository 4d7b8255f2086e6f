"""Names of quantities as primary-care systems write them, with their codes."""

#: Processor -> code and phrase.
READ_NAMES: dict[str, tuple[tuple[str, str], ...]] = {
    "CRP": (("XE2dy", "Plasma C-reactive protein level"), ("XaINL", "Serum C reactive protein level")),
    "Sodium": (("X771T", "Sodium level"), ("XaDva", "Blood sodium level"), ("XaIRf", "Plasma sodium level"), ("XE2q0", "Serum sodium level")),
    "Potassium": (("X771S", "Potassium level"), ("XaDvZ", "Blood potassium level"), ("XaIRl", "Plasma potassium level"), ("XE2pz", "Serum potassium level")),
    "Urea": (("X771P", "Blood urea"), ("XaDvl", "Plasma urea level"), ("XM0lt", "Serum urea level")),
    "Creatinine": (("X771Q", "Creatinine level"), ("XaETQ", "Plasma creatinine level"), ("XaERX", "Cor plasma creatinine level"), ("XE2q5", "Serum creatinine level"), ("XaERc", "Cor serum creatinine level")),
    "Lithium": (("XE25g", "Serum lithium level"),),
    "TSH": (
        ("XaELW", "Plasma TSH level"),
        ("XaET7", "30 minute plasma TSH level"),
        ("XaESa", "60 minute plasma TSH level"),
        ("XaET2", "90 minute plasma TSH level"),
        ("XaESb", "120 minute plasma TSH level"),
        ("XaESc", "150 minute plasma TSH level"),
        ("XaELV", "Serum TSH level"),
        ("XaESX", "60 minute serum TSH level"),
        ("XaESY", "90 minute serum TSH level"),
        ("XaET1", "120 minute serum TSH level"),
        ("XaESZ", "150 minute serum TSH level"),
    ),
    "AlkPhos": (("XaIRj", "Plasma alkaline phosphatase level"), ("XE2px", "Serum alkaline phosphatase level"), ("44F3.", "Alkaline phosphatase level")),
    "ALT": (("44G3.", "ALT/SGPT serum level"),),
    "GammaGT": (("44G4.", "Gamma-glutamyl transferase lev"), ("XaES4", "Plasma gamma-glutamyl transferase level"), ("XaES3", "Serum gamma-glutamyl transferase level")),
    "Bilirubin": (("XaETf", "Plasma total bilirubin level"), ("44E..", "Serum bilirubin level"), ("XaERu", "Serum total bilirubin level"), ("XE2qu", "Total bilirubin level")),
    "Albumin": (("XaIRc", "Plasma albumin level"), ("XE2eA", "Serum albumin level")),
    "Glucose": (
        ("X772y", "Glucose level"),
        ("X772z", "Blood glucose level"),
        ("44U7.", "2 hour post-prand blood gluc"),
        ("XaEOS", "150 minute blood glucose level"),
        ("44g0.", "Plasma random glucose level"),
        ("44g1.", "Plasma fasting glucose level"),
        ("XaEOT", "30 minute plasma glucose level"),
        ("XaEOU", "60 minute plasma glucose level"),
        ("XaEPc", "90 minute plasma glucose level"),
        ("XaEOV", "120 minute plasma glucose level"),
        ("44g2.", "Plasma 2-hr post-pran gluc lev"),
        ("XaEOW", "150 min plasma glucose level"),
        ("44f..", "Serum glucose level"),
        ("44f0.", "Serum random glucose level"),
        ("44f1.", "Serum fasting glucose level"),
        ("XaEOX", "30 minute serum glucose level"),
        ("XaEOY", "60 minute serum glucose level"),
        ("XaEPd", "90 minute serum glucose level"),
        ("XaEOZ", "120 minute serum glucose level"),
        ("44f2.", "Serum 2-hr post-prand gluc lev"),
        ("XaERQ", "150 minute serum glucose level"),
    ),
    "LDLCholesterol": (
        ("XaEVs", "Plasma LDL cholesterol level"),
        ("44d5.", "Plasma fast LDL cholest level"),
        ("44d4.", "Plasma rndm LDL cholest level"),
        ("44P6.", "Serum LDL cholesterol level"),
        ("44PD.", "Serum fast LDL cholesterol lev"),
        ("44PE.", "Ser random LDL cholesterol lev"),
    ),
    "HDLCholesterol": (
        ("XaEVr", "Plasma HDL cholesterol level"),
        ("44d3.", "Plasma fast HDL cholest level"),
        ("44d2.", "Plasma rndm HDL cholest level"),
        ("44P5.", "Serum HDL cholesterol level"),
        ("44PB.", "Serum fast HDL cholesterol lev"),
        ("44PC.", "Ser random HDL cholesterol lev"),
    ),
    "TotalCholesterol": (("XE2eD", "Serum cholesterol level"), ("XaIRd", "Plasma total cholesterol level"), ("XaJe9", "Serum total cholesterol level")),
    "Triglycerides": (
        ("X772O", "Triglyceride level"),
        ("44e..", "Plasma triglyceride level"),
        ("44e1.", "Plasma fast triglyceride level"),
        ("44e0.", "Plasma rndm triglyceride level"),
        ("XE2q9", "Serum triglyceride levels"),
        ("44Q4.", "Serum fasting triglyceride lev"),
        ("44Q5.", "Serum random triglyceride lev"),
    ),
    "HbA1c": (("X772q", "Haemoglobin A1c level"), ("XaERp", "HbA1c level (DCCT aligned)"), ("XaPbt", "HbA1c levl - IFCC standardised")),
    "Haemoglobin": (("Xa96v", "Haemoglobin concentration"),),
    "Haematocrit": (("X76tb", "Haematocrit"),),
    "RBC": (("426..", "Red blood cell count"),),
    "ESR": (("XE2m7", "Erythrocyte sedimentation rate"),),
    "WBC": (("XaIdY", "Total white blood count"),),
    "Neutrophils": (("42J..", "Neutrophil count"), ("XaIao", "Polymorph count")),
    "Lymphocytes": (("42M..", "Lymphocyte count"),),
    "Monocytes": (("42N..", "Monocyte count"),),
    "Basophils": (("42L..", "Basophil count"),),
    "Eosinophils": (("42K..", "Eosinophil count"),),
    "Platelets": (("42P..", "Platelet count"),),
}


def read_pattern(processor: str) -> str:
    """The names of a quantity, longest first, each perhaps followed by its code in brackets; an empty text if it has none."""
    from carrel.functions.strings import escape

    def one(code: str, phrase: str) -> str:
        words = r"\s+".join(escape(w) for w in phrase.split())
        return rf"\b{words}(?:\s*-\s+observation)?(?:\s*\({escape(code)}\))?"

    return "|".join(one(c, p) for c, p in sorted(READ_NAMES.get(processor, ()), key=lambda x: (-len(x[1]), x[1])))
