"""Medical abbreviations written out, in ordered passes over a text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Common abbreviations.
UPPER = {"BP": "blood pressure", "HR": "heart rate", "RR": "respiratory rate", "MI": "myocardial infarction", "CHF": "congestive heart failure", "COPD": "chronic obstructive pulmonary disease", "CAD": "coronary artery disease", "DM": "diabetes mellitus", "HTN": "hypertension", "UTI": "urinary tract infection", "DVT": "deep vein thrombosis", "CVA": "cerebrovascular accident", "TIA": "transient ischemic attack", "ICU": "intensive care unit", "ER": "emergency room", "CT": "computed tomography", "MRI": "magnetic resonance imaging", "ECG": "electrocardiogram", "EKG": "electrocardiogram", "CBC": "complete blood count", "BMI": "body mass index", "GERD": "gastroesophageal reflux disease", "NSAID": "nonsteroidal anti-inflammatory drug", "SOB": "shortness of breath", "CABG": "coronary artery bypass graft", "AFIB": "atrial fibrillation", "CKD": "chronic kidney disease", "WBC": "white blood cell", "RBC": "red blood cell", "INR": "international normalized ratio"}
#: Abbreviations of several meanings, each with its rank and parts of words that speak for it.
AMBIGUOUS = {
    "AS": (("aortic stenosis", 1, ("valve", "heart", "murmur", "echo", "cardiac")), ("ankylosing spondylitis", 0, ("spine", "back", "joint", "rheum", "hla"))),
    "PE": (
        ("pulmonary embolism", 1, ("clot", "dvt", "anticoag", "lung", "d-dimer", "ctpa", "embol")),
        ("physical exam", 0, ("exam", "assessment", "evaluation", "noted on", "unremarkable")),
        ("pleural effusion", 0, ("effusion", "fluid", "tap", "thorecent", "chest tube")),
    ),
    "CP": (
        ("chest pain", 1, ("heart", "cardiac", "acs", "troponin", "ekg", "substernal", "angina", "exertion", "sob", "shortness", "dyspnea", "chest", "stemi", "nstemi", "nitro", "mi", "cath", "stress test", "pressure")),
        ("cerebral palsy", 0, ("neuro", "motor", "spastic", "developmental", "pediatric", "gait", "tone")),
    ),
    "MS": (
        ("multiple sclerosis", 1, ("neuro", "brain", "lesion", "demyelinat", "relaps", "white matter")),
        ("mitral stenosis", 0, ("valve", "heart", "murmur", "echo", "rheumatic", "cardiac")),
        ("morphine sulfate", 0, ("pain", "mg", "dose", "iv", "prn", "opioid", "narcotic")),
        ("mental status", 0, ("exam", "oriented", "alert", "confused", "ams")),
    ),
    "US": (("ultrasound", 1, ("imaging", "scan", "sonogr", "doppler", "echo", "radiol", "abdomen", "pelvi")),),
    "CTA": (("clear to auscultation", 1, ("lung", "breath", "chest", "bilat", "wheez", "pulm")), ("CT angiography", 0, ("scan", "imaging", "radiol", "vessel", "steno", "aneurysm"))),
}
#: Forms with dots.
DOTTED = {
    "q.d": "once a day", "q.o.d": "every other day", "b.i.d": "twice a day", "t.i.d": "three times a day", "q.i.d": "four times a day",
    "q.h.s": "every night at bedtime", "q.h": "every hour", "q.2.h": "every 2 hours", "q.4.h": "every 4 hours", "q.6.h": "every 6 hours",
    "q.8.h": "every 8 hours", "q.12.h": "every 12 hours", "q.a.m": "every morning", "q.p.m": "every evening", "a.c": "before meals",
    "p.c": "after meals", "h.s": "at bedtime", "p.r.n": "as needed", "s.o.s": "if needed", "p.o": "by mouth", "s.l": "sublingual",
    "s.q": "subcutaneous", "s.c": "subcutaneous", "i.v": "intravenous", "i.m": "intramuscular", "i.d": "intradermal", "p.r": "per rectum",
    "p.v": "per vagina", "i.t": "intrathecal", "i.n": "intranasal", "o.d": "right eye", "o.s": "left eye", "o.u": "both eyes",
    "n.p.o": "nothing by mouth", "d.c": "discontinue", "a.d.l": "activities of daily living", "w.n.l": "within normal limits", "d.t": "delirium tremens",
}
#: Forms with slashes.
SLASH = {
    "s/p": "status post", "c/o": "complains of", "w/": "with", "w/o": "without", "b/l": "bilateral", "n/v": "nausea and vomiting",
    "n/v/d": "nausea, vomiting, and diarrhea", "d/c": "discharge", "f/u": "follow up", "h/o": "history of", "r/o": "rule out", "d/t": "due to",
    "a/w": "associated with", "p/w": "presents with", "c/b": "complicated by", "c/w": "consistent with", "e/o": "evidence of",
    "s/s": "signs and symptoms", "l/s": "lumbosacral", "c/s": "cesarean section", "i/o": "intake and output",
}
#: Forms with an ampersand.
AMPERSAND = {
    "I&D": "incision and drainage", "D&C": "dilation and curettage", "T&A": "tonsillectomy and adenoidectomy", "S&S": "signs and symptoms",
    "C&S": "culture and sensitivity", "A&O": "alert and oriented", "A&Ox3": "alert and oriented times three", "A&Ox4": "alert and oriented times four",
    "D&E": "dilation and evacuation", "O&P": "ova and parasites", "R&R": "rate and rhythm", "S&A": "sugar and acetone",
    "T&C": "type and crossmatch", "T&S": "type and screen",
}
#: Forms of mixed case.
MIXED = {
    "Dx": "diagnosis", "Tx": "treatment", "Rx": "prescription", "Hx": "history", "Sx": "symptoms", "Fx": "fracture", "Bx": "biopsy",
    "Cx": "culture", "Ax": "assessment", "Mx": "management", "Px": "prognosis", "Ix": "investigations", "SpO2": "oxygen saturation",
    "SaO2": "arterial oxygen saturation", "PaO2": "partial pressure of oxygen", "PaCO2": "partial pressure of carbon dioxide",
    "pO2": "partial pressure of oxygen", "pCO2": "partial pressure of carbon dioxide", "FiO2": "fraction of inspired oxygen",
    "EtCO2": "end-tidal carbon dioxide", "HbA1c": "hemoglobin A1c", "Hb": "hemoglobin", "Hgb": "hemoglobin", "Plt": "platelet",
    "Cr": "creatinine", "BNP": "B-type natriuretic peptide", "tPA": "tissue plasminogen activator", "pH": "pH", "Tmax": "maximum temperature",
    "O2sat": "oxygen saturation",
}
#: Degree signs and letters under a bar.
DEGREE = {"1°": "primary", "2°": "secondary", "3°": "tertiary", "4°": "quaternary"}
BAR = {"c\u0304": "with", "s\u0304": "without", "p\u0304": "after", "a\u0304": "before", "\u0101": "before"}
#: Capitals that aren't abbreviations of medicine.
PLAIN = frozenset("AM PM OR US IT IS IF IN ON AN AT BE BY DO GO HE ME MY NO OF SO TO UP WE ID TV THE AND FOR NOT ALL ARE WAS HAS HAD BUT CAN MAY NEW OLD USE ONE TWO USA UK EU FAQ PDF OK AM PM".split())

_DEFINED = re.compile(r"\(([A-Z][A-Za-z&/]{1,7})\)|\b([A-Z]{2,6})\s*\((?=[a-z])")
#: Words on either side that are looked at for a choice.
NEAR = 10


def _choice(options, text: str, begin: int, end: int) -> str:
    """The meaning for which most parts stand around it; its rank decides between equals, then the order."""
    near = " ".join([*text[:begin].split()[-NEAR:], *text[end:].split()[:NEAR]]).lower()
    return max(options, key=lambda o: (sum(part in near for part in o[2]), o[1]))[0]


def _by_words(keys, left: str, right: str, flags: int = 0) -> re.Pattern:
    return re.compile(left + "(" + "|".join(re.escape(k) for k in sorted(keys, key=len, reverse=True)) + ")" + right, flags)


#: The passes in their order: which forms, and where they can stand.
PASSES = (
    (BAR, _by_words(BAR, r"(?<!\w)", r"(?!\w)"), False),
    (DEGREE, _by_words(DEGREE, r"(?<!\w)", ""), False),
    (SLASH, _by_words(SLASH, r"(?<![\w/])", r"(?![\w/])", re.I), True),
    (AMPERSAND, _by_words(AMPERSAND, r"\b", r"\b"), False),
    (DOTTED, re.compile(r"\b([A-Za-z](?:\.[A-Za-z0-9]{1,2})+)\.?\b"), True),
    (MIXED, _by_words(MIXED, r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])"), False),
)


def normalised(text: str | None, table: dict[str, str] | None = None) -> str | None:
    """Passes in order: bars, degrees, slashes, ampersands, dots, mixed case, capitals; what the text itself defines stays.
    ``table`` has further capitals, or other meanings of these."""
    if not text:
        return text
    defined = {a or b for a, b in _DEFINED.findall(text)}
    capitals = UPPER | (table or {})
    for forms, pattern, any_case in PASSES:

        def written(m: re.Match, forms=forms, any_case=any_case) -> str:
            word = m[1]
            return m[0] if word in defined else forms.get(word.lower() if any_case else word, m[0])

        text = pattern.sub(written, text)

    def upper(m: re.Match) -> str:
        word = m[0]
        if word in defined:
            return word
        if word in AMBIGUOUS and word not in (table or {}):
            options = AMBIGUOUS[word]
            # A word that is also a plain one needs something that speaks for it.
            if word in PLAIN and not any(part in m.string.lower() for o in options for part in o[2]):
                return word
            return _choice(options, m.string, m.start(), m.end())
        return word if word in PLAIN else capitals.get(word, word)

    return re.sub(r"\b[A-Z][A-Z0-9]{1,5}\b", upper, text)


def medical(text: Column, table: dict[str, str] | None = None) -> Column:
    """Column form, in Arrow batches."""
    import pandas as pd

    @F.pandas_udf("string")
    def run(part):
        return pd.Series([normalised(t, table) for t in part], dtype="object")

    return run(text)
