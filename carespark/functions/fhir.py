"""References, codings and ages of FHIR resources kept as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import cascade, filled

REFERENCE = (
    "struct<reference:string, msftSourceReference:string, idOrig:string, type:string, "
    "display:string, identifier:struct<value:string>>"
)
CODING = "struct<system:string, code:string, display:string>"
CONCEPT = f"struct<coding:array<{CODING}>, text:string>"
PERIOD = "struct<start:string, end:string>"
MONEY = "struct<value:double>"


def typed_reference(ref: Column, resource_type: str) -> Column:
    """`Type/id` from the four shapes a reference may take.

    Order: literal reference, source reference (kept when it is local or already
    typed), original id, identifier value.
    """
    kind = F.when(ref["type"].rlike("^[A-Za-z][A-Za-z0-9]+$"), ref["type"]).otherwise(resource_type)
    typed = lambda value: F.concat(kind, F.lit("/"), value)
    source = filled(ref["msftSourceReference"])
    return F.coalesce(
        filled(ref["reference"]),
        F.when(source.startswith("#") | source.contains("/"), source).otherwise(typed(source)),
        typed(filled(ref["idOrig"])),
        typed(filled(ref["identifier"]["value"])),
    )


def fhir_reference(col: str, resource_type: str, path: str | None = None) -> Column:
    """Typed reference straight from a JSON text column (one-off use).

    `path` names the member of the first array element that holds the
    reference. Table builds parse members once instead, see `operators.silver`.
    """
    if path is None:
        ref = F.from_json(F.col(col), REFERENCE)
    else:
        ref = F.from_json(F.col(col), f"array<struct<{path}:{REFERENCE}>>")[0][path]
    return typed_reference(ref, resource_type)


def strip_ref(ref: Column, resource_type: str = "Patient") -> Column:
    """Bare id of a typed reference; empty when the type does not match."""
    return F.regexp_extract(ref, f"{resource_type}/(.*)", 1)


def ontology_patient_id(ref: Column, imaging: bool = False) -> Column:
    """Patient id as the graph projections resolve it (blank text is missing)."""
    trimmed = lambda c: F.nullif(F.trim(c), F.lit(""))
    source = trimmed(F.regexp_replace(ref["msftSourceReference"], "^Patient/", ""))
    identifier = trimmed(ref["identifier"]["value"])
    original = trimmed(ref["idOrig"])
    return F.coalesce(*([identifier, source] if imaging else [source, identifier]), original)


# --- ages: three deliberate definitions ---------------------------------------


def age_by_days(birth: Column, as_of: Column) -> Column:
    """floor(days / 365.25), the form of the quality and risk tables."""
    return F.floor(F.datediff(as_of, birth) / F.lit(365.25)).cast("int")


def age_at(birth: Column, as_of: Column) -> Column:
    """Calendar age: birthdays passed."""
    before = F.date_format(as_of, "MMdd") < F.date_format(birth, "MMdd")
    return F.year(as_of) - F.year(birth) - before.cast("int")


def age_by_year(birth: Column, as_of: Column) -> Column:
    """Year boundaries crossed, the form of the cohort reports."""
    return F.year(as_of) - F.year(birth)


def is_pediatric(birth: Column, as_of: Column, limit: int = 21) -> Column:
    return F.coalesce(age_at(birth, as_of) < limit, F.lit(False))


# --- payer and drug classes -----------------------------------------------------

# Signal patterns per payer category, first match wins.
PAYER_PATTERNS = [
    ("Medicare", r"medicare|\bmcr\b"),
    ("Medicaid", r"medicaid|\bmcd\b"),
    ("Uninsured", r"self[- ]pay|uninsured|no insurance"),
    ("Commercial", "commercial|private|employer|blue cross|bcbs|aetna|cigna|united|humana|anthem|kaiser"),
]
# Adherence classes and their drug names, first match wins.
DRUG_CLASSES = [
    ("PDC-DR (Diabetes)", "metformin|glipizide|glyburide|glimepiride|sitagliptin|pioglitazone|empagliflozin|dapagliflozin|liraglutide|semaglutide|insulin"),
    ("PDC-RASA (RAS Antagonists)", "lisinopril|enalapril|ramipril|losartan|valsartan|irbesartan|olmesartan|candesartan|benazepril|captopril"),
    ("PDC-STA (Statins)", "atorvastatin|simvastatin|rosuvastatin|pravastatin|lovastatin|fluvastatin|pitavastatin"),
]


def first_pattern(text: Column, patterns: list[tuple[str, str]], default) -> Column:
    low = F.lower(text)
    return cascade([(low.rlike(p), name) for name, p in patterns], default)


def payer_category(code: Column, display: Column, text: Column, name: Column) -> Column:
    """Reporting category from every available coverage signal."""
    return first_pattern(F.concat_ws(" ", code, display, text, name), PAYER_PATTERNS, "Unknown")


def drug_class(name: Column) -> Column:
    return first_pattern(name, DRUG_CLASSES, None)

