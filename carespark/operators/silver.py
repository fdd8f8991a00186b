"""Silver resources (JSON text members) to typed rows.

Each JSON member is parsed exactly once: all members of a row go through one
`inline` generator. The optimizer neither repeats a generator per field access
nor pushes later filters on parsed values below it, as it would with a plain
projection. Scans read only the columns named here. Claims have many members, of
which most reports need few: those that are never filtered on are projected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fhir import CONCEPT, MONEY, PERIOD, REFERENCE, strip_ref, typed_reference


def parse_members(df: DataFrame, keep: list, **members: tuple[str, str]) -> DataFrame:
    """`keep` plus one parsed struct per member `name=(json column, schema)`."""
    row = F.struct(*[F.from_json(F.col(c), ddl).alias(n) for n, (c, ddl) in members.items()])
    return df.select(*keep, F.inline(F.array(row)))


def _coding(concept: str, field: str) -> Column:
    return F.col(concept)["coding"][0][field]


def _ref(name: str, resource_type: str) -> Column:
    return typed_reference(F.col(name), resource_type)


def _patient_id(name: str = "subject") -> Column:
    return strip_ref(_ref(name, "Patient")).alias("patient_id")


def patients(silver: DataFrame) -> DataFrame:
    name = "array<struct<text:string, given:array<string>, family:string>>"
    birth = F.col("birthDate").cast("date").alias("birth_date")
    keep = [F.col("idOrig").alias("patient_id"), birth, "gender"]
    return parse_members(silver, keep, names=("name_string", name)).select(
        "patient_id", "birth_date", "gender", F.col("names")[0].alias("name")
    )


def patient_facts(silver: DataFrame) -> DataFrame:
    """Id, birth date and gender only: no JSON is read."""
    return silver.select(
        F.col("idOrig").alias("patient_id"), F.col("birthDate").cast("date").alias("birth_date"), "gender"
    )


def conditions(silver: DataFrame, with_encounter: bool = False) -> DataFrame:
    members = {
        "subject": ("subject_string", REFERENCE),
        "concept": ("code_string", CONCEPT),
        "status": ("clinicalStatus_string", CONCEPT),
    }
    if with_encounter:
        members["encounter"] = ("encounter_string", REFERENCE)
    keep = [F.col("idOrig").alias("condition_id"), F.col("onsetDateTime").cast("date").alias("onset_date")]
    rows = parse_members(silver, keep, **members)
    columns = [
        "condition_id",
        _ref("subject", "Patient").alias("patient_ref"),
        _patient_id(),
        _coding("concept", "system").alias("system"),
        _coding("concept", "code").alias("code"),
        _coding("concept", "display").alias("display"),
        F.col("concept.coding").alias("codings"),
        _coding("status", "code").alias("clinical_status"),
        "onset_date",
    ]
    if with_encounter:
        columns.append(_ref("encounter", "Encounter").alias("encounter_ref"))
    return rows.select(*columns)


def observations(silver: DataFrame) -> DataFrame:
    """The code is parsed first: a filter on it keeps the other members of the rows it drops from being parsed."""
    keep = [F.col("idOrig").alias("observation_id"), F.col("effectiveDateTime").cast("date").alias("obs_date")]
    coded = parse_members(silver, [*keep, "subject_string", "valueQuantity_string"], concept=("code_string", CONCEPT))
    return parse_members(
        coded,
        ["observation_id", "obs_date", "concept"],
        subject=("subject_string", REFERENCE),
        quantity=("valueQuantity_string", "struct<value:double, unit:string>"),
    ).select(
        "observation_id",
        _patient_id(),
        _coding("concept", "code").alias("code"),
        _coding("concept", "display").alias("display"),
        F.col("quantity.value").alias("value"),
        F.col("quantity.unit").alias("unit"),
        "obs_date",
    )


def _coded_event(silver: DataFrame, id_name: str, keep: list[Column], subject: str, concept: str) -> DataFrame:
    rows = parse_members(
        silver,
        [F.col("idOrig").alias(id_name), *keep],
        subject=(subject, REFERENCE),
        concept=(concept, CONCEPT),
    )
    kept = [c for c in rows.columns if c not in ("subject", "concept")]
    return rows.select(
        *kept,
        _patient_id(),
        _coding("concept", "code").alias("code"),
        _coding("concept", "display").alias("display"),
    )


def medications(silver: DataFrame) -> DataFrame:
    keep = [F.col("authoredOn").cast("date").alias("authored_date"), F.col("status")]
    return _coded_event(silver, "medication_id", keep, "subject_string", "medicationCodeableConcept_string")


def immunizations(silver: DataFrame) -> DataFrame:
    keep = [F.col("occurrenceDateTime").cast("date").alias("imm_date")]
    return _coded_event(silver, "immunization_id", keep, "patient_string", "vaccineCode_string")


def encounters(silver: DataFrame, with_locations: bool = False) -> DataFrame:
    members = {
        "subject": ("subject_string", REFERENCE),
        "type": ("type_string", f"array<{CONCEPT}>"),
        "period": ("period_string", PERIOD),
        "class": ("class_string", "struct<code:string>"),
    }
    if with_locations:
        members["locations"] = (
            "location_string",
            "array<struct<location:struct<id:string, identifier:struct<value:string>>>>",
        )
    rows = parse_members(silver, [F.col("idOrig").alias("encounter_id")], **members)
    return rows.select(
        "encounter_id",
        _patient_id(),
        F.col("class.code").alias("encounter_class"),
        F.col("type")[0]["coding"][0]["display"].alias("type_display"),
        F.col("period.start").cast("timestamp").alias("admit_date"),
        F.col("period.end").cast("timestamp").alias("discharge_date"),
        *(["locations"] if with_locations else []),
    )


def encounter_locations(encounters: DataFrame) -> DataFrame:
    """One row per encounter location for `patient_location`."""
    loc = F.col("loc.location")
    return encounters.select(
        "patient_id", F.col("admit_date").alias("start"), F.explode("locations").alias("loc")
    ).select(
        "patient_id",
        "start",
        F.coalesce(
            F.nullif(loc["id"], F.lit("")), F.nullif(loc["identifier"]["value"], F.lit(""))
        ).alias("location_key"),
    )


def coverage(silver: DataFrame) -> DataFrame:
    return parse_members(
        silver,
        [F.col("idOrig").alias("coverage_id")],
        subject=("beneficiary_string", REFERENCE),
        concept=("type_string", CONCEPT),
        period=("period_string", PERIOD),
        payors=("payor_string", "array<struct<display:string>>"),
    ).select(
        "coverage_id",
        _ref("subject", "Patient").alias("patient_ref"),
        _patient_id(),
        _coding("concept", "code").alias("type_code"),
        _coding("concept", "display").alias("type_display"),
        F.col("concept.text").alias("type_text"),
        F.col("payors")[0]["display"].alias("payer_name"),
        F.col("period.start").cast("date").alias("coverage_start"),
        F.col("period.end").cast("date").alias("coverage_end"),
    )


def explanations(silver: DataFrame) -> DataFrame:
    """Explanation-of-benefit rows with typed references, dates and amounts."""
    amount = f"struct<amount:{MONEY}>"
    # seldom filtered on: a plain projection, so reports that use few of them parse only those
    plain = {
        "insurance": ("insurance_string", f"array<struct<coverage:{REFERENCE}>>"),
        "provider": ("provider_string", REFERENCE),
        "facility": ("facility_string", REFERENCE),
        "concept": ("type_string", CONCEPT),
        "billable": ("billablePeriod_string", PERIOD),
        "total": ("total_string", f"array<{amount}>"),
        "payment": ("payment_string", amount),
    }
    rows = parse_members(
        silver,
        [F.col("idOrig").alias("claim_id"), "outcome", "created", *[c for c, _ in plain.values()]],
        subject=("patient_string", REFERENCE),
    )
    parsed = [F.from_json(F.col(c), ddl).alias(n) for n, (c, ddl) in plain.items()]
    return rows.select("claim_id", "outcome", "created", "subject", *parsed).select(
        "claim_id",
        _ref("subject", "Patient").alias("patient_ref"),
        _patient_id(),
        _ref("provider", "Practitioner").alias("provider_ref"),
        _ref("facility", "Location").alias("facility_ref"),
        typed_reference(F.col("insurance")[0]["coverage"], "Coverage").alias("coverage_ref"),
        F.coalesce(
            _coding("concept", "display"), _coding("concept", "code"), F.lit("Unknown")
        ).alias("claim_type"),
        "outcome",
        F.coalesce("billable.start", "created").cast("date").alias("service_date"),
        F.get("total", F.lit(0))["amount"]["value"].alias("total_0"),
        F.get("total", F.lit(1))["amount"]["value"].alias("total_1"),
        F.col("payment.amount.value").alias("payment"),
    )


def imaging(silver: DataFrame) -> DataFrame:
    keep = [
        F.col("idOrig").alias("study_id"),
        "modality",
        "description",
        F.col("started").cast("timestamp").alias("started"),
        F.col("numberOfSeries").alias("number_of_series"),
        F.col("numberOfInstances").alias("number_of_instances"),
    ]
    rows = parse_members(silver, keep, subject=("subject_string", REFERENCE))
    return rows.select("*", _patient_id())


def device_basics(silver: DataFrame) -> DataFrame:
    """Association resources with structs for code, subject and extensions."""
    ext = "array<struct<url:string, valueReference:struct<reference:string>>>"
    return parse_members(
        silver,
        ["id"],
        code=("code_string", CONCEPT),
        subject=("subject_string", REFERENCE),
        extension=("extension_string", ext),
    )
