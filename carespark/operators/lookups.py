"""Look-ups for monitored patients: association rows joined to clinical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.ranking import sorted_index
from ..functions.text import any_of
from .alerts import live_patient_id

RESPIRATORY = ["asthma", "copd", "pneumonia", "respiratory"]


def device_associations(
    basics: DataFrame, device: str | None = None, codes: tuple[str, ...] = ("device-assoc",)
) -> DataFrame:
    """Device reference, patient name and normalised patient id per association."""
    rows = (
        basics.where(F.col("code.coding")[0]["code"].isin(*codes))
        .select(
            live_patient_id(F.col("subject")).alias("patient_id"),
            F.col("subject.display").alias("patient_name"),
            F.explode("extension").alias("ext"),
        )
        .where(any_of(F.col("ext.url"), ["associated-device", "device-association-device"]))
        .select(F.col("ext.valueReference.reference").alias("device_ref"), "patient_name", "patient_id")
    )
    return rows if device is None else rows.where(F.col("device_ref").contains(device))


def for_devices(associations: DataFrame, clinical: DataFrame, *columns) -> DataFrame:
    """Inner join of associations with any clinical table on the patient id."""
    return associations.join(clinical, "patient_id").select("device_ref", "patient_name", *columns)


def device_conditions(associations: DataFrame, conditions: DataFrame) -> DataFrame:
    return for_devices(associations, conditions, F.col("display").alias("condition_name"), "onset_date")


def device_medications(associations: DataFrame, medications: DataFrame) -> DataFrame:
    return for_devices(associations, medications, F.col("display").alias("medication"), "status", "authored_date")


def device_immunizations(associations: DataFrame, immunizations: DataFrame) -> DataFrame:
    return for_devices(associations, immunizations, F.col("display").alias("vaccine"), "imm_date")


def immunization_counts(associations: DataFrame, immunizations: DataFrame) -> DataFrame:
    """Totals and newest date per device; events are summed before the join."""
    per_patient = immunizations.groupBy("patient_id").agg(
        F.count("*").alias("n"), F.max("imm_date").alias("last")
    )
    return (
        associations.join(per_patient, "patient_id")
        .groupBy("device_ref", "patient_name")
        .agg(F.sum("n").alias("total_immunizations"), F.max("last").alias("most_recent_immunization"))
    )


def newest(df: DataFrame, day: str, tiebreak: str, limit: int = 50) -> DataFrame:
    """Top-k newest rows, e.g. recent observations, procedures or studies."""
    return df.orderBy(F.desc(day), tiebreak).limit(limit)


def patient_timeline(associations: DataFrame, events: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Typed events of monitored patients: `kind -> (frame, description, day)`.

    The union is built first, so associations are joined once.
    """
    out = None
    for kind, (df, what, day) in events.items():
        part = df.select(
            "patient_id", F.lit(kind).alias("record_type"), F.col(what).alias("description"),
            F.to_date(day).alias("date_recorded"),
        )
        out = part if out is None else out.unionByName(part)
    return associations.join(out, "patient_id").select(
        "patient_name", "record_type", "description", "date_recorded"
    )


def respiratory_missing_pneumococcal(
    associations: DataFrame, conditions: DataFrame, immunizations: DataFrame, vaccine_word: str
) -> DataFrame:
    """Monitored respiratory patients without the vaccine.

    An anti join: unlike NOT IN, a vaccine row without patient does not empty
    the result.
    """
    vaccinated = immunizations.where(F.lower("display").contains(vaccine_word.lower())).select("patient_id")
    sick = conditions.where(any_of(F.col("display"), RESPIRATORY)).select(
        "patient_id", F.col("display").alias("respiratory_condition")
    )
    return (
        associations.join(vaccinated, "patient_id", "left_anti")
        .join(sick, "patient_id")
        .select("device_ref", "patient_name", "respiratory_condition")
        .distinct()
    )


def device_demographics(associations: DataFrame, patients: DataFrame) -> DataFrame:
    return associations.join(patients, "patient_id", "left").select(
        "device_ref", "patient_name", "patient_id", "gender", "birth_date", "city", "state"
    )


def claims_by_payer(claims: DataFrame) -> DataFrame:
    return claims.groupBy("payer_category").agg(
        F.count("*").alias("claim_count"), F.sum("paid_amount").cast("double").alias("total_paid")
    )


def top_members(high_cost: DataFrame, limit: int = 10) -> DataFrame:
    return (
        high_cost.select("patient_id", "payer_category", "total_paid", "claim_count", "denied_claims", "is_stop_loss")
        .orderBy(F.desc("total_paid"), "patient_id", "payer_category")
        .limit(limit)
    )


def open_gaps_by_type(gaps: DataFrame) -> DataFrame:
    """Status is compared without case: the table holds lower-case values."""
    return (
        gaps.where(F.upper("gap_status") == "OPEN")
        .groupBy("gap_type")
        .agg(F.count("*").alias("open_gap_count"), F.max("days_overdue").alias("max_days_overdue"))
    )


def riskiest_encounters(scores: DataFrame, limit: int = 10) -> DataFrame:
    return (
        scores.select("patient_id", "encounter_id", "risk_probability", "risk_tier", "los_days")
        .orderBy(F.desc("risk_probability"), "encounter_id")
        .limit(limit)
    )


def device_assignment(devices: DataFrame, patients: DataFrame) -> DataFrame:
    """Every device gets a patient, cycling the patients when they run out.

    Both sides are taken in id order.
    """
    indexed_patients = sorted_index(patients.select("patient_id"), "patient_id", "slot")
    n = patients.agg(F.count("*").alias("_n"))
    return (
        sorted_index(devices.select("device_id"), "device_id", "device_index")
        .crossJoin(F.broadcast(n))
        .withColumn("slot", F.col("device_index") % F.col("_n"))
        .join(indexed_patients, "slot")
        .select("device_id", "patient_id", "device_index")
    )


def qualifying_patients(conditions: DataFrame, codes: list[tuple[str, str]], limit: int | None = None) -> DataFrame:
    """Patients by the first list entry they match, or the first `limit` in list order, then patient id."""
    ranked = conditions.sparkSession.createDataFrame(
        [(c, d, i) for i, (c, d) in enumerate(codes)], "code string, condition string, rank int"
    )
    first = (
        conditions.where(F.col("patient_id") != "")
        .join(F.broadcast(ranked.select("code", "rank")), "code")
        .groupBy("patient_id")
        .agg(F.min("rank").alias("rank"))
        .join(F.broadcast(ranked.select("rank", "condition")), "rank")
        .select("patient_id", "condition", "rank")
    )
    return first if limit is None else first.orderBy("rank", "patient_id").limit(limit)
