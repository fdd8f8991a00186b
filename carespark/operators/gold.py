"""Gold dimensions and facts from parsed Silver rows.

Surrogate keys are 64-bit hashes of the business key: stable across runs.
Duplicate business keys keep the first row of an explicit order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fhir import payer_category, strip_ref
from ..refdata.clinical import CHRONIC_WORDS


def surrogate(*cols: str) -> Column:
    return F.xxhash64(*cols)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the smallest ordering tuple; aggregation, no window."""
    rest = [c for c in df.columns if c not in keys]
    tuple_ = F.struct(*order, *[c for c in rest if c not in order])
    return df.groupBy(*keys).agg(F.min(tuple_).alias("row")).select(*keys, *[f"row.{c}" for c in rest])


def dim_payer(coverage: DataFrame) -> DataFrame:
    """Payer rows with a normalised category, one per coverage id."""
    kind = payer_category(
        F.col("type_code"), F.col("type_display"), F.col("type_text"), F.col("payer_name")
    )
    rows = coverage.select(
        F.col("coverage_id").alias("payer_id"),
        "payer_name",
        kind.alias("payer_type"),
        "coverage_start",
        "coverage_end",
        "patient_ref",
        F.lit(1).alias("is_active"),
    )
    return (
        keep_first(rows, ["payer_id"], ["coverage_start", "patient_ref"])
        .withColumn("payer_key", surrogate("payer_id"))
        .withColumn("payer_category", F.col("payer_type"))
    )


def patient_payer(payers: DataFrame) -> DataFrame:
    """Newest coverage per patient; a missing start date ranks last.

    Aggregation with map-side combine rather than a per-patient window.
    """
    newest = F.struct(
        F.col("coverage_start").isNotNull().alias("dated"),
        "coverage_start",
        "payer_id",
        F.struct("payer_category", "payer_key", "payer_name").alias("row"),
    )
    return (
        payers.withColumn("patient_id", strip_ref(F.col("patient_ref")))
        .where(F.col("patient_id") != "")
        .groupBy("patient_id")
        .agg(F.max(newest).alias("m"))
        .select(
            "patient_id",
            F.col("m.payer_id").alias("primary_payer_id"),
            "m.row.payer_category",
            F.col("m.row.payer_key").alias("primary_payer_key"),
            "m.row.payer_name",
        )
    )


def code_system(system: Column) -> Column:
    return (
        F.when(system == "http://snomed.info/sct", "SNOMED-CT")
        .when(F.lower(system).contains("icd"), "ICD-10")
        .otherwise("Other")
    )


def dim_diagnosis(conditions: DataFrame) -> DataFrame:
    """One row per diagnosis code; the alphabetically first description wins."""
    chronic = F.lower("display").rlike(CHRONIC_WORDS)
    rows = conditions.select(
        F.coalesce("code", F.lit("UNKNOWN")).alias("icd_code"),
        F.coalesce("display", F.lit("Unknown Diagnosis")).alias("icd_description"),
        code_system(F.col("system")).alias("code_system"),
        F.when(chronic, 1).otherwise(0).alias("is_chronic"),
        F.lit(1).alias("is_active"),
    )
    # a few hundred distinct rows are left for the sorting aggregate
    return keep_first(rows.distinct(), ["icd_code"], ["icd_description", "code_system"]).withColumn(
        "diagnosis_key", surrogate("icd_code")
    )


def fact_claim(explanations: DataFrame, payers: DataFrame, patient_payers: DataFrame) -> DataFrame:
    """Claims with amounts, denial flag and payer category.

    Category: the claim's own coverage, else the patient's newest coverage,
    else Unknown. Money stays decimal so totals do not depend on row order.
    Claims without coverage join on keys of their own that match no payer, so
    they spread over all tasks.
    """
    money = lambda c: c.cast("decimal(18,2)")
    zero = F.lit(0).cast("decimal(18,2)")
    by_coverage = payers.select(
        F.col("payer_id").alias("_coverage"), F.col("payer_category").alias("own_category")
    )
    alone = F.concat(F.lit("none:"), F.pmod(F.col("claim_key"), F.lit(4096)).cast("string"))
    by_patient = patient_payers.select("patient_id", F.col("payer_category").alias("patient_category"))
    return (
        explanations.select(
            surrogate("claim_id").alias("claim_key"),
            "claim_id",
            "patient_ref",
            "patient_id",
            "provider_ref",
            "facility_ref",
            "coverage_ref",
            strip_ref(F.col("coverage_ref"), "Coverage").alias("coverage_id"),
            "claim_type",
            F.coalesce("outcome", F.lit("complete")).alias("claim_status"),
            "service_date",
            F.coalesce(money(F.col("total_0")), zero).alias("billed_amount"),
            F.coalesce(money(F.col("payment")), money(F.col("total_1")), zero).alias("paid_amount"),
            F.coalesce(money(F.col("payment")), zero).alias("payment_amount"),
            F.when(F.col("outcome") != "complete", 1).otherwise(0).alias("denial_flag"),
        )
        .withColumn("patient_responsibility", money(F.col("billed_amount") - F.col("paid_amount")))
        .withColumn("allowed_amount", F.col("billed_amount"))
        .withColumn("_coverage", F.coalesce("coverage_id", alone))
        .join(by_coverage, "_coverage", "left")
        .join(by_patient, "patient_id", "left")
        .withColumn("payer_category", F.coalesce("own_category", "patient_category", F.lit("Unknown")))
        .drop("own_category", "patient_category", "_coverage")
    )


def fact_diagnosis(conditions: DataFrame) -> DataFrame:
    return conditions.select(
        surrogate("condition_id").alias("fact_diagnosis_key"),
        F.col("condition_id").alias("diagnosis_id"),
        "patient_ref",
        "encounter_ref",
        F.coalesce("code", F.lit("UNKNOWN")).alias("icd_code"),
        F.coalesce("display", F.lit("Unknown")).alias("diagnosis_description"),
        F.lit("principal").alias("diagnosis_type"),
        F.lit(1).alias("diagnosis_sequence"),
        "clinical_status",
        F.col("onset_date").alias("diagnosis_date"),
    )


def with_payer(df: DataFrame, patient_payers: DataFrame) -> DataFrame:
    """Payer category of the row's patient, Unknown when there is none."""
    return df.join(patient_payers.select("patient_id", "payer_category"), "patient_id", "left").fillna(
        {"payer_category": "Unknown"}
    )
