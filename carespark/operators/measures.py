"""Report measures over Gold and cohort tables.

Each takes optional grouping keys; no key gives one row. Ratios yield 0 for an
empty denominator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fhir import age_by_year
from ..functions.numbers import count_if, distinct_if, exact, ratio
from ..functions.text import cascade, mask_id, mask_name, same_text

SEGMENTS = ["Medicare", "Medicaid", "Commercial"]


def _agg(df: DataFrame, by: tuple[str, ...], *cols: Column) -> DataFrame:
    return df.groupBy(*by).agg(*cols) if by else df.agg(*cols)


def mean(col: str, digits: int = 6) -> Column:
    return F.round(F.avg(exact(col)), digits).cast("double")


def money(col: str) -> Column:
    """Exact total; an empty set gives 0."""
    return F.coalesce(F.sum(F.col(col).cast("decimal(18,2)")), F.lit(0).cast("decimal(18,2)"))


# --- quality, gaps, claims, adherence ------------------------------------------


def quality_kpis(measures: DataFrame, *by: str) -> DataFrame:
    return _agg(
        measures,
        by,
        ratio(count_if(F.col("quality_met")), count_if(F.col("in_denominator"))).alias("quality_rate"),
        F.count_distinct("patient_id").alias("patients_measured"),
    )


def measures_met(summary: DataFrame) -> DataFrame:
    """Measures whose best rate reaches their benchmark."""
    best = summary.groupBy("measure_id").agg(
        F.max("quality_rate").alias("rate"), F.max("benchmark_rate").alias("mark")
    )
    return best.agg(
        count_if(F.col("rate") >= F.col("mark")).alias("measures_met"),
        F.count("*").alias("total_measures"),
    )


def gap_kpis(gaps: DataFrame, *by: str) -> DataFrame:
    return _agg(
        gaps,
        by,
        count_if(same_text(F.col("gap_status"), "open")).alias("open_care_gaps"),
        F.count("*").alias("care_gap_count"),
    )


def claim_kpis(claims: DataFrame, *by: str) -> DataFrame:
    billed, paid = money("billed_amount"), money("paid_amount")
    return _agg(
        claims,
        by,
        billed.cast("double").alias("total_billed"),
        paid.cast("double").alias("total_paid"),
        ratio(paid, billed).alias("collection_rate"),
        ratio(count_if(F.col("denial_flag") == 1), F.count("*")).alias("denial_rate"),
        mean("billed_amount", 4).alias("avg_claim_amount"),
        (billed - paid).cast("double").alias("revenue_leakage"),
        F.count("*").alias("total_claims"),
    )


def adherence_kpis(adherence: DataFrame, *by: str) -> DataFrame:
    return _agg(
        adherence,
        by,
        mean("pdc_score", 4).alias("avg_pdc_score"),
        count_if(F.col("adherence_category") == "Non-Adherent").alias("non_adherent_patients"),
        F.count("*").alias("adherence_members"),
    )


# --- stars, risk, readmission, utilisation --------------------------------------


def star_kpis(detail: DataFrame) -> DataFrame:
    score, top = F.sum("weighted_score"), F.sum("measure_weight") * 5
    return detail.agg(
        mean("overall_weighted_star", 4).alias("overall_star_rating"),
        score.alias("weighted_score"),
        top.alias("max_possible_score"),
        (top - score).alias("star_improvement_opportunity"),
    )


def measure_star(detail: DataFrame) -> DataFrame:
    return detail.groupBy("measure_name").agg(mean("star_rating", 4).alias("measure_star_rating"))


def risk_kpis(scores: DataFrame, *by: str) -> DataFrame:
    return _agg(
        scores,
        by,
        mean("raf_score").alias("average_raf_score"),
        count_if(F.col("risk_tier").isin("Very High", "High")).alias("high_risk_members"),
        money("annual_revenue").cast("double").alias("total_annual_revenue"),
        mean("hcc_count").alias("average_hcc_count"),
        F.count("*").alias("risk_member_count"),
    )


def opportunity_kpis(opportunity: DataFrame) -> DataFrame:
    return opportunity.agg(
        money("potential_revenue_uplift").cast("double").alias("total_revenue_at_risk"),
        F.count("*").alias("coding_gap_count"),
    )


def readmission_kpis(scores: DataFrame, performance: DataFrame | None = None) -> DataFrame:
    out = scores.agg(
        count_if(F.col("risk_tier") == "High").alias("high_risk_encounters"),
        mean("risk_probability").alias("avg_readmission_risk"),
        ratio(F.sum("readmitted_30d"), F.count("*")).alias("actual_readmission_rate"),
        F.count("*").alias("readmission_encounter_count"),
    )
    if performance is None:
        return out
    metric = lambda n: F.max(F.when(F.col("name") == n, F.col("value")))
    quality = performance.agg(metric("auc_roc").alias("model_auc"), metric("accuracy").alias("model_accuracy"))
    return out.crossJoin(quality)


def utilization_kpis(
    claims: DataFrame, utilization: DataFrame, by_payer: DataFrame, high_cost: DataFrame
) -> DataFrame:
    """One row. This PMPM divides by the largest monthly membership times twelve,
    unlike the member-month PMPM of the utilisation table; both are shown."""
    paid = claims.agg(money("paid_amount").alias("_paid"))
    use = utilization.agg(
        F.max("unique_members").alias("_members"),
        F.max("ip_per_1k").alias("ip_per_1k"),
        F.max("ed_per_1k").alias("ed_per_1k"),
        mean("avg_los", 4).alias("alos"),
        F.max("bed_days_per_1k").alias("bed_days_per_1k"),
        F.max("pmpm").alias("monthly_pmpm"),
        F.round(F.max("pmpm") - F.max("benchmark_pmpm"), 2).alias("pmpm_vs_benchmark"),
    )
    ed = by_payer.agg(F.coalesce(F.sum("ed_visits"), F.lit(0)).alias("payer_ed_visits"))
    top = high_cost.agg(
        F.count("*").alias("high_cost_member_count"), money("total_paid").cast("double").alias("high_cost_total_paid")
    )
    return (
        paid.crossJoin(use).crossJoin(ed).crossJoin(top)
        .withColumn("pmpm", F.round(ratio(F.col("_paid"), F.col("_members") * 12), 6))
        .drop("_paid", "_members")
    )


def payer_segments(
    claims: DataFrame, measures: DataFrame, scores: DataFrame, utilization: DataFrame,
    segments: list[str] | None = None,
) -> DataFrame:
    """Paid, quality, collection, risk and PMPM per payer segment.

    One grouped aggregate per table instead of one scan per segment and measure.
    """
    keep = F.col("payer_category").isin(segments or SEGMENTS)
    members = utilization.agg((F.max("unique_members") * 12).alias("_base"))
    claim = claim_kpis(claims.where(keep), "payer_category")
    quality = quality_kpis(measures.where(keep), "payer_category")
    risk = risk_kpis(scores.where(keep), "payer_category")
    return (
        claim.join(quality, "payer_category", "left")
        .join(risk, "payer_category", "left")
        .crossJoin(F.broadcast(members))
        .select(
            F.col("payer_category").alias("segment"),
            F.col("total_paid").alias("paid"),
            F.col("quality_rate").alias("quality"),
            F.col("collection_rate").alias("collection"),
            "denial_rate",
            "patients_measured",
            F.col("average_raf_score").alias("raf"),
            F.round(ratio(F.col("total_paid"), F.col("_base")), 6).alias("pmpm"),
        )
    )


# --- cohort tables -----------------------------------------------------------------


def age_group(birth: Column, as_of: Column) -> Column:
    """Five bands on year-boundary age."""
    age = age_by_year(birth, as_of)
    return cascade(
        [(age < 18, "Under 18"), (age <= 35, "18-35"), (age <= 50, "36-50"), (age <= 65, "51-65"), (age > 65, "Over 65")],
        "Unknown",
    )


def diabetes_type(code: Column) -> Column:
    # Condition codes of the two diabetes types.
    return cascade([(code == "46635009", "Type I"), (code == "44054006", "Type II")], "Non - Diabetic")


def diabetic_status(code: Column) -> Column:
    return F.when(diabetes_type(code).startswith("Type"), "Diabetic").otherwise("Non - Diabetic")


def gender_counts(person: DataFrame) -> DataFrame:
    is_ = lambda g: count_if(F.col("gender") == g)
    return person.agg(
        is_("female").alias("female"), is_("male").alias("male"), is_("unknown").alias("unknown")
    )


def _people(person: DataFrame, as_of: Column) -> DataFrame:
    return person.select("patient_id", "gender", age_group(F.col("birth_date"), as_of).alias("age_group"))


def cost_by_gender(cost: DataFrame, person: DataFrame) -> DataFrame:
    """Totals per gender; costs are summed per patient before the join."""
    paid = cost.groupBy("patient_id").agg(F.sum("total_charge").alias("total_charge"))
    joined = paid.join(person.select("patient_id", "gender"), "patient_id")
    total = lambda g: F.coalesce(F.sum(F.when(F.col("gender") == g, F.col("total_charge"))), F.lit(0)).cast("double")
    return joined.agg(total("female").alias("female"), total("male").alias("male"), total("unknown").alias("unknown"))


def patients_by_age_group(person: DataFrame, as_of: Column) -> DataFrame:
    return _people(person, as_of).groupBy("age_group").agg(F.count("*").alias("patients"))


def visits_by_age_group(visits: DataFrame, person: DataFrame, as_of: Column) -> DataFrame:
    counts = visits.groupBy("patient_id").agg(F.count("*").alias("n"))
    return (
        counts.join(_people(person, as_of), "patient_id")
        .groupBy("age_group")
        .agg(F.sum("n").alias("visits"))
    )


def diabetic_counts(conditions: DataFrame) -> DataFrame:
    kind, who = diabetes_type(F.col("code")), F.col("patient_id")
    return conditions.agg(
        distinct_if(kind.startswith("Type"), who).alias("diabetic"),
        distinct_if(~kind.startswith("Type"), who).alias("non_diabetic"),
        distinct_if(kind == "Type I", who).alias("type_1"),
        distinct_if(kind == "Type II", who).alias("type_2"),
    )


def patients_per_condition(conditions: DataFrame) -> DataFrame:
    return conditions.groupBy("display").agg(F.count_distinct("patient_id").alias("patients"))


def hba1c_counts(
    measurements: DataFrame, name: str = "Hemoglobin A1c/Hemoglobin.total in Blood", cut: float = 0.8
) -> DataFrame:
    hit, who = F.col("display") == name, F.col("patient_id")
    return measurements.agg(
        distinct_if(hit & (F.col("value") >= cut), who).alias("high"),
        distinct_if(hit & (F.col("value") < cut), who).alias("low"),
    )


def rehospitalization_nonmetro(determinants: DataFrame) -> DataFrame:
    """Summed rehospitalisation rate over places whose nonmetro indicator is 1."""
    name, value = F.col("name"), F.col("value_as_number")
    per_place = determinants.groupBy("location_value").agg(
        F.max(F.when(name == "Nonmetro2013", value)).alias("nonmetro"),
        F.sum(F.when(name == "LTC_AVG_OBS_REHOSP_RATE", value).otherwise(0.0)).alias("rate"),
    )
    return per_place.where(F.col("nonmetro") == 1).agg(
        F.coalesce(F.sum("rate"), F.lit(0.0)).alias("rehospitalization_nonmetro")
    )


def cohort_cards(person: DataFrame, conditions: DataFrame, drugs: DataFrame) -> DataFrame:
    return (
        person.agg(F.count("*").alias("patients"))
        .crossJoin(conditions.agg(F.count("*").alias("condition_occurrences")))
        .crossJoin(drugs.agg(F.count("*").alias("drug_exposures")))
    )


def patients_by_birth_year(person: DataFrame) -> DataFrame:
    return person.groupBy(F.year("birth_date").alias("birth_year")).agg(F.count("*").alias("patients"))


def patient_journey(visits: DataFrame, conditions: DataFrame, drugs: DataFrame) -> DataFrame:
    """Visit, condition and drug rows of every patient in one shape."""
    shape = lambda df, kind, what, day: df.select(
        "patient_id", F.lit(kind).alias("event_type"), F.col(what).alias("event"), F.to_date(day).alias("event_date")
    )
    return (
        shape(visits, "Visit", "encounter_class", "admit_date")
        .unionByName(shape(conditions, "Condition", "display", "onset_date"))
        .unionByName(shape(drugs, "Drug", "display", "authored_date"))
    )


def comorbidity(conditions: DataFrame) -> DataFrame:
    """Distinct conditions per patient, and patients per count."""
    return (
        conditions.groupBy("patient_id")
        .agg(F.count_distinct("code").alias("conditions"))
        .groupBy("conditions")
        .agg(F.count("*").alias("patients"))
    )


def lab_table(measurements: DataFrame) -> DataFrame:
    return measurements.groupBy("display").agg(
        F.count("*").alias("results"),
        F.count_distinct("patient_id").alias("patients"),
        mean("value", 4).alias("avg_value"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
    )


# --- command-centre rows -------------------------------------------------------------


def payer_kpi_row(
    claims: DataFrame, utilization: DataFrame, by_payer: DataFrame, high_cost: DataFrame, opportunity: DataFrame
) -> DataFrame:
    use = utilization_kpis(claims, utilization, by_payer, high_cost)
    return claim_kpis(claims).crossJoin(use).crossJoin(opportunity_kpis(opportunity)).select(
        "total_paid", "total_billed", "revenue_leakage", "collection_rate", "denial_rate", "total_claims",
        "pmpm", "high_cost_member_count", "total_revenue_at_risk",
    )


def provider_kpi_row(
    gaps: DataFrame, measures: DataFrame, stars: DataFrame, scores: DataFrame, readmission: DataFrame,
    utilization: DataFrame,
) -> DataFrame:
    alos = utilization.agg(mean("avg_los", 4).alias("alos"))
    return (
        gap_kpis(gaps).crossJoin(quality_kpis(measures)).crossJoin(star_kpis(stars)).crossJoin(risk_kpis(scores))
        .crossJoin(readmission_kpis(readmission)).crossJoin(alos)
        .select(
            "open_care_gaps", "quality_rate", "overall_star_rating", "average_raf_score", "avg_readmission_risk",
            "alos", "star_improvement_opportunity", "patients_measured",
        )
    )


def top_high_cost(high_cost: DataFrame, limit: int = 8) -> DataFrame:
    return (
        high_cost.select("patient_id", "payer_category", "total_paid", "claim_count", "is_stop_loss")
        .orderBy(F.desc("total_paid"), "patient_id", "payer_category")
        .limit(limit)
    )


def top_gap_types(gaps: DataFrame, limit: int = 8) -> DataFrame:
    return (
        gaps.groupBy("gap_type").agg(F.count("*").alias("gaps")).orderBy(F.desc("gaps"), "gap_type").limit(limit)
    )


def readmission_tiers(scores: DataFrame) -> DataFrame:
    return scores.groupBy("risk_tier").agg(
        F.count("*").alias("encounters"), mean("risk_probability").alias("avg_risk")
    )


def worst_stars(detail: DataFrame, limit: int = 6) -> DataFrame:
    return measure_star(detail).orderBy("measure_star_rating", "measure_name").limit(limit)


def imaging_kpis(studies: DataFrame, person: DataFrame, as_of: Column) -> DataFrame:
    """Studies, patients, files, ratios and mean age of imaged patients."""
    per_patient = studies.groupBy("patient_id").agg(
        F.count("*").alias("studies"), F.sum("number_of_instances").alias("files")
    )
    aged = per_patient.join(person.select("patient_id", "birth_date"), "patient_id", "left").withColumn(
        "age", age_by_year(F.col("birth_date"), as_of)
    )
    s, f, n = F.sum("studies"), F.sum("files"), F.count("*")
    return aged.agg(
        s.alias("studies"), n.alias("patients"), f.alias("files"),
        F.round(ratio(s, n), 6).alias("studies_per_patient"), F.round(ratio(f, s), 6).alias("files_per_study"),
        mean("age").alias("avg_age"),
    )


def modality_mix(studies: DataFrame, limit: int = 8) -> DataFrame:
    return (
        studies.groupBy("modality")
        .agg(
            F.count("*").alias("studies"), F.sum("number_of_instances").alias("files"),
            F.count_distinct("patient_id").alias("patients"),
        )
        .orderBy(F.desc("studies"), "modality")
        .limit(limit)
    )


def heaviest_studies(studies: DataFrame, person: DataFrame, as_of: Column, limit: int = 8) -> DataFrame:
    """Patients with the most image files. Top-k first, names joined after."""
    top = (
        studies.groupBy("patient_id")
        .agg(F.count("*").alias("studies"), F.sum("number_of_instances").alias("files"))
        .orderBy(F.desc("files"), "patient_id")
        .limit(limit)
    )
    names = person.select("patient_id", "patient_name", age_group(F.col("birth_date"), as_of).alias("age_range"))
    return names.join(F.broadcast(top), "patient_id").select("patient_name", "age_range", "studies", "files")


# --- snapshots -------------------------------------------------------------------------

# Lens, metric column, unit, in display order.
PAYER_METRICS = [("total_paid", "money"), ("collection_rate", "percent"), ("pmpm", "money"), ("total_revenue_at_risk", "money"), ("revenue_leakage", "money")]
PROVIDER_METRICS = [("open_care_gaps", "count"), ("quality_rate", "percent"), ("avg_readmission_risk", "percent"), ("average_raf_score", "ratio"), ("overall_star_rating", "ratio")]
IMAGING_METRICS = [("studies", "count"), ("files", "count"), ("studies_per_patient", "ratio"), ("avg_age", "ratio")]


def kpi_snapshot(payer: DataFrame, provider: DataFrame, imaging: DataFrame) -> DataFrame:
    """KPI rows in long form: lens, metric, value, unit, rank."""

    def long(df: DataFrame, lens: str, metrics: list[tuple[str, str]]) -> DataFrame:
        rows = F.array(
            *[
                F.struct(
                    F.lit(lens).alias("lens"),
                    F.lit(name).alias("metric"),
                    F.coalesce(F.col(name).cast("double"), F.lit(0.0)).alias("value"),
                    F.lit(unit).alias("unit"),
                    F.lit(i).alias("rank"),
                )
                for i, (name, unit) in enumerate(metrics)
            ]
        )
        return df.select(F.inline(rows))

    return (
        long(payer, "payer", PAYER_METRICS)
        .unionByName(long(provider, "provider", PROVIDER_METRICS))
        .unionByName(long(imaging, "medtech", IMAGING_METRICS))
    )


def series_snapshot(
    segments: DataFrame, gap_types: DataFrame, tiers: DataFrame, stars: DataFrame, modality: DataFrame
) -> DataFrame:
    """Chart rows in long form. Every input is already a bounded report."""
    shape = lambda df, lens, series, label, value, unit: df.select(
        F.lit(lens).alias("lens"),
        F.lit(series).alias("series"),
        F.col(label).alias("label"),
        F.col(value).cast("double").alias("value"),
        F.lit(unit).alias("unit"),
    )
    return (
        shape(segments, "payer", "payerSegment", "segment", "paid", "money")
        .unionByName(shape(gap_types, "provider", "careGap", "gap_type", "gaps", "count"))
        .unionByName(shape(tiers, "provider", "riskTier", "risk_tier", "encounters", "count"))
        .unionByName(shape(stars, "provider", "starMeasure", "measure_name", "measure_star_rating", "ratio"))
        .unionByName(shape(modality, "medtech", "modality", "modality", "studies", "count"))
    )


def worklist_snapshot(high_cost: DataFrame, heaviest: DataFrame) -> DataFrame:
    """Masked top-8 rows of both worklists."""
    members = high_cost.select(
        F.lit("payer").alias("lens"), F.lit("highCostMember").alias("kind"),
        mask_id(F.col("patient_id")).alias("subject"), F.col("payer_category").alias("segment"),
        F.col("total_paid").cast("double").alias("primary_value"),
        F.col("claim_count").cast("double").alias("secondary_value"),
        F.coalesce("is_stop_loss", F.lit(False)).alias("flagged"),
    )
    scans = heaviest.select(
        F.lit("medtech").alias("lens"), F.lit("heavyAcquisition").alias("kind"),
        mask_name(F.col("patient_name")).alias("subject"), F.col("age_range").alias("segment"),
        F.col("files").cast("double").alias("primary_value"), F.col("studies").cast("double").alias("secondary_value"),
        F.lit(False).alias("flagged"),
    )
    return members.unionByName(scans)
