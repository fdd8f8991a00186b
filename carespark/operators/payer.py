"""Payer stream scoring: fraud, cost trajectory, care-gap alerts, worklists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.numbers import count_if, exact, plain, ratio, sum_if
from ..functions.text import cascade, filled, has_term, same_text
from ..functions.timing import as_column, back, compact_stamp, recent, recency_key

# Emergency department procedure codes and the upcoding target.
ED_PROCEDURES = ["99281", "99282", "99283", "99284", "99285"]
UPCODED = "99215"


def submitted(claims: DataFrame, as_of, window_minutes: int) -> DataFrame:
    return recent(claims, "event_timestamp", as_of, minutes=window_minutes).where(
        F.col("event_type") == "CLAIM_SUBMITTED"
    )


def provider_window_stats(claims: DataFrame, as_of, window_minutes: int = 60) -> DataFrame:
    """Volume, rate, mean, spread and upcoding share per provider.

    A hot provider is combined map-side; no raw claim is shuffled.
    """
    n = F.count("*")
    return (
        submitted(claims, as_of, window_minutes)
        .groupBy("provider_id")
        .agg(
            n.alias("provider_claims"),
            (n * F.lit(60.0) / F.lit(float(window_minutes))).alias("claims_per_hour"),
            F.avg(exact("claim_amount")).cast("double").alias("avg_amount"),
            F.stddev_samp("claim_amount").alias("stdev_amount"),
            (F.lit(100.0) * count_if(F.col("procedure_code") == UPCODED) / n).alias("upcode_rate"),
        )
    )


def provider_partials(claims: DataFrame) -> DataFrame:
    """Mergeable aggregates per provider: counts, sums and sums of squares in cents, extremes.

    Sums are exact decimals, so the order in which parts are merged is without effect.
    """
    cents = (F.col("claim_amount").cast("decimal(18,2)") * 100).cast("decimal(18,0)")
    return claims.where(F.col("event_type") == "CLAIM_SUBMITTED").groupBy("provider_id").agg(
        F.count("*").alias("claims"),
        F.count(cents).alias("amounts"),
        F.sum(cents).cast("decimal(38,0)").alias("cents"),
        F.sum((cents * cents).cast("decimal(36,0)")).cast("decimal(38,0)").alias("cents_squared"),
        F.min(cents).cast("decimal(38,0)").alias("least"),
        F.max(cents).cast("decimal(38,0)").alias("most"),
        count_if(F.col("procedure_code") == UPCODED).alias("upcoded"),
        F.min("event_timestamp").alias("first_claim"),
        F.max("event_timestamp").alias("last_claim"),
    )


def merge_provider_partials(parts: DataFrame) -> DataFrame:
    """One row per provider from `provider_partials` of disjoint claims."""
    added = [F.sum(c).cast(t).alias(c) for c, t in (("claims", "long"), ("amounts", "long"), ("cents", "decimal(38,0)"), ("cents_squared", "decimal(38,0)"), ("upcoded", "long"))]
    return parts.groupBy("provider_id").agg(
        *added, F.min("least").alias("least"), F.max("most").alias("most"), F.min("first_claim").alias("first_claim"), F.max("last_claim").alias("last_claim")
    )


def provider_running_stats(merged: DataFrame, window_minutes: float) -> DataFrame:
    """The columns of `provider_window_stats`, extremes and span, from merged aggregates."""
    n = F.col("amounts").cast("double")
    spread = (F.col("amounts").cast("decimal(18,0)") * F.col("cents_squared") - F.col("cents") * F.col("cents")).cast("double")
    return merged.select(
        "provider_id",
        F.col("claims").alias("provider_claims"),
        (F.col("claims") * F.lit(60.0) / F.lit(float(window_minutes))).alias("claims_per_hour"),
        F.try_divide(F.col("cents").cast("double"), n * 100).alias("avg_amount"),
        F.when(F.col("amounts") > 1, F.sqrt(spread / (n * (n - 1))) / 100).alias("stdev_amount"),
        (F.lit(100.0) * F.col("upcoded") / F.col("claims")).alias("upcode_rate"),
        (F.col("least").cast("double") / 100).alias("min_amount"),
        (F.col("most").cast("double") / 100).alias("max_amount"),
        "first_claim",
        "last_claim",
    )


def fraud_risk(
    claims: DataFrame,
    as_of,
    window_minutes: int = 60,
    velocity: tuple[float, float] = (20.0, 10.0),
    z_limit: float = 3.0,
) -> DataFrame:
    """Score each claim of the window: velocity, amount, denial, upcoding.

    Aggregate-then-join: the joined side has one row per provider, and the
    claims of a hot provider stay splittable (no window over raw claims).
    """
    stats = provider_window_stats(claims, as_of, window_minutes)
    return score_claims(submitted(claims, as_of, window_minutes), stats, as_of, velocity, z_limit)


def score_claims(
    claims: DataFrame, stats: DataFrame, as_of, velocity: tuple[float, float] = (20.0, 10.0), z_limit: float = 3.0
) -> DataFrame:
    """Fraud scores of claims by the statistics of their providers, whatever these were gathered from."""
    flags, rate = F.col("injected_fraud_flags"), F.col("claims_per_hour")
    z = F.col("amount_zscore")
    points = {
        "velocity_burst": F.when(rate >= velocity[0], 30.0).when(rate >= velocity[1], 15.0).otherwise(0.0),
        "amount_outlier": F.when((z >= z_limit) | has_term(flags, "amount_outlier"), 25.0).otherwise(0.0),
        "denial_pattern": F.when(has_term(flags, "denial_pattern"), 25.0).otherwise(0.0),
        "upcoding": F.when(
            (F.col("procedure_code") == UPCODED) | has_term(flags, "upcoding"), 20.0
        ).otherwise(0.0),
    }
    score = sum(points.values(), F.lit(0.0))
    slots = [F.when(p > 0, F.lit(name)).otherwise("") for name, p in points.items()]
    total = F.col("fraud_score")
    return (
        claims.join(stats, "provider_id", "left")
        .withColumn(
            "amount_zscore",
            F.when(
                F.col("stdev_amount") > 0,
                (F.col("claim_amount").cast("double") - F.col("avg_amount")) / F.col("stdev_amount"),
            ).otherwise(0.0),
        )
        .withColumn("fraud_score", score)
        .select(
            F.concat(F.lit("FRAUD-"), "claim_id").alias("score_id"),
            as_column(as_of).alias("score_timestamp"),
            "claim_id",
            "patient_id",
            "provider_id",
            "fraud_score",
            # Five bar-joined slots, double bars replaced once: stray bars may stay.
            F.replace(
                F.concat_ws("|", *slots, F.coalesce(flags, F.lit(""))), F.lit("||"), F.lit("|")
            ).alias("fraud_flags"),
            cascade(
                [(total >= 80, "CRITICAL"), (total >= 50, "HIGH"), (total >= 25, "MEDIUM")], "LOW"
            ).alias("risk_tier"),
            "latitude",
            "longitude",
            "claim_amount",
            "diagnosis_code",
            "procedure_code",
            "claims_per_hour",
            "amount_zscore",
        )
    )


def high_cost_trajectory(claims: DataFrame, as_of, lookback_days: int = 90) -> DataFrame:
    """30/90-day spend, ED use and trend per member; LOW tier is dropped."""
    new = F.col("event_timestamp") > back(as_of, days=30)
    is_ed = same_text(F.col("claim_type"), "emergency") | F.col("procedure_code").isin(ED_PROCEDURES)
    amount = F.col("claim_amount").cast("decimal(18,2)")
    s30, s90, ed = F.col("rolling_spend_30d"), F.col("rolling_spend_90d"), F.col("ed_visits_30d")
    # Position of the newest claim; of equal times the largest id hash, in one primitive key.
    tie = F.conv(F.substring(F.md5("claim_id"), 1, 12), 16, 10).cast("decimal(18,0)")
    key = recency_key("event_timestamp", "_tie")
    return (
        recent(claims, "event_timestamp", as_of, days=lookback_days)
        .withColumn("_tie", tie)
        .groupBy("patient_id")
        .agg(
            sum_if(new, amount).alias("rolling_spend_30d"),
            F.sum(amount).alias("rolling_spend_90d"),
            count_if(new & is_ed).cast("int").alias("ed_visits_30d"),
            F.max("event_timestamp").alias("last_claim_time"),
            F.max_by("latitude", key).alias("latitude"),
            F.max_by("longitude", key).alias("longitude"),
        )
        .withColumn(
            "risk_tier",
            cascade(
                [
                    ((s30 > 100000) | (ed >= 5), "CRITICAL"),
                    ((s30 > 50000) | (ed >= 3), "HIGH"),
                    (s30 > 15000, "MEDIUM"),
                ],
                "LOW",
            ),
        )
        .where(F.col("risk_tier") != "LOW")
        .select(
            F.concat(
                F.lit("HIGHCOST-"), "patient_id", F.lit("-"), compact_stamp(as_column(as_of))
            ).alias("alert_id"),
            as_column(as_of).alias("alert_timestamp"),
            "patient_id",
            s30.cast("double").alias("rolling_spend_30d"),
            s90.cast("double").alias("rolling_spend_90d"),
            "ed_visits_30d",
            F.lit(False).alias("readmission_flag"),
            "risk_tier",
            cascade(
                [
                    ((s90 > 0) & (s30 * 3 > s90 * F.lit("1.25").cast("decimal(3,2)")), "ACCELERATING"),
                    ((s90 > 0) & (s30 >= s90 * F.lit("0.40").cast("decimal(3,2)")), "RISING"),
                ],
                "STABLE",
            ).alias("cost_trend"),
            "latitude",
            "longitude",
            "last_claim_time",
        )
    )


CARE_GAP_ALERT_SCHEMA = (
    "alert_id string, alert_timestamp timestamp, patient_id string, facility_id string, "
    "measure_id string, measure_name string, gap_days_overdue int, alert_priority string, "
    "alert_text string, latitude double, longitude double, provider_id string, "
    "claim_id string, fraud_score double"
)


def care_gap_on_alert(spark, care_gaps: DataFrame | None, as_of) -> DataFrame:
    """Open gaps as alerts; an empty typed table when no gap table exists."""
    if care_gaps is None:
        return spark.createDataFrame([], CARE_GAP_ALERT_SCHEMA)
    overdue = F.col("days_overdue").cast("int")
    blank = F.lit("")
    nowhere = F.lit(None).cast("double")
    return care_gaps.where(same_text(F.col("gap_status"), "open")).select(
        F.concat_ws("-", F.lit("CAREGAP"), "patient_id", "measure_id").alias("alert_id"),
        as_column(as_of).alias("alert_timestamp"),
        "patient_id",
        blank.alias("facility_id"),
        "measure_id",
        F.col("gap_type").alias("measure_name"),
        overdue.alias("gap_days_overdue"),
        F.when(overdue >= 90, F.lit("HIGH")).otherwise(F.lit("MEDIUM")).alias("alert_priority"),
        F.col("recommended_action").alias("alert_text"),
        nowhere.alias("latitude"),
        nowhere.alias("longitude"),
        blank.alias("provider_id"),
        blank.alias("claim_id"),
        F.lit(0.0).alias("fraud_score"),
    )


def payer_ops_worklist(fraud: DataFrame, high_cost: DataFrame, gaps: DataFrame) -> DataFrame:
    """CRITICAL / HIGH rows of the three domains in one shape."""
    blank = F.lit("")

    def shape(df, alert_id, time, domain, priority, provider, claim, value, metric, message):
        return df.where(F.col(priority).isin("CRITICAL", "HIGH")).select(
            F.col(alert_id).alias("alert_id"),
            F.col(time).alias("alert_time"),
            F.lit(domain).alias("alert_domain"),
            F.col(priority).alias("priority"),
            "patient_id",
            provider.alias("provider_id"),
            claim.alias("claim_id"),
            F.col(value).cast("double").alias("metric_value"),
            F.lit(metric).alias("metric_name"),
            message.alias("message"),
            "latitude",
            "longitude",
        )

    return (
        shape(
            fraud, "score_id", "score_timestamp", "FRAUD", "risk_tier",
            F.col("provider_id"), F.col("claim_id"), "fraud_score", "fraud_score",
            F.concat(
                F.lit("Fraud risk "), plain(F.col("fraud_score")), F.lit(" for claim "), "claim_id",
                F.lit(" provider "), "provider_id",
            ),
        )
        .unionByName(
            shape(
                high_cost, "alert_id", "alert_timestamp", "HIGH_COST", "risk_tier",
                blank, blank, "rolling_spend_30d", "rolling_spend_30d",
                F.concat(
                    F.lit("30d spend $"), plain(F.col("rolling_spend_30d")),
                    F.lit("; ED visits="), F.col("ed_visits_30d").cast("string"),
                    F.lit("; trend="), "cost_trend",
                ),
            )
        )
        .unionByName(
            shape(
                gaps, "alert_id", "alert_timestamp", "CARE_GAP", "alert_priority",
                F.col("provider_id"), F.col("claim_id"), "gap_days_overdue", "gap_days_overdue",
                F.col("alert_text"),
            )
        )
    )


def top_fraud_providers(fraud: DataFrame, limit: int = 10) -> DataFrame:
    """Newest score per provider (ties: highest score, then claim id), best first."""
    row = F.struct("fraud_score", "risk_tier", "fraud_flags", "claim_id", "patient_id")
    return (
        fraud.groupBy("provider_id")
        .agg(F.max(F.struct("score_timestamp", "fraud_score", "claim_id", row.alias("row"))).alias("m"))
        .select("provider_id", "m.row.*", F.col("m.score_timestamp").alias("score_timestamp"))
        .orderBy(F.desc("fraud_score"), "provider_id")
        .limit(limit)
    )


_ACTIONS = {
    "FRAUD": "Route to SIU review",
    "HIGH_COST": "Assign care management outreach",
    "CARE_GAP": "Send provider outreach",
}


def priority_summary(worklist: DataFrame) -> DataFrame:
    """Totals per domain, priority and provider. The source names only the outputs."""
    domain = F.col("alert_domain")
    return worklist.groupBy("alert_domain", "priority", "provider_id").agg(
        F.count("*").alias("alert_count"),
        F.count_distinct("patient_id").alias("affected_members"),
        F.count_distinct(filled(F.col("provider_id"))).alias("affected_providers"),
        F.max("metric_value").alias("max_metric"),
        F.max("alert_time").alias("latest_alert"),
    ).withColumn(
        "recommended_action",
        cascade([(domain == d, a) for d, a in _ACTIONS.items()], "Review"),
    )


def high_cost_members(trajectory: DataFrame) -> DataFrame:
    """Trajectory plus projected band and a 0-100 score (outputs named by the source only)."""
    s30 = F.col("rolling_spend_30d")
    tier_points = cascade(
        [(F.col("risk_tier") == "CRITICAL", 60), (F.col("risk_tier") == "HIGH", 40)], 20
    )
    trend_points = cascade(
        [(F.col("cost_trend") == "ACCELERATING", 25), (F.col("cost_trend") == "RISING", 15)], 0
    )
    return trajectory.select(
        "patient_id", "risk_tier", "cost_trend", "rolling_spend_30d", "rolling_spend_90d",
        cascade(
            [(s30 * 12 >= 1000000, "CATASTROPHIC"), (s30 * 12 >= 500000, "VERY_HIGH"), (s30 * 12 >= 100000, "HIGH")],
            "MODERATE",
        ).alias("projected_cost_band"),
        (tier_points + trend_points + F.least(F.col("ed_visits_30d") * 3, F.lit(15))).alias("high_cost_score"),
        "ed_visits_30d", "readmission_flag", F.col("alert_timestamp").alias("refreshed_at"),
    )


def provider_fraud_claims(fraud: DataFrame, claims: DataFrame, as_of, window_minutes: int = 60) -> DataFrame:
    """Recent claims of the top-scoring provider with its current score.

    The joined side is a single row, hence the broadcast.
    """
    top = top_fraud_providers(fraud, 1).select(
        "provider_id",
        F.col("fraud_score").alias("current_fraud_score"),
        F.col("risk_tier").alias("current_risk_tier"),
        "fraud_flags",
    )
    return submitted(claims, as_of, window_minutes).join(F.broadcast(top), "provider_id").select(
        "provider_id", "current_fraud_score", "current_risk_tier", "fraud_flags", "claim_id",
        "patient_id", "claim_type", F.col("claim_amount").cast("double").alias("claim_amount"),
        "diagnosis_code", "event_timestamp", "injected_fraud_flags",
    )


def highest_priority_claim(fraud: DataFrame) -> DataFrame:
    """The single best claim with the reason for its rank."""
    return (
        fraud.orderBy(F.desc("fraud_score"), F.desc("claim_amount"), "claim_id")
        .limit(1)
        .select(
            "claim_id", "patient_id", "provider_id", "fraud_score", "risk_tier", "fraud_flags",
            F.col("claim_amount").cast("double").alias("claim_amount"),
            F.concat(
                F.lit("Score "), plain(F.col("fraud_score")), F.lit(" ("), "risk_tier",
                F.lit(") from "), "fraud_flags",
            ).alias("priority_reason"),
            F.lit("Route to SIU review").alias("recommended_action"),
        )
    )


def critical_care_gaps(gaps: DataFrame, limit: int | None = None) -> DataFrame:
    """Gaps at HIGH or above, most overdue first when limited."""
    rows = gaps.where(F.col("alert_priority").isin("CRITICAL", "HIGH")).select(
        "alert_id", "patient_id", "measure_name", "gap_days_overdue", "alert_priority", "alert_text",
        F.col("alert_text").alias("recommended_action"),
    )
    return rows if limit is None else rows.orderBy(F.desc("gap_days_overdue"), "alert_id").limit(limit)


def _newest(df: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """One row per key: the one with the largest ordering tuple."""
    return (
        df.groupBy(key)
        .agg(F.max(F.struct(*order, F.struct(*fields).alias("row"))).alias("m"))
        .select(key, "m.row.*")
    )


def cross_domain_context(
    device_patients: DataFrame, alerts: DataFrame, conditions: DataFrame, claims: DataFrame,
    gaps: DataFrame, payers: DataFrame, risk: DataFrame, high_cost: DataFrame,
) -> DataFrame:
    """Patient x device x diagnosis x alert x claim x gap x payer x risk.

    Each branch is restricted to monitored patients and reduced to one row per
    patient, so the joins are one-to-one and cannot multiply. The source names
    only the outputs.
    """
    device = device_patients.groupBy("patient_id").agg(F.max("device_id").alias("device_id"))
    monitored = device_patients.select("patient_id").distinct()
    alerts, conditions, claims, gaps, risk = (
        df.join(monitored, "patient_id", "left_semi") for df in (alerts, conditions, claims, gaps, risk)
    )
    alert = (
        alerts.where(F.col("patient_id") != "")
        .groupBy("patient_id")
        .agg(
            F.max(F.struct("alert_time", "alert_tier")).alias("m"),
            F.count("*").alias("repeated_alert_count"),
        )
        .select("patient_id", "m.alert_time", "m.alert_tier", "repeated_alert_count")
    )
    diagnosis = _newest(
        conditions.where(F.col("clinical_status") == "active"), "patient_id", ["onset_date", "code"],
        ["code", "display", "clinical_status"],
    ).withColumnsRenamed({"code": "diagnosis_code", "display": "diagnosis_name"})
    claim = _newest(claims, "patient_id", ["event_timestamp", "claim_id"], ["claim_id", "claim_amount"])
    gap = (
        gaps.groupBy("patient_id")
        .agg(F.min("measure_name").alias("care_gap_measure"))
        .withColumn("care_gap_status", F.lit("OPEN"))
    )
    payer = payers.select("patient_id", "payer_name", "payer_category")
    cost = high_cost.select("patient_id", "rolling_spend_30d").withColumn("high_cost_status", F.lit("AT_RISK"))
    risks = (
        risk.groupBy("patient_id")
        .agg(F.max("risk_probability").alias("risk_probability"))
        .withColumn(
            "risk_tier",
            cascade([(F.col("risk_probability") >= 0.3, "HIGH"), (F.col("risk_probability") >= 0.15, "MEDIUM")], "LOW"),
        )
    )
    out = device.join(alert, "patient_id", "left")
    for branch in (diagnosis, claim, gap, payer, cost, risks):
        out = out.join(branch, "patient_id", "left")
    return out.withColumn("claim_amount", F.col("claim_amount").cast("double")).fillna(
        {"repeated_alert_count": 0, "care_gap_status": "NONE", "high_cost_status": "NONE", "payer_category": "Unknown"}
    )


def gap_and_abnormal_telemetry(gaps: DataFrame, alerts: DataFrame) -> DataFrame:
    """Gap rows of patients that also have a current alert."""
    abnormal = alerts.where(F.col("patient_id") != "").select("patient_id").distinct()
    return gaps.join(abnormal, "patient_id", "left_semi").select(
        "patient_id", "measure_id", "measure_name", "gap_days_overdue", "alert_priority"
    )


def common_diagnoses_repeat_alerts(conditions: DataFrame, history: DataFrame, min_alerts: int = 2) -> DataFrame:
    """Diagnosis counts among patients with repeated alerts.

    `history` carries `patient_id` (device history joined to its patient).
    """
    repeated = (
        history.where(F.col("patient_id") != "")
        .groupBy("patient_id")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= min_alerts)
        .select("patient_id")
    )
    return (
        conditions.join(repeated, "patient_id", "left_semi")
        .groupBy("code", "display")
        .agg(F.count_distinct("patient_id").alias("patient_count"), F.count("*").alias("diagnosis_rows"))
    )


def claim_counts_by_grain(live: DataFrame, fact_claim: DataFrame) -> DataFrame:
    """Live counts by event type beside the historical total, source named per row."""
    now = live.groupBy(F.col("event_type").alias("grain")).agg(
        F.count("*").alias("claim_count"),
        F.sum("claim_amount").cast("double").alias("amount"),
    ).withColumn("source", F.lit("claims_events"))
    past = fact_claim.agg(
        F.count("*").alias("claim_count"),
        F.sum("paid_amount").cast("double").alias("amount"),
    ).select(F.lit("ALL_HISTORY").alias("grain"), "claim_count", "amount", F.lit("fact_claim").alias("source"))
    return now.unionByName(past)


def imaging_summary(studies: DataFrame, source: str = "SilverImagingStudy") -> DataFrame:
    return studies.groupBy("modality").agg(F.count("*").alias("study_count")).withColumn(
        "source_name", F.lit(source)
    )
