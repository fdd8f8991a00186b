"""Boundary values of every tier and cut point."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from carespark.operators import alerts, payer, quality, risk, telemetry

NOW = datetime(2026, 7, 1, 12, 0, 0)


def readings(spark, rows):
    """rows: (device, seconds before NOW, spo2, pr)."""
    data = [
        (i, d, NOW - timedelta(seconds=s), float(spo2) if spo2 is not None else None, pr, 2.0, 10, 12.0, 96)
        for i, (d, s, spo2, pr) in enumerate(rows)
    ]
    return spark.createDataFrame(
        data, "event_id long, device_id string, ts timestamp, spo2 double, pr int, pi double, pvi int, sphb double, signal_iq int"
    )


@pytest.mark.parametrize(
    "spo2, tier", [(94.0, None), (93.9, "WARNING"), (90.0, "WARNING"), (89.9, "URGENT"), (85.0, "URGENT"), (84.9, "CRITICAL")]
)
def test_spo2_tiers(spark, spo2, tier):
    out = alerts.spo2_alerts(readings(spark, [("D", 10, spo2, 70)]), NOW).collect()
    assert [r.alert_tier for r in out] == ([tier] if tier else [])


@pytest.mark.parametrize(
    "pr, tier, kind",
    [
        (110, None, None), (111, "WARNING", "PR_HIGH"), (130, "WARNING", "PR_HIGH"), (131, "URGENT", "PR_HIGH"),
        (150, "URGENT", "PR_HIGH"), (151, "CRITICAL", "PR_HIGH"), (50, None, None), (49, "WARNING", "PR_LOW"),
        (45, "WARNING", "PR_LOW"), (44, "URGENT", "PR_LOW"), (40, "URGENT", "PR_LOW"), (39, "CRITICAL", "PR_LOW"),
    ],
)
def test_pulse_tiers(spark, pr, tier, kind):
    out = alerts.pulse_alerts(readings(spark, [("D", 10, 98, pr)]), NOW).collect()
    assert [(r.alert_tier, r.alert_type) for r in out] == ([(tier, kind)] if tier else [])


def test_both_pulse_sides(spark):
    row = alerts.pulse_alerts(readings(spark, [("D", 10, 98, 131), ("D", 20, 98, 39)]), NOW).first()
    assert (row.alert_type, row.alert_tier, row.metric_value, row.threshold_value) == ("PR_BOTH", "CRITICAL", 131.0, 150.0)
    assert "high=131 / low=39" in row.message


@pytest.mark.parametrize("age, status", [(29, "ONLINE"), (30, "STALE"), (119, "STALE"), (120, "OFFLINE")])
def test_device_status(spark, age, status):
    assert telemetry.device_status(readings(spark, [("D", age, 98, 70)]), NOW).first().status == status


def test_window_is_strict(spark):
    df = readings(spark, [("IN", 299, 98, 70), ("EDGE", 300, 98, 70)])
    assert [r.device_id for r in telemetry.vitals_trend(df, NOW, 5).collect()] == ["IN"]


def test_single_reading_has_no_deviation(spark):
    row = telemetry.vitals_trend(readings(spark, [("D", 10, 98, 70)]), NOW).first()
    assert row.stddev_spo2 is None and row.readings == 1


def test_empty_window(spark):
    df = readings(spark, [("D", 4000, 80, 200)])
    assert telemetry.vitals_trend(df, NOW).count() == 0
    assert alerts.clinical_alerts(df, NOW).count() == 0
    assert telemetry.current_device_summary(df, NOW).first()[0] == 0


def test_implausible_values(spark):
    df = readings(spark, [("ZERO", 10, 0, 70), ("FULL", 10, 100, 70), ("NULL", 10, None, 70), ("LOW", 10, 88, 70)])
    raw = {r.device_id for r in alerts.spo2_alerts(df, NOW).collect()}
    plausible = {r.device_id for r in alerts.spo2_alerts(df, NOW, mode="plausible").collect()}
    assert raw == {"ZERO", "LOW"} and plausible == {"LOW"}
    with pytest.raises(ValueError):
        alerts.spo2_alerts(df, NOW, mode="other")


def test_wider_window_keeps_alerts(spark):
    df = readings(spark, [("A", 100, 88, 70), ("B", 2000, 84, 140), ("C", 5000, 99, 160)])
    found = [{r.device_id for r in alerts.clinical_alerts(df, NOW, m).collect()} for m in (5, 60, 120)]
    assert found[0] <= found[1] <= found[2] and found[2] == {"A", "B", "C"}


def test_row_order_does_not_matter(spark, rows):
    df = readings(spark, [(f"D{i % 3}", i * 7 % 290, 80 + i % 19, 40 + i * 3 % 120) for i in range(60)])
    again = df.repartition(7, "event_id").orderBy(F.rand(3))
    assert rows(telemetry.vitals_trend(df, NOW)) == rows(telemetry.vitals_trend(again, NOW))
    assert rows(alerts.clinical_alerts(df, NOW)) == rows(alerts.clinical_alerts(again, NOW))


def test_escalation(spark):
    got = spark.createDataFrame(
        [(t, r) for t in ("CRITICAL", "URGENT", "WARNING") for r in (True, False)], "t string, r boolean"
    ).select("t", "r", alerts.escalate(F.col("t"), F.col("r")).alias("o"))
    assert {(x.t, x.r): x.o for x in got.collect()} == {
        ("CRITICAL", True): "CRITICAL", ("CRITICAL", False): "CRITICAL", ("URGENT", True): "CRITICAL",
        ("URGENT", False): "URGENT", ("WARNING", True): "URGENT", ("WARNING", False): "WARNING",
    }


def claims(spark, rows):
    """rows: (claim, provider, amount, procedure, flags)."""
    data = [
        (c, NOW - timedelta(minutes=5), "CLAIM_SUBMITTED", "p", pr, "I10", proc, "Emergency", a, 1.0, 2.0, fl)
        for c, pr, a, proc, fl in rows
    ]
    return spark.createDataFrame(
        data,
        "claim_id string, event_timestamp timestamp, event_type string, patient_id string, provider_id string, diagnosis_code string, "
        "procedure_code string, claim_type string, claim_amount double, latitude double, longitude double, injected_fraud_flags string",
    )


def test_fraud_points_and_flags(spark):
    df = claims(
        spark,
        [
            ("none", "A", 10.0, "1", ""), ("out", "B", 10.0, "1", "amount_outlier"), ("up", "C", 10.0, "99215", ""),
            ("mix", "D", 10.0, "99215", "amount_outlier|denial_pattern"), ("near", "E", 10.0, "1", "amount_outlier_x"),
        ],
    )
    got = {r.claim_id: r for r in payer.fraud_risk(df, NOW).collect()}
    assert {k: (v.fraud_score, v.risk_tier) for k, v in got.items()} == {
        "none": (0.0, "LOW"), "out": (25.0, "MEDIUM"), "up": (20.0, "LOW"), "mix": (70.0, "HIGH"), "near": (0.0, "LOW"),
    }
    # Five joined slots, double bars replaced once: stray bars stay.
    assert got["none"].fraud_flags == "||"
    assert got["mix"].fraud_flags == "|amount_outlier|denial_pattern|upcoding|amount_outlier|denial_pattern"
    assert got["none"].amount_zscore == 0.0


def test_fraud_velocity(spark):
    busy = [(f"c{i}", "BUSY", 10.0, "99215", "denial_pattern|amount_outlier") for i in range(20)]
    half = [(f"h{i}", "HALF", 10.0, "1", "") for i in range(10)]
    got = {r.claim_id: r for r in payer.fraud_risk(claims(spark, busy + half), NOW).collect()}
    assert got["c0"].fraud_score == 100.0 and got["c0"].risk_tier == "CRITICAL"
    assert got["h0"].fraud_score == 15.0


def test_high_cost_ed_and_case(spark):
    df = claims(spark, [(f"c{i}", "A", 10.0, "1", "") for i in range(3)])
    row = payer.high_cost_trajectory(df, NOW).first()
    assert (row.ed_visits_30d, row.risk_tier, row.cost_trend) == (3, "HIGH", "ACCELERATING")


def test_gap_status_ignores_case(spark):
    gaps = spark.createDataFrame(
        [("p", "m", "t", "OPEN", 90, "a"), ("q", "m", "t", "open", 89, "a"), ("r", "m", "t", "closed", 99, "a")],
        "patient_id string, measure_id string, gap_type string, gap_status string, days_overdue int, recommended_action string",
    )
    got = {r.patient_id: r.alert_priority for r in payer.care_gap_on_alert(spark, gaps, NOW).collect()}
    assert got == {"p": "HIGH", "q": "MEDIUM"}
    assert payer.care_gap_on_alert(spark, None, NOW).columns[:2] == ["alert_id", "alert_timestamp"]


@pytest.mark.parametrize(
    "rate, stars, missing",
    [(51.9, 1, 0.1), (52.0, 2, 12.0), (63.9, 2, 0.1), (64.0, 3, 11.0), (75.0, 4, 11.0), (85.9, 4, 0.1), (86.0, 5, None)],
)
def test_stars(spark, rate, stars, missing):
    row = spark.range(1).select(
        quality.star(F.lit(rate)).alias("s"), F.round(quality.to_next_star(F.lit(rate), quality.star(F.lit(rate))), 6).alias("m")
    ).first()
    assert (row.s, row.m) == (stars, missing)


def test_adherence_cut(spark):
    fills = [("nine", m) for m in range(9)] + [("ten", m) for m in range(10)] + [("all", m) for m in range(13)]
    df = spark.createDataFrame(fills, "patient_id string, m int").select(
        "patient_id", F.lit("Metformin 500").alias("display"), F.add_months(F.lit("2025-07-01").cast("date"), F.col("m")).alias("authored_date")
    )
    got = {r.patient_id: (r.pdc_score, r.adherence_category, r.gap_days) for r in quality.medication_adherence(df).collect()}
    assert got == {"nine": (0.75, "Non-Adherent", 91), "ten": (0.83, "Adherent", 0), "all": (1.0, "Adherent", 0)}


@pytest.mark.parametrize("day, flag", [(0, 0), (1, 1), (30, 1), (31, 0)])
def test_readmission_days(spark, day, flag):
    out = datetime(2026, 1, 10, 10)
    df = spark.createDataFrame(
        [("a", "p", datetime(2026, 1, 8), out), ("b", "p", datetime(2026, 1, 10, 9) + timedelta(days=day), datetime(2026, 6, 1))],
        "encounter_id string, patient_id string, admit_date timestamp, discharge_date timestamp",
    )
    got = {r.encounter_id: r.readmitted_30d for r in risk.readmit_30d(df).collect()}
    assert got == {"a": flag, "b": 0}
