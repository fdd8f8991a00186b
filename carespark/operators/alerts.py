"""Clinical alerts from telemetry, their enrichment and their reports."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.lineage import cut_lineage
from ..functions.numbers import count_if, exact, mean, plain
from ..functions.text import any_of, cascade, filled, first_filled
from ..functions.tiers import (
    HIGH_RISK_CODES,
    PULSE_HIGH,
    PULSE_LOW,
    escalate,
    pulse_threshold,
    pulse_tier,
    spo2_threshold,
    spo2_tier,
    tier_rank,
    worst,
)
from ..functions.timing import as_column, compact_stamp, recent, seconds_between
from .telemetry import latest_columns


def _spo2(mode: str) -> Column:
    """Saturation under the chosen mode; implausible values become null."""
    value = F.col("spo2")
    if mode == "raw":
        return value
    if mode == "plausible":
        return F.when((value > 0) & (value < 100), value)
    raise ValueError(f"unknown mode {mode!r}")


def spo2_alerts(
    readings: DataFrame, as_of, window_minutes: int = 5, mode: str = "raw"
) -> DataFrame:
    """Window-minimum saturation breaches. `plausible` drops values outside (0, 100)."""
    rows = recent(readings, "ts", as_of, minutes=window_minutes)
    value = _spo2(mode)
    if mode == "plausible":
        rows = rows.where(value.isNotNull())
        low = F.min("spo2").cast("double")
    else:
        low = F.round(F.min("spo2"), 1).cast("double")
    tier = F.col("alert_tier")
    head = F.concat(tier, F.lit(": Device "), "device_id")
    message = (
        F.concat(
            head,
            F.lit(" — SpO2 min="), plain(F.col("metric_value")),
            F.lit("%, avg="), plain(F.col("avg_spo2")),
            F.lit(f"% over last {window_minutes} min"),
        )
        if mode == "raw"
        else F.concat(tier, F.lit(" Dev:"), "device_id", F.lit(" SpO2="), plain(F.col("metric_value")))
    )
    return (
        rows.groupBy("device_id")
        .agg(
            F.count("*").alias("readings"),
            mean("spo2", 1).alias("avg_spo2"),
            low.alias("metric_value"),
            F.max("ts").alias("alert_time"),
        )
        .withColumn("alert_tier", spo2_tier(F.col("metric_value")))
        .where(tier.isNotNull())
        .select(
            "alert_time",
            "device_id",
            "alert_tier",
            F.lit("SPO2_LOW").alias("alert_type"),
            F.lit("spo2").alias("metric_name"),
            "metric_value",
            spo2_threshold(tier).alias("threshold_value"),
            message.alias("message"),
            "readings",
        )
    )


def _pulse_words(low: Column, high: Column) -> Column:
    is_high, is_low = high > 110, low < 50
    return F.concat(
        F.when(is_high, F.concat(F.lit("high="), high.cast("string"))).otherwise(""),
        F.when(is_high & is_low, F.lit(" / ")).otherwise(""),
        F.when(is_low, F.concat(F.lit("low="), low.cast("string"))).otherwise(""),
    )


def pulse_alerts(
    readings: DataFrame, as_of, window_minutes: int = 5, short_message: bool = False
) -> DataFrame:
    """Tachycardia / bradycardia over the window; the high side wins for the value."""
    low, high, tier = F.col("min_pr"), F.col("max_pr"), F.col("alert_tier")
    message = (
        F.concat(tier, F.lit(" Dev:"), "device_id", F.lit(" PR:"), high.cast("string"))
        if short_message
        else F.concat(
            tier, F.lit(": Device "), "device_id", F.lit(" — PR "), _pulse_words(low, high),
            F.lit(f" bpm over last {window_minutes} min"),
        )
    )
    return (
        recent(readings, "ts", as_of, minutes=window_minutes)
        .groupBy("device_id")
        .agg(
            F.count("*").alias("readings"),
            F.min("pr").alias("min_pr"),
            F.max("pr").alias("max_pr"),
            F.max("ts").alias("alert_time"),
        )
        .withColumn("alert_tier", pulse_tier(low, high))
        .where(tier.isNotNull())
        .select(
            "alert_time",
            "device_id",
            "alert_tier",
            cascade(
                [((high > 110) & (low < 50), "PR_BOTH"), (high > 110, "PR_HIGH")], "PR_LOW"
            ).alias("alert_type"),
            F.lit("pr").alias("metric_name"),
            F.when(high > 110, high).otherwise(low).cast("double").alias("metric_value"),
            pulse_threshold(tier, high > 110).alias("threshold_value"),
            message.alias("message"),
            "readings",
        )
    )


def clinical_columns(mode: str) -> list[Column]:
    """Everything both alert families and the newest vitals need, in one aggregation."""
    low = F.min(_spo2(mode))
    return [
        (F.round(low, 1) if mode == "raw" else low).cast("double").alias("min_spo2"),
        F.round(F.avg(exact(_spo2(mode))), 1).cast("double").alias("avg_spo2"),
        F.max(F.when(_spo2(mode).isNotNull(), F.col("ts"))).alias("spo2_time"),
        F.min("pr").alias("min_pr"),
        F.max("pr").alias("max_pr"),
        F.max("ts").alias("alert_time"),
        *latest_columns(["spo2", "pr", "pi", "sphb", "signal_iq"]),
    ]


def clinical_alerts(
    readings: DataFrame, as_of, window_minutes: int = 5, mode: str = "raw"
) -> DataFrame:
    """Multi-metric alerts: one aggregation instead of three scans and two joins."""
    s, p = F.col("spo2_tier"), F.col("pr_tier")
    span = F.lit(f" over last {window_minutes} min")
    detail = F.concat(
        F.when(
            s.isNotNull(),
            F.concat(
                F.lit(" | "), s, F.lit(": Device "), "device_id", F.lit(" — SpO2 min="),
                plain(F.col("min_spo2")), F.lit("%, avg="), plain(F.col("avg_spo2")), F.lit("%"), span,
            ),
        ).otherwise(""),
        F.when(
            p.isNotNull(),
            F.concat(
                F.lit(" | "), p, F.lit(": Device "), "device_id", F.lit(" — PR "),
                _pulse_words(F.col("min_pr"), F.col("max_pr")), F.lit(" bpm"), span,
            ),
        ).otherwise(""),
    )
    head = F.concat(
        "alert_tier", F.lit(" ALERT | Device: "), "device_id",
        F.lit(" | SpO2: "), plain(F.col("spo2")), F.lit("% | PR: "), F.col("pr").cast("string"),
        F.lit(" bpm"),
    )
    return (
        recent(readings, "ts", as_of, minutes=window_minutes)
        .groupBy("device_id")
        .agg(*clinical_columns(mode))
        .withColumn("spo2_tier", spo2_tier(F.col("min_spo2")))
        .withColumn("pr_tier", pulse_tier(F.col("min_pr"), F.col("max_pr")))
        .where(s.isNotNull() | p.isNotNull())
        .withColumn("alert_tier", worst(s, p))
        .select(
            F.concat(
                F.lit("ALERT-"), "device_id", F.lit("-"), compact_stamp(as_column(as_of))
            ).alias("alert_id"),
            # The plausible form dates a saturation alert by its own readings.
            (
                F.when(s.isNotNull(), F.col("spo2_time")).otherwise(F.col("alert_time"))
                if mode == "plausible"
                else F.col("alert_time")
            ).alias("alert_time"),
            "device_id",
            F.lit("").alias("patient_id"),
            F.lit("").alias("patient_name"),
            "alert_tier",
            cascade(
                [(s.isNotNull() & p.isNotNull(), "MULTI_METRIC"), (s.isNotNull(), "SPO2_LOW")],
                "PR_ABNORMAL",
            ).alias("alert_type"),
            "spo2",
            "pr",
            "pi",
            "sphb",
            "signal_iq",
            F.lit("").alias("qualifying_conditions"),
            (F.concat(head, detail) if mode == "raw" else head).alias("message"),
        )
    )


# --- enrichment -------------------------------------------------------------


def live_patient_id(ref: Column) -> Column:
    """Patient id as the live queries resolve it: original id, source reference, identifier."""
    return first_filled(
        ref["idOrig"],
        F.regexp_replace(ref["msftSourceReference"], "Patient/", ""),
        ref["identifier"]["value"],
    )


def device_patient_map(basics: DataFrame) -> DataFrame:
    """Device to patient rows from association resources.

    Input: `code` (coding array), `subject` (reference struct),
    `extension` (array of url + valueReference).
    """
    ext = F.col("ext")
    return (
        basics.where(F.col("code.coding")[0]["code"].isin("device-assoc", "ASSIGNED"))
        .select(live_patient_id(F.col("subject")).alias("patient_id"), F.explode("extension").alias("ext"))
        .where(any_of(ext["url"], ["associated-device", "device-association-device"]))
        .select(
            F.regexp_replace(ext["valueReference"]["reference"], "Device/", "").alias("device_id"),
            "patient_id",
        )
    )


def pick_name(name: Column) -> Column:
    """Text form, else first given plus family name."""
    return first_filled(
        name["text"], F.concat_ws(" ", name["given"][0], name["family"])
    )


def high_risk_conditions(conditions: DataFrame, codes: list[str] = HIGH_RISK_CODES) -> DataFrame:
    """Sorted comma list of qualifying condition names per patient."""
    return (
        conditions.where(F.col("code").isin(codes) & filled(F.col("patient_id")).isNotNull())
        .groupBy("patient_id")
        .agg(F.array_join(F.array_sort(F.collect_set("display")), ", ").alias("conditions"))
    )


def enriched_clinical_alerts(
    alerts: DataFrame, device_patients: DataFrame, patients: DataFrame, conditions: DataFrame
) -> DataFrame:
    """Add patient, conditions and one-step escalation to `clinical_alerts`.

    Conditions and names are reduced to the alerted patients (semi join) before
    any grouping, so the work follows the alerts and not the whole population.
    """
    linked = alerts.drop("patient_id", "patient_name").join(device_patients, "device_id", "left")
    alerted = linked.where(F.col("patient_id").isNotNull()).select("patient_id").distinct()
    names = patients.join(alerted, "patient_id", "left_semi").select("patient_id", "patient_name")
    risks = high_risk_conditions(conditions.join(alerted, "patient_id", "left_semi"))
    risky = filled(F.col("conditions")).isNotNull()
    final = escalate(F.col("alert_tier"), risky)
    return (
        linked.join(names, "patient_id", "left")
        .join(risks, "patient_id", "left")
        .withColumn("final_tier", final)
        .withColumn("escalated", F.col("final_tier") != F.col("alert_tier"))
        .select(
            "alert_id",
            "alert_time",
            "device_id",
            F.coalesce("patient_id", F.lit("")).alias("patient_id"),
            F.coalesce("patient_name", F.lit("(not linked)")).alias("patient_name"),
            F.col("final_tier").alias("alert_tier"),
            "alert_type",
            "spo2",
            "pr",
            "pi",
            "sphb",
            "signal_iq",
            F.coalesce("conditions", F.lit("")).alias("qualifying_conditions"),
            "escalated",
            F.concat(
                "final_tier", F.lit(" ALERT"),
                F.when(F.col("escalated"), F.lit(" (ESCALATED)")).otherwise(""),
                F.lit(" | Patient: "), F.coalesce("patient_name", F.lit("Unknown")),
                F.lit(" | Device: "), "device_id",
                F.lit(" | SpO2: "), plain(F.col("spo2")),
                F.lit("% | PR: "), F.col("pr").cast("string"), F.lit(" bpm"),
                F.when(risky, F.concat(F.lit(" | Conditions: "), "conditions")).otherwise(""),
            ).alias("message"),
        )
    )


UNKNOWN_SITE = "Unknown (no Encounter Location match)"


def patient_location(encounters: DataFrame, locations: DataFrame) -> DataFrame:
    """Site of the newest encounter per patient.

    Encounters `(patient_id, location_key, start)`; locations
    `(id, id_orig, name, latitude, longitude, city, state)` match on either id.
    """
    newest = (
        encounters.where(
            filled(F.col("patient_id")).isNotNull() & filled(F.col("location_key")).isNotNull()
        )
        # visits of a place are combined before the aggregate that sorts
        .groupBy("patient_id", "location_key")
        .agg(F.max("start").alias("start"))
        .groupBy("patient_id")
        .agg(F.max_by("location_key", F.struct("start", "location_key")).alias("location_key"))
    )
    sites = (
        locations.where(F.col("latitude").isNotNull())
        .select(
            F.explode(F.array_distinct(F.array("id", "id_orig"))).alias("location_key"),
            F.col("name").alias("location_name"),
            "latitude",
            "longitude",
            "city",
            "state",
        )
        .where(filled(F.col("location_key")).isNotNull())
    )
    return newest.join(sites, "location_key", "left").select(
        "patient_id",
        F.coalesce("location_name", F.lit(UNKNOWN_SITE)).alias("location_name"),
        F.coalesce("city", F.lit("Unknown")).alias("city"),
        F.coalesce("state", F.lit("")).alias("state"),
        "latitude",
        "longitude",
    )


def alert_location_map(enriched: DataFrame, places: DataFrame) -> DataFrame:
    """Alerts with their patient's site, defaults where none is known."""
    return enriched.join(places, "patient_id", "left").select(
        "alert_time", "device_id", "patient_id", "patient_name", "alert_tier", "alert_type",
        "spo2", "pr",
        F.coalesce("location_name", F.lit(UNKNOWN_SITE)).alias("location_name"),
        F.coalesce("city", F.lit("Unknown")).alias("city"),
        F.coalesce("state", F.lit("")).alias("state"),
        "latitude", "longitude", "qualifying_conditions", "escalated", "message",
    )


def alert_default_site(alerts: DataFrame, site: dict) -> DataFrame:
    """Alerts with one fixed site (`location_name city state latitude longitude`)."""
    label = f" | {site['city']}, {site['state']}"
    return alerts.select(
        "alert_time", "device_id", "alert_tier", "alert_type", "spo2", "pr",
        *[F.lit(site[k]).alias(k) for k in ("location_name", "city", "state", "latitude", "longitude")],
        F.concat("message", F.lit(label)).alias("message"),
    )


# --- persisted alert history --------------------------------------------------


def alert_history_transform(readings: DataFrame) -> DataFrame:
    """Row-level breaches of a batch or stream, both families in one pass.

    Stateless: each row carries an array of candidate alerts, exploded once.
    """
    spo2, pr = F.col("spo2").cast("double"), F.col("pr")
    s_tier, p_tier = spo2_tier(spo2), pulse_tier(pr, pr)
    high = pr > PULSE_HIGH["WARNING"]
    # The row-level pulse limit follows its own side, CRITICAL first.
    p_limit = cascade(
        [(pr > PULSE_HIGH[t], PULSE_HIGH[t]) for t in PULSE_HIGH]
        + [(pr < PULSE_LOW[t], PULSE_LOW[t]) for t in PULSE_LOW],
        PULSE_LOW["WARNING"],
    )
    stamp = compact_stamp("ts")

    def candidate(prefix, tier, kind, name, value, limit, reading_text, unit):
        return F.struct(
            F.concat(F.lit(prefix), "device_id", F.lit("-"), stamp).alias("alert_id"),
            tier.alias("alert_tier"),
            kind.alias("alert_type"),
            F.lit(name).alias("metric_name"),
            value.alias("metric_value"),
            limit.alias("threshold_value"),
            F.concat(
                tier, F.lit(": Device "), "device_id", reading_text,
                F.lit(f"{unit} (threshold: "), plain(limit), F.lit("%)" if unit == "%" else ")"),
            ).alias("message"),
        )

    candidates = F.array(
        F.when(
            s_tier.isNotNull(),
            candidate(
                "SPO2-", s_tier, F.lit("SPO2_LOW"), "spo2", spo2, spo2_threshold(s_tier),
                F.concat(F.lit(" SpO2="), plain(F.round("spo2", 1))), "%",
            ),
        ),
        F.when(
            p_tier.isNotNull(),
            candidate(
                "PR-", p_tier, F.when(high, F.lit("PR_HIGH")).otherwise(F.lit("PR_LOW")), "pr",
                pr.cast("double"), p_limit, F.concat(F.lit(" PR="), pr.cast("string")), " bpm",
            ),
        ),
    )
    alert = F.col("alert")
    field = lambda n: alert[n].alias(n)
    return (
        readings.select("ts", "device_id", F.explode(F.array_compact(candidates)).alias("alert"))
        .select(
            field("alert_id"),
            F.col("ts").alias("alert_time"),
            "device_id",
            F.lit("").alias("patient_id"),
            F.lit("").alias("patient_name"),
            *[field(n) for n in ("alert_tier", "alert_type", "metric_name", "metric_value", "threshold_value")],
            F.lit("").alias("qualifying_conditions"),
            field("message"),
            F.lit(False).alias("acknowledged"),
            F.lit("").alias("acknowledged_by"),
            F.lit(None).cast("timestamp").alias("acknowledged_at"),
        )
    )


def _tier_counts(total: str) -> list[Column]:
    tier = F.col("alert_tier")
    return [
        F.count("*").alias(total),
        *[count_if(tier == t.upper()).alias(t) for t in ("critical", "urgent", "warning")],
    ]


def tier_counts(alerts: DataFrame) -> DataFrame:
    return alerts.agg(*_tier_counts("open_alerts"))


def alerts_by_bin(history: DataFrame, as_of, hours: int = 24, bin: str = "15 minutes") -> DataFrame:
    return (
        recent(history, "alert_time", as_of, hours=hours)
        .groupBy("alert_tier", F.window("alert_time", bin).alias("w"))
        .agg(F.count("*").alias("alert_count"))
        .select("alert_tier", F.col("w.start").alias("ts"), "alert_count")
    )


def noisy_devices(history: DataFrame, as_of, hours: int = 24, limit: int = 10) -> DataFrame:
    return (
        recent(history, "alert_time", as_of, hours=hours)
        .groupBy("device_id")
        .agg(
            *_tier_counts("total_alerts"),
            F.max("alert_time").alias("last_alert"),
            F.count_distinct("patient_id").alias("patients"),
        )
        .orderBy(F.desc("total_alerts"), "device_id")
        .limit(limit)
    )


def current_alert_severity(history: DataFrame, as_of, window_minutes: int = 15) -> DataFrame:
    """Alert counts by severity over the newest history."""
    return (
        recent(history, "alert_time", as_of, minutes=window_minutes)
        .groupBy(F.col("alert_tier").alias("severity"))
        .agg(F.count("*").alias("alert_count"))
        .withColumn("window_minutes", F.lit(window_minutes))
        .withColumn("as_of_utc", as_column(as_of))
    )


def clinical_aggregate_summary(
    readings: DataFrame, history: DataFrame, as_of, device_minutes: int = 5,
    severity_minutes: int = 15, oxygen_minutes: int = 30, threshold: float = 94.0,
) -> DataFrame:
    """One row: severity counts, reporting devices, low-oxygen devices."""
    from .telemetry import current_device_summary, low_oxygen

    counts = recent(history, "alert_time", as_of, minutes=severity_minutes).agg(
        *_tier_counts("alert_count")
    )
    devices = current_device_summary(readings, as_of, device_minutes).select(
        "currently_reporting_devices", "latest_event_time_utc"
    )
    low = low_oxygen(readings, as_of, oxygen_minutes, threshold).select(
        F.col("device_count").alias("low_oxygen_devices")
    )
    return counts.crossJoin(devices).crossJoin(low)


# --- reports on enriched alerts -----------------------------------------------


def _age_minutes(as_of) -> Column:
    return F.round(seconds_between(as_column(as_of), "alert_time") / F.lit(60.0), 1)


def _action() -> Column:
    tier = F.col("alert_tier")
    return cascade(
        [
            (tier == "CRITICAL", "Immediate bedside assessment / escalation"),
            (tier == "URGENT", "Nurse review within 5 minutes"),
        ],
        "Monitor trend and verify sensor placement",
    )


def _risk(escalated_text: Column | str, none_text: str) -> Column:
    named = filled(F.col("qualifying_conditions"))
    return cascade(
        [(F.col("escalated"), escalated_text), (named.isNull(), none_text)],
        F.concat(F.lit("Conditions: "), named),
    )


def _worst_first(df: DataFrame, limit: int) -> DataFrame:
    return df.orderBy(
        tier_rank(F.col("alert_tier")), F.desc("alert_time"), "device_id"
    ).limit(limit)


def alert_feed(enriched: DataFrame, as_of, limit: int = 20) -> DataFrame:
    return _worst_first(
        enriched.select(
            "alert_tier", _age_minutes(as_of).alias("alert_age_minutes"), "alert_time", "device_id",
            "patient_name", "alert_type", "spo2", "pr", "signal_iq",
            _risk("Escalated by clinical context", "No condition escalation").alias("risk_context"),
            _action().alias("recommended_action"), "message",
        ),
        limit,
    )


def triage_queue(enriched: DataFrame, wider: DataFrame, as_of, limit: int = 100) -> DataFrame:
    """Feed plus a repeat mark from a wider window of alerts."""
    repeats = wider.groupBy("device_id").agg(F.count("*").alias("repeat_count"))
    named = filled(F.col("qualifying_conditions"))
    return _worst_first(
        enriched.join(repeats, "device_id", "left").select(
            "alert_tier", _age_minutes(as_of).alias("alert_age_minutes"), "alert_time", "device_id",
            "patient_name", "patient_id", "alert_type", "spo2", "pr", "signal_iq",
            F.coalesce(named, F.lit("Vital-sign threshold only")).alias("condition_summary"),
            _risk("Escalated by clinical context", "No condition escalation").alias("risk_context"),
            _action().alias("recommended_action"),
            F.when(F.col("repeat_count") > 1, F.lit("Repeat")).otherwise(F.lit("New")).alias("is_repeat_alert"),
            "message",
        ),
        limit,
    )


def alert_reasons(enriched: DataFrame, limit: int = 50) -> DataFrame:
    kind = F.col("alert_type")
    named = filled(F.col("qualifying_conditions"))
    return _worst_first(
        enriched.select(
            "alert_time", "alert_tier", "device_id", "patient_name",
            cascade(
                [
                    (kind == "SPO2_LOW", F.concat(F.lit("SpO2 "), plain(F.col("spo2")), F.lit("% below threshold"))),
                    (kind == "PR_ABNORMAL", F.concat(F.lit("Pulse "), F.col("pr").cast("string"), F.lit(" bpm outside threshold"))),
                ],
                "Multiple vital-sign thresholds breached",
            ).alias("reason"),
            _risk(
                F.concat(F.lit("Escalated by conditions: "), F.coalesce(named, F.lit(""))),
                "Vital-sign threshold only",
            ).alias("context"),
            _action().alias("recommended_action"),
        ),
        limit,
    )


def patient_risk_context(enriched: DataFrame, max_conditions: int = 5) -> DataFrame:
    """Alert totals and condition context per device and patient."""
    tier = F.col("alert_tier")
    listed = F.array_join(F.col("conditions"), ", ")
    return (
        enriched.groupBy("device_id", "patient_name", "patient_id")
        .agg(
            F.max("alert_time").alias("latest_alert"),
            F.count("*").alias("alert_count"),
            count_if(tier == "CRITICAL").alias("critical"),
            count_if(tier == "URGENT").alias("urgent"),
            F.slice(
                F.array_sort(F.collect_set(filled(F.col("qualifying_conditions")))), 1, max_conditions
            ).alias("conditions"),
            F.max("escalated").alias("escalated"),
        )
        .select(
            "device_id", "patient_name", "patient_id", "latest_alert", "alert_count", "critical", "urgent",
            cascade(
                [
                    (F.col("escalated"), F.concat(F.lit("Escalated by conditions: "), listed)),
                    (F.size("conditions") == 0, "Vital-sign threshold only"),
                ],
                F.concat(F.lit("Conditions: "), listed),
            ).alias("risk_context"),
        )
    )


def alerts_by_point(located: DataFrame) -> DataFrame:
    return located.groupBy("location_name", "latitude", "longitude", "city", "state").agg(
        *_tier_counts("alert_count"),
        F.count_distinct("patient_name").alias("patients"),
        F.count_distinct("device_id").alias("devices"),
    )


def alerts_by_site(located: DataFrame) -> DataFrame:
    return located.groupBy("location_name").agg(*_tier_counts("total"))


def alert_detail_device(enriched: DataFrame, devices: list[str], limit: int = 25) -> DataFrame:
    return (
        enriched.where(F.col("device_id").isin(devices))
        .select("alert_time", "alert_tier", "device_id", "patient_name", "spo2", "pr", "alert_type", "message")
        .orderBy(F.desc("alert_time"), "device_id")
        .limit(limit)
    )


def alert_detail_facility(located: DataFrame, limit: int = 100) -> DataFrame:
    return _worst_first(
        located.select(
            "alert_time", "alert_tier", "device_id", "patient_name", "alert_type", "spo2", "pr",
            "location_name", "city", "state", "qualifying_conditions", "message",
        ),
        limit,
    )


def triage_view(
    alerts: DataFrame, as_of, severities: list[str] | None = None, sites: list[str] | None = None,
    since=None, stale_minutes: int = 5,
) -> DataFrame:
    """Filtered alert list with normalised tier, status and staleness."""
    raw = F.upper(F.trim(F.col("alert_tier")))
    tier = F.when(raw.isin("CRITICAL", "URGENT", "WARNING"), raw).otherwise(F.lit("INFO"))
    rows = alerts.withColumn("severity", tier)
    if since is not None:
        rows = rows.where(F.col("alert_time") >= as_column(since))
    if severities:
        rows = rows.where(F.col("severity").isin(severities))
    if sites:
        rows = rows.where(F.col("location_name").isin(sites))
    return rows.withColumn(
        "is_stale", seconds_between(as_column(as_of), "alert_time") > stale_minutes * 60
    ).withColumn("status", F.when(F.col("acknowledged"), F.lit("ACKNOWLEDGED")).otherwise(F.lit("OPEN")))


def triage_totals(view: DataFrame) -> DataFrame:
    """Header counts for `triage_view`."""
    is_open = F.col("status") == "OPEN"
    return view.agg(
        F.count("*").alias("total"),
        count_if(is_open).alias("open"),
        count_if(is_open & F.col("severity").isin("CRITICAL", "URGENT")).alias("unresolved_urgent"),
        count_if(F.col("is_stale")).alias("stale"),
        F.max("alert_time").alias("latest_alert"),
    )


def readmission_digest(scores: DataFrame) -> DataFrame:
    """High-tier stays with a percent message, for a daily digest."""
    pct = plain(F.round(F.col("risk_probability").cast("decimal(18,6)") * 100, 1))
    return scores.where(F.col("risk_tier") == "High").select(
        "patient_id", "risk_tier", "risk_probability", "los_days",
        F.col("admit_date").cast("string").alias("admit_date"),
        F.concat(F.lit("30-day readmission risk "), pct, F.lit("%")).alias("message"),
    )


def notice_times(times, cooldown: int, last: int | None = None) -> list[int]:
    """Positions in ascending integer times that are notified: each at least `cooldown` after the one before.

    Jumps from notice to notice by binary search, so quiet stretches cost nothing.
    """
    chosen, at = [], 0 if last is None else int(times.searchsorted(last + cooldown))
    while at < len(times):
        chosen.append(at)
        at = int(times.searchsorted(times[at] + cooldown))
    return chosen


def exits(times, start: int, cooldown: int) -> list[tuple[int, int]]:
    """(upto, exit) of a block of ascending distinct times from `start` on, `upto` ascending.

    Whoever may notify from a time up to `upto` on, and after the `upto` before,
    sends the block's last notice at `exit`. Only entries within one cooldown
    of the start can be told apart; walks that meet share their exit, so the table is short.
    """
    import numpy as np

    first = min(len(times), int(times.searchsorted(start + cooldown)) + 1)
    at, after = np.arange(first), times.searchsorted(times + cooldown)
    while True:
        following = after[at]
        moved = np.where(following < len(times), following, at)
        if (moved == at).all():
            break
        at = moved
    out = times[at]
    kept = np.append(out[1:] != out[:-1], True)
    return list(zip(times[:first][kept].tolist(), out[kept].tolist()))


#: Cooldowns that make up a time block.
BLOCK_COOLDOWNS = 16


def notify_candidates(
    alerts: DataFrame, cooldown_seconds: int, key: str = "device_id", ts: str = "alert_time"
) -> DataFrame:
    """CRITICAL / URGENT rows, at most one per key and rolling cooldown, and the alerts up to the next notice.

    `suppressed_from` counts the alerts from a notice to the next one, itself
    included. Of alerts at one time the smallest id is notified.

    Alerts are counted per key and time; a key's times are cut into blocks of
    `BLOCK_COOLDOWNS` cooldowns, each walked on its own. A block is first
    reduced to a table from the time at which it may notify to its last notice;
    these few rows are chained per key, and each block is walked again from
    the time the chain gives it. So a key with a third of all alerts is spread
    over its blocks, and no window or frame holds its rows.
    """
    import numpy as np
    import pyarrow as pa

    span = cooldown_seconds * 1_000_000
    length = span * BLOCK_COOLDOWNS
    urgent = alerts.where(F.col("alert_tier").isin("CRITICAL", "URGENT")).select(
        F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), "alert_id", "alert_tier"
    )
    block = F.expr(f"(at - pmod(at, {length}L)) div {length}L").alias("block")
    times = cut_lineage(urgent.groupBy(F.col("key").cast("string").alias("key"), block, "at").agg(F.count("*").alias("n")))

    def summary(table: pa.Table) -> pa.Table:
        at = np.sort(table["at"].to_numpy())
        number = table["block"][0].as_py()
        rows = exits(at, number * length, span)
        return pa.table({
            "key": pa.array([table["key"][0].as_py()] * len(rows), pa.string()), "block": pa.array([number] * len(rows), pa.int64()),
            "upto": pa.array([a for a, _ in rows], pa.int64()), "exit": pa.array([b for _, b in rows], pa.int64()),
        })

    def chain(table: pa.Table) -> pa.Table:
        out, last = [], None
        rows = sorted(zip(*(table[c].to_pylist() for c in ("block", "upto", "exit"))))
        for number, own in groupby(rows, key=lambda r: r[0]):
            out.append((number, last))
            own = list(own)
            entry = None if last is None else last + span
            last = next((e for _, upto, e in own if entry is None or upto >= entry), last)
        return pa.table({
            "key": pa.array([table["key"][0].as_py()] * len(out), pa.string()),
            "block": pa.array([b for b, _ in out], pa.int64()), "last": pa.array([e for _, e in out], pa.int64()),
        })

    def walk(table: pa.Table, entered: pa.Table) -> pa.Table:
        order = np.argsort(table["at"].to_numpy())
        at, n = table["at"].to_numpy()[order], table["n"].to_numpy()[order]
        last = entered["last"][0].as_py()
        chosen = notice_times(at, span, last)
        upto = np.concatenate(([0], np.cumsum(n)))
        rows = [(int(at[a]), int(upto[b] - upto[a])) for a, b in zip(chosen, [*chosen[1:], len(at)])]
        before = int(upto[chosen[0]] if chosen else upto[-1])
        if last is not None and before:
            rows.append((last, before))  # still suppressed by the notice of an earlier block
        return pa.table({
            "key": pa.array([table["key"][0].as_py()] * len(rows), pa.string()),
            "at": pa.array([a for a, _ in rows], pa.int64()), "n": pa.array([c for _, c in rows], pa.int64()),
        })

    tables = times.groupBy("key", "block").applyInArrow(summary, "key string, block long, upto long, exit long")
    entries = tables.groupBy("key").applyInArrow(chain, "key string, block long, last long")
    walked = times.groupBy("key", "block").cogroup(entries.groupBy("key", "block")).applyInArrow(walk, "key string, at long, n long")
    notices = walked.groupBy("key", "at").agg(F.sum("n").alias("suppressed_from"))
    # only alerts at the time of a notice
    least = (
        urgent.alias("u").join(notices.alias("n"), F.col("u.key").cast("string").eqNullSafe(F.col("n.key")) & (F.col("u.at") == F.col("n.at")))
        .groupBy("u.key", "u.at", "suppressed_from").agg(F.min(F.struct("alert_id", "alert_tier")).alias("first"))
    )
    kinds = {f.name: f.dataType for f in alerts.schema}
    return least.select(
        F.col("key").alias(key), F.timestamp_micros("at").cast(kinds[ts]).alias(ts), "first.alert_id", "first.alert_tier", "suppressed_from"
    )
