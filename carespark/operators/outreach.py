"""Outreach facts, cohort enrichment, upserts and run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ids import uuid5
from ..functions.ranking import sorted_index

# Name space of derived resource ids and provenance label.
NAMESPACE = "73590e85-86db-46ab-8a17-549b208963cc"
SOURCE = "synthetic-demo-enrichment"
# Payers in rotation, added conditions and monthly drugs.
PAYERS = [("Medicare", "MCR"), ("Medicaid", "MCD"), ("Commercial", "COMM")]
ADDED_CONDITIONS = [("44054006", "Type 2 diabetes mellitus"), ("59621000", "Essential hypertension")]
ADDED_DRUGS = [("860975", "metformin 500 MG Oral Tablet"), ("314076", "lisinopril 10 MG Oral Tablet"), ("617314", "atorvastatin 20 MG Oral Tablet")]


def resource_id(*parts) -> Column:
    return uuid5(NAMESPACE, *parts)


def created_day(df: DataFrame, scheduled: str, out: str = "created_day") -> DataFrame:
    """Report date from the scheduled timestamp, as a plain column."""
    return df.withColumn(out, F.to_date(scheduled))


def carry_event_time(tasks: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """Tasks keep the creation time of their source event."""
    return tasks.join(events.select(key, F.col("created_on")), key, "left")


def marketing_events(
    appointments: DataFrame, journeys: DataFrame, assets: DataFrame, channels: DataFrame
) -> DataFrame:
    """One labelled event per appointment for the first journey, asset and e-mail channel.

    The key hashes the appointment key: no global row number is needed.
    """
    first = lambda df, key: F.broadcast(df.agg(F.min(key).alias(key)).where(F.col(key).isNotNull()))
    mail = channels.where(F.col("channel_name") == "Email")
    day = F.col("appointment_scheduled_date")
    return (
        appointments.crossJoin(first(journeys, "journey_key"))
        .crossJoin(first(assets, "asset_key"))
        .crossJoin(first(mail, "channel_key"))
        .select(
            F.xxhash64("appointment_key").alias("marketing_event_key"),
            "patient_key", "journey_key", "appointment_key", "channel_key", "asset_key",
            F.to_date(day).alias("event_date"),
            F.date_format(day, "MMM-yyyy").alias("event_month_year"),
            F.lit(SOURCE).alias("source_table"),
        )
    )


def outreach_sources(patients: DataFrame, stamp: Column) -> dict[str, DataFrame]:
    """Contacts, journey instances, sent and opened messages per patient.

    Every third patient in id order did not open the message.
    """
    journey, message = resource_id("outreach", "journey"), resource_id("outreach", "email")
    rows = sorted_index(patients.select("patient_id"), "patient_id", "index").select(
        "patient_id",
        "index",
        resource_id(F.col("patient_id"), "outreach-contact").alias("contact_id"),
        resource_id(F.col("patient_id"), "journey-instance").alias("instance_id"),
        stamp.alias("modified_on"),
        F.lit(SOURCE).alias("scenario_source"),
    )

    def sent(kind: str, df: DataFrame) -> DataFrame:
        return df.select(
            F.col("modified_on").alias("timestamp"),
            resource_id(F.col("patient_id"), kind).alias("interaction_id"),
            F.col("contact_id").alias("profile_id"),
            journey.alias("journey_id"),
            message.alias("message_id"),
            F.col("instance_id").alias("journey_run_id"),
            "scenario_source",
        )

    return {
        "contact": rows.select("contact_id", "modified_on", F.col("patient_id").alias("fhir_id"), "scenario_source"),
        "journey_instance": rows.select(
            "instance_id", journey.alias("journey_id"), F.col("contact_id").alias("target_id"), "modified_on", "scenario_source"
        ),
        "email_sent": sent("emailsent", rows),
        "email_opened": sent("emailopened", rows.where("index % 3 <> 0")),
    }


def enrich_cohort(
    patients: DataFrame, year: int, month: int, day: int, scenario_patients: int | None = None
) -> DataFrame:
    """Coverage, appointment, conditions and monthly fills as tagged resource rows.

    Conditions and fills go to all patients, or to the first `scenario_patients`
    in id order; fills are monthly for even indexes and every second month for odd ones.
    """
    indexed = sorted_index(patients.select("patient_id"), "patient_id", "index")
    pid, i = F.col("patient_id"), F.col("index")
    as_of = F.make_date(F.lit(year), F.lit(month), F.lit(day))
    subject = F.struct(F.concat(F.lit("Patient/"), pid).alias("reference"))
    tag = F.struct(F.array(F.struct(F.lit(SOURCE).alias("code"))).alias("tag"))

    def rows(df: DataFrame, kind: str, rid: Column, **members: Column) -> DataFrame:
        body = F.struct(
            F.lit(kind).alias("resourceType"), rid.alias("id"), *[c.alias(n) for n, c in members.items()], tag.alias("meta")
        )
        return df.select("patient_id", F.lit(kind).alias("resource_type"), rid.alias("resource_id"), F.to_json(body).alias("resource"))

    payer = F.element_at(
        F.array(*[F.struct(F.lit(n).alias("name"), F.lit(c).alias("code")) for n, c in PAYERS]), (i % 3 + 1).cast("int")
    )
    coverage = rows(
        indexed, "Coverage", resource_id(pid, "coverage"), status=F.lit("active"), beneficiary=subject,
        payor=F.array(F.struct(F.concat(F.lit("Synthetic Demo "), payer["name"]).alias("display"))),
        type=F.struct(F.array(F.struct(payer["code"].alias("code"), payer["name"].alias("display"))).alias("coding"), payer["name"].alias("text")),
        period=F.struct(F.lit(f"{year}-01-01").alias("start"), F.lit(f"{year}-12-31").alias("end")),
    )
    start = F.date_sub(as_of, (1 + i % 28).cast("int"))
    appointment = rows(
        indexed, "Appointment", resource_id(pid, "appointment"),
        status=F.when(i % 3 != 0, "fulfilled").otherwise("booked"),
        start=F.concat(start.cast("string"), F.lit("T14:00:00Z")), end=F.concat(start.cast("string"), F.lit("T14:30:00Z")),
        created=F.concat(F.date_sub(start, 7).cast("string"), F.lit("T14:00:00Z")),
        participant=F.array(F.struct(subject.alias("actor"), F.lit("accepted").alias("status"))),
    )
    chosen = indexed if scenario_patients is None else indexed.where(i < scenario_patients)
    literal = lambda pairs: F.inline(F.array(*[F.struct(F.lit(c).alias("code"), F.lit(n).alias("display")) for c, n in pairs]))
    concept = F.struct(F.array(F.struct("code", "display")).alias("coding"), F.col("display").alias("text"))
    conditions = rows(
        chosen.select("*", literal(ADDED_CONDITIONS)), "Condition", resource_id(pid, "condition", F.col("code")),
        code=concept, subject=subject, recordedDate=F.lit(f"{year}-01-01"),
        clinicalStatus=F.struct(F.array(F.struct(F.lit("active").alias("code"))).alias("coding")),
    )
    step = F.when(i % 2 == 0, 1).otherwise(2)
    fills = chosen.select("*", F.explode(F.sequence(F.lit(1), F.lit(month), step)).alias("month")).select("*", literal(ADDED_DRUGS))
    medications = rows(
        fills, "MedicationRequest", resource_id(pid, "medication", F.col("code"), year, F.col("month").cast("string")),
        status=F.lit("active"), intent=F.lit("order"), subject=subject, medicationCodeableConcept=concept,
        authoredOn=F.format_string(f"{year}-%02d-01", "month"),
    )
    return coverage.unionByName(appointment).unionByName(conditions).unionByName(medications)


# --- upserts and logs ---------------------------------------------------------------


def upsert_latest(
    current: DataFrame, updates: DataFrame, keys: list[str], updated: str = "last_updated"
) -> DataFrame:
    """Idempotent merge: per key the row with the newest update time wins.

    Ties keep the updates' row, then the larger row, so replays change nothing.
    """
    rest = [c for c in current.columns if c not in keys]
    tagged = current.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    row = F.struct(F.col(updated), F.col("_new"), *[c for c in rest if c != updated])
    best = tagged.groupBy(*keys).agg(F.max(row).alias("m"))
    return best.select(*keys, *[f"m.{c}" for c in rest])


def replay_check(before: DataFrame, after: DataFrame, keys: list[str], errors: DataFrame) -> DataFrame:
    """Verdict of a replay: no key lost, no error logged."""
    lost = before.join(after, keys, "left_anti").agg(F.count("*").alias("lost_keys"))
    counts = before.agg(F.count("*").alias("rows_before")).crossJoin(after.agg(F.count("*").alias("rows_after")))
    logged = errors.where(F.lower("severity") == "error").agg(F.count("*").alias("errors"))
    return counts.crossJoin(lost).crossJoin(logged).withColumn(
        "passed", (F.col("lost_keys") == 0) & (F.col("errors") == 0)
    )


def latest_errors(log: DataFrame, activities: list[str] | None = None) -> DataFrame:
    """Newest error per activity."""
    rows = log.where(F.lower("severity") == "error")
    if activities:
        rows = rows.where(F.col("activity_name").isin(activities))
    return (
        rows.groupBy("activity_name")
        .agg(F.max(F.struct("event_time", "message")).alias("m"), F.count("*").alias("errors"))
        .select("activity_name", "m.event_time", "m.message", "errors")
    )


def run_summary(runs: DataFrame, since=None) -> DataFrame:
    """Status and record totals per activity and batch outcome."""
    rows = runs if since is None else runs.where(F.col("created") >= since)
    ok = F.lower("status").isin("succeeded", "success", "completed")
    return (
        rows.groupBy("activity_name", "status")
        .agg(
            F.count("*").alias("batches"),
            F.sum("source_records").alias("source_records"),
            F.sum("target_records").alias("target_records"),
        )
        .withColumn("is_ok", ok)
    )
