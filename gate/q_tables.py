"""Layered tables, ingestion of all event kinds, retention and the Gold build, over the given tables."""


from pyspark.sql import DataFrame, functions as F

from carespark.operators import alerts as a
from carespark.operators.gates import row_count_report
from carespark.plans.gold_build import GoldBuild
from carespark.sources import events as ev, lakehouse as lh
from carespark.streaming import sinks

from .lake import Lake
from .q_streams import as_json, scratch, stream
from . import q_gold  # noqa: F401  (its queries count the Gold rows)
from .registry import SQL, day_text, query, ts_text


def lakehouse(k: Lake) -> lh.Lakehouse:
    return lh.Lakehouse(k.spark, scratch(k))


def silver_copy(k: Lake) -> DataFrame:
    lake = lakehouse(k)
    k.silver("patient").write.parquet(lake.path("silver", "Patient"))
    return lake.read_silver("Patient").select("idOrig", "birthDate", "gender", "site")


query("read_silver", 'select patient_id as "idOrig", cast(birth_date as varchar) as "birthDate", gender, site from v_patients')(silver_copy)


def merged_schema(k: Lake) -> DataFrame:
    """The second write lacks two columns of the first and brings a new one."""
    lake = lakehouse(k)
    coverage = k.typed("coverage")
    lake.write_gold(coverage.select("coverage_id", "payer_name", "type_code"), "dim")
    lake.write_gold(coverage.select("coverage_id", "patient_id"), "dim")
    return lake.read_gold("dim")


query("write_gold", "select coverage_id, patient_id, cast(null as varchar) as payer_name, cast(null as varchar) as type_code from v_coverage")(merged_schema)


def mirrored(k: Lake) -> DataFrame:
    folder = scratch(k)
    lh.mirror_write(k.claims.select("claim_id", "provider_id", "claim_amount"), [f"{folder}/{n}" for n in ("hot", "warm", "cold")])
    copy = lambda n: k.spark.read.parquet(f"{folder}/{n}").withColumn("target", F.lit(n))
    return copy("hot").unionByName(copy("warm")).unionByName(copy("cold"))


query("mirror_write", "select claim_id, provider_id, cast(claim_amount as double) as claim_amount, target from v_claims, (values ('hot'), ('warm'), ('cold')) t(target)")(mirrored)


def ensured(k: Lake) -> DataFrame:
    lake = lakehouse(k)
    lake.write_gold(k.claims.select("claim_id", "claim_amount"), "fact_claim")
    created = lake.ensure_gold_tables({"fact_claim": "claim_id string", "care_gaps": "patient_id string, measure_id string, gap_status string"})
    report = row_count_report({t: lake.read_gold(t) for t in ("fact_claim", "care_gaps")})
    return report.withColumn("created", F.col("table_name").isin(created))


query(
    "ensure_gold_tables",
    "select 'fact_claim' as table_name, count(*) as row_count, 0 as with_path, false as created from v_claims union all select 'care_gaps', 0, 0, true",
)(ensured)


def replaced(k: Lake) -> DataFrame:
    folder = scratch(k)
    score = lambda b: b.groupBy(F.concat(F.lit("prov-"), "l_suppkey").alias("provider_id")).agg(F.count("*").alias("provider_claims"))
    sink = sinks.snapshot_sink(score, replace_path=f"{folder}/scores")
    for n in ("first", "again"):  # a replay replaces the snapshot
        rows = stream(k, "lineitem").writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/{n}")
        rows.trigger(availableNow=True).start().awaitTermination()
    return k.spark.read.parquet(f"{folder}/scores")


query("snapshot_replace", "select provider_id, count(*) as provider_claims from v_claims group by 1")(replaced)


# --- event kinds: the same expressions make the rows in both engines ---
PLACE = [("latitude", "cast(33 + (num % 100) * 0.01 as double)"), ("longitude", "cast(-84 - (num % 100) * 0.01 as double)")]
KINDS = {
    "adt": (
        "encounters", ev.ADT,
        [
            ("event_id", "concat('ADT-', num)"), ("event_timestamp", "start_time"), ("event_type", "'ADT_A01'"), ("patient_id", "patient_id"),
            ("facility_id", "location_id"), ("facility_name", "concat('Hospital \"', location_id, '\"')"), ("admission_type", "encounter_class"),
            ("primary_diagnosis", "type_display"), *PLACE, ("has_open_care_gaps", "num % 2 = 0"), ("open_gap_measures", "case when num % 2 = 0 then 'CMS122|CMS165' end"),
        ],
    ),
    "rx": (
        "medications", ev.RX,
        [
            ("event_id", "concat('RX-', num)"), ("event_timestamp", "cast(authored_date as timestamp)"), ("event_type", "'RX_FILL'"), ("patient_id", "patient_id"),
            ("provider_id", "concat('prov-', num % 40)"), ("medication_code", "code"), ("medication_name", "display"), ("drug_class", "status"),
            ("quantity", "cast(num % 90 as int)"), ("days_supply", "cast(30 * (1 + num % 3) as int)"), *PLACE,
        ],
    ),
}
for _kind, (_view, _fields, _cols) in KINDS.items():
    _sql = ", ".join(f"{ts_text(f"date_trunc('second', {e})") if n == 'event_timestamp' else e} as {n}" for n, e in _cols)

    def _ingest(k: Lake, view=_view, fields=_fields, cols=_cols) -> DataFrame:
        rows = k.typed(view)
        text = as_json(rows.selectExpr(*[f"{e} as {n}" for n, e in cols]), F.regexp_extract("event_id", r"(\d+)$", 1).cast("bigint") % 40 == 0)
        return ev.split_bad_rows(ev.ingest_json(text, fields))[0]

    query(f"ingest_{_kind}", f"select {_sql} from v_{_view} where num % 40 <> 0")(_ingest)


def history(k: Lake) -> DataFrame:
    return a.alert_history_transform(k.telemetry)


ALERT_SQL = f"alert_id, {ts_text("date_trunc('second', alert_time)")} as alert_time, device_id, alert_tier, alert_type, cast(metric_value as double) as metric_value, cast(threshold_value as double) as threshold_value, message"
query("ingest_alerts", f"select {ALERT_SQL} from v_history")(
    lambda k: ev.split_bad_rows(ev.ingest_json(as_json(history(k), F.lit(False)), ev.ALERTS))[0].select(
        "alert_id", "alert_time", "device_id", "alert_tier", "alert_type", "metric_value", "threshold_value", "message"
    )
)


def retained(k: Lake) -> DataFrame:
    """History by day, rewritten without what is older than ten days."""
    folder = scratch(k)
    lh.with_day(history(k).select("alert_id", "alert_time"), "alert_time").write.partitionBy("day").parquet(f"{folder}/history")
    return lh.rewrite_retained(f"{folder}/history", f"{folder}/kept", k.spark, k.as_of, days=10)


query(
    "retention_rewrite",
    f"select alert_id, {ts_text('alert_time')} as alert_time, {day_text('alert_time')} as day from v_history where alert_time > (select as_of from v_as_of) - interval 10 day",
)(retained)

SILVER = {
    "Coverage": "coverage", "Condition": "condition", "ExplanationOfBenefit": "eob", "Patient": "patient",
    "Observation": "observation", "MedicationRequest": "medication", "Immunization": "immunization", "Encounter": "encounter",
}
#: The checked query that gives the rows of a Gold table.
COUNTED = {
    "dim_payer": "dim_payer", "dim_diagnosis": "dim_diagnosis", "fact_claim": "fact_claim", "fact_diagnosis": "fact_diagnosis",
    "agg_quality_measures": "quality_measures", "agg_quality_summary": "quality_summary", "agg_medication_adherence": "medication_adherence",
    "care_gaps": "care_gaps", "star_rating_detail": "star_detail", "star_rating_simulation": "star_simulation", "fact_patient_hcc": "hcc_hierarchy",
    "agg_risk_scores": "risk_scores", "agg_risk_summary": "risk_summary", "revenue_opportunity": "revenue_opportunity",
    "readmission_risk_scores": "readmission_scores", "agg_utilization_summary": "utilization_monthly", "agg_utilization_by_payer": "utilization_by_payer",
    "agg_cost_by_category": "cost_by_category", "agg_high_cost_claimants": "high_cost_claimants", "agg_condition_pmpm": "condition_pmpm",
}


def gold_gate(k: Lake) -> DataFrame:
    """All Gold tables from written Silver ones; row counts where a source row gives one."""
    lake = lakehouse(k)
    for name, table in SILVER.items():
        k.silver(table).write.option("compression", lh.COMPRESSION).parquet(lake.path("silver", name))
    gate = GoldBuild(k.spark, lake).run()
    return gate.select("table_name", F.when(F.col("table_name").isin(list(COUNTED)), F.col("row_count")).alias("row_count"), "status", "passed")


GOLD_TABLES = (
    "dim_payer dim_diagnosis fact_claim fact_diagnosis agg_quality_measures agg_quality_summary agg_medication_adherence care_gaps star_rating_detail "
    "star_rating_simulation dim_hcc fact_patient_hcc agg_risk_scores agg_risk_summary revenue_opportunity readmission_risk_scores readmission_risk_summary "
    "readmission_model_performance agg_utilization_summary agg_utilization_by_payer agg_cost_by_category agg_high_cost_claimants agg_condition_pmpm"
).split()
query(
    "gold_row_gate",
    " union all ".join(
        f"select '{t}' as table_name, {f'(select count(*) from ({SQL[COUNTED[t]]}))' if t in COUNTED else 'cast(null as bigint)'} as row_count, 'OK' as status, true as passed" for t in GOLD_TABLES
    ),
)(gold_gate)
