"""Streaming forms run over the given tables and compared with batch SQL.

Each query starts a stream over the events file, lets it finish, and returns
the written rows. Folders live under the session's checkpoint folder.
"""

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, functions as F

from carespark.functions.lineage import checkpoint_folder
from carespark.functions.timing import recent
from carespark.operators import alerts as a, payer as p
from carespark.plans import live_alerts
from carespark.sources import events as ev
from carespark.streaming import live, sinks

from .lake import Lake
from .q_alerts import TIER_P, TIER_S
from .q_payer import HAS, MONTH
from .registry import CTES, avg_dec, query, ts_text


def scratch(k: Lake) -> str:
    return f"{checkpoint_folder(k.spark)}/stream-{uuid.uuid4().hex}"


def stream(k: Lake, table: str) -> DataFrame:
    """The parquet file of a table as a stream."""
    return k.spark.readStream.schema(k.table(table).schema).parquet(f"{k.folder}/{table}*.parquet")


def readings(k: Lake) -> DataFrame:
    _, _, cols = k._views["telemetry"]
    return stream(k, "events").selectExpr(*[f"{e} as {n}" for n, e in cols])


def run(k: Lake, df: DataFrame, mode: str = "append") -> DataFrame:
    """Run to the end; append writes files, update and complete keep the last result."""
    folder = scratch(k)
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        q = writer.format("parquet").option("path", f"{folder}/out").start()
    else:
        q = writer.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{folder}/out")).start()
    q.awaitTermination()
    return k.spark.read.schema(df.schema).parquet(f"{folder}/out")


FILES = 4


def in_batches(k: Lake, df: DataFrame, part, n: int) -> DataFrame:
    """The rows as a stream of `n` micro-batches: first those of part 0, then of part 1 and so on."""
    folder = f"{scratch(k)}/in"
    for i in range(n):
        df.where(part == i).repartition(FILES).write.mode("append").parquet(folder)
    return k.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", FILES).parquet(folder)


def by_time(k: Lake, n: int) -> DataFrame:
    """Readings as a stream of `n` micro-batches in order of time."""
    low, high = k.telemetry.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))), F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()
    part = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - low) * n / (high - low + 1))
    return in_batches(k, k.telemetry, part, n)


WATERMARK = "(select max(ts) from v_telemetry) - interval 10 minute"
query(
    "stream_alert_history",
    f"select alert_id, {ts_text('alert_time')} as alert_time, device_id, alert_tier, alert_type, metric_value, threshold_value, message from v_history",
)(lambda k: run(k, a.alert_history_transform(readings(k)).drop("acknowledged_at")).select("alert_id", "alert_time", "device_id", "alert_tier", "alert_type", "metric_value", "threshold_value", "message"))
query(
    "stream_binned_spo2",
    f"select device_id, {ts_text('b')} as ts, {avg_dec('spo2', 4, 1)} as avg_spo2 from (select *, time_bucket(interval 15 minute, ts) as b from v_telemetry) where b + interval 15 minute <= {WATERMARK} group by device_id, b",
)(lambda k: run(k, live.binned_metric(readings(k), "spo2", "15 minutes")))
CTES["v_sliding"] = """select t.*, w from v_telemetry t, (select unnest(range(0, 5)) as i) r, lateral (select time_bucket(interval 1 minute, ts) - to_minutes(i) as w)"""
query(
    "stream_sliding_vitals",
    f"""select device_id, {ts_text('w')} as window_start, {ts_text('w + interval 5 minute')} as window_end, readings, avg_spo2, min_spo2, max_spo2, avg_pr, min_pr, max_pr, {ts_text('last_reading')} as last_reading, {TIER_S.format(c='min_spo2')} as spo2_tier, {TIER_P.format(lo='min_pr', hi='max_pr')} as pr_tier
 from (select device_id, w, count(*) as readings, {avg_dec('spo2', 4, 1)} as avg_spo2, cast(round(min(spo2), 1) as double) as min_spo2, cast(round(max(spo2), 1) as double) as max_spo2, {avg_dec('pr', 0, 0)} as avg_pr, min(pr) as min_pr, max(pr) as max_pr, max(ts) as last_reading from v_sliding where w + interval 5 minute <= {WATERMARK} group by 1, 2)""",
)(lambda k: run(k, live.sliding_vitals(readings(k))))
query("stream_dedupe_events", f"select event_id, device_id, {ts_text('ts')} as ts from v_telemetry")(
    lambda k: run(k, live.dedupe_events(readings(k).unionByName(readings(k)).select("event_id", "device_id", "ts")))
)
query(
    "stream_latest_per_device",
    f"select device_id, {ts_text('ts')} as timestamp, cast(spo2 as double) as spo2, pr, cast(pi as double) as pi, pvi, cast(sphb as double) as sphb, signal_iq from v_latest",
)(lambda k: newest(k).select("device_id", "timestamp", "spo2", "pr", "pi", "pvi", "sphb", "signal_iq"))


def newest(k: Lake) -> DataFrame:
    """Changed devices of each of four batches, upserted into a table."""
    folder = scratch(k)
    sink = sinks.upsert_sink(f"{folder}/table", ["device_id"], "timestamp", buckets=8)
    rows = live.latest_per_device(by_time(k, 4)).writeStream.outputMode("update").foreachBatch(sink)
    rows.option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start().awaitTermination()
    return sinks.read_upserted(k.spark, f"{folder}/table")


CTES["v_breach"] = "select device_id, ts, spo2, pr from v_telemetry where spo2 < 94 or pr > 110 or pr < 50"
CTES["v_breach_runs"] = "select *, sum(new) over (partition by device_id order by ts) as run from (select *, case when ts >= lag(ts) over (partition by device_id order by ts) + interval 2 hour then 1 else 0 end as new from v_breach)"
query(
    "stream_breach_sessions",
    f"""select device_id, {ts_text('min(ts)')} as session_start, {ts_text('max(ts) + interval 2 hour')} as session_end, count(*) as breaches, cast(min(spo2) as double) as min_spo2, max(pr) as max_pr from v_breach_runs group by device_id, run
 having max(ts) + interval 2 hour <= (select max(ts) from v_telemetry) - interval 10 minute""",
)(lambda k: run(k, live.breach_sessions(by_time(k, 4), "2 hours")))


def stream_history(k: Lake) -> DataFrame:
    return a.alert_history_transform(readings(k)).select("alert_id", "alert_time", "device_id", "alert_tier")


CTES["v_ranked_alerts"] = "select *, row_number() over (partition by device_id order by alert_time, alert_id) as r from v_history where alert_tier in ('CRITICAL', 'URGENT')"
query(
    "stream_cooldown_notifications",
    f"select device_id, {ts_text('alert_time')} as alert_time, alert_id, alert_tier from v_notified where sent",
)(lambda k: run(k, live.cooldown_notifications(stream_history(k), 21600)))
CTES["v_notified"] = """select * from (with recursive walk as (select device_id, alert_time, alert_id, alert_tier, r, true as sent, alert_time as last from v_ranked_alerts where r = 1
 union all select n.device_id, n.alert_time, n.alert_id, n.alert_tier, n.r, n.alert_time >= w.last + interval 6 hour, case when n.alert_time >= w.last + interval 6 hour then n.alert_time else w.last end
 from walk w join v_ranked_alerts n on n.device_id = w.device_id and n.r = w.r + 1) select * from walk)"""


def claim_json(k: Lake) -> DataFrame:
    """Claim rows as JSON text; every 50th order's rows are cut short."""
    rows = stream(k, "lineitem").join(k.table("orders"), F.expr("l_orderkey = o_orderkey"))
    rows = rows.selectExpr("l_orderkey", *[f"{e} as {n}" for n, e in k._views["claims"][2]])
    return as_json(rows, F.col("l_orderkey") % 50 == 0)


def as_json(rows: DataFrame, cut) -> DataFrame:
    """Rows as JSON text with times to the second; `cut` ones are unreadable."""
    times = [f.name for f in rows.schema if f.dataType.typeName().startswith("timestamp")]
    text = F.to_json(F.struct(*[F.date_format(n, "yyyy-MM-dd HH:mm:ss").alias(n) if n in times else F.col(n) for n in rows.columns]))
    return rows.select(F.when(cut, F.substring(text, 1, 20)).otherwise(text).alias("value"))


def ingest(k: Lake) -> tuple[DataFrame, DataFrame]:
    folder = scratch(k)
    sink = sinks.ingest_sink(ev.CLAIMS, f"{folder}/good", f"{folder}/bad")
    claim_json(k).writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start().awaitTermination()
    return k.spark.read.parquet(f"{folder}/good"), k.spark.read.parquet(f"{folder}/bad")


CLAIM_FIELDS = [f.strip().split()[0] for f in ev.CLAIMS.split(",")]
query(
    "stream_ingest_claims",
    f"select * replace ({ts_text("date_trunc('second', event_timestamp)")} as event_timestamp, cast(claim_amount as double) as claim_amount) from v_claims where cast(split_part(event_id, '-', 2) as bigint) % 50 <> 0",
)(lambda k: ingest(k)[0].select(*CLAIM_FIELDS))
query("stream_ingest_rejects", "select count(*) as rejected from lineitem where l_orderkey % 50 = 0")(lambda k: ingest(k)[1].agg(F.count("*").alias("rejected")))


def upserted(k: Lake) -> DataFrame:
    folder = scratch(k)
    orders = k.table("orders").selectExpr("concat('pat-', o_custkey) as patient_id", "o_orderdate as last_updated", "concat('enc-', o_orderkey) as payload", "dayofyear(o_orderdate) % 3 as part")  # rows of one time meet in one batch
    src = in_batches(k, orders, F.col("part"), 3).drop("part")
    for n in ("first", "again"):  # the second run replays everything under a new checkpoint
        sink = sinks.upsert_sink(f"{folder}/table", ["patient_id"], buckets=16, label=n)
        start = lambda c: src.writeStream.foreachBatch(sink).option("checkpointLocation", c).trigger(availableNow=True).start()
        sinks.replay_from_new_checkpoint(start, f"{folder}/c", n)
    return sinks.read_upserted(k.spark, f"{folder}/table")


query(
    "stream_upsert_replayed",
    f"select patient_id, {ts_text('last_updated')} as last_updated, payload from (select concat('pat-', o_custkey) as patient_id, o_orderdate as last_updated, concat('enc-', o_orderkey) as payload from orders) qualify row_number() over (partition by patient_id order by last_updated desc, payload desc) = 1",
)(upserted)
query(
    "telemetry_source",
    f"select event_id, device_id, {ts_text("date_trunc('millisecond', ts)")} as ts, cast(spo2 as double) as spo2, pr, signal_iq from v_telemetry",
)(
    lambda k: ev.telemetry_readings(
        k.telemetry.select(
            "event_id", "device_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("timestamp"),
            F.to_json(F.struct("spo2", "pr", "pi", "pvi", "sphb", "signal_iq")).alias("telemetry"),
        )
    ).select("event_id", "device_id", "ts", "spo2", "pr", "signal_iq")
)
query(
    "external_static_table",
    "select device_id, patient_id, count(*) as readings from v_telemetry left join v_assoc using (device_id) group by 1, 2",
)(lambda k: run(k, ev.join_static(readings(k).select("device_id"), a.device_patient_map(k.basics), "device_id")).groupBy("device_id", "patient_id").agg(F.count("*").alias("readings")))
query(
    "snapshot_append",
    "select provider_id, count(*) as provider_claims from v_claims group by 1",
)(lambda k: snapshot(k))


def snapshot(k: Lake) -> DataFrame:
    folder = scratch(k)
    score = lambda b: b.groupBy(F.concat(F.lit("prov-"), "l_suppkey").alias("provider_id")).agg(F.count("*").alias("provider_claims"))
    sink = sinks.snapshot_sink(score, append_path=f"{folder}/scores")
    stream(k, "lineitem").writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start().awaitTermination()
    return k.spark.read.parquet(f"{folder}/scores").drop("batch_id")


query(
    "retention",
    f"select alert_id, {ts_text('alert_time')} as alert_time from v_history where alert_time > (select as_of from v_as_of) - interval 10 day",
)(lambda k: __import__("carespark.sources.lakehouse", fromlist=["x"]).retention(a.alert_history_transform(k.telemetry), k.as_of, days=10).select("alert_id", "alert_time"))


# --- scores over all batches so far ---
LIVE_RATE = (0.8, 0.4)
PARTS = 4


def live_claims(k: Lake) -> DataFrame:
    return in_batches(k, k.claims, F.dayofmonth("event_timestamp") % PARTS, PARTS)


def provider_scores(k: Lake) -> DataFrame:
    """The snapshot after the last of four batches; partial rows are folded after every second one."""
    folder = scratch(k)
    sink = sinks.running_scores_sink(
        p.provider_partials, p.merge_provider_partials, f"{folder}/state", fold_every=2,
        snapshot=lambda merged: p.provider_running_stats(merged, MONTH), replace_path=f"{folder}/scores",
    )
    live_claims(k).writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start().awaitTermination()
    rates = ["claims_per_hour", "avg_amount", "stdev_amount", "upcode_rate"]
    return k.spark.read.parquet(f"{folder}/scores").withColumns({c: F.round(c, 6) for c in rates})


CENTS = "cast(claim_amount * 100 as hugeint)"
SPREAD = "sqrt(cast(n * cc - c * c as double) / (n * cast(n - 1 as double))) / 100"
query(
    "live_provider_scores",
    f"""select provider_id, n as provider_claims, round(n * 60.0::double / 43200.0::double, 6) as claims_per_hour, round(cast(c as double) / (n * 100.0::double), 6) as avg_amount,
 case when n > 1 then round({SPREAD}, 6) end as stdev_amount, round(100.0::double * up / n, 6) as upcode_rate, cast(lo as double) as min_amount, cast(hi as double) as max_amount, {ts_text('t0')} as first_claim, {ts_text('t1')} as last_claim
 from (select provider_id, count(*) as n, sum({CENTS}) as c, sum({CENTS} * {CENTS}) as cc, count(*) filter (where procedure_code = '99215') as up, min(claim_amount) as lo, max(claim_amount) as hi, min(event_timestamp) as t0, max(event_timestamp) as t1 from v_claims group by 1)""",
)(provider_scores)


def fraud_scores(k: Lake) -> DataFrame:
    """Each batch's claims, scored by all claims of their providers so far and appended."""
    folder, as_of = scratch(k), k.claims.agg(F.max("event_timestamp")).first()[0]
    sink = sinks.running_scores_sink(
        p.provider_partials, p.merge_provider_partials, f"{folder}/state", fold_every=2,
        score=lambda claims, merged: p.score_claims(claims, p.provider_running_stats(merged, MONTH), as_of, LIVE_RATE), append_path=f"{folder}/scores",
    )
    live_claims(k).writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start().awaitTermination()
    rows = k.spark.read.parquet(f"{folder}/scores")
    return rows.select("batch_id", "claim_id", "provider_id", "fraud_score", "risk_tier", F.round("amount_zscore", 6).alias("amount_zscore"))


CTES["v_live_stats"] = f"""select b, provider_id, n, cast(c as double) / (n * 100.0::double) as mean, case when n > 1 then {SPREAD} end as spread from (
 select b, provider_id, count(*) as n, sum({CENTS}) as c, sum({CENTS} * {CENTS}) as cc from v_claims, (select unnest(range(0, {PARTS})) as b) where day(event_timestamp) % {PARTS} <= b group by 1, 2)"""
CTES["v_live_points"] = f"""select c.*, b, n * 60.0::double / 43200.0::double as claims_per_hour, case when spread > 0 then (cast(claim_amount as double) - mean) / spread else 0 end as z
 from v_claims c join v_live_stats s on s.provider_id = c.provider_id and s.b = day(c.event_timestamp) % {PARTS}"""
CTES["v_live_fraud"] = f"""select b, claim_id, provider_id, z, case when claims_per_hour >= {LIVE_RATE[0]} then 30 when claims_per_hour >= {LIVE_RATE[1]} then 15 else 0 end
 + case when z >= 3 or {HAS.format('amount_outlier')} then 25 else 0 end + case when {HAS.format('denial_pattern')} then 25 else 0 end
 + case when procedure_code = '99215' or {HAS.format('upcoding')} then 20 else 0 end as score from v_live_points"""
query(
    "live_fraud_scores",
    """select cast(b as integer) as batch_id, claim_id, provider_id, cast(score as double) as fraud_score,
 case when score >= 80 then 'CRITICAL' when score >= 50 then 'HIGH' when score >= 25 then 'MEDIUM' else 'LOW' end as risk_tier, round(z, 6) as amount_zscore from v_live_fraud""",
)(fraud_scores)

# --- rows behind the watermark of a running stream ---
CTES["v_arrivals"] = "select *, event_id % 3 as b from v_telemetry"
CTES["v_marks"] = "select b, n, late, top from (select b, count(*) as n, max(ts) as own from v_arrivals group by b) m, lateral (select max(ts) as top, max(ts) filter (where a.b < m.b) - interval 6 hour as late from v_arrivals a where a.b <= m.b)"


def arrivals(k: Lake) -> str:
    """Readings in three batches that each span all days; the folder of counts, late rows and others."""
    folder = scratch(k)
    sink = sinks.late_row_sink(f"{folder}/counts", "ts", timedelta(hours=6), f"{folder}/late", f"{folder}/good")
    src = in_batches(k, k.telemetry, F.col("event_id") % 3, 3)
    src.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start().awaitTermination()
    return folder


query(
    "late_rows",
    f"select cast(b as integer) as batch_id, n as n_rows, (select count(*) from v_arrivals a where a.b = m.b and a.ts < m.late) as late_rows, {ts_text('top')} as max_ts from v_marks m",
)(lambda k: k.spark.read.parquet(f"{arrivals(k)}/counts").select("batch_id", F.col("rows").alias("n_rows"), "late_rows", "max_ts"))
query(
    "late_row_events",
    f"select cast(b as integer) as batch_id, event_id, device_id, {ts_text('ts')} as ts, ts < late as is_late from v_arrivals join v_marks using (b) where ts < late or event_id % 2 = 0".replace("ts < late as", "coalesce(ts < late, false) as"),
)(
    lambda k: (lambda f: k.spark.read.parquet(f"{f}/late").withColumn("is_late", F.lit(True)).unionByName(
        k.spark.read.parquet(f"{f}/good").where("event_id % 2 = 0").withColumn("is_late", F.lit(False))
    ))(arrivals(k)).select("batch_id", "event_id", "device_id", "ts", "is_late")
)


# --- history by day, compacted, and a look-back that reads its days only ---
def history_table(k: Lake) -> DataFrame:
    folder = scratch(k)
    live_alerts.start_history(a.alert_history_transform(by_time(k, 3)), f"{folder}/history", f"{folder}/c", once=True).awaitTermination()
    before = k.telemetry.agg(F.date_sub(F.max("ts"), 3)).first()[0]
    return live_alerts.compact_history(k.spark, f"{folder}/history", f"{folder}/compact", str(before))


query(
    "stream_history_lookback",
    f"select alert_id, {ts_text('alert_time')} as alert_time, device_id, alert_tier from v_history where alert_time > (select as_of from v_as_of) - interval 5 day",
)(lambda k: recent(history_table(k), "alert_time", k.as_of, days=5).select("alert_id", "alert_time", "device_id", "alert_tier"))
