"""Streams over bounded input equal their batch twins; late rows are counted."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from carespark.operators.alerts import alert_history_transform, notify_candidates
from carespark.functions.timing import recent
from carespark.operators.telemetry import binned_metric
from carespark.plans.live_alerts import compact_history, start_alert_history, start_history
from carespark.streaming import live, sinks

T0 = datetime(2026, 1, 1)
SCHEMA = "event_id long, device_id string, ts timestamp, spo2 double, pr int, pi double, pvi int, sphb double, signal_iq int"


def readings(spark, minutes, start=0):
    rows = [
        (start + i, f"D{i % 3}", T0 + timedelta(minutes=m), 80.0 + (i * 7) % 20, 40 + (i * 13) % 120, 2.0, 9, 12.0, 95)
        for i, m in enumerate(minutes)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def stream(spark, folder, batches):
    """One file per micro-batch."""
    for i, df in enumerate(batches):
        df.coalesce(1).write.mode("append").parquet(str(folder / "in"))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))


def finish(df, folder, mode="append"):
    out = str(folder / "out")
    w = df.writeStream.outputMode(mode).option("checkpointLocation", str(folder / "c")).trigger(availableNow=True)
    w.format("parquet").option("path", out).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(out)


def test_binned_metric_equals_batch(spark, tmp_path, rows):
    parts = [readings(spark, range(0, 40)), readings(spark, range(40, 80), 100), readings(spark, [300], 200)]
    got = finish(live.binned_metric(stream(spark, tmp_path, parts), "spo2", "10 minutes"), tmp_path)
    everything = parts[0].unionByName(parts[1])
    want = binned_metric(everything, "spo2", T0 + timedelta(days=1), "10 minutes", 100000)
    assert rows(got) == rows(want)


def test_rows_behind_the_watermark_are_dropped_and_counted(spark, tmp_path):
    parts = [readings(spark, [0, 60]), readings(spark, [61], 10), readings(spark, [62, 5], 20), readings(spark, [400], 30)]
    src = stream(spark, tmp_path, parts)
    got = finish(live.binned_metric(src, "spo2", "10 minutes", "10 minutes"), tmp_path)
    # The row at minute 5 came two batches after minute 60: its bin was already closed.
    first = got.where(F.col("ts") == T0).collect()
    assert [r.device_id for r in first] == ["D0"]

    late = str(tmp_path / "late")
    sink = sinks.late_row_sink(late, "ts", timedelta(minutes=10))
    src.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    counts = sorted((r.batch_id, r["rows"], r.late_rows) for r in spark.read.parquet(late).collect())
    assert counts == [(0, 2, 0), (1, 1, 0), (2, 2, 1), (3, 1, 0)]


def test_dedupe(spark, tmp_path):
    df = readings(spark, range(5))
    assert finish(live.dedupe_events(stream(spark, tmp_path, [df, df])), tmp_path).count() == 5


def test_alert_history_job(spark, tmp_path, rows):
    df = readings(spark, range(30))
    payload = F.to_json(F.struct("spo2", "pr", "pi", "pvi", "sphb", "signal_iq"))
    raw = df.select("event_id", "device_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), payload.alias("telemetry"))
    raw.write.parquet(str(tmp_path / "raw"))
    src = spark.readStream.schema(raw.schema).parquet(str(tmp_path / "raw"))
    start_alert_history(src, str(tmp_path / "hist"), str(tmp_path / "c"), once=True).awaitTermination()
    keep = ["alert_id", "alert_tier", "metric_value", "message"]
    assert rows(spark.read.parquet(str(tmp_path / "hist")).select(*keep)) == rows(alert_history_transform(df).select(*keep))


def alerts_frame(spark, minutes):
    return spark.createDataFrame(
        [(f"a{i:02d}", T0 + timedelta(minutes=m), "D", tier) for i, (m, tier) in enumerate(minutes)],
        "alert_id string, alert_time timestamp, device_id string, alert_tier string",
    )


def test_cooldown_rolls_over_batches(spark, tmp_path):
    parts = [[(0, "CRITICAL"), (30, "URGENT"), (59, "URGENT")], [(60, "WARNING"), (61, "URGENT"), (100, "CRITICAL")], [(121, "CRITICAL")]]
    n = 0
    for p in parts:
        df = alerts_frame(spark, p).withColumn("alert_id", F.concat(F.lit(f"b{n}-"), "alert_id"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        n += 1
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = finish(live.cooldown_notifications(src, 3600), tmp_path)
    minutes = sorted((r.alert_time - T0).total_seconds() / 60 for r in got.collect())
    assert minutes == [0, 61, 121]


def test_batch_cooldown_rolls(spark):
    minutes = [(59, "CRITICAL"), (61, "URGENT"), (118, "WARNING"), (119, "URGENT"), (170, "URGENT"), (230, "CRITICAL"), (289, "URGENT")]
    got = sorted((r.alert_id, r.suppressed_from) for r in notify_candidates(alerts_frame(spark, minutes), 3600).collect())
    assert got == [("a00", 2), ("a03", 2), ("a05", 2)]


def brute_notices(rows, seconds):
    """{key: [(alert_id, alerts up to the next notice)]} by one walk per key."""
    out = {}
    for key in {r[2] for r in rows}:
        own = sorted((r[1], r[0]) for r in rows if r[2] == key and r[3] in ("CRITICAL", "URGENT"))
        last = None
        for t, alert in own:
            if last is None or (t - last).total_seconds() >= seconds:
                out.setdefault(key, []).append([alert, 0])
                last = t
            out[key][-1][1] += 1
    return out


@pytest.mark.parametrize("seconds", [600, 3600])
def test_cooldown_in_blocks_equals_one_walk(spark, seconds):
    pick = random.Random(seconds)
    rows = [
        (f"a{i:05d}", T0 + timedelta(seconds=pick.choice([1, 60, 599, 600]) * pick.randrange(4000)), pick.choice(["hot", "hot", "D1", None]), pick.choice(["CRITICAL", "URGENT", "WARNING"]))
        for i in range(4000)
    ]
    # an endless run without a pause
    rows += [(f"b{i:05d}", T0 + timedelta(seconds=97 * i), "endless", "URGENT") for i in range(6000)]
    df = spark.createDataFrame(rows, "alert_id string, alert_time timestamp, device_id string, alert_tier string")
    got = {}
    for r in notify_candidates(df, seconds).orderBy("alert_time").collect():
        got.setdefault(r.device_id, []).append([r.alert_id, r.suppressed_from])
    assert got == brute_notices(rows, seconds)


def test_cooldown_stream_equals_batch_and_forgets_idle_keys(spark, tmp_path):
    pick = random.Random(4)
    rows = [(f"a{i:04d}", T0 + timedelta(seconds=30 * i + pick.randrange(600)), f"D{i % 3}" if i < 300 else "D9", "URGENT") for i in range(600)]
    parts = [rows[a:a + 150] for a in range(0, 600, 150)]
    closing = [("z", T0 + timedelta(days=2), "close", "CRITICAL")]
    for p in (*parts, closing):
        spark.createDataFrame(p, "alert_id string, alert_time timestamp, device_id string, alert_tier string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = finish(live.cooldown_notifications(src, 1800, delay="20 minutes"), tmp_path)
    found = {}
    for r in got.orderBy("alert_time").collect():
        found.setdefault(r.device_id, []).append(r.alert_id)
    assert found == {k: [a for a, _ in v] for k, v in brute_notices(rows, 1800).items()}
    left = spark.read.format("statestore").option("stateVarName", "waiting").load(str(tmp_path / "c"))
    assert {r.key.device_id for r in left.collect()} == {"close"}  # the watermark has not reached it
    last = spark.read.format("statestore").option("stateVarName", "last").load(str(tmp_path / "c"))
    assert last.count() == 0


def upsert_rows(spark):
    return lambda data: spark.createDataFrame(data, "k string, last_updated int, v string")


def test_upsert_touches_only_its_buckets(spark, tmp_path):
    path, make = str(tmp_path / "t"), upsert_rows(spark)
    merge = sinks.upsert_sink(path, ["k"], buckets=16)
    merge(make([(f"k{i}", 1, "old") for i in range(40)]), 0)
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "t").glob("bucket=*/*.parquet")}
    merge(make([("k3", 2, "new"), ("k4", 0, "stale"), ("k99", 1, "add")]), 1)
    got = {r.k: r.v for r in sinks.read_upserted(spark, path).collect()}
    assert len(got) == 41 and got["k3"] == "new" and got["k4"] == "old" and got["k99"] == "add"
    kept = {f for f in (tmp_path / "t").glob("bucket=*/*.parquet") if files.get(f) == f.stat().st_mtime_ns}
    assert len(kept) >= len(files) - 3


def test_upsert_replayed_and_empty_batches(spark, tmp_path, rows):
    path, make = str(tmp_path / "t"), upsert_rows(spark)
    batches = [make([("a", 1, "x"), ("b", 5, "y")]), make([("a", 3, "z")]), make([]), make([("b", 4, "late"), ("c", 1, "n")])]
    want = [("a", 3, "z"), ("b", 5, "y"), ("c", 1, "n")]
    for label in ("live", "again"):
        merge = sinks.upsert_sink(path, ["k"], buckets=4, label=label)
        for i, b in enumerate(batches):
            merge(b, i)
        merge(batches[-1], len(batches) - 1)
        assert rows(sinks.read_upserted(spark, path)) == want


def test_upsert_goes_on_from_staged_rows(spark, tmp_path, rows):
    path, make = str(tmp_path / "t"), upsert_rows(spark)
    merge = sinks.upsert_sink(path, ["k"], buckets=2)
    merge(make([(f"k{i}", 1, "old") for i in range(8)]), 0)
    merge(make([(f"k{i}", 2, "new") for i in range(8)]), 1)
    for f in (tmp_path / "t").glob("bucket=0/*"):  # as if the overwrite had broken off here
        f.rename(tmp_path / f"lost-{f.name}")
    assert sinks.read_upserted(spark, path).count() < 8
    merge(make([(f"k{i}", 2, "new") for i in range(8)]), 1)
    assert rows(sinks.read_upserted(spark, path)) == [(f"k{i}", 2, "new") for i in range(8)]


def test_running_scores_repeat_and_fold(spark, tmp_path, rows):
    merge = lambda r: r.groupBy("k").agg(F.sum("n").alias("n"))
    sink = sinks.running_scores_sink(
        lambda b: b.groupBy("k").agg(F.count("*").alias("n")), merge, str(tmp_path / "s"), fold_every=2,
        snapshot=lambda m: m, replace_path=str(tmp_path / "out"),
    )
    make = lambda keys: spark.createDataFrame([(k,) for k in keys], "k string")
    for i, keys in enumerate(["aab", "bc", "a", "c", "cc"]):
        sink(make(keys), i)
        sink(make(keys), i)  # repeated after a failure
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == [("a", 3), ("b", 2), ("c", 4)]
    assert sorted(p.name for p in (tmp_path / "s/base").glob("upto=*")) == ["upto=1", "upto=3"]


def test_a_calm_stream_closes_its_last_session(spark, tmp_path):
    breach = spark.createDataFrame([(1, "D", T0, 85.0, 70, 2.0, 9, 12.0, 95)], SCHEMA)
    calm = [spark.createDataFrame([(2 + i, "D", T0 + timedelta(minutes=30 * (i + 1)), 98.0, 70, 2.0, 9, 12.0, 95)], SCHEMA) for i in range(3)]
    got = finish(live.breach_sessions(stream(spark, tmp_path, [breach, *calm])), tmp_path).collect()
    assert [(r.device_id, r.breaches) for r in got] == [("D", 1)]


def test_newest_reading_writes_changed_devices_only(spark, tmp_path):
    seen = []
    make = lambda dev, minute, n: spark.createDataFrame([(n, dev, T0 + timedelta(minutes=minute), 95.0 + n, 70, 2.0, 9, 12.0, 95)], SCHEMA)
    src = stream(spark, tmp_path, [make("D1", 0, 1).unionByName(make("D2", 1, 2)), make("D2", 9, 3), make("D2", 5, 4)])
    merge = sinks.upsert_sink(str(tmp_path / "t"), ["device_id"], "timestamp", buckets=4)

    def sink(batch, batch_id):
        seen.append(sorted(r.device_id for r in batch.collect()))
        merge(batch, batch_id)

    live.latest_per_device(src).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert seen[:3] == [["D1", "D2"], ["D2"], ["D2"]]
    got = {r.device_id: r.spo2 for r in sinks.read_upserted(spark, str(tmp_path / "t")).collect()}
    assert got == {"D1": 96.0, "D2": 98.0}


def test_late_rows_are_those_behind_the_operators_watermark(spark, tmp_path):
    parts = [readings(spark, [0, 60]), readings(spark, [61], 10), readings(spark, [62, 5, 52], 20), readings(spark, [400, 40], 30)]
    src = stream(spark, tmp_path, parts)
    q = live.binned_metric(src, "spo2", "1 minute", "10 minutes").writeStream.format("memory").queryName("late_bins")
    q = q.option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    marks = {p["batchId"]: p["eventTime"]["watermark"] for p in q.recentProgress if p["numInputRows"]}
    sink = sinks.late_row_sink(str(tmp_path / "n"), "ts", timedelta(minutes=10), str(tmp_path / "late"), str(tmp_path / "good"))
    src.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    late = {(r.batch_id, r.ts) for r in spark.read.parquet(str(tmp_path / "late")).collect()}
    want = set()
    for i, df in enumerate(parts):
        mark = datetime.fromisoformat(marks[i].rstrip("Z"))
        want |= {(i, r.ts) for r in df.collect() if r.ts < mark}
    assert late == want == {(2, T0 + timedelta(minutes=5)), (3, T0 + timedelta(minutes=40))}
    assert spark.read.parquet(str(tmp_path / "good")).count() == 6


def test_history_by_day_is_compacted_and_pruned(spark, tmp_path, rows):
    days = [alerts_frame(spark, [(1440 * d + m, "URGENT") for m in range(5)]).withColumn("alert_id", F.concat(F.lit(f"d{d}-"), "alert_id")) for d in range(6)]
    for df in days:
        df.repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(days[0].schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    start_history(src, str(tmp_path / "h"), str(tmp_path / "c"), once=True).awaitTermination()
    assert len(list((tmp_path / "h").glob("day=*"))) == 6
    whole = compact_history(spark, str(tmp_path / "h"), str(tmp_path / "k"), "2026-01-05")
    assert rows(whole.drop("day")) == rows(spark.read.parquet(str(tmp_path / "h")).drop("day"))
    assert len(list((tmp_path / "k").glob("day=*/*.parquet"))) == 4
    late = recent(spark.read.parquet(str(tmp_path / "h")), "alert_time", "2026-01-06 00:00:00", days=1)
    assert late.count() == 9
    assert {f.split("day=")[1][:10] for f in late.inputFiles()} >= {"2026-01-05", "2026-01-06"}
    plan = late._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "day" in plan.split("PartitionFilters")[1].split("]")[0]


def test_ingest_sink_repeats_safely(spark, tmp_path):
    batch = spark.createDataFrame([('{"event_id":"1"}',), ("{",)], "value string")
    sink = sinks.ingest_sink("event_id string", str(tmp_path / "good"), str(tmp_path / "bad"))
    for _ in range(2):
        sink(batch, 0)
    assert spark.read.parquet(str(tmp_path / "good")).count() == 1
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 1
