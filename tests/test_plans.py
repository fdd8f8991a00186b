"""Plans stay on the JVM, distributed, and read only what they need."""

import pytest
from pyspark.sql import functions as F

from carespark.plans.gold_build import GoldBuild, check
from carespark.sources.lakehouse import Lakehouse
from gate.catalog import QUERIES
from gate.lake import Lake

PYTHON = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "GroupsInPandas", "InArrow")
# Fits a model or starts a stream: its plan is only the final read.
EAGER = ("readmission_model", "stream_", "live_", "late_row", "external_static", "snapshot_", "gold_row_gate")
# Walks the alert times of a block in Python.
WALKS = {"notify_candidates"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


LAZY = [n for n in QUERIES if not n.startswith(EAGER) or n in ("stream_health", "stream_freshness_gate")]


@pytest.mark.parametrize("name", LAZY)
def test_no_python_and_no_cartesian_product(name, spark, folder):
    text = plan(QUERIES[name](spark, folder))
    assert name in WALKS or not any(p in text for p in PYTHON)
    assert "CartesianProduct" not in text


def test_notices_use_no_window(spark, folder):
    text = plan(QUERIES["notify_candidates"](spark, folder))
    assert "Window" not in text and "CartesianProduct" not in text


def test_streams_hold_keyed_state_without_whole_groups(spark, folder):
    from carespark.streaming import live

    rows = spark.readStream.schema("alert_id string, alert_time timestamp, device_id string, alert_tier string").parquet(f"{folder}/events.parquet")
    text = live.cooldown_notifications(rows, 3600)._jdf.queryExecution().analyzed().toString()
    assert "TransformWithState" in text and "FlatMapGroupsInPandasWithState" not in text


@pytest.mark.parametrize("name", ["clinical_alerts", "quality_measures", "fraud_risk", "readmit_30d", "cost_by_category", "latest_readings"])
def test_no_window_over_one_partition(name, spark, folder):
    text = plan(QUERIES[name](spark, folder))
    assert "Window [" not in text or "SinglePartition" not in text


@pytest.mark.parametrize("name", ["vitals_trend", "clinical_alerts", "latest_readings", "device_status"])
def test_device_aggregates_hash_without_sorting(name, spark, folder):
    text = plan(QUERIES[name](spark, folder))
    assert "HashAggregate" in text and "SortAggregate" not in text


def test_scan_reads_two_columns(spark, folder):
    df = Lake(spark, folder).claims.select("provider_id", "event_timestamp").groupBy("provider_id").agg(F.max("event_timestamp"))
    text = plan(df)
    assert "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint,l_shipdate:timestamp_ntz>" in text


def test_literal_time_bound_reaches_the_scan(spark, folder):
    from carespark.operators.telemetry import current_device_summary

    df = current_device_summary(Lake(spark, folder).telemetry, F.lit("2024-01-30").cast("timestamp_ntz"))
    assert "GreaterThan(ts," in plan(df)


def test_each_json_member_is_parsed_once(spark, folder):
    text = plan(Lake(spark, folder).conditions.where("patient_id <> ''").select("patient_id", "code"))
    assert text.count("from_json(") <= 3


def test_gold_build(spark, tmp_path, folder):
    lake = Lake(spark, folder)
    tables = {
        "Coverage": "coverage", "Condition": "condition", "ExplanationOfBenefit": "eob", "Patient": "patient",
        "Observation": "observation", "MedicationRequest": "medication", "Immunization": "immunization", "Encounter": "encounter",
    }
    for name, table in tables.items():
        lake.silver(table).write.parquet(f"{tmp_path}/silver/{name}")
    gate = GoldBuild(spark, Lakehouse(spark, str(tmp_path))).run()
    check(gate)
    assert gate.count() == 23
    failing = gate.limit(1).withColumn("passed", F.lit(False))
    with pytest.raises(RuntimeError):
        check(failing)


def test_stored_tables_are_compressed_with_zstd(spark, tmp_path):
    import pyarrow.parquet as pq

    lake = Lakehouse(spark, str(tmp_path))
    lake.write_gold(spark.range(1000).selectExpr("concat('pat-', id) as patient_id"), "t")
    GoldBuild(spark, lake).parsed("p", spark.range(10).selectExpr("id"))
    files = list(tmp_path.rglob("*.parquet"))
    assert files and all(pq.ParquetFile(f).metadata.row_group(0).column(0).compression == "ZSTD" for f in files if pq.ParquetFile(f).metadata.num_rows)


def test_claim_reports_parse_only_the_members_they_use(spark, folder):
    text = plan(Lake(spark, folder).rates)
    assert "total_string" in text and "payment_string" in text
    assert not any(c in text for c in ("provider_string", "facility_string", "billablePeriod_string"))


@pytest.mark.parametrize("name", ["utilization_kpis", "payer_segments", "payer_kpi_row", "kpi_snapshot", "series_snapshot", "graph_edge_counts"])
def test_reports_build_claims_once(name, spark, folder):
    Lake(spark, folder).silver("eob")
    df = QUERIES[name](spark, folder)
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert "insurance_string" not in text


def test_measures_are_built_once(spark, folder):
    for name in ("star_simulation", "provider_kpi_row"):
        text = QUERIES[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
        assert "valueQuantity_string" not in text


def test_stages_with_large_methods_are_run_by_operator(spark, folder):
    Lake(spark, folder)
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_bundle_files_are_written_without_a_checkpoint(spark, folder):
    from gate.q_bundles import file_loads

    table = file_loads(Lake(spark, folder))
    texts = spark.read.parquet(table.removesuffix("/table") + "/texts")
    assert texts.count() == texts.select("name").distinct().count() > 0


def test_file_texts_are_read_in_small_batches(spark, tmp_path):
    """A reader decodes up to 4096 rows of a row group at once: rows of whole files must not share large groups."""
    import pyarrow.parquet as pq

    from carespark.sources.bundle_files import load_changed_files, loaded_bundles

    (tmp_path / "in").mkdir()
    for i in range(600):
        (tmp_path / "in" / f"b{i}.json").write_text('{"resourceType":"Bundle","entry":[]}' + " " * i)
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")  # many files a task
    try:
        load_changed_files(spark, str(tmp_path / "in"), str(tmp_path / "table"), 0)
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    groups = [f.metadata.row_group(g).num_rows for f in map(pq.ParquetFile, (tmp_path / "table").rglob("*.parquet")) for g in range(f.metadata.num_row_groups)]
    assert sum(groups) == 600 and max(groups) <= 32
    assert loaded_bundles(spark, str(tmp_path / "table")).count() == 600


@pytest.mark.parametrize("name", ["utilization_monthly", "worklist_snapshot", "reference_integrity", "graph_nodes", "graph_fork_rows", "graph_fork_optional"])
def test_silver_is_built_within_the_query(name, spark, folder):
    read = QUERIES[name](spark, folder).inputFiles()
    assert not any("/lake-" in f for f in read)


def test_claim_ids_parse_no_coverage(spark, folder):
    text = plan(Lake(spark, folder).fact_claim.select("claim_id", "patient_id"))
    assert "patient_string" in text and "insurance_string" not in text


@pytest.mark.parametrize("name", ["graph_path", "graph_edge_audit"])
def test_graph_queries_build_claims_once(name, spark, folder):
    text = QUERIES[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "insurance_string" not in text


@pytest.mark.parametrize("name", ["kpi_snapshot", "graph_edges", "graph_edge_counts"])
def test_conditions_and_payers_are_parsed_once(name, spark, folder):
    text = QUERIES[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "clinicalStatus_string" not in text and "payor_string" not in text
    assert text.count("medicationCodeableConcept_string") == 0


def test_observations_of_other_codes_parse_no_value(spark, folder):
    rows = Lake(spark, folder).observations.where("code = '4548-4'").select("patient_id", "value")
    text = rows._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("quantity, from_json(") < text.index("Filter ") < text.index("concept, from_json(")


def test_edges_are_shuffled_once_for_a_path(spark):
    from carespark.operators import graph

    rows = [("a", "1", "x"), ("a", "1", "x"), ("b", "2", None), ("b", "3", "y"), (None, "3", "y"), ("c", "", "z")]
    claims = spark.createDataFrame(rows, "patient_id string, claim_key string, coverage_id string")
    make = lambda near: graph.match_path(graph.edges({"fact_claim": claims}, ["hasClaim", "coveredBy"], near), "hasClaim", "coveredBy")
    near = {"hasClaim": "dst", "coveredBy": "src"}
    assert plan(make(near)).count("Exchange hashpartitioning") == 2 < plan(make(None)).count("Exchange hashpartitioning")
    want = [("a", "1", "x"), ("b", "3", "y")]
    assert sorted(map(tuple, make(near).collect())) == sorted(map(tuple, make(None).collect())) == want


def test_own_ends_are_counted_where_they_lie(spark):
    from carespark.operators import graph

    rows = [("a", "1", "x"), ("a", "1", "x"), ("b", "2", None), ("b", "3", "y"), (None, "3", "y"), ("c", "3", "z")]
    claims = spark.createDataFrame(rows, "patient_id string, claim_key string, coverage_id string")
    make = lambda kind, near: graph.edges({"fact_claim": claims}, [kind], near)
    for kind, want in (("hasClaim", ("hasClaim", 4, 3, 3)), ("coveredBy", ("coveredBy", 3, 2, 3))):
        end = graph.OWN_ENDS[kind]
        counted = graph.edge_counts(make(kind, {kind: end}), kind, end)
        text = plan(counted)
        assert text.count(f"Exchange hashpartitioning({end}") == 2 and text.count("Exchange hashpartitioning") == 3
        assert [tuple(r) for r in counted.collect()] == [tuple(r) for r in graph.edge_counts(make(kind, None)).collect()] == [want]
        assert not graph.edge_counts(make(kind, {kind: end}).limit(0), kind, end).collect()


def test_edge_audit_shuffles_nodes_once(spark):
    from carespark.operators import graph

    edges = spark.createDataFrame(
        [("p1", "c1", "hasClaim", "Patient", "Claim"), ("p1", "c2", "hasClaim", "Patient", "Claim"), ("p2", "c1", "hasClaim", "Patient", "Claim"),
         ("c1", "x", "coveredBy", "Claim", "Payer"), ("p1", "e1", "hasEncounter", "Patient", "Encounter")],
        "src string, dst string, type string, src_label string, dst_label string",
    )
    nodes = spark.createDataFrame([("p1", "Patient"), ("p1", "Patient"), ("c1", "Claim"), ("c1", "Patient"), (None, "Claim")], "id string, label string")
    audit = graph.edge_audit(edges, nodes, ["hasClaim", "coveredBy", "hasProcedure"])
    assert plan(audit).count("Exchange hashpartitioning") == 2
    got = {r["type"]: (r["edges"], r["dangling_src"], r["dangling_dst"], r["is_empty"]) for r in audit.collect()}
    assert got == {"hasClaim": (3, 1, 1, False), "coveredBy": (1, 0, 1, False), "hasProcedure": (0, 0, 0, True)}


def test_bundles_are_parsed_once(spark):
    from carespark.operators import bundles

    doc = (
        '{"resourceType":"Bundle","entry":[{"fullUrl":"urn:uuid:p","resource":{"resourceType":"Patient","id":"1","note":"{\\"reference\\":\\"urn:uuid:p\\"}"}},'
        '{"fullUrl":"urn:uuid:o","resource":{"resourceType":"Observation","id":"2","subject":{"reference":"urn:uuid:p"},"a":{"reference":""},"b":[{"x":1,"reference":"u\\"v"},{"reference":"urn:uuid:p"}]}}]}'
    )
    frame = spark.createDataFrame([("k", doc), ("none", None), ("empty", '{"entry":[]}'), ("bad", "x")], "bundle_id string, content string")
    out = bundles.resolve_bundles(frame)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 2
    got = {r["pos"]: (r["resource"], r["resolved"]) for r in out.collect()}
    assert got == {
        0: ('{"resourceType":"Patient","id":"1","note":"{\\"reference\\":\\"urn:uuid:p\\"}"}', 0),
        1: ('{"resourceType":"Observation","id":"2","subject":{"reference":"Patient/1"},"a":{"reference":""},"b":[{"x":1,"reference":"u\\"v"},{"reference":"Patient/1"}]}', 1),
    }
