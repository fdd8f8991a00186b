"""Helpers and operators on small literal or random inputs, against plain Python."""

import random
import uuid
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from carespark.functions.fhir import age_at, age_by_days, age_by_year, fhir_reference, is_pediatric, payer_category, strip_ref
from carespark.functions.ids import uuid5
from carespark.functions.lineage import checkpoint_folder
from carespark.functions.ranking import index_within, rank_values, sorted_index
from carespark.functions.text import has_term, mask_id, mask_name
from carespark.operators import bundles, gates, graph, lookups, outreach, quality, risk, sdoh
from carespark.sources import events
from carespark.sources.lakehouse import Lakehouse, SchemaConflict, additive, mirror_write


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


@pytest.mark.parametrize(
    "text, want",
    [
        ('{"reference":"Patient/a","idOrig":"b"}', "Patient/a"),
        ('{"reference":"","msftSourceReference":"#x"}', "#x"),
        ('{"msftSourceReference":"Group/x","idOrig":"b"}', "Group/x"),
        ('{"msftSourceReference":"x"}', "Patient/x"),
        ('{"msftSourceReference":"x","type":"Group"}', "Group/x"),
        ('{"msftSourceReference":"x","type":"not a type"}', "Patient/x"),
        ('{"idOrig":"b","identifier":{"value":"c"}}', "Patient/b"),
        ('{"identifier":{"value":"c"}}', "Patient/c"),
        ("{}", None),
        (None, None),
    ],
)
def test_reference_order(spark, text, want):
    df = spark.createDataFrame([(text,)], "r string")
    assert df.select(fhir_reference("r", "Patient")).first()[0] == want


def test_nested_reference_and_strip(spark):
    df = spark.createDataFrame([('[{"coverage":{"idOrig":"c1"}}]',)], "r string")
    row = df.select(fhir_reference("r", "Coverage", "coverage").alias("x")).select("x", strip_ref(F.col("x")).alias("p")).first()
    assert (row.x, row.p) == ("Coverage/c1", "")


@pytest.mark.parametrize(
    "code, display, text, name, want",
    [
        ("MCR", None, None, None, "Medicare"), (None, "Medicare Advantage", None, "Humana", "Medicare"),
        ("MCD", None, None, None, "Medicaid"), (None, None, "self-pay", None, "Uninsured"), (None, None, "Self pay", None, "Uninsured"),
        (None, None, None, "Blue Cross", "Commercial"), ("AMCRX", None, None, None, "Unknown"), (None, None, None, None, "Unknown"),
    ],
)
def test_payer_category(spark, code, display, text, name, want):
    df = spark.createDataFrame([(code, display, text, name)], "c string, d string, t string, n string")
    assert df.select(payer_category(F.col("c"), F.col("d"), F.col("t"), F.col("n"))).first()[0] == want


def test_three_ages(spark):
    birth, day = F.lit("2005-07-02").cast("date"), F.lit("2026-07-01").cast("date")
    assert one(spark, age_at(birth, day)) == 20
    assert one(spark, age_by_year(birth, day)) == 21
    assert one(spark, age_by_days(birth, day)) == 20
    assert one(spark, is_pediatric(birth, day)) is True
    assert one(spark, is_pediatric(F.lit(None).cast("date"), day)) is False


def test_masks_and_terms(spark):
    assert one(spark, mask_id(F.lit("12345678"))) == "12345678"
    assert one(spark, mask_id(F.lit("123456789"))) == "1234…6789"
    assert one(spark, mask_id(F.lit(None).cast("string"))) == "—"
    assert one(spark, mask_name(F.lit("Emanuel231 Schoen8"))) == "E. S."
    assert one(spark, has_term(F.lit("upcoding|x"), "upcoding")) is True
    assert one(spark, has_term(F.lit("upcodings"), "upcoding")) is False


def test_uuid5_matches_the_standard(spark):
    ns = "73590e85-86db-46ab-8a17-549b208963cc"
    for parts in [("a",), ("p1", "coverage"), ("é", "x", "2026")]:
        assert one(spark, uuid5(ns, *parts)) == str(uuid.uuid5(uuid.UUID(ns), ":".join(parts)))


def test_rank_values_brute_force(spark):
    rng = random.Random(5)
    values = [0] * 400 + [rng.randint(0, 300) for _ in range(800)]  # a third on one value
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(6)
    got = {r.v: (r.n, r["rank"]) for r in rank_values(df, "v", buckets=16).collect()}
    assert got == {v: (values.count(v), 1 + sum(x > v for x in values)) for v in set(values)}


def test_sorted_index(spark):
    keys = [f"k{random.Random(i).randint(0, 10**9)}-{i}" for i in range(500)]
    df = spark.createDataFrame([(k,) for k in keys], "k string").repartition(5)
    got = {r.k: r["index"] for r in sorted_index(df, "k", partitions=7).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}


def test_index_within_hot_group(spark):
    data = [("hot", p * 3) for p in range(500)] + [(f"g{i}", p) for i in range(5) for p in range(20)]
    df = spark.createDataFrame(data, "g string, pos long").repartition(4)
    got = {(r.g, r.pos): r.i for r in index_within(df, "g", "pos", "i", width=100).collect()}
    want = {}
    for g in {x for x, _ in data}:
        for i, p in enumerate(sorted(p for x, p in data if x == g)):
            want[(g, p)] = i
    assert got == want


def test_readmit_brute_force(spark):
    rng = random.Random(11)
    start = datetime(2024, 1, 1)
    stays = []
    for i in range(600):
        admit = start + timedelta(hours=rng.randint(0, 24 * 700))
        who = "hot" if i % 3 == 0 else f"p{rng.randint(0, 20)}"
        stays.append((f"e{i}", who, admit, admit + timedelta(hours=rng.randint(1, 24 * 20))))
    df = spark.createDataFrame(stays, "encounter_id string, patient_id string, admit_date timestamp, discharge_date timestamp")
    want = {
        e: int(any(q == p and a2 > d and (a2.date() - d.date()).days <= 30 for _, q, a2, _ in stays))
        for e, p, _, d in stays
    }
    assert {r.encounter_id: r.readmitted_30d for r in risk.readmit_30d(df).collect()} == want


def test_auc_brute_force(spark):
    rng = random.Random(3)
    data = [(round(rng.random(), 1), int(rng.random() < 0.4)) for _ in range(300)]
    df = spark.createDataFrame(data, "risk_probability double, y int")
    pos, neg = [p for p, y in data if y], [p for p, y in data if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert risk.auc(df, "y", buckets=8).first().value == pytest.approx(want)


def test_model_is_better_than_chance(spark):
    rng = random.Random(1)
    data = []
    for i in range(400):
        los, admits = rng.randint(1, 12), rng.randint(0, 6)
        y = int(0.25 * los + 0.5 * admits + rng.gauss(0, 1) > 3)
        data.append((f"e{i}", f"p{i}", datetime(2026, 1, 1), datetime(2026, 1, 2), 60, 0, los, 1, 1, admits, 0, 0, 0, 0, 0, 0, y))
    cols = (
        "encounter_id string, patient_id string, admit_date timestamp, discharge_date timestamp, age int, sex_male int, los_days int, "
        "comorbidity_count int, medication_count int, prior_admits_12mo int, prior_ed_visits_6mo int, has_diabetes int, has_chf int, "
        "has_copd int, payer_is_medicare int, payer_is_medicaid int, readmitted_30d int"
    )
    scored, performance = risk.readmission_model(spark.createDataFrame(data, cols))
    metrics = {r.name: r.value for r in performance.where("type = 'metric'").collect()}
    assert metrics["auc_roc"] > 0.8 and metrics["total_encounters"] == 400
    assert scored.count() == 400
    assert performance.where("type = 'coefficient'").count() == 12


def test_readmission_scores_add_no_row(spark):
    cols = "encounter_id string, patient_id string, admit_date timestamp, discharge_date timestamp, risk_probability double, risk_tier string, readmitted_30d int, los_days int"
    df = spark.createDataFrame([("e", "p", datetime(2026, 1, 1), datetime(2026, 1, 3), 0.2, "Medium", 0, 2)], cols)
    payers = spark.createDataFrame([("p", "Medicare")], "patient_id string, payer_category string")
    assert [r.scenario_source for r in risk.readmission_scores(df, payers).collect()] == ["observed"]


def test_split_is_stratified_and_weights_see_training_rows(spark):
    rows = [(f"e{i}", int(i % 10 == 0)) for i in range(3000)]
    split = risk.balance_weights(risk.holdout(spark.createDataFrame(rows, "encounter_id string, readmitted_30d int"))).collect()
    for y, n in ((0, 2700), (1, 300)):
        test = sum(r.is_test for r in split if r.readmitted_30d == y)
        assert 0.19 * n <= test <= 0.2 * n
    assert all((r.weight is None) == r.is_test for r in split)
    assert abs(sum(r.weight for r in split if r.weight and r.readmitted_30d) - sum(r.weight for r in split if r.weight and not r.readmitted_30d)) < 1e-6


def bundle(*resources):
    import json

    return json.dumps({"resourceType": "Bundle", "type": "transaction", "entry": [{"fullUrl": u, "resource": r} for u, r in resources]})


def test_references_resolve_at_any_depth(spark):
    import json

    text = bundle(
        ("urn:uuid:1", {"resourceType": "Patient", "id": "p1", "identifier": [{"system": "s", "value": "a/b"}]}),
        ("urn:uuid:2", {"resourceType": "Encounter", "id": "e1", "subject": {"reference": "urn:uuid:1"},
                        "participant": [{"individual": {"reference": "Patient?identifier=s|a/b"}}, {"individual": {"reference": "urn:uuid:9"}}],
                        "note": "the text \"reference\":\"urn:uuid:1\" stays"}),
    )
    entries = bundles.explode_bundles(spark.createDataFrame([("b", text)], "bundle_id string, content string"))
    refs = [r.ref for r in bundles.extract_references(entries).collect()]
    assert sorted(refs) == ["Patient?identifier=s|a/b", "urn:uuid:1", "urn:uuid:9"]
    out = {r.resource_id: json.loads(r.resource) for r in bundles.resolve_references(entries).collect()}
    e = out["e1"]
    assert e["subject"]["reference"] == "Patient/p1"
    # A conditional reference resolves to the URL's id, the URN to the resource id.
    assert [p["individual"]["reference"] for p in e["participant"]] == ["Patient/1", "urn:uuid:9"]
    assert "urn:uuid:1" in e["note"]


def test_bundles_are_rewritten_as_trees(spark):
    import json

    patient = {"resourceType": "Patient", "id": "p1", "identifier": [{"system": "s", "value": 'q"1'}, {"system": "", "value": "x"}, {"value": "y"}]}
    plan = {
        "resourceType": "CarePlan", "id": "c1", "subject": {"reference": "urn:uuid:1"},
        "addresses": [{"reference": "Patient/p1"}, {"reference": "urn:uuid:1"}, {"reference": ""}, {"reference": 'Patient?identifier=s|q"1'}],
        "contained": [{"resourceType": "Observation", "subject": {"reference": "urn:uuid:1", "display": "ä \\ \" {"}}],
        'odd"reference': "urn:uuid:1", "text": 'see ,"reference":"urn:uuid:1", {"reference":"urn:uuid:1"}', "reference": {"reference": "urn:uuid:2"},
    }
    docs = [
        ("a", bundle(("urn:uuid:1", {"resourceType": "Old", "id": "o"}), ("urn:uuid:1", patient), ("urn:uuid:2", plan), ("Patient/p1", {"resourceType": "Group", "id": "g"}), ("urn:uuid:3", {"id": "untyped"}))),
        ("empty", json.dumps({"resourceType": "Bundle", "entry": []})), ("none", "{}"), ("cut", "{"), ("null", None),
    ]
    frame = spark.createDataFrame(docs, "bundle_id string, content string")
    rows = bundles.resolve_bundles(frame).collect()
    assert [(r.bundle_id, r.pos) for r in sorted(rows, key=lambda r: r.pos)] == [("a", i) for i in range(5)]
    got = {r.resource_id: r for r in rows}
    want = json.loads(json.dumps(plan))
    want["subject"]["reference"] = want["contained"][0]["subject"]["reference"] = "Patient/p1"
    want["addresses"] = [{"reference": v} for v in ("Group/g", "Patient/p1", "", "Patient/1")]
    want["reference"]["reference"] = "CarePlan/c1"
    assert json.loads(got["c1"].resource) == want and got["c1"].resolved == 4
    assert json.loads(got["p1"].resource) == patient and got["p1"].resolved == 0
    joined = {r.pos: (r.resource, r.resolved) for r in bundles.resolve_references(bundles.explode_bundles(frame)).collect()}
    assert joined == {r.pos: (r.resource, r.resolved) for r in rows}
    plan_text = bundles.resolve_bundles(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan_text and "Join" not in plan_text


def test_fork_rows(spark, rows):
    first = spark.createDataFrame([("p1", "c2"), ("p1", "c1"), ("p2", "c3"), ("p3", "c4")] + [("p0", f"c{i:03d}") for i in range(200)], "start string, first_end string")
    second = spark.createDataFrame([("p1", "g2"), ("p1", "g1"), ("p3", None), ("p9", "g")] + [("p0", f"g{i:03d}") for i in range(200)], "start string, second_end string")
    every = [(a, x, y) for a, x in map(tuple, first.collect()) for y in ([e for s, e in map(tuple, second.collect()) if s == a] or [None])]
    assert rows(graph.match_fork_rows(first, second, optional=True)) == sorted(every, key=repr)
    key = lambda r: (r[0], r[1], r[2] is not None, r[2] or "")
    for n in (3, 250):
        assert sorted(map(tuple, graph.match_fork_rows(first, second, True, n).collect()), key=key) == sorted(every, key=key)[:n]
    inner = [r for r in every if r[0] != "p2"]
    assert sorted(map(tuple, graph.match_fork_rows(first, second, False, 7).collect()), key=key) == sorted(inner, key=key)[:7]


def test_chunks_keep_small_bundles_whole(spark):
    rows = [("big", i, "Patient" if i < 2 else "Condition") for i in range(12)] + [("small", i, "Condition") for i in range(5)]
    df = spark.createDataFrame(rows, "bundle_id string, pos int, resource_type string")
    got = bundles.order_and_chunk_entries(df, 5).collect()
    assert {r.chunk for r in got if r.bundle_id == "small"} == {0}
    sizes = {c: sum(r.chunk == c for r in got if r.bundle_id == "big") for c in range(4)}
    assert sizes == {0: 5, 1: 3, 2: 3, 3: 1}


def test_bundle_names(spark):
    names = ["Ann_1.json", "hospitalInformation1.json", "practitionerInformation1.json", "_control/x.json", "device-associations.json", "a.txt"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.n for r in df.where(bundles.is_bundle_file(F.col("n"))).collect()] == ["Ann_1.json"]


@pytest.mark.parametrize(
    "payload, want",
    [
        (None, "EMPTY_OR_NULL_RESOURCE"), ("  ", "EMPTY_OR_NULL_RESOURCE"), ("{", "JSON_PARSE_ERROR"), ("[1]", "PAYLOAD_NOT_OBJECT"),
        ('"x"', "PAYLOAD_NOT_OBJECT"), ("{}", "MISSING_RESOURCE_TYPE"), ('{"resourceType":5}', "MISSING_RESOURCE_TYPE"),
        ('{"resourceType":" "}', "MISSING_RESOURCE_TYPE"), ('{"resourceType":"X","n":"a"}', "SCHEMA_PARSE_FAILED"), ('{"resourceType":"X","n":1}', None),
    ],
)
def test_payload_errors(spark, payload, want):
    df = spark.createDataFrame([(payload,)], "resource string")
    assert df.select(gates.payload_error(F.col("resource"), "resourceType string, n int")).first()[0] == want


def test_row_gate_never_hides_an_empty_fact(spark):
    full, empty = spark.range(3), spark.range(0)
    got = {r.table_name: (r.status, r.passed) for r in gates.row_gate({"dim": full, "fact": empty, "opt": empty}, {"opt"}).collect()}
    assert got == {"dim": ("OK", True), "fact": ("EMPTY_REQUIRED", False), "opt": ("EMPTY_OPTIONAL", True)}


def test_future_events_do_not_pass(spark):
    now = datetime(2026, 7, 1, 12)
    df = spark.createDataFrame([(now + timedelta(hours=1), now)], "t timestamp, i timestamp")
    row = gates.stream_freshness_gate(df, now, "t", "i").first()
    assert (row.recent_events, row.passed) == (0, False)


def test_presence_scan(spark):
    files = [
        ("schema/empty.parquet", None, 0), ("x/full.parquet", None, 3), ("a.json", '{"resourceType":"Bundle","entry":[]}', None),
        ("b.json", '{"x":[{"resource":{"resourceType":"Patient"}}]}', None), ("c.ipynb", '{"cells":[{"outputs":[]}]}', None),
    ]
    df = spark.createDataFrame(files, "path string, payload string, row_count long")
    assert {r.path: r.violation for r in gates.data_presence_scan(df).collect()} == {"x/full.parquet": "populated-parquet", "b.json": "clinical-fhir-record"}


def test_round_robin_covers_all_devices(spark):
    devices = spark.createDataFrame([(f"D{i:02d}",) for i in range(7)], "device_id string")
    people = spark.createDataFrame([("a",), ("b",), ("c",)], "patient_id string")
    got = {r.device_id: r.patient_id for r in lookups.device_assignment(devices, people).collect()}
    assert got == {f"D{i:02d}": "abc"[i % 3] for i in range(7)}


def test_anti_join_survives_missing_patient(spark):
    assoc = spark.createDataFrame([("d", "n", "p")], "device_ref string, patient_name string, patient_id string")
    cond = spark.createDataFrame([("p", "Asthma")], "patient_id string, display string")
    imm = spark.createDataFrame([(None, "pneumococcal")], "patient_id string, display string")
    assert lookups.respiratory_missing_pneumococcal(assoc, cond, imm, "pneumococcal").count() == 1


def test_sdoh_rows(spark):
    places = sdoh.zip_to_fips(spark.createDataFrame([("30032",), ("30032",), ("99999",)], "zip string"))
    assert {(r.zip, r.county_fips) for r in places.collect()} == {("30032", "13089"), ("99999", "13121")}
    rows = sdoh.social_determinants(places).collect()
    assert len(rows) == 12
    seed = sum(ord(c) for c in "30032")
    income = [r.value_as_number for r in rows if r.location_value == "30032" and r.name == "ACS_MEDIAN_HH_INC"]
    assert income == [52000 + seed % 34 * 1000]


def test_upsert_is_idempotent(spark, rows):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 5, "y")], "k string, last_updated int, v string")
    new = spark.createDataFrame([("a", 2, "z"), ("b", 4, "n"), ("c", 1, "w")], "k string, last_updated int, v string")
    merged = outreach.upsert_latest(old, new, ["k"])
    assert rows(merged) == [("a", 2, "z"), ("b", 5, "y"), ("c", 1, "w")]
    assert rows(outreach.upsert_latest(merged, new, ["k"])) == rows(merged)


def test_measure_period_keeps_both_ends(spark):
    df = spark.createDataFrame([("p", date(2025, 6, 30)), ("p", date(2025, 7, 1)), ("p", date(2026, 7, 1)), ("p", date(2026, 7, 2)), ("", date(2026, 1, 1))], "patient_id string, d date")
    assert quality.in_period(df, "d", "2025-07-01", "2026-07-01").count() == 2


# --- sources ---------------------------------------------------------------------


def test_lakehouse_schemas(spark, tmp_path):
    lake = Lakehouse(spark, str(tmp_path))
    lake.write_gold(spark.createDataFrame([(1, "a")], "id int, a string"), "t")
    out = lake.write_gold(spark.createDataFrame([(2, 1.5)], "id int, b double"), "t")
    assert sorted(out.columns) == ["a", "b", "id"] and out.count() == 1
    with pytest.raises(SchemaConflict):
        lake.write_gold(spark.createDataFrame([("x",)], "id string"), "t")
    assert lake.write_gold(spark.createDataFrame([("x",)], "id string"), "t", "replace").columns == ["id"]
    assert lake.ensure_gold_tables({"t": "id string", "new": "n int"}) == ["new"]
    lake.snapshot_append(spark.createDataFrame([(1,)], "n int"), "new")
    lake.snapshot_append(spark.createDataFrame([(2,)], "n int"), "new")
    assert lake.read_gold("new").count() == 2
    lake.snapshot_replace(spark.createDataFrame([(3,)], "n int"), "new")
    assert lake.read_gold("new").count() == 1


def test_mirror_write(spark, tmp_path):
    paths = [str(tmp_path / n) for n in ("a", "b", "c")]
    mirror_write(spark.range(5), paths)
    assert [spark.read.parquet(p).count() for p in paths] == [5, 5, 5]


def test_additive_fills_typed_nulls(spark):
    have = spark.createDataFrame([], "a int, b date").schema
    assert additive(spark.createDataFrame([(1,)], "a int"), have).schema["b"].dataType == have["b"].dataType


def test_bad_events_go_aside(spark):
    raw = spark.createDataFrame([('{"event_id":"1","claim_amount":2.5}',), ("{bad",), (None,), ('{"event_id":"2","claim_amount":"x"}',)], "value string")
    good, bad = events.split_bad_rows(events.ingest_json(raw, events.CLAIMS))
    assert [r.event_id for r in good.collect()] == ["1"] and bad.count() == 3


def test_bundle_files(spark, tmp_path):
    import hashlib

    from carespark.sources.bundle_files import bundle_source

    text = bundle(("urn:uuid:1", {"resourceType": "Patient", "id": "p"}))
    (tmp_path / "A.json").write_text(text)
    (tmp_path / "B.json").write_text("{}")
    (tmp_path / "hospitalInformation1.json").write_text("{}")
    manifest = spark.createDataFrame([("A.json", hashlib.sha256(text.encode()).hexdigest()), ("C.json", "0")], "name string, sha256 string")
    rows, findings = bundle_source(spark, str(tmp_path), manifest)
    assert rows.count() == 2
    assert sorted((r.rule, r.key) for r in findings.collect()) == [("extra_file", "B.json"), ("missing_file", "C.json"), ("not_a_transaction_bundle", "B.json")]


def test_checkpoint_folder_comes_from_the_session(spark):
    assert checkpoint_folder(spark) == checkpoint_folder(spark)
    assert spark.sparkContext.getCheckpointDir()
