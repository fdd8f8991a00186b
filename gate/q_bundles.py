"""Bundle, gate, imaging, social-determinant, outreach and generator queries."""

import uuid

from pyspark.sql import functions as F

from carespark.functions.fhir import ontology_patient_id, strip_ref, typed_reference
from carespark.functions.lineage import checkpoint_folder
from carespark.operators import bundles as b, gates as g, imaging as im, lookups, outreach as o, sdoh
from carespark.operators.alerts import device_patient_map
from carespark.refdata import sdoh as sdoh_ref
from carespark.sources.bundle_files import WIDE_ROWS, load_changed_files, loaded_bundles

from .fixtures import CONDITION_CODES, LINE_KEY, pick
from .lake import AS_OF_DAY, Lake
from .registry import CTES, day_text, query, ts_text

ASOF = f"date '{AS_OF_DAY}'"

# --- bundle documents: one visit bundle per order, the same text in both engines ---
U = lambda kind, key="o_orderkey": f"concat('urn:uuid:{kind}-', {key})"
NPI = "concat('99998', 10000 + o_custkey % 40)"


def entry(url: str, body: str) -> str:
    return f"""concat('{{"fullUrl":"', {url}, '","resource":', {body}, '}}')"""


PATIENT = """concat('{"resourceType":"Patient","id":"patient-', o_orderkey, '","identifier":[{"system":"http://mrn","value":"M', o_custkey, '"}],"name":[{"text":"P ', o_custkey, '"}]}')"""
ENCOUNTER = f"""concat('{{"resourceType":"Encounter","id":"encounter-', o_orderkey, '","class":{{"code":"AMB"}},"subject":{{"reference":"', {U('patient')}, '"}},"serviceProvider":{{"reference":"Organization/', {pick('o_orderkey', ['org-main', 'org-peds', 'org-east'])}, '"}},"location":[{{"location":{{"reference":"Location?identifier=http://loc|site-', o_custkey % 25, '"}}}}],"participant":[{{"individual":{{"reference":"Practitioner?identifier=http://hl7.org/fhir/sid/us-npi|', {NPI}, '"}}}}]}}')"""
CONDITION = f"""concat('{{"resourceType":"Condition","id":"condition-', o_orderkey, '","code":{{"coding":[{{"code":"', {pick('o_orderkey', [c for _, c, _ in CONDITION_CODES])}, '"}}]}},"subject":{{"reference":"', case when o_orderkey % 5 = 0 then concat('Patient?identifier=http://mrn|M', o_custkey) else {U('patient')} end, '"}},"encounter":{{"reference":"', case when o_orderkey % 11 = 0 then 'urn:uuid:missing' else {U('encounter')} end, '"}}}}')"""
OBSERVATION = f"""concat('{{"resourceType":"Observation","id":"observation-', o_orderkey, '","subject":{{"reference":"', {U('patient')}, '"}}', case when o_orderkey % 13 = 0 then '' else concat(',"encounter":{{"reference":"', {U('encounter')}, '"}}') end, '}}')"""
ORGANIZATION = """concat('{"resourceType":"Organization","id":"org-', o_orderkey % 9, '","identifier":[{"system":"http://org","value":"', o_orderkey % 9, '"}]}')"""
DOC = "concat('{\"resourceType\":\"Bundle\",\"type\":\"', case when o_orderkey % 97 = 0 then 'collection' else 'transaction' end, '\",\"entry\":[', " + ", ',', ".join(
    [
        entry(U("observation"), OBSERVATION),
        entry(U("condition"), CONDITION),
        entry(U("encounter"), ENCOUNTER),
        entry(U("patient"), PATIENT),
        entry(U("org", "o_orderkey % 9"), ORGANIZATION),
    ]
) + ", ']}')"
CTES["v_bundles"] = f"select o_orderkey, o_custkey, concat('bundle-', o_orderkey) as bundle_id, {DOC} as content from orders"
BODY = {"observation": (0, OBSERVATION), "condition": (1, CONDITION), "encounter": (2, ENCOUNTER), "patient": (3, PATIENT)}
CTES["v_entries"] = " union all ".join(
    f"select o_orderkey, o_custkey, concat('bundle-', o_orderkey) as bundle_id, {pos} as pos, {U(k)} as full_url, '{k.title()}' as resource_type, concat('{k}-', o_orderkey) as resource_id, {body} as resource from orders"
    for k, (pos, body) in BODY.items()
) + f" union all select o_orderkey, o_custkey, concat('bundle-', o_orderkey), 4, {U('org', 'o_orderkey % 9')}, 'Organization', concat('org-', o_orderkey % 9), {ORGANIZATION} from orders"


def documents(k: Lake):
    make = lambda: k.table("orders").selectExpr("o_custkey", "o_orderkey", "concat('bundle-', o_orderkey) as bundle_id", f"{DOC} as content")
    return k.written("bundles", make)


def entries(k: Lake):
    return b.explode_bundles(documents(k).select("bundle_id", "content"))


query("explode_bundles", "select bundle_id, pos, full_url, resource_type, resource_id, resource from v_entries")(entries)
query("full_url_map", "select bundle_id, full_url as ref, resource_type || '/' || resource_id as direct_ref from v_entries")(lambda k: b.full_url_map(entries(k)))
query(
    "conditional_ref_map",
    "select bundle_id, 'Patient?identifier=http://mrn|M' || o_custkey as ref, 'Patient/patient-' || o_orderkey as direct_ref from v_bundles union all select bundle_id, 'Organization?identifier=http://org|' || o_orderkey % 9, 'Organization/org-' || o_orderkey % 9 from v_bundles",
)(lambda k: b.conditional_ref_map(entries(k)))
CTES["v_refs"] = "select bundle_id, o_orderkey, o_custkey, pos, resource_type, resource_id, unnest(regexp_extract_all(resource, '\"reference\":\"([^\"]*)\"', 1)) as ref from v_entries"
query("extract_references", "select bundle_id, pos, resource_type, resource_id, ref from v_refs")(lambda k: b.extract_references(entries(k)))
RES = "resource"
for _kind in ("patient", "encounter"):
    RES = f"replace({RES}, '\"reference\":\"urn:uuid:{_kind}-' || o_orderkey || '\"', '\"reference\":\"{_kind.title()}/{_kind}-' || o_orderkey || '\"')"
RES = f"replace({RES}, '\"reference\":\"Patient?identifier=http://mrn|M' || o_custkey || '\"', '\"reference\":\"Patient/patient-' || o_orderkey || '\"')"
CTES["v_resolved"] = f"select * replace ({RES} as resource) from v_entries"
query(
    "resolve_references",
    f"select bundle_id, pos, full_url, resource_type, resource_id, {RES} as resource, cast(len(list_distinct([r for r in regexp_extract_all(resource, '\"reference\":\"([^\"]*)\"', 1) if r like 'urn:uuid:%' and r <> 'urn:uuid:missing' or r like 'Patient?%'])) as int) as resolved from v_entries",
)(lambda k: b.resolve_bundles(documents(k).select("bundle_id", "content")))
query(
    "resolve_references_by_join",
    f"select bundle_id, pos, {RES} as resource from v_entries",
)(lambda k: b.resolve_references(entries(k)).select("bundle_id", "pos", "resource"))
query("flag_conditional_refs", "select bundle_id, pos, resource_type, contains(resource, '?identifier') as has_conditional_ref from v_resolved")(
    lambda k: b.flag_conditional_refs(b.resolve_bundles(documents(k).select("bundle_id", "content"))).select("bundle_id", "pos", "resource_type", "has_conditional_ref")
)
UUID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)"
query(
    "stub_missing_resources",
    f"""select ref, 'Practitioner' as resource_type, {UUID} as resource_id, 'Provider-' || right(npi, 4) as name, null as city, null as state, cast(null as double) as latitude, cast(null as double) as longitude
 from (select distinct ref, split_part(ref, '|', 2) as npi, md5('practitioner-npi-' || split_part(ref, '|', 2)) as h from v_refs where ref like 'Practitioner?%')
 union all select ref, 'Location', {UUID}, l.name, l.city, l.state, l.latitude, l.longitude from (select distinct ref, md5('location-http://loc-' || split_part(ref, '|', 2)) as h from v_refs where ref like 'Location?%' and ref <> 'Location?identifier=http://loc|site-3')
 join v_sites l on cast('0x' || substr(h, 1, 8) as bigint) % (select count(*) from v_sites) = l.site_index""",
)(
    lambda k: b.stub_missing_resources(
        entries(k),
        k.typed("locations").selectExpr("cast(substr(location_id, 5) as int) as site_index", "name", "city", "state", "latitude", "longitude"),
        k.spark.createDataFrame([("Location?identifier=http://loc|site-3",)], "ref string"),
    )
)
CTES["v_sites"] = "select cast(substr(location_id, 5) as int) as site_index, * from v_locations"


def big_bundle(k: Lake):
    """Entries of all orders of a customer group as one bundle each."""
    parsed = documents(k).select("o_custkey", "o_orderkey", F.posexplode(F.from_json("content", b.BUNDLE)["entry"]).alias("pos", "e"))
    return parsed.select(
        F.concat(F.lit("group-"), F.col("o_custkey") % 13).alias("bundle_id"),
        (F.col("o_orderkey") * 5 + F.col("pos")).alias("pos"),
        F.get_json_object("e.resource", "$.resourceType").alias("resource_type"),
    )


query(
    "order_and_chunk_entries",
    """select bundle_id, pos, resource_type, case when total <= 400 then 0 else type_rank end as type_rank, case when total <= 400 or type_rank < 99 then 0 else cast((row_number() over (partition by bundle_id, type_rank = 99 order by pos) - 1) // greatest(400 - f, 1) as int) end as chunk from (
 select *, count(*) over (partition by bundle_id) as total, case resource_type when 'Organization' then 0 when 'Patient' then 4 else 99 end as type_rank, count(*) filter (where resource_type in ('Organization', 'Patient')) over (partition by bundle_id) as f from (
 select 'group-' || o_custkey % 13 as bundle_id, o_orderkey * 5 + pos as pos, resource_type from v_entries))""",
)(lambda k: b.order_and_chunk_entries(big_bundle(k)))
query(
    "order_and_chunk_small",
    """select bundle_id, pos, resource_type, type_rank, case when type_rank < 99 then 0 else cast((row_number() over (partition by bundle_id, type_rank = 99 order by pos) - 1) // 2 as int) end as chunk from (
 select *, case resource_type when 'Organization' then 0 when 'Patient' then 4 else 99 end as type_rank from v_entries)""",
)(lambda k: b.order_and_chunk_entries(entries(k).select("bundle_id", "pos", "resource_type"), 4))
ICD = ["J44", "J45", "I50", "G47.3", "J84", "J18", "J96", "E11", "I25", "J47", "Q21"]
SNOMED = ["195967001", "44054006", "59621000", "38341003", "162864005", "271825005", "13645005", "84114007", "233604007", "53741008", "22298006", "840539006"]
inlist = lambda xs: ", ".join(f"'{x}'" for x in xs)
query(
    "qualifying_cohort",
    f"select distinct patient_id from v_conditions where (system like '%snomed%' and code in ({inlist(SNOMED)})) or ((system like '%icd%' or system = '') and regexp_matches(code, '^({'|'.join(p.replace('.', chr(92) + '.') for p in ICD)})'))",
)(lambda k: b.qualifying_cohort(k.conditions, SNOMED, ICD))
query(
    "site_membership",
    f"select bundle_id, {pick('o_orderkey', ['org-main', 'org-peds', 'org-east'])} as provider_org, o_orderkey % 3 = 1 as is_member from v_bundles",
)(lambda k: b.site_membership(entries(k), ["peds", "childrens"]))
query(
    "bundle_batches",
    "select resource_id, cast((row_number() over (order by resource_id) - 1) // 200 as int) as batch from (select concat('cond-', o_orderkey) as resource_id from orders)",
)(lambda k: b.bundle_batches(k.typed("conditions").select(F.col("condition_id").alias("resource_id")), "resource_id"))
query(
    "fhir_reference",
    "select condition_id, 'Patient/' || patient_id as patient_ref, patient_id, case when num % 4 = 0 then null else patient_id end as ontology_id from v_conditions",
)(
    lambda k: k.silver("condition")
    .select(F.col("idOrig").alias("condition_id"), F.inline(F.array(F.struct(F.from_json("subject_string", "struct<reference:string, msftSourceReference:string, idOrig:string, type:string, display:string, identifier:struct<value:string>>").alias("ref")))))
    .select(
        "condition_id",
        typed_reference(F.col("ref"), "Patient").alias("patient_ref"),
        strip_ref(typed_reference(F.col("ref"), "Patient")).alias("patient_id"),
        ontology_patient_id(F.col("ref")).alias("ontology_id"),
    )
)

# --- gates ---
# Whole texts as JSON string bodies: quotes, backslashes and control characters become spaces.
SAFE = {
    "spark": r"""regexp_replace(coalesce({c}, ''), '[\\x00-\\x1F\\x7F"\\\\]', ' ')""",
    "duck": r"""regexp_replace(coalesce({c}, ''), '[\x00-\x1F\x7F"\\]', ' ', 'g')""",
}


def json_text(engine: str, head: str, column: str, tail: str = "\"}") -> str:
    """SQL for JSON text that ends with a whole text column."""
    return f"concat('{head}\"', {SAFE[engine].format(c=column)}, '{tail}')"


def bronze_columns(engine: str, table: str) -> list[tuple[str, str]]:
    j = lambda head, column, tail="\"}": json_text(engine, head, column, tail)
    if table == "documents":
        return [
            ("resourceType", "'Document'"),
            ("resource", f"""case doc_id % 8 when 0 then text when 1 then null when 2 then '   ' when 3 then {j('[', 'text', '"]')} when 4 then {j('{"text":', 'text')}
              when 5 then {j('{"resourceType":7,"text":', 'text')} else {j('{"resourceType":"Document","text":', 'text')} end"""),
            ("sourceSystem", "source"),
            ("filePath", "case when doc_id % 3 = 0 then null else concat('f/', doc_id, '.json') end"),
        ]
    return [
        ("resourceType", "'Page'"),
        ("resource", f"""case page_id % 3 when 0 then html when 1 then {j('{"resourceType":"Page","html":', 'html', '"')} else {j('{"resourceType":"Page","html":', 'html')} end"""),
        ("sourceSystem", "url"),
        ("filePath", "concat('p/', page_id)"),
    ]


sel = lambda cols: ", ".join(f'{e} as "{n}"' for n, e in cols)
CTES["v_bronze"] = " union all ".join(f"select {sel(bronze_columns('duck', t))} from {t}" for t in ("documents", "pages"))
CTES["v_audit"] = """select *, case when resource is null or trim(resource) = '' then 'EMPTY_OR_NULL_RESOURCE' when not json_valid(resource) then 'JSON_PARSE_ERROR' when json_type(resource) <> 'OBJECT' then 'PAYLOAD_NOT_OBJECT'
 when json_type(resource, '$.resourceType') is distinct from 'VARCHAR' then 'MISSING_RESOURCE_TYPE' end as validation_error from v_bronze"""


def bronze(k: Lake):
    make = lambda t: k.table(t).selectExpr(*[f"{e} as {n}" for n, e in bronze_columns("spark", t)])
    return make("documents").unionByName(make("pages"))


query(
    "audit_json_payloads",
    'select "resourceType", "sourceSystem", "filePath", validation_error, length(resource) as payload_chars from v_audit where validation_error is not null',
)(lambda k: g.audit_json_payloads(bronze(k)).select("resourceType", "sourceSystem", "filePath", "validation_error", F.length("resource").cast("bigint").alias("payload_chars")))
query("audit_summary", 'select "resourceType", validation_error, count(*) as invalid_rows from v_audit where validation_error is not null group by 1, 2')(lambda k: g.audit_summary(bronze(k)))
query(
    "audit_gate",
    "select count(*) as total_rows, count(validation_error) as invalid_rows, count(validation_error) / cast(count(*) as double) as invalid_share, count(validation_error) / cast(count(*) as double) <= 0.01 as passed from v_audit",
)(lambda k: g.audit_gate(bronze(k)))


def broken(df, col: str, num_every: int):
    """Blank out every n-th reference."""
    n = F.regexp_extract("idOrig", r"(\d+)", 1).cast("bigint")
    return df.withColumn(col, F.when(n % num_every == 0, F.lit('{"reference":"","idOrig":""}')).otherwise(F.col(col)))


query(
    "reference_integrity",
    "select \"check\", broken_rows from (" + " union all ".join(
        f"select '{c}' as \"check\", count(*) filter (where {w}) as broken_rows from {t}"
        for c, w, t in (
            ("Condition.subject_string", "num % 10 = 0", "v_conditions"), ("Condition.encounter_string", "false", "v_conditions"),
            ("Observation.subject_string", "false", "v_observations"), ("Observation.encounter_string", "num % 6 = 0", "v_observations"),
            ("Procedure.subject_string", "num % 8 = 0", "v_eob"), ("Procedure.encounter_string", "false", "v_eob"),
            ("Encounter.subject_string", "num % 25 = 0", "v_encounters"), ("CarePlan.subject_string", "num % 12 = 0", "v_conditions"),
            ("MedicationRequest.subject_string", "num % 14 = 0", "v_medications"), ("Immunization.patient_string", "num % 15 = 0", "v_immunizations"),
            ("Coverage.beneficiary_string", "num % 16 = 0", "(select num from v_coverage union all select num from v_coverage2)"),
            ("ImagingStudy.subject_string", "num % 18 = 0", "v_imaging"), ("Basic.subject_string", "user_id % 4 = 0", "(select distinct user_id from events)"),
            ("Claim.patient_string", "num % 22 = 0", "v_eob"), ("ExplanationOfBenefit.patient_string", "num % 24 = 0", "v_eob"),
        )
    ) + ")",
)(
    lambda k: g.reference_integrity(
        {
            "Condition": broken(k.silver("condition"), "subject_string", 10),
            "Observation": broken(k.silver("observation").withColumn("encounter_string", F.col("subject_string")), "encounter_string", 6),
            "Procedure": broken(k.silver("eob").select("idOrig", F.col("patient_string").alias("subject_string"), F.col("facility_string").alias("encounter_string")), "subject_string", 8),
            "Encounter": broken(k.silver("encounter"), "subject_string", 25),
            "CarePlan": broken(k.silver("condition").select("idOrig", "subject_string"), "subject_string", 12),
            "MedicationRequest": broken(k.silver("medication"), "subject_string", 14),
            "Immunization": broken(k.silver("immunization"), "patient_string", 15),
            "Coverage": broken(k.silver("coverage"), "beneficiary_string", 16),
            "ImagingStudy": broken(k.silver("imaging"), "subject_string", 18),
            "Basic": broken(k.silver("basic").withColumnRenamed("id", "idOrig"), "subject_string", 4),
            "Claim": broken(k.silver("eob").select("idOrig", "patient_string"), "patient_string", 22),
            "ExplanationOfBenefit": broken(k.silver("eob"), "patient_string", 24),
        }
    )
)
query(
    "device_association_contract",
    "select count(*) as associations, count(*) filter (where user_id % 3 = 2) as missing_patient, 0 as missing_device from (select distinct user_id from events) where user_id % 7 <> 3 and user_id % 2 = 0",
)(lambda k: g.device_association_contract(k.basics).withColumn("missing_device", F.col("missing_device").cast("int")))
query("name_contract", "select count(*) as patients, count(*) filter (where num % 50 = 0) as missing_name from v_patients")(
    lambda k: g.name_contract(k.patients.withColumn("name", F.when(F.regexp_extract("patient_id", r"(\d+)", 1).cast("int") % 50 != 0, F.col("name"))))
)
query(
    "row_gate",
    "select 'fact_claim' as table_name, (select count(*) from v_eob) as row_count, 'OK' as status, true as passed union all select 'dim_payer', 0, 'EMPTY_OPTIONAL', true union all select 'care_gaps', 0, 'EMPTY_REQUIRED', false",
)(lambda k: g.row_gate({"fact_claim": k.typed("eob"), "dim_payer": k.typed("coverage").where("num < 0"), "care_gaps": k.typed("patients").where("num < 0")}, {"dim_payer"}))
query(
    "row_count_report",
    'select \'Bronze\' as table_name, count(*) as row_count, count("filePath") as with_path from v_bronze union all select \'Patient\', count(*), 0 from v_patients',
)(lambda k: g.row_count_report({"Bronze": bronze(k), "Patient": k.typed("patients")}))
CTES["v_ingested"] = "select *, ts + to_minutes(cast(event_id % 600 as integer)) as ingested from v_telemetry"
query(
    "stream_freshness_gate",
    f"""select {ts_text('max(ts)')} as latest_event, {ts_text('max(ingested)')} as latest_ingestion, count(*) filter (where ts between a - interval 120 minute and a) as recent_events, count(*) filter (where ts < a - interval 120 minute) as backlog_events,
 count(*) filter (where ts between a - interval 120 minute and a) > 0 as passed from v_ingested, (select as_of as a from v_as_of) where ingested > a - interval 120 minute""",
)(lambda k: g.stream_freshness_gate(k.telemetry.withColumn("ingested", F.col("ts") + F.expr("make_dt_interval(0, 0, cast(event_id % 600 as int), 0)")), k.as_of, "ts", "ingested", 120))
query("graph_count_check", "select count(*) as associations, count(distinct patient_id) as patients, count(distinct device_ref) as devices, 65 as expected, count(*) = 65 as passed from v_monitored")(
    lambda k: g.graph_count_check(k.associations, 65)
)


def shown_files(k: Lake):
    """Bundle documents as named files; every 40th missing, every 31st changed."""
    n = F.regexp_extract("bundle_id", r"(\d+)$", 1).cast("bigint")
    files = documents(k).withColumn("n", n).withColumn("name", F.concat("bundle_id", F.lit(".json")))
    manifest = files.where("n % 20 <> 1").select("name", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"))
    seen = files.where("n % 40 <> 0").withColumn("content", F.when(F.col("n") % 31 == 0, F.concat("content", F.lit(" "))).otherwise(F.col("content")))
    return seen.select("name", "content"), manifest


query(
    "manifest_findings",
    """select 'missing_file' as rule, bundle_id || '.json' as key, '' as detail from v_bundles where o_orderkey % 20 <> 1 and o_orderkey % 40 = 0 union all select 'extra_file', bundle_id || '.json', '' from v_bundles where o_orderkey % 20 = 1
 union all select 'checksum_mismatch', bundle_id || '.json', '' from v_bundles where o_orderkey % 20 <> 1 and o_orderkey % 40 <> 0 and o_orderkey % 31 = 0 union all select 'not_a_transaction_bundle', bundle_id || '.json', 'Bundle' from v_bundles where o_orderkey % 40 <> 0 and o_orderkey % 97 = 0""",
)(lambda k: g.manifest_findings(*shown_files(k)))


# --- files of bundles: one of ten customers each, loaded in two runs ---
CTES["v_file_texts"] = """select 'file-' || o_custkey // 10 || '.json' as name, o_custkey // 10 as n,
 '{"resourceType":"Bundle","type":"transaction","entry":[' || string_agg('{"fullUrl":"' || full_url || '","resource":' || resource || '}', ',' order by o_orderkey, pos) || ']}' as content from v_entries group by 1, 2"""


def file_texts(k: Lake):
    entry = F.concat(F.lit('{"fullUrl":"'), "full_url", F.lit('","resource":'), "resource", F.lit("}"))
    order = F.regexp_extract("bundle_id", r"(\d+)$", 1).cast("bigint")
    rows = entries(k).join(k.table("orders").selectExpr("concat('bundle-', o_orderkey) as bundle_id", "o_custkey div 10 as n"), "bundle_id")
    listed = F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), "pos", entry.alias("e")))), lambda s: s["e"])
    text = F.concat(F.lit('{"resourceType":"Bundle","type":"transaction","entry":['), F.array_join(listed, ","), F.lit("]}"))
    return rows.groupBy("n").agg(text.alias("content")).select(F.concat(F.lit("file-"), "n", F.lit(".json")).alias("name"), "n", "content")


def file_loads(k: Lake) -> str:
    """Every 7th file comes with the second run, for which every 5th of the others is changed."""
    folder = f"{checkpoint_folder(k.spark)}/files-{uuid.uuid4().hex}"
    texts = file_texts(k)
    texts.write.options(**WIDE_ROWS).parquet(f"{folder}/texts")  # compressed, unlike a checkpoint
    texts = k.spark.read.schema(texts.schema).parquet(f"{folder}/texts")

    def write(rows):  # one row per name: no shuffle brings rows of a file together
        rows.drop("n").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("name").text(f"{folder}/in")

    write(texts.where("n % 7 <> 0"))
    load_changed_files(k.spark, f"{folder}/in", f"{folder}/table", 0, by_folder=True)
    changed = F.when(F.col("n") % 7 != 0, F.concat("content", F.lit(" "))).otherwise(F.col("content"))
    write(texts.where("n % 7 = 0 or n % 5 = 0").withColumn("content", changed))
    load_changed_files(k.spark, f"{folder}/in", f"{folder}/table", 1, by_folder=True)
    return f"{folder}/table"


query(
    "bundle_file_loads",
    """select 0 as batch_id, name, 'added' as status, sha256(content || chr(10)) as sha256 from v_file_texts where n % 7 <> 0
 union all select 1, name, case when n % 7 = 0 then 'added' else 'changed' end, sha256(content || case when n % 7 = 0 then '' else ' ' end || chr(10)) from v_file_texts where n % 7 = 0 or n % 5 = 0""",
)(lambda k: k.spark.read.parquet(file_loads(k)).select("batch_id", "name", "status", "sha256"))
query("loaded_bundle_entries", "select 'file-' || o_custkey // 10 || '.json' as bundle_id, resource_type, resource_id from v_entries")(
    lambda k: b.explode_bundles(loaded_bundles(k.spark, file_loads(k))).select("bundle_id", "resource_type", "resource_id")
)
query("bundle_checksums", "select bundle_id, sha256(content) as sha256 from v_bundles")(lambda k: documents(k).select("bundle_id", F.sha2(F.col("content").cast("binary"), 256).alias("sha256")))
query("dangling_references", "select 'dangling_reference' as rule, 'urn:uuid:missing' as key, bundle_id as detail from v_bundles where o_orderkey % 11 = 0")(lambda k: g.dangling_references(entries(k)))
query("missing_references", "select 'missing_reference' as rule, 'Observation.encounter' as key, 'observation-' || o_orderkey as detail from v_bundles where o_orderkey % 13 = 0")(lambda k: g.missing_references(entries(k)))
query(
    "cohort_validate",
    """select 'dangling_reference' as rule, 'urn:uuid:missing' as key, bundle_id as detail from v_bundles where o_orderkey % 11 = 0 union all select 'missing_reference', 'Observation.encounter', 'observation-' || o_orderkey from v_bundles where o_orderkey % 13 = 0
 union all select 'missing_condition_code', 'none-such', '' union all select 'insufficient_encounters', 'VR', '0' union all select 'duplicate_patient_id', patient_id, cast(count(*) as varchar) from v_assign group by patient_id having count(*) > 1""",
)(
    lambda k: g.cohort_validate(
        entries(k), k.patient_facts, k.conditions, k.encounters,
        lookups.device_assignment(k.telemetry.select("device_id").distinct(), k.patient_facts),
        k.as_of_day, ["44054006", "none-such"], {"IMP": 1, "VR": 5},
    )
)
CTES["v_assign"] = "select device_id, patient_id from (select device_id, row_number() over (order by device_id) - 1 as i from (select distinct device_id from v_telemetry)) join (select patient_id, row_number() over (order by patient_id) - 1 as slot from v_patients) on i % (select count(*) from v_patients) = slot"
query("duplicate_ids", "select 'duplicate_id' as rule, 'Visit/' || o_custkey as key, cast(count(*) as varchar) as detail from orders group by o_custkey having count(*) > 1")(
    lambda k: g.duplicate_ids(k.table("orders").select(F.lit("Visit").alias("resource_type"), F.col("o_custkey").cast("string").alias("resource_id")))
)
query("count_mismatch", "select 'count_mismatch' as rule, encounter_class as key, cast(count(*) as varchar) as detail from v_encounters group by encounter_class union all select 'count_mismatch', 'VR', '0'")(
    lambda k: g.count_mismatch(
        k.encounters, "encounter_class",
        k.spark.createDataFrame([("IMP", 1), ("AMB", 1), ("VR", 2)], "encounter_class string, expected bigint"),
    )
)
def file_columns(engine: str) -> list[tuple[str, str]]:
    quote = "\\\\\"" if engine == "spark" else "\\\""
    return [
        ("path", "case doc_id % 6 when 0 then concat('a/', doc_id, '.json') when 1 then concat('t/_delta_log/', doc_id, '.json') when 2 then concat('n/', doc_id, '.ipynb') when 3 then concat('d/', doc_id, '.parquet') when 4 then concat(case doc_id % 24 when 4 then 'x/prepackaged/' when 10 then 'Output/' when 16 then 'synthea/output/' else 'vendor/microsoft-hds/a/b/SampleData/' end, doc_id, '.txt') else concat('s/output/', doc_id, '.md') end"),
        ("payload", f"""case doc_id % 6 when 0 then case when doc_id % 12 = 0 then {json_text(engine, '{"resourceType":"Bundle","entry":[{"resource":{"resourceType":"Patient","note":', 'text', '"}}]}')} else {json_text(engine, '{"resourceType":"Organization","name":', 'text')} end
          when 1 then case when doc_id % 4 = 1 then concat('{{"stats":"{{{quote}numRecords{quote}:5}}",', {json_text(engine, '"note":', 'text')}) else concat('{{"stats":"{{{quote}numRecords{quote}:0}}",', {json_text(engine, '"note":', 'text')}) end
          when 2 then case when doc_id % 4 = 0 then {json_text(engine, '{"cells":[{"outputs":[]}],"note":', 'text')} else {json_text(engine, '{"cells":[{"outputs":[{}]}],"note":', 'text')} end else text end"""),
        ("row_count", "cast(doc_id % 4 as bigint)"),
    ]


CTES["v_files"] = f"select doc_id, {sel(file_columns('duck'))} from documents"
query(
    "data_presence_scan",
    """select path, case doc_id % 6 when 0 then 'clinical-fhir-record' when 1 then 'sample-delta-statistics' when 2 then 'notebook-output' when 3 then 'populated-parquet' else 'blocked-path' end as violation from v_files
 where (doc_id % 6 = 0 and doc_id % 12 = 0) or (doc_id % 6 = 1 and doc_id % 4 = 1) or (doc_id % 6 = 2 and doc_id % 4 <> 0) or (doc_id % 6 = 3 and doc_id % 4 > 0) or doc_id % 6 = 4""",
)(lambda k: g.data_presence_scan(k.table("documents").selectExpr(*[f"{e} as {n}" for n, e in file_columns("spark")])))

# --- imaging ---
MAP = ", ".join(f"('{c}', {i}, '{m}', '{col}')" for i, (c, m, col) in enumerate(im.MODALITY_MAP))
CTES["v_collection"] = f"select p.patient_id, coalesce(m.modality, 'CT') as modality, coalesce(m.collection, 'LIDC-IDRI') as collection from v_patients p left join (select patient_id, arg_min(modality, r) as modality, arg_min(collection, r) as collection from v_conditions join (values {MAP}) t(code, r, modality, collection) using (code) where system like '%snomed%' group by 1) m using (patient_id)"
query("assign_collection", "select * from v_collection")(lambda k: im.assign_collection(k.patient_facts, k.conditions))
words = lambda i: "|".join(im.BODY_SITES[i][0])
CTES["v_body"] = f"""select p.patient_id, coalesce(g, 0) as g from v_patients p left join (select patient_id, case when bool_or(regexp_matches(lower(display), '{words(0)}')) then 0 when bool_or(regexp_matches(lower(display), '{words(1)}')) then 1
 when bool_or(regexp_matches(lower(display), '{words(2)}')) then 2 else 0 end as g from v_conditions where system like '%snomed%' group by 1) using (patient_id)"""
arm = lambda j: "case g " + " ".join(f"when {i} then '{v[j]}'" for i, (_, v) in enumerate(im.BODY_SITES)) + " end"
query("infer_body_site", f"select patient_id, {arm(0)} as body_site_code, {arm(1)} as body_site_display, {arm(2)} as body_site_text, {arm(3)} as body_part from v_body")(lambda k: im.infer_body_site(k.patient_facts, k.conditions))


def planned(k: Lake):
    site = im.infer_body_site(k.patient_facts, k.conditions)
    return (
        k.imaging.join(im.assign_collection(k.patient_facts, k.conditions).withColumnRenamed("modality", "planned_modality"), "patient_id")
        .join(site, "patient_id")
        .select(
            "patient_id", F.concat(F.lit("urn:oid:"), "study_id").alias("study_uid"), F.concat("study_id", F.lit(".1")).alias("series_uid"),
            "planned_modality", F.col("planned_modality").alias("modality"), "collection", "body_site_code", "body_site_display", "body_part",
            F.col("number_of_instances").alias("instance_count"), "started", F.lit("DEV-X").alias("device_id"),
        )
    )


CTES["v_planned"] = f"select i.num, i.patient_id, 'urn:oid:' || study_id as study_uid, study_id || '.1' as series_uid, c.modality as planned_modality, c.collection, {arm(0)} as body_site_code, {arm(1)} as body_site_display, {arm(3)} as body_part, number_of_instances as instance_count, i.started from v_imaging i join v_collection c using (patient_id) join v_body using (patient_id)"
query(
    "imaging_study_rows",
    """select patient_id, replace(study_uid, 'urn:oid:', '') as study_uid, '{"resourceType":"ImagingStudy","status":"available","subject":{"reference":"Patient/' || patient_id || '"},"started":"' || strftime(started, '%Y-%m-%dT%H:%M:%SZ') || '","numberOfSeries":1,"numberOfInstances":' || instance_count || ',"description":"' || instance_count || ' re-tagged instances","series":[{"uid":"' || series_uid ||
 '","modality":{"system":"http://dicom.nema.org/resources/ontology/DCM","code":"' || planned_modality || '"},"numberOfInstances":' || instance_count || ',"bodySite":{"system":"http://snomed.info/sct","code":"' || body_site_code || '","display":"' || body_site_display || '"}}],"identifier":[{"system":"urn:dicom:uid","value":"' || study_uid || '"}],"note":[{"text":"DICOM files stored at: /dicom/' || patient_id || '/' || replace(study_uid, 'urn:oid:', '') || '"}]}' as resource from v_planned""",
)(lambda k: im.imaging_study_rows(planned(k).withColumn("study_uid", F.regexp_replace("study_uid", "^urn:oid:", "")), "/dicom"))
query(
    "imaging_manifest",
    """select patient_id, patient_id as dicom_patient_id, 'DEV-X' as device_id, replace(study_uid, 'urn:oid:', '') as study_instance_uid, study_uid as study_instance_uid_urn, series_uid, planned_modality,
 case when num % 40 = 0 then 'MR' else planned_modality end as actual_modality, case when num % 40 = 0 then body_part else body_part end as body_part_examined, body_site_code, body_site_display, case when num % 40 = 0 then '20260101' end as tag_study_date, instance_count, collection from v_planned""",
)(
    lambda k: im.imaging_manifest(
        planned(k),
        k.typed("imaging").where("num % 40 = 0").selectExpr("concat('urn:oid:', study_id) as study_uid", "'MR' as tag_modality", "'' as tag_body_part", "patient_id as tag_patient_id", "'20260101' as tag_study_date"),
    )
)


def instances(k: Lake):
    one = F.explode(F.sequence(F.lit(1), F.greatest("number_of_instances", F.lit(1)))).alias("instance_number")
    return k.typed("imaging").select(
        "patient_id", F.col("study_id").alias("source_study"), one, "modality", F.lit("CHEST").alias("body_part"), F.to_date("started").alias("study_date"),
    ).withColumn("source_series", (F.col("instance_number") % 3).cast("string"))


def retagged(k: Lake):
    return im.retag_metadata(
        instances(k), k.typed("patients"), device_patient_map(k.basics), "General Hospital"
    )


query(
    "retag_metadata",
    f"""select patient_id, family || '^' || given as tag_patient_name, strftime(birth_date, '%Y%m%d') as tag_birth_date, upper(left(gender, 1)) as tag_sex, 'ACC-' || coalesce(device_id, 'NONE') as accession_number, 'General Hospital' as institution_name, strftime(started, '%Y%m%d') as study_date, 'CHEST' as body_part, modality, count(*) as instances, cast(count(distinct study_id) as int) as studies, count(*) as sops
 from (select *, unnest(range(1, greatest(number_of_instances, 1) + 1)) as n from v_imaging) join v_patients using (patient_id) left join v_assoc using (patient_id) group by 1, 2, 3, 4, 5, 6, 7, 8, 9""",
)(
    lambda k: retagged(k)
    .groupBy("patient_id", "tag_patient_name", "tag_birth_date", "tag_sex", "accession_number", "institution_name", "study_date", "body_part", "modality")
    .agg(F.count("*").alias("instances"), F.count_distinct("study_uid").cast("int").alias("studies"), F.count_distinct("sop_uid").alias("sops"))
)

# --- social determinants ---
CTES["v_zips"] = "select distinct lpad(cast(30000 + c_custkey % 400 as varchar), 5, '0') as zip from customer"
COUNTY = ", ".join(f"('{z}', '{f}', '{n}')" for (f, n), zs in sdoh_ref.COUNTIES.items() for z in zs)
CTES["v_fips"] = f"select 'GA-' || zip as id, zip, 'GA' as state, coalesce(f, '13121') as county_fips, coalesce(n, 'Fulton County') as county_name, 'SyntheticSdohSeed' as source_table from v_zips left join (values {COUNTY}) c(zip, f, n) using (zip)"


def zips(k: Lake):
    return k.table("customer").selectExpr("lpad(cast(30000 + c_custkey % 400 as string), 5, '0') as zip")


query("zip_to_fips", "select * from v_fips")(lambda k: sdoh.zip_to_fips(zips(k)))
MEAS = ", ".join(f"({c}, {u}, '{t}', '{n}', {b}, {m}, {f})" for c, u, t, n, b, m, f in sdoh_ref.MEASURES)
CTES["v_determinants"] = f"""select category_id, unit_of_measure_id, name, description, cast(v as varchar) as value, cast(v as double) as value_as_number, 'zip' as location_type, zip as location_value, '{{"zip":"' || zip || '","countyFips":"' || county_fips || '"}}' as location_json, zip || ':' || name as harmonization_key
 from (select *, b + (list_sum(list_transform(string_split(zip, ''), lambda x: ascii(x))) % m) * f as v from v_fips, (values {MEAS}) t(category_id, unit_of_measure_id, description, name, b, m, f))"""
query("social_determinants", "select * from v_determinants")(lambda k: sdoh.social_determinants(sdoh.zip_to_fips(zips(k))).drop("social_determinant_id"))
query(
    "sdoh_coverage",
    "select category_name, count(*) as determinants, count(distinct location_value) as places from v_determinants join (values (1, 'Economic Stability'), (2, 'Health Care Access and Quality'), (3, 'Neighborhood and Built Environment')) c(category_id, category_name) using (category_id) group by 1",
)(
    lambda k: sdoh.social_determinants(sdoh.zip_to_fips(zips(k)))
    .join(F.broadcast(sdoh.sdoh_dimensions(k.spark)["sdoh_category"]), "category_id")
    .groupBy("category_name")
    .agg(F.count("*").alias("determinants"), F.count_distinct("location_value").alias("places"))
)
query(
    "rehospitalization_nonmetro",
    "select coalesce(sum(r), 0) as rehospitalization_nonmetro from (select location_value, max(value_as_number) filter (where name = 'Nonmetro2013') as nm, sum(value_as_number) filter (where name = 'LTC_AVG_OBS_REHOSP_RATE') as r from v_determinants group by 1) where nm = 1",
)(lambda k: __import__("carespark.operators.measures", fromlist=["x"]).rehospitalization_nonmetro(sdoh.social_determinants(sdoh.zip_to_fips(zips(k)))))

# --- outreach ---
UUID5 = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', cast('0x' || substr(h, 17, 1) as int) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"


def uuid5_sql(ns: str, name: str) -> str:
    h = f"sha1(unhex('{ns.replace('-', '')}') || encode({name}))"
    return UUID5.replace("h,", f"{h},")


OID = lambda name: uuid5_sql(o.NAMESPACE, name)
query(
    "marketing_events",
    f"""select patient_id as patient_key, 1 as journey_key, encounter_id as appointment_key, 0 as channel_key, 0 as asset_key, {day_text('start_time')} as event_date, strftime(start_time, '%b-%Y') as event_month_year, 'synthetic-demo-enrichment' as source_table from v_encounters""",
)(
    lambda k: o.marketing_events(
        k.typed("encounters").selectExpr("patient_id as patient_key", "encounter_id as appointment_key", "start_time as appointment_scheduled_date"),
        k.table("nation").selectExpr("n_nationkey + 1 as journey_key"), k.table("region").selectExpr("r_regionkey as asset_key"),
        k.table("region").selectExpr("r_regionkey as channel_key", "'Email' as channel_name"),
    ).drop("marketing_event_key")
)


def outreach(k: Lake):
    return o.outreach_sources(k.patient_facts, F.lit("2026-06-01"))


query(
    "outreach_contacts",
    f"select {OID("patient_id || ':outreach-contact'")} as contact_id, '2026-06-01' as modified_on, patient_id as fhir_id, 'synthetic-demo-enrichment' as scenario_source from v_patients",
)(lambda k: outreach(k)["contact"])
query(
    "outreach_journeys",
    f"select {OID("patient_id || ':journey-instance'")} as instance_id, {OID("'outreach:journey'")} as journey_id, {OID("patient_id || ':outreach-contact'")} as target_id from v_patients",
)(lambda k: outreach(k)["journey_instance"].select("instance_id", "journey_id", "target_id"))
query("outreach_sent", f"select {OID("patient_id || ':emailsent'")} as interaction_id, {OID("patient_id || ':outreach-contact'")} as profile_id from v_patients")(lambda k: outreach(k)["email_sent"].select("interaction_id", "profile_id"))
query(
    "outreach_opened",
    f"select {OID("patient_id || ':emailopened'")} as interaction_id from (select patient_id, row_number() over (order by patient_id) - 1 as i from v_patients) where i % 3 <> 0",
)(lambda k: outreach(k)["email_opened"].select("interaction_id"))
CTES["v_indexed"] = "select patient_id, row_number() over (order by patient_id) - 1 as i from v_patients"
query(
    "enrich_cohort",
    f"""select patient_id, 'Coverage' as resource_type, {OID("patient_id || ':coverage'")} as resource_id from v_indexed union all select patient_id, 'Appointment', {OID("patient_id || ':appointment'")} from v_indexed
 union all select patient_id, 'Condition', {OID("patient_id || ':condition:' || c")} from v_indexed, (values ('44054006'), ('59621000')) t(c)
 union all select patient_id, 'MedicationRequest', {OID("patient_id || ':medication:' || c || ':2026:' || m")} from v_indexed, (values ('860975'), ('314076'), ('617314')) t(c), range(1, 8) r(m) where i % 2 = 0 or m % 2 = 1""",
)(lambda k: o.enrich_cohort(k.patient_facts, 2026, 7, 1).select("patient_id", "resource_type", "resource_id"))
query("created_day", f"select encounter_id, {day_text('start_time')} as created_day from v_encounters")(lambda k: o.created_day(k.typed("encounters"), "start_time").select("encounter_id", "created_day"))
query(
    "carry_event_time",
    f"select medication_id, encounter_key, {ts_text('o_orderdate')} as created_on from (select concat('med-', o_orderkey) as medication_id, o_orderkey as encounter_key, o_orderdate from orders)",
)(lambda k: o.carry_event_time(k.table("orders").selectExpr("concat('med-', o_orderkey) as medication_id", "o_orderkey as encounter_key"), k.table("orders").selectExpr("o_orderkey as encounter_key", "o_orderdate as created_on"), "encounter_key"))


def versions(k: Lake, shift: str):
    return k.typed("encounters").selectExpr("patient_id", f"start_time + make_dt_interval({shift}) as last_updated", "encounter_id as payload")


UPDATES = "case when num % 3 = 0 then 1 else -400 end"  # days: some are newer, some older, some equal


def upsert(k: Lake):
    return o.upsert_latest(versions(k, "0"), versions(k, UPDATES), ["patient_id"])


CTES["v_upsert"] = "select patient_id, last_updated, payload from (select patient_id, start_time as last_updated, encounter_id as payload, 0 as n from v_encounters union all select patient_id, start_time + to_days(case when num % 3 = 0 then 1 else -400 end), encounter_id, 1 from v_encounters) qualify row_number() over (partition by patient_id order by last_updated desc, n desc, payload desc) = 1"
query("upsert_latest", f"select patient_id, {ts_text('last_updated')} as last_updated, payload from v_upsert")(upsert)
query("upsert_replayed", f"select patient_id, {ts_text('last_updated')} as last_updated, payload from v_upsert")(lambda k: o.upsert_latest(upsert(k), versions(k, UPDATES), ["patient_id"]))


def run_log(k: Lake):
    return k.table("events").selectExpr("event_type as activity_name", "ts as event_time", "case when event_id % 10 = 0 then 'error' else 'info' end as severity", "concat('m', event_id, ' ', props) as message")


CTES["v_log"] = "select event_type as activity_name, ts as event_time, case when event_id % 10 = 0 then 'error' else 'info' end as severity, concat('m', event_id, ' ', props) as message from events"
query(
    "latest_errors",
    f"select activity_name, {ts_text('max(event_time)')} as event_time, arg_max(message, row(event_time, message)) as message, count(*) as errors from v_log where severity = 'error' group by 1",
)(lambda k: o.latest_errors(run_log(k)))
query(
    "run_summary",
    "select event_type as activity_name, case when event_id % 9 = 0 then 'Failed' else 'Succeeded' end as status, count(*) as batches, cast(sum(event_id % 100) as bigint) as source_records, cast(sum(event_id % 90) as bigint) as target_records, max(event_id % 9) > 0 as is_ok from events group by 1, 2",
)(lambda k: o.run_summary(k.table("events").selectExpr("event_type as activity_name", "case when event_id % 9 = 0 then 'Failed' else 'Succeeded' end as status", "event_id % 100 as source_records", "event_id % 90 as target_records")))
query(
    "replay_check",
    "select (select count(*) from v_before) as rows_before, (select count(*) from v_upsert) as rows_after, 0 as lost_keys, (select count(*) from v_log where severity = 'error') as errors, false as passed",
)(
    lambda k: o.replay_check(versions(k, "0").select("patient_id").distinct(), upsert(k), ["patient_id"], run_log(k)).withColumn("lost_keys", F.col("lost_keys").cast("int"))
)
CTES["v_before"] = "select distinct patient_id from v_encounters"
