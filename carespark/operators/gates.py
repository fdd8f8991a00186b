"""Data-quality gates. Each rule is a query; results are small rows to act on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import count_if
from ..functions.text import any_of, cascade, filled, first_filled
from ..functions.timing import as_column, back
from .bundles import reference_list


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# --- payload audit ------------------------------------------------------------


def payload_error(payload: Column, schema: str | None = None) -> Column:
    """First problem of a JSON payload, null when it is fine. No Python."""
    doc = F.try_parse_json(payload)
    kind = F.schema_of_variant(F.try_variant_get(doc, "$.resourceType", "variant"))
    name = F.try_variant_get(doc, "$.resourceType", "string")
    rules = [
        (payload.isNull() | (F.trim(payload) == ""), "EMPTY_OR_NULL_RESOURCE"),
        (doc.isNull(), "JSON_PARSE_ERROR"),
        (~F.ltrim(payload).startswith("{"), "PAYLOAD_NOT_OBJECT"),
        (kind.isNull() | (kind != "STRING") | (F.trim(name) == ""), "MISSING_RESOURCE_TYPE"),
    ]
    if schema is not None:
        checked = F.from_json(
            payload, f"struct<{schema}, _corrupt_record:string>", {"columnNameOfCorruptRecord": "_corrupt_record"}
        )
        rules.append((checked["_corrupt_record"].isNotNull(), "SCHEMA_PARSE_FAILED"))
    return cascade(rules, F.lit(None))


def audit_json_payloads(bronze: DataFrame, schema: str | None = None, keep_valid: bool = False) -> DataFrame:
    """Bad rows with their error and a preview. `schema` is a DDL field list."""
    out = bronze.withColumn("validation_error", payload_error(F.col("resource"), schema)).withColumn(
        "resource_preview", F.substring("resource", 1, 180)
    )
    return out if keep_valid else out.where(F.col("validation_error").isNotNull())


def audit_summary(bronze: DataFrame, schema: str | None = None) -> DataFrame:
    return (
        audit_json_payloads(bronze, schema)
        .groupBy("resourceType", "validation_error")
        .agg(F.count("*").alias("invalid_rows"))
    )


def audit_gate(bronze: DataFrame, schema: str | None = None, max_share: float = 0.01) -> DataFrame:
    """Totals and verdict in one pass."""
    bad = F.col("validation_error").isNotNull()
    share = F.coalesce(F.try_divide(F.col("invalid_rows").cast("double"), F.col("total_rows").cast("double")), F.lit(0.0))
    return (
        audit_json_payloads(bronze, schema, keep_valid=True)
        .agg(F.count("*").alias("total_rows"), count_if(bad).alias("invalid_rows"))
        .withColumn("invalid_share", share)
        .withColumn("passed", F.col("invalid_share") <= max_share)
    )


# --- reference and name contracts ------------------------------------------------


# Reference columns that downstream models need, by table.
REFERENCE_CHECKS = {
    "Condition": ["subject_string", "encounter_string"],
    "Observation": ["subject_string", "encounter_string"],
    "Procedure": ["subject_string", "encounter_string"],
    "Encounter": ["subject_string"],
    "CarePlan": ["subject_string"],
    "MedicationRequest": ["subject_string"],
    "Immunization": ["patient_string"],
    "Coverage": ["beneficiary_string"],
    "ImagingStudy": ["subject_string"],
    "Basic": ["subject_string"],
    "Claim": ["patient_string"],
    "ExplanationOfBenefit": ["patient_string"],
}
REFERENCE = "reference string, msftSourceReference string, idOrig string, identifier struct<value:string>"


def _no_reference(col: str) -> Column:
    """Holds none of the four reference forms; the text is parsed once."""
    return F.exists(
        F.array(F.from_json(col, REFERENCE)),
        lambda r: first_filled(r["reference"], r["msftSourceReference"], r["idOrig"], r["identifier"]["value"]).isNull(),
    )


def reference_integrity(tables: dict[str, DataFrame], checks: dict[str, list[str]] = REFERENCE_CHECKS) -> DataFrame:
    """Rows whose reference column is set but holds no usable form, per column.

    One aggregation per table covers all its columns.
    """
    parts = []
    for name, df in tables.items():
        columns = checks[name]
        row = df.agg(*[count_if(F.col(c).isNotNull() & _no_reference(c)).alias(c) for c in columns])
        labelled = F.array(*[F.struct(F.lit(f"{name}.{c}").alias("check"), F.col(c).alias("broken_rows")) for c in columns])
        parts.append(row.select(F.inline(labelled)))
    return _union(parts)


def device_association_contract(basics: DataFrame, code: str = "device-assoc") -> DataFrame:
    """Association rows that lack a patient or a device."""
    patient = first_filled(F.col("subject.idOrig"), F.regexp_replace("subject.msftSourceReference", "Patient/", ""))
    device = F.exists(
        F.coalesce("extension", F.array()),
        lambda e: any_of(e["url"], ["associated-device", "device-association-device"])
        & filled(e["valueReference"]["reference"]).isNotNull(),
    )
    return basics.where(F.col("code.coding")[0]["code"] == code).agg(
        F.count("*").alias("associations"),
        count_if(patient.isNull()).alias("missing_patient"),
        count_if(~device).alias("missing_device"),
    )


def name_contract(patients: DataFrame) -> DataFrame:
    any_part = first_filled(F.col("name.text"), F.col("name.family"), F.get("name.given", F.lit(0)))
    return patients.agg(F.count("*").alias("patients"), count_if(any_part.isNull()).alias("missing_name"))


# --- row gates ---------------------------------------------------------------------


def row_count_report(tables: dict[str, DataFrame], path_column: str = "filePath") -> DataFrame:
    """Rows per table, and non-null file paths where the column exists."""
    parts = []
    for name, df in tables.items():
        paths = F.count(path_column) if path_column in df.columns else F.lit(0).cast("bigint")
        parts.append(df.agg(F.count("*").alias("row_count"), paths.alias("with_path")).select(F.lit(name).alias("table_name"), "row_count", "with_path"))
    return _union(parts)


def row_gate(tables: dict[str, DataFrame], optional: set[str] = frozenset()) -> DataFrame:
    """Each table by itself: a filled dimension never hides an empty fact."""
    may_be_empty = F.col("table_name").isin(*optional) if optional else F.lit(False)
    return row_count_report(tables).select(
        "table_name",
        "row_count",
        cascade(
            [(F.col("row_count") > 0, "OK"), (may_be_empty, "EMPTY_OPTIONAL")], "EMPTY_REQUIRED"
        ).alias("status"),
        ((F.col("row_count") > 0) | may_be_empty).alias("passed"),
    )


def stream_freshness_gate(
    events: DataFrame, as_of, event_ts: str, ingest_ts: str, minutes: int = 5
) -> DataFrame:
    """Newest event and ingestion, recent and backlog counts of newly ingested rows.

    Future event times count neither as recent nor as a pass.
    """
    since, now, t = back(as_of, minutes=minutes), as_column(as_of), F.col(event_ts)
    return (
        events.where(F.col(ingest_ts) > since)
        .agg(
            F.max(event_ts).alias("latest_event"),
            F.max(ingest_ts).alias("latest_ingestion"),
            count_if(t.between(since, now)).alias("recent_events"),
            count_if(t < since).alias("backlog_events"),
        )
        .withColumn("passed", F.col("recent_events") > 0)
    )


def graph_count_check(associations: DataFrame, expected: int) -> DataFrame:
    n = F.col("associations")
    return associations.agg(
        F.count("*").alias("associations"),
        F.count_distinct("patient_id").alias("patients"),
        F.count_distinct("device_ref").alias("devices"),
    ).withColumn("expected", F.lit(expected)).withColumn("passed", n == F.lit(expected))


# --- cohort validation ---------------------------------------------------------------

# Reference members every resource type must carry.
REQUIRED_REFERENCES = {
    "Condition": ["subject", "encounter"],
    "Observation": ["subject", "encounter"],
    "Procedure": ["subject", "encounter"],
    "Encounter": ["subject"],
    "CarePlan": ["subject", "encounter"],
    "MedicationRequest": ["subject", "encounter"],
    "Immunization": ["patient", "encounter"],
    "Coverage": ["beneficiary"],
    "Claim": ["patient"],
    "ExplanationOfBenefit": ["patient"],
    "DocumentReference": ["subject"],
}


def _finding(df: DataFrame, rule: str, key: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def manifest_findings(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Missing, extra, changed and non-bundle files.

    `files` `(name, content)`, `manifest` `(name, sha256)`. Contents are read
    and hashed once; only hashes and types are joined.
    """
    hashed = files.select(
        "name",
        F.sha2(F.col("content").cast("binary"), 256).alias("actual"),
        F.json_tuple(F.col("content").cast("string"), "resourceType", "type").alias("kind", "bundle_type"),
        F.lit(True).alias("seen"),
    )
    both = hashed.join(manifest.withColumn("listed", F.lit(True)), "name", "full")
    is_bundle = F.col("kind").eqNullSafe("Bundle") & F.col("bundle_type").eqNullSafe("transaction")
    finding = lambda hit, rule, detail=F.lit(""): F.when(hit, F.struct(F.lit(rule).alias("rule"), detail.alias("detail")))
    found = F.array_compact(
        F.array(
            finding(F.col("seen").isNull(), "missing_file"),
            finding(F.col("listed").isNull(), "extra_file"),
            finding(F.col("actual") != F.col("sha256"), "checksum_mismatch"),
            finding(F.col("seen") & ~is_bundle, "not_a_transaction_bundle", F.coalesce("kind", F.lit(""))),
        )
    )
    return both.select("name", F.explode(found).alias("f")).select("f.rule", F.col("name").alias("key"), "f.detail")


def duplicate_ids(entries: DataFrame, shared: tuple[str, ...] = ("Organization",)) -> DataFrame:
    repeated = (
        entries.where(~F.col("resource_type").isin(*shared))
        .groupBy("resource_type", "resource_id")
        .agg(F.count("*").alias("n"))
        .where("n > 1")
    )
    return _finding(repeated, "duplicate_id", F.concat_ws("/", "resource_type", "resource_id"), F.col("n"))


def dangling_references(entries: DataFrame) -> DataFrame:
    """URN references that no entry of the same bundle provides."""
    refs = (
        entries.select("bundle_id", F.explode(reference_list(F.col("resource"))).alias("ref"))
        .where(F.startswith("ref", F.lit("urn:uuid:")))
        .distinct()
    )
    urls = entries.select("bundle_id", F.col("full_url").alias("ref"))
    return _finding(refs.join(urls, ["bundle_id", "ref"], "left_anti"), "dangling_reference", F.col("ref"), F.col("bundle_id"))


def missing_references(entries: DataFrame) -> DataFrame:
    """Resources whose required members hold no reference."""
    rows = entries.select("resource_id", F.explode(_missing_fields()).alias("field"))
    return _finding(rows, "missing_reference", F.col("field"), F.col("resource_id"))


def _missing_fields() -> Column:
    """`Type.member` of the required members of an entry without a reference; only these are parsed."""
    kind = F.col("resource_type")
    required = cascade(
        [(kind == t, F.array(*[F.lit(f) for f in fields])) for t, fields in REQUIRED_REFERENCES.items()],
        F.array().cast("array<string>"),
    )
    member = lambda f: F.call_function("get_json_object", F.col("resource"), F.concat(F.lit("$."), f))
    lacking = F.filter(required, lambda f: F.size(reference_list(F.coalesce(member(f), F.lit("")))) == 0)
    return F.transform(lacking, lambda f: F.concat(kind, F.lit("."), f))


def entry_findings(entries: DataFrame, shared: tuple[str, ...] = ("Organization",)) -> DataFrame:
    """Duplicate ids, dangling and missing references in one pass over the entries.

    Each entry gives the facts it adds: its id, its URL, its URN references and
    its missing members. One aggregation by fact decides all three rules.
    """
    fact = lambda rule, a, b, given=False: F.struct(
        F.lit(rule).alias("rule"), a.alias("a"), b.alias("b"), F.lit(given).alias("given")
    )
    bundle, url = F.col("bundle_id"), F.col("full_url")
    urns = F.array_distinct(F.filter(reference_list(F.col("resource")), lambda r: F.startswith(r, F.lit("urn:uuid:"))))
    own = F.array_compact(
        F.array(
            F.when(~F.col("resource_type").isin(*shared), fact("duplicate_id", F.col("resource_type"), F.col("resource_id"))),
            F.when(F.startswith(url, F.lit("urn:uuid:")), fact("dangling_reference", url, bundle, True)),
        )
    )
    facts = F.concat(
        own,
        F.transform(F.coalesce(urns, F.array().cast("array<string>")), lambda r: fact("dangling_reference", r, bundle)),
        F.transform(_missing_fields(), lambda f: fact("missing_reference", f, F.col("resource_id"))),
    )
    known = (
        entries.select(F.inline(facts))
        .groupBy("rule", "a", "b")
        .agg(F.count("*").alias("n"), F.bool_or("given").alias("given"))
        .where(
            cascade([(F.col("rule") == "duplicate_id", F.col("n") > 1), (F.col("rule") == "dangling_reference", ~F.col("given"))], True)
        )
    )
    twice = F.col("rule") == "duplicate_id"
    again = F.sequence(F.lit(1), F.when(F.col("rule") == "missing_reference", F.col("n")).otherwise(1).cast("int"))
    return known.select(
        "rule",
        F.when(twice, F.concat_ws("/", "a", "b")).otherwise(F.col("a")).alias("key"),
        F.when(twice, F.col("n").cast("string")).otherwise(F.col("b")).alias("detail"),
        F.explode(again).alias("again"),
    ).drop("again")


def age_findings(patients: DataFrame, as_of: Column, low: int = 0, high: int = 120) -> DataFrame:
    from ..functions.fhir import age_at

    age = age_at(F.col("birth_date"), as_of)
    return _finding(
        patients.where(F.col("birth_date").isNull() | ~age.between(low, high)), "invalid_age", F.col("patient_id"), age
    )


def required_codes(rows: DataFrame, codes: list[str], rule: str, column: str = "code") -> DataFrame:
    wanted = rows.sparkSession.createDataFrame([(c,) for c in codes], f"{column} string")
    present = rows.where(F.col(column).isin(codes)).select(column).distinct()
    return _finding(wanted.join(present, column, "left_anti"), rule, F.col(column), F.lit(""))


def minimum_counts(rows: DataFrame, column: str, minimum: dict[str, int], rule: str = "insufficient_rows") -> DataFrame:
    wanted = rows.sparkSession.createDataFrame(list(minimum.items()), f"{column} string, need bigint")
    counted = rows.groupBy(column).agg(F.count("*").alias("n"))
    short = wanted.join(counted, column, "left").fillna(0, ["n"]).where("n < need")
    return _finding(short, rule, F.col(column), F.col("n"))


def count_mismatch(rows: DataFrame, column: str, expected: DataFrame) -> DataFrame:
    """Counts per value that differ from the expected `(value, expected)` rows."""
    counted = rows.groupBy(column).agg(F.count("*").alias("n"))
    both = counted.join(expected, column, "full").fillna(0, ["n", "expected"])
    return _finding(both.where("n <> expected"), "count_mismatch", F.col(column), F.col("n"))


def one_to_one(assignments: DataFrame, left: str, right: str) -> DataFrame:
    """Ids used more than once on either side."""

    def repeated(col: str) -> DataFrame:
        n = assignments.groupBy(col).agg(F.count("*").alias("n")).where("n > 1")
        return _finding(n, f"duplicate_{col}", F.col(col), F.col("n"))

    return repeated(left).unionByName(repeated(right))


def cohort_validate(
    entries: DataFrame, patients: DataFrame, conditions: DataFrame, encounters: DataFrame,
    assignments: DataFrame, as_of: Column, codes: list[str], class_minimum: dict[str, int],
) -> DataFrame:
    """All cohort rules as (rule, key, detail) rows; empty means valid."""
    return _union(
        [
            entry_findings(entries),
            age_findings(patients, as_of),
            required_codes(conditions, codes, "missing_condition_code"),
            minimum_counts(encounters, "encounter_class", class_minimum, "insufficient_encounters"),
            one_to_one(assignments, "device_id", "patient_id"),
        ]
    )


# --- data presence ----------------------------------------------------------------------

# File suffixes and resource types of the presence rules.
RECORD_SUFFIXES = ["csv", "tsv", "ndjson", "jsonl", "dcm", "avro", "orc", "feather", "arrow"]
ARCHIVE_SUFFIXES = ["zip", "tar", "gz", "tgz", "7z", "whl", "jar", "pbix"]
DATABASE_SUFFIXES = ["db", "sqlite", "sqlite3"]
JSON_SUFFIXES = ["json", "avsc", "bim", "pbir", "pbism"]
# Folders and files that must not be in a repository.
BLOCKED_PATHS = [
    r"(^|/)(prepackaged|\.generated|\.hds-build|patientoutreachanalytics)(/|$)",
    r"(^|/)canonical-fixture-manifest\.json$",
    r"^output(/|$)",
    r"^synthea/output(/|$)",
    r"^vendor/microsoft-hds/[^/]+/([^/]+/)?(sampledata|referencedata)(/|$)",
]
NON_CLINICAL_TYPES = [
    "Bundle", "Organization", "CodeSystem", "ValueSet", "ConceptMap", "StructureDefinition", "SearchParameter",
    "CapabilityStatement", "OperationDefinition", "NamingSystem", "CompartmentDefinition", "ImplementationGuide",
]


def data_presence_scan(files: DataFrame) -> DataFrame:
    """Files that hold populated clinical data, with the rule they break.

    Input `(path, payload, row_count)`; `row_count` is the parquet row count
    where known. Resource types are found at any depth by pattern.
    """
    path, payload = F.lower("path"), F.coalesce("payload", F.lit(""))
    suffix = F.regexp_extract(path, r"\.([a-z0-9]+)$", 1)
    types = F.regexp_extract_all(payload, F.lit(r'"resourceType"\s*:\s*"([A-Z][A-Za-z0-9]*)"'), 1)
    clinical = F.exists(types, lambda t: ~t.isin(*NON_CLINICAL_TYPES))
    statistics = payload.rlike(r'numRecords\\?"\s*:\s*[1-9]') | payload.rlike(r'(min|max)Values\\?"\s*:\s*\{\\?"')
    blocked = path.rlike("|".join(BLOCKED_PATHS))
    has_output = payload.rlike(r'"outputs"\s*:\s*\[\s*[^\]\s]')
    rule = cascade(
        [
            (blocked, "blocked-path"),
            ((suffix == "parquet") & (F.coalesce("row_count", F.lit(0)) > 0), "populated-parquet"),
            (suffix.isin(DATABASE_SUFFIXES) & (payload != ""), "database-payload"),
            (suffix.isin(RECORD_SUFFIXES), "record-file"),
            (suffix.isin(ARCHIVE_SUFFIXES), "archive-file"),
            ((suffix == "ipynb") & has_output, "notebook-output"),
            (path.contains("_delta_log/") & statistics, "sample-delta-statistics"),
            (suffix.isin(JSON_SUFFIXES) & clinical, "clinical-fhir-record"),
        ],
        F.lit(None),
    )
    return files.select("path", rule.alias("violation")).where(F.col("violation").isNotNull())
