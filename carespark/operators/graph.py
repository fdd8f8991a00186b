"""Graph projections: typed nodes, key-pair edges, small matches, audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.fhir import REFERENCE, ontology_patient_id


def with_optional(df: DataFrame, **columns: str) -> DataFrame:
    """Adds missing optional columns as typed nulls."""
    for name, kind in columns.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def device_association(basics: DataFrame, code: str = "device-assoc") -> DataFrame:
    """Association projection with bare device and patient ids."""
    is_device = F.lower("ext.url").rlike("associated-device|device-association-device")
    return (
        basics.where(F.col("code.coding")[0]["code"] == code)
        .withColumn("ext", F.explode("extension"))
        .where(is_device)
        .select(
            "id",
            F.regexp_replace("ext.valueReference.reference", "^Device/", "").alias("device_ref"),
            F.col("subject.display").alias("patient_name"),
            ontology_patient_id(F.col("subject")).alias("patient_id"),
            F.col("code.coding")[0]["code"].alias("assoc_code"),
            F.col("code.coding")[0]["display"].alias("assoc_display"),
        )
    )


# Projection name -> (reference column, kept columns with type).
PROJECTIONS = {
    "Patient": (None, {"idOrig": "string", "name_string": "string", "gender": "string", "birthDate": "string"}),
    "Device": (None, {"idOrig": "string", "type_string": "string", "status": "string"}),
    "Encounter": ("subject_string", {"idOrig": "string", "class_string": "string", "status": "string", "period_start": "string"}),
    "Condition": ("subject_string", {"idOrig": "string", "code_string": "string", "clinicalStatus_string": "string"}),
    "MedicationRequest": ("subject_string", {"idOrig": "string", "medicationCodeableConcept_string": "string", "status": "string", "authoredOn": "string"}),
    "Observation": ("subject_string", {"idOrig": "string", "code_string": "string", "valueQuantity_value": "double", "valueQuantity_unit": "string", "effectiveDateTime": "string"}),
    "ImagingStudy": ("subject_string", {"idOrig": "string", "description": "string", "numberOfSeries": "long", "numberOfInstances": "long"}),
}


def project_node_table(silver: DataFrame, name: str) -> DataFrame:
    """Node projection of one Silver table; absent columns become typed nulls."""
    reference, columns = PROJECTIONS[name]
    df = silver
    if name == "Encounter" and "period_string" in df.columns:
        from_json = F.get_json_object("period_string", "$.start")
        own = F.col("period_start") if "period_start" in df.columns else F.lit(None).cast("string")
        df = df.withColumn("period_start", F.coalesce(F.nullif(F.trim(own), F.lit("")), from_json))
    if name == "Observation" and "valueQuantity_string" in df.columns:
        for part, kind in (("value", "double"), ("unit", "string")):
            own = F.col(f"valueQuantity_{part}") if f"valueQuantity_{part}" in df.columns else F.lit(None).cast(kind)
            df = df.withColumn(f"valueQuantity_{part}", F.coalesce(own, F.get_json_object("valueQuantity_string", f"$.{part}").cast(kind)))
    df = with_optional(df, **columns)
    if reference is None:
        return df.select(*[F.col(c).cast(t).alias(c) for c, t in columns.items()])
    row = F.struct(F.from_json(F.col(reference), REFERENCE).alias("ref"))
    parsed = df.select(*[F.col(c).cast(t).alias(c) for c, t in columns.items()], F.inline(F.array(row)))
    patient = ontology_patient_id(F.col("ref"), imaging=name == "ImagingStudy")
    return parsed.withColumn("patient_id", patient).drop("ref")


def fact_diagnosis_projection(fact_diagnosis: DataFrame) -> DataFrame:
    return fact_diagnosis.withColumn("patient_id", F.regexp_replace("patient_ref", "^Patient/", ""))


def nodes(df: DataFrame, label: str, key: str, *properties: str) -> DataFrame:
    """Uniform node rows `(id, label, props)`."""
    pairs = [x for p in properties for x in (F.lit(p), F.col(p).cast("string"))]
    props = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return df.select(F.col(key).cast("string").alias("id"), F.lit(label).alias("label"), props.alias("props"))


# Edge type -> (table, source label, source key, target label, target key).
EDGE_TYPES = {
    "hasEncounter": ("Encounter", "Patient", "patient_id", "Encounter", "idOrig"),
    "hasCondition": ("Condition", "Patient", "patient_id", "Condition", "idOrig"),
    "hasObservation": ("Observation", "Patient", "patient_id", "Observation", "idOrig"),
    "hasMedication": ("MedicationRequest", "Patient", "patient_id", "MedicationRequest", "idOrig"),
    "hasImagingStudy": ("ImagingStudy", "Patient", "patient_id", "ImagingStudy", "idOrig"),
    "linkedToDevice": ("DeviceAssociation", "Patient", "patient_id", "Device", "device_ref"),
    "generatesTelemetry": ("Telemetry", "Device", "device_id", "DeviceTelemetry", "device_id"),
    "hasClaim": ("fact_claim", "Patient", "patient_id", "Claim", "claim_key"),
    "coveredBy": ("fact_claim", "Claim", "claim_key", "Payer", "coverage_id"),
    "hasDiagnosis": ("FactDiagnosis", "Patient", "patient_id", "PatientDiagnosis", "fact_diagnosis_key"),
    "diagnosisClassifiedAs": ("FactDiagnosis", "PatientDiagnosis", "fact_diagnosis_key", "Diagnosis", "icd_code"),
    "hasAdherence": ("agg_medication_adherence", "Patient", "patient_id", "MedAdherence", "patient_id"),
    "hasCareGap": ("care_gaps", "Patient", "patient_id", "CareGap", "patient_id"),
    "hasRiskScore": ("agg_risk_scores", "Patient", "patient_id", "PatientRisk", "patient_id"),
    "hasHighCostProfile": ("agg_high_cost_claimants", "Patient", "patient_id", "HighCostClaimant", "patient_id"),
}

# Edge types one of whose ends is the id of a single resource, and that end: few pairs share it.
OWN_ENDS = {
    "hasEncounter": "dst", "hasCondition": "dst", "hasObservation": "dst", "hasMedication": "dst", "hasImagingStudy": "dst",
    "hasClaim": "dst", "coveredBy": "src", "hasDiagnosis": "dst", "diagnosisClassifiedAs": "src",
}


def edges(tables: dict[str, DataFrame], kinds: list[str] | None = None, near: dict[str, str] | None = None) -> DataFrame:
    """Distinct non-null key pairs of every edge type whose table is given.

    `near` names, per type, the end (src or dst) that the next step joins on: its pairs are shuffled by that end
    once, for the distinct and the join. Only for ends that few pairs share.
    """
    parts, near = [], near or {}
    for kind in kinds or EDGE_TYPES:
        table, src_label, src, dst_label, dst = EDGE_TYPES[kind]
        if table not in tables:
            continue
        text = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
        # a generator: the keys, often parsed from JSON, are not computed again by the filter
        ends = F.inline(F.array(F.struct(text(src).alias("src"), text(dst).alias("dst"))))
        pairs = tables[table].select(ends).where(F.col("src").isNotNull() & F.col("dst").isNotNull())
        if kind in near:
            pairs = pairs.repartition(near[kind])
        # distinct pairs of one table: joins of it that add no rows and no end are dropped by the optimizer
        parts.append(
            pairs.distinct().select("src", "dst", F.lit(kind).alias("type"), F.lit(src_label).alias("src_label"), F.lit(dst_label).alias("dst_label"))
        )
    return reduce(DataFrame.unionByName, parts)


def match_one_hop(edge_rows: DataFrame, kind: str) -> DataFrame:
    return edge_rows.where(F.col("type") == kind).select("src", "dst")


def match_path(edge_rows: DataFrame, first: str, second: str, optional: bool = False) -> DataFrame:
    """Chains `start -first-> middle -second-> end`; `optional` keeps chains that stop early."""
    a = match_one_hop(edge_rows, first).select(F.col("src").alias("start"), F.col("dst").alias("middle"))
    b = match_one_hop(edge_rows, second).select(F.col("src").alias("middle"), F.col("dst").alias("end"))
    return a.join(b, "middle", "left" if optional else "inner").select("start", "middle", "end")


def match_fork(edge_rows: DataFrame, first: str, second: str, optional: bool = False) -> DataFrame:
    """`start -first-> a` with the second relation of the same start beside it.

    The second relation is reduced to its smallest end and its count per start,
    so a start with many ends on both sides does not multiply.
    """
    a = match_one_hop(edge_rows, first).select(F.col("src").alias("start"), F.col("dst").alias("first_end"))
    b = (
        match_one_hop(edge_rows, second)
        .groupBy(F.col("src").alias("start"))
        .agg(F.min("dst").alias("second_end"), F.count("*").alias("second_count"))
    )
    return a.join(b, "start", "left" if optional else "inner").fillna(0, ["second_count"])


def match_fork_rows(first: DataFrame, second: DataFrame, optional: bool = False, limit: int | None = None) -> DataFrame:
    """Rows (start, first_end, second_end) of two relations that share their start.

    `first` is (start, first_end), `second` (start, second_end). With `optional`
    a start without a second relation keeps its rows, `second_end` being null.

    With `limit`, the first rows in (start, first_end, second_end) order. Every
    start gives a row at least, so only as many starts as rows are wanted, and
    of each only as many ends, are joined at all: a hub with many ends on both
    sides is never expanded beyond that.
    """
    if limit is not None:
        if not optional:
            first = first.join(second.select("start").distinct(), "start", "left_semi")
        starts = F.broadcast(first.select("start").distinct().orderBy("start").limit(limit))

        def least(edges: DataFrame, end: str) -> DataFrame:
            order = Window.partitionBy("start").orderBy(F.col(end).asc_nulls_first())
            return edges.join(starts, "start", "left_semi").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")

        first, second = least(first, "first_end"), least(second, "second_end")
    rows = first.join(second, "start", "left" if optional else "inner").select("start", "first_end", "second_end")
    return rows if limit is None else rows.orderBy("start", "first_end", "second_end").limit(limit)


def fork_path_count(edge_rows: DataFrame, first: str, second: str) -> DataFrame:
    """Number of (first, second) pairs over all starts, without forming them."""
    degree = lambda k, n: match_one_hop(edge_rows, k).groupBy("src").agg(F.count("*").alias(n))
    return degree(first, "_a").join(degree(second, "_b"), "src").agg(
        F.coalesce(F.sum(F.col("_a") * F.col("_b")), F.lit(0)).alias("paths"), F.count("*").alias("starts")
    )


def edge_counts(edge_rows: DataFrame, kind: str | None = None, end: str | None = None) -> DataFrame:
    """Edges and distinct ends per type.

    `kind` and `end` name the one type to count and the end that its pairs are dealt by (`near` of `edges`): that end
    is counted where its pairs lie, and only the other one is shuffled again.
    """
    if kind is not None:
        pairs, other = match_one_hop(edge_rows, kind), "src" if end == "dst" else "dst"
        own = pairs.groupBy(end).agg(F.count("*").alias("n")).agg(F.sum("n").alias("edges"), F.count(end).alias(end))
        ends = own.crossJoin(pairs.select(other).distinct().agg(F.count(other).alias(other))).where(F.col("edges") > 0)
        return ends.select(F.lit(kind).alias("type"), "edges", F.col("src").alias("sources"), F.col("dst").alias("targets"))
    return edge_rows.groupBy("type").agg(
        F.count("*").alias("edges"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets")
    )


def edge_audit(edge_rows: DataFrame, node_rows: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Edges, dangling ends and a zero-row mark per type.

    Both ends are counted per node before the join, so a node that ends most
    edges (a diagnosis code) is one row there.
    """
    kinds = list(kinds or EDGE_TYPES)
    known = node_rows.select("id", "label").distinct().withColumn("known", F.lit(1))
    ends = F.inline(
        F.array(*[F.struct(F.lit(e).alias("end"), F.col(e).alias("id"), F.col(f"{e}_label").alias("label")) for e in ("src", "dst")])
    )
    # grouped by the node alone, with a count per type and end: the join needs no other shuffle
    count = lambda kind, end: F.count(F.when((F.col("type") == kind) & (F.col("end") == end), 1))
    nodes = (
        edge_rows.where(F.col("type").isin(kinds))
        .select("type", ends)
        .groupBy("id", "label")
        .agg(*[count(k, e).alias(f"{e}_{i}") for i, k in enumerate(kinds) for e in ("src", "dst")])
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    dangling = lambda c: total(F.when(F.col("known").isNull(), F.col(c)))
    audited = nodes.join(known, ["id", "label"], "left").agg(
        *[
            F.struct(
                F.lit(k).alias("type"), total(F.col(f"src_{i}")).alias("edges"),
                dangling(f"src_{i}").alias("dangling_src"), dangling(f"dst_{i}").alias("dangling_dst"),
            ).alias(f"audit_{i}")
            for i, k in enumerate(kinds)
        ]
    )
    return audited.select(F.inline(F.array(*[F.col(f"audit_{i}") for i in range(len(kinds))]))).withColumn("is_empty", F.col("edges") == 0)
