"""Lazily built frames for the checked queries, all derived from one folder."""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from carespark.functions.lineage import checkpoint_folder
from carespark.operators import alerts, cost, gold, graph, lookups, quality, risk, silver
from carespark.plans.session import small_methods
from carespark.sources.lakehouse import COMPRESSION

from .fixtures import SCHEMAS, views

AS_OF_DAY = "2026-07-01"
#: Rows of a written file; only more files than cores matter.
FILE_ROWS = 20_000
_WRITTEN: dict[tuple[str, str, str], tuple] = {}
YEAR = ("2025-07-01", "2026-07-01")


def _ref(kind: str, id_expr: str, num: str) -> str:
    """JSON reference; the four source shapes rotate by `num`."""
    obj = lambda *kv: f"to_json(named_struct({', '.join(kv)}))"
    return (
        f"case {num} % 4 "
        f"when 0 then {obj(repr('reference'), f'''concat('{kind}/', {id_expr})''')} "
        f"when 1 then {obj(repr('msftSourceReference'), f'''concat('{kind}/', {id_expr})''')} "
        f"when 2 then {obj(repr('idOrig'), id_expr, repr('type'), repr(kind))} "
        f"else {obj(repr('identifier'), f'''named_struct('value', {id_expr})''')} end"
    )


def _concept(system: str, code: str, display: str, text: str = "cast(null as string)") -> str:
    return (
        f"to_json(named_struct('coding', array(named_struct('system', {system}, 'code', {code}, "
        f"'display', {display})), 'text', {text}))"
    )


class Lake:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.shared: set[str] = set()
        self._views = views("spark")
        small_methods(spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")

    def typed(self, name: str) -> DataFrame:
        base, where, cols = self._views[name]
        if " join " in base:
            left, rest = base.split(" join ")
            right, cond = rest.split(" on ")
            df = self.table(left).join(self.table(right), F.expr(cond))
        else:
            df = self.table(base)
        if where:
            df = df.where(where)
        return df.selectExpr(*[f"{e} as {n}" for n, e in cols])

    # --- streams ---
    @cached_property
    def telemetry(self) -> DataFrame:
        return self.typed("telemetry")

    @cached_property
    def claims(self) -> DataFrame:
        return self.typed("claims")

    @cached_property
    def as_of(self) -> Column:
        return self.table("events").agg(F.max("ts")).scalar()

    @cached_property
    def claims_as_of(self) -> Column:
        return self.table("lineitem").agg(F.max("l_shipdate")).scalar()

    @property
    def as_of_day(self) -> Column:
        return F.lit(AS_OF_DAY).cast("date")

    # --- silver: JSON text forms of the typed views ---
    def silver(self, name: str) -> DataFrame:
        """Built in the query that reads it: only the members it uses become JSON, and no copy is written first."""
        return getattr(self, f"_silver_{name}")

    def written(self, name: str, make) -> DataFrame:
        """Rows written once per session and source folder, in files that all cores can read."""
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _WRITTEN:
            df = make()
            path = f"{checkpoint_folder(self.spark)}/lake-{uuid.uuid4().hex}/{name}"
            df.write.option("maxRecordsPerFile", FILE_ROWS).parquet(path)
            _WRITTEN[key] = (path, df.schema)
        path, schema = _WRITTEN[key]
        return self.spark.read.schema(schema).parquet(path)

    def share(self, name: str, *columns: str) -> Lake:
        """Writes the used columns (all without any) of a frame that several steps of one query read: it is built once for it."""
        df = getattr(self, name).select(*columns or ["*"])
        path = f"{checkpoint_folder(self.spark)}/share-{uuid.uuid4().hex}/{name}"
        df.write.option("compression", COMPRESSION).parquet(path)
        self.__dict__[name] = self.spark.read.schema(df.schema).parquet(path)
        self.shared.add(name)
        return self

    @cached_property
    def _silver_patient(self) -> DataFrame:
        return self.typed("patients").selectExpr(
            "patient_id as idOrig", "cast(birth_date as string) as birthDate", "gender", "num", "site",
            "case when num % 3 = 0 then to_json(array(named_struct('text', concat(given, ' ', family)))) "
            "else to_json(array(named_struct('given', array(given), 'family', family))) end as name_string",
        )

    @cached_property
    def _silver_condition(self) -> DataFrame:
        return self.typed("conditions").selectExpr(
            "condition_id as idOrig",
            f"{_ref('Patient', 'patient_id', 'num')} as subject_string",
            f"{_ref('Encounter', 'encounter_id', 'num + 1')} as encounter_string",
            f"{_concept('system', 'code', 'display')} as code_string",
            "case when clinical_status is null then null else "
            f"{_concept(repr('status'), 'clinical_status', 'clinical_status')} end as clinicalStatus_string",
            "cast(onset_date as string) as onsetDateTime",
        )

    @cached_property
    def _silver_observation(self) -> DataFrame:
        return self.typed("observations").selectExpr(
            "observation_id as idOrig",
            f"{_ref('Patient', 'patient_id', 'num')} as subject_string",
            f"{_concept(repr('http://loinc.org'), 'code', 'display')} as code_string",
            "to_json(named_struct('value', value, 'unit', unit)) as valueQuantity_string",
            "cast(obs_date as string) as effectiveDateTime",
        )

    @cached_property
    def _silver_medication(self) -> DataFrame:
        return self.typed("medications").selectExpr(
            "medication_id as idOrig",
            f"{_ref('Patient', 'patient_id', 'num')} as subject_string",
            f"{_concept(repr('rxnorm'), 'code', 'display')} as medicationCodeableConcept_string",
            "cast(authored_date as string) as authoredOn", "status",
        )

    @cached_property
    def _silver_immunization(self) -> DataFrame:
        return self.typed("immunizations").selectExpr(
            "immunization_id as idOrig",
            f"{_ref('Patient', 'patient_id', 'num')} as patient_string",
            f"{_concept(repr('cvx'), 'code', 'display')} as vaccineCode_string",
            "cast(imm_date as string) as occurrenceDateTime",
        )

    @cached_property
    def _silver_encounter(self) -> DataFrame:
        return self.typed("encounters").selectExpr(
            "encounter_id as idOrig",
            f"{_ref('Patient', 'patient_id', 'num')} as subject_string",
            "to_json(named_struct('code', encounter_class)) as class_string",
            "to_json(array(named_struct('coding', array(named_struct('display', type_display))))) as type_string",
            "to_json(named_struct('start', date_format(start_time, 'yyyy-MM-dd HH:mm:ss'), "
            "'end', date_format(end_time, 'yyyy-MM-dd HH:mm:ss'))) as period_string",
            "case when num % 2 = 0 then to_json(array(named_struct('location', named_struct('id', location_id)))) "
            "else to_json(array(named_struct('location', named_struct('identifier', named_struct('value', location_id))))) "
            "end as location_string",
        )

    @cached_property
    def _silver_coverage(self) -> DataFrame:
        both = self.typed("coverage").unionByName(self.typed("coverage2"))
        return both.selectExpr(
            "coverage_id as idOrig",
            f"{_ref('Patient', 'patient_id', 'num')} as beneficiary_string",
            f"{_concept(repr('cov'), 'type_code', 'type_display', 'type_text')} as type_string",
            "to_json(array(named_struct('display', payer_name))) as payor_string",
            "to_json(named_struct('start', cast(cov_start as string), 'end', cast(cov_end as string))) as period_string",
        )

    @cached_property
    def _silver_eob(self) -> DataFrame:
        return self.typed("eob").selectExpr(
            "claim_id as idOrig",
            f"{_ref('Patient', 'patient_id', 'num')} as patient_string",
            f"{_ref('Practitioner', 'provider_id', 'num + 1')} as provider_string",
            f"{_ref('Location', 'facility_id', 'num + 2')} as facility_string",
            "case when coverage_id = '' then null else "
            "to_json(array(named_struct('coverage', named_struct('idOrig', coverage_id)))) end as insurance_string",
            f"{_concept(repr('claim'), 'lower(claim_type)', 'claim_type')} as type_string",
            "outcome", "cast(created as string) as created",
            "to_json(named_struct('start', cast(bill_start as string))) as billablePeriod_string",
            "to_json(array(named_struct('amount', named_struct('value', billed)), "
            "named_struct('amount', named_struct('value', paid)))) as total_string",
            "case when payment is null then null else "
            "to_json(named_struct('amount', named_struct('value', payment))) end as payment_string",
        )

    @cached_property
    def _silver_imaging(self) -> DataFrame:
        return self.typed("imaging").selectExpr(
            "study_id as idOrig", "modality", "description",
            f"{_ref('Patient', 'patient_id', 'num div 20')} as subject_string", "started",
            "number_of_series as numberOfSeries", "number_of_instances as numberOfInstances",
        )

    @cached_property
    def _silver_basic(self) -> DataFrame:
        """One association per telemetry device; every seventh has another code."""
        users = self.table("events").select("user_id").distinct()
        return users.selectExpr(
            "concat('basic-', user_id) as id",
            _concept(repr("assoc"), "case when user_id % 7 = 3 then 'other' when user_id % 2 = 0 then 'device-assoc' else 'ASSIGNED' end", repr("Device association")) + " as code_string",
            "case user_id % 3 when 0 then to_json(named_struct('idOrig', concat('pat-', user_id), 'display', concat('Patient ', user_id))) "
            "when 1 then to_json(named_struct('msftSourceReference', concat('Patient/pat-', user_id), 'display', concat('Patient ', user_id))) "
            "else to_json(named_struct('identifier', named_struct('value', concat('pat-', user_id)), 'display', concat('Patient ', user_id))) end as subject_string",
            "to_json(array(named_struct('url', 'http://example.org/note', 'valueReference', named_struct('reference', 'Device/none')), "
            "named_struct('url', case when user_id % 2 = 0 then 'http://example.org/associated-device' else 'http://example.org/device-association-device' end, "
            "'valueReference', named_struct('reference', concat('Device/DEV-', lpad(cast(user_id as string), 5, '0')))))) as extension_string",
        )

    # --- typed rows parsed back from the JSON forms ---
    @cached_property
    def patients(self) -> DataFrame:
        return silver.patients(self.silver("patient"))

    @cached_property
    def conditions(self) -> DataFrame:
        return silver.conditions(self.silver("condition"))

    @cached_property
    def patient_facts(self) -> DataFrame:
        return silver.patient_facts(self.silver("patient"))

    @cached_property
    def observations(self) -> DataFrame:
        return silver.observations(self.silver("observation"))

    @cached_property
    def medications(self) -> DataFrame:
        return silver.medications(self.silver("medication"))

    @cached_property
    def immunizations(self) -> DataFrame:
        return silver.immunizations(self.silver("immunization"))

    @cached_property
    def encounters(self) -> DataFrame:
        return silver.encounters(self.silver("encounter"))

    @cached_property
    def coverage(self) -> DataFrame:
        return silver.coverage(self.silver("coverage"))

    @cached_property
    def eob(self) -> DataFrame:
        return silver.explanations(self.silver("eob"))

    @cached_property
    def imaging(self) -> DataFrame:
        return silver.imaging(self.silver("imaging"))

    @cached_property
    def basics(self) -> DataFrame:
        return silver.device_basics(self.silver("basic"))

    # --- gold ---
    @cached_property
    def dim_payer(self) -> DataFrame:
        return gold.dim_payer(self.coverage)

    @cached_property
    def patient_payer(self) -> DataFrame:
        return gold.patient_payer(self.dim_payer)

    @cached_property
    def fact_claim(self) -> DataFrame:
        return gold.fact_claim(self.eob, self.dim_payer, self.patient_payer)

    @cached_property
    def features(self) -> DataFrame:
        return quality.quality_features(
            self.patient_facts, self.conditions, self.observations, self.medications, self.immunizations, self.as_of_day
        )

    @cached_property
    def measures(self) -> DataFrame:
        return quality.quality_measures(self.features, self.patient_payer)

    @cached_property
    def quality_summary(self) -> DataFrame:
        return quality.quality_summary(self.measures)

    @cached_property
    def adherence(self) -> DataFrame:
        return quality.medication_adherence(self.medications)

    @cached_property
    def care_gaps(self) -> DataFrame:
        return quality.care_gaps(self.measures)

    @cached_property
    def rated(self) -> DataFrame:
        return quality.rated_measures(self.quality_summary, self.adherence)

    @cached_property
    def patient_hcc(self) -> DataFrame:
        return risk.hcc_hierarchy(risk.patient_hcc(self.conditions))

    @cached_property
    def risk_scores(self) -> DataFrame:
        return risk.risk_scores(self.patient_facts, self.patient_hcc, self.patient_payer, self.as_of_day)

    @cached_property
    def readmission_features(self) -> DataFrame:
        return risk.readmission_features(
            self.encounters, self.patient_facts, self.conditions, self.medications, self.patient_payer, self.as_of_day
        )

    @cached_property
    def readmission(self) -> DataFrame:
        scored = risk.readmission_rule_score(self.readmission_features)
        return risk.readmission_scores(scored, self.patient_payer)

    @cached_property
    def months(self) -> DataFrame:
        return cost.member_months(self.coverage, self.as_of_day)

    @cached_property
    def classified(self) -> DataFrame:
        return cost.classify_encounters(self.encounters)

    @cached_property
    def rates(self) -> DataFrame:
        return cost.population_rates(self.classified, self.fact_claim, self.months)

    @cached_property
    def utilization(self) -> DataFrame:
        return cost.utilization_monthly(self.classified, self.rates)

    @cached_property
    def high_cost(self) -> DataFrame:
        return cost.high_cost_claimants(self.fact_claim, self.conditions)

    # --- reports ---
    @cached_property
    def person(self) -> DataFrame:
        """Patients with name and home place."""
        place = self.typed("patients").selectExpr(
            "patient_id", "concat('City ', num % 7) as city", "case when num % 5 = 0 then 'TN' else 'GA' end as state"
        )
        named = self.patients.select(
            "patient_id", "birth_date", "gender", alerts.pick_name(F.col("name")).alias("patient_name")
        )
        return named.join(place, "patient_id")

    @cached_property
    def costs(self) -> DataFrame:
        return self.claims.select("patient_id", F.col("claim_amount").alias("total_charge"))

    @cached_property
    def by_payer(self) -> DataFrame:
        return cost.utilization_by_payer(self.classified, self.patient_payer)

    @cached_property
    def star_detail(self) -> DataFrame:
        return quality.star_detail(self.rated)

    @cached_property
    def opportunity(self) -> DataFrame:
        return risk.revenue_opportunity(self.risk_scores)

    @cached_property
    def procedures(self) -> DataFrame:
        return self.claims.select(
            F.col("claim_id").alias("procedure_id"), "patient_id", F.col("procedure_code").alias("display"),
            F.to_date("event_timestamp").alias("performed"),
        )

    @cached_property
    def associations(self) -> DataFrame:
        return lookups.device_associations(self.basics)

    def edge_table(self, name: str) -> DataFrame:
        silver_tables = {
            "Encounter": "encounter", "Condition": "condition", "MedicationRequest": "medication",
            "Observation": "observation", "ImagingStudy": "imaging",
        }
        if name in silver_tables:
            return graph.project_node_table(self.silver(silver_tables[name]), name)
        if name == "DeviceAssociation":
            return graph.device_association(self.basics)
        if name == "fact_claim":
            return self.fact_claim.withColumn("claim_key", F.col("claim_id"))
        if name == "FactDiagnosis":
            if "conditions" in self.shared:  # an edge shows no encounter
                rows = graph.with_optional(self.conditions, encounter_ref="string")
                facts = gold.fact_diagnosis(rows).drop("encounter_ref")
            else:
                facts = gold.fact_diagnosis(silver.conditions(self.silver("condition"), with_encounter=True))
            return graph.fact_diagnosis_projection(facts).withColumn("fact_diagnosis_key", F.col("diagnosis_id"))
        return {
            "Telemetry": lambda: self.telemetry,
            "agg_medication_adherence": lambda: self.adherence,
            "care_gaps": lambda: self.care_gaps,
            "agg_risk_scores": lambda: self.risk_scores,
            "agg_high_cost_claimants": lambda: self.high_cost,
        }[name]()

    def edges_of(self, *kinds: str, near: dict[str, str] | None = None) -> DataFrame:
        """Edges of the named types; only their tables are built, claims once where several types read them."""
        tables = [graph.EDGE_TYPES[k][0] for k in kinds]
        if tables.count("fact_claim") > 1 and "fact_claim" not in self.shared:
            self.share("fact_claim", "patient_id", "claim_id", "coverage_id")
        return graph.edges({t: self.edge_table(t) for t in sorted(set(tables))}, list(kinds), near)
