"""Batch job: Silver tables to the Gold star schema, then the row gate.

Every table is written once and read back, so a later step starts from stored
rows and a lost executor costs one step at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import cost, gates, gold, quality, risk, silver
from ..refdata import clinical as ref
from ..sources.lakehouse import COMPRESSION, Lakehouse

SILVER = ["Coverage", "Condition", "ExplanationOfBenefit", "Patient", "Observation", "MedicationRequest", "Immunization", "Encounter"]
# Tables that may legitimately hold no row.
OPTIONAL = {
    "dim_payer", "agg_medication_adherence", "fact_patient_hcc", "revenue_opportunity", "agg_condition_pmpm",
    "dim_diagnosis", "fact_diagnosis", "readmission_risk_scores", "readmission_risk_summary",
    "readmission_model_performance",
}


class GoldBuild:
    def __init__(self, spark: SparkSession, lake: Lakehouse, as_of: str = ref.PERIOD_END, use_model: bool = True):
        self.spark, self.lake, self.use_model = spark, lake, use_model
        self.as_of = F.lit(as_of).cast("date")
        self.written: dict[str, DataFrame] = {}

    def save(self, name: str, df: DataFrame) -> DataFrame:
        self.written[name] = self.lake.write_gold(df, name)
        return self.written[name]

    def parsed(self, name: str, df: DataFrame) -> DataFrame:
        """Typed rows that several tables need, parsed from JSON once."""
        path = self.lake.path("parsed", name)
        df.write.format(self.lake.format).option("compression", COMPRESSION).mode("overwrite").save(path)
        return self.spark.read.format(self.lake.format).load(path)

    def run(self) -> DataFrame:
        """Builds all tables and returns the gate rows."""
        read = self.lake.read_silver
        coverage = self.parsed("coverage", silver.coverage(read("Coverage")))
        conditions = self.parsed("conditions", silver.conditions(read("Condition"), with_encounter=True))
        patients = self.parsed("patients", silver.patient_facts(read("Patient")))
        medications = self.parsed("medications", silver.medications(read("MedicationRequest")))
        encounters = self.parsed("encounters", silver.encounters(read("Encounter")))

        payers = self.save("dim_payer", gold.dim_payer(coverage))
        patient_payers = self.save("patient_payer", gold.patient_payer(payers))
        self.save("dim_diagnosis", gold.dim_diagnosis(conditions))
        claims = self.save(
            "fact_claim", gold.fact_claim(silver.explanations(read("ExplanationOfBenefit")), payers, patient_payers)
        )
        self.save("fact_diagnosis", gold.fact_diagnosis(conditions))

        features = quality.quality_features(
            patients, conditions, silver.observations(read("Observation")), medications,
            silver.immunizations(read("Immunization")), self.as_of,
        )
        measures = self.save("agg_quality_measures", quality.quality_measures(features, patient_payers))
        summary = self.save("agg_quality_summary", quality.quality_summary(measures))
        adherence = self.save("agg_medication_adherence", quality.medication_adherence(medications))
        gaps = self.save("care_gaps", quality.care_gaps(measures))
        stars = self.save("star_rating_detail", quality.star_detail(quality.rated_measures(summary, adherence)))
        self.save("star_rating_simulation", quality.star_simulation(stars, gaps))

        self.save("dim_hcc", risk.dim_hcc(self.spark))
        hcc = self.save("fact_patient_hcc", risk.hcc_hierarchy(risk.patient_hcc(conditions)))
        scores = self.save("agg_risk_scores", risk.risk_scores(patients, hcc, patient_payers, self.as_of))
        self.save("agg_risk_summary", risk.risk_summary(scores))
        self.save("revenue_opportunity", risk.revenue_opportunity(scores))

        stays = risk.readmission_features(encounters, patients, conditions, medications, patient_payers, self.as_of)
        if self.use_model and risk.can_fit(stays):  # else the fixed rule scores
            scored, performance = risk.readmission_model(stays)
        else:
            scored = risk.readmission_rule_score(stays)
            performance = risk.rule_performance(scored)
        readmission = self.save("readmission_risk_scores", risk.readmission_scores(scored, patient_payers))
        self.save("readmission_risk_summary", risk.readmission_summary(readmission))
        self.save("readmission_model_performance", performance)

        classified = cost.classify_encounters(encounters)
        rates = cost.population_rates(classified, claims, cost.member_months(coverage, self.as_of))
        utilization = self.save("agg_utilization_summary", cost.utilization_monthly(classified, rates))
        self.save("agg_utilization_by_payer", cost.utilization_by_payer(classified, patient_payers))
        self.save("agg_cost_by_category", cost.cost_by_category(claims))
        self.save("agg_high_cost_claimants", cost.high_cost_claimants(claims, conditions))
        rate_row = utilization.select("pmpm").limit(1)
        self.save("agg_condition_pmpm", cost.condition_pmpm(claims, conditions, rate_row))
        return gates.row_gate({n: df for n, df in self.written.items() if n != "patient_payer"}, OPTIONAL)


def check(gate: DataFrame) -> None:
    """Raises when a required table is empty. One row per table reaches the driver."""
    failed = [r["table_name"] for r in gate.where(~F.col("passed")).collect()]
    if failed:
        raise RuntimeError(f"empty required tables: {', '.join(sorted(failed))}")
