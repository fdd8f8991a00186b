"""Member months, utilisation and cost reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.lineage import cut_lineage
from ..functions.ranking import rank_values
from ..functions.text import cascade
from ..refdata import clinical as ref
from .gold import with_payer


def member_months(coverage: DataFrame, as_of: Column) -> DataFrame:
    """Rounded months of each coverage, at least one; open coverage ends at `as_of`."""
    end = F.coalesce("coverage_end", as_of)
    months = F.round(F.months_between(end, "coverage_start"), 0).cast("int")
    return coverage.select(
        "coverage_id", "patient_id", "coverage_start", end.alias("coverage_end"),
        F.greatest(months, F.lit(1)).alias("member_months"),
    )


def classify_encounters(encounters: DataFrame) -> DataFrame:
    kind = F.lower("encounter_class")
    day = F.to_date("admit_date")
    return encounters.select(
        "encounter_id",
        "patient_id",
        "encounter_class",
        day.alias("admit_date"),
        F.to_date("discharge_date").alias("discharge_date"),
        F.greatest(F.datediff("discharge_date", "admit_date"), F.lit(0)).alias("los_days"),
        cascade(
            [
                (kind.isin("inpatient", "imp"), "Inpatient"),
                (kind == "emergency", "Emergency"),
                (kind.isin("outpatient", "ambulatory", "amb"), "Outpatient"),
            ],
            "Other",
        ).alias("service_category"),
        F.date_format(day, "yyyy-MM").alias("service_month"),
    )


def _use_columns(members: str, bed_days: str) -> list[Column]:
    kind, stay = F.col("service_category"), F.col("los_days")
    one = lambda k: F.count(F.when(kind == k, 1))
    inpatient = F.when(kind == "Inpatient", stay)
    return [
        F.count_distinct("patient_id").alias(members),
        one("Inpatient").alias("inpatient_admits"),
        one("Emergency").alias("ed_visits"),
        one("Outpatient").alias("outpatient_visits"),
        F.coalesce(F.sum(inpatient), F.lit(0)).alias(bed_days),
        F.round(F.avg(inpatient.cast("decimal(18,6)")), 1).cast("double").alias("avg_los"),
    ]


def population_rates(classified: DataFrame, claims: DataFrame, months: DataFrame) -> DataFrame:
    """One row: rates per 1,000 members and paid per member month."""
    kind = F.col("service_category")
    use = classified.agg(
        F.count(F.when(kind == "Inpatient", 1)).alias("ip"),
        F.count(F.when(kind == "Emergency", 1)).alias("ed"),
        F.coalesce(F.sum(F.when(kind == "Inpatient", F.col("los_days"))), F.lit(0)).alias("bed_days"),
    )
    paid = claims.agg(F.sum("paid_amount").alias("paid"))
    base = months.groupBy("patient_id").agg(F.sum("member_months").alias("m")).agg(
        F.sum("m").alias("months"), F.count("*").alias("members")
    )
    at_least_one = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(1)), F.lit(1))
    per_1k = lambda c: F.round(F.col(c) * F.lit(1000.0) / at_least_one("members"), 1)
    return use.crossJoin(paid).crossJoin(base).select(
        F.round(F.coalesce(F.col("paid"), F.lit(0)) / at_least_one("months"), 2).cast("double").alias("pmpm"),
        per_1k("ip").alias("ip_per_1k"),
        per_1k("ed").alias("ed_per_1k"),
        per_1k("bed_days").alias("bed_days_per_1k"),
    )


def utilization_monthly(classified: DataFrame, rates: DataFrame) -> DataFrame:
    marks = ref.UTILISATION_BENCHMARKS
    return (
        classified.groupBy("service_month")
        .agg(*_use_columns("unique_members", "bed_days"))
        .crossJoin(F.broadcast(rates))
        .withColumns({f"benchmark_{k}": F.lit(marks[k]) for k in ("pmpm", "ip_per_1k", "ed_per_1k", "alos")})
    )


def utilization_by_payer(classified: DataFrame, patient_payers: DataFrame) -> DataFrame:
    return with_payer(classified, patient_payers).groupBy("payer_category").agg(
        *_use_columns("member_count", "total_bed_days")
    )


def service_category(claim_type: Column) -> Column:
    text = F.lower(claim_type)
    return cascade(
        [
            (text.rlike("inpatient|institutional"), "Inpatient"),
            (text.rlike("emergency"), "Emergency"),
            (text.rlike("outpatient|ambulatory"), "Outpatient"),
            (text.rlike("pharmacy|rx"), "Pharmacy"),
            (text.rlike("professional|physician"), "Professional"),
        ],
        "Other",
    )


def cost_by_category(claims: DataFrame) -> DataFrame:
    return claims.groupBy(
        service_category(F.col("claim_type")).alias("service_category"), "payer_category"
    ).agg(
        F.count("*").alias("claim_count"),
        F.sum("billed_amount").cast("double").alias("total_billed"),
        F.sum("paid_amount").cast("double").alias("total_paid"),
        F.round(F.avg("billed_amount"), 2).cast("double").alias("avg_claim_amount"),
        F.sum("denial_flag").alias("denied_claims"),
    )


def patient_costs(claims: DataFrame) -> DataFrame:
    return claims.groupBy("patient_id", "payer_category").agg(
        F.sum("paid_amount").alias("total_paid"),
        F.sum("billed_amount").alias("total_billed"),
        F.count("*").alias("claim_count"),
        F.sum("denial_flag").alias("denied_claims"),
    )


def high_cost_claimants(
    claims: DataFrame, conditions: DataFrame, share: float = 0.95
) -> DataFrame:
    """Patients at or above the paid percentile, with percent rank and conditions.

    Per-patient totals feed the threshold, the ranks and the result, so they are
    written once. The threshold comes from the exact ranks, which count equal
    totals once and run per value bucket: there is no single-task window.
    """
    costs = cut_lineage(patient_costs(claims))
    ranks = rank_values(costs, "total_paid")
    n = costs.agg(F.count("*")).scalar()
    keep = F.col("rank") <= n - F.ceil(n * F.lit(share)) + 1
    top_values = cut_lineage(ranks.where(keep))
    bounds = top_values.agg(F.sum("n").alias("_size"), F.min("total_paid").alias("_floor"))
    top = costs.join(top_values.select("total_paid", "rank"), "total_paid")
    listed = (
        conditions.join(top.select("patient_id").distinct(), "patient_id", "left_semi")
        .groupBy("patient_id")
        .agg(F.array_join(F.array_sort(F.collect_set("display")), ", ").alias("conditions_list"))
    )
    return (
        top.crossJoin(F.broadcast(bounds))
        .withColumn(
            "percentile_rank",
            F.when(F.col("_size") > 1, (F.col("rank") - 1) / (F.col("_size") - 1)).otherwise(0.0),
        )
        .withColumn("is_stop_loss", F.col("total_paid") >= F.col("_floor") * 2)
        .join(listed, "patient_id", "left")
        .select(
            "patient_id", "payer_category",
            F.col("total_paid").cast("double").alias("total_paid"),
            F.col("total_billed").cast("double").alias("total_billed"),
            "claim_count", "denied_claims", "percentile_rank", "is_stop_loss", "conditions_list",
        )
    )


def condition_pmpm(claims: DataFrame, conditions: DataFrame, rates: DataFrame) -> DataFrame:
    """Cost per condition group in one pass over both tables.

    Claims are summed per patient before the join, so a patient in several
    groups repeats one row, not all claims.
    """
    spark = claims.sparkSession
    groups = spark.createDataFrame(
        [(c, name) for name, codes in ref.CHRONIC_GROUPS.items() for c in codes],
        "code string, condition_name string",
    )
    codes = [c for cs in ref.CHRONIC_GROUPS.values() for c in cs]
    members = (
        conditions.where(F.col("code").isin(codes))
        .join(F.broadcast(groups), "code")
        .select("patient_id", "condition_name")
        .distinct()
    )
    paid = claims.groupBy("patient_id").agg(F.sum("paid_amount").alias("paid"))
    n = F.col("patient_count")
    return (
        members.join(paid, "patient_id", "left")
        .groupBy("condition_name")
        .agg(
            F.count("*").cast("int").alias("patient_count"),
            F.coalesce(F.sum("paid"), F.lit(0)).alias("total"),
        )
        .select(
            "condition_name",
            "patient_count",
            F.col("total").cast("double").alias("total_cost"),
            F.round(F.col("total") / (n * 12), 2).cast("double").alias("condition_pmpm"),
        )
        .crossJoin(F.broadcast(rates.select(F.col("pmpm").alias("overall_pmpm"))))
    )
