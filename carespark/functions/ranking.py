"""Exact global ranks without a one-task window.

Rows get a bucket that preserves order. Bucket totals (a table of at most
`buckets` rows) give each bucket its offset; the window then runs per bucket.
Equal values are counted once before any window, so a value shared by a third
of all rows is a single row there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .lineage import cut_lineage


def _offsets(buckets: DataFrame, descending: bool) -> DataFrame:
    """Rows in all earlier buckets; input holds one row per bucket."""
    order = F.desc("bucket") if descending else F.asc("bucket")
    before = Window.partitionBy(F.lit(0)).orderBy(order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    return buckets.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))


def rank_values(values: DataFrame, col: str, buckets: int = 256) -> DataFrame:
    """Distinct values of `col` with `n` and `rank` (1 + rows with a larger value).

    The bounds only balance the buckets; the ranks are exact for any bounds.
    They travel as one broadcast row of at most `buckets` numbers.
    """
    at = [i / buckets for i in range(1, buckets)]
    bounds = values.agg(
        F.array_distinct(F.percentile_approx(col, at, 10 * buckets)).alias("_bounds")
    )
    counted = (
        values.groupBy(col)
        .agg(F.count("*").alias("n"))
        .crossJoin(F.broadcast(bounds))
        .withColumn("bucket", F.size(F.filter("_bounds", lambda b: b < F.col(col))))
        .drop("_bounds")
    )
    totals = counted.groupBy("bucket").agg(F.sum("n").alias("n"))
    within = Window.partitionBy("bucket").orderBy(F.desc(col)).rowsBetween(Window.unboundedPreceding, -1)
    return (
        counted.withColumn("above", F.coalesce(F.sum("n").over(within), F.lit(0)))
        .join(_offsets(totals, descending=True), "bucket")
        .select(col, "n", (F.col("offset") + F.col("above") + 1).alias("rank"))
    )


def sorted_index(df: DataFrame, key: str, out: str = "index", partitions: int | None = None) -> DataFrame:
    """Exact zero-based index in key order, without a global window.

    Rows are range-partitioned, sorted inside each partition and written once;
    an index is then the rows of earlier partitions plus the position inside
    its own. Reading a written copy keeps partitions and positions stable when
    an executor is lost.
    """
    ranged = df.repartitionByRange(partitions, key) if partitions else df.repartitionByRange(key)
    placed = (
        cut_lineage(ranged.sortWithinPartitions(key))
        .withColumn("bucket", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    totals = placed.groupBy("bucket").agg(F.count("*").alias("n"))
    return (
        placed.join(F.broadcast(_offsets(totals, descending=False)), "bucket")
        .withColumn(out, F.col("offset") + F.col("_at"))
        .drop("bucket", "_at", "offset")
    )


def index_within(df: DataFrame, group: str, position: str, out: str, width: int = 10000) -> DataFrame:
    """Zero-based index by an integer position inside each group.

    Windows see at most `width` positions of a group at a time, so a group that
    holds a third of all rows is still split.
    """
    tagged = df.withColumn("_b", F.floor(F.col(position) / width))
    totals = tagged.groupBy(group, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(group, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    within = Window.partitionBy(group, "_b").orderBy(position)
    return (
        tagged.withColumn("_r", F.row_number().over(within) - 1)
        .join(offsets, [group, "_b"])
        .withColumn(out, F.col("_o") + F.col("_r"))
        .drop("_b", "_r", "_o")
    )
