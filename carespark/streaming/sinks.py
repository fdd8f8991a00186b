"""Micro-batch sinks that can be repeated safely after a failure."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from ..operators.outreach import upsert_latest
from ..sources.events import ingest_json, split_bad_rows


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Append as `batch_id=N`; repeating a batch replaces its own folder."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def ingest_sink(fields: str, good_path: str, bad_path: str, column: str = "value"):
    """foreachBatch: typed rows to one table, unreadable rows to a side table."""

    def run(batch: DataFrame, batch_id: int) -> None:
        parsed = ingest_json(batch, fields, column).persist()  # two outputs, read and parsed once
        good, bad = split_bad_rows(parsed)
        write_batch(good, good_path, batch_id)
        write_batch(bad, bad_path, batch_id)
        parsed.unpersist()

    return run


def snapshot_sink(score, append_path: str | None = None, replace_path: str | None = None):
    """foreachBatch: apply `score` and append its rows, or replace the snapshot."""

    def run(batch: DataFrame, batch_id: int) -> None:
        rows = score(batch)
        if append_path:
            write_batch(rows, append_path, batch_id)
            rows = batch.sparkSession.read.parquet(f"{append_path}/batch_id={batch_id}")  # scored once
        if replace_path:
            rows.write.mode("overwrite").parquet(replace_path)

    return run


def running_scores_sink(
    partial, merge, path: str, *, score=None, append_path: str | None = None, snapshot=None, replace_path: str | None = None,
    fold_every: int = 32,
):
    """foreachBatch: scores from aggregates over all batches so far, not of one batch alone.

    `partial(batch)` gives mergeable rows per key (counts, sums, sums of
    squares, extremes), which are kept per batch; `merge(rows)` adds them up.
    `score(batch, merged)` rows are appended, `snapshot(merged)` replaces the
    snapshot. A repeated batch replaces its own partial rows and scores. Every
    `fold_every` batches the rows so far are folded into one base, so a batch
    reads the newest base before it and the few batches since.
    """

    def merged_until(spark: SparkSession, batch_id: int) -> DataFrame:
        rows = spark.read.parquet(f"{path}/partial").where(F.col("batch_id") <= batch_id)
        try:
            base = spark.read.parquet(f"{path}/base").where(F.col("upto") < batch_id)
        except AnalysisException:
            return merge(rows.drop("batch_id"))
        newest = base.agg(F.max("upto")).first()[0]
        if newest is None:
            return merge(rows.drop("batch_id"))
        since = rows.where(F.col("batch_id") > newest).drop("batch_id")
        return merge(since.unionByName(base.where(F.col("upto") == newest).drop("upto")))

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # aggregated and scored
        write_batch(partial(batch), f"{path}/partial", batch_id)
        merged = merged_until(batch.sparkSession, batch_id)
        if (batch_id + 1) % fold_every == 0:
            merged.write.mode("overwrite").parquet(f"{path}/base/upto={batch_id}")
        if append_path:
            write_batch(score(batch, merged), append_path, batch_id)
        if replace_path:
            snapshot(merged).write.mode("overwrite").parquet(replace_path)
        batch.unpersist()

    return run


def late_row_sink(path: str, ts: str, delay: timedelta, late_path: str | None = None, good_path: str | None = None):
    """foreachBatch: split rows behind the watermark from the others, and count both.

    The watermark of a batch is that of a streaming operator: the highest time
    of all earlier batches less the delay. One counting row per batch is kept
    at `path`; the highest time is read back from it, so a restart goes on where
    it stopped. Late rows go to `late_path`, the others to `good_path`.
    """

    def highest(spark: SparkSession, batch_id: int):
        try:
            seen = spark.read.parquet(path).where(F.col("batch_id") < batch_id)
        except AnalysisException:
            return None
        return seen.agg(F.max("max_ts")).first()[0]

    def run(batch: DataFrame, batch_id: int) -> None:
        top = highest(batch.sparkSession, batch_id)
        t = F.col(ts).cast("timestamp")
        late = F.lit(False) if top is None else F.coalesce(t < F.lit(top - delay), F.lit(False))
        batch.persist()  # counted and split
        if late_path:
            write_batch(batch.where(late), late_path, batch_id)
        if good_path:
            write_batch(batch.where(~late), good_path, batch_id)
        row = batch.agg(
            F.count("*").alias("rows"), F.count(F.when(late, 1)).alias("late_rows"),
            F.greatest(F.max(t), F.lit(top)).alias("max_ts"),
        )
        write_batch(row, path, batch_id)
        batch.unpersist()

    return run


def upsert_sink(path: str, keys: list[str], updated: str = "last_updated", *, buckets: int, label: str = "live"):
    """foreachBatch: the newest row per key, in a table partitioned by key bucket.

    Only the buckets that a batch touches are read (partition pruning), merged
    and written: first as a staged table, then into the table by dynamic
    partition overwrite. The staged rows of the last two batches stay, so a
    batch that failed half-way through the overwrite is overwritten again from
    them when it is repeated; one that failed before is merged again. Merging
    keeps the newest row, so a replay from the start changes nothing: give it a
    `label` of its own, as its batches count from 0. `buckets` should grow with
    the table, to a few files' worth of rows each.
    """

    def merge(batch: DataFrame, batch_id: int = 0) -> None:
        spark = batch.sparkSession
        staged = f"{path}_staged/{label}/{batch_id % 2}"
        if not _staged(spark, staged, batch_id):
            own = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
            touched = [r["bucket"] for r in own.select("bucket").distinct().collect()]  # at most `buckets` numbers
            if not touched:
                return
            try:
                current = spark.read.parquet(path).where(F.col("bucket").isin(touched)).select(*own.columns)
            except AnalysisException:
                current = own.limit(0)
            merged = upsert_latest(current, own, [*keys, "bucket"], updated).withColumn("staged_batch", F.lit(batch_id))
            merged.repartition("bucket").write.mode("overwrite").parquet(staged)
        rows = spark.read.parquet(staged).drop("staged_batch")
        swap = rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        swap.partitionBy("bucket").parquet(path)

    return merge


def _staged(spark: SparkSession, staged: str, batch_id: int) -> bool:
    """Whether the batch was staged whole: an unfinished write leaves no table."""
    try:
        return not spark.read.parquet(staged).where(F.col("staged_batch") == batch_id).isEmpty()
    except AnalysisException:
        return False


def read_upserted(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def replay_from_new_checkpoint(start, checkpoint: str, label: str):
    """Reprocess a source under a fresh checkpoint; the old one stays untouched.

    `start(checkpoint_folder)` starts the query. Sinks must be idempotent, as
    `upsert_sink` is. Returns the folder and the finished query.
    """
    folder = f"{checkpoint.rstrip('/')}_replay_{label}"
    query = start(folder)
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return folder, query
