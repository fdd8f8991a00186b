"""Bundle files on storage: read, checked against a manifest, loaded as they come."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from ..operators.bundles import is_bundle_file
from ..operators.gates import manifest_findings

#: Parquet row groups of whole file texts. A reader decodes up to 4096 rows of a row group at once, so what a task
#: holds grows with the rows of a group and the length of a text, not with the number of files.
WIDE_ROWS = {"parquet.block.row.count.limit": "32"}


def _files(spark: SparkSession, folder: str, by_folder: bool) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    segments = F.split("path", "/")
    # a bundle that Spark wrote lies in a folder `name=...` of its own
    name = F.regexp_replace(F.element_at(segments, -2), "^name=", "") if by_folder else F.element_at(segments, -1)
    return files.withColumn("name", name).where(is_bundle_file(F.col("name")))


def read_bundle_files(spark: SparkSession, folder: str, by_folder: bool = False) -> DataFrame:
    """`(name, content)` of patient bundles under a folder."""
    return _files(spark, folder, by_folder).select("name", "content")


def bundle_source(
    spark: SparkSession, folder: str, manifest: DataFrame | None = None, by_folder: bool = False
) -> tuple[DataFrame, DataFrame | None]:
    """Bundle rows `(bundle_id, content)` and the findings against the manifest.

    The caller decides what a finding means; every finding is fatal for a load.
    """
    files = read_bundle_files(spark, folder, by_folder)
    rows = files.select(F.col("name").alias("bundle_id"), F.col("content").cast("string").alias("content"))
    return rows, None if manifest is None else manifest_findings(files, manifest)


def load_changed_files(
    spark: SparkSession, folder: str, table: str, run_id: int, slack: timedelta | None = timedelta(hours=1), by_folder: bool = False
) -> None:
    """Append the files that are new, or whose content has changed, to `table` as `batch_id=run_id`.

    The table is its own ledger: (name, sha256, modified, status, content), of
    which only the short columns are read here. Files older than the newest
    known one less `slack` are not opened, as the time bound reaches the
    source; `slack` None opens all, for files that keep an old time when copied.
    A repeated run replaces its own rows. Contents are read and hashed once,
    and written in small row groups, as a content is a whole file.
    """
    files = _files(spark, folder, by_folder).select("name", "content", F.col("modificationTime").alias("modified"))
    try:
        seen = spark.read.parquet(table).where(F.col("batch_id") < run_id)
        since = seen.agg(F.max("modified")).first()[0]
    except AnalysisException:
        seen = since = None
    if since is not None and slack is not None:
        files = files.where(F.col("modified") >= F.lit(since - slack))
    hashed = files.withColumn("sha256", F.sha2("content", 256))
    if seen is None:
        fresh = hashed.withColumn("status", F.lit("added"))
    else:
        newest = seen.groupBy("name").agg(F.max_by("sha256", "batch_id").alias("known"))
        status = F.when(F.col("known").isNull(), "added").when(F.col("known") != F.col("sha256"), "changed")
        fresh = hashed.join(newest, "name", "left").withColumn("status", status).where(F.col("status").isNotNull()).drop("known")
    fresh.write.mode("overwrite").options(**WIDE_ROWS).parquet(f"{table}/batch_id={run_id}")


def loaded_bundles(spark: SparkSession, table: str) -> DataFrame:
    """`(bundle_id, content)`: the newest content of each file loaded so far."""
    rows = spark.read.parquet(table)
    newest = rows.groupBy("name").agg(F.max("batch_id").alias("batch_id"))
    return rows.join(newest, ["name", "batch_id"], "left_semi").select(
        F.col("name").alias("bundle_id"), F.col("content").cast("string").alias("content")
    )
