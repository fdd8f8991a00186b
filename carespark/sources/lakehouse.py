"""Named tables by layer, stored as parquet folders under one root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from ..functions.timing import as_column, back

#: Ids and JSON texts, most of what tables hold, take less space than in the default codec.
COMPRESSION = "zstd"


class SchemaConflict(ValueError):
    pass


def additive(df: DataFrame, current: StructType) -> DataFrame:
    """`df` with every current column: missing ones as typed nulls, no type change."""
    have = {f.name: f.dataType for f in df.schema}
    for f in current:
        if f.name in have and have[f.name] != f.dataType:
            raise SchemaConflict(f"{f.name}: {f.dataType.simpleString()} -> {have[f.name].simpleString()}")
    for f in current:
        if f.name not in have:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    return df


class Lakehouse:
    def __init__(self, spark: SparkSession, root: str, format: str = "parquet"):
        self.spark, self.root, self.format = spark, root.rstrip("/"), format

    def path(self, layer: str, table: str) -> str:
        return f"{self.root}/{layer}/{table}"

    def _read(self, layer: str, table: str) -> DataFrame:
        return self.spark.read.format(self.format).load(self.path(layer, table))

    def read_silver(self, table: str) -> DataFrame:
        return self._read("silver", table)

    def read_gold(self, table: str) -> DataFrame:
        return self._read("gold", table)

    def exists(self, table: str, layer: str = "gold") -> bool:
        try:
            self._read(layer, table)
            return True
        except AnalysisException:
            return False

    def write_gold(
        self, df: DataFrame, table: str, schema_mode: str = "merge", partition_by: list[str] | None = None
    ) -> DataFrame:
        """Overwrite a table and return a frame that reads the written copy.

        `merge` keeps existing columns and refuses type changes; `replace` takes
        the new schema. A table must not be overwritten from itself.
        """
        if schema_mode not in ("merge", "replace"):
            raise ValueError(f"unknown schema mode {schema_mode!r}")
        if schema_mode == "merge" and self.exists(table):
            df = additive(df, self.read_gold(table).schema)
        writer = df.write.format(self.format).option("compression", COMPRESSION).mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).save(self.path("gold", table))
        return self.read_gold(table)

    def ensure_gold_tables(self, schemas: dict[str, str]) -> list[str]:
        """Empty typed placeholders for absent tables; returns their names."""
        created = []
        for table, ddl in schemas.items():
            if not self.exists(table):
                self.spark.createDataFrame([], ddl).write.format(self.format).mode("overwrite").save(self.path("gold", table))
                created.append(table)
        return created

    def snapshot_append(self, df: DataFrame, table: str) -> None:
        df.write.format(self.format).mode("append").save(self.path("gold", table))

    def snapshot_replace(self, df: DataFrame, table: str) -> None:
        df.write.format(self.format).mode("overwrite").save(self.path("gold", table))


def mirror_write(df: DataFrame, targets: list[str], format: str = "parquet") -> None:
    """Write one projection to several folders.

    The first copy is computed; the others are read from it, so the projection
    runs once and no cache has to hold it.
    """
    first, *others = targets
    df.write.format(format).mode("overwrite").save(first)
    written = df.sparkSession.read.format(format).load(first)
    for target in others:
        written.write.format(format).mode("overwrite").save(target)


def retention(df: DataFrame, as_of, ts: str = "alert_time", days: int = 90) -> DataFrame:
    """Rows still inside the retention period."""
    return df.where(F.col(ts) > back(as_of, days=days))


def rewrite_retained(table: str, target: str, spark: SparkSession, as_of, ts: str = "alert_time", days: int = 90) -> DataFrame:
    """Copy of a day-partitioned folder without expired rows, and a frame that reads it.

    Expired days are not read; only the rows of the oldest kept day are compared by time.
    """
    kept = day_window(spark.read.parquet(table), ts, as_column(as_of), days)
    kept.write.mode("overwrite").partitionBy("day").parquet(target)
    return spark.read.schema(kept.schema).parquet(target)


def with_day(df: DataFrame, ts: str, out: str = "day") -> DataFrame:
    """Adds the partition column used for date pruning."""
    return df.withColumn(out, F.to_date(ts))


def day_window(df: DataFrame, ts: str, as_of: Column, days: int, partition: str = "day") -> DataFrame:
    """Look-back that also prunes date partitions: the day bound is implied by the time bound."""
    since = back(as_of, days=days)
    return df.where((F.col(partition) >= F.to_date(since)) & (F.col(ts) > since))
