"""Helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from carespark.functions.lineage import checkpoint_folder


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write_shared(df: DataFrame) -> DataFrame:
    """Write the rows once as Parquet into the shared checkpoint folder and read them back.

    Unlike a row checkpoint the copy keeps column pruning and statistics.
    """
    path = f"{checkpoint_folder(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def split_hash(doc_id: Column | str) -> Column:
    """crc32 of the id as text; a null id counts as empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def blocks(sizes: list[int], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive runs of items whose sizes add up to about `limit`."""
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def give_back() -> None:
    """Return what this worker no longer needs to the machine, so that reused workers do not keep the peak of each stage."""
    gc.collect()  # memories that name each other
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """Texts of an Arrow batch; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def map_texts(
    df: DataFrame,
    keep: list[str],
    fields: str,
    make: Callable[[], Callable[[list[str]], dict[str, list]]],
    text: str = "text",
) -> DataFrame:
    """`keep` columns unchanged, plus columns computed from the texts of each Arrow batch.

    `make()` runs once per task and returns the function from texts to columns,
    so models are prepared once. Ids never pass through pandas, which would
    turn nullable integers into floats. `fields` is a DDL string.
    """
    schema = T.StructType([df.schema[c] for c in keep] + list(T._parse_datatype_string(fields)))
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = to_arrow_schema(schema)
        work = make()
        for batch in batches:
            if batch.num_rows:
                new = work(texts_of(batch, text))
                kept = [batch.column(i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays(
                    kept + [pa.array(new[n], type=types.field(n).type) for n in names[len(keep):]], names=names
                )
        give_back()

    return df.select(*keep, F.col(text)).mapInArrow(run, schema)


def filter_texts(df: DataFrame, make: Callable[[], Callable[[list[str]], list[bool]]], text: str = "text") -> DataFrame:
    """Rows whose text passes; all columns unchanged, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(work(texts_of(batch, text)), type=pa.bool_()))
        give_back()

    return df.mapInArrow(run, df.schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, most: int) -> DataFrame:
    """(doc_id, text, y) of at most `most` labelled documents outside the held-out fold.

    The sample takes the smallest hashes of the id, so it does not depend on
    partitions. Several labels of one document count as their maximum. The ids
    are a broadcast of at most `most` rows.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .where(split_hash("doc_id") % folds != held)
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("int")).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
