"""Training-data pipeline: toxic and bad documents go, near copies go, sources are mixed, the rest is packed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from carespark.functions.lineage import checkpoint_folder
from carespark.llm import mixing, packing, quality, simhash, toxicity
from carespark.llm.common import read_table
from carespark.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that score below 0.5 for toxicity."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, read_table(spark, folder, "labels")), 0.5)


def drop_bad(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose lines are good with a mean probability of 0.3 or more."""
    return quality.keep_good(docs, quality.fit(docs, read_table(spark, folder, "labels")), 0.3)


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of SimHash links."""
    return simhash.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents repeated by their copies in the mix."""
    return mixing.take(docs, mixing.mix(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of token sequences, ids included."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_bad),
    ("near_duplicates", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Trained models and bit fingerprints have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """Apply all stages to `documents`; each reads the Parquet table that the one before wrote."""
    docs = read_table(spark, folder, "documents")
    base = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, folder).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
