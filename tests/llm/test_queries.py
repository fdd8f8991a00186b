"""Registered queries on the given tables, and the pipeline stage by stage."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from carespark.llm.queries import ORACLE, QUERIES
from gate.check import compare


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(name, spark, con, folder):
    good, note = compare(spark, con, name, QUERIES[name], ORACLE[name], folder)
    assert good, note


@pytest.fixture(scope="module")
def labels(con):
    return {i: (q, t) for i, q, t in con.execute("select doc_id, quality, toxic from labels").fetchall()}


@pytest.mark.parametrize(("name", "column", "least"), [("op7_quality", 0, 0.97), ("op10_toxicity", 1, 0.93)])
def test_held_out_accuracy(name, column, least, spark, folder, labels):
    rows = QUERIES[name](spark, folder).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    right = [r["predicted"] == labels[r["doc_id"]][column] for r in rows if r["doc_id"] in labels and r["held_out"]]
    assert np.mean(right) >= least
    clean = [r["predicted"] for r in rows if labels.get(r["doc_id"], (0, 1)) == (1, 0)]
    assert np.mean(np.array(clean) == (1 if column == 0 else 0)) >= 0.98


def test_language_accuracy(spark, con, folder):
    known = dict(con.execute("select doc_id, lang from documents").fetchall())
    rows = [r for r in QUERIES["op3_langid"](spark, folder).collect() if r["held_out"]]
    assert rows and np.mean([r["lang_pred"] == known[r["doc_id"]] for r in rows]) >= 0.99


def test_only_row_functions_on_the_url_path(spark, folder):
    text = QUERIES["op5_url_rules"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert not any(p in text for p in ("Python", "Pandas", "Arrow", "CartesianProduct"))


def test_pipeline_stages(spark, folder, tmp_path, labels):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "mixing", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, ids = docs.columns, [set(r[0] for r in docs.select("doc_id").collect())]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert name == "packing" or docs.columns == names
        ids.append(set(r[0] for r in docs.select("doc_id").collect()))
    assert all(b <= a for a, b in zip(ids, ids[1:]))
    good = {i for i, (q, t) in labels.items() if q == 1 and t == 0}
    assert len(good & ids[2]) >= 0.98 * len(good)
    assert docs.agg(F.sum("length")).first()[0] > 0
