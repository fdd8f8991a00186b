"""Very long texts, hosts and vocabularies end within seconds."""

import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from carespark.llm import licenses, quality, toxicity, url_rules
from carespark.llm.queries import QUERIES


@pytest.mark.parametrize("phrase", ["mit license ", "apache license x "])
def test_phrases_of_a_long_text(phrase):
    text = phrase * (5_000_000 // len(phrase))
    start = time.time()
    found = licenses.scan(text)
    step = len(phrase.split())
    n = len(text) // len(phrase)
    assert (found["n_base"], found["first_word"], found["last_word"]) == (n, 0, (n - 1) * step)
    assert time.time() - start < 30


def test_a_host_of_many_labels(spark):
    host = "a." * 50_000 + "example.org"
    pages = spark.createDataFrame([(1, f"http://{host}/es/x"), (2, f"http://{host}/en/2"), (3, "http://org/")], "page_id long, url string")
    rules = spark.createDataFrame([("allow", "org", "/"), ("block", "example.org", "/es/")], "verdict string, host string, path string")
    start = time.time()
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_rules.judge(pages, rules).collect()}
    assert got == {1: ("example.org/es/", "block"), 2: ("org/", "allow"), 3: ("org/", "allow")}
    assert time.time() - start < 30


def test_no_telling_token_is_dropped(spark):
    counts = spark.range(70_000).select(
        F.concat(F.lit("t"), F.col("id")).cast("binary").alias("token"), F.lit(0).alias("fold"), F.lit(30).alias("toxic"), F.lit(0).alias("clean")
    )
    clean = spark.sql("select cast('plain' as binary) as token, 0 as fold, 0 as toxic, 5000000 as clean")
    scores = toxicity.token_scores(counts.unionByName(clean))
    assert len(scores) == 70_001 and min(v for k, v in scores.items() if k != b"plain") > 1


def test_held_out_recall_and_precision(spark):
    folder = "/root/testdata/sf0.1"
    labels = dict(duckdb.sql(f"select doc_id, toxic from '{folder}/labels.parquet'").fetchall())
    rows = [(r["predicted"], labels[r["doc_id"]]) for r in QUERIES["op10_toxicity"](spark, folder).collect() if r["held_out"] and r["doc_id"] in labels]
    right = sum(p and y for p, y in rows)
    assert right >= 0.9 * sum(y for _, y in rows) and right >= 0.95 * sum(p for p, _ in rows)


def test_pieces_of_a_chain_give_the_marginals_of_the_whole():
    rnd = np.random.default_rng(8)
    counts = np.array([1, 5, 17, 64, 3, 40])
    odds, trans = rnd.normal(size=counts.sum()) * 2, rnd.normal(size=(2, 2))
    whole, _, _ = quality.forward_backward(odds, trans, counts)
    for piece in (1, 2, 7, 16, 1000):
        assert np.allclose(quality.good_marginals(odds, trans, counts, piece), whole)


def test_a_text_of_a_million_lines():
    rnd = np.random.default_rng(9)
    model = quality.QualityModel(np.zeros(15), np.ones(15), rnd.normal(size=46), rnd.normal(size=(2, 2)))
    start = time.time()
    scores = model.score(["\n".join(f"Line {i}." for i in range(1_000_000)), "one line"])
    assert len(scores) == 2 and all(0 <= s <= 1 for s in scores)
    assert time.time() - start < 60


def test_odds_of_neighbours_equal_the_wide_product():
    rnd = np.random.default_rng(10)
    counts = np.array([3, 1, 5])
    own, weights = rnd.normal(size=(9, 15)), rnd.normal(size=46)
    ends = np.cumsum(counts)
    model = quality.QualityModel(np.zeros(15), np.ones(15), weights, np.zeros((2, 2)))
    assert np.allclose(model.odds(own, counts), quality._with_neighbours(own, ends - counts, ends - 1) @ weights, atol=1e-4)


def test_runs_keep_the_sample_within_its_lines():
    assert quality.run_length([5, 1000, 3], 10_000, 400) == 400
    n = quality.run_length([500] * 100, 10_000, 400)
    assert n == 100 and quality.run_length([5] * 100, 10, 400) == 1
