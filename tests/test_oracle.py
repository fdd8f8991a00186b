"""Every registered query against its SQL twin on the smallest tables."""

import pytest

from gate.catalog import ORACLE, QUERIES
from gate.check import compare


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, con, folder):
    good, note = compare(spark, con, name, QUERIES[name], ORACLE.get(name), folder)
    assert good, note


def test_only_model_fits_lack_sql():
    assert set(QUERIES) - set(ORACLE) == {"readmission_model_scores", "readmission_model_performance"}
