"""Every query against its SQL, and the driver contract."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from __spark_entry__ import entry  # noqa: E402

from shoalwise.plans.checks import ORACLES  # noqa: E402
from shoalwise.plans.queries import QUERIES  # noqa: E402
from tools.compare import differences, sql_frame  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
ROWS_ONLY = {"poisson_gam", "gam_summary", "gam_residuals", "gam_smoothing", "gam_smooth_tests", "smooth_bands", "station_month_ols"}


def test_every_query_has_sql_or_is_listed():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    out = entry(spark)
    assert out.columns == ["date", "richness"]
    assert out.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    assert len(got) > 0
    if name in ORACLES:
        assert differences(got, sql_frame(FOLDER, ORACLES[name])) == ""
