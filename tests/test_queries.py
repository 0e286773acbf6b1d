"""A spread of registered queries against their SQL at the smallest scale.

``python tests/check.py`` compares every query at sf0.01.
"""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.check import compare, duck

SF = "/root/testdata/sf0.001"
NAMES = (
    "tick_bars",
    "asset_frame",
    "raw_feature_bundle",
    "funding_feature",
    "dollar_neutral_weights",
    "portfolio_metrics",
    "contamination_flags",
    "align_with_staleness",
    "cross_sectional_ic",
    "block_bootstrap_ci",
    "panel_folds",
    "continuous_curve",
    "coverage_grid",
    "hysteresis_labels",
    "volume_breakouts",
    "streaming_bars",
    "panel_backtest",
)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    res, _, _ = compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name])
    assert res.startswith("ok"), res


def test_contract():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 250
    assert all(sql.strip() for sql in o.values())
