"""The configurations of the regime labels, on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tickloom.operators import regime

SF = "/root/testdata/sf0.001"


def test_weights_and_bands():
    for dims in regime.CONFIGURATIONS.values():
        for d in dims:
            assert sum(i.weight for i in d.indicators) == pytest.approx(1)
            assert d.bands[0].lower is None and d.bands[-1].upper is None
            assert all(a.upper == b.lower for a, b in zip(d.bands, d.bands[1:], strict=False))


@pytest.mark.parametrize(
    ("name", "dims"),
    [
        ("regime_detection_curve", {"term_structure", "carry"}),
        ("regime_detection_macro", {"risk", "yield_curve", "credit"}),
        ("regime_detection_equity", {"trend", "volatility", "mean_reversion"}),
    ],
)
def test_dimensions(spark, name, dims):
    """Every dimension whose inputs are there, labels of its bands, scores in [-1, 1]."""
    rows = entry.queries()[name](spark, SF).collect()
    assert {r.dimension for r in rows} == dims
    names = {d.key: {b.label for b in d.bands} for c in regime.CONFIGURATIONS.values() for d in c}
    for r in rows:
        assert r.score is None or -1.000001 <= r.score <= 1.000001
        assert r.label is None or r.label in names[r.dimension]


def test_shift(spark):
    """A shift moves each series' rows, and nothing else."""
    from tickloom.functions.ordered import Ordered

    day = Ordered(("symbol",), ("date",), step=1)
    df = spark.range(60).selectExpr("'a' as symbol", "date_add(date'2000-01-01', cast(id as int)) as date", "sin(id / 5.0) as macro_yield_curve", "cos(id / 7.0) as macro_yield_curve_3m10y")
    plain = [(r.score, r.label) for r in regime.detect(df, day, regime.MACRO).orderBy("date").collect()]
    moved = [(r.score, r.label) for r in regime.detect(df, day, regime.MACRO, shift=2).orderBy("date").collect()]
    assert moved == [(None, None)] * 2 + plain[:-2] and any(label for _, label in plain)
