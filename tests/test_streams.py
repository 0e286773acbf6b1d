"""Labels of a stream that comes late and out of order, against a loop over sorted rows."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from tickloom.operators.regime import three_bands
from tickloom.streaming import streams

BANDS = three_bands("bear", "sideways", "bull", -0.25, 0.3)
START = dt.datetime(2020, 1, 1)


def plain(rows, margin, dwell):
    """Labels of (time, score) rows in order of time."""
    out, current, pending, count = {}, None, None, 0
    for t, v in sorted(rows):
        if v is None:
            out[t] = None
            continue
        now = next(b for b in BANDS if (b.lower is None or v >= b.lower) and (b.upper is None or v < b.upper))
        if current is None:
            current = now
        elif now is current or (current.lower is None or v >= current.lower - margin) and (current.upper is None or v < current.upper + margin):
            pending, count = None, 0
        else:
            count = count + 1 if now is pending else 1
            pending = now
            if count >= dwell:
                current, pending, count = now, None, 0
        out[t] = current.label
    return out


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    """80 rows of two series in eight files, shuffled within four hours, two far too late."""
    r = random.Random(1)
    path = str(tmp_path_factory.mktemp("scores"))
    rows = [(k, START + dt.timedelta(hours=i), r.uniform(-1, 1) if r.random() < 0.9 else None) for k in "ab" for i in range(40)]
    came = sorted(rows, key=lambda x: x[1] + dt.timedelta(hours=r.uniform(0, 4)))
    lost = [x for x in came if x[1] == START + dt.timedelta(hours=3)]
    came = [x for x in came if x not in lost] + lost  # after everything else
    for n in range(8):
        part = spark.createDataFrame(came[n * 10 : n * 10 + 10], "symbol string, datetime timestamp, score double")
        part.coalesce(1).write.mode("append").parquet(path)
    s = spark.readStream.schema("symbol string, datetime timestamp, score double").option("maxFilesPerTrigger", 1).parquet(path)
    got = streams.drain(streams.stream_labels(s, BANDS, 0.1, 3, late="5 hours", span_hours=7)).collect()
    return rows, lost, got


def test_labels_in_order_of_time_whatever_the_arrival(labelled):
    rows, lost, got = labelled
    mark = START + dt.timedelta(hours=39 - 5)
    for k in "ab":
        mine = {r["datetime"]: r["label"] for r in got if r["symbol"] == k}
        want = plain([x[1:] for x in rows if x[0] == k and x not in lost], 0.1, 3)
        done = {t: v for t, v in want.items() if t <= max(mine)}
        assert mine == done and mark - dt.timedelta(hours=7) < max(mine) <= mark


def test_late_rows_are_dropped_and_the_rest_waits(labelled):
    rows, lost, got = labelled
    assert len(lost) == 2 and not {(x[0], x[1]) for x in lost} & {(r["symbol"], r["datetime"]) for r in got}
    assert max(r["datetime"] for r in got) <= START + dt.timedelta(hours=34)
    assert len(got) == len({(r["symbol"], r["datetime"]) for r in got})
