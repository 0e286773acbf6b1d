from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from tickloom.llm import mixing

def test_quotas():
    assert mixing.quotas([100, 100, 100], [5, 2, 1], 300, 3) == [187.5, 75, 37.5]
    q = mixing.quotas([10, 500, 490], [5, 2, 1], 1000, 3)
    assert q[0] == 30 and sum(q) == pytest.approx(1000) and q[1] == pytest.approx(2 * q[2])
    assert mixing.quotas([], [], 0, 3) == [] and mixing.quotas([0, 0], [1, 1], 0, 3) == [0, 0]


@pytest.mark.parametrize("seed", range(12))
def test_flow_against_enumeration(seed):
    import random

    r = random.Random(seed)
    cap = [r.randint(1, 3) for _ in range(3)]
    members = [sorted(r.sample(range(2), r.randint(1, 2))) for _ in cap]
    quota = [r.randint(1, 6) for _ in range(2)]
    flows = mixing.min_cost_flow(cap, members, quota)

    def cost(parts):  # words beyond a first use cost 1, beyond a second 3
        return sum(max(0, min(t, 2 * c) - c) + 3 * max(0, t - 2 * c) for t, c in zip(parts, cap, strict=True))

    routes = [(i, j) for i, m in enumerate(members) for j in m]
    best = None
    for amount in itertools.product(*[range(min(3 * cap[i], quota[j]) + 1) for i, j in routes]):
        per = [sum(a for a, (i, _) in zip(amount, routes, strict=True) if i == k) for k in range(3)]
        into = [sum(a for a, (_, j) in zip(amount, routes, strict=True) if j == k) for k in range(2)]
        if all(p <= 3 * c for p, c in zip(per, cap, strict=True)) and all(x <= q for x, q in zip(into, quota, strict=True)):
            best = max(best or (-1, 0), (sum(amount), -cost(per)))
    per = [sum(f.values()) for f in flows]
    assert (sum(per), -cost(per)) == best
    assert all(set(f) <= set(m) for f, m in zip(flows, members, strict=True))


def test_table_near_targets_and_repeatable(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken")
    rows = sorted(out.collect())
    assert rows == sorted(mixing.mix(docs.repartition(5)).select(*out.columns).collect())
    assert len(rows) == docs.count()
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        assert r.size == len(text[r.doc_id].encode().split())
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    by = {}
    for r in rows:
        by.setdefault((r.source, r.target, r.source_size), []).append(r)
    assert sum(k[1] for k in by) == pytest.approx(sum(r.size for r in rows))
    for (_, target, size), rs in by.items():
        assert size == sum(r.size for r in rs)
        assert abs(sum(r.taken for r in rs) - target) <= 0.03 * target


def test_overlapping_sources(spark):
    rows = [(i, "w " * 10, s) for i, s in enumerate([["a"], ["a", "b"], ["b"], ["c", "a"], ["a", "b"]] * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, m array<string>")
    out = mixing.mix(df, members=F.col("m"), weights=(1, 1, 1)).collect()
    assert sum(r.taken for r in out) == pytest.approx(1000, abs=30)
    alone = sum(r.taken for r in out if r.m == ["c", "a"])
    assert alone == pytest.approx(1000 / 3, abs=20)  # the only way to fill c is to repeat its pattern


@pytest.mark.parametrize(("long", "after"), [(19_000, 0), (15_000, 0), (40_000, 25), (7_000, 49)])
def test_long_document_bars_no_later_ones(spark, long, after):
    """Target 10000 of a source with 200 documents of 200 words and a long one at a given place of the order."""
    text = "w " * long
    rows = [(i, "w " * 200, "a") for i in range(200)]
    h = F.xxhash64(F.lit(17), F.col("doc_id"), F.xxhash64("text"))
    small = sorted(r.h for r in spark.createDataFrame(rows, "doc_id long, text string, s string").select(h.alias("h")).collect())
    at = spark.range(1000, 40_000).select(F.col("id").alias("doc_id"), F.lit(text).alias("text")).select("doc_id", h.alias("h"))
    low = small[after - 1] if after else -(2**63)
    rows.append((at.where((F.col("h") > low) & (F.col("h") < small[after])).first().doc_id, text, "a"))
    rows += [(100_000 + i, "w " * 100, "b") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    total = 80_000 + long
    out = mixing.mix(df, weights=(10_000, total - 10_000)).where("source = 'a'").collect()
    assert out[0].target == pytest.approx(10_000)
    assert sum(r.taken for r in out) == 10_000


def test_gap_is_below_every_unused_document(spark):
    import random

    r = random.Random(4)
    rows = [(i, "w " * int(2 ** r.uniform(0, 13)), "a" if i % 3 else "b") for i in range(600)]
    rows += [(7, rows[7][1], "a")] * 2  # equal rows are one unit
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 2)).collect()
    for s in "ab":
        rs = [x for x in out if x.source == s]
        gap = rs[0].target - sum(x.taken for x in rs)
        least = min(x.size for x in rs if x.taken == min(y.taken for y in rs))
        assert abs(gap) <= max(1, least)
    assert len({x.taken for x in out if x.doc_id == 7}) == 1


def test_odd_rows(odd, none, odd_rows):
    out = mixing.mix(odd).collect()
    assert len(out) == len(odd_rows)
    assert all(r.taken == 0 for r in out if r.size == 0)
    assert len({r.taken for r in out if r.doc_id == 1}) == 1  # equal rows alike
    assert mixing.mix(none).count() == 0
    again = mixing.mixed(odd)
    assert again.columns == odd.columns
    assert again.count() == sum(r.taken // r.size for r in out if r.size)
