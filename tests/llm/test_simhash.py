from __future__ import annotations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tickloom.llm import simhash
from tickloom.llm.common import components

from .conftest import SF


def plain(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(prints, radius=3):
    ids = list(prints)
    top = {i: i for i in range(len(ids))}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (ids[i][1] ^ ids[j][1]).bit_count() <= radius:
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    out = {}
    for i in range(len(ids)):
        out.setdefault(find(i), []).append(ids[i][0])
    return {ids[i][0]: min(out[find(i)]) for i in range(len(ids))}


def test_table_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    want = groups([(r.doc_id, plain(r.text)) for r in rows])
    got = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.fp & (2**64 - 1) for r in got} == {r.doc_id: plain(r.text) for r in rows}


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5, 7])
def test_bit_planes_find_every_near_pair(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 9), replace=False))) for b in base for _ in range(6)]
    fps = np.unique(np.array(near, np.uint64))
    n = len(fps)
    pairs = {(i, int(j)) for i, js in simhash.near_pairs(fps, np.zeros(n, int), np.full(n, n), radius) for j in js}
    assert pairs == {(i, j) for i in range(n) for j in range(i + 1, n) if (int(fps[i]) ^ int(fps[j])).bit_count() <= radius}


def test_hot_bucket_is_cut_into_blocks(spark):
    rng = np.random.default_rng(5)
    fps = sorted({int(0x1234 << 40 ^ (1 << int(a)) ^ (1 << int(b))) for a, b in rng.integers(0, 62, (1500, 2))})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    links = simhash.links(df, block=64)
    assert len({r.label for r in components(links).collect()}) == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150), (7, 7), (300, 300)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 150: 100, 200: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_odd_rows(odd, none, odd_rows):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id, r.fp) for r in simhash.near_duplicates(odd).collect())
    assert len(got) == len(odd_rows)
    by = {(a, b): c for a, b, c, _ in got}
    assert by[(False, 1)] == by[(False, 2)] == 1  # case is folded
    assert by[(False, 3)] == by[(False, 4)] == by[(False, 5)] == 3  # no words: fingerprint zero
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    texts = [r.text for r in kept.collect()]
    assert sum(t is not None and t.lower() == "a b c d e f g h" for t in texts) == 1
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0
    assert kept.select(F.count_distinct("doc_id")).first()[0] == kept.count()


def test_blocks_without_near_pairs_are_abandoned():
    rng = np.random.default_rng(8)
    fps = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    stopped = []
    assert list(simhash.near_pairs(fps, np.zeros(5000, int), np.full(5000, 5000), 3, stopped)) == []
    assert len(stopped) == -(-5000 // simhash.QUERIES) and max(stopped) < 40
    fps[4000] = fps[17]  # one pair keeps one block open, and only that
    stopped = []
    assert [(i, j.tolist()) for i, j in simhash.near_pairs(fps, np.zeros(5000, int), np.full(5000, 5000), 3, stopped)] == [(17, [4000])]
    assert len(stopped) == -(-5000 // simhash.QUERIES) - 1


def test_more_blocks_for_more_fingerprints(spark):
    assert len(simhash.block_masks(1000, 3)) == 4 and len(simhash.block_masks(10**9, 3)) == 10
    assert all(sum(m.bit_count() for m in simhash.block_masks(n, 3)) for n in (1, 10**8, 10**11))
    rng = np.random.default_rng(9)
    base = rng.integers(-(1 << 63), 1 << 63, 60)
    near = {int(b) for b in base} | {int(b ^ np.int64(sum(1 << int(k) for k in rng.choice(63, 3, replace=False)))) for b in base}
    df = spark.createDataFrame([(x,) for x in near], "fp long")
    few, many = (components(simhash.links(df, 3, masks=simhash.block_masks(n, 3))).collect() for n in (1, 10**11))
    assert {(r.node, r.label) for r in few} == {(r.node, r.label) for r in many} and len({r.label for r in few}) == 60
