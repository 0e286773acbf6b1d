"""The conversation trie against plain dictionaries, and its merging across blocks."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from tickloom.llm import trie, triesql

SCHEMA = "conv_id long, turn long, role string, text string, c long, p long, n long, pid int, key string, a long, node string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, *(None,) * 7) for r in rows], SCHEMA)


def plain(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    rebuilt = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(turns.get(c - int(math.fmod(c, 100)), [])[:h] + turns[c][h:])
    members, kids = defaultdict(list), defaultdict(set)
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
            if d:
                kids[s[: d - 1]].add(s[:d])
    leaves, saved = defaultdict(int), defaultdict(int)
    for k in members:
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(members[k]) - 1) * len(k[-1][1]) if k else 0
    out = []
    for k, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if rebuilt[c] == k)))
        parent = min(members[k[:-1]]) if k else None
        out.append((min(m), len(k), parent, len(m), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[1], r[0]))


@pytest.fixture(scope="module")
def odd_rows():
    r = random.Random(3)
    rows = [
        (c, t if t else None, r.choice(["u", None, ""]), r.choice(["a", "b", "bb", None, "", "x" * 9]))
        for c in [*range(250), 1250, -7]
        for t in range(r.choice([1, 1, 2, 3, 5, 8, 30]))
    ]
    return [*rows, (None, 1, "u", "a"), (9000, 0, "u", "é🙂" * 5000)]


@pytest.mark.parametrize(("block", "most"), [(1 << 16, 1 << 18), (4, 8), (7, 60)])
def test_odd_rows_against_plain(spark, odd_rows, block, most):
    got = found(trie.conversation_trie(frame(spark, odd_rows), block, most))
    assert got == plain(odd_rows)


def test_ties_and_repeated_rows(spark):
    one, two, three, four = [c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 == 0][:4]  # keep all own turns
    rows = [(c, 0, "u", "a") for c in (one, two) for _ in range(3)]
    rows += [(three, 0, "u", "b"), (three, 0, "u", "a"), (four, 0, "u", "a"), (four, 0, "u", "b")]
    got = found(trie.conversation_trie(frame(spark, rows)))
    ends = {r[1]: r[7] for r in got if r[7] != trie.NO_ENDS}
    assert ends == {d: hashlib.sha256(f"{x},{y}".encode()).hexdigest() for d, x, y in ((3, one, two), (2, three, four))}
    assert got[0][3:6] == (4, len({r[0] for r in got if r[1] == 1}), 2)


def test_prefixes_of_one_conversation(spark):
    rows = [(100 * k, t, "u", "m") for k in range(1, 60) for t in range(k)]
    assert found(trie.conversation_trie(frame(spark, rows), 5, 10)) == plain(rows)


def test_no_conversations(spark):
    assert trie.conversation_trie(frame(spark, [])).collect() == []


def test_sql_twin_agrees_with_plain(odd_rows):
    import pandas as pd

    con = duckdb.connect()
    rows = [r for r in odd_rows if r[0] != 9000]
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    assert sorted(con.sql(triesql.TRIE).fetchall(), key=lambda r: (r[1], r[0])) == plain(rows)


def test_merge_does_not_depend_on_blocks():
    r = random.Random(5)
    depths = [r.randint(0, 6) for _ in range(200)]
    leaves = [[max(a, b) + r.randint(0, 2), 0, 1, i, 0, 0, 0, 0, 0, None] for i, (a, b) in enumerate(zip([0, *depths], [*depths, 0], strict=True))]
    edges = [(d, 0, 0, 0) for d in depths]
    whole, top, _ = trie.merge(leaves, edges, True)
    items, joints, closed = [], [], []
    for a in range(0, 201, 9):
        done, rest, inner = trie.merge(leaves[a : a + 9], edges[a : a + len(leaves[a : a + 9]) - 1], False)
        closed += done
        joints += ([edges[a - 1]] if a else []) + inner
        items += rest
    done, last, _ = trie.merge(items, joints, True)
    key = lambda v: (v[0][0], v[0][2], v[0][3], max(v[0][4], 1), v[0][6], v[1][0])
    assert sorted(map(key, closed + done)) == sorted(map(key, whole))
    assert last[0][:7] == top[0][:7]
