from __future__ import annotations

import re
from collections import Counter

from tests.check import compare, duck
from tickloom.llm import queries, weakrules

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    t = text or ""
    w = WORD.findall(t)
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def stats(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words


def test_statistics_and_verdicts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    out = weakrules.judge(docs)
    rows = out.collect()
    assert all(stats(r) == plain(text[r.doc_id]) for r in rows)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in rows)
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = [(r.kept, label[r.doc_id]) for r in rows if r.doc_id in label and not r.base_failed]
    assert all(kept for kept, q in judged if q == 1)
    assert sum(not kept for kept, q in judged if q == 0) >= 0.9 * sum(q == 0 for _, q in judged)
    plan = out._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    res, _, _ = compare(queries.op4_weak_rules(spark, sf), duck(sf), queries.ORACLES["op4_weak_rules"])
    assert res == "ok", res


def test_em_finds_planted_accuracies(spark):
    import random

    r = random.Random(4)
    rules = ["a", "b", "c"]
    good = {"a": 0.9, "b": 0.95, "c": 0.85}
    count = Counter()
    for _ in range(40_000):
        y = r.random() < 0.8
        count[tuple(None if r.random() < 0.2 else int((r.random() < (good[k] if y else 0.8)) == y) for k in rules)] += 1
    rows = [(*k, n) for k, n in count.items()]
    par = weakrules.fit(spark.createDataFrame(rows, "v_a int, v_b int, v_c int, n long"), rules)
    assert abs(par["prior"] - 0.8) < 0.03
    assert all(abs(par[f"good_{k}"] - good[k]) < 0.03 and abs(par[f"bad_{k}"] - 0.8) < 0.06 for k in rules)


def test_odd_rows(odd, none, odd_rows):
    rows = weakrules.judge(odd).collect()
    assert sorted(map(stats, rows)) == sorted(plain(r[1]) for r in odd_rows)
    assert all(r.base_failed and not r.kept for r in rows if r.n_words < 50)
    assert all(r.base_failed for r in rows if r.doc_id in (10, 11))
    assert weakrules.judge(none).count() == 0
