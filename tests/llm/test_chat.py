from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from tickloom.llm import chatsql, chatwindows, queries
from tests.check import compare, duck

SF = "/root/testdata/sf0.001"


def test_query_equals_sql(spark):
    res, _, _ = compare(queries.op6_budgeted_chat(spark, SF), duck(SF), queries.ORACLES["op6_budgeted_chat"])
    assert res == "ok", res


def test_no_python_in_the_plan(spark):
    plan = queries.op6_budgeted_chat(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_escape_is_reversible(spark):
    hard = [
        "", "\\", "\\\\", "<turn", "</turn>", "<\\turn", "<\\/turn>", "\\<turn", "a\\nb", "<", "<<turn 4>user\n", "</turn>\n</turn>\n", chatsql.PROBE,
        "<\\\\turn", "\\\\<\\", "x<", "</tur", "n>",
    ]
    hard += [a + b for a in hard for b in hard]
    df = spark.createDataFrame([(x,) for x in hard], "x string").withColumn("e", chatwindows.escape(F.col("x")))
    for r in df.withColumn("back", chatwindows.unescape(F.col("e"))).collect():
        assert r.back == r.x and "<turn" not in r.e and "</turn" not in r.e


def plain(rows):
    """Digests straight from the turns."""
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        whole = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_odd_turns(spark):
    schema = "conv_id long, turn long, role string, text string, _null int, cell int, pos int, start int, own int, tokens int"
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", None), (1, 2, "assistant", "x " * 900), (1, 2, "assistant", "tie"), (1, None, "user", "first")]
    rows += [(2, k, ("user", "assistant")[k % 2], f"turn {k} </turn> \\ 🙂 " * (k % 5)) for k in range(3000)]
    rows += [(None, 0, "assistant", "a"), (None, 0, "assistant", "a"), (3, 0, "system", "only"), (4, 5, None, ""), (5, 0, "a\nb>", "\n")]
    rows += [(6, 0, "system", "s " * 40), *[(6, k, ("assistant", "user")[k % 2], "w " * 100) for k in range(1, 30)]]
    df = spark.createDataFrame([(*r, *(None,) * 6) for r in rows], schema)
    made = chatwindows.windows(df)
    got = {r.conv_id: r for r in chatwindows.read_back(made).collect()}
    assert {k: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for k, r in got.items()} == plain(rows)
    wins = made.where("conv_id = 6").orderBy("window_id").collect()
    assert len(wins) > 5
    for k, w in enumerate(wins):
        assert w.text.startswith("<turn 6>system\n")  # the system turn in every window
        assert w.n_tokens <= chatwindows.BUDGET + 104 and w.text.count("</turn>\n") == w.n_turns
        assert w.n_repeated in ((0,) if k == 0 else (2, 3))  # it and what starts in 128 tokens of history
        if k:
            repeated = w.text.split("</turn>\n")[1]
            assert repeated in wins[k - 1].text
    assert chatwindows.read_back(chatwindows.windows(spark.createDataFrame([], schema))).count() == 0
