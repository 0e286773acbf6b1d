"""The library stands without the training-data subpackage."""

from __future__ import annotations

import os
import re
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

BLOCKED = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("tickloom.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
q = e.queries()
assert len(q) > 250 and set(e.oracle_sql()) <= set(q)
assert not any(k.startswith("op") and k[2].isdigit() for k in q) and "pipeline" not in q
"""


def test_imports_without_the_subpackage():
    subprocess.run([sys.executable, "-c", BLOCKED], cwd=ROOT, check=True)


def test_nothing_else_imports_it():
    for top, _, names in os.walk(os.path.join(ROOT, "tickloom")):
        if os.path.basename(top) == "llm":
            continue
        for n in names:
            if n.endswith(".py"):
                assert not re.search(r"\bllm\b", open(os.path.join(top, n)).read()), n


def test_shared_folder_is_required_on_a_cluster(monkeypatch, spark):
    from tickloom import session

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        def __init__(self, master):
            self.master = master

        def getCheckpointDir(self):
            return None

        def setCheckpointDir(self, path):
            pass

    class Session:
        conf = Conf()

        def __init__(self, master):
            self.sparkContext = Context(master)

    with pytest.raises(RuntimeError):
        session.shared_dir(Session("spark://host:7077"))
    with pytest.raises(RuntimeError):
        session.shared_dir(Session("local-cluster[3,2,1024]"))
    assert os.path.isdir(session.shared_dir(Session("local[8]")))


def test_release_deletes_tables(spark):
    from tickloom import session

    t = session.materialize(spark.range(5))
    assert t.count() == 5
    folder = session._folder(spark).removeprefix("file://").removeprefix("file:")
    assert os.path.isdir(folder)
    session.release(spark)
    assert not os.path.isdir(folder)


def test_newey_west_uses_every_lag(spark):
    """A series of 2,000 rows needs lag 13; against numpy."""
    import numpy as np
    from tickloom.functions.ordered import DAILY
    from tickloom.operators import inference

    rng = np.random.default_rng(3)
    x = np.cumsum(rng.normal(size=2000)) * 0.05 + rng.normal(size=2000) + 0.1
    rows = [("a", i, float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "symbol string, k int, x double").selectExpr(
        "symbol", "date_add(date'2000-01-01', k) as date", "x"
    )
    got = inference.diebold_mariano(df, DAILY, "x").first()
    lag, d = round(len(x) ** (1 / 3)), x - x.mean()
    var = d @ d / len(x) + sum(2 * (1 - k / (lag + 1)) * (d[k:] @ d[:-k]) / len(x) for k in range(1, lag + 1))
    assert lag > 8 and got["tstat"] == pytest.approx(x.mean() / np.sqrt(var / len(x)), rel=1e-9)
