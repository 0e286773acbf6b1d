"""Mixing overlapping sources to target weights by min-cost flow.

Documents are summed by membership pattern (the set of sources they belong to). A flow
network over these sums routes tokens to the sources' quotas: each pattern offers its
size once per repetition, every further repetition at a higher cost. The flow tells how
often each pattern is repeated; a seeded order picks the documents of the last, partial
repetition, in rounds that pass over documents longer than what is left.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, running_start, stage

COSTS = (0, 1, 3)  # of the first, second and third use of a document
WEIGHTS = (5, 2, 1)
MAX_PATTERNS = 100_000  # rows of the pattern table that the driver may hold


def quotas(sizes: Sequence[int], weights: Sequence[float], total: float, most: float) -> list[float]:
    """Share ``total`` by weight; no share above ``most`` times its size, the excess reshared."""
    out = [0.0] * len(sizes)
    free = [i for i in range(len(sizes)) if sizes[i] > 0]
    left = float(total)
    while free:
        unit = left / sum(weights[i] for i in free)
        over = [i for i in free if weights[i] * unit > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = weights[i] * unit
            break
        for i in over:
            out[i] = float(most * sizes[i])
            left -= out[i]
        free = [i for i in free if i not in set(over)]
    return out


def min_cost_flow(
    capacity: Sequence[int], members: Sequence[Sequence[int]], quota: Sequence[int], costs: Sequence[int] = COSTS
) -> list[dict[int, int]]:
    """Words that each pattern sends to each of its sources.

    Successive shortest paths with potentials: one edge per repetition from the origin
    to a pattern, then to its sources, then to the sink. The flow is the largest
    possible and, among those, the one of the least cost.
    """
    p, s = len(capacity), len(quota)
    origin, sink = p + s, p + s + 1
    to: list[int] = []
    cap: list[int] = []
    cost: list[int] = []
    out: list[list[int]] = [[] for _ in range(p + s + 2)]

    def edge(a: int, b: int, c: int, w: int) -> None:
        for x, y, c1, w1 in ((a, b, c, w), (b, a, 0, -w)):
            out[x].append(len(to))
            to.append(y)
            cap.append(c1)
            cost.append(w1)

    for i, c in enumerate(capacity):
        for w in costs:
            edge(origin, i, int(c), w)
    routes = {}
    for i, m in enumerate(members):
        for j in m:
            routes[len(to)] = (i, j)
            edge(i, p + j, int(capacity[i]) * len(costs), 0)
    for j, q in enumerate(quota):
        edge(p + j, sink, int(q), 0)
    height = [0] * (p + s + 2)
    while True:
        far = {origin: 0}
        via: dict[int, int] = {}
        heap, done = [(0, origin)], set()
        while heap:
            d, x = heapq.heappop(heap)
            if x in done:
                continue
            done.add(x)
            for e in out[x]:
                if cap[e]:
                    y, nd = to[e], d + cost[e] + height[x] - height[to[e]]
                    if y not in done and nd < far.get(y, nd + 1):
                        far[y], via[y] = nd, e
                        heapq.heappush(heap, (nd, y))
        if sink not in far:
            break
        top = max(far.values())
        for x in range(len(height)):
            height[x] += far.get(x, top)
        path, x = [], sink
        while x != origin:
            path.append(via[x])
            x = to[via[x] ^ 1]
        move = min(cap[e] for e in path)
        for e in path:
            cap[e] -= move
            cap[e ^ 1] += move
    flows: list[dict[int, int]] = [{} for _ in range(p)]
    for e, (i, j) in routes.items():
        if cap[e ^ 1]:
            flows[i][j] = cap[e ^ 1]
    return flows


#: What the last repetition takes of a pattern: units up to a size and before a hash; single units.
CHOICE = "_rules array<struct<most:long,stop:long>>, _picks array<long>"


def chosen(size: str | Column) -> Column:
    """Whether a unit of hash ``_h`` is taken by ``_rules`` or ``_picks``."""
    size = F.col(size) if isinstance(size, str) else size
    ruled = F.exists("_rules", lambda r: (size <= r["most"]) & (r["stop"].isNull() | (F.col("_h") < r["stop"])))
    return ruled | F.array_contains("_picks", F.col("_h"))


def words(text: str | Column) -> Column:
    """Number of words of the whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(
    docs: DataFrame,
    members: Column | None = None,
    weights: Sequence[float] = WEIGHTS,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Every row of ``docs`` with the words the mix takes of it.

    ``members`` is the array of sources a row belongs to (default: its own source; null
    is a source, the last in order). The i-th source in code-point order has weight
    ``weights[i mod len]``; the quotas add up to all words, none above three times its
    source's size. Added columns: ``size`` (words), ``mix_members``, ``source_size`` and
    ``target`` (of the first member), ``taken`` (words times repetitions, a whole
    multiple of the size from 0 to 3). Rows without words are taken 0 times. Rows equal
    in id and text are taken equally often. An empty table gives an empty result.
    Columns of these names in ``docs`` are replaced.
    """
    spark = docs.sparkSession
    names = ("size", "mix_members", "source_size", "target", "taken")
    base = docs.drop(*names)
    member = F.array(F.col(source_col)) if members is None else members
    keyed = base.withColumns(
        {
            "size": words(text_col),
            "mix_members": F.array_distinct(member),
            "_h": F.xxhash64(F.lit(seed), F.col(id_col), F.xxhash64(text_col)),
        }
    )
    pattern = F.array_join(F.transform("mix_members", lambda x: F.coalesce(F.hex(x), F.lit("-"))), ",")
    keyed = keyed.withColumn("_pattern", pattern)
    units = stage(
        keyed.groupBy("_pattern", "_h").agg(
            F.sum("size").alias("size"), F.first("mix_members").alias("members"), F.count("*").alias("n")
        )
    )
    sums = units.groupBy("_pattern").agg(F.sum("size").alias("size"), F.first("members").alias("members"))
    rows = sums.orderBy("_pattern").limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    sources = sorted({m for r in rows for m in r["members"]}, key=lambda x: (x is None, x or ""))
    index = {m: i for i, m in enumerate(sources)}
    size = [0] * len(sources)
    for r in rows:
        for m in r["members"]:
            size[index[m]] += r["size"]
    total = sum(r["size"] for r in rows)
    quota = quotas(size, [weights[i % len(weights)] for i in range(len(sources))], total, len(COSTS))
    flows = min_cost_flow(
        [r["size"] for r in rows], [[index[m] for m in r["members"]] for r in rows], [round(q) for q in quota]
    )
    full: dict[str, int] = {}
    rest: dict[str, int] = {}
    for r, f in zip(rows, flows, strict=True):
        taken = sum(f.values())
        full[r["_pattern"]], rest[r["_pattern"]] = divmod(taken, r["size"]) if r["size"] else (0, 0)
    order = units.where("size > 0").select("_pattern", "_h", "size")
    rules: dict[str, list[tuple[int, int | None]]] = {k: [] for k in rest}
    picks: dict[str, list[int]] = {k: [] for k in rest}

    def unused(gap: dict[str, int]) -> DataFrame:
        """Units not taken yet of the patterns in ``gap``."""
        rows = [(k, v, rules[k], picks[k]) for k, v in gap.items()]
        left = F.broadcast(spark.createDataFrame(rows, f"_pattern string, gap long, {CHOICE}"))
        return order.join(left, "_pattern").where(~chosen("size"))

    # Each round takes the prefix of the units within a bound that fits. From the second on
    # the bound is half the gap, so a round halves the gap or uses all units up to the bound.
    most = {k: v for k, v in rest.items() if v > 0}
    while most:
        within = unused(most).where("size <= gap").select("_pattern", "_h", "size")
        room = F.broadcast(spark.createDataFrame([(k, rest[k]) for k in most], "_pattern string, room long"))
        inside = F.col("start") + F.col("size") <= F.col("room")
        edge = running_start(within, ["_pattern", "_h"], "size", "_pattern").join(room, "_pattern").groupBy("_pattern").agg(
            F.min(F.when(~inside, F.col("_h"))).alias("stop"), F.sum(F.when(inside, F.col("size")).otherwise(0)).alias("got")
        )
        more = {}
        for r in edge.collect():
            k = r["_pattern"]
            rules[k].append((most[k], r["stop"]))
            rest[k] -= r["got"]
            if r["stop"] is not None and rest[k] > 1:
                more[k] = rest[k] // 2
        most = more
    for last in (False, True):  # at most one more unit fits; then one that is nearest
        gap = {k: v for k, v in rest.items() if v > 0}
        if not gap:
            break
        free = unused(gap).where("size < 2 * gap" if last else "size <= gap")
        near = F.min(F.struct(F.abs(F.col("gap") - F.col("size")).alias("off"), "size", "_h")).alias("x")
        for r in free.groupBy("_pattern").agg(near).collect():
            picks[r["_pattern"]].append(r["x"]["_h"])
            rest[r["_pattern"]] -= r["x"]["size"]
    plan = [
        (
            r["_pattern"], full[r["_pattern"]], rules[r["_pattern"]], picks[r["_pattern"]],
            size[index[r["members"][0]]] if r["members"] else 0, quota[index[r["members"][0]]] if r["members"] else 0.0,
        )
        for r in rows
    ]
    schema = f"_pattern string, _full long, {CHOICE}, source_size long, target double"
    plans = F.broadcast(spark.createDataFrame(plan, schema))
    many = stage(units.where("n > 1").select("_pattern", "_h", F.col("size").alias("_unit")))  # few: equal rows
    taken = F.col("size") * (F.col("_full") + F.when(chosen(F.coalesce("_unit", "size")), 1).otherwise(0))
    out = keyed.join(many, ["_pattern", "_h"], "left").join(plans, "_pattern").withColumn("taken", taken)
    return out.drop("_pattern", "_h", "_full", "_rules", "_picks", "_unit")


def mixed(docs: DataFrame, **kw) -> DataFrame:
    """The mixture itself: each row of ``docs`` as often as the mix takes it, same columns."""
    out = mix(docs, **kw).where("size > 0 and taken > 0")
    times = F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int"))
    return out.withColumn("_time", F.explode(times)).select(*docs.columns)
