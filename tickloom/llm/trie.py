"""Prefix trie of conversations by union-find over sorted-neighbour LCP edges.

Distinct sequences of turns are sorted; the longest common prefix of two neighbours is
an edge between them. Taking the edges in descending depth, union-find merges components,
and every merge at a new depth creates the branching node of that depth. Blocks of the
sorted sequences are merged on their own. What a block cannot decide, the chains of nodes
that touch its two ends, is contracted to a short list of partial nodes, and these lists
are merged by the same function across block and partition boundaries. The nodes between
two branching nodes, which have the same members, are spread over the stored turns last.

No conversation, node or group of copies is held whole. A sequence is sorted by its turns
at which the set of sequences that share the prefix shrinks (and every 65,536th turn): a
key of k such turns needs k(k+1)/2 turns in the corpus, so keys have a proven bound.
Prefixes are compared by two 64-bit sums of hashes bound to their positions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import stage

BLOCK = 1 << 16  # sorted sequences that are merged in one go
SPAN = 1 << 16  # turns of a conversation that a window holds
NO_ENDS = hashlib.sha256(b"").hexdigest()
FAR = 1 << 62

NODE = "d long, chars long, n long, c long, leaves long, saved long, kids long, a long, b long, ends string"
KEY = "array<struct<p:long,a:long,b:long,chars:long,pa:long,pb:long>>"
ITEM = f"pid int, seq long, open boolean, {NODE}, pd long, pchars long, pa long, pb long, first {KEY}, last {KEY}"


def running(df: DataFrame, key: str, order: list[str], sums: list[str]) -> DataFrame:
    """Replace each column of ``sums`` by its running sum (modulo 2**64) within ``key``.

    Rows are range partitioned in the order of ``order`` (which begins with ``key``); each
    partition sums its own rows, and one row per partition carries what its first key had
    before. The table is stored once; a key of any size is spread.
    """
    fields = [*df.schema.fields, T.StructField("_pid", T.IntegerType()), T.StructField("_rn", T.LongType())]
    schema = T.StructType(fields)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, rn, last, carry = TaskContext.get().partitionId(), 0, None, {}
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            k = b.column(b.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            sizes = np.diff(np.append(starts, n))
            cols = dict(zip(b.schema.names, b.columns, strict=True))
            for s in sums:
                v = cols[s].to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                total = np.cumsum(v, dtype=np.uint64)
                total = total - np.repeat(total[starts] - v[starts], sizes)
                if k[0] == last:
                    total[: sizes[0]] += carry[s]
                carry[s] = total[-1]
                cols[s] = pa.array(total.view(np.int64))
            last = k[-1]
            more = [pa.array(np.full(n, pid, np.int32)), pa.array(np.arange(rn, rn + n))]
            rn += n
            yield pa.RecordBatch.from_arrays([*cols.values(), *more], [f.name for f in fields])

    done = stage(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(local, schema))
    tail = F.max_by(F.struct(key, *sums), "_rn").alias("tail")
    ends = done.groupBy("_pid").agg(F.min_by(key, "_rn").alias("head"), tail).collect()  # one row per partition
    bases: dict[int, tuple[int, list[int]]] = {}
    at, held = None, [0] * len(sums)
    for r in sorted(ends, key=lambda r: r["_pid"]):
        before = held if r["head"] == at else [0] * len(sums)
        if any(before):
            bases[r["_pid"]] = (r["head"], before)
        spread = r["tail"][key] == r["head"]
        held = [((b if spread else 0) + r["tail"][s]) & 0xFFFFFFFFFFFFFFFF for s, b in zip(sums, before, strict=True)]
        at = r["tail"][key]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = dict(zip(b.schema.names, b.columns, strict=True))
            pids = cols.pop("_pid").to_numpy()
            del cols["_rn"]
            k = cols[key].to_numpy(zero_copy_only=False)
            for pid in np.unique(pids):
                if int(pid) not in bases:
                    continue
                head, before = bases[int(pid)]
                hit = (pids == pid) & (k == head)
                for s, base in zip(sums, before, strict=True):
                    v = cols[s].to_numpy(zero_copy_only=False).view(np.uint64).copy()
                    v[hit] += np.uint64(base)
                    cols[s] = pa.array(v.view(np.int64))
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return done.mapInArrow(add, df.schema)


def rebuilt(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that share openings: turns (c, p, size, h1, h2, n) and one row per conversation.

    Conversation c begins with the first h turns of conversation c - c % group and goes on
    with its own turns after its first h; h is the CRC-32 of its decimal id modulo ``most``.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    src = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("c"),
        F.col("turn").alias("turn"),
        F.xxhash64(role, text).alias("h1"),
        F.xxhash64(F.lit(17), text, role).alias("h2"),
        F.length(text).cast("long").alias("n"),
        F.lit(1).cast("long").alias("pos"),
    )
    own = running(src, "c", ["c", "turn", "h1", "h2"], ["pos"])
    h = F.crc32(F.col("c").cast("string")) % most
    heads = own.where((F.col("c") % group == 0) & (F.col("pos") < most)).groupBy(F.col("c").alias("base"))
    heads = heads.agg(F.sort_array(F.collect_list(F.struct("pos", "h1", "h2", "n"))).alias("head"))  # below `most` entries
    convs = own.groupBy("c").agg(F.max("pos").alias("own")).withColumn("h", h)
    convs = convs.withColumn("base", F.col("c") - F.col("c") % group).join(heads, "base", "left")
    none = F.array().cast(heads.schema["head"].dataType)
    convs = convs.withColumn("head", F.coalesce(F.filter("head", lambda x: x["pos"] <= F.col("h")), none))
    size = F.size("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    convs = stage(convs.select("c", "h", "head", size.cast("long").alias("size")))
    first = convs.select("c", "size", F.inline("head")).select("c", F.col("pos").alias("p"), "size", "h1", "h2", "n")
    rest = own.where(F.col("pos") > h).join(convs.select("c", "size", "h", F.size("head").alias("given")), "c")
    rest = rest.select("c", (F.col("pos") - F.col("h") + F.col("given")).alias("p"), "size", "h1", "h2", "n")
    return first.unionByName(rest), convs.select("c", "size")


def prefixes(turns: DataFrame) -> DataFrame:
    """Per turn (c, p): the hashes ``a``, ``b`` of the prefix, those of the prefix before
    (``pa``, ``pb``), the code points so far and before (``chars``, ``pchars``)."""
    g1, g2 = F.xxhash64("p", "h1", "h2"), F.xxhash64(F.lit(29), "h2", "p", "h1")
    src = turns.select("c", "p", "size", "n", g1.alias("g1"), g2.alias("g2"), g1.alias("a"), g2.alias("b"), F.col("n").alias("chars"))
    sums = running(src, "c", ["c", "p"], ["a", "b", "chars"])
    schema = "c long, p long, size long, a long, b long, chars long, pa long, pb long, pchars long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            v = {k: c.to_numpy(zero_copy_only=False).view(np.uint64) for k, c in zip(x.schema.names, x.columns, strict=True)}
            out = [v[k] for k in ("c", "p", "size", "a", "b", "chars")]
            out += [v["a"] - v["g1"], v["b"] - v["g2"], v["chars"] - v["n"]]
            yield pa.RecordBatch.from_arrays([pa.array(y.view(np.int64)) for y in out], [s.split()[0] for s in schema.split(", ")])

    return sums.mapInArrow(work, schema)


def sequences(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per distinct whole sequence: its members' count, smallest id and id digest.

    Ids are joined in ascending pieces of up to 64 KB by partition, so that the digest,
    which needs them in one place by definition, reads few rows even of a hot sequence.
    """
    ends = rows.where("p = size").select("c", F.col("p").alias("d"), "a", "b", "chars")
    zero = F.lit(0).cast("long")
    ends = ends.unionByName(convs.where("size = 0").select("c", *[zero.alias(k) for k in ("d", "a", "b", "chars")]))
    names = ["d", "a", "b", "chars", "c", "n", "ids"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[int]] = {}

        def batch(keys: list[tuple]) -> pa.RecordBatch:
            parts = [held.pop(k) for k in keys]
            cols: list[Any] = [pa.array(list(x), pa.int64()) for x in zip(*keys, strict=True)]
            cols += [pa.array([x[0] for x in parts], pa.int64()), pa.array([len(x) for x in parts], pa.int64())]
            cols.append(pa.array([",".join(map(str, x)) for x in parts]))
            return pa.RecordBatch.from_arrays(cols, names)

        count = 0
        for x in batches:
            for c, *k in zip(*[y.to_pylist() for y in x.columns], strict=True):
                mine = held.setdefault(tuple(k), [])
                mine.append(c)
                count += 1
                if len(mine) >= 4096:
                    count -= len(mine)
                    yield batch([tuple(k)])
            if count > 1 << 19:
                yield batch(list(held))
                count = 0
        if held:
            yield batch(list(held))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, least, n, sha = None, 0, 0, None
        for x in batches:
            done = []
            for d, a, b, chars, c, m, ids in zip(*[y.to_pylist() for y in x.columns], strict=True):
                if (d, a, b, chars) != at:
                    if at:
                        done.append((*at, least, n, sha.hexdigest()))
                    at, least, n, sha = (d, a, b, chars), c, 0, hashlib.sha256()
                else:
                    sha.update(b",")
                n += m
                sha.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(list(y)) for y in zip(*done, strict=True)], [*names[:-1], "ends"])
        if at:
            last = [(*at, least, n, sha.hexdigest())]
            yield pa.RecordBatch.from_arrays([pa.array(list(y)) for y in zip(*last, strict=True)], [*names[:-1], "ends"])

    longs = "d long, a long, b long, chars long, c long, n long"
    sorted_ends = ends.select("c", "d", "a", "b", "chars").repartitionByRange("c").sortWithinPartitions("c")
    some = sorted_ends.mapInArrow(pieces, f"{longs}, ids string")
    return stage(some.repartition("a", "b").sortWithinPartitions("d", "a", "b", "c").mapInArrow(digest, f"{longs}, ends string"))


def sort_keys(rows: DataFrame, seqs: DataFrame) -> DataFrame:
    """``seqs`` with ``key``: the turns at which the sequences that share the prefix get fewer.

    Whether a turn belongs to the key depends on its prefix alone, so two sequences have the
    same entries as far as they agree, and both have one at the first turn where they differ.
    The last entry stands for the end of the sequence.
    """
    # Stored, so that the join reads both sides from shuffles and can split a frequent prefix.
    shared = stage(rows.groupBy("p", "a", "b").agg(F.count(F.lit(1)).alias("share")))
    w = Window.partitionBy("c", F.floor(F.col("p") / SPAN)).orderBy("p")
    x = rows.join(shared, ["p", "a", "b"]).withColumn("was", F.lag("share").over(w))
    entry = F.struct("p", "a", "b", F.col("pchars").alias("chars"), "pa", "pb")
    keys = x.where("was IS NULL OR was <> share").groupBy("c").agg(F.sort_array(F.collect_list(entry)).alias("key"))
    zero = F.lit(0).cast("long")
    end = F.struct(
        (F.col("d") + 1).alias("p"), zero.alias("a"), zero.alias("b"), "chars", F.col("a").alias("pa"), F.col("b").alias("pb")
    )
    out = seqs.join(keys, "c", "left")
    return out.withColumn("key", F.concat(F.coalesce("key", F.array().cast(keys.schema["key"].dataType)), F.array(end)))


# A node in the making: depth, code points down to it, members, smallest member, childless
# nodes below, saved below, children, its two hashes, digest of the members that end there.
def _under(new: list, v: list) -> None:
    new[2] += v[2]
    new[3] = min(new[3], v[3])
    new[4] += max(v[4], 1)
    new[5] += v[5] + (v[2] - 1) * (v[1] - new[1])
    new[6] += 1


def _same(new: list, v: list) -> None:
    new[2] += v[2]
    new[3] = min(new[3], v[3])
    new[4] += v[4]
    new[5] += v[5]
    new[6] += v[6]
    new[9] = new[9] or v[9]


def merge(items: list[list], edges: list[tuple], ends: bool) -> tuple[list[tuple], list[list], list[tuple]]:
    """Union-find over the edges between neighbouring items, deepest first.

    ``edges[i]`` = (depth, code points, hash, hash) lies between items i and i + 1. Returns
    the closed nodes, each with its parent's edge, and the contracted items with their edges.
    A component that touches either end is not closed, since edges beyond may belong to it:
    it is set aside as it is, and the node above it goes on without it. The lists of those
    set aside, with the last component between, describe all that is still open. ``ends``
    says that nothing lies beyond, so all but the last component is closed.
    """
    up = list(range(len(items)))
    node = list(items)
    left: list[tuple] = []
    right: list[tuple] = []
    closed: list[tuple] = []

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    last = len(items) - 1
    for e in sorted(range(last), key=lambda i: -edges[i][0]):
        edge = edges[e]
        d, chars, a, b = edge
        x, y = find(e), find(e + 1)
        new = [d, chars, 0, FAR, 0, 0, 0, a, b, None]
        for v, aside, touches in ((node[x], left, x == find(0)), (node[y], right, y == find(last))):
            if v[0] == d:
                _same(new, v)
            elif touches and not ends:
                aside.append((v, edge))
            else:
                closed.append((v, edge))
                _under(new, v)
        up[y] = x
        node[x] = new
    top = node[find(0)]
    rest = [v for v, _ in left] + [top] + [v for v, _ in reversed(right)]
    return closed, rest, [x for _, x in left] + [x for _, x in reversed(right)]


def lcp(one: list[dict], two: list[dict]) -> tuple:
    """The edge between two different neighbours, from the first entry that differs."""
    for x, y in zip(one, two, strict=False):
        if x["p"] != y["p"] or x["a"] != y["a"] or x["b"] != y["b"]:
            return x["p"] - 1, x["chars"], x["pa"], x["pb"]
    raise ValueError("equal keys of different sequences")


def _contract(block: int, ends: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The work on sorted items: closed nodes (``open`` false) and contracted ones."""
    schema = to_arrow_schema(T._parse_datatype_string(ITEM))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, seq = TaskContext.get().partitionId(), 0
        items: list[list] = []
        edges: list[tuple] = []
        lead: tuple | None = None  # the edge before the block
        first = last = None  # keys at the ends of the block, where an edge is unknown
        before = None  # key of the item before
        fresh = True

        def rows(final: bool) -> pa.RecordBatch:
            nonlocal seq, first
            closed, rest, joints = merge(items, edges, ends)
            if ends and final:
                top = rest.pop()
                if top[0] > 0:
                    root = [0, 0, 0, FAR, 0, 0, 0, 0, 0, None]
                    closed.append((top, (0, 0, 0, 0)))
                    _under(root, top)
                    top = root
                closed.append((top, (None, None, None, None)))
            out = [(pid, 0, False, *v[:4], max(v[4], 1), *v[5:], *e, None, None) for v, e in closed]
            for i, v in enumerate(rest):
                e = joints[i - 1] if i else (lead or (None,) * 4)
                out.append((pid, seq, True, *v, *e, first if i == 0 else None, last if i == len(rest) - 1 and final else None))
                seq += 1
            first = None
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)

        for x in batches:
            whole = "key" in x.schema.names
            for r in x.to_pylist():
                if whole:
                    v = [r["d"], r["chars"], r["n"], r["c"], 0, 0, 0, r["a"], r["b"], r["ends"]]
                    mine = after = r["key"]
                    edge = lcp(before, mine) if before else None
                else:
                    v = [r["d"], r["chars"], r["n"], r["c"], r["leaves"], r["saved"], r["kids"], r["a"], r["b"], r["ends"]]
                    mine, after = r["first"], r["last"]
                    edge = None if r["pd"] is None else (r["pd"], r["pchars"], r["pa"], r["pb"])
                    if edge is None and before:
                        edge = lcp(before, mine)
                if len(items) >= block and not ends:
                    yield rows(False)
                    items, edges, lead = [], [], edge
                elif items:
                    edges.append(edge)
                else:
                    lead = edge
                if fresh:
                    first, fresh = mine if edge is None else None, False
                items.append(v)
                before = last = after
        if items:
            yield rows(True)

    return work


def compact_nodes(keyed: DataFrame, block: int = BLOCK, most: int = 4 * BLOCK) -> DataFrame:
    """The root, the branching nodes and the sequences' ends, from keyed sequences."""
    cur = stage(keyed.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(_contract(block, False), ITEM))
    found = cur.where("not open")
    left, count = cur.where("open"), 0
    while True:
        before, count = count, left.count()
        if count <= most or before and count > before // 2:
            break
        cur = stage(
            left.repartitionByRange("pid", "seq").sortWithinPartitions("pid", "seq").mapInArrow(_contract(block, False), ITEM)
        )
        found = found.unionByName(cur.where("not open"))
        left = cur.where("open")
    last = left.repartition(1).sortWithinPartitions("pid", "seq").mapInArrow(_contract(block, True), ITEM)
    return found.unionByName(stage(last)).drop("pid", "seq", "open", "first", "last", "pchars")


def spread(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """All nodes: each compact node with the depths between its parent's and its own."""
    above = nodes.select(F.col("d").alias("pd"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("c").alias("parent"))
    full = stage(nodes.join(above, ["pd", "pa", "pb"], "left").drop("pa", "pb", "a", "b"))
    here = F.struct("d", "pd", "parent", "chars", "n", "kids", "leaves", "saved", "ends").alias("node")
    part = F.explode(F.sequence(F.floor((F.col("pd") + 1) / SPAN), F.floor(F.col("d") / SPAN))).alias("q")
    marks = full.where("d > 0").select("c", here, part)
    marks = marks.select("c", "q", F.least(F.col("node.d"), (F.col("q") + 1) * SPAN - 1).alias("p"), F.lit(0).alias("turn"),
                         F.lit(0).cast("long").alias("pchars"), "node")
    kind = marks.schema["node"].dataType
    turns = rows.select("c", F.floor(F.col("p") / SPAN).alias("q"), "p", F.lit(1).alias("turn"), "pchars", F.lit(None).cast(kind).alias("node"))
    w = Window.partitionBy("c", "q").orderBy(F.desc("p"), "turn").rowsBetween(Window.unboundedPreceding, 0)
    deep = marks.unionByName(turns).withColumn("node", F.last("node", ignorenulls=True).over(w))
    deep = deep.where("turn = 1 AND p > node.pd").select("c", "p", "pchars", "node.*")
    zero = F.lit(0).cast("long")
    root = full.where("d = 0").select("c", zero.alias("p"), zero.alias("pchars"), here).select("c", "p", "pchars", "node.*")
    deep = deep.unionByName(root)
    end = F.col("p") == F.col("d")
    return deep.select(
        F.col("c").alias("conv_id"),
        F.col("p").alias("depth"),
        F.when(end & (F.col("p") == 0), None).when(F.col("p") == F.col("pd") + 1, F.col("parent")).otherwise(F.col("c")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(end, F.col("kids")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("saved") + F.when(F.col("p") > 0, (F.col("n") - 1) * (F.col("chars") - F.col("pchars"))).otherwise(F.lit(0))).alias("saved_tokens"),
        F.when(end, F.coalesce("ends", F.lit(NO_ENDS))).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def prefix_trie(turns: DataFrame, convs: DataFrame, block: int = BLOCK, most: int = 4 * BLOCK) -> DataFrame:
    """The trie of conversations given as turns (c, p, size, h1, h2, n), p from 1 without gaps."""
    rows = prefixes(turns)
    seqs = sequences(rows, convs)
    rows = stage(rows.join(seqs.select("c"), "c"))  # one member of each group of copies
    return spread(rows, compact_nodes(sort_keys(rows, seqs), block, most))


def conversation_trie(conversations: DataFrame, block: int = BLOCK, most: int = 4 * BLOCK) -> DataFrame:
    """One row per node of the prefix trie of the rebuilt ``conversations``.

    Columns: conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs,
    n_children, n_leaves, saved_tokens (code points that sharing the prefix saves in the
    subtree) and ends_sha256 (digest of the ids of members that end at the node).

    Null role or text counts as empty; a null turn comes first; rows of one turn are ordered
    by a hash of role and text, and repeated rows are turns of their own. Rows without
    conv_id belong to no conversation. Without conversations there is no root: the result
    is empty. A conversation without turns is a member of the root and ends there. Further
    columns are ignored.
    """
    return prefix_trie(*rebuilt(conversations.select("conv_id", "turn", "role", "text")), block, most)
