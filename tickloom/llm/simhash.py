"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints that differ in at most ``radius`` bits agree in one of ``radius + 1``
bit blocks, so each block value is a bucket. Inside a bucket the fingerprints are held
as bit planes: bit k of 64 fingerprints is one machine word. A query adds
``plane ^ own bit`` of all planes into carry-save counters, 64 distances at a time, and
stops as soon as every distance in the block has passed the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, stage

BITS = 64
QUERIES = 128  # fingerprints compared with a block at a time
BLOCK = 4096  # fingerprints of one bucket that a task compares with another block
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles; 0 for a text without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = [h(joined, seed)]
    else:
        lens = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lens + 1) - 1
        starts = ends - lens
        hashes = [h(joined[s:e], seed) for s, e in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=False)]
    count = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = np.array(hashes[i : i + (1 << 15)], dtype="<u8")
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * count > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``doc_id``, ``fp`` (the unsigned fingerprint as a signed long) and ``text_hash``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x, width) for x in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), b.column(2)], ["doc_id", "fp", "text_hash"])

    cols = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash")
    )
    return cols.mapInArrow(work, "doc_id long, fp long, text_hash long")


def near_pairs(
    fps: np.ndarray, first: np.ndarray, stop: np.ndarray, radius: int, abandoned: list[int] | None = None
) -> Iterator[tuple[int, np.ndarray]]:
    """For rows grouped in runs: each row that has later rows within ``radius``, with those.

    ``first[i]`` and ``stop[i]`` bound the run of row i. Rows of neighbouring runs may be compared as well; what
    is returned is within the radius in any case. Queries and words of 64 lanes whose distances
    have all passed the radius are dropped as the planes go on, and a block is abandoned once
    none is left; ``abandoned`` collects the plane at which each such block stopped.
    """
    counters = (radius + 1).bit_length() if radius & (radius + 1) else radius.bit_length()
    init = (1 << counters) - 1 - radius  # a counter overflows exactly when the distance passes the radius
    shifts = np.arange(BITS, dtype=np.uint64)[:, None]
    n, a = len(fps), 0
    while a < n:
        b = min(n, a + QUERIES)
        target = fps[a : int(stop[b - 1])]
        padded = np.concatenate([target, np.zeros(-len(target) % 64, np.uint64)])
        planes = np.packbits(((padded[None, :] >> shifts) & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little").view("<u8")
        mine = np.where((fps[a:b][None, :] >> shifts) & np.uint64(1), FULL, np.uint64(0))
        lane = np.arange(len(padded))[None, :]
        own = np.arange(b - a)
        skip = (lane <= own[:, None]) | (lane >= len(target))  # itself, rows before it, filling lanes
        over = np.packbits(skip, axis=1, bitorder="little").view("<u8")
        count = [np.full(over.shape, FULL if init >> k & 1 else 0, np.uint64) for k in range(counters)]
        words = np.arange(planes.shape[1])
        for k in range(BITS):
            carry = planes[k][None, :] ^ mine[k][:, None]
            for c in count:
                up = c & carry
                c ^= carry
                carry = up
            over |= carry
            if k % 4 == 3:
                open_words = over != FULL
                rows, cols = open_words.any(axis=1), open_words.any(axis=0)
                if not rows.any():
                    if abandoned is not None:
                        abandoned.append(k)
                    break
                if 2 * rows.sum() <= len(rows) or 2 * cols.sum() <= len(cols):  # go on with what is open
                    at = np.ix_(rows, cols)
                    over, count = over[at], [c[at] for c in count]
                    planes, mine, own, words = planes[:, cols], mine[:, rows], own[rows], words[cols]
        else:
            near = np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little")
            lanes = (words[:, None] * 64 + np.arange(64)).ravel()
            for i in np.flatnonzero(near.any(axis=1)):
                yield a + int(own[i]), a + lanes[np.flatnonzero(near[i])]
        a = b


def forest(fps: np.ndarray, run: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside the runs, as (fingerprint, root) pairs."""
    cuts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    stop = np.repeat(np.append(cuts[1:], len(fps)), np.diff(np.append(cuts, len(fps))))
    first = np.repeat(cuts, np.diff(np.append(cuts, len(fps))))
    parent = np.arange(len(fps))

    def roots(x: np.ndarray) -> np.ndarray:
        r = parent[x]
        while (parent[r] != r).any():
            r = parent[r]
        return r

    for i, others in near_pairs(fps, first, stop, radius):
        r = np.unique(roots(np.append(others, i)))
        parent[r] = r[0]
        parent[others] = r[0]
        parent[i] = r[0]
    top = roots(np.arange(len(fps)))
    keep = fps != fps[top]
    return fps[keep], fps[top][keep]


def block_masks(count: int, radius: int, most: int = BLOCK) -> list[int]:
    """Masks of bits, one of which two fingerprints within ``radius`` agree in.

    With radius + j equal blocks some j of them agree. j is the least that leaves about
    ``most`` of ``count`` random fingerprints to a bucket, so buckets do not grow with the data.
    """
    keep = 1
    while keep < 8 and count >> (BITS * keep // (radius + keep)) > most:
        keep += 1
    edges = [BITS * i // (radius + keep) for i in range(radius + keep + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in pairwise(edges)]
    return [sum(c) for c in combinations(blocks, keep)]


def links(distinct: DataFrame, radius: int = 3, block: int = BLOCK, masks: list[int] | None = None) -> DataFrame:
    """Links (``u``, ``v``) that span every group of fingerprints (column ``fp``).

    A bucket of more than ``block`` fingerprints is cut into blocks, and each pair of
    blocks is a task's unit, so the rows of a hot bucket are spread. Each unit returns
    a forest and never all its pairs.
    """
    masks = masks or block_masks(distinct.count(), radius)
    parts = [
        F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(m - (1 << BITS) if m >> (BITS - 1) else m)).alias("val"))
        for k, m in enumerate(masks)
    ]
    keyed = distinct.select("fp", F.explode(F.array(*parts)).alias("b")).select("fp", "b.t", "b.val")
    full = keyed.groupBy("t", "val").agg(F.ceil(F.count("*") / block).cast("int").alias("c"), F.count("*").alias("n"))
    rows = keyed.join(full.where("n > 1").drop("n"), ["t", "val"])
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("c")).cast("int"))
    other = F.when(F.col("c") == 1, F.array(F.lit(0))).otherwise(
        F.array_remove(F.sequence(F.lit(0), F.col("c") - 1), F.col("own"))
    )
    rows = rows.withColumn("other", F.explode(other))
    unit = F.xxhash64("t", "val", F.least("own", "other"), F.greatest("own", "other"))
    rows = rows.select("fp", unit.alias("unit"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0

        def flush(df: pd.DataFrame) -> pd.DataFrame:
            u, v = forest(df["fp"].to_numpy(np.int64).view(np.uint64), df["unit"].to_numpy(np.int64), radius)
            return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

        for b in batches:
            held.append(b)
            size += len(b)
            if size >= 8 * BLOCK:
                df = pd.concat(held, ignore_index=True)
                cut = int(np.searchsorted(df["unit"].to_numpy(), df["unit"].iloc[-1]))
                if cut:
                    yield flush(df.iloc[:cut])
                held = [df.iloc[cut:]]
                size = len(df) - cut
        if size:
            yield flush(pd.concat(held, ignore_index=True))

    return rows.repartition("unit").sortWithinPartitions("unit").mapInPandas(work, "u long, v long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3
) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``fp``, ``text_hash``, ``rep`` and ``component_id``.

    ``rep`` (doc_id, text_hash) marks the row that stands for the group, the one of the
    smallest doc_id; ``component_id`` is that doc_id. Null or empty texts have
    fingerprint zero and link like others; repeated rows are kept, each with the same
    result; rows with a null doc_id are grouped but never name a group unless all its
    ids are null; an empty table gives an empty result. Other columns are ignored.
    """
    prints = stage(fingerprints(docs, id_col, text_col, width))
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("rep")
    distinct = stage(prints.groupBy("fp").agg(rep))
    label = components(links(distinct.select("fp"), radius))
    label = label.select(F.col("node").alias("fp"), "label")
    grouped = distinct.join(label, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    best = grouped.groupBy("label").agg(F.min("rep").alias("rep"))
    of_print = grouped.select("fp", "label").join(best, "label").select("fp", "rep")
    out = prints.join(of_print, "fp")
    return out.select("doc_id", "fp", "text_hash", "rep", F.col("rep.doc_id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: one row of each group, all columns."""
    found = near_duplicates(docs, id_col, text_col)
    keep = found.where(
        F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("text_hash") == F.col("rep.text_hash"))
    ).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    tagged = docs.withColumn("_h", F.xxhash64(text_col)).withColumn("_i", F.coalesce(F.col(id_col).cast("long"), F.lit(-1)))
    keep = keep.withColumn("_i", F.coalesce("_id", F.lit(-1))).withColumnRenamed("_hash", "_h")
    both = tagged.join(keep, ["_i", "_h"]).where(F.col(id_col).cast("long").eqNullSafe(F.col("_id")))
    return both.dropDuplicates(["_i", "_h"]).drop("_i", "_h", "_id")
