"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

WORD = r"[^\x20\x09-\x0D]+"  # bytes.split() cuts at the same characters


def stage(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    return materialize(df)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def running_start(df: DataFrame, order: list[str], value: str, group: str | None = None) -> DataFrame:
    """Add ``start``: the sum of ``value`` over the rows before, in the order of
    ``order`` (within ``group``, which must then be the first order column).

    The rows are range partitioned, so no key, however frequent, needs one task.
    Each partition sums its own rows; the totals per partition and group (a table
    no longer than partitions plus groups) give every partition its base.
    ``df`` should be a stored table: range partitioning reads it twice.
    """
    spark = df.sparkSession
    key = group or "_all"
    src = df if group else df.withColumn("_all", F.lit(0))
    fields = [*src.schema.fields, T.StructField("pid", T.IntegerType()), T.StructField("start", T.LongType())]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, last, carry = TaskContext.get().partitionId(), object(), 0
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(b.schema.get_field_index(value)).to_numpy(zero_copy_only=False).astype(np.int64)
            k = b.column(b.schema.get_field_index(key)).to_pylist()
            run = np.cumsum(v) - v
            first = np.array([0, *[i for i in range(1, len(k)) if k[i] != k[i - 1]]])
            run = run - np.repeat(run[first], np.diff([*first, len(k)]))
            if k[0] == last:
                run[: first[1] if len(first) > 1 else None] += carry
            last, carry = k[-1], int(run[-1] + v[-1])
            more = [pa.array(np.full(len(k), pid, np.int32)), pa.array(run)]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, "pid", "start"])

    local = stage(src.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(sums, T.StructType(fields)))
    totals = local.groupBy(key, "pid").agg(F.sum(value).alias("t")).collect()
    base, acc = [], {}
    for r in sorted(totals, key=lambda r: r["pid"]):
        base.append((r[key], r["pid"], acc.get(r[key], 0)))
        acc[r[key]] = acc.get(r[key], 0) + r["t"]
    kind = src.schema[key].dataType
    schema = T.StructType(
        [T.StructField("_k", kind), T.StructField("_p", T.IntegerType()), T.StructField("_b", T.LongType())]
    )
    bases = F.broadcast(spark.createDataFrame(base, schema))
    out = local.join(bases, F.col(key).eqNullSafe(F.col("_k")) & (F.col("pid") == F.col("_p")))
    return out.withColumn("start", F.col("start") + F.col("_b")).drop("_k", "_p", "_b", "pid", "_all")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the links (``u``, ``v``, both long).

    Returns one row per linked node: ``node`` and ``label``, the smallest node of its
    component. Every round points each node at its smallest neighbour, shortens the
    pointers, and contracts the links to the pointers' ends; a round at least halves
    the nodes. Minima are combined before the shuffle, so a hub is no single task.
    """
    cur = stage(edges.where("u <> v").select("u", "v").distinct())
    labels = None
    while not is_empty(cur):
        both = cur.union(cur.select(F.col("v"), F.col("u")))
        up = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("p")))
        while True:
            nxt = up.select(F.col("u").alias("p"), F.col("p").alias("q"))
            up2 = stage(up.join(nxt, "p").select("u", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved")))
            moved = not is_empty(up2.where("moved"))
            up = up2.drop("moved")
            if not moved:
                break
        if labels is None:
            labels = up.select(F.col("u").alias("node"), F.col("p").alias("label"))
        else:
            step = up.select(F.col("u").alias("label"), F.col("p").alias("to"))
            labels = stage(
                labels.join(step, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
            )
        a = up.select("u", F.col("p").alias("pu"))
        b = up.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        cur = stage(
            cur.join(a, "u").join(b, "v").where("pu <> pv").select(F.col("pu").alias("u"), F.col("pv").alias("v")).distinct()
        )
    if labels is None:
        return cur.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels
