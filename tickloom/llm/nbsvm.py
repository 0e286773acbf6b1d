"""Quality classifier: naive Bayes support vectors.

Indicators of byte n-grams and words are scaled by their class log-count ratio
``log((p + a) / |p|) - log((q + a) / |q|)``, and a linear hinge-loss model over the
scaled indicators is fitted by dual coordinate descent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packing import slices

FEATURE_BITS = 18
GRAMS = (1, 2, 3, 4)
MAX_TRAIN_ROWS = 8192  # labelled rows that the fit reads at most
PACKED = 1 << (FEATURE_BITS - 3)  # bytes of a row's indicators as bits: the most a row takes
FIELDS = 1 << FEATURE_BITS


def features(text: bytes | None, seen: np.ndarray) -> np.ndarray:
    """Sorted slots of the text's n-gram and word indicators (whole text, bytes).

    ``seen`` is a scratch array of ``FIELDS`` false values, returned that way. Slot 0
    is the bias; slots 1 to 3 mark any word said 2, 3 or 5 times running. Windows over the bytes are hashed at once; so are words and word pairs,
    as differences of a running polynomial hash.
    """
    seen[0] = True
    raw = np.frombuffer(text or b"", np.uint8)
    for lo in range(0, len(raw), 1 << 20):
        b = raw[lo : lo + (1 << 20) + max(GRAMS)].astype(np.uint32)
        code = np.zeros(len(b), np.uint32)
        for n in GRAMS:
            if len(b) < n:
                break
            code = code[: len(b) - n + 1] * np.uint32(257) + b[n - 1 :] + np.uint32(1)
            seen[(code * np.uint32(0x9E3779B1) + np.uint32(n)) >> np.uint32(32 - FEATURE_BITS)] = True
    if len(raw):
        space = (raw == 32) | ((raw >= 9) & (raw <= 13))
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
        first, stop = edge[::2], edge[1::2]
        if len(first):
            sums = np.add.reduceat(raw.astype(np.uint64) * powers(len(raw)), np.ravel(np.column_stack([first, np.minimum(stop, len(raw) - 1)])))[::2]
            whole = stop == len(raw)
            sums[whole] = [np.sum(raw[f:].astype(np.uint64) * powers(len(raw))[f:]) for f in first[whole]]
            word = sums * inverses(len(raw))[first]
            pair = word[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[1:]
            same = word[:-1] == word[1:]
            seen[1] = same.any()
            seen[2] = (same[:-1] & same[1:]).any()
            seen[3] = (same[:-3] & same[1:-2] & same[2:-1] & same[3:]).any()
            for h in (word, pair):
                seen[((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - FEATURE_BITS)] = True
    groups = np.flatnonzero(seen.view(np.uint64))  # eight flags at a time: most are unset
    inside = seen.reshape(-1, 8)[groups]
    row, col = np.nonzero(inside)
    seen.reshape(-1, 8)[groups] = False
    return groups[row] * 8 + col


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> np.ndarray:
    """Powers of an odd base modulo 2**64, and with ``inverses`` those of its inverse."""
    if len(_POWERS[0]) < n:
        m = 1 << max(16, (n - 1).bit_length())
        base = 0x2545F4914F6CDD1D
        for k, x in enumerate((base, pow(base, -1, 1 << 64))):
            _POWERS[k] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(m - 1, x, np.uint64)]), dtype=np.uint64)
    return _POWERS[0][:n]


def inverses(n: int) -> np.ndarray:
    powers(n)
    return _POWERS[1][:n]


def packed(slots: np.ndarray) -> bytes:
    """Slots as 32-bit numbers, or as bits where that is shorter."""
    if 4 * len(slots) < PACKED:
        return slots.astype("<u4").tobytes()
    bits = np.zeros(FIELDS, np.uint8)
    bits[slots] = 1
    return np.packbits(bits).tobytes()


def unpacked(row: bytes | np.ndarray) -> np.ndarray:
    if isinstance(row, np.ndarray):
        return row
    if len(row) < PACKED:
        return np.frombuffer(row, "<u4")
    return np.flatnonzero(np.unpackbits(np.frombuffer(row, np.uint8)))


def dual_descent(rows: list[bytes] | list[np.ndarray], y: np.ndarray, ratio: np.ndarray, each: np.ndarray, c: np.ndarray, epochs: int, seed: int) -> np.ndarray:
    """Weights of min |w|^2 / 2 + sum c_i max(0, 1 - y_i w x_i), x_i = each_i * ratio on row i's slots.

    One dual variable is moved at a time to its best value in [0, c_i], in random order.
    """
    rng = np.random.default_rng(seed)
    w = np.zeros(len(ratio))
    alpha = np.zeros(len(rows))
    norm = np.array([float(((ratio[unpacked(r)] * e) ** 2).sum()) for r, e in zip(rows, each, strict=True)])
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            if norm[i] <= 0:
                continue
            at = unpacked(rows[i])  # rows stay packed: they may be long
            value = ratio[at] * each[i]
            grad = y[i] * (w[at] @ value) - 1
            new = min(max(alpha[i] - grad / norm[i], 0.0), c[i])
            step = new - alpha[i]
            if step:
                w[at] += step * y[i] * value
                alpha[i] = new
                moved = max(moved, abs(step) * norm[i])
        if moved < 1e-3:
            break
    return w


def logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability of y = 1 given the margin (Newton steps)."""
    t = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y <= 0).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - t) * margin).sum(), (p - t).sum()])
        d = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(d * margin * margin).sum(), (d * margin).sum()], [(d * margin).sum(), d.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-3), b


@dataclass
class Model:
    """Weights by slot (ratio times linear weight) and the margin's logistic."""

    weight: np.ndarray
    slope: float
    offset: float

    def score(self, slots: np.ndarray) -> float:
        z = self.slope * float(self.weight[slots].sum() / np.sqrt(len(slots))) + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def fit(rows: list[bytes] | list[np.ndarray], label: np.ndarray, cost: float = 4.0, epochs: int = 30, seed: int = 3, smooth: float = 1.0) -> Model:
    """Fit on slot lists and labels 0/1; with one class only, the score is that class's rate."""
    w = np.zeros(FIELDS)
    if len(rows) == 0 or label.min() == label.max():
        rate = (label.sum() + 1) / (len(rows) + 2)
        return Model(w, 1.0, float(np.log(rate / (1 - rate))))
    p, q = np.full(FIELDS, smooth), np.full(FIELDS, smooth)
    for r, t in zip(rows, label, strict=True):
        (p if t else q)[unpacked(r)] += 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    ratio[0] = 1.0
    ratio[(p + q) <= 2 * smooth + 1] = 0.0  # seen in one row only
    y = np.where(label > 0, 1.0, -1.0)
    each = np.array([1 / np.sqrt(len(unpacked(r))) for r in rows])

    def train(at: np.ndarray) -> np.ndarray:
        return dual_descent([rows[i] for i in at], y[at], ratio, each[at], np.full(len(at), cost), epochs, seed)

    fold = np.random.default_rng(seed).integers(0, 3, len(rows))
    margin = np.zeros(len(rows))
    for k in range(3):
        w = train(np.flatnonzero(fold != k)) * ratio
        for i in np.flatnonzero(fold == k):
            margin[i] = w[unpacked(rows[i])].sum() * each[i]
    slope, offset = logistic(margin, y)
    return Model(train(np.arange(len(rows))) * ratio, slope, offset)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learned from: crc32(doc_id as text) mod 3 is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS, seed: int = 3) -> Model:
    """Fit on at most ``max_rows`` labelled rows that are not held out, chosen by hash.

    The fit is one task's work on that bounded sample. Rows with a null id or label are
    left out; of several labels of one document the smallest counts; of several documents
    of one id one is used.
    """
    spark = docs.sparkSession
    mine = labels.where(~held_out()).where("doc_id is not null and quality is not null")
    mine = mine.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = mine.count()
    pick = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 31))
    if n > max_rows:
        mine = mine.where(pick < int((1 << 31) * max_rows / n))
    sample = mine.orderBy(pick, "doc_id").limit(max_rows).collect()
    chosen = F.broadcast(spark.createDataFrame([(r[0], int(r[1])) for r in sample], "doc_id long, quality int"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(FIELDS, bool)
        for b in batches:
            for part in slices(b, 2):
                rows = pa.array([packed(features(x, seen)) for x in part.column(2).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), rows], ["doc_id", "quality", "slots"])

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows = (
        text.join(chosen, "doc_id").select("doc_id", "quality", "text")
        .mapInArrow(work, "doc_id long, quality int, slots binary").dropDuplicates(["doc_id"])
        .repartition(1).sortWithinPartitions("doc_id")  # at most max_rows rows of at most PACKED bytes
    )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, label = [], []
        for b in batches:
            label += b.column(1).to_pylist()
            slots += b.column(2).to_pylist()
        m = fit(slots, np.array(label, int))
        yield pa.RecordBatch.from_pydict({"w": [m.weight.astype("<f4").tobytes()], "slope": [m.slope], "offset": [m.offset]})

    got = rows.mapInArrow(learn, "w binary, slope double, offset double").collect()
    if not got:
        return fit([], np.zeros(0, int))
    return Model(np.frombuffer(bytes(got[0]["w"]), "<f4"), got[0]["slope"], got[0]["offset"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.weight.astype(np.float32), model.slope, model.offset))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, m = np.zeros(FIELDS, bool), Model(*shared.value)
        for b in batches:
            for part in slices(b, 1):
                s = np.array([m.score(features(x, seen)) for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    cols = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary"))
    return cols.mapInArrow(work, "doc_id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """Score every row of ``docs`` by a model fitted on ``labels`` (doc_id, quality).

    Null and empty texts are scored on the bias alone; long texts as a whole; repeated
    rows get one result each; without usable labels every score is 0.5; an empty table
    gives an empty result. Other columns are ignored, and no label reaches a score.
    """
    return score(docs, train(docs, labels, max_rows)).withColumn("held_out", held_out())


def accepted(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS, trained_on: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` that the classifier predicts good, all columns.

    Null and empty texts are judged on the bias alone, like in ``classify``; repeated rows
    share their fate; an empty table gives an empty result.
    """
    model = train(docs if trained_on is None else trained_on, labels, max_rows)
    shared = docs.sparkSession.sparkContext.broadcast((model.weight.astype(np.float32), model.slope, model.offset))
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, m = np.zeros(FIELDS, bool), Model(*shared.value)
        for b in batches:
            for part in slices(b, at):
                texts = part.column(at).cast(pa.binary()).to_pylist()
                yield part.filter(pa.array([m.score(features(x, seen)) >= 0.5 for x in texts], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
