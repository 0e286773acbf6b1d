"""Substring deduplication by content-defined chunks.

A gear hash rolls over the text's bytes; where its tested bits are zero a chunk ends, so
chunk borders move with the content and an insertion disturbs its neighbourhood only.
Chunks are compared by a 128-bit digest over the whole table. Where a run of repeated
chunks ends, the bytes beside it are compared with those beside the first copy, so the run
grows to the passage's own ends. A passage of at least ``min_words`` words is removed
everywhere but at its first occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import discard
from .common import stage
from .packing import slices

WINDOW = 16  # bytes that decide a border
MASK_BITS = 5  # a border every 32 bytes on average, after the least length
MIN_CHUNK = 16
MAX_CHUNK = 256
MIN_WORDS = 15
#: Bytes of the first copy compared beside a repeated chunk. After one, borders agree to the
#: passage's end, so the rest lies in one chunk; before one, borders may have to fall in step.
BEFORE, AFTER = 2 * MAX_CHUNK, MAX_CHUNK
GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear(raw: np.ndarray) -> np.ndarray:
    """The gear hash at each byte: sum of GEAR[byte] << age over the last WINDOW bytes.

    Twice as many bytes are covered with each doubling step.
    """
    h = GEAR[raw]
    reach = 1
    while reach < WINDOW:
        h[reach:] += h[:-reach] << np.uint32(reach)
        reach *= 2
    return h


def borders(raw: np.ndarray) -> np.ndarray:
    """Ends of the chunks of UTF-8 bytes; always at a character's end."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64)
    after = np.flatnonzero((raw & 0xC0) != 0x80)  # a character starts here, so one may end before
    hit = (gear(raw) >> np.uint32(WINDOW - MASK_BITS)) & np.uint32((1 << MASK_BITS) - 1) == 0
    ends = np.flatnonzero(hit) + 1
    ends = ends[ends < n]
    ends = ends[(raw[ends] & 0xC0) != 0x80].tolist()
    ends.append(n)
    out, last = [], 0
    for e in ends:
        if e - last < MIN_CHUNK and e < n:
            continue
        while e - last > MAX_CHUNK:
            last = int(after[np.searchsorted(after, last + MAX_CHUNK, "right") - 1])
            out.append(last)
        if e > last:
            out.append(e)
            last = e
    return np.array(out, np.int64)


def chunks(docs: DataFrame) -> DataFrame:
    """Per row (``doc_id``, ``text_hash``, UTF-8 ``t``): the digests' halves in chunk order."""
    import xxhash

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = xxhash.xxh3_128_digest
        for b in batches:
            for part in slices(b, 2):
                size, digests = [], []
                for x in part.column(2).to_pylist():
                    x = x or b""
                    at = borders(np.frombuffer(x, np.uint8)).tolist()
                    size.append(len(at))
                    digests.extend([h(x[s:e]) for s, e in zip([0, *at], at, strict=False)])
                offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
                both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(both[:, k]))) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *lists], ["doc_id", "text_hash", "h1", "h2"])

    return docs.mapInArrow(work, "doc_id long, text_hash long, h1 array<long>, h2 array<long>")


def _marked(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """Texts with their repeated chunks: cut the runs, report what was done."""
    mark = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for b in batches:
        for part in slices(b, 0):
            out = [
                cut_text(t, f, min_words) for t, f in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)
            ]
            texts, spans, sources, dup = zip(*out, strict=True)
            new = [pa.array(texts, pa.string()), pa.array(spans, mark), pa.array(sources, pa.list_(pa.int64())), pa.array(dup, pa.int64())]
            yield pa.RecordBatch.from_arrays([*part.columns[2:], *new], [*part.schema.names[2:], *ADDED])


def beside(wanted: DataFrame) -> DataFrame:
    """For each wanted chunk (``want``: digest halves, place, sides) of a text ``t``: the bytes beside it."""
    schema = T._parse_datatype_string("h1 long, h2 long, left binary, right binary")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        for b in batches:
            for part in slices(b, 0):
                rows = []
                for t, want in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    begin = [0, *borders(np.frombuffer(t, np.uint8)).tolist()]
                    for x in want:
                        lo, hi = begin[x["i"]], begin[x["i"] + 1]
                        left = t[max(0, lo - BEFORE) : lo] if x["l"] else None
                        rows.append((x["h1"], x["h2"], left, t[hi : hi + AFTER] if x["r"] else None))
                cols = zip(*rows, strict=True) if rows else [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], schema.names)

    return wanted.mapInArrow(work, schema)


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)))


def cut_text(text: bytes | None, found: list[dict] | None, min_words: int) -> tuple:
    """Text without its later copies, removed byte spans, documents of the first copies,
    and bytes that occur elsewhere (first copies included).

    ``found`` has the repeated chunks: place ``i``, whether the chunk is a later copy, the
    document of the first, and the bytes beside the first (``left``, ``right``) where they
    may differ. Later copies grow into the bytes that agree; spans are drawn in to whole words.
    """
    if text is None or not found:
        return (text.decode("utf-8", "replace") if text is not None else None, [], [], 0)
    found = sorted(found, key=lambda x: x["i"])
    begin = [0, *borders(np.frombuffer(text, np.uint8)).tolist()]
    parts: list[list] = []  # runs of first or of later copies: start, end, later, documents
    for k, x in enumerate(found):
        lo, hi = begin[x["i"]], begin[x["i"] + 1]
        if x["later"]:
            if x.get("left") and not (k and found[k - 1]["i"] + 1 == x["i"] and found[k - 1]["later"]):
                lo -= common(x["left"][::-1], text[max(0, lo - BEFORE) : lo][::-1])
            if x.get("right") and not (k + 1 < len(found) and found[k + 1]["i"] == x["i"] + 1 and found[k + 1]["later"]):
                hi += common(x["right"], text[hi : hi + AFTER])
        docs = {x["doc"]} if x["later"] and x["doc"] is not None else set()
        while parts and parts[-1][2] and x["later"] and parts[-1][1] >= lo:
            last = parts.pop()
            lo, hi, docs = min(lo, last[0]), max(hi, last[1]), docs | last[3]
        parts.append([lo, hi, x["later"], docs])
    runs: list[list] = []  # passages: start, end, parts
    for x in sorted(parts, key=lambda x: x[:2]):
        if runs and runs[-1][1] >= x[0]:
            runs[-1][1] = max(runs[-1][1], x[1])
            runs[-1][2].append(x)
        else:
            runs.append([x[0], x[1], [x]])
    spans: list[tuple[int, int]] = []
    sources: set[int] = set()
    repeated = 0
    for start, end, run in runs:
        if len(text[start:end].split()) < min_words:
            continue
        repeated += end - start
        for lo, hi, later, docs in run:
            if not later:
                continue
            lo = max(lo, spans[-1][1]) if spans else lo
            while lo > 0 and lo < hi and not text[lo - 1 : lo].isspace():
                lo += 1
            while hi < len(text) and hi > lo and not text[hi : hi + 1].isspace():
                hi -= 1
            if hi > lo:
                spans.append((lo, hi))
                sources.update(docs)
    keep, last = [], 0
    for lo, hi in spans:
        keep.append(text[last:lo])
        last = hi
    keep.append(text[last:])
    marks = [{"start": lo, "end": hi} for lo, hi in spans]
    return b"".join(keep).decode("utf-8", "replace"), marks, sorted(sources), repeated


ADDED = ("kept_text", "removed", "first_docs", "repeated_bytes")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of ``docs`` with the text cut, and what was found.

    Added: ``kept_text`` (the text without later copies of passages), ``removed`` (byte
    spans of the UTF-8 text), ``first_docs`` (ids of the documents that keep the removed
    passages), ``repeated_bytes`` (bytes in passages that occur elsewhere too; of a first copy
the whole chunks). The first
    copy is the one in the smallest (doc_id, row, place), null ids last; repeats inside
    one text count. Null texts stay null, empty ones empty; rows equal in id and text get
    the same result; an empty table gives an empty result. Columns of the added names in
    ``docs`` are replaced.

    Only the first half of a digest is counted over all chunks; whole digests decide
    among the chunks whose first half occurs again. Counts are combined before the
    shuffle, and a frequent chunk meets one row in the joins, so it can be split.
    """
    base = docs.drop(*ADDED)
    keys = (F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"))
    cut = chunks(base.select(*keys, F.col(text_col).cast("binary").alias("t")))
    cut = stage(cut.withColumn("uid", F.monotonically_increasing_id()))
    halves = cut.select(F.explode("h1").alias("h1")).groupBy("h1").agg(F.count("*").alias("n"))
    flat = cut.select("uid", F.posexplode(F.arrays_zip("h1", "h2")).alias("i", "h"))
    flat = flat.select("uid", "i", F.col("h.h1").alias("h1"), F.col("h.h2").alias("h2"))
    again = flat.join(halves.where("n > 1").select("h1"), "h1")
    again = again.join(cut.select("uid", "doc_id", "text_hash"), "uid")
    near = Window.partitionBy("uid").orderBy("i")  # the chunks of one row
    short = F.col("h1").bitwiseAND((1 << 31) - 1).cast("int")  # tells neighbours apart, and is stored for each chunk
    beside_it = [F.when(fn("i").over(near) == F.col("i") + d, fn(short).over(near)) for fn, d in ((F.lag, -1), (F.lead, 1))]
    again = stage(again.withColumns({"p1": beside_it[0], "n1": beside_it[1]}))
    discard(cut)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "uid", "i", "text_hash", "p1", "n1")).alias("first")
    differs = [((F.count(c) < F.count("*")) | (F.min(c) != F.max(c))).alias(side) for c, side in (("p1", "l"), ("n1", "r"))]
    twice = stage(again.groupBy("h1", "h2").agg(F.count("*").alias("n"), first, *differs).where("n > 1").drop("n"))
    ends = twice.where("l or r")
    want = ends.groupBy(
        F.coalesce("first.doc_id", F.lit(-1)).alias("_i"), F.col("first.no").alias("_n"), F.col("first.text_hash").alias("_h")
    ).agg(F.collect_list(F.struct("h1", "h2", "first.i", F.coalesce("l", F.lit(True)).alias("l"), F.coalesce("r", F.lit(True)).alias("r"))).alias("want"))
    tagged = base.withColumns(
        {"_i": F.coalesce(keys[0], F.lit(-1)), "_n": F.col(id_col).cast("long").isNull(), "_h": keys[1]}
    )
    want = stage(want)
    wanted = tagged.join(want, ["_i", "_n", "_h"]).select(F.col(text_col).cast("binary").alias("t"), "want")
    sides = stage(beside(wanted).groupBy("h1", "h2").agg(F.max("left").alias("left"), F.max("right").alias("right")))
    discard(want)
    later = (F.col("uid") != F.col("first.uid")) | (F.col("i") != F.col("first.i"))
    same = [F.coalesce(F.col(c) == F.col(f"first.{c}"), F.lit(False)) for c in ("p1", "n1")]
    hit = F.struct(
        "i", later.alias("later"), F.col("first.doc_id").alias("doc"),
        F.when(later & ~same[0], F.col("left")).alias("left"), F.when(later & ~same[1], F.col("right")).alias("right"),
    )
    twice = twice.select("h1", "h2", "first").join(sides, ["h1", "h2"], "left")
    hits = again.join(twice, ["h1", "h2"]).groupBy("doc_id", "text_hash", "uid").agg(F.collect_list(hit).alias("found"))
    hits = hits.groupBy("doc_id", "text_hash").agg(F.min_by("found", "uid").alias("_found"))
    hits = hits.select(F.coalesce("doc_id", F.lit(-1)).alias("_i"), F.col("doc_id").isNull().alias("_n"), F.col("text_hash").alias("_h"), "_found")
    both = tagged.join(hits, ["_i", "_n", "_h"], "left")
    both = both.select(F.col(text_col).cast("binary").alias("_t"), "_found", *[base[c] for c in base.columns])
    schema = T.StructType(
        [
            *base.schema.fields,
            *T._parse_datatype_string(
                "kept_text string, removed array<struct<start:int,end:int>>, first_docs array<long>, repeated_bytes long"
            ).fields,
        ]
    )
    return both.mapInArrow(lambda b: _marked(b, min_words), schema)


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with each text cut to what no earlier document holds; same columns."""
    out = deduplicate(docs, id_col, text_col, min_words)
    cols = {text_col: F.col("kept_text")}
    if "n_chars" in docs.columns:
        cols["n_chars"] = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
    return out.withColumns(cols).select(*docs.columns)
