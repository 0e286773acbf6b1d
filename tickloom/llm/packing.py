"""Packing along a space-filling curve.

A document's token counts are hashed into a short vector, projected to four
dimensions, and placed on a Hilbert curve. The documents are laid end to end along the
curve and cut every ``length`` tokens, so neighbours on the curve share sequences and
only the very last sequence has padding.
"""

from __future__ import annotations

import os
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import running_start, stage

DIMS = 4
HASHED = 512
CURVE_BITS = 15
EOS = 1


def ragged(values: np.ndarray, count: np.ndarray, index: np.ndarray, group: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Lists ``index`` of a table of lists, end to end, and the length of each ``group`` of them."""
    n = count[index]
    ends = np.cumsum(n)
    first = (np.cumsum(count) - count)[index]
    out = values[np.repeat(first - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
    return out, n.reshape(-1, group).sum(axis=1)


class WordTokenizer:
    """Token ids of many whole texts at once, each different word encoded once.

    A tokenizer that drops white space and never merges across it lets texts be cut at
    ASCII white space, in Arrow, and a batch's words be put in a dictionary. Words of
    plain characters are encoded in one call, side by side, and cut apart by counting the
    tokens that end a piece; other words one by one. What a tokenizer allows is probed
    when it is loaded; one that keeps white space gets whole texts.
    """

    PIECE = r"'(?:s|t|re|ve|m|ll|d)|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
    PLAIN = "^[\x21-\x7e\u00c0-\u012f\u0131-\u0148\u014a-\u017e]+$"  # one form, one lower case each

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if max(size, EOS + 1) <= 1 << 16 else np.dtype("<u4")
        self.size = size
        same = lambda x, *parts: self.ids(x) == [i for p in parts for i in self.ids(p)]
        self.by_words = same("Ab, c1\n\t\x0b\x0c\r é's  <x>", "Ab,", "c1", "é's", "<x>") and same(" ab ", "ab")
        self.folds = self.by_words and "Lowercase" in str(self.tok.normalizer) and same("AB éZ", "ab éz")
        self.ends = np.zeros(size, bool)
        suffix = getattr(self.tok.model, "end_of_word_suffix", None)
        if suffix:
            self.ends[[i for t, i in self.tok.get_vocab().items() if t.endswith(suffix)]] = True
        self.bare = Tokenizer(self.tok.model)  # for words of a to z, which nothing else changes
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        probe = "ab thing qzxjkw notwithstanding e"
        self.bare_ok = self.ends.any() and self.bare.encode(probe, add_special_tokens=False).ids == self.ids(probe)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]

    def ids(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, encoded apart, and how many each has."""
        got = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for g in got for i in g], np.int64), np.array([len(g) for g in got], np.int64)

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different words and how many each has: stems and closing marks apart."""
        stems = pc.utf8_rtrim(words, characters=string.punctuation)
        cut = pc.match_substring_regex(stems, "[0-9a-z\u00e0-\u00f6]$")  # the tokenizer cuts after these
        for s in self.special:
            cut = pc.and_not(cut, pc.match_substring(words, s))
        stems = pc.if_else(cut, stems, words)
        short = np.flatnonzero(pc.not_equal(stems, words).to_numpy(zero_copy_only=False))
        some = pa.array(short)
        pairs = zip(words.take(some).to_pylist(), stems.take(some).to_pylist(), strict=True)
        marks = pa.array([w[len(x) :] for w, x in pairs], pa.string()).dictionary_encode()
        stems = stems.dictionary_encode()
        ids, count = self.stems(stems.dictionary)
        mark_ids, mark_count = self.each(["", *marks.dictionary.to_pylist()])
        both = np.full((len(words), 2), len(count))
        both[:, 0] = stems.indices.to_numpy()
        both[short, 1] += 1 + marks.indices.to_numpy()
        return ragged(np.concatenate([ids, mark_ids]), np.concatenate([count, mark_count]), both.ravel(), 2)

    def stems(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        letters = pc.match_substring_regex(words, "^[a-z]+$").to_numpy(zero_copy_only=False) & self.bare_ok
        plain = pc.match_substring_regex(words, self.PLAIN)
        for s in self.special:
            plain = pc.and_not(plain, pc.match_substring(words, s))
        plain = plain.to_numpy(zero_copy_only=False) & self.ends.any() & ~letters
        count = np.zeros(len(words), np.int64)
        parts = []
        for tok, which in ((self.bare, letters), (self.tok, plain)):
            at = np.flatnonzero(which)
            if not len(at):
                continue
            some = words.take(pa.array(at))
            pieces = np.ones(len(at), np.int64)
            if tok is self.tok:
                pieces = pc.count_substring_regex(some, self.PIECE).to_numpy(zero_copy_only=False).astype(np.int64)
            line = pc.binary_join(pa.ListArray.from_arrays([0, len(some)], some), " ")[0].as_py()
            ids = np.array(tok.encode_batch_fast([line], add_special_tokens=False)[0].ids, np.int64)
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == pieces.sum() and pieces.min() > 0:
                count[at] = np.diff(cut[np.cumsum(pieces) - 1], prepend=0)
                parts.append((at, ids))
            else:  # the count of pieces is off somewhere
                which[:] = False
        at = np.flatnonzero(~(plain | letters))
        if len(at):
            ids, count[at] = self.each(words.take(pa.array(at)).to_pylist())
            parts.append((at, ids))
        start = np.cumsum(count) - count
        out = np.zeros(int(count.sum()), np.int64)
        for at, ids in parts:
            n = count[at]
            out[np.repeat(start[at] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return out, count

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text, the closing id included."""
        texts = pc.fill_null(texts, "")
        if not self.by_words:
            ids, count = self.each(texts.to_pylist())
        else:
            if self.folds:
                low = pc.ascii_lower(texts)
                for s in self.special:  # unless that makes a special token
                    low = pc.if_else(pc.greater(pc.count_substring(low, s), pc.count_substring(texts, s)), texts, low)
                texts = low
            lists = pc.ascii_split_whitespace(texts)
            offsets = lists.offsets.to_numpy()
            coded = lists.values.slice(0, offsets[-1]).dictionary_encode()
            ids, size = self.words(coded.dictionary)
            ids, n = ragged(ids, size, coded.indices.to_numpy(zero_copy_only=False))
            count = np.diff(np.concatenate([[0], np.cumsum(n)])[offsets])
        ids = ids.astype(self.dtype)
        stops = np.cumsum(count)
        out = np.full(len(ids) + len(count), EOS, self.dtype)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(count)), count)] = ids
        return np.split(out, (stops + np.arange(1, len(count) + 1))[:-1])


@lru_cache(maxsize=2)
def tokenizer_of(path: str) -> WordTokenizer:
    """One tokenizer per Python worker."""
    return WordTokenizer(path)


def projections(size: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and sign of each token, and the projection of the buckets."""
    rng = np.random.default_rng(seed)
    bucket = rng.integers(0, HASHED, size)
    sign = rng.choice(np.array([-1.0, 1.0]), size)
    return bucket, sign, rng.normal(size=(HASHED, DIMS)) / np.sqrt(HASHED)


def tokenized(docs: DataFrame, tokenizer: str, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, packed ``ids``, their number ``n`` and the point ``p0`` .. ``p3``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer_of(tokenizer)
        bucket, sign, proj = projections(tok.size)
        for b in batches:
            for part in slices(b, 1):
                ids = tok.encode(part.column(1))
                points = np.zeros((len(ids), DIMS))
                for i, x in enumerate(ids):
                    t = x[:-1]
                    if len(t):
                        v = np.bincount(bucket[t], weights=sign[t], minlength=HASHED)
                        v = np.sign(v) * np.sqrt(np.abs(v))
                        points[i] = v @ proj / max(np.linalg.norm(v), 1e-12)
                n = np.array([len(x) for x in ids], np.int64)
                cols = [part.column(0), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(n)]
                cols += [pa.array(np.round(points[:, k], 9)) for k in range(DIMS)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "ids", "n", *[f"p{k}" for k in range(DIMS)]])
                del ids, cols
                pa.default_memory_pool().release_unused()  # the worker lives on, and other stages need the room

    schema = "doc_id long, ids binary, n long, " + ", ".join(f"p{k} double" for k in range(DIMS))
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(work, schema)


def slices(batch: pa.RecordBatch, col: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``most`` bytes, by the lengths of a binary column."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(col)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < batch.num_rows:
        base = size[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(size, base + most)))
        yield batch.slice(a, b - a)
        a = b


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of integer points (n, dims), each below 2**bits."""
    x = [cells[:, k].astype(np.int64) for k in range(cells.shape[1])]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | (((x[i] ^ t) >> b) & 1)
    return key


def pack(
    docs: DataFrame, tokenizer: str, length: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece of a document in a sequence of ``length`` tokens.

    Columns: ``doc_id``, ``start`` (ids of the document before the piece), ``length``,
    ``ids`` (little-endian unsigned 32-bit), ``doc_tokens``, ``sequence_id``,
    ``offset``, ``curve_key``. Null and empty texts are documents of one closing id;
    texts of any length are cut over as many sequences as they need; repeated rows and
    rows with a null doc_id are packed like others; an empty table gives no pieces.
    Ties on the curve are ordered by doc_id. Other columns are ignored.
    """
    tokens = stage(tokenized(docs, tokenizer, id_col, text_col).withColumn("uid", F.monotonically_increasing_id()))
    stats = [f(F.col(f"p{k}")).alias(f"{n}{k}") for k in range(DIMS) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    row = tokens.agg(*stats).first()
    mean = np.array([row[f"m{k}"] or 0.0 for k in range(DIMS)]).round(6)
    sd = np.array([row[f"s{k}"] or 1.0 for k in range(DIMS)]).round(6)
    sd[sd <= 0] = 1.0

    @F.pandas_udf("long")
    def curve(*p: pd.Series) -> pd.Series:
        z = (np.column_stack([x.to_numpy(float) for x in p]) - mean) / sd
        side = 1 << CURVE_BITS
        cells = np.clip(side / (1 + np.exp(-1.702 * z)), 0, side - 1).astype(np.int64)
        return pd.Series(hilbert(cells, CURVE_BITS))

    points = tokens.select("uid", "doc_id", "n", curve(*[f"p{k}" for k in range(DIMS)]).alias("curve_key"))
    placed = running_start(stage(points), ["curve_key", "doc_id", "n", "uid"], "n")
    rows = tokens.select("uid", "doc_id", "ids", "n").join(placed.select("uid", "start", "curve_key"), "uid")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 1):
                n = part.column(2).to_numpy()
                at = part.column(3).to_numpy()
                first, last = at // length, (at + n - 1) // length
                count = last - first + 1
                row = np.repeat(np.arange(len(n)), count)
                seq = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]
                lo = np.maximum(at[row], seq * length)
                hi = np.minimum((at + n)[row], (seq + 1) * length)
                ids = [
                    np.frombuffer(x, "<u2" if len(x) == 2 * m else "<u4").astype("<u4")
                    for x, m in zip(part.column(1).to_pylist(), n, strict=True)
                ]
                start = lo - at[row]
                pieces = [ids[r][s : s + k].tobytes() for r, s, k in zip(row, start, hi - lo, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(row)), pa.array(start), pa.array(hi - lo), pa.array(pieces, pa.binary()),
                        pa.array(n[row]), pa.array(seq), pa.array(lo - seq * length), part.column(4).take(pa.array(row)),
                    ],
                    ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "curve_key"],
                )

    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, curve_key long"
    return rows.select("doc_id", "ids", "n", "start", "curve_key").mapInArrow(cut, schema)
