from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from tickloom.llm import packing, queries

from .conftest import SF

PATH = queries.tokenizer()


def whole(rows, texts, length):
    """Every id in exactly one piece, sequences gapless, one short sequence at most."""
    tok = Tokenizer.from_file(PATH)
    seqs, by = {}, {}
    for r in rows:
        assert r.start + r.length <= r.doc_tokens and len(r.ids) == 4 * r.length > 0
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by.setdefault(r.doc_id, []).append(r)
    short = 0
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= length
        short += at < length
    assert short <= 1
    got = []
    for parts in by.values():
        parts.sort(key=lambda r: r.start)
        got += np.frombuffer(b"".join(bytes(r.ids) for r in sorted(parts, key=lambda r: (r.sequence_id, r.offset))), "<u4").tolist()
    want = [i for t in texts for i in [*tok.encode(t or "", add_special_tokens=False).ids, 1]]
    assert sorted(got) == sorted(want)
    return by, tok


def test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.pack(docs, PATH, 512).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    by, tok = whole(rows, texts.values(), 512)
    for k, parts in by.items():
        ids = np.frombuffer(b"".join(bytes(r.ids) for r in parts), "<u4").tolist()
        assert ids == [*tok.encode(texts[k], add_special_tokens=False).ids, 1]
    again = packing.pack(docs.repartition(7), PATH, 512).collect()
    key = lambda r: (r.doc_id, r.start, r.length, r.sequence_id, r.offset, zlib.crc32(bytes(r.ids)))
    assert sorted(map(key, rows)) == sorted(map(key, again))  # no matter how the input is cut


def test_words_apart_equal_whole_texts():
    rng = random.Random(3)
    parts = ["a", "B", "é", "É", " ", "\n", "\x1c", "\xa0", "'s", "'", "12", "!?", "ß", "Σ", "日本", "<|endoftext|>", "\t", "́", "한", "🙂", "İ", "ŉ", "×", "$$$", "'ve", "1a", "|", "<|ENDOFTEXT|>", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    tok = packing.WordTokenizer(PATH)
    got = [x[:-1].tolist() for x in tok.encode(pa.array(texts))]
    assert got == [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def test_hilbert_is_a_curve():
    side = 8
    cells = np.array([(a, b, c) for a in range(side) for b in range(side) for c in range(side)])
    key = packing.hilbert(cells, 3)
    assert sorted(key) == list(range(side**3))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()  # each step goes to a neighbour


def test_neighbours_share_sequences(spark):
    """Documents of one language lie together on the curve far more than by chance."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    key = {r.doc_id: r.curve_key for r in packing.pack(docs, PATH).select("doc_id", "curve_key").distinct().collect()}
    rows = sorted((key[r.doc_id], r.lang) for r in docs.collect() if len(r.text or "") > 200)
    same = np.mean([a[1] == b[1] for a, b in zip(rows, rows[1:], strict=False)])
    share = np.array([sum(r[1] == x for r in rows) for x in {r[1] for r in rows}]) / len(rows)
    assert same > (share**2).sum() + 0.15


def test_odd_rows(odd, none, odd_rows):
    rows = packing.pack(odd, PATH, 2048).collect()
    whole([r for r in rows], [r[1] for r in odd_rows], 2048)
    assert sorted(r.doc_id for r in rows if r.doc_tokens == 1 and r.doc_id is not None) == [3, 4, 5]
    assert packing.pack(none, PATH).count() == 0
