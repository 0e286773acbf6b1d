from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from tickloom.llm import progjpeg, queries


def scalar(data):
    """A plain progressive decoder, bit by bit and block by block."""
    im = progjpeg.parse(data)
    coef = [np.zeros((*im.grid(i, True)[::-1], 64), int) for i in range(len(im.comps))]
    for (comps, ss, se, ah, al, restart, tables), raw in im.scans:
        codes = []
        for t in tables:
            book, code, at = {}, 0, 16
            for n in range(1, 17):
                for _ in range(t[n - 1] if t else 0):
                    book[n, code] = t[at]
                    code, at = code + 1, at + 1
                code <<= 1
            codes.append(book)
        parts, part, i = [], bytearray(), 0
        while i < len(raw):
            if raw[i] == 255 and i + 1 < len(raw):
                if raw[i + 1] == 0:
                    part.append(255)
                else:
                    parts.append(bytes(part))
                    part = bytearray()
                i += 2
            else:
                part.append(raw[i])
                i += 1
        parts.append(bytes(part))
        blocks = []
        if len(comps) == 1:
            w, h = im.grid(comps[0], False)
            blocks = [[(0, y, x)] for y in range(h) for x in range(w)]
        else:
            w, h = im.grid(comps[0], True)
            _, fh, fv, _ = im.comps[comps[0]]
            for y in range(h // fv):
                for x in range(w // fh):
                    unit = []
                    for k, c in enumerate(comps):
                        _, a, b, _ = im.comps[c]
                        unit += [(k, y * b + j, x * a + i) for j in range(b) for i in range(a)]
                    blocks.append(unit)
        bits, pred, eob = iter(()), [0] * len(comps), 0

        def take(n):
            v = 0
            for _ in range(n):
                v = v << 1 | next(bits)
            return v

        def symbol(book):
            v = 0
            for n in range(1, 17):
                v = v << 1 | next(bits)
                if (n, v) in book:
                    return book[n, v]
            raise AssertionError

        def signed(s):
            v = take(s)
            return v if not s or v >> (s - 1) else v - (1 << s) + 1

        for u, unit in enumerate(blocks):
            if u % (restart or len(blocks)) == 0:
                p = parts.pop(0)
                bits = iter([b >> k & 1 for b in p for k in range(7, -1, -1)] + [0] * 64)
                pred, eob = [0] * len(comps), 0
            for k, y, x in unit:
                c = coef[comps[k]][y, x]
                if ss == 0:
                    if ah:
                        c[0] |= take(1) << al
                    else:
                        pred[k] += signed(symbol(codes[k]))
                        c[0] = pred[k] << al
                    continue
                z = ss
                while z <= se:
                    if eob:
                        break
                    s = symbol(codes[k])
                    r, s = s >> 4, s & 15
                    if s == 0 and r < 15:
                        eob = (1 << r) + take(r)
                        break
                    v = (signed(s) if not ah else (1 if take(1) else -1)) * (1 << al) if s else 0
                    while z <= se:
                        if ah and c[z]:
                            if take(1):
                                c[z] += (1 << al) if c[z] > 0 else -(1 << al)
                        elif r == 0:
                            c[z] = v
                            z += 1
                            break
                        else:
                            r -= 1
                        z += 1
                if eob:
                    if ah:
                        for q in range(z, se + 1):
                            if c[q] and take(1):
                                c[q] += (1 << al) if c[q] > 0 else -(1 << al)
                    eob -= 1
    return coef


def samples():
    r = random.Random(1)
    out = [b"", b"a", b"\xff" * 300, bytes(range(256)) * 3, bytes([127, 129, 128] * 100), bytes([128] * 500), "日本語テキスト、あ。".encode() * 20]
    out += [bytes(r.choice([128] * 8 + [129, 127, 40]) for _ in range(640)) for _ in range(12)] + [bytes(r.randrange(256) for _ in range(4000))]
    return [x + bytes(-len(x) % 64 if x else 64) for x in out]


@pytest.mark.parametrize("restart", [progjpeg.RESTART, 1, 50_000])
def test_against_the_scalar_decoder(monkeypatch, restart):
    monkeypatch.setattr(progjpeg, "RESTART", restart)
    payloads = samples()
    files = progjpeg.encode(payloads, list(range(len(payloads))))
    c, images = progjpeg.coefficients(files)
    for i, (p, im, f) in enumerate(zip(payloads, images, files, strict=True)):
        assert progjpeg.payload_of(c, im) == (p, i)
        for k, want in enumerate(scalar(f)):
            assert np.array_equal(want.reshape(-1, 64), c[im.base[k] : im.base[k] + want.shape[0] * want.shape[1]])


def test_end_of_band_runs():
    """A run of ends over several blocks, which the encoder does not make."""
    run = progjpeg.Huffman(bytes([0, 3] + [0] * 14), bytes([0x00, 0x20, 0x01]))
    bits = "01" + "10" + "10" + "1" + "00" + "00"  # a run of 4 + 2 blocks, then a value of size 1 and an end, then an end
    bits += "1" * (-len(bits) % 8)
    data = int(bits, 2).to_bytes(len(bits) // 8, "big")
    frame = b"\x08" + (8).to_bytes(2, "big") + (64).to_bytes(2, "big") + b"\1\1\x11\0"
    file = b"\xff\xd8" + progjpeg.segment(0xDB, b"\0" + b"\1" * 64) + progjpeg.segment(0xC2, frame) + progjpeg.segment(0xC4, b"\x10" + run.counts + run.symbols)
    file += progjpeg.segment(0xDA, b"\1\1\0\1\x05\0") + data + b"\xff\xd9"
    c, images = progjpeg.coefficients([file])
    assert np.array_equal(c, scalar(file)[0].reshape(-1, 64)) and c[6, 1] == 1 and np.count_nonzero(c) == 1
    assert progjpeg.tensors(c, images)[0].shape == (8, 64, 3)


def test_inverse_transform_and_colour():
    """Samples against the cosine sum; chroma is repeated; grey stays grey."""
    c, images = progjpeg.coefficients(progjpeg.encode([bytes(range(128, 192)) * 6], [0]))
    rgb = progjpeg.tensors(c, images)[0]
    assert rgb.shape == (16, 16, 3)
    raster = np.zeros(64)
    raster[progjpeg.ZIGZAG] = c[0]
    want = np.zeros((8, 8))
    for y in range(8):
        for x in range(8):
            for v in range(8):
                for u in range(8):
                    k = (np.sqrt(0.5) if u == 0 else 1) * (np.sqrt(0.5) if v == 0 else 1) / 4
                    want[y, x] += k * raster[8 * v + u] * np.cos((2 * y + 1) * v * np.pi / 16) * np.cos((2 * x + 1) * u * np.pi / 16)
    flat = np.rint(c.astype(float) @ progjpeg.INVERSE / (1 << 13))[0].reshape(8, 8)
    assert np.abs(flat - want).max() <= 1
    grey = bytes([128]) * 384
    c, images = progjpeg.coefficients(progjpeg.encode([grey], [0]))
    assert (progjpeg.tensors(c, images)[0] == 128).all()
    for bad in (b"", b"\xff\xd8\xff\xc0\x00\x04\x00\x00", b"no image"):
        with pytest.raises((ValueError, IndexError)):
            progjpeg.coefficients([bad])


def test_table_and_odd_rows(spark, odd, none, odd_rows):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in queries.op7_progressive_jpeg(spark, "/root/testdata/sf0.001").collect():
        raw = (text[r.doc_id] or "").encode()
        p = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    out = progjpeg.read(progjpeg.stored(odd)).collect()
    assert len(out) == len(odd_rows)
    assert sorted(bytes(r.payload).rstrip(b"\0") for r in out) == sorted((r[1] or "").encode() for r in odd_rows)
    assert all(len(r.rgb) == 3 * r.height * r.width for r in out)
    assert len({(bytes(r.media), r.feature) for r in out if r.doc_id == 1}) == 1
    assert progjpeg.read(progjpeg.stored(none)).count() == 0
    gap = spark.createDataFrame([(1, None)], "doc_id long, media binary")
    assert progjpeg.read(gap).first().payload is None
