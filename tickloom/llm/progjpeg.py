"""Progressive JPEG columns, coded and decoded in numpy over many images at once.

A payload's bytes are the quantised DCT coefficients (byte - 128) of a three-component
image with halved chroma, one block per 64 bytes, so the entropy-coded scans hold them
without loss. Restart markers cut every scan into short segments; all segments of all
images are decoded in lockstep, one coefficient at a time. Scans select bands (Ss, Se)
and bit planes (Ah, Al) and accumulate into coefficient arrays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import slices

RESTART = 4  # blocks (or units of the interleaved scan) between restart markers
FACTORS = ((2, 2), (1, 1), (1, 1))  # samples of Y, Cb, Cr: a unit has 6 blocks
UNIT = 6
SIDE = 4095  # most units in a row or column
BATCH = 3 << 20  # payload bytes coded together
#: (component, Ss, Se, Ah, Al); None: all components interleaved
SCRIPT = (
    (None, 0, 0, 0, 1), *[(c, 1, 5, 0, 1) for c in range(3)], *[(c, 6, 63, 0, 1) for c in range(3)],
    *[(c, 1, 63, 1, 0) for c in range(3)], (None, 0, 0, 1, 0),
)


def zigzag() -> np.ndarray:
    """Raster place of each coefficient in zigzag order."""
    cells = [(i, j) for i in range(8) for j in range(8)]
    cells.sort(key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([8 * i + j for i, j in cells])


ZIGZAG = zigzag()
ANGLE = np.cos((2 * np.arange(8)[:, None] + 1) * np.arange(8)[None, :] * np.pi / 16) * np.where(np.arange(8) == 0, np.sqrt(0.125), 0.5)
#: coefficients in zigzag order to samples, in units of 2**-13; sums are exact in doubles
INVERSE = np.rint(np.kron(ANGLE, ANGLE).T[ZIGZAG] * (1 << 13))


@dataclass
class Huffman:
    """A canonical code: counts per length and symbols, as a DHT segment lists them."""

    counts: bytes
    symbols: bytes

    def __post_init__(self) -> None:
        self.code = np.zeros(256, np.int64)
        self.size = np.zeros(256, np.int64)
        self.look_sym = np.zeros(1 << 16, np.uint8)
        self.look_len = np.zeros(1 << 16, np.int64)
        code, at = 0, 0
        for length in range(1, 17):
            for _ in range(self.counts[length - 1]):
                s = self.symbols[at]
                self.code[s], self.size[s] = code, length
                lo = code << (16 - length)
                self.look_sym[lo : lo + (1 << (16 - length))] = s
                self.look_len[lo : lo + (1 << (16 - length))] = length
                code, at = code + 1, at + 1
            code <<= 1


def by_length(length: dict[int, int]) -> Huffman:
    order = sorted(length, key=lambda s: (length[s], s))
    return Huffman(bytes(sum(v == n for v in length.values()) for n in range(1, 17)), bytes(order))


DC = by_length({s: 3 if 2 < s < 8 else 5 for s in range(12)})
SHORT = {1: 5, 2: 4, 3: 2, 4: 2, 5: 4, 6: 3, 7: 5, 8: 6, 0: 5}  # run 0, by size; 0 ends a block
AC = by_length({(r << 4) | s: SHORT.get(s, 12) if r == 0 else 9 if r == 1 and 0 < s < 9 else 12 for r in range(16) for s in range(11)})
BITS = np.array([int(i).bit_length() for i in range(1 << 12)])


def segment(mark: int, body: bytes) -> bytes:
    return b"\xff" + bytes([mark]) + (len(body) + 2).to_bytes(2, "big") + body


def written(value: np.ndarray, size: np.ndarray, seg: np.ndarray, n_seg: int, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the tokens (value, size up to 32, segment; in order) as stuffed bytes.

    Each segment is padded with ones to a byte; a restart marker follows it unless it is
    the ``last`` of its scan. ``last`` holds the marker's number, -1 for none. Returns the
    bytes and each segment's start.
    """
    total = np.bincount(seg, weights=size, minlength=n_seg).astype(np.int64)
    n_bytes = (total + 7) >> 3
    first = np.cumsum(n_bytes) - n_bytes
    end_bits = np.cumsum(size)
    before = np.cumsum(total) - total
    at = end_bits - size - before[seg] + 8 * first[seg]
    pad = 8 * n_bytes - total
    at = np.concatenate([at, 8 * first + total])
    value = np.concatenate([value, (1 << pad) - 1]).astype(np.uint64)
    size = np.concatenate([size, pad]).astype(np.int64)
    word = at >> 5
    whole = value << (64 - (at & 31) - size).astype(np.uint64)
    whole[size == 0] = 0
    n_words = int(n_bytes.sum() + 3) // 4 + 2
    words = np.bincount(word, weights=(whole >> np.uint64(32)).astype(np.float64), minlength=n_words)
    words += np.bincount(word + 1, weights=(whole & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n_words)[: len(words)]
    raw = words.astype(np.uint32).astype(">u4").view(np.uint8)[: int(n_bytes.sum())]
    stuffed = raw == 255
    marked = last >= 0
    step = 1 + stuffed.astype(np.int64)
    ends = first + n_bytes
    extra = np.zeros(len(raw) + 1, np.int64)
    np.add.at(extra, ends, 2 * marked)
    place = np.cumsum(step) - step + np.cumsum(extra)[: len(raw)]
    out = np.zeros(int(step.sum() + extra.sum()), np.uint8)
    out[place] = raw
    size_out = np.bincount(np.repeat(np.arange(n_seg), n_bytes), weights=step, minlength=n_seg).astype(np.int64) + 2 * marked
    begin = np.cumsum(size_out) - size_out
    stop = begin + size_out
    out[stop[marked] - 2] = 255
    out[stop[marked] - 1] = 0xD0 + last[marked]
    return out, begin


def first_tokens(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens (value, size, block) of a first pass over bands ``v`` (blocks, width)."""
    n, width = v.shape
    blk, k = np.nonzero(v)
    x = v[blk, k].astype(np.int64)
    new = np.concatenate([[True], blk[1:] != blk[:-1]]) if len(blk) else np.zeros(0, bool)
    prev = np.where(new, -1, np.concatenate([[0], k[:-1]])) if len(blk) else k
    run = k - prev - 1
    long = run >> 4
    tail = np.ones(n, np.int64)
    if len(blk):
        is_last = np.concatenate([blk[1:] != blk[:-1], [True]])
        tail[blk[is_last]] = k[is_last] < width - 1
    ends_before = np.cumsum(tail) - tail
    slot = np.cumsum(1 + long) - 1 + ends_before[blk]
    count = np.bincount(blk, weights=1 + long, minlength=n).astype(np.int64) + tail
    total = int(count.sum())
    value = np.full(total, AC.code[0xF0])
    size = np.full(total, AC.size[0xF0])
    s = BITS[np.abs(x)]
    sym = ((run & 15) << 4) | s
    value[slot] = (AC.code[sym] << s) | np.where(x > 0, x, x + (1 << s) - 1)
    size[slot] = AC.size[sym] + s
    end = (np.cumsum(count) - 1)[tail > 0]
    value[end], size[end] = AC.code[0], AC.size[0]
    return value, size, np.repeat(np.arange(n), count)


def refine_tokens(c: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of a refinement pass: bit ``low`` of bands ``c`` (blocks, width).

    Tokens and correction bits are put in order by a key: block, group (how many fresh
    coefficients came before, then runs of 16 zeros), token before corrections, place.
    """
    mag = np.abs(c.astype(np.int64)) >> low
    had, fresh = mag > 1, mag == 1
    busy = fresh.any(axis=1)
    width = c.shape[1]
    items: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # value, size, block, key in block

    def put(value: np.ndarray | int, size: np.ndarray | int, block: np.ndarray, group: np.ndarray | int, place: np.ndarray | int) -> None:
        full = [np.broadcast_to(np.asarray(v, np.int64), block.shape) for v in (value, size)]
        items.append((*full, block, (block * 260 + group) * 65 + place))

    quiet = np.flatnonzero(~busy)
    put(AC.code[0], AC.size[0], quiet, 0, 0)
    h, m = had[quiet].astype(np.int64), mag[quiet] & 1
    for part, lo in enumerate(range(0, width, 24)):
        val = np.zeros(len(quiet), np.int64)
        for j in range(lo, min(width, lo + 24)):
            val = (val << h[:, j]) | (m[:, j] & h[:, j])
        put(val, h[:, lo : lo + 24].sum(axis=1), quiet, 0, 1 + part)
    rows = np.flatnonzero(busy)
    if len(rows):
        h, f, m, x = had[rows], fresh[rows], mag[rows], c[rows]
        zeros = np.cumsum(~h & ~f, axis=1)
        zeros[:, 1:] = zeros[:, :-1].copy()
        zeros[:, 0] = 0
        seen = np.cumsum(f, axis=1) - f
        base = np.maximum.accumulate(np.where(f, zeros, 0), axis=1)
        base[:, 1:] = base[:, :-1].copy()
        base[:, 0] = 0
        run = zeros - base  # zeros since the last fresh one
        many = f.sum(axis=1)
        r, j = np.nonzero(f)
        runs = run[r, j]
        sym = ((runs & 15) << 4) | 1
        put((AC.code[sym] << 1) | (x[r, j] > 0), AC.size[sym] + 1, rows[r], seen[r, j] * 4 + (runs >> 4), 0)
        at = np.repeat(np.arange(len(r)), runs >> 4)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(runs >> 4) - (runs >> 4), runs >> 4)
        put(AC.code[0xF0], AC.size[0xF0], rows[r[at]], seen[r[at], j[at]] * 4 + nth, 0)
        last = width - 1 - np.argmax(f[:, ::-1], axis=1)
        put(AC.code[0], AC.size[0], rows[last < width - 1], many[last < width - 1] * 4, 0)
        r, j = np.nonzero(h)
        group = seen[r, j] * 4 + np.where(seen[r, j] < many[r], run[r, j] >> 4, 0)
        put(m[r, j] & 1, 1, rows[r], group, 1 + j)
    value, size, block, key = (np.concatenate(v) for v in zip(*items, strict=True))
    order = np.argsort(key, kind="stable")
    return value[order], size[order], block[order]


def shape(n_payload: int) -> tuple[int, int]:
    """Units per row and rows of units for a payload."""
    units = -(-n_payload // (64 * UNIT))
    wide = max(min(units, 4), -(-units // SIDE))
    if wide > SIDE:
        raise ValueError("payload too large for one image")
    return wide, -(-units // wide)


def order_of(wide: int, high: int) -> list[np.ndarray]:
    """Per component, the place of each of its blocks (raster) in the units' order."""
    unit = np.arange(wide * high).reshape(high, wide) * UNIT
    y = np.empty((2 * high, 2 * wide), np.int64)
    for k in range(4):
        y[k // 2 :: 2, k % 2 :: 2] = unit + k
    return [y.ravel(), unit.ravel() + 4, unit.ravel() + 5]


def encode(payloads: list[bytes], notes: list[int]) -> list[bytes]:
    """A progressive JPEG file per payload (multiples of 64 bytes); ``notes`` are stored with it."""
    shapes = [shape(len(p)) for p in payloads]
    totals = [w * h * UNIT for w, h in shapes]
    base = np.cumsum([0, *totals])
    c = np.zeros((int(base[-1]), 64), np.int16)
    for p, b in zip(payloads, base, strict=False):
        c[b : b + len(p) // 64] = np.frombuffer(p, np.uint8).reshape(-1, 64).astype(np.int16) - 128
    orders = [[o + b for o in order_of(w, h)] for (w, h), b in zip(shapes, base, strict=False)]
    files: list[list[bytes]] = []
    for p, (w, h), note in zip(payloads, shapes, notes, strict=True):
        head = b"\xff\xd8" + segment(0xFE, b"payload=%d text=%d" % (len(p), note)) + segment(0xDB, b"\0" + b"\1" * 64)
        frame = b"\x08" + (16 * h).to_bytes(2, "big") + (16 * w).to_bytes(2, "big") + b"\3"
        frame += b"".join(bytes([i + 1, f[0] << 4 | f[1], 0]) for i, f in enumerate(FACTORS))
        head += segment(0xC2, frame) + segment(0xDD, RESTART.to_bytes(2, "big"))
        head += segment(0xC4, b"\x00" + DC.counts + DC.symbols + b"\x10" + AC.counts + AC.symbols)
        files.append([head])
    for comp, ss, se, ah, al in SCRIPT:
        per = RESTART * UNIT if comp is None else RESTART
        if comp is None:
            seq, sizes = np.arange(len(c)), np.array(totals)
            head = b"\3" + b"".join(bytes([i + 1, 0]) for i in range(3))
        else:
            seq = np.concatenate([o[comp] for o in orders])
            sizes = np.array([len(o[comp]) for o in orders])
            head = bytes([1, comp + 1, 0])
        head = segment(0xDA, head + bytes([ss, se, ah << 4 | al]))
        begin = np.cumsum(sizes) - sizes
        within = np.arange(len(seq)) - np.repeat(begin, sizes)
        n_segs = -(-sizes // per)
        seg_base = np.cumsum(n_segs) - n_segs
        seg_of = np.repeat(seg_base, sizes) + within // per
        number = np.arange(int(n_segs.sum())) - np.repeat(seg_base, n_segs)
        last = np.where(number == np.repeat(n_segs, n_segs) - 1, -1, number % 8)
        if ss == 0 and ah == 0:
            dc = c[seq, 0].astype(np.int64) >> al
            slot = np.where(within % UNIT < 4, 0, within % UNIT)
            prev = np.zeros(len(dc), np.int64)
            for k in (0, 4, 5):
                at = np.flatnonzero(slot == k)
                prev[at[1:]] = np.where(seg_of[at[1:]] == seg_of[at[:-1]], dc[at[:-1]], 0)
            d = dc - prev
            s = BITS[np.abs(d)]
            value, size, block = (DC.code[s] << s) | np.where(d > 0, d, d + (1 << s) - 1), DC.size[s] + s, np.arange(len(seq))
        elif ss == 0:
            value, size, block = (c[seq, 0].astype(np.int64) >> al) & 1, np.ones(len(seq), np.int64), np.arange(len(seq))
        elif ah == 0:
            band = c[seq, ss : se + 1]
            value, size, block = first_tokens(np.sign(band) * (np.abs(band) >> al))
        else:
            value, size, block = refine_tokens(c[seq, ss : se + 1], al)
        data, starts = written(value, size, seg_of[block], len(last), last)
        edges = np.append(starts, len(data))[np.append(seg_base, len(last))]
        for i, f in enumerate(files):
            f += (head, data[edges[i] : edges[i + 1]].tobytes())
    return [b"".join((*f, b"\xff\xd9")) for f in files]


# --- decoding --------------------------------------------------------------------------

SCAN_END = re.compile(rb"\xff+[^\x00\xd0-\xd7\xff]", re.S)


@dataclass
class Image:
    """A parsed file: geometry, tables, scans, and its blocks' place in the batch."""

    height: int = 0
    width: int = 0
    comps: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, table
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    comment: bytes = b""
    scans: list[tuple[tuple, bytes]] = field(default_factory=list)  # (comps, ss, se, ah, al, restart, tables), data
    base: list[int] = field(default_factory=list)

    def grid(self, i: int, padded: bool) -> tuple[int, int]:
        """Blocks across and down of component i, with or without those that fill units."""
        hm, vm = max(c[1] for c in self.comps), max(c[2] for c in self.comps)
        _, h, v, _ = self.comps[i]
        if padded:
            return -(-self.width // (8 * hm)) * h, -(-self.height // (8 * vm)) * v
        return -(-(-(-self.width * h // hm)) // 8), -(-(-(-self.height * v // vm)) // 8)


def parse(data: bytes) -> Image:
    """Segments of a progressive file; scans keep the tables in force when they begin."""
    im, at, restart = Image(), 2, 0
    tables: dict[int, bytes] = {}
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    while at < len(data):
        while data[at + 1] == 0xFF:
            at += 1
        mark = data[at + 1]
        if mark == 0xD9:
            break
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if mark == 0xFE:
            im.comment = body
        elif mark == 0xDB:
            while body:
                wide, n = body[0] >> 4, 64 * (1 + (body[0] >> 4))
                im.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.float64)
                body = body[1 + n :]
        elif mark == 0xC2:
            im.height, im.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            im.comps = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a progressive Huffman file")
        elif mark == 0xDD:
            restart = int.from_bytes(body, "big")
        elif mark == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                tables[body[0]] = body[1:n]
                body = body[n:]
        elif mark == 0xDA:
            n = body[0]
            ids = [c[0] for c in im.comps]
            comps = tuple(ids.index(body[1 + 2 * i]) for i in range(n))
            ss, se, a = body[1 + 2 * n : 4 + 2 * n]
            use = tuple(tables.get((body[2 + 2 * i] >> 4) if ss == 0 else 0x10 | (body[2 + 2 * i] & 15), b"") for i in range(n))
            m = SCAN_END.search(data, at)
            stop = m.start() if m else len(data)
            im.scans.append(((comps, ss, se, a >> 4, a & 15, restart, use), data[at:stop]))
            at = stop
    return im


_CODES: dict[bytes, Huffman] = {}


def code_of(table: bytes) -> Huffman:
    if table not in _CODES:
        if len(_CODES) > 64:
            _CODES.clear()
        _CODES[table] = Huffman(table[:16], table[16:])
    return _CODES[table]


class Lanes:
    """Bit positions of all segments of one scan of many images, read in lockstep."""

    def __init__(self, datas: list[bytes]):
        raw = np.frombuffer(b"".join(x + b"\xff\xd0" for x in datas), np.uint8)  # a marker after each scan
        ff = np.flatnonzero(raw[:-1] == 255)
        nxt = raw[ff + 1]
        marks = ff[(nxt >= 0xD0) & (nxt <= 0xD7)]
        drop = np.zeros(len(raw), bool)
        drop[ff[nxt == 0] + 1] = True
        drop[marks] = drop[marks + 1] = True
        kept = np.cumsum(~drop)
        starts = np.concatenate([[0], kept[marks[:-1]]])
        b = np.concatenate([raw[~drop], np.zeros(8, np.uint8)]).astype(np.uint32)
        self.word = (b[:-3] << np.uint32(24)) | (b[1:-2] << np.uint32(16)) | (b[2:-1] << np.uint32(8)) | b[3:]
        self.at = starts.astype(np.int64) * 8
        ends = np.cumsum([len(x) + 2 for x in datas])
        self.per_image = np.diff(np.concatenate([[0], np.searchsorted(marks, ends)]))

    def peek(self, lanes: np.ndarray) -> np.ndarray:
        p = np.minimum(self.at[lanes], 8 * (len(self.word) - 1))
        return ((self.word[p >> 3] << (p & 7).astype(np.uint32)) >> np.uint32(16)).astype(np.int64)

    def bits(self, lanes: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """Up to 16 bits of each lane, moving on."""
        out = self.peek(lanes) >> (16 - n)
        self.at[lanes] += n
        return out

    def symbol(self, lanes: np.ndarray, code: Huffman) -> np.ndarray:
        x = self.peek(lanes)
        self.at[lanes] += code.look_len[x]
        return code.look_sym[x].astype(np.int64)


def extend(x: np.ndarray, s: np.ndarray) -> np.ndarray:
    return np.where(x < (1 << np.maximum(s, 1) >> 1), x - (1 << s) + 1, x)


def scan_blocks(im: Image, comps: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
    """Blocks of a scan in order (from each component's first), the component of each, blocks per unit."""
    if len(comps) == 1:
        across, down = im.grid(comps[0], False)
        stride = im.grid(comps[0], True)[0]
        seq = (np.arange(down)[:, None] * stride + np.arange(across)[None, :]).ravel()
        return seq, np.zeros(len(seq), np.int64), 1
    parts, which = [], []
    for n, i in enumerate(comps):
        _, h, v, _ = im.comps[i]
        across, down = im.grid(i, True)
        g = np.arange(across * down).reshape(down // v, v, across // h, h).transpose(0, 2, 1, 3)
        parts.append(g.reshape(-1, h * v))
        which += [n] * (h * v)
    seq = np.concatenate(parts, axis=1)
    return seq.ravel(), np.tile(which, len(seq)), len(which)


def run_scan(c: np.ndarray, images: list[Image], spec: tuple, datas: list[bytes], cache: dict) -> None:
    """Decode one scan of several images into the coefficients ``c`` (blocks, 64)."""
    comps, ss, se, ah, al, restart, tables = spec
    lanes = Lanes(datas)
    seqs, which, first, count = [], [], [], []
    total = 0
    for im, n_lanes in zip(images, lanes.per_image, strict=True):
        key = (comps, im.width, im.height, tuple(im.comps))
        if key not in cache:
            cache[key] = scan_blocks(im, comps)
        seq, kind, unit = cache[key]
        seqs.append(seq + (np.array([im.base[i] for i in comps])[kind] if len(comps) > 1 else im.base[comps[0]]))
        which.append(kind)
        per = restart * unit if restart else len(seq)
        begin = np.arange(n_lanes) * per
        first.append(begin + total)
        count.append(np.minimum(len(seq) - begin, per))
        total += len(seq)
    seq, kind = np.concatenate(seqs), np.concatenate(which)
    first, count = np.concatenate(first), np.concatenate(count)
    n = len(first)
    if ss == 0:
        pred = np.zeros((len(comps), n), np.int64)
        for j in range(int(count.max(initial=0))):
            live = np.flatnonzero(count > j)
            blk = first[live] + j
            if ah:
                c[seq[blk], 0] |= (lanes.bits(live, 1) << al).astype(np.int16)
                continue
            for k in range(len(comps)):
                mine = np.flatnonzero(kind[blk] == k)
                if not len(mine):
                    continue
                lane = live[mine]
                s = lanes.symbol(lane, code_of(tables[k]))
                pred[k, lane] += np.where(s > 0, extend(lanes.bits(lane, s), s), 0)
                c[seq[blk[mine]], 0] = (pred[k, lane] << al).astype(np.int16)
        return
    code = code_of(tables[0])
    eob = np.zeros(n, np.int64)
    for j in range(int(count.max(initial=0))):
        live = np.flatnonzero(count > j)
        where = seq[first[live] + j]
        band = np.ascontiguousarray(c[where, ss : se + 1].T)
        (refine_block if ah else first_block)(lanes, live, band, code, eob, al)
        c[where, ss : se + 1] = band.T


def next_symbol(lanes: Lanes, lane: np.ndarray, code: Huffman, eob: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Run, size and whether the lane's band ends here (its end-of-band run then is set)."""
    sym = lanes.symbol(lane, code)
    r, s = sym >> 4, sym & 15
    end = (s == 0) & (r < 15)
    if end.any():
        e = lane[end]
        eob[e] = (1 << r[end]) + np.where(r[end] > 0, lanes.bits(e, r[end]), 0)
    return r, s, end


def first_block(lanes: Lanes, live: np.ndarray, band: np.ndarray, code: Huffman, eob: np.ndarray, al: int) -> None:
    """One block of every lane, first pass: symbols give zero runs and values."""
    skip = np.full(len(live), -1)  # zeros to pass before the pending value; -1: read a symbol
    value = np.zeros(len(live), np.int64)
    open_ = eob[live] == 0
    for k in range(len(band)):
        need = np.flatnonzero(open_ & (skip < 0))
        if len(need):
            r, s, end = next_symbol(lanes, live[need], code, eob)
            v = extend(lanes.bits(live[need], s), s)
            value[need] = np.where(s > 0, v << al, 0)
            skip[need] = r
            open_[need[end]] = False
        hit = open_ & (skip == 0)
        band[k] = np.where(hit, value, 0)
        skip -= 1
        if k % 16 == 15 and not open_.any():
            break
    eob[live] = np.maximum(eob[live] - 1, 0)


def refine_block(lanes: Lanes, live: np.ndarray, band: np.ndarray, code: Huffman, eob: np.ndarray, al: int) -> None:
    """One block of every lane, refinement: a bit for each old value, symbols for new ones."""
    skip = np.full(len(live), -1)
    value = np.zeros(len(live), np.int64)
    open_ = eob[live] == 0
    for k in range(len(band)):
        need = np.flatnonzero(open_ & (skip < 0))
        if len(need):
            r, s, end = next_symbol(lanes, live[need], code, eob)
            new = np.flatnonzero(s > 0)
            value[need] = 0
            value[need[new]] = np.where(lanes.bits(live[need[new]], 1) > 0, 1, -1) << al
            skip[need] = r
            open_[need[end]] = False
        old = band[k] != 0
        at = np.flatnonzero(old)
        if len(at):
            bit = lanes.bits(live[at], 1) << al
            x = band[k, at]
            band[k, at] = x + np.where(x > 0, bit, -bit)
        fresh = ~old & open_
        band[k] = np.where(fresh & (skip == 0), value, band[k])
        skip = np.where(fresh, skip - 1, skip)
    eob[live] = np.maximum(eob[live] - 1, 0)


def coefficients(files: list[bytes]) -> tuple[np.ndarray, list[Image]]:
    """Zigzag coefficients of all blocks of all files, and the parsed images."""
    images = [parse(f) for f in files]
    total = 0
    for im in images:
        for i in range(len(im.comps)):
            across, down = im.grid(i, True)
            im.base.append(total)
            total += across * down
    c = np.zeros((total, 64), np.int16)
    cache: dict = {}
    for k in range(max((len(im.scans) for im in images), default=0)):
        groups: dict[tuple, list[Image]] = {}
        for im in images:
            if k < len(im.scans):
                groups.setdefault(im.scans[k][0], []).append(im)
        for spec, same in groups.items():
            run_scan(c, same, spec, [im.scans[k][1] for im in same], cache)
    return c, images


def tensors(c: np.ndarray, images: list[Image]) -> list[np.ndarray]:
    """Full-resolution RGB (height, width, 3) of each image; chroma is repeated."""
    planes: list[list[np.ndarray]] = []
    same = all(np.array_equal(q, np.ones(64)) for im in images for q in im.quant.values())
    if same:
        flat = np.rint(c.astype(np.float64) @ INVERSE / (1 << 13)).astype(np.int16)
    for im in images:
        out = []
        for i, (_, _, _, q) in enumerate(im.comps):
            across, down = im.grid(i, True)
            part = slice(im.base[i], im.base[i] + across * down)
            x = flat[part] if same else np.rint((c[part] * im.quant[q]) @ INVERSE / (1 << 13)).astype(np.int16)
            out.append(x.reshape(down, across, 8, 8).transpose(0, 2, 1, 3).reshape(8 * down, 8 * across) + np.int16(128))
        planes.append(out)
    result = []
    for im, ps in zip(images, planes, strict=True):
        hm, vm = max(x[1] for x in im.comps), max(x[2] for x in im.comps)
        full = []
        for (_, h, v, _), p in zip(im.comps, ps, strict=True):
            p = np.clip(p, 0, 255).astype(np.int32)
            if (hm // h, vm // v) != (1, 1):
                p = np.repeat(np.repeat(p, vm // v, axis=0), hm // h, axis=1)
            full.append(p[: im.height, : im.width])
        rgb = np.empty((im.height, im.width, 3), np.uint8)
        if len(full) == 1:
            rgb[:] = full[0][:, :, None]
        else:
            y, cb, cr = full[0] << 16, full[1] - 128, full[2] - 128
            rgb[..., 0] = np.clip((y + 91881 * cr + 32768) >> 16, 0, 255)
            rgb[..., 1] = np.clip((y - 22554 * cb - 46802 * cr + 32768) >> 16, 0, 255)
            rgb[..., 2] = np.clip((y + 116130 * cb + 32768) >> 16, 0, 255)
        result.append(rgb)
    return result


def payload_of(c: np.ndarray, im: Image) -> tuple[bytes, int]:
    """The payload stored in an image made by ``encode``, and the number stored with it."""
    n, note = map(int, re.fullmatch(rb"payload=(\d+) text=(\d+)", im.comment).groups())
    wide, high = im.width // 16, im.height // 16
    out = np.empty((wide * high * UNIT, 64), np.uint8)
    for o, b in zip(order_of(wide, high), im.base, strict=True):
        out[o] = (c[b : b + len(o)] + 128).astype(np.uint8)
    return out.tobytes()[:n], note


def feature(rgb: np.ndarray) -> str:
    """Size, channel means and a coarse grid of the tensor's brightness."""
    h, w, _ = rgb.shape
    sums = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64)
    rows = np.add.reduceat(rgb[..., 1].sum(axis=1, dtype=np.int64), np.arange(4) * h // 4)
    mean = "/".join(f"{int(x) * 1000 // (h * w)}" for x in sums)
    return f"{w}x{h}:{mean}:" + "/".join(str(int(x) * 4 // (h * w)) for x in rows)


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``media``: each whole text's UTF-8 bytes, zero padded, as a file.

    Null texts are empty; the padding fills up to a positive multiple of 64. Repeated rows
    give equal files, null ids pass through, an empty table gives an empty result, other
    columns are ignored.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 1, BATCH):
                texts = [x or b"" for x in part.column(1).to_pylist()]
                made = encode([x + bytes(-len(x) % 64 if x else 64) for x in texts], [len(x) for x in texts])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary())], ["doc_id", "media"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary")).mapInArrow(work, "doc_id long, media binary")


def read(media: DataFrame, keep_tensors: bool = True) -> DataFrame:
    """Decode ``media``: the payload, the RGB tensor (row-major bytes) and its feature.

    Null media give null results.
    """
    schema = "doc_id long, media binary, n_bytes long, payload binary, height int, width int, feature string"
    schema += ", rgb binary" if keep_tensors else ""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 1, BATCH):
                files = part.column(1).to_pylist()
                there = [i for i, f in enumerate(files) if f is not None]
                rows: list[tuple] = [(None,) * 6] * len(files)
                c, images = coefficients([files[i] for i in there])
                for i, im, rgb in zip(there, images, tensors(c, images), strict=True):
                    payload, n = payload_of(c, im)
                    rows[i] = (n, payload, im.height, im.width, feature(rgb), rgb.tobytes() if keep_tensors else None)
                cols = list(zip(*rows, strict=True)) or [()] * 6
                kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.string(), pa.binary())[: 6 if keep_tensors else 5]
                arrays = [pa.array(x, t) for x, t in zip(cols, kinds, strict=False)]
                names = ["doc_id", "media", "n_bytes", "payload", "height", "width", "feature", "rgb"]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *arrays], names[: 2 + len(arrays)])

    return media.select("doc_id", "media").mapInArrow(work, schema)
