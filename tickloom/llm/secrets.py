"""Secret scan with a worklist of decoded layers.

The whole text is the first layer. A layer is scanned for secrets; then every decoder that
finds something in it makes a further layer, which joins the worklist: percent escapes and
Unicode escapes are replaced where they stand (the text around them stays, so a name before
an escape still counts), base64 runs and compressed data give layers of their own. A layer
that was seen before at the same place is not taken up again, so the work ends even for data
that decodes to itself. Each layer knows, per code point, which stretch of the text it
stands for, and a find is reported as the smallest stretch that holds it.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are matched whole, so this equals dropping shorter runs
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(
    r"(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)+"
)
ONE_ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\u\{([0-9A-Fa-f]+)\}|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#([0-9]+);|&#[xX]([0-9A-Fa-f]+);")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{12,}={0,2}")
HINTS = re.compile(r"%[0-9A-Fa-f]{2}|\\[uUx][{0-9A-Fa-f]|&#|[A-Za-z0-9+/_-]{12}")
WINDOW, REACH = 1 << 20, 1 << 16  # unpacked data are scanned in windows that overlap

Layer = tuple[str, np.ndarray | int, np.ndarray | int]  # text, stretch per code point (or one for all)


def scan(text: str) -> list[tuple[int, int, int]]:
    """The finds in one layer: (start, kind, end)."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


def unpacked(data: bytes) -> Iterator[bytes]:
    """The contents of gzip, zlib, bzip2 or xz data in overlapping windows; nothing otherwise.

    Damaged data give what comes before the damage. Memory stays at one window however far
    the data expand; a find of up to ``REACH`` bytes lies whole in one window.
    """
    if data[:2] == b"\x1f\x8b":
        tool = zlib.decompressobj(31)
    elif len(data) > 2 and data[0] & 15 == 8 and data[0] >> 4 <= 7 and (data[0] << 8 | data[1]) % 31 == 0:
        tool = zlib.decompressobj(15)
    elif data[:3] == b"BZh":
        tool = bz2.BZ2Decompressor()
    elif data[:6] == b"\xfd7zXZ\x00":
        tool = lzma.LZMADecompressor(memlimit=1 << 28)
    else:
        return
    held, rest = b"", data
    while True:
        try:
            more = tool.decompress(rest, WINDOW)
        except (zlib.error, OSError, lzma.LZMAError, EOFError):
            more = b""
        rest = tool.unconsumed_tail if hasattr(tool, "unconsumed_tail") else b""
        if not more:
            break
        held += more
        if len(held) >= WINDOW:
            yield held
            held = held[-REACH:]
        if tool.eof or hasattr(tool, "needs_input") and tool.needs_input:
            break
    if held:
        yield held


def readable(data: bytes) -> str | None:
    """``data`` as text, if it is UTF-8 without control characters."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    return text if text and not re.search(r"[\x00-\x08\x0E-\x1F\x7F]", text) else None


def layers_of(data: bytes, start: int, end: int) -> Iterator[Layer]:
    """Layers of decoded bytes that stand for one stretch: text, or what unpacking gives."""
    text = readable(data)
    if text is not None:
        yield text, start, end
        return
    for part in unpacked(data):
        yield part.decode("utf-8", "replace"), start, end


def _replaced(layer: Layer, spots: list[tuple[int, int, list[tuple[str, int, int]]]]) -> Layer:
    """The layer with stretches replaced: (start, end, pieces of (text, start, end))."""
    text, lo, hi = layer
    one = isinstance(lo, int)
    los, his, out, at = [], [], [], 0

    def keep(a: int, b: int) -> None:
        out.append(text[a:b])
        los.append(np.full(b - a, lo) if one else lo[a:b])
        his.append(np.full(b - a, hi) if one else hi[a:b])

    for a, b, pieces in spots:
        keep(at, a)
        for piece, x, y in pieces:
            out.append(piece)
            los.append(np.full(len(piece), lo if one else lo[x]))
            his.append(np.full(len(piece), hi if one else hi[y - 1]))
        at = b
    keep(at, len(text))
    return "".join(out), np.concatenate(los), np.concatenate(his)


def percent(layer: Layer) -> Iterator[Layer]:
    """Percent escapes as UTF-8; bytes that are none become a layer if they unpack."""
    text, lo, hi = layer
    spots = []
    for m in PERCENT.finditer(text):
        data = bytes.fromhex(m[0].replace("%", ""))
        try:
            chars = data.decode()
        except UnicodeDecodeError:
            a, b = (lo, hi) if isinstance(lo, int) else (int(lo[m.start()]), int(hi[m.end() - 1]))
            yield from layers_of(data, a, b)
            chars = data.decode("utf-8", "replace")
            if len(chars.encode()) != len(data):  # replaced bytes shift places: the run counts as a whole
                spots.append((m.start(), m.end(), [(chars, m.start(), m.end())]))
                continue
        pieces, at = [], m.start()
        for ch in chars:
            size = 3 * len(ch.encode())
            pieces.append((ch, at, at + size))
            at += size
        spots.append((m.start(), m.end(), pieces))
    if spots:
        yield _replaced(layer, spots)


def escapes(layer: Layer) -> Iterator[Layer]:
    """Backslash and numeric character escapes; two surrogates make one character."""
    spots = []
    for m in ESCAPE.finditer(layer[0]):
        pieces: list[tuple[str, int, int]] = []
        for e in ONE_ESCAPE.finditer(m[0]):
            digits, base = next((g, 10 if i == 4 else 16) for i, g in enumerate(e.groups()) if g is not None)
            code, a, b = int(digits, base), m.start() + e.start(), m.start() + e.end()
            high = ord(pieces[-1][0]) if pieces and len(pieces[-1][0]) == 1 else 0
            if 0xDC00 <= code < 0xE000 and 0xD800 <= high < 0xDC00:
                code = 0x10000 + (high - 0xD800 << 10) + code - 0xDC00
                a = pieces.pop()[1]
            pieces.append((chr(code) if code < 0x110000 else "�", a, b))
        pieces = [("�" if 0xD800 <= ord(t) < 0xE000 else t, a, b) for t, a, b in pieces]
        spots.append((m.start(), m.end(), pieces))
    if spots:
        yield _replaced(layer, spots)


def base64_runs(layer: Layer) -> Iterator[Layer]:
    """Base64 runs of 12 characters or more that decode to text or to compressed data."""
    text, lo, hi = layer
    for m in BASE64.finditer(text):
        run = m[0].rstrip("=").replace("-", "+").replace("_", "/")
        if len(run) % 4 == 1:
            continue
        try:
            data = base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
        except (binascii.Error, ValueError):
            continue
        chars = readable(data)
        if chars is None:
            a, b = (lo, hi) if isinstance(lo, int) else (int(lo[m.start()]), int(hi[m.end() - 1]))
            yield from layers_of(data, a, b)
            continue
        if isinstance(lo, int):
            yield chars, lo, hi
            continue
        ends = np.cumsum([len(c.encode()) for c in chars])  # 3 bytes are 4 characters of the run
        first = m.start() + (ends - [len(c.encode()) for c in chars]) * 4 // 3
        past = m.start() + np.minimum(-(-ends * 4 // 3), len(run))
        yield chars, lo[first], hi[past - 1]


def spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The finds of the text itself, and those of all layers mapped to it, sorted."""
    base = sorted(scan(text))
    if not HINTS.search(text):
        return base, base
    found = set(base)
    places = np.arange(len(text) + 1)
    work: list[Layer] = [(text, places[:-1], places[1:])]
    seen: set[tuple] = set()
    while work:
        layer = work.pop()
        for decode in (percent, escapes, base64_runs):
            for new in decode(layer):
                chars, lo, hi = new
                one = isinstance(lo, int)
                mark = (hashlib.blake2b(chars.encode("utf-8", "surrogatepass"), digest_size=16).digest(), lo if one else int(lo[0]), hi if one else int(hi[-1]))
                if mark in seen:
                    continue
                seen.add(mark)
                found.update((lo, k, hi) if one else (int(lo[s]), k, int(hi[e - 1])) for s, k, e in scan(chars))
                work.append(new)
    return base, sorted(found)


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id``, counts and digest of the finds in the text itself
    (``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``) and ``spans``, all finds, those
    of decoded layers included, as kind:start:end in code points of the text.

    A null or empty text has no finds (the digest of the empty string). Repeated rows each
    give a row; finds that map to the same stretch and kind are one; a null id stays null;
    an empty table gives an empty result; further columns are ignored. Texts are read whole,
    one at a time; decoded data that expand are scanned window by window.
    """
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x in b.column(1):
                base, found = spans(x.as_py() or "")
                kinds = [k for _, k, _ in base]
                rows.append((*[kinds.count(k) for k in range(3)], hashlib.sha256(joined(base).encode()).hexdigest(), joined(found)))
            if rows:
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 3 + [pa.string()] * 2, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), *cols], names)

    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return cols.mapInArrow(work, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
