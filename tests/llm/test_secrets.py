"""Secret spans against a character-by-character unwrapping, and planted nested layers."""

from __future__ import annotations

import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import string
import urllib.parse
import zlib

import pytest

from tickloom.llm import queries, secrets

KEY = "AKIA" + "Q7ZX" * 4
ASSIGN = 'password = "hunter2hunter2"'


def b64(data: bytes | str) -> str:
    return base64.b64encode(data.encode() if isinstance(data, str) else data).decode()


def pct(s: str) -> str:
    return "".join(f"%{b:02x}" for b in s.encode())


def uni(s: str) -> str:
    return "".join(f"\\u{ord(c):04X}" for c in s)


WRAPS = {
    "base64": b64,
    "urlsafe": lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("="),
    "percent": pct,
    "partly": lambda s: urllib.parse.quote(s),
    "unicode": uni,
    "hexadecimal": lambda s: "".join(f"\\x{ord(c):02x}" for c in s),
    "html": lambda s: "".join(f"&#{ord(c)};" for c in s),
    "gzip": lambda s: b64(gzip.compress(s.encode(), mtime=0)),
    "zlib": lambda s: b64(zlib.compress(s.encode())),
    "bzip2": lambda s: b64(bz2.compress(s.encode())),
    "xz": lambda s: b64(lzma.compress(s.encode())),
    "percent zlib": lambda s: "".join(f"%{b:02X}" for b in zlib.compress(s.encode())),
}


def plain_base(text: str) -> list[tuple[str, int, int]]:
    """Leftmost finds by a scan from every place."""
    out = []
    rules = (
        ("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[1]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    )
    for kind, rule, keep in rules:
        i, pattern = 0, re.compile(rule, re.ASCII)
        while i < len(text):
            m = pattern.match(text, i)
            if m is None:
                i += 1
                continue
            if keep(m):
                out.append((kind, *m.span()))
            i = m.end()
    order = ["assign", "access", "hex"]
    return sorted(out, key=lambda x: (x[1], order.index(x[0]), x[2]))


def plain_layers(text: str) -> set[tuple[str, int, int]]:
    """All finds by recursion over lists of (character, start, end), one character at a time."""
    found, seen = set(), set()

    def visit(chars: list[tuple[str, int, int]]) -> None:
        s = "".join(c for c, _, _ in chars)
        mark = (s, chars[0][1], chars[-1][2])
        if mark in seen:
            return
        seen.add(mark)
        found.update((k, chars[a][1], chars[b - 1][2]) for k, a, b in plain_base(s))
        for pattern, read in ((r"%([0-9a-fA-F]{2})", lambda m: int(m[1], 16)), (r"\\u([0-9a-fA-F]{4})", lambda m: int(m[1], 16))):
            out, i = [], 0
            while i < len(s):
                m = re.compile(pattern).match(s, i)
                if m and (read(m) < 128 or pattern[0] == "\\"):
                    out.append((chr(read(m)), chars[i][1], chars[m.end() - 1][2]))
                    i = m.end()
                else:
                    out.append(chars[i])
                    i += 1
            if len(out) != len(chars):
                visit(out)
        for m in re.finditer(r"[A-Za-z0-9+/_-]{12,}", s):
            run = m[0].translate(str.maketrans("-_", "+/"))
            bits = "".join(f"{(string.ascii_uppercase + string.ascii_lowercase + string.digits + '+/').index(c):06b}" for c in run)
            data = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits) - 7, 8))
            if len(run) % 4 != 1 and data and all(32 <= x < 127 for x in data):
                visit([(chr(x), chars[m.start() + i * 8 // 6][1], chars[m.start() + (i * 8 + 7) // 6][2]) for i, x in enumerate(data)])

    if text:
        visit([(c, i, i + 1) for i, c in enumerate(text)])
    return found


@pytest.mark.parametrize("first", WRAPS)
@pytest.mark.parametrize("second", WRAPS)
def test_nested_secrets_are_found_in_their_place(first, second):
    for secret, kind in ((KEY, 1), (ASSIGN, 0)):
        wrapped = WRAPS[second](WRAPS[first](secret))
        text = f"é some words | {wrapped} | more words"
        base, found = secrets.spans(text)
        start = text.index(wrapped)
        hits = [(s, e) for s, k, e in found if k == kind and start <= s and e <= start + len(wrapped)]
        assert hits, (first, second)
        assert set(base) <= set(found)
        assert max(e - s for s, e in hits) >= 0.5 * len(wrapped) - 8


def test_random_texts_against_plain():
    r = random.Random(7)
    pool = [KEY, ASSIGN, "token:abcdef1234", "secret='x'", "0123456789abcdef" * 2, "words here", "%41%zz", "\\u0041", "ünï"]
    for _ in range(300):
        parts = []
        for _ in range(r.randint(1, 5)):
            p = r.choice(pool)
            for _ in range(r.randint(0, 3)):
                p = r.choice([b64, uni, pct, str])(p) if p.isascii() else p
            parts.append(p)
        text = r.choice(["", " "]).join(parts)
        base, found = secrets.spans(text)
        assert [(secrets.KINDS[k], s, e) for s, k, e in base] == plain_base(text)
        assert {(secrets.KINDS[k], s, e) for s, k, e in found} == plain_layers(text), text


def test_a_name_before_an_escape_counts():
    text = "x token=%61%62%63%64%65%66 y"
    assert secrets.joined(secrets.spans(text)[1]) == f"assign:2:{len(text) - 2}"


def test_layers_end_and_bombs_stay_small():
    text = "%25" * 50 + " " + b64(zlib.compress(b"a" * 30_000_000 + KEY.encode() + b" " * 5_000_000))
    _, found = secrets.spans(text)
    assert (151, 1, len(text.rstrip("="))) in found or (151, 1, len(text)) in found


def test_kelvin_sign_is_no_letter():
    assert secrets.spans("toKen=abcdefgh")[1] == []


def test_odd_rows(spark, odd, none, odd_rows):
    got = secrets.find_secrets(odd).collect()
    assert len(got) == len(odd_rows)
    empty = hashlib.sha256(b"").hexdigest()
    for r in got:
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["spans"]) == (0, 0, 0, "") and r["base_sha256"] == empty
    assert secrets.find_secrets(none).collect() == []


def test_query_against_plain(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in queries.QUERIES["op12_layered_secrets"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        base = plain_base(d["text"] or "")
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        r = got[d["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x for k, _, _ in base) for x in ("assign", "access", "hex")]
        if len(d["text"] or "") < 3000:
            assert set(filter(None, r["spans"].split(","))) == {f"{k}:{s}:{e}" for k, s, e in plain_layers(d["text"] or "")}
