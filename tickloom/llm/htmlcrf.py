"""Main-text extraction: a linear-chain conditional random field over DOM leaf blocks.

A page becomes the sequence of its leaf blocks, each with its ancestor tags. Two labels
(main text or not), features of ancestors and text, weights fitted by likelihood on
labelled pages, the best label sequence found by Viterbi.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RAW = {"script", "style", "noscript", "template", "title", "textarea", "svg", "math", "iframe", "select", "object", "xmp", "noembed", "noframes"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
BLOCK = set(
    "html head body address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
CLOSES_P = BLOCK - {"html", "head", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = {"ul", "ol", "dl", "table", "menu"}
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)", re.S)
ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
SPLIT_NAME = re.compile(r"[^a-z]+")


@dataclass
class Block:
    """A leaf block: ancestors as ``tag`` and ``.name`` words, its text, and what the text looks like."""

    path: tuple[str, ...]
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def names(attrs: str) -> tuple[str, ...]:
    out = []
    for m in ATTR.finditer(attrs):
        key = m.group(1).lower()
        value = next((v for v in m.groups()[1:] if v is not None), "")
        if key in ("class", "id", "role"):
            out += ["." + w for w in SPLIT_NAME.split(re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower()) if w]
        elif value.lower() != "false":
            out.append(".hidden")
    return tuple(out)


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks with text, in page order; raw elements, comments and markup give none."""
    page = page or ""
    stack: list[tuple[str, tuple[str, ...]]] = []
    out: list[Block] = []
    now: Block | None = None
    links, at, end = 0, 0, len(page)

    def close() -> None:
        nonlocal now
        if now is not None:
            now.text = " ".join(entities.unescape("".join(now.pieces)).split())
            if now.text:
                out.append(now)
        now = None

    def add(text: str) -> None:
        nonlocal now
        if not text:
            return
        if now is None:
            if text.isspace():
                return
            now = Block(tuple(w for tag, words in stack for w in (tag, *words)))
        now.pieces.append(text)
        if links:
            now.linked += len(text)

    def drop(upto: int) -> None:
        close()
        del stack[upto:]

    while at < end:
        m = TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCK:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        drop(k)
                        break
                    if stack[k][0] in ("table", "td", "th") and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                        break
                links = links if stack else 0
        elif tag in RAW:
            stop = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            if not m.group(0).endswith("/>"):
                at = stop.end() if stop else end
        elif tag in ("br", "wbr", "hr"):
            if tag == "br" and now is not None:
                now.pieces.append(" ")
            elif tag == "hr":
                close()
        elif tag == "a":
            links = 1
        elif tag in BLOCK:
            close()
            if tag in CLOSES_P and stack and stack[-1][0] == "p":
                stack.pop()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in SELF_CLOSING.get(tag, ()):
                    del stack[k:]
                    break
                if stack[k][0] in SCOPE:
                    break
            stack.append((tag, names(m.group(3))))
            if len(stack) > 500:
                del stack[1]
    close()
    return out


def bucket(x: float, cuts: tuple[float, ...]) -> int:
    return sum(x >= c for c in cuts)


@lru_cache(maxsize=50_000)
def path_features(path: tuple[str, ...]) -> tuple[str, ...]:
    tags = [w for w in path if w[0] != "."]
    out = {f"in={w}" for w in path}
    out.add(f"leaf={tags[-1] if tags else ''}")
    out.add(f"pair={'/'.join(tags[-2:])}")
    return tuple(sorted(out))


def text_features(b: Block) -> tuple[str, ...]:
    t = b.text
    words = t.count(" ") + 1
    dense = bucket(b.linked / max(1, len(t)), (0.01, 0.34, 0.67))
    long = bucket(words, (3, 6, 11, 21, 41))
    ends = t[-1] in ".!?…。\"»”"
    out = [f"words={long}", f"links={dense}", f"ends={ends}", f"words,ends={long},{ends}", f"words,links={long},{dense}"]
    if "©" in t or "·" in t or t.count("|") * 80 >= max(80, len(t)):
        out.append("mark")
    if sum(map(str.isdigit, t)) * 5 > len(t):
        out.append("digits")
    return tuple(out)


@dataclass
class Crf:
    """Weights: label 1 against 0 per feature; ``move[i][j]`` from label i to label j."""

    weight: dict[str, float]
    move: np.ndarray
    start: float

    def __post_init__(self) -> None:
        self.paths: dict[tuple[str, ...], float] = {}

    def unary(self, seq: list[Block]) -> np.ndarray:
        w = self.weight
        out = np.empty(len(seq))
        for i, b in enumerate(seq):
            p = self.paths.get(b.path)
            if p is None:
                p = sum(w.get(f, 0.0) for f in path_features(b.path))
                if len(self.paths) < 50_000:
                    self.paths[b.path] = p
            out[i] = p + sum(w.get(f, 0.0) for f in text_features(b))
        return out

    def viterbi(self, seq: list[Block]) -> list[int]:
        """The most probable labels; ties go to label 0."""
        u = self.unary(seq).tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        s0, s1 = 0.0, self.start + u[0]
        back: list[tuple[int, int]] = []
        for x in u[1:]:
            f0, f1 = int(s1 + m10 > s0 + m00), int(s1 + m11 > s0 + m01)
            s0, s1 = (s1 + m10 if f0 else s0 + m00), (s1 + m11 if f1 else s0 + m01) + x
            back.append((f0, f1))
        y = [int(s1 > s0)]
        for f in reversed(back):
            y.append(f[y[-1]])
        return y[::-1]


def fit(pages: list[tuple[list[Block], list[int]]], epochs: int = 15, rate: float = 0.5, decay: float = 1e-3, seed: int = 5) -> Crf:
    """Maximum likelihood by stochastic gradient steps; expectations by forward-backward."""
    seqs = [[path_features(b.path) + text_features(b) for b in seq] for seq, _ in pages]
    index = {f: i for i, f in enumerate(sorted({f for s in seqs for fs in s for f in fs}))}
    ids = [[np.array([index[f] for f in fs]) for fs in s] for s in seqs]
    w, move, start = np.zeros(len(index)), np.zeros((2, 2)), 0.0
    square, sq_move, sq_start = np.full(len(index), 1e-6), np.full((2, 2), 1e-6), 1e-6
    rng = random.Random(seed)
    order = [i for i in range(len(pages)) if pages[i][0]]
    for _ in range(epochs):
        rng.shuffle(order)
        for k in order:
            y, rows = pages[k][1], ids[k]
            u = np.array([w[r].sum() for r in rows])
            n = len(rows)
            a, b = np.zeros((n, 2)), np.zeros((n, 2))
            a[0] = (0.0, start + u[0])
            for i in range(1, n):
                a[i] = np.logaddexp(a[i - 1][0] + move[0], a[i - 1][1] + move[1]) + (0.0, u[i])
            for i in range(n - 2, -1, -1):
                nxt = b[i + 1] + (0.0, u[i + 1])
                b[i] = np.logaddexp(move[:, 0] + nxt[0], move[:, 1] + nxt[1])
            z = np.logaddexp(*a[-1])
            p1 = np.exp(a[:, 1] + b[:, 1] - z)
            g_move = np.zeros((2, 2))
            for i in range(1, n):
                pair = a[i - 1][:, None] + move + (b[i] + (0.0, u[i]))[None, :] - z
                g_move -= np.exp(pair)
                g_move[y[i - 1], y[i]] += 1
            g_start = y[0] - p1[0]
            g = np.zeros(len(w))
            for i, r in enumerate(rows):
                g[r] += y[i] - p1[i]
            g -= decay * w
            square += g * g
            w += rate * g / np.sqrt(square)
            sq_move += g_move**2
            move += rate * g_move / np.sqrt(sq_move)
            sq_start += g_start**2
            start += rate * g_start / np.sqrt(sq_start)
    return Crf({f: float(w[i]) for f, i in index.items()}, move, start)


# --- labelled pages -------------------------------------------------------------------

SYLLABLES = "ka lo mi ren tas vo du pel ni sor ba ten qui za mar".split()
MAIN_SHELLS = (
    "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", '<div class="content"><div class="post">{}</div></div>',
    '<div id="main">{}</div>', '<section class="entry-content">{}</section>', '<div class="article-body">{}</div>', '<div id="content" role="main">{}</div>',
    '<div class="wrapper"><article class="story">{}</article></div>', "<table><tr><td>{}</td></tr></table>", "<div>{}</div>",
)


def labelled_page(rng: random.Random) -> tuple[str, list[str]]:
    """A page and its main blocks' texts. Main and other blocks draw on the same words."""
    main: list[str] = []

    def say(lo: int, hi: int, end: str = ".") -> str:
        words = ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(rng.randint(lo, hi))]
        return " ".join(words).capitalize() + end

    def link(lo: int = 1, hi: int = 3) -> str:
        return f'<a href="/{rng.randint(0, 999)}">{say(lo, hi, "")}</a>'

    def keep(text: str) -> str:
        main.append(text)
        return text

    def menu() -> str:
        return "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 8))) + "</ul>"

    def para() -> str:
        t = keep(say(1, 60))
        if rng.random() < 0.2:
            words = t.split(" ")
            k = rng.randrange(len(words))
            words[k] = f"<{(g := rng.choice(('b', 'em', 'a', 'span')))}>{words[k]}</{g}>"
            t = " ".join(words)
        return t

    def comments() -> str:
        each = rng.choice(('<div class="comment"><p>{}</p></div>', '<li class="comment">{}</li>', '<article class="comment"><p>{}</p></article>'))
        shell = rng.choice(('<section id="comments">{}</section>', '<div class="comments-area">{}</div>', '<div id="disqus_thread">{}</div>', '<ol class="commentlist">{}</ol>'))
        title = rng.choice(("", f"<h3>{say(1, 3, '')}</h3>"))
        return shell.format(title + "".join(each.format(say(3, 40)) for _ in range(rng.randint(1, 4))))

    def extra() -> str:
        kind = rng.randrange(12)
        if kind == 0:
            return f'<div class="{rng.choice(("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner"))}">{say(2, 25)}</div>'
        if kind == 1:
            return f'<aside{rng.choice(("", " class=sidebar"))}>{rng.choice((menu(), f"<p>{say(3, 30)}</p>", f"<h4>{say(1, 3, "")}</h4>{menu()}"))}</aside>'
        if kind == 2:
            return f'<div class="{rng.choice(("cookie", "cookie-notice", "notice", "alert", "consent", "gdpr", "warning", "message"))}">{rng.choice(("<p>{}</p>", "{}")).format(say(4, 30))}</div>'
        if kind == 3:
            return f"<form><label>{say(1, 3, '')}</label><input><p>{say(3, 12)}</p><button>{say(1, 2, '')}</button></form>"
        if kind == 4:
            return f'<div class="{rng.choice(("share", "social", "tags", "related", "breadcrumb", "pagination", "menu", "toc", "widget"))}">{menu() if rng.random() < 0.6 else link(2, 6)}</div>'
        if kind == 5:
            return comments()
        if kind == 6:
            return f'<div id="{rng.choice(("sidebar", "side", "left-column", "navbar", "toolbar"))}"><h3>{say(1, 3, "")}</h3><p>{say(2, 25)}</p>{menu()}</div>'
        if kind == 7:
            return f'<div class="{rng.choice(("newsletter", "subscribe", "signup", "popup", "modal", "login"))}"><p>{say(3, 20)}</p></div>'
        if kind == 8:
            return f'<div role="{rng.choice(("alert", "navigation", "banner", "complementary", "dialog"))}">{say(3, 25)}</div>'
        if kind == 9:
            return f'<section class="{rng.choice(("disclaimer", "legal", "copyright", "author-bio", "byline", "caption-credit"))}"><p>{say(3, 25)}</p></section>'
        if kind == 10:
            return f"<nav>{menu()}</nav>"
        return f'<div class="ad"><span>{say(1, 12)}</span></div>'

    def body() -> str:
        out = [f"<h1>{keep(say(2, 10, rng.choice(('', '.'))))}</h1>"]
        if rng.random() < 0.08:
            out = []
        for _ in range(rng.randint(1, 9)):
            kind = rng.random()
            if kind < 0.62:
                out.append(f"<p>{para()}</p>")
            elif kind < 0.7:
                out.append(f"<p><b>{keep(say(3, 40))}<br>")
            elif kind < 0.76:
                out.append(f"<h2>{keep(say(1, 6, ''))}</h2><p>{para()}</p>")
            elif kind < 0.82:
                out.append("<ul>" + "".join(f"<li>{keep(say(2, 14))}</li>" for _ in range(rng.randint(2, 4))) + "</ul>")
            elif kind < 0.86:
                out.append(f"<blockquote><p>{keep(say(5, 40))}</p></blockquote>")
            elif kind < 0.9:
                out.append("<table>" + "".join(f"<tr><th>{keep(say(1, 2, ''))}</th><td>{keep(say(1, 6, ''))}</td></tr>" for _ in range(2)) + "</table>")
            elif kind < 0.93:
                out.append(f"<pre>{keep(say(3, 20, ''))}</pre>")
            elif kind < 0.97:
                out.append(extra())
            else:
                out.append(f"<figure><figcaption>{keep(say(2, 12))}</figcaption></figure>")
        return "\n".join(out)

    before = rng.choice(("", f"<header><h2>{say(1, 3, '')}</h2><p>{say(2, 8)}</p></header>", f'<div id="header">{say(1, 4, "")}{menu()}</div>', f"<header><nav>{menu()}</nav></header>"))
    menu_bar = rng.choice((f"<nav>{menu()}</nav>", f'<div class="menu">{menu()}</div>', f"<nav>{link()} | {link()} | {link()}</nav>", ""))
    around = "".join(extra() for _ in range(rng.randint(0, 2)))
    text = rng.choice(MAIN_SHELLS).format(body())
    after = "".join(extra() for _ in range(rng.randint(0, 2)))
    if rng.random() < 0.3:
        after += comments()
    foot = rng.choice((f"<footer>&copy; {say(1, 3, '')} &middot; {say(2, 9)}</footer>", f"<footer><p>{say(2, 20)}</p></footer>", f'<div class="footer"><p>&copy; {rng.randint(1990, 2030)} {say(1, 5)}</p>{menu()}</div>', ""))
    return f"<html><head><title>{say(2, 6, '')}</title></head><body>{before}{menu_bar}{around}{text}{after}{foot}</body></html>", main


def labelled(n: int, seed: int) -> list[tuple[list[Block], list[int]]]:
    """``n`` labelled pages as block sequences with labels."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        page, main = labelled_page(rng)
        seq, want = blocks(page), set(main)
        out.append((seq, [int(b.text in want) for b in seq]))
    return out


@lru_cache(maxsize=1)
def model(pages: int = 300, seed: int = 11) -> Crf:
    """The field fitted on ``pages`` labelled pages (the bound of the training sample)."""
    return fit(labelled(pages, seed))


def main_text(page: str | None, crf: Crf) -> str:
    """Main blocks joined by one space; empty for null, empty and text-free pages."""
    seq = blocks(page)
    if not seq:
        return ""
    return " ".join(b.text for b, y in zip(seq, crf.viterbi(seq), strict=True) if y)


def extract(pages: DataFrame, crf: Crf | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: ``page_id``, ``url``, ``text`` and ``n_chars`` (code points).

    Null and empty pages, and pages without a main block, have an empty text; pages of any
    length are read whole; unclosed markup ends at the page's end; repeated rows and null
    ids pass through; an empty table gives an empty result. Other columns are ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast(crf or model())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            text = [main_text(x, m) for x in b.column(2).to_pylist()]
            n = pa.array([len(t) for t in text], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), n], ["page_id", "url", "text", "n_chars"])

    cols = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return cols.mapInArrow(work, "page_id long, url string, text string, n_chars long")
