from __future__ import annotations

import itertools
import random

import numpy as np

from tickloom.llm import htmlcrf

SF = "/root/testdata/sf0.01"


def test_viterbi_and_likelihood_by_enumeration():
    rng = np.random.default_rng(1)
    crf = htmlcrf.Crf({}, rng.normal(size=(2, 2)), 0.3)
    seq = [htmlcrf.Block((str(i),)) for i in range(7)]
    u = rng.normal(size=7)
    crf.unary = lambda s: u[: len(s)]
    score = lambda y: y[0] * crf.start + sum(a * b for a, b in zip(u, y, strict=True)) + sum(crf.move[a, b] for a, b in zip(y, y[1:], strict=False))
    best = max(itertools.product((0, 1), repeat=7), key=score)
    assert crf.viterbi(seq) == list(best)


def test_blocks():
    page = """<!DOCTYPE html><title>no</title><script>var t="</p><p>no</p>";</script><body class="Main-Page"><p>One <b>two&nbsp;&amp;
     three<br>four<p>five<!-- <p>no</p> --> six<ul><li>a<li><a href=x>b</a></ul><div id=sideBar>z &lt;i&gt;</div><textarea>no</textarea><p>&#x41;&#66;"""
    got = htmlcrf.blocks(page)
    assert [b.text for b in got] == ["One two & three four", "five six", "a", "b", "z <i>", "AB"]
    assert got[0].path == ("body", ".main", ".page", "p") and got[1].path[-1] == "p"
    assert got[3].linked == 1 and got[4].path[-2:] == (".side", ".bar")
    for bad in (None, "", "<", "<div", "</p>", "<p", "text", "<script>x", "<!--", "&#xZZ; &bogus;", "<p a='>'>q"):
        htmlcrf.blocks(bad)
    assert [b.text for b in htmlcrf.blocks("<div>" * 5000 + "deep")] == ["deep"]


def test_block_features_read_the_whole_text():
    prose = "some plain words of a text " * 20
    of = lambda t: set(htmlcrf.text_features(htmlcrf.Block(("p",), text=t))) & {"mark", "digits"}
    assert of(prose) == set() and of("a | b") == {"mark"} and of("12 3") == {"digits"}
    assert of(prose + "one | two " * 100) == {"mark"} and of("a | b " + prose) == set()
    assert of(prose + "20 300 4000 " * 100) == {"digits"} and of("1 " * 100 + prose * 3) == set()


def test_held_out_labelled_pages():
    crf = htmlcrf.model()
    wrong = total = 0
    for seq, y in htmlcrf.labelled(200, 777):
        if seq:
            p = crf.viterbi(seq)
            wrong += sum(a != b for a, b in zip(p, y, strict=True))
            total += len(y)
    assert wrong <= 0.01 * total


def test_table(spark):
    """Against the article element, cut out by hand."""
    import html
    import re

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in htmlcrf.extract(pages).collect()}
    right = 0
    for r in pages.collect():
        inner = re.sub(r"</?b>", "", r.html[r.html.index("<article>") + 9 : r.html.index("</article>")])
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())
        right += got[r.page_id].text == want
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url
    assert right >= 0.99 * len(got)


def test_odd_rows(spark):
    long = "<article>" + "<p>some words of text here.</p>" * 20_000 + "</article>"
    rows = [(1, "u", None), (1, "u", ""), (None, None, "<article><p>A long enough text, it seems.</p></article>"), (2, "u", long), (2, "u", long), (3, "u", "\x00<p>")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, text string, n_chars string")
    out = htmlcrf.extract(df).collect()
    assert len(out) == 6 and [r.text for r in out if r.page_id == 1] == ["", ""]
    assert len({(r.text, r.n_chars) for r in out if r.page_id == 2}) == 1 and max(r.n_chars for r in out) > 400_000
    assert htmlcrf.extract(df.limit(0)).count() == 0


def test_training_is_repeatable():
    a, b = (htmlcrf.fit(htmlcrf.labelled(20, 1), epochs=2) for _ in range(2))
    assert a.weight == b.weight and random.random() >= 0
