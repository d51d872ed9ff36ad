import html
import itertools
import random
import re

import duckdb
import numpy as np
import pytest

from cuesheet.llm import crf, extract

DATA = "/root/testdata/sf0.01/pages.parquet"


@pytest.fixture(scope="module")
def pages():
    return [r[0] for r in duckdb.sql(f"select html from '{DATA}' order by page_id").fetchall()]


@pytest.fixture(scope="module")
def model(pages):
    return extract.fit(pages[:120])


def article_of(page):
    """Text of the article element, by patterns."""
    inner = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1].replace("<br>", " ")
    parts = re.split(r"</?(?:p|h1)>", inner)
    texts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in parts)
    return "\n".join(x for x in texts if x)


def test_held_out_pages(pages, model):
    out = extract.Extractor(model).texts(pages[120:])
    right = sum(o == article_of(p) for p, o in zip(pages[120:], out))
    assert len(out) > 100 and right >= 0.99 * len(out)


LAYOUT = """<html><head><title>T</title><style>p{}</style></head><body><div class="site-header"><h2>Site</h2></div>
<ul class="menu"><li><a href=x>Home</a><li><a href=y>About us</a></ul>
<div id="content"><h1>My great title</h1><p>First paragraph of the story, with &lt;b&gt; &amp; commas
  and   all.<p>Second<b> one</b>, &eacute;t&#233; and more.<!-- <p>no --><blockquote>A quote that someone said.</blockquote>
<ul><li>item one<li>item two</ul><div class="ad">Buy now our things, they are the best ones you can get today.</div>
<p>Last paragraph closes the story<br>in a good way.</div>
<aside><p>Another story that you may like, it is as long as a paragraph in here.</aside>
<section class="comments"><p>I liked this story very much, thank you for all of it.</section>
<form><p>Write to us about this story, we like to read what you say.</form><script>var t="<p>no";</script>
<div class="cookie-notice"><p>We use cookies to make this site better for you, please accept.</div><footer>&copy; 2020 Site"""


def test_other_layout(model):
    assert extract.Extractor(model).texts([LAYOUT])[0].split("\n") == [
        "My great title",
        "First paragraph of the story, with <b> & commas and all.",
        "Second one, été and more.",
        "A quote that someone said.",
        "item one",
        "item two",
        "Last paragraph closes the story in a good way.",
    ]


def test_odd_pages(model):
    odd = [None, "", "   ", "no tags at all", "<p", "<a href=\"x", "<!-- open", "<script>x", "&am", "<div>" * 20_000 + "x", "<p>w " * 20_000, "</p></div>x<>< y"]
    out = extract.Extractor(model).texts(odd)
    assert len(out) == len(odd) and out[:3] == ["", "", ""]
    paths = extract.Paths()
    assert len(extract.blocks_of("<p>w " * 20_000, paths)) == 20_000
    assert [b.text for b in extract.blocks_of("</p></div>x<>< y &am", paths)] == ["x<>< y &am"]


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(1)
    sizes = [1, 5, 3]
    item, moves = rng.normal(size=(sum(sizes), 2)), rng.normal(size=(2, 2))
    starts = np.array([0, 1, 6])
    out = crf.viterbi(item, starts, moves)
    first = np.log(np.exp(moves).sum(axis=0))
    for s, n in zip(starts, sizes):
        value = lambda p: first[p[0]] + sum(item[s + t, k] for t, k in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:]))  # noqa: E731,B023
        assert tuple(out[s : s + n]) == max(itertools.product((0, 1), repeat=n), key=value)


SCHEMA = "page_id long, url string, html string, text string, main_text int"


def test_query_columns(spark, pages):
    rng = random.Random(1)
    rows = [(i, f"u{i}", rng.choice(pages), "x", 1) for i in range(60)] + [(None, None, None, None, None), (1, "u", "", "", 0), (1, "u", "", "", 0)]
    out = extract.extract_pages(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows) and list(out[0].asDict()) == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.text, r.n_chars) for r in out if r.page_id is None or r.url == "u") == [("", 0)] * 3
    assert all(r.n_chars == len(r.text) for r in out)
    empty = spark.createDataFrame([], SCHEMA)
    assert extract.extract_pages(empty).count() == 0
    assert [r.text for r in extract.extract_pages(spark.createDataFrame([(1, "u", "<p>x", "", 0)], SCHEMA)).collect()] in ([""], ["x"])


def test_ancestors_count_at_any_depth(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    reader = extract.Extractor(extract.fit([p for p in pages if extract.is_labelled(p)][:150]))
    prose = "The river rose in the night, and by morning the lower fields were under water. " * 3

    def read(depth):
        inner = "<div>" * depth + "<p>%s</p>" + "</div>" * depth
        menu = inner % '<a href="/">All pages of this site</a>'
        page = f"<html><body><nav>{menu}</nav><article>{inner % prose}<p>{prose}</p></article></body></html>"
        return reader.texts([page])[0]

    assert read(40) == read(400) == read(5) == "\n".join([" ".join(prose.split())] * 2)


def test_features_of_a_path_are_those_of_its_words():
    paths = extract.Paths()
    at = 0
    for tag, names in (("body", ""), ("nav", 'class="menu top"'), *[("div", f'id="x{i % 3}"') for i in range(50)], ("li", "")):
        at = paths.child(at, tag, names)
        assert paths.features(at) == extract.path_features(paths.words(at))


def test_copies_do_not_fill_the_sample(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(extract, "fit", lambda pages: taken.append(pages))
    rows = [("<article>hot",)] * 3000 + [(f"<main>{i}",) for i in range(20)]
    extract.fitted(spark.createDataFrame(rows, "html string").repartition(4), most=10)
    assert len(taken[0]) == 10 == len(set(taken[0]))
