"""Blocks of pages, the field against all labellings, and pages held out of the training."""

import html
import itertools
import math
import re

import numpy as np
import pytest

from tradespec.llm import html_extraction
from tradespec.llm.dom_blocks import blocks
from tradespec.llm.html_extraction import Field, extract, fit, laid_out, main_text, train
from tradespec.llm.labelled_pages import layouts

FOLDER = "/root/testdata/sf0.01"
PAGE = """<!DOCTYPE html><html><head><title>x</title></head><body class="home">
<div id="cookie-consent">We use cookies. Accept?</div>
<header class="site-header"><h1>My Site</h1><nav><a href="/">Home</a><a href="/b">Blog</a></nav></header>
<main><h2>A great story</h2><p>It was a dark &amp; stormy   night, and <i>rain</i> fell. <a href="#">See more</a> of it.</p>
<p>Short one.</p><div class="advertisement"><p>Buy now! Great deals await you.</p></div>
<ul><li>First point of the list.<li>Second point.</ul><p>Last paragraph, ending the story here.</p></main>
<aside class="sidebar"><h3>Related</h3><ul><li><a href="">One</a></li><li><a>Two</a></li></ul></aside>
<section id="comments"><h3>2 comments</h3><div class="comment"><p>I loved this story, thanks for it!</p></div>
<form><label>Name</label><textarea>t</textarea><button>Send</button></form></section>
<footer><p>&copy; 2024 My Site. All rights reserved.</p></footer><script>var a="<p>no</p>"</script></body></html>"""
STORY = [
    "A great story", "It was a dark & stormy night, and rain fell. See more of it.", "Short one.",
    "First point of the list.", "Second point.", "Last paragraph, ending the story here.",
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{FOLDER}/pages.parquet")


@pytest.fixture(scope="module")
def field(pages):
    return train(pages, rows=150)


def article(page):
    inner = page[page.index("<article>") : page.index("</article>")]
    parts = re.split(r"</?(?:article|h1|p)>", inner.replace("<b>", " ").replace("<br>", " "))
    texts = [" ".join(html.unescape(p).split()) for p in parts]
    return "\n\n".join(t for t in texts if t)


def test_every_page_of_the_table(pages, field):
    rows = {r.page_id: r for r in pages.collect()}
    found = extract(pages, field).collect()
    assert len(found) == len(rows)
    for row in found:
        assert row.text == article(rows[row.page_id].html)
        assert (row.url, row.n_chars) == (rows[row.page_id].url, len(row.text))


def test_a_page_by_hand(field):
    assert main_text(PAGE, field) == "\n\n".join(STORY)
    named = PAGE.replace("<main>", '<div class="post-content">').replace("</main>", "</div>")
    assert main_text(named, field) == "\n\n".join(STORY)


def test_layouts_held_out(pages, field):
    """Pages with other words and other chance than those of the training."""
    wrong = total = 0
    for page in pages.limit(40).collect():
        words = " ".join(b.text for b in blocks(page.html)).split()
        for made in layouts(words, 10**6 + page.page_id, 3):
            known, gold = laid_out(made)
            wrong += sum(a != b for a, b in zip(field.decode(known), gold))
            total += len(gold)
    assert total > 1500 and wrong < 0.03 * total


def test_awkward_rows(spark, field):
    rows = [
        (1, None, None, "v", 1), (2, "u", "", "v", 1), (3, "u", "no markup", "v", 1),
        (4, "u", "<p", "v", 1), (5, "u", "<!-- open <p>x</p>", "v", 1), (None, "u", PAGE, "v", 1),
        (None, "u", PAGE, "v", 1), (2**53 + 1, "u", "<article><p>" + "word and " * 60000, "v", 1),
    ]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    found = {(r.page_id, r.text, r.n_chars) for r in extract(table, field).collect()}
    story = "\n\n".join(STORY)
    long = ("word and " * 60000).strip()
    assert {(1, "", 0), (2, "", 0), (5, "", 0), (None, story, len(story))} <= found
    assert (2**53 + 1, long, len(long)) in found
    assert extract(table, field).count() == len(rows)


def test_an_empty_table_has_a_field(spark, pages):
    nothing = pages.limit(0)
    learned = train(nothing)
    assert extract(nothing, learned).count() == 0


def texts(page):
    return [b.text for b in blocks(page)]


def test_blocks_of_broken_markup():
    assert texts("a<p>b<p>c<div>d</div>e") == ["a", "b", "c", "d", "e"]
    assert texts("<p>a<br>b <b>c</b>d&nbsp;&lt;e&gt; &amp;amp; &am</p>") == ["a b cd <e> &amp; &am"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == ["a", "b", "c", "d"]
    assert texts("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"]
    assert texts("1 < 2 and 3 > 2 <3") == ["1 < 2 and 3 > 2 <3"]
    assert texts("<SCRIPT>x<p>y</SCRIPT ><p>z") == ["z"]
    assert texts("a<script>x<p>y") == ["a"]
    assert texts("a<noscript>b</noscript>c<noscript>d") == ["ac", "d"] or texts("a<noscript>b</noscript>c<noscript>d") == ["acd"]
    assert texts('<p title="a>b" class=x>c</p>') == ["c"]
    assert texts("<p title='a<b>c</p>") == ["c"]
    assert texts("</div></p>a") == ["a"]
    assert texts("<!DOCTYPE html><?xml?><!-- x > y -->a<!-->b-->c") == ["ac"]


def test_blocks_take_time_in_proportion():
    for part in ("<a ", "<p>", "<!-", '<a "', "</div>", "<noscript>", "<svg/>", "<<", "&#", "<li>"):
        assert list(blocks(part * 20000 + ">")) is not None


def test_ancestors_names_and_links():
    (block,) = blocks('<main id="postBody"><div class="a-b C"><p>x <a>yz</a></p></div></main>')
    assert block.tags == ("main", "div", "p") and block.linked == 2
    assert block.words == {"post", "body", "a", "b", "c"} and block.near == {"a", "b", "c"}


def test_decoding_finds_the_best_of_all_labellings():
    chance = np.random.default_rng(3)
    for length in (1, 2, 5, 8):
        for _ in range(20):
            weights = {f"f{i}": float(chance.normal()) for i in range(length)}
            follow = chance.normal(size=(2, 2)).tolist()
            field = Field(weights, follow, float(chance.normal()))

            def score(labels):
                own = sum(field.base + weights[f"f{i}"] for i, x in enumerate(labels) if x)
                return own + sum(follow[a][b] for a, b in zip(labels, labels[1:]))

            best = max(itertools.product((0, 1), repeat=length), key=score)
            assert field.decode([[f"f{i}"] for i in range(length)]) == list(map(bool, best))


def test_expected_counts_are_those_of_all_labellings():
    chance = np.random.default_rng(4)
    score, follow = chance.normal(size=(1, 5)), chance.normal(size=(2, 2))
    inside, both = html_extraction._expected(score, follow, np.ones((1, 5), bool))
    total, wanted, pairs = 0.0, np.zeros(5), np.zeros((4, 2, 2))
    for labels in itertools.product((0, 1), repeat=5):
        weight = math.exp(
            sum(score[0, i] for i in range(5) if labels[i])
            + sum(follow[a, b] for a, b in zip(labels, labels[1:]))
        )
        total += weight
        wanted += weight * np.array(labels)
        for t in range(4):
            pairs[t, labels[t], labels[t + 1]] += weight
    assert np.allclose(inside[0], wanted / total) and np.allclose(both[0], pairs / total)


def test_equal_training_gives_equal_fields():
    made = [laid_out(p) for p in layouts([f"w{i}" for i in range(50)], 3, 30)]
    assert fit(made).dumps() == fit(made).dumps()
