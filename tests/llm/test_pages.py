"""Main text of pages outside of the fit (looked at while its labelled pages were chosen): without article, with odd names, with formulas, and very deep."""

import time

import numpy as np
import pytest

from tidemark.llm import html_content

RIVER = "The river rose early that year and the fields by the mill were under water for a week."
MARKET = "On Tuesdays the square fills with carts, and by noon most of the bread and the cheese is gone."
SHIP = "She carried timber to the south and came home with salt, wine and letters for half the town."
NOTE = "Written by the keeper."
ITEMS = "".join(f'<li><a href="/{i}">Item {i}</a></li>' for i in range(6))
#: Pages written by hand, with the text that a reader would call the article.
HELD_OUT = [
    (f'<body><ul class="menu">{ITEMS}</ul><div><div><p>{RIVER} {SHIP}</p><p>{MARKET}</p></div></div></body>', [f"{RIVER} {SHIP}", MARKET]),
    (f'<body><nav><ul>{ITEMS}</ul></nav><article><h1>Markets</h1><p>{RIVER} {MARKET}</p><div class="share-price"><p>The share price rose by two points.</p></div><div class="share-links"><a href="x">Send</a></div></article></body>', ["Markets", f"{RIVER} {MARKET}", "The share price rose by two points."]),
    (f'<body><article><h1>Verse</h1><p>{RIVER}</p><div class="form-of-verse"><p>Roses are red.</p></div><p>{SHIP}</p></article><form><p>Send me mail</p></form></body>', ["Verse", RIVER, "Roses are red.", SHIP]),
    (f'<body><article><p>{RIVER} where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p><noscript><p>{MARKET}</p></noscript><p>{SHIP} <svg><text>label</text></svg></p></article></body>', [f"{RIVER} where x=2 holds.", MARKET, f"{SHIP} label"]),
    (f'<body><div id="page"><div class="top-menu"><ul>{ITEMS}</ul></div><div class="col-md-8"><h2>Title here</h2><p>{RIVER}</p><p>{MARKET} {SHIP}</p></div><div class="col-md-4 sidebar"><p>{RIVER}</p></div></div></body>', ["Title here", RIVER, f"{MARKET} {SHIP}"]),
    (f'<body><header><p>Town paper</p></header><main><h1>Flood</h1><p>{RIVER}</p><blockquote>{SHIP}</blockquote><aside><p>{MARKET}</p></aside><p>{MARKET}</p></main><div id="comments"><p>{SHIP}</p></div><footer>{NOTE}</footer></body>', ["Flood", RIVER, SHIP, MARKET]),
    (f'<body><div class="cookie-bar"><p>We use cookies to see who reads what on these pages.</p></div><div class="entry"><p>{RIVER}</p><ul><li>{MARKET}</li><li>{SHIP}</li></ul></div></body>', [RIVER, MARKET, SHIP]),
    (f'<body><section><h1>Ships</h1><p>{SHIP}</p><p>{RIVER}</p><p>{MARKET}</p></section><div class="relatedPosts"><h3>More</h3><ul>{ITEMS}</ul></div><footer><p>{NOTE}</p></footer></body>', ["Ships", SHIP, RIVER, MARKET]),
    (f'<body><article><h1>Ships</h1><p>{SHIP}</p><table><tr><td>{RIVER}</td><td>Ten</td></tr></table><div class="ad"><p>{MARKET}</p></div><p>{RIVER}</p></article></body>', ["Ships", SHIP, RIVER, "Ten", RIVER]),
    (f'<body><p>{RIVER}</p><p>{MARKET}</p><p>{SHIP}</p></body>', [RIVER, MARKET, SHIP]),
]


BRIDGE = "The bridge was built by hand over nine summers and one very cold autumn."
STONE = "Nobody recalls who set the first stone, but the last one bears a date."
LINKS = "".join(f'<a href="/n{i}">Section {i}</a> ' for i in range(7))
#: Pages written after the fit was final; the model misses one (comments inside of the article).
UNSEEN = [
    (f'<body><div class="header-wrap"><a href="/">Home</a></div><div class="hero"><h1>Bridge</h1></div><div class="rich-text"><p>{BRIDGE}</p><p>{STONE}</p></div><div class="promo-box">{STONE}</div></body>', ["Bridge", BRIDGE, STONE]),
    (f'<body><div role="navigation">{LINKS}</div><div role="main"><h1>Bridge</h1><p>{BRIDGE}</p><pre>code here</pre><p>{STONE}</p></div><div role="contentinfo">{STONE}</div></body>', ["Bridge", BRIDGE, "code here", STONE]),
    (f'<body><table><tr><td class="leftnav">{LINKS}</td><td><h2>Bridge</h2><p>{BRIDGE}</p><p>{STONE}</p></td></tr></table></body>', ["Bridge", BRIDGE, STONE]),
    (f'<body><article class="post"><header><h1>Bridge</h1></header><p>{BRIDGE}</p><div class="inline-ad">{STONE}</div><p>{STONE}</p><section id="user-comments"><article><p>{BRIDGE}</p></article></section></article></body>', [BRIDGE, STONE]),
    (f'<body><main class="layout"><div class="grid"><div class="prose-block"><p>{BRIDGE}</p></div><div class="prose-block"><p>{STONE}</p></div></div><div class="newsletter-box"><p>{BRIDGE}</p><input></div></main></body>', [BRIDGE, STONE]),
    (f'<body>{LINKS}<hr><h1>Bridge</h1><p>{BRIDGE}</p><p>{STONE}</p><hr>&copy; Keeper</body>', ["Bridge", BRIDGE, STONE]),
]


@pytest.fixture(scope="module")
def model(spark):
    return html_content.fit(spark.createDataFrame([], "page_id long, html string"))


def test_held_out_pages(model):
    found = html_content.texts_of([page for page, _ in HELD_OUT], model)
    right = [text == "\n".join(wanted) for text, (_, wanted) in zip(found, HELD_OUT, strict=True)]
    assert all(right), [found[i] for i, x in enumerate(right) if not x]


def test_unseen_pages(model):
    found = html_content.texts_of([page for page, _ in UNSEEN], model)
    assert sum(text == "\n".join(wanted) for text, (_, wanted) in zip(found, UNSEEN, strict=True)) >= 5


def test_both_orders_of_messages_agree():
    r = np.random.default_rng(3)
    n = 400
    parent = np.array([-1] + [int(r.integers(max(0, i - 60), i)) for i in range(1, n)])
    depth = np.zeros(n, np.int64)
    for i in range(1, n):
        depth[i] = depth[parent[i]] + 1
    assert depth.max() * 4 <= n
    unary, pair = r.normal(size=(n, 2)), r.normal(size=(n, 2, 2))
    for x, y in zip(html_content.marginals(parent, depth, unary, pair), html_content._marginals_in_turn(parent, unary, pair), strict=True):
        assert np.allclose(x, y, atol=1e-12)


def test_very_deep_pages(model):
    depth = 100_000
    start = time.time()
    pages = ["<article>" + "<div>" * depth + RIVER + "</div>" * depth + "</article>", f"<p>{RIVER}<td>" * 20_000, "<ul><li>a" * 20_000 + "</ul>" * 20_000]
    assert len(html_content.texts_of(pages, model)) == 3
    assert time.time() - start < 30


def test_ties_keep_text_and_empty_pages():
    tables = [np.zeros(n) for _, n in html_content.FEATURES]
    even = (tables, np.zeros(html_content.NAMES), np.zeros((2, 2, len(html_content.GROUPS))))
    assert html_content.texts_of(["<p>even</p>", None, "", "<!-- only a note -->"], even) == ["even", "", "", ""]
