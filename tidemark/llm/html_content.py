"""Main text of web pages by a tree-structured graphical model over DOM nodes.

Every element of a page is a binary variable: content or not. A node's unary
potential comes from its tag group, the length of its text, the share of that
text inside links, its parent's tag group, and learned weights of the hashed words
of its own and its parent's class, id and role; the words of one name share its weight, so an unknown word beside a known
one halves what that says. A potential between parent and child, by the child's
tag group, says how often content begins, goes on or ends there. Sum-product
messages run from the leaves to the root and back and give the exact marginal of
each node; text whose parent element is content with probability one half or
more is kept (a tie keeps the text).

The potentials are fitted by maximum likelihood over labelled pages: small
hand-labelled pages, with and without an article element, and a bounded sample
of the pages themselves. Of these, the ones with one article or main element and
no named element inside it label themselves; names are thus learned from the
hand-labelled pages, and from what stands outside of articles.

Inference takes all nodes of a block of pages at once, one tree level at a
time, or node by node where the trees are deep and thin; both take time linear in
the nodes. Null and empty pages give an empty text. Rows are returned as often as
they occur, and other columns pass through (``text`` and ``n_chars`` are replaced).
"""

from __future__ import annotations

import html as entities
import math
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

# HTML's element groups.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style template iframe textarea noframes".split())  # their content is not markup, or is not shown
INLINE = set("a abbr b bdi bdo big br cite code canvas del dfn em font i img ins kbd mark math noscript object q s samp small span strike strong sub sup svg time tt u var wbr".split())
MATHS = set("mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot munder mover munderover mstyle mpadded semantics annotation text tspan".split())  # inside math and svg: no new block
GROUPS = ["other", "root", "head", "article", "section", "paragraph", "heading", "list", "table", "quote", "inline", "link", "nav", "header", "footer", "aside", "form"]
GROUP_TAGS = {
    "root": "html body", "head": "head title", "article": "article main", "section": "div section center figure figcaption details summary address hgroup picture video audio",
    "paragraph": "p br hr", "heading": "h1 h2 h3 h4 h5 h6", "list": "ul ol li dl dt dd", "table": "table thead tbody tfoot tr td th caption colgroup",
    "quote": "blockquote pre", "link": "a", "nav": "nav menu", "header": "header", "footer": "footer", "aside": "aside dialog",
    "form": "form input button select option optgroup label fieldset legend datalist output progress meter",
}
FEATURES = [("tag", len(GROUPS)), ("above", len(GROUPS)), ("length", 5), ("links", 4)]
NAMES = 1 << 15  # buckets of hashed words of names

_PIECE = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]|=\s*"[^"]*"|=\s*'[^']*'|[="'])*+)(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_GROUP_OF = {tag: GROUPS.index(g) for g, tags in GROUP_TAGS.items() for tag in tags.split()} | {t: GROUPS.index("inline") for t in INLINE if t not in ("a", "br")} | {t: GROUPS.index("inline") for t in MATHS}
_CLOSES_P = {t for g in ("article", "section", "heading", "list", "table", "quote", "nav", "header", "footer", "aside") for t in GROUP_TAGS[g].split()} | {"p", "form", "fieldset", "hr"}
_HOLDS_P = {"td", "th", "button"}
_SIBLING = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


def name_words(attributes: str, mark: str = "") -> list[tuple[int, float]]:
    """Buckets of the words of class, id and role, and their beginnings, with the share of each in its name; a mark gives buckets of their own."""
    if "=" not in attributes:
        return []
    found = []
    for value in _NAMES.findall(attributes):
        for name in "".join(value).split():
            words = [w.lower() for w in _WORDS.findall(name)]
            for w in words:
                found.append((zlib.crc32(f"{mark}{w}".encode()) % NAMES, 1.0 / len(words)))
                found.append((zlib.crc32(f"{mark}^{w[:5]}".encode()) % NAMES, 1.0 / len(words)))
    return found


class Page:
    """Elements of a page in document order, and its text pieces with their element and block number."""

    def __init__(self, source: str):
        self.parent, self.group, self.attributes, self.tags, self.depth = [-1], [1], [""], ["#root"], [0]
        self.texts: list[tuple[int, int, str]] = []
        self._parse(source)

    def _parse(self, source: str) -> None:
        stack, at, block = [0], 0, 0
        places: dict[str, list[int]] = {}  # by tag, where its open elements stand in the stack
        lower = None

        def pop_to(place: int) -> None:
            for node in stack[place:]:
                places[self.tags[node]].pop()
            del stack[place:]

        def innermost(tags: set[str]) -> int:
            return max((places[t][-1] for t in tags if places.get(t)), default=0)

        while at < len(source):
            m = _PIECE.search(source, at)
            if text := source[at : m.start() if m else None]:
                self.texts.append((stack[-1], block, entities.unescape(text) if "&" in text else text))
            if not m:
                break
            at = m.end()
            closing, tag, attributes = m[1], m[2], m[3]
            if tag is None:
                continue
            tag = tag.lower()
            if tag not in INLINE and tag not in MATHS:
                block += 1
            elif tag == "br":
                self.texts.append((stack[-1], block, " "))
                continue
            if closing:
                if places.get(tag):
                    pop_to(places[tag][-1])
                continue
            if tag in RAW:
                lower = lower or source.lower()
                if not attributes.endswith("/"):
                    end = lower.find(f"</{tag}", at) if len(lower) == len(source) else -1
                    if len(lower) != len(source):  # lower-casing changed the length
                        found = re.compile(f"</{tag}", re.I).search(source, at)
                        end = found.start() if found else -1
                    at = end if end >= 0 else len(source)
                continue
            if tag in _CLOSES_P and places.get("p") and innermost(_HOLDS_P) < places["p"][-1]:
                pop_to(places["p"][-1])
            if tag in _SIBLING:
                ends, within = _SIBLING[tag]
                border = innermost(within)
                open_ends = [x[i] for t in ends if (x := places.get(t)) and (i := bisect_right(x, border)) < len(x)]
                if open_ends:
                    pop_to(min(open_ends))
            self.parent.append(stack[-1])
            self.group.append(_GROUP_OF.get(tag, 0))
            self.attributes.append(attributes)
            self.tags.append(tag)
            self.depth.append(self.depth[stack[-1]] + 1)
            if tag not in VOID and not attributes.endswith("/"):
                places.setdefault(tag, []).append(len(stack))
                stack.append(len(self.parent) - 1)

    def features(self) -> np.ndarray:
        """One row per node, one column per entry of FEATURES."""
        n = len(self.parent)
        length, linked = np.zeros(n), np.zeros(n)
        link = GROUPS.index("link")
        inside = [False] * n
        for i in range(1, n):
            inside[i] = self.group[i] == link or inside[self.parent[i]]
        for node, _, text in self.texts:
            size = len(text.strip())
            length[node] += size
            linked[node] += size * inside[node]
        for i in range(n - 1, 0, -1):
            length[self.parent[i]] += length[i]
            linked[self.parent[i]] += linked[i]
        share = linked / np.maximum(length, 1)
        group = np.array(self.group)
        above = np.where(np.array(self.parent) < 0, 1, group[self.parent])
        return np.stack([group, above, np.searchsorted([1, 20, 80, 300], length, "right"), np.searchsorted([0.01, 0.3, 0.7], share, "right")], axis=1)

    def names(self) -> np.ndarray:
        """(node, bucket, share) of the words of each element's and its parent's names, one row per word."""
        own = [name_words(a) for a in self.attributes]
        above = {i: name_words(self.attributes[i], ">") for i, words in enumerate(own) if words}
        return np.array([(i, *x) for i, p in enumerate(self.parent) for x in (*own[i], *above.get(p, ()))], np.float64).reshape(-1, 3)

    def own_labels(self) -> np.ndarray | None:
        """Labels read off the page: inside its one article or main and outside of furniture elements; None if it has none, several, or names inside."""
        article, furniture = GROUPS.index("article"), {GROUPS.index(g) for g in ("nav", "header", "footer", "aside", "form")}
        if self.group.count(article) != 1:
            return None
        out, within = np.zeros(len(self.parent), np.int64), [False] * len(self.parent)
        for i in range(1, len(out)):
            within[i] = within[self.parent[i]] or self.group[i] == article
            if within[self.parent[i]] and name_words(self.attributes[i]):
                return None
            out[i] = 0 if self.group[i] in furniture else 1 if self.group[i] == article else out[self.parent[i]]
        return out

    def marked_labels(self) -> np.ndarray:
        """Labels of hand-labelled pages: the attribute k begins content, x ends it."""
        out = np.zeros(len(self.parent), np.int64)
        for i in range(1, len(out)):
            marks = self.attributes[i].split()
            out[i] = 1 if "k" in marks else 0 if "x" in marks else out[self.parent[i]]
        return out


def _labelled_pages() -> list[str]:
    """Small labelled pages: attribute k marks content, x marks furniture inside of it.

    They teach what names say (furniture, content, and names of content that hold
    a word of furniture), and prose without an article element or without any name.
    """
    long, short = "Long running prose with many plain words, as articles have it. " * 6, "A plain sentence of some words."
    medium = "Some prose of one or two plain sentences. It says what a page has to say. " * 2
    link = '<a href="/a">Short link</a>'
    links = "".join(f"<li>{link}</li>" for _ in range(5))
    top = f'<head><title>Name</title></head><body><header>{short}</header><nav><ul>{links}</ul></nav>'
    end = f'<footer>{short} {link}</footer></body>'
    body = f"<h1>{short}</h1><p>{long}</p><p>{long} {link} {short}</p><h2>{short}</h2><ul><li>{short}</li><li>{long}</li></ul><blockquote>{long}</blockquote><table><tr><td>{short}</td></tr></table><pre>{short}</pre><p>{short}</p><p><b>{short}</b> {long}</p>"
    names = """ad advert advertisement ads ad-box ad-slot adsense sponsor sponsored promo promotion banner sidebar side-bar side-column right-rail nav navbar navigation nav-links
    menu menu-item main-menu header site-header page-header masthead topbar toolbar footer site-footer page-footer breadcrumb breadcrumbs comments comment comment-list reply replies respond disqus_thread discussion
    cookie-notice cookie-banner cookies consent gdpr-notice privacy-notice notice notice-box alert popup modal overlay share share-buttons sharing social social-links social-share follow follow-us
    related related-posts related-articles recommended recommendations more-stories newsletter newsletter-signup subscribe subscription signup login register search search-box form widget widget-area pagination pager
    copyright legal skip-link contentinfo complementary dialog toast outbrain taboola trending popular popular-posts donate paywall author-box tags""".split()
    holders = "content post-content article article-body entry entry-content story story-body main main-content body-text post text prose page-content".split()
    mixed = """share-price share-holders form-of-verse form-letter header-of-chapter chapter-header-image comment-on-law commentary-text notice-of-motion legal-history legal-essay search-for-truth social-history social-science
    menu-of-dishes side-effects popular-science popular-music related-work alert-system banner-years follow-river tags-explained promotion-rules ad-hoc-report register-of-ships navigation-at-sea widget-theory footer-of-page-two
    cookie-recipe login-shells overlay-network modal-logic modal-verbs dialog-scene privacy-law consent-theory discussion-of-results sponsor-of-bill newsletter-history subscription-model copyright-history""".split()
    pages = []
    for i, name in enumerate(names):
        other, odd = names[(i + 17) % len(names)], mixed[i % len(mixed)]
        holder = ["<article k>", "<main k>", *(f'<div class="{h}" k>' if j % 2 else f'<div id="{h}" k>' for j, h in enumerate(holders)), "<article k><div>", "<div k><div>", "<div k>", "<div><div k>", "<section k>"][i % (7 + len(holders))]
        inner = f'<div class="{name}" x><p>{long if i % 2 else short}</p><div><p>{short}</p><p>{medium}</p></div><ul>{links}</ul></div>'
        outer = f'<div class="{other}"><p>{short if i % 2 else long}</p><h3>{short}</h3></div>'
        own = f'<div class="{odd}"><p>{medium if i % 2 else long}</p><p>{short}</p></div><figure><figcaption>{short}</figcaption></figure>'
        tiny = "".join(f"<p>{w}</p>" for w in ("Tiny.", "A few words.", "Some more words here.", "End.") * (1 + 5 * (i % 3)))
        shut = "</div></div></section></article></main>"
        pages.append(f"<html>{top}{outer}{holder}{body}{own}{inner}{shut}{outer}<aside><h3>{short}</h3><p>{long}</p><ul>{links}</ul></aside>{end}</html>")
        few = "".join(f"<p>{(medium, long, short)[(i + j) % 3]}</p>" for j in range(1 + i // 5 % 4))
        wrap = ["", '<div class="wrap">', '<div id="page">', "<div>", '<div class="container"><div class="row">', "<main>"][i % 6]
        element = ("aside", "form", "nav", "footer", "header")[i % 5]
        pages.append(f'<html><body>{wrap}{holder}<h2>{short}</h2>{few}<{element} x><p>{medium if i % 2 else short}</p></{element}><p>{medium}</p><aside x><p>{medium}</p></aside></div></section></article></main><div class="{name}">{short}</div></body></html>' if i % 2 else f'<html><body>{"<header>Name</header>" if i % 3 else ""}{few.replace("<p>", "<p k>")}<h2 k>{short}</h2><p k>{long}</p><div class="{name}"><p>{short}</p></div><{element}><p>{short}</p></{element}></body></html>')
        for small in ["<article k>", ["<main k>", "<section k>", "<article k><div>"][i % 3], "<div k>" if i % 2 else "<div><div k>", holder]:
            pages.append(f'<html><body>{wrap}<header><p>{short}</p></header><div class="{name}"><p>{medium if i % 3 else short}</p></div>{small}<h2>{short}</h2>{few}<div class="{other}" x><p>{short}</p></div></div></section></article><aside><p>{medium}</p></aside><footer>{short}</footer></body></html>')
        small = ["<article k>", "<main k>", "<div k>", "<div><div k>", holder][i % 5]
        pages.append(f'<html>{top if i % 2 else "<body>"}<div class="{name}">{medium if i % 3 else short}</div>{small}<h1>{short}</h1>{few}<div class="{odd}"><p>{short}</p></div>{shut}<div class="{other}"><ul>{links}</ul></div>{end}</html>')
        match i % 4:
            case 0:
                pages.append(f'<html>{top}{holder}<h1>{short}</h1><p>{short}</p><form x><label>{short}</label><p>{short}</p><button>{short}</button></form><section class="{name}" x><h2>{short}</h2><p>{long}</p><article><p>{long}</p></article></section><aside x><p>{long}</p></aside><nav x><ul>{links}</ul></nav><header x><p>{short}</p></header><footer x><p>{short}</p></footer><p>{long}</p>{shut}{end}</html>')
            case 1:
                pages.append(f'<html><body><div class="wrap"><header><p>Name</p></header><article k><h1>T</h1><p>One {link} two.</p><div class="{other}-box" x><p>{short}</p></div>{tiny}<p><b>{short}<br></p><section class="{name}" x><h2>Tiny</h2><p>{short}</p></section></article><div class="{name}">{short} <button>OK</button></div><form><p>Tiny</p></form><footer>{short}</footer></div></body></html>')
            case 2:
                pages.append(f'<html><body><ul class="{name}">{links}</ul><div><div k><p>{medium}</p><p>{long}</p><p>{short}</p><div class="{odd}"><p>{short}</p></div></div></div><div class="{other}"><p>{medium}</p></div>{end}</html>')
            case _:
                pages.append(f'<html><body><nav>{link} {link} {link}</nav><div k><h1>{short}</h1><p>{medium}</p><p>{medium} {link}</p><ul><li>{short}</li><li>{short}</li></ul></div><div><ul>{links}</ul></div><div class="{name}">{short}</div>{end}</html>')
    pages.append(f"<html><head><title>Name</title></head><body k><h1>{short}</h1><p>{medium}</p><p>{long}</p><nav x><ul>{links}</ul></nav><footer x>{short}</footer></body></html>")
    pages.append(f"<html><head><title>Name</title></head><body><p k>{long}</p><p k>{medium}</p><ul>{links}</ul><p k>{long}</p>{end}</html>")
    return pages


Nodes = tuple[np.ndarray, np.ndarray]  # one row per node; one row per word of a name
Model = tuple[list[np.ndarray], np.ndarray, np.ndarray]  # weights of the features, of the words of names, of parent and child


def _arrays(page: Page, labels: np.ndarray, weight: float) -> Nodes:
    """parent, depth, label, weight and features of a page's nodes, and the words of their names."""
    n = len(page.parent)
    return np.column_stack([page.parent, page.depth, labels, np.full(n, weight), page.features()]).astype(np.float64), page.names()


def join_pages(pages: list[Nodes]) -> Nodes:
    """The nodes of several pages as one forest."""
    sizes = [len(p) for p, _ in pages]
    starts = np.cumsum([0, *sizes])[:-1]
    out, names = np.concatenate([p for p, _ in pages]), np.concatenate([w for _, w in pages])
    out[:, 0] = np.where(out[:, 0] < 0, -1, out[:, 0] + np.repeat(starts, sizes))
    names[:, 0] += np.repeat(starts, [len(w) for _, w in pages])
    return out, names


def fit(pages: DataFrame, *, sample: int = 400, seed_weight: float = 3.0, html: str = "html", key: str = "page_id") -> Model:
    """Potentials by maximum likelihood over the labelled pages.

    At most ``sample`` of the given pages are used, taken in hash order of their
    key, and of these the ones that label themselves; Spark parses them, and the
    fit on the driver sees a few numbers per element.
    """
    chosen = pages.select(key).where(F.col(key).isNotNull()).distinct().orderBy(F.xxhash64(key), key).limit(sample)
    rows = pages.select(key, html).dropDuplicates([key]).join(F.broadcast(chosen), key, "left_semi")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = []
            for h in batch.column(1):
                page = Page(h.as_py() or "")
                if (y := page.own_labels()) is not None:
                    found.append([x.tobytes() for x in _arrays(page, y, 1.0)])
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.binary()) for i in (0, 1)], ["nodes", "names"])

    width = 4 + len(FEATURES)
    own = sorted((r.nodes, r.names) for r in rows.mapInArrow(run, "nodes binary, names binary").collect())
    seeds = [_arrays(p, p.marked_labels(), seed_weight) for p in map(Page, _labelled_pages())]
    return maximise(*join_pages(seeds + [(np.frombuffer(x).reshape(-1, width), np.frombuffer(w).reshape(-1, 3)) for x, w in own]))


def maximise(nodes: np.ndarray, names: np.ndarray, *, steps: int = 400, rate: float = 0.1, penalty: float = 0.5, word_penalty: float = 0.02) -> Model:
    """Log-linear potentials: weights of features and words for label 1 and a table (parent label, label, tag group).

    The gradient is the labels' counts less those expected under the marginals
    of nodes and of parent-child pairs, both exact on trees.
    """
    parent, depth, y, weight = nodes[:, 0].astype(np.int64), nodes[:, 1].astype(np.int64), nodes[:, 2].astype(np.int64), nodes[:, 3]
    x = nodes[:, 4:].astype(np.int64)
    sizes = [n for _, n in FEATURES]
    theta = np.zeros(sum(sizes) + NAMES + 4 * len(GROUPS))
    of, bucket, share = names[:, 0].astype(np.int64), names[:, 1].astype(np.int64), names[:, 2]
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    held = np.full_like(theta, penalty)
    held[sum(sizes) : sum(sizes) + NAMES] = word_penalty
    child = parent >= 0
    cell = lambda above, own: (above * 2 + own) * len(GROUPS) + x[child, 0]
    for step in range(1, steps + 1):
        node, edge = marginals(parent, depth, *_scores(_unpack(theta), parent, x, names))
        gradient = [np.bincount(x[:, k], weight * (y - node), n) for k, n in enumerate(sizes)]
        gradient.append(np.bincount(bucket, share * (weight * (y - node))[of], NAMES))
        g = np.bincount(cell(y[parent[child]], y[child]), weight[child], 4 * len(GROUPS))
        for above in (0, 1):
            for own in (0, 1):
                g -= np.bincount(cell(above, own), weight[child] * edge[child, above, own], 4 * len(GROUPS))
        g = (np.concatenate([*gradient, g]) - held * theta) / weight.sum()
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        theta = theta + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return _unpack(theta)


def _unpack(theta: np.ndarray) -> Model:
    ends = np.cumsum([n for _, n in FEATURES])
    tables = np.split(theta[: ends[-1]], ends[:-1])
    return tables, theta[ends[-1] : ends[-1] + NAMES], theta[ends[-1] + NAMES :].reshape(2, 2, len(GROUPS))


def _scores(model: Model, parent: np.ndarray, x: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    tables, words, pair = model
    unary = np.zeros((len(x), 2))
    unary[:, 1] = sum(t[x[:, k]] for k, t in enumerate(tables)) + np.bincount(names[:, 0].astype(np.int64), names[:, 2] * words[names[:, 1].astype(np.int64)], len(x))
    unary[parent < 0] = [0.0, -50.0]  # the page itself is not content
    return unary, np.moveaxis(pair[:, :, x[:, 0]], 2, 0)


def _log_sum(a: np.ndarray) -> np.ndarray:
    """log of the sum of exponentials over the last axis (of two)."""
    return np.logaddexp(a[..., 0], a[..., 1])


def marginals(parent: np.ndarray, depth: np.ndarray, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(content) of each node of a forest, and P(parent label, label) of each node with a parent.

    parent: -1 at roots; unary: (node, label); pair: (node, parent label, label); both are logs.
    """
    if len(depth) and depth.max() * 4 > len(depth):
        return _marginals_in_turn(parent, unary, pair)
    levels = np.split(np.argsort(depth, kind="stable"), np.cumsum(np.bincount(depth))[:-1])[1:] if len(depth) else []
    up = unary.copy()
    sent = np.zeros_like(unary)
    for at in reversed(levels):
        sent[at] = _log_sum(up[at][:, None, :] + pair[at])
        np.add.at(up, parent[at], sent[at])
    down = np.zeros_like(unary)
    edge = np.full(pair.shape, -np.inf)
    for at in levels:
        above = up[parent[at]] + down[parent[at]] - sent[at]
        joint = above[:, :, None] + pair[at]
        down[at] = _log_sum(joint.transpose(0, 2, 1))
        edge[at] = joint + up[at][:, None, :]
    total = up + down
    norm = _log_sum(total)
    return np.exp(total[:, 1] - norm), np.exp(edge - norm[:, None, None])


def _marginals_in_turn(parent: np.ndarray, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``marginals`` node by node, for deep and thin trees; parents stand before their children."""

    def log_sum(a: float, b: float) -> float:
        high, low = (a, b) if a > b else (b, a)
        return high + math.log1p(math.exp(low - high))

    above, up, pairs = parent.tolist(), unary.tolist(), pair.tolist()
    sent = [None] * len(above)
    for i in range(len(above) - 1, -1, -1):
        if (p := above[i]) >= 0:
            own, (off, on) = up[i], pairs[i]
            sent[i] = log_sum(own[0] + off[0], own[1] + off[1]), log_sum(own[0] + on[0], own[1] + on[1])
            up[p] = [up[p][0] + sent[i][0], up[p][1] + sent[i][1]]
    down = [(0.0, 0.0)] * len(above)
    edge = np.full((len(above), 2, 2), -np.inf)
    for i, p in enumerate(above):
        if p >= 0:
            rest = [up[p][k] + down[p][k] - sent[i][k] for k in (0, 1)]
            joint = [[rest[k] + pairs[i][k][own] for own in (0, 1)] for k in (0, 1)]
            down[i] = log_sum(joint[0][0], joint[1][0]), log_sum(joint[0][1], joint[1][1])
            edge[i] = [[joint[k][own] + up[i][own] for own in (0, 1)] for k in (0, 1)]
    total = np.array(up) + np.array(down)
    norm = _log_sum(total)
    return np.exp(total[:, 1] - norm), np.exp(edge - norm[:, None, None])


def texts_of(sources: list[str | None], model: Model) -> list[str]:
    """Main texts of some pages."""
    pages = [Page(s or "") for s in sources]
    nodes, names = join_pages([_arrays(p, np.zeros(len(p.parent)), 1.0) for p in pages])
    parent = nodes[:, 0].astype(np.int64)
    node, _ = marginals(parent, nodes[:, 1].astype(np.int64), *_scores(model, parent, nodes[:, 4:].astype(np.int64), names))
    content, starts = node >= 0.5, np.flatnonzero(parent < 0)
    out = []
    for page, start in zip(pages, starts, strict=False):
        blocks: dict[int, list[str]] = {}
        for node, block, text in page.texts:
            if content[start + node]:
                blocks.setdefault(block, []).append(text)
        lines = (" ".join("".join(b).split()) for b in blocks.values())
        out.append("\n".join(x for x in lines if x))
    return out


def extract(pages: DataFrame, model: Model, *, html: str = "html") -> DataFrame:
    """Replace ``html`` by ``text``, the page's main text, and ``n_chars``, its code points."""
    rest = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    schema = pages.select(*rest).schema.add("text", StringType()).add("n_chars", LongType())

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                texts = texts_of(part.column(html).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*rest, "text", "n_chars"])

    return pages.select(*rest, html).mapInArrow(run, schema)
