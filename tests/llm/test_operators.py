"""The corpus operators against brute force and known answers, with nulls, empty texts, ties and repeated rows."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.oracle import difference

from tidemark.llm import bpe, decontaminate, factorisation, html_content, line_dedup, minhash, quality_rules, queries, suffixes, token_counts, url_filters

SF = "/root/testdata/sf0.001"
WORDS = [a + b for a, b in itertools.product("ba ce di fo gu la me ni ro su ta ve".split(), repeat=2)]
ODD = [(None, "no id here " * 20), (1, None), (2, ""), (3, " \n\t \n"), (4, "one"), (4, "one"), (5, "é" * 5000 + " 日本 " * 300), (6, "a b " * 4000)]


def prose(r, n):
    return " ".join(r.choice(WORDS) + ("." if r.random() < 0.1 else "") for _ in range(n))


def ranks_path():
    return queries.vocabulary("byte_bpe_50k.tiktoken")


def test_bpe_is_the_rank_library(spark, documents):
    import tiktoken

    path = ranks_path()
    own = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    r = random.Random(1)
    texts = ["".join(r.choice(" \n\t'stremdabcéßABC,.;:!?-0123456789  日本\x1c\x85") for _ in range(r.randint(0, 120))) for _ in range(200)] + ["<|endoftext|>", "  x", "x  \n\n y", "don't"]
    df = documents(list(enumerate(texts)) + [(900, None), (901, ""), (902, ODD[6][1])])
    out = bpe.digests(bpe.decode(bpe.encode(df, path), path))
    for row in out.collect():
        ids = own.encode_ordinary(row.text or "")
        assert row.ids == ids and row.n_tokens == len(ids)
        assert bytes(row.decoded).decode() == (row.text or "")
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((row.text or "").encode()).hexdigest()
    assert out.columns[:6] == df.columns
    assert bpe.encode(df.limit(0), path).count() == 0


def test_token_counts_are_greedy_longest_match(spark, documents):
    begins, inner = ["a", "ab", "abcd", "b"], ["a", "b", "bc", "c", "cde", "d", "de"]
    automaton = token_counts.Automaton(begins, inner)

    def greedy(word):
        at, count = 0, 0
        while at < len(word):
            fits = [p for p in (inner if at else begins) if word.startswith(p, at)]
            if not fits:
                return token_counts.UNKNOWN + 1
            at, count = at + len(max(fits, key=len)), count + 1
        return count

    for n in range(1, 7):
        for word in map("".join, itertools.product("abcdex", repeat=n)):
            assert automaton.pieces(word) == greedy(word), word
    path = queries.vocabulary("piece_bpe_32k.model")
    out = {r.doc_id: r for r in token_counts.count_tokens(documents([(1, "The cat sat."), (2, None), (3, ""), (4, "  \n")]), path).collect()}
    assert out[1].n_words == 3 and out[1].n_pieces >= 3
    assert all((out[k].n_words, out[k].n_pieces, out[k].n_unknown) == (0, 0, 0) for k in (2, 3, 4))


def brute_lines(rows):
    seen, gone = [], set()
    for key, text in sorted((x for x in rows if x[0] is not None and x[1]), key=lambda x: x[0]):
        for i, line in enumerate(text.split("\n")):
            words = frozenset(w for w in re.split(r"[\x20\x09-\x0D]+", line) if w)
            if not words:
                continue
            if any(at < (key, i) and 100 * len(words & o) >= 80 * len(words | o) for at, o in seen):
                gone.add((key, i))
            seen.append(((key, i), words))
    return gone


def edited(r, text, rate):
    return " ".join(r.choice(WORDS) if r.random() < rate else w for w in text.split(" "))


@pytest.mark.parametrize("seed", [2, 3])
def test_lines(spark, documents, seed):
    r = random.Random(seed)
    base = [prose(r, n) for n in (1, 2, 3, 4, 5, 6, 9, 12, 20, 40)]
    rows = [(k, "\n".join(edited(r, x, r.choice([0, 0, 0.05, 0.1, 0.2])) for x in r.sample(base, 5)) + "\n\n \n" + prose(r, 8)) for k in range(40)] + ODD
    df = documents(rows)
    gone = line_dedup.duplicate_lines(df)
    found = {(x.doc_id, x.line_no) for x in gone.collect()}
    assert found == brute_lines(rows) and len(found) > 60
    left = line_dedup.remove_lines(df, gone).collect()
    assert len(left) == len(rows) and left[0].asDict().keys() == set(df.columns)
    texts = Counter(x.text for x in left)
    assert texts[None] == 1 and texts["no id here " * 20] == 1
    for key, text in rows[:40]:
        want = "\n".join(x for i, x in enumerate(text.split("\n")) if (key, i) not in found)
        assert any(x.doc_id == key and x.text == want and x.n_chars == len(want) for x in left)
    assert line_dedup.duplicate_lines(df.limit(0)).count() == 0


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else [])


def test_near_duplicates(spark, documents):
    r = random.Random(3)
    bases = [prose(r, n) for n in (3, 5, 30, 80, 200, 400)]
    rows = [(k, edited(r, r.choice(bases), r.choice([0, 0, 0.005, 0.01, 0.03]))) for k in range(300)] + [(400 + k, prose(r, 60)) for k in range(40)]
    rows += [(500, bases[3].upper()), (501, None), (502, ""), (503, " \n"), (504, "one"), (504, "one"), (505, "One"), (None, bases[3])]
    sets, parent = [shingles(t) for _, t in rows], {k: k for k, _ in rows if k is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, s), (b, t) in itertools.combinations([(k, s) for (k, _), s in zip(rows, sets) if k is not None and s], 2):
        if 100 * len(s & t) >= 85 * len(s | t):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    out = minhash.near_duplicates(documents(rows)).collect()
    assert len(out) == len(rows)
    assert Counter((x.doc_id, x.n_shingles) for x in out) == Counter((k, len(s)) for (k, _), s in zip(rows, sets))
    for x in out:
        if x.doc_id is None:
            assert x.component_id is None and not x.kept
        else:
            assert x.component_id == root(x.doc_id) and x.kept == (x.doc_id == x.component_id)
    assert minhash.near_duplicates(documents(rows).limit(0)).count() == 0


def test_neighbours_in_crowded_regions_use_the_window():
    keys = np.zeros((50, 4), np.int32)
    a, b, c = minhash.neighbours(np.zeros(50, np.int32), keys, np.arange(50), 2, 3, 8)
    assert set((b - a).tolist()) == {1, 2, 3} and set(c.tolist()) == {4}
    keys[:, 3] = np.arange(50)
    a, b, _ = minhash.neighbours(np.arange(50) // 6, keys, np.arange(50), 2, 1, 8)
    assert len(a) == 8 * 15 + 1  # all pairs of each small region, none across trees


def linked(rows, percent):
    """{doc_id: least doc_id of its component} by all pairs."""
    sets, column = [shingles(t) for _, t in rows], {}
    places = [[column.setdefault(x, len(column)) for x in s] for s in sets]
    m = np.zeros((len(rows), len(column)), np.float32)
    for i, at in enumerate(places):
        m[i, at] = 1
    both, sizes, root = (m @ m.T).astype(int), np.array(list(map(len, sets))), {k: k for k, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in np.argwhere((100 * both >= percent * (sizes[:, None] + sizes - both)) & (both > 0)).tolist():
        x, y = find(rows[i][0]), find(rows[j][0])
        root[max(x, y)] = min(x, y)
    return {k: find(k) for k in root}


def test_near_duplicates_in_a_template_crowd(spark, documents):
    r = random.Random(12)
    template = [f"w{j}" for j in range(604)]

    def swapped(words, n, tag):  # places too far apart to share a shingle
        out = list(words)
        for j in r.sample([j for j in range(6, 600, 6) if words[j] == template[j]], n):
            out[j] = f"{tag}x{j}"
        return out

    crowd = [swapped(template, 7, f"t{k}") for k in range(600)]  # similarity 0.79 to 0.85 with each other
    texts = crowd + [swapped(x, 9, f"p{k}") for k, x in enumerate(crowd[:300])]  # their partners, at 0.860
    r.shuffle(texts)
    rows = [(k, " ".join(w)) for k, w in enumerate(texts)]
    want = linked(rows, 85)
    assert 590 < len(set(want.values())) <= 600
    out = {x.doc_id: x.component_id for x in minhash.near_duplicates(documents(rows)).collect()}
    assert sum(out[k] != want[k] for k in want) == 0


def test_decontamination(spark, documents):
    r = random.Random(4)
    items = [(i, " ".join(r.choice(WORDS) for _ in range(r.randint(5, 60)))) for i in range(30)] + [(50, None), (51, ""), (52, "one")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows, want = [], set()
    for k in range(60):
        text = " ".join(r.choice("kax lop wuz yim".split()) for _ in range(40))
        if k % 2:
            i, item = items[k // 2]
            words = item.split()
            for _ in range(len(words) // 20):  # a quarter of the edits allowed
                words[r.randrange(len(words))] = "kax"
            text += " " + ", ".join(words).upper() + " " + text
            want.add((k, i))
        rows.append((k, text))
    out = decontaminate.find_contamination(documents([*rows, (100, None), (101, ""), (None, items[0][1])]), benchmark, block_chars=1500).collect()
    assert len(out) == 63
    found = {(x.doc_id, h.item_id) for x in out for h in x.hits if x.doc_id is not None}
    assert found == want
    assert [h.item_id for x in out if x.doc_id is None for h in x.hits] == [0]
    assert decontaminate.find_contamination(documents(rows), benchmark.limit(0)).where("size(hits) > 0").count() == 0


@pytest.mark.parametrize("kind", ["replace", "insert", "delete"])
def test_decontamination_at_the_edit_limit(kind):
    r = random.Random(13)
    sizes = [n for n in (5, 9, 15, 30, 60, 100, 200) for _ in range(8)]
    items = [(i, " ".join(f"i{i}w{j}" for j in range(n))) for i, n in enumerate(sizes)]
    index = decontaminate.Index(items)
    for i, text in items:
        words = text.split()
        k = decontaminate.allowed(len(words))
        for j in sorted(r.sample(range(1, len(words) - 1), k), reverse=True):
            words[j : j + (kind != "insert")] = [] if kind == "delete" else ["kax"]
        found = index.hits(" ".join(["lop"] * 50 + words + ["lop"] * 50))
        assert [(h["item_id"], h["distance"]) for h in found] == [(i, k)]
        assert index.hits(" ".join(["lop"] * 50 + words[:1] + ["kax"] + words[1:-1])) == []  # an edit more, and the end gone


def test_alignment_is_the_least_edit_distance():
    r = random.Random(5)
    for _ in range(200):
        item, text = [r.randint(1, 4) for _ in range(r.randint(1, 8))], [r.randint(1, 4) for _ in range(r.randint(0, 12))]
        row = [0] * (len(text) + 1)
        for i, a in enumerate(item, 1):
            new = [i]
            for j, b in enumerate(text, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
            row = new
        assert decontaminate.align(np.array(item), np.array(text, dtype=int))[0] == min(row)


def test_factorisation(spark, documents):
    r = np.random.default_rng(6)
    model = (0.1, r.normal(size=factorisation.PLACES), r.normal(size=(factorisation.PLACES, 3)))
    places, values = np.array([3, 9, 70, 500]), r.normal(size=4)
    brute = 0.1 + model[1][places] @ values + sum(model[2][places[i]] @ model[2][places[j]] * values[i] * values[j] for i in range(4) for j in range(i))
    assert math.isclose(factorisation.raw_scores(model, places, values, np.array([0, 4]))[0], brute, rel_tol=1e-9)
    rr = random.Random(7)
    rows = [(k, prose(rr, 60) if k % 3 else " | ".join(prose(rr, 1) for _ in range(60))) for k in range(300)]
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(200)], "doc_id long, quality int")
    df = documents(rows)
    fitted = factorisation.fit(df, labels)
    out = factorisation.score(documents([*rows, *ODD]), fitted).collect()
    assert len(out) == 308 and all(0 <= x.score <= 1 for x in out)
    assert all((x.score >= 0.5) == (x.doc_id % 3 > 0) for x in out[200:300])
    assert factorisation.score(df.limit(0), fitted).count() == 0


def test_marginals_are_exact():
    r = np.random.default_rng(8)
    parent, depth = np.array([-1, 0, 0, 1, 1, 2]), np.array([0, 1, 1, 2, 2, 2])
    unary, pair = r.normal(size=(6, 2)), r.normal(size=(6, 2, 2))
    weights = {y: math.exp(sum(unary[i, y[i]] for i in range(6)) + sum(pair[i, y[parent[i]], y[i]] for i in range(1, 6))) for y in itertools.product((0, 1), repeat=6)}
    total = sum(weights.values())
    node, edge = html_content.marginals(parent, depth, unary, pair)
    for i in range(6):
        assert math.isclose(node[i], sum(w for y, w in weights.items() if y[i]) / total, rel_tol=1e-9)
        if i:
            assert math.isclose(edge[i, 1, 0], sum(w for y, w in weights.items() if y[parent[i]] == 1 and y[i] == 0) / total, rel_tol=1e-9)


def test_html(spark):
    page = """<html><body><div class="wrap"><header><p>Top</p></header><nav><ul><li><a href="/">Home</a></li></ul></nav><article><h1>Title &amp; more</h1><p>One &lt;b&gt; <a href=x>link</a>
      two.<p>Three<br>four.</p><div class="ad-box"><p>Buy this now please, friend.</p></div><script>var p = "</p>";</script><section class="comments"><h2>Comments</h2><p>I like it very much, thank you all for the nice read.</p></section></article>
      <aside class="sidebar"><p>Side text</p></aside><div class="cookie-notice">We use cookies <button>OK</button></div><form><p>Subscribe</p></form><footer>foot</footer></div></body></html>"""
    rows = [(1, "u", page), (1, "u", page), (2, "u", None), (3, "u", ""), (4, "u", "<p>" * 3000), (5, None, "<article><p>Cut off here and the tag is not clos<"), (None, "u", "plain text")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("old"))
    out = html_content.extract(df, html_content.fit(df)).collect()
    texts = [x.text for x in out if x.page_id == 1]
    assert texts == ["Title & more\nOne <b> link two.\nThree four."] * 2
    assert all(x.n_chars == len(x.text) for x in out) and [x.text for x in out if x.page_id in (2, 3)] == ["", ""]
    assert len(out) == 7
    assert html_content.extract(df.limit(0), html_content.fit(df.limit(0))).count() == 0


def test_repeated_passages(spark, documents):
    r = random.Random(9)
    passage, short = prose(r, 70), prose(r, 40)
    rows = [(k, prose(r, r.randint(20, 90)) + " " + (passage if k % 3 == 0 else short if k % 3 == 1 else "") + " " + prose(r, 60)) for k in range(60)] + [(100, rows_ := prose(r, 300)), (101, rows_), (102, None), (103, ""), (None, passage)]
    out = suffixes.repeated_passages(documents(rows)).collect()
    grams = {}
    for k, t in rows:
        w = (t or "").split()
        for i in range(len(w) - 49 if k is not None else 0):
            grams.setdefault(tuple(w[i : i + 50]), set()).add(k)
    want = {k for ids in grams.values() if len(ids) > 1 for k in ids}
    assert {x.doc_id for x in out} == want == {*range(0, 60, 3), 100, 101}
    texts = dict(x for x in rows if x[0] is not None)
    for x in out:
        span = " ".join(texts[x.doc_id].split()[x.start_word : x.start_word + x.n_words])
        assert (passage if x.doc_id < 100 else rows_) in span and x.n_words <= (75 if x.doc_id < 100 else 300)
    assert suffixes.repeated_passages(documents(rows).limit(0)).count() == 0


def brute_base(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    covered = {i + j for i, x in enumerate(windows) if n[x] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, documents):
    import xxhash

    r = random.Random(10)
    rows = [(k, "\n".join(prose(r, 10) for _ in range(8)) if k % 4 else " ".join(w + "###" for w in prose(r, 80).split())) for k in range(80)]
    rows += [*ODD, (200, "la la la " * 60), (201, "x y z\n" * 3 + "x\x0by z"), (202, "one two three four " * 50 + prose(r, 300)), (203, prose(r, 90) + " " + prose(r, 3) * 2)]
    labels = spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(40)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    df = documents(rows)
    out = quality_rules.judge_quality(df, labels).collect()
    assert len(out) == len(rows)
    for x in out:
        base = brute_base(x.text)
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == base, x.text[:80]
        assert x.base_failed == (base[0] < 50 or 100 * base[4] > 50 * base[0])
    assert all(x.kept == (x.doc_id % 4 > 0) for x in out if x.doc_id is not None and x.doc_id < 80 and len(x.text or "") > 100 and x.doc_id > 6)
    # the log ratios by hand
    m = 1 << 16
    h = lambda t: xxhash.xxh64_intdigest(t.encode(), 42) & m - 1
    end = lambda t: xxhash.xxh64_intdigest(t[-3:].encode(), xxhash.xxh64_intdigest((3).to_bytes(4, "little"), 42)) & m - 1
    grams = lambda t: [f(w) for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w for f in (h, end)]
    raw, good = Counter(), Counter()
    for k, t in rows:
        raw.update(grams(t))
        if k is not None and k < 40 and k % 4:
            good.update(grams(t))
    R, T = sum(raw.values()), sum(good.values())
    x = next(x for x in out if x.doc_id == 9)
    want = sum(round(math.log((good[b] + 1) / (raw[b] * T / R + 1)) * 10_000) for b in grams(x.text))
    assert abs(x.llr_sum - want) <= 1
    assert quality_rules.accepted(quality_rules.judge_quality(df, labels)).count() == sum(x.kept for x in out)
    assert quality_rules.judge_quality(df.limit(0), labels).count() == 0
    assert quality_rules.judge_quality(df, labels.limit(0)).count() == len(rows)


def test_urls(spark):
    rules = [*queries.URL_RULES, ("allow", "a.b", ""), ("block", "a.b", "")]
    urls = ["http://x.com/en/1", "https://EXAMPLE.com/en/75?q=/en/7", "http://example.com", "http://com/en/", "http://notexample.com/en/7", "http://a.net/de/1", "http://www.example.net/de/8#x", "//x.com/en/", None, "", "nothing", "http://u@x.com:80/en/1", "http://c.a.b?x", "http://sub.a.b", "http:///en/", "http://x.org/es/", "ftp://É.COM/en/é"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(0, urls[0]), (None, urls[0])]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit(1))

    def judge(url):
        head, sep, rest = (url or "").partition("://")
        m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S) if sep else None
        host, path = (m[1].translate(str.maketrans(url_filters.UPPER, url_filters.LOWER)), m[2]) if m else ("", "")
        fit = [(len(h + p), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, 0, None, "allow"))
        return host, path, best[2], best[3]

    out = url_filters.judge_urls(pages, url_filters.rule_table(spark, rules)).collect()
    assert sorted(map(repr, [(x.page_id, x.host, x.path, x.rule, x.verdict) for x in out])) == sorted(repr((k, *judge(u))) for k, u in rows)
    assert url_filters.judge_urls(pages.limit(0), url_filters.rule_table(spark, rules)).count() == 0


def test_url_oracle(spark):
    assert difference(spark, SF, queries.op10_url_filters, queries.oracle_sql()["op10_url_filters"]) is None


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_run(spark, name):
    assert queries.queries()[name](spark, SF).count() > 0


def test_pipeline(spark):
    import corpus_pipeline

    docs, counts = corpus_pipeline.table(spark, SF, "documents"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert sorted(out.columns) == sorted(docs.columns)
        counts.append(out.count())
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert counts == sorted(counts, reverse=True)
    assert corpus_pipeline.run(spark, SF).count() == counts[-1]


def test_pipeline_near_duplicates_at_80_percent(spark, documents):
    import corpus_pipeline

    r = random.Random(14)
    rows = []
    for k in range(0, 60, 2):  # four or five words apart: 20 to 25 of 200 shingles, similarity 0.82 or 0.78
        words = [r.choice(WORDS) for _ in range(204)]
        near = list(words)
        for j in range(4 + k // 2 % 2):
            near[20 + 30 * j] = f"x{j}"
        rows += [(k, " ".join(words)), (k + 1, " ".join(near))]
    root = linked(rows, 80)
    assert len(set(root.values())) == 45 and len(set(linked(rows, 85).values())) == 60
    assert {x.doc_id for x in corpus_pipeline.near_duplicates(spark, documents(rows), SF).collect()} == set(root.values())
