"""Full-text search against plain loops: syntax, stems, covers, block bounds, filters and snippets."""

import random
import re
import uuid

import pytest

from pyspark.sql import functions as F

from tidemark.functions.stems import english_stem
from tidemark.operators import fulltext


@pytest.mark.parametrize(
    "words, stem",
    [
        ("consistency consistent consistently consist", "consist"), ("knightly", "knight"), ("generously generous", "generous"), ("generate generated generating", "generat"), ("hopping hop", "hop"), ("hoping hope", "hope"),
        ("relational relate", "relat"), ("rationalize", "ration"), ("dying", "die"), ("by", "by"), ("ties tie", "tie"), ("cries cry", "cri"), ("singing sing", "sing"), ("agreed agree", "agre"), ("technology", "technolog"), ("über", "über"), ("gas", "gas"),
    ],
)
def test_stems(words, stem):
    assert {english_stem(w) for w in words.split()} == {stem}


def plain_search(docs, query, ignored):
    """{id: score} by loops."""
    groups, out = fulltext.parse(query, ignored), {}
    for i, text in docs.items():
        at = {}
        for p, w in enumerate(re.findall(r"[^\W_]+", (text or "").lower())):
            if w not in ignored:
                at.setdefault(english_stem(w), []).append(p)
        begins = lambda u: [p for p in at.get(u[0][0], []) if all(p + d in at.get(w, []) for w, d in u)]
        score, hit = 0.0, False
        for yes, no in groups:
            units = [begins(u) for u in yes]
            if not all(units) or any(begins(u) for u in no):
                continue
            hit = True
            spans = {(min(c), max(c)) for c in _choices(units)}
            covers = [s for s in spans if not any(t != s and s[0] <= t[0] and t[1] <= s[1] for t in spans)]
            score += sum(1 / (1 + max(0, b - a + 1 - len(units))) for a, b in covers if units)
        if hit:
            out[i] = round(score, 6)
    return out


def _choices(units):
    out = [()]
    for u in units:
        out = [c + (p,) for c in out for p in u]
    return [c for c in out if c]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(5)
    vocabulary = "export exports control controlled chip chips the of revenue grow growing china fab".split()
    docs = {i: " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 8, 30]))) for i in range(120)} | {120: None, 121: "", 122: "China-made, CHIPS!"}
    table = spark.createDataFrame([(i, t, i % 3) for i, t in docs.items()], "id long, text string, cik int")
    path = str(tmp_path_factory.mktemp("index") / uuid.uuid4().hex)
    return docs, table, fulltext.write_index(table, "id", path, buckets=4, spread=2, block=4, ignored=["the", "of"])


QUERIES = ["export china", '"export controls" china', "fab or revenue -chips", '"control of the chip"', "-china", "china-made", "fab -export or growing -fab", "the of", "absent", "chip chips", '"chip revenue" grow export -fab']


@pytest.mark.parametrize("query", QUERIES)
def test_search_equals_loops(corpus, query):
    docs, table, index = corpus
    want = plain_search(docs, query, index.ignored)
    got = fulltext.search(index, table, query).collect()
    got = {r["id"]: r["score"] for r in got}
    assert sorted(set(got) ^ set(want)) == [] and got == pytest.approx(want)
    order = sorted(want.items(), key=lambda x: (-x[1], x[0]))
    for limit in (1, 7):
        top = fulltext.search(index, table, query, limit, first=1).collect()
        assert [(r["id"], r["score"]) for r in top] == [(i, pytest.approx(s)) for i, s in order[:limit]]


def test_filters_and_snippets(corpus, spark, tmp_path):
    docs, table, index = corpus
    want = {i for i in plain_search(docs, "export china", index.ignored) if i % 3 == 1}
    assert {r["id"] for r in fulltext.search(index, table, "export china", where=F.col("cik") == 1).collect()} == want
    few = spark.createDataFrame([(1, "Export controls on advanced chips to China could reduce our revenue."), (2, "We will build a second fab in Arizona."), (3, None)], "id long, text string")
    index = fulltext.write_index(few, "id", str(tmp_path / "few"), buckets=2)
    first = fulltext.search(index, few, '"export controls" china', 5).collect()
    assert [r["id"] for r in first] == [1] and "[Export] [controls] on advanced chips to [China]" in first[0]["snippet"]
    assert [r["id"] for r in fulltext.search(index, few, "fabs arizona").collect()] == [2]


def test_the_index_prunes_and_bears_an_empty_table(corpus, spark, tmp_path):
    _, table, index = corpus
    plan = index.read(spark, ["china"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "EqualTo(term,china)" in plan
    none = fulltext.write_index(table.where("id < 0"), "id", str(tmp_path / "none"), buckets=2)
    assert fulltext.search(none, table.where("id < 0"), "china", 3).collect() == []
