"""Edge cases of the corpus operators: clashing names, repeated ids, crowded places and odd rows in the pipeline's stages."""

import itertools
import random
import re

from pyspark.sql import functions as F

from tidemark.llm import components, factorisation, line_dedup, minhash, quality_rules, queries, suffixes, url_filters
from tidemark.llm.common import table

LARGER = "/root/testdata/sf0.01"
WORDS = [a + b + c for a, b, c in itertools.product("ba ce di fo gu la me ni".split(), repeat=3)]


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def test_clashing_names_pass_through(spark, documents):
    r = random.Random(1)
    pages = spark.createDataFrame([(1, "http://x.com/en/1", "a", "b"), (2, None, "c", "d")], "page_id long, url string, _url string, _best string")
    out = {x.page_id: x for x in url_filters.judge_urls(pages, url_filters.rule_table(spark, queries.URL_RULES)).collect()}
    assert (out[1]["_url"], out[1]["_best"], out[1]["verdict"]) == ("a", "b", "block") and out[2]["_url"] == "c"
    docs = documents([(1, prose(r, 80)), (2, prose(r, 80))])
    for name in ("_w", "_lines", "_b", "_r", "_row", "_key", "_numbers"):
        docs = docs.withColumn(name, F.lit(name))
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    judged = quality_rules.accepted(quality_rules.judge_quality(docs, labels))
    assert {*docs.columns} <= {*judged.columns} and judged.select("_w", "_row").distinct().collect() == [("_w", "_row")]
    kept = line_dedup.remove_lines(docs, line_dedup.duplicate_lines(docs))
    assert kept.columns == docs.columns and kept.select("_key", "_numbers").distinct().collect() == [("_key", "_numbers")]


def test_a_labelled_id_counts_once(spark, documents):
    r = random.Random(2)
    rows = [(1, prose(r, 30) + f" {i}") for i in range(50)] + [(2, prose(r, 30)), (3, None), (4, "")]
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, None), (None, 1), (4, 1)], "doc_id long, quality int")
    seen = []
    real = factorisation.maximise
    factorisation.maximise = lambda vectors, y, **options: seen.append((len(vectors), sorted(y))) or real(vectors, y, **options)
    try:
        factorisation.fit(documents(rows), labels)
    finally:
        factorisation.maximise = real
    assert seen == [(3, [0, 1, 1])]


def test_held_out_quality_of_the_given_labels(spark):
    out = queries.op6_factorisation(spark, LARGER).where("held_out").join(table(spark, LARGER, "labels"), "doc_id").dropna(subset=["quality"]).collect()
    assert len(out) >= 60 and sum(x.predicted == x.quality for x in out) >= 0.9 * len(out)


def test_passages_hidden_by_their_neighbours(spark, documents):
    r = random.Random(3)
    passage, tail = prose(r, 60), prose(r, 45)
    often = " ".join(f"{passage} {prose(r, 5)}" for _ in range(9))  # one document fills the nearest places
    rows = [(1, often), (2, prose(r, 80) + " " + passage), (3, often)]
    rare = prose(r, 20)  # its partner shares the rare beginning, thousands share the end
    rows += [(100 + k, f"{prose(r, 30)} {tail} {prose(r, 30)}") for k in range(400)]
    rows += [(600, f"{prose(r, 30)} {rare} {tail} {prose(r, 30)}"), (601, f"{prose(r, 30)} {rare} {tail} {prose(r, 30)}")]
    found = {x.doc_id for x in suffixes.repeated_passages(documents(rows)).collect()}
    assert found == {1, 2, 3, 600, 601}


def test_passages_of_repeated_and_long_rows(spark, documents):
    r = random.Random(4)
    long = prose(r, 20_000)
    rows = [(1, long), (1, long), (2, " ".join(long.split()[9_000:9_100])), (3, "short"), (4, None)]
    out = {x.doc_id: x for x in suffixes.repeated_passages(documents(rows)).collect()}
    assert set(out) == {1, 2} and out[1].start_word <= 9_000 and out[1].start_word + out[1].n_words >= 9_100


def test_components(spark):
    r = random.Random(5)
    links = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)] + [(7, 7)]
    root = {x: x for p in links for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    out = {x.node: x.component for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(out.get(x, x) == find(x) for x in root)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lines_at_one_place_and_set_equal_lines(spark, documents):
    rows = [(1, "alpha beta gamma delta epsilon"), (1, "zeta eta theta iota kappa"), (2, "epsilon delta gamma beta alpha"), (3, "two words"), (4, "words  two"), (5, "words two three"), (6, "kappa iota theta eta zeta\nalpha")]
    gone = {(x.doc_id, x.line_no) for x in line_dedup.duplicate_lines(documents(rows)).collect()}
    assert gone == {(2, 0), (4, 0), (6, 0)}


def test_lines_that_match_their_nearest_are_compared_with_nothing_else(spark, documents, monkeypatch):
    r = random.Random(4)
    base = prose(r, 30).split(" ")
    rows = [(k, " ".join(w if i != k % 30 else f"edit{k}" for i, w in enumerate(base))) for k in range(60)] + [(100 + k, prose(r, 30)) for k in range(20)]
    seen = []
    real = line_dedup.closer
    monkeypatch.setattr(line_dedup, "closer", lambda pairs, *rest: seen.append(pairs.count()) or real(pairs, *rest))
    gone = {x.doc_id for x in line_dedup.duplicate_lines(documents(rows)).collect()}
    assert gone == set(range(1, 60)) and sum(seen) <= 60


def test_crowds_post_prefixes_only(spark, documents, monkeypatch):
    r = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(w if r.random() > r.choice([0.01, 0.03, 0.05]) else f"e{r.random()}" for w in base) for _ in range(80)]
    sizes, real = {}, minhash.staged

    def staged(df, name):
        out = real(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(minhash, "staged", staged)
    out = {x.doc_id: x.component_id for x in minhash.near_duplicates(documents(list(enumerate(texts))), percent=80, least_depth=2).collect()}
    sets = [frozenset(tuple(t.split()[i : i + 5]) for i in range(196)) for t in texts]
    root = list(range(80))
    for a in range(80):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if x == high else x for x in root]
    assert out == dict(enumerate(root)) and len(set(root)) > 1
    assert sizes["dense"] > 24 and max(sizes.values()) <= 80 * (196 // 5 + 2)


def test_size_classes_keep_partners_together(spark):
    for percent in (50, 80, 90, 100):
        rows = spark.range(1, 3000).select(F.col("id").alias("n")).select("n", line_dedup.size_class(percent).alias("c")).collect()
        number = {x.n: x.c for x in rows}
        assert all(number[m] - c in (0, 1) for n, c in number.items() for m in (n, 100 * n // percent) if m in number)
        assert percent == 100 or number[2999] - number[1] > 5


def test_the_table_of_ranks_is_copied_into_no_row(spark, documents, capsys):
    line_dedup.first_lines(documents([(1, "alpha beta\ngamma")]), 80).explain()
    plan = capsys.readouterr().out
    assert "Subquery" in plan and not re.search(r"\] AS r#", plan)


def test_the_smaller_line_posts_what_its_partners_need_and_no_more_than_before(spark):
    for percent in (50, 80, 90, 95):
        posts = line_dedup.smaller_posts(percent)
        rows = spark.range(1, 700).select(F.col("id").alias("n")).select("n", line_dedup.size_class(percent).alias("c"), posts.alias("posts")).collect()
        number, posted = {x.n: x.c for x in rows}, {x.n: dict(x.posts) for x in rows}
        least = line_dedup.least_size(percent)
        for n in number:
            for m in range(n, min(100 * n // percent, 699) + 1):
                shared = -(-percent * (n + m) // (100 + percent))
                if shared <= n and (n >= least or m == n):
                    assert posted[n].get(number[m], 0) >= (n - shared + 1 if n >= least else 1), (percent, n, m)
        own = {n: n - -(-2 * percent * n // (100 + percent)) + 1 if n >= least else 1 for n in number}
        assert all(sorted(posted[n].values())[1] == own[n] for n in number)
        assert percent != 80 or sum(sum(p.values()) for p in posted.values()) < 1.6 * sum(own.values())


def test_words_are_split_at_every_white_space_character(spark, documents):
    rows = [(1, "alpha\tbeta gamma\x0bdelta\x0cepsilon\rzeta"), (2, "zeta  epsilon delta\t\tgamma beta alpha "), (3, "alpha\u00a0beta gamma"), (4, "alpha beta gamma"), (5, "a|b."), (6, "a b"), (7, "\t\r")]
    gone = {(x.doc_id, x.line_no) for x in line_dedup.duplicate_lines(documents(rows)).collect()}
    assert gone == {(2, 0)}


def test_words_of_places_are_read_by_the_same_join_at_every_size(spark, documents, capsys):
    docs = documents([(1, "alpha beta\n\ngamma"), (2, "delta")])
    wanted = spark.createDataFrame([((1, 2),), ((2, 0),)], "at struct<doc_id: long, line_no: int>")
    found = line_dedup.words_of_lines(docs, wanted)
    assert sorted((x.at.doc_id, x.at.line_no, x.n) for x in found.collect()) == [(1, 2, 1), (2, 0, 1)]
    found.explain()
    assert "BroadcastHashJoin" not in capsys.readouterr().out


def test_what_made_the_links_stands_in_one_plan_once(spark, monkeypatch):
    plans, real = [], components.cut
    monkeypatch.setattr(components, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df))
    links = spark.range(40).select(F.col("id").alias("a"), (F.col("id") * 7 % 40).alias("b"))
    out = {x.node: x.component for x in components.components(links).collect()}
    assert out[7] == out[9] == 1 and sum(plan.count("Range (") for plan in plans) == 1
