"""Clusters, manifests and neighbours against brute force, on edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bisector, merkle, vantage


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(k, v, 1, "x") for k, v in rows], f"vec_id bigint, embedding array<{kind}>, cluster int, score string")


def finite(v, dims):
    return v is not None and len(v) == dims and all(c is not None and np.isfinite(c) for c in v)


def lloyd(rows, k, rounds, dims, scale=1024):
    kept = [(i, [int(np.floor(np.float64(np.float32(c)) * scale)) for c in v]) for i, v in rows if finite(v, dims)]
    order = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest() if i is not None else "~", v) for i, v in kept)
    centres = [list(v) for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(centres)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                centres[j] = [sum(c) // len(mine) for c in zip(*mine)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    total = {j: sum(d for _, o, d in found if o == j) for j in range(len(centres))}
    return sorted(((i, j, d, total[j], sum(total.values()), hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for i, j, d in found), key=repr)


def test_clusters_equal_lloyd_rounds(spark):
    draw = np.random.default_rng(1)
    rows = [(i, [float(np.float32(c)) for c in draw.normal(i % 3, 0.4, 6)]) for i in range(120)]
    rows += [(200, None), (201, []), (202, [1.0] * 5), (203, [1.0] * 5 + [None]), (204, [1.0] * 5 + [float("nan")]), (205, [1.0] * 5 + [float("inf")]), (None, [0.5] * 6)]
    rows += [(300, [0.25] * 6)] * 5 + [(301, [0.25] * 6)] + [(302 + i, [float(i % 2)] * 6) for i in range(10)]
    got = bisector.cluster(vectors(spark, rows), dims=6)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == lloyd(rows, 8, 10, 6)


def test_clusters_beyond_small_integers_and_longs(spark):
    rows = [(i, [float(2**17 * (i % 4)), 1.0, -float(2**18 * (i % 3))]) for i in range(20)]
    got = bisector.cluster(vectors(spark, rows), dims=3, k=3)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == lloyd(rows, 3, 10, 3)
    far = bisector.cluster(vectors(spark, [(1, [1e30]), (2, [1e30]), (3, [-1e30]), (4, [0.0])]), dims=1, k=2)
    assert {r.vec_id for r in far.collect()} == {1, 2, 3, 4} and any(r.distance is None and r.inertia is None for r in far.collect())


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_clusters_of_few_vectors(spark, rows):
    assert sorted((tuple(r) for r in bisector.cluster(vectors(spark, rows), dims=2).collect()), key=repr) == lloyd(rows, 8, 10, 2)


def test_a_zero_sign_test_favours_the_smaller_number():
    best, far = bisector.Tournament([[0, 0], [2, 0], [0, 2], [2, 2]]).winners(np.array([[1, 1], [2, 1], [3, 3]]))
    assert best.tolist() == [0, 1, 3] and far.tolist() == [2, 1, 2]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def climbed(nodes):
    """Levels of a tree."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def way(levels, place):
    out = []
    for level in levels[:-1]:
        start, at = place // 16 * 16, place % 16
        run = level[start : start + 16]
        out.append(("".join(run[:at]), "".join(run[at + 1 :])))
        place //= 16
    return out


def manifest(rows):
    part = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    low = lambda t: None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    leaf = lambda r, text: sha("".join(map(part, (*r[:4], text))))
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    trees = {}
    for g, held in groups.items():
        held.sort(key=lambda x: x[:3])
        trees[g] = climbed([h[2] for h in held])
    names = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    top = climbed([trees[g][-1][0] for g in names])
    out = []
    for g, held in groups.items():
        for i, (_, _, own, r) in enumerate(held):
            path = way(trees[g], i) + way(top, names.index(g))
            h = leaf(r, low(r[4])) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else own
            for before, after in path:
                h = sha(before + h + after)
            out.append((r[0], own, trees[g][-1][0], top[-1][0], "".join(b + a for b, a in path), h, h == top[-1][0]))
    return sorted(out, key=repr)


def documents(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id bigint, source string, lang string, n_chars bigint, text string, node string, place string")


def many():
    draw = random.Random(5)
    rows = [(i, "hot", "en", i % 7, f"Text {i}") for i in range(4200)]  # four levels, a ragged last block
    rows += [(10_000 + i, f"s{i % 40}", None, None, draw.choice(["", None, "ABC", "plain", "Ünï A"])) for i in range(300)]
    rows += [(20_000, "lone", "de", 1, "One"), (None, None, None, None, None), (None, "hot", "", 0, "No id"), (3, "hot", "en", 3, "Text 3"), (3, "hot", "en", 3, "Other A")]
    return rows


@pytest.mark.parametrize("rows", [[], many()[-5:-4], many()[:16], many()[:17], many()[:257], many()], ids=["none", "lone", "run", "two_runs", "two_blocks", "many"])
def test_manifest_equals_a_plain_tree(spark, rows):
    got = merkle.manifest(documents(spark, rows))
    assert sorted((tuple(r) for r in got.select("doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified").collect()), key=repr) == manifest(rows)


def test_a_changed_text_is_found(spark):
    got = {r.doc_id: r.verified for r in merkle.manifest(documents(spark, many())).where("doc_id < 4200 AND doc_id <> 3").collect()}
    assert all(ok == (zlib.crc32(str(i).encode()) % 5 != 0) for i, ok in got.items()) and not all(got.values())


def neighbours(rows, every, k=5):
    held = [(i, np.array(v, dtype=np.float64)) for i, v in dict.fromkeys((i, tuple(v)) for i, v in rows if v is not None and i is not None and v and finite(v, len(v)) and any(v))]
    out = []
    for q, x in held:
        if q % every == 0:
            near = sorted((-float((x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum()))), i) for i, y in held if i != q and len(x) == len(y))
            out += [(q, n + 1, i, round(-s, 12)) for n, (s, i) in enumerate(near[:k])]
    return sorted(out)


def found(df):
    return sorted((r.query_id, r.rank, r.vec_id, round(r.score, 12)) for r in df.collect())


def test_neighbours_equal_brute_force_in_many_shards(spark):
    draw = np.random.default_rng(2)
    rows = [(i, [float(c) for c in draw.integers(-3, 4, 5)]) for i in range(900)]  # many equal and scaled vectors
    rows += [(1000 + i, [1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(300)]  # one vector fills a quarter
    rows += [(1300 + i, [c * 2.0**i for c in (1.0, 2.0, 3.0, 4.0, 5.0)]) for i in range(1, 100)]  # different vectors that tie
    rows += [(5, list(rows[5][1])), (2000, None), (2010, []), (2020, [0.0] * 5), (2030, [1.0, None, 0.0, 0.0, 0.0]), (2040, [float("nan")] * 5), (None, [1.0] * 5), (2050, [1.0, 1.0]), (2060, [1.0, -1.0]), (2070, [3.0])]
    got = vantage.nearest(vectors(spark, rows, "double"), F.col("vec_id") % 10 == 0, most=60, least=20)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    mine, want = found(got), neighbours(rows, 10)
    assert [r[:2] + r[3:] for r in mine] == [r[:2] + r[3:] for r in want]
    assert mine == want


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 0.0])], [(0, [1.0, 0.0]), (3, [0.0, 2.0])], [(0, [1e200, 1e200]), (1, [1e-200, 0.0]), (2, [-1.0, -1.0])]])
def test_neighbours_of_few_vectors(spark, rows):
    mine = found(vantage.nearest(vectors(spark, rows, "double"), F.col("vec_id") % 10 == 0))
    if len(rows) == 3:
        assert [r[:3] for r in mine] == [(0, 1, 1), (0, 2, 2)] and mine[0][3] == round(0.5**0.5, 12) and mine[1][3] == -1.0
    else:
        assert mine == neighbours(rows, 10)


def test_relaxed_pruning_keeps_recall_and_meets_fewer_vectors(spark):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(40, 16))
    x = vantage.units(centres[draw.integers(0, 40, 6000)] + 0.35 * draw.normal(size=(6000, 16)))
    tree, q = vantage.VantageTree(x), x[::20]
    full = np.argsort(-(q @ x.T), axis=1)[:, :6]
    met = {}
    for factor in (1.0, 1.2, 1.5):
        tree.met = 0
        _, of = tree.search(q, 10, 6, np.full(len(q), np.inf), factor)
        met[factor] = tree.met
        recall = np.mean([len(set(a[:6]) & set(b)) / 6 for a, b in zip(of, full)])
        assert recall == 1.0 if factor == 1 else recall >= 0.9, (factor, recall)
    assert met[1.5] < met[1.2] < met[1.0] < len(q) * len(x)
    with pytest.raises(ValueError):
        vantage.nearest(vectors(spark, []), F.lit(True), factor=0.9)
