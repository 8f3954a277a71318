"""Dual-tree clustering against Lloyd's rounds over all pairs, in Python's integers."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from sedimark.llm import dual_tree
from sedimark.llm.dual_tree import CoverTree, Walk


def brute(rows, k=16, rounds=3, scale=64, width=64, seed=1):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    centroids = [v for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            members = [v for (_, v), c in zip(kept, own, strict=True) if c == n]
            if members:
                centroids[n] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    out = [(i, *reversed(nearest(v))) for i, v in kept]
    by = Counter()
    for _, c, d in out:
        by[c] += d
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, c, d, by[c], sum(by.values()), marks[c]) for i, c, d in out)


def blobs(rng, n, spread=0.05, width=64):
    centres = [[rng.uniform(-1, 1) for _ in range(width)] for _ in range(9)]
    return [[x + rng.gauss(0, spread) for x in rng.choice(centres)] for _ in range(n)]


SCHEMA = "vec_id long, embedding array<double>"


def test_clusters_against_all_pairs(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(k, v) for k, v in enumerate(blobs(rng, 400))] + [(1000 + k, [rng.uniform(-1, 1) for _ in range(64)]) for k in range(150)]
    rows += [(2000 + k, rows[0][1]) for k in range(200)] + [(3, rows[5][1]), (3, rows[5][1]), (None, rows[7][1])]  # a third equal, repeated and null ids
    rows += [(5000, None), (5001, []), (5002, [0.5] * 63), (5003, [0.5] * 63 + [None]), (5004, [0.5] * 63 + [math.nan]), (5005, [0.5] * 63 + [-math.inf]), (5006, [0.0] * 64), (5007, [-0.001] * 64)]
    inner = dual_tree.lloyd
    monkeypatch.setattr(dual_tree, "lloyd", lambda v, **b: inner(v, block_rows=64, **b))
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS cluster", "2 AS codes", "3 AS distance").repartition(5)
    assert Counter(map(tuple, dual_tree.clustered(frame).collect())) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 5, 16])
def test_few_vectors(spark, n):
    rows = [(k, [float(k)] * 64) for k in range(n)]
    assert Counter(map(tuple, dual_tree.clustered(spark.createDataFrame(rows, SCHEMA)).collect())) == brute(rows)


def test_equal_vectors_leave_clusters_empty(spark):
    rows = [(k, [0.25] * 64) for k in range(40)]
    found = dual_tree.clustered(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter(map(tuple, found)) == brute(rows) and {r.cluster for r in found} == {0}


def test_wide_components_are_exact(spark):
    rng = random.Random(4)
    rows = [(k, [rng.choice([1.5e6, 1.5e6 + 1 / 64, 1.5e6 - 9, 1.4e6]) for _ in range(64)]) for k in range(60)]
    assert Counter(map(tuple, dual_tree.clustered(spark.createDataFrame(rows, SCHEMA)).collect())) == brute(rows)


def test_distances_beyond_64_bits_are_refused(spark):
    rows = [(k, [1e9 * k] * 64) for k in range(40)]
    with pytest.raises(Exception, match="64 bits"):
        dual_tree.clustered(spark.createDataFrame(rows, SCHEMA)).collect()
    with pytest.raises(Exception, match="too large"):
        dual_tree.clustered(spark.createDataFrame([(1, [1e300] * 64)], SCHEMA)).collect()


@pytest.mark.parametrize("kind", ["blobs", "even", "equal", "one"])
def test_cover_tree_holds_its_points(kind):
    rng = random.Random(1)
    points = {"blobs": blobs(rng, 300), "even": [[rng.random() for _ in range(64)] for _ in range(200)], "equal": [[0.5] * 64] * 50, "one": [[1.0] * 64]}[kind]
    codes = np.floor(np.array(points) * 64).astype(np.int64)
    tree = CoverTree.unpacked(CoverTree.of(codes).packed())
    assert sorted(tree.order.tolist()) == list(range(len(codes)))
    for k in range(len(tree.start)):
        own = codes[tree.order[tree.start[k] : tree.end[k]]]
        apart = dual_tree.roots(dual_tree.squared(own, codes[tree.centre[k]]))
        assert tree.centre[k] in tree.order[tree.start[k] : tree.end[k]] and apart.max() == tree.radius[k]
        below = range(tree.first[k], tree.last[k])
        assert not below or [tree.start[below[0]], tree.end[below[-1]]] == [tree.start[k], tree.end[k]]
        # Covering and separation: children's points lie within half the radius' power of two, their centres further apart.
        centres = codes[tree.centre[list(below)]]
        for i, c in enumerate(below):
            cover = 2.0 ** math.floor(math.log2(tree.radius[k]))
            cover = cover if cover < tree.radius[k] else cover / 2
            assert tree.radius[c] <= cover and all(np.sqrt(((centres[i] - x) ** 2).sum()) > cover for x in centres[:i])


def test_walk_prunes_pairs_of_clustered_vectors():
    rng = random.Random(6)
    codes = np.floor(np.array(blobs(rng, 2000, spread=0.02)) * 64).astype(np.int64)
    centroids = codes[::125]
    walk = Walk(codes, CoverTree.of(codes), centroids)
    all_pairs = ((codes[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert (walk.cluster == all_pairs.argmin(axis=1)).all()
    assert walk.met + walk.compared < 0.35 * all_pairs.size
