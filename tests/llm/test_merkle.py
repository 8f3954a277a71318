"""Merkle manifests against a version on lists, and proofs that don't hold."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sedimark.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(doc, text, lang, source, n):
    return h(*map(enc, (doc, source, lang, n, text)))


def climb(nodes):
    """(root, list of sides for each node)"""
    sides, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, place in enumerate(at):
            run = nodes[place // 16 * 16 : place // 16 * 16 + 16]
            sides[k].append(("".join(run[: place % 16]), "".join(run[place % 16 + 1 :])))
            at[k] = place // 16
        nodes = [h(*nodes[a : a + 16]) for a in range(0, len(nodes), 16)]
    return nodes[0] if nodes else None, sides


def brute(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[3]].append((row[0] is not None, row[0] or 0, leaf(*row), row))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in order}
    root, outer = climb([trees[s][0] for s in order])
    out = []
    for s, above in zip(order, outer, strict=True):
        for (_, _, own, (doc, text, lang, source, n)), inside in zip(sorted(groups[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            path = inside + above
            hit = doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text) if hit and text is not None else text
            found = leaf(doc, low, lang, source, n)
            for left, right in path:
                found = h(left, found, right)
            out.append((doc, own, trees[s][0], root, h(*(left + right for left, right in path)), found, found == root))
    return out


@pytest.fixture(scope="module")
def rows():
    """A source with most rows, of one row, of sixteen, of 256, null and empty sources, repeated rows and ids, nulls everywhere."""
    rng = random.Random(3)
    out = [(k, rng.choice(["Abc", "abc", "É Z", None, ""]), rng.choice(["en", None]), "hot", k % 7) for k in range(700)]
    out += [(1000 + k, f"Text {k}", "de", "sixteen", None) for k in range(16)] + [(2000 + k, f"T{k}", "fr", "full", 1) for k in range(256)]
    out += [(5, "One", "en", "one", 3), (6, None, None, None, None), (7, "Null Source", "en", None, 4), (8, "Empty", "en", "", 5), (9, "Ü", "en", "Ü", 1)]
    out += [(None, "No Id", "en", "hot", 2), (None, "No Id", "en", "hot", 2), (None, None, None, None, None), (11, "Twice", "en", "hot", 1), (11, "Twice", "en", "hot", 1), (12, "b", "x", "hot", 1), (12, "a", "x", "hot", 1)]
    return out + [(3000 + k, f"Many {k}", "en", f"s{k}", k) for k in range(40)] + [(4000, "Long Text " * 30_000, "en", "long", 1)]


@pytest.mark.parametrize("per_partition", [13, 100, 100_000])
def test_manifest_against_lists(spark, rows, per_partition, monkeypatch):
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS leaf", "1 AS number", "2 AS grp", "3 AS p", "4 AS level").repartition(7)
    inner = merkle.manifest
    monkeypatch.setattr(merkle, "manifest", lambda *a, **b: inner(*a, **b, per_partition=per_partition))
    found = merkle.tampered_proofs(docs).collect()
    assert Counter(map(tuple, found)) == Counter(brute(rows))


def test_one_group_over_many_partitions_with_equal_rows(spark):
    rows = [(1, "Same", "en", "s", 1)] * 500 + [(k, "x", "en", "s", 1) for k in range(2, 40)]
    out = merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(3), per_partition=20)
    assert sorted(r.number for r in out.collect()) == list(range(len(rows)))
    assert out.select(merkle.folded(F.col("leaf"), F.col("proof")).alias("r"), "root").filter("r <> root").count() == 0
    assert {r.root for r in out.select("root").collect()} == {climb([climb([leaf(*r) for r in rows])[0]])[0]}


def test_a_changed_proof_does_not_hold(spark, rows):
    out = merkle.manifest(spark.createDataFrame(rows, SCHEMA))
    swapped = F.transform("proof", lambda s: F.struct(s["right"].alias("left"), s["left"].alias("right")))
    wrong = out.filter("size(proof) > 0").select(merkle.folded(F.lit("0" * 64), F.col("proof")).alias("a"), merkle.folded(F.col("leaf"), swapped).alias("b"), "root")
    assert wrong.filter("a = root").count() == 0 and wrong.filter("b = root").count() == 0


def test_manifest_of_nothing_and_of_one_row(spark, empty):
    assert merkle.tampered_proofs(empty).collect() == []
    row = (7, "One", "en", "s", 3)
    (found,) = merkle.tampered_proofs(spark.createDataFrame([row], SCHEMA)).collect()
    assert tuple(found) == brute([row])[0] and found.leaf == found.subroot == found.root and found.proof_sha256 == h()


@pytest.mark.parametrize(("first", "n"), [(0, 1), (0, 16), (5, 11), (5, 12), (3, 600), (16, 256), (15, 258), (0, 4096), (250, 300)])
def test_stretches_are_cut_into_whole_subtrees(first, n):
    whole = [h(str(k)) for k in range(first + n + 40)]
    levels = [whole]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][a : a + 16]) for a in range(0, len(levels[-1]), 16)])
    found = list(merkle.ragged_of(merkle.levels_of(first, whole[first : first + n])))
    covered = []
    for level, k, digest in found:
        assert digest == levels[level][k]
        covered += range(k * 16**level, (k + 1) * 16**level)
    assert sorted(covered) == list(range(first, first + n))
    assert max(Counter(level for level, _, _ in found).values()) <= 30
