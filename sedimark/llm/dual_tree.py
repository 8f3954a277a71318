"""Lloyd's clustering by two trees: a cover tree over a block's vectors and one over the centroids of the round.

Blocks of consecutive rows get a cover tree once and are stored with it; no vector
is shuffled. A node has a centre, one of its points, and a radius; the centres of its
children are further apart than the cover that each child's points lie in.

Each round walks pairs of nodes. A vector node's bound is the least, over the centroid
nodes met, of the centres' distance plus its radius. A pair whose points are all
further apart is dropped. Where one centroid is left, it takes the whole node; where
both nodes are leaves, distances are compared exactly, in integers. A round returns a
row for each cluster.

Bounds are floats with a margin far above their rounding; what they decide is only which
pairs are compared. Components beyond 2^26 are reckoned in Python's integers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from sedimark.llm._common import ragged, shared_folder, stored

PLAIN = 1 << 26
LEAF = 8


def integers(codes: np.ndarray) -> np.ndarray:
    """64-bit integers where squares of differences fit them, else Python's."""
    return codes.astype(np.int64) if not codes.size or max(abs(int(codes.min())), abs(int(codes.max()))) <= PLAIN else codes.astype(object)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=-1)


def roots(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(np.asarray(squares, dtype=np.float64))


@dataclass
class CoverTree:
    """Points in the tree's order; node k has order[start[k]:end[k]], children first[k]:last[k] (none: a leaf)."""

    order: np.ndarray
    start: np.ndarray
    end: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    last: np.ndarray

    @classmethod
    def of(cls, points: np.ndarray, leaf: int = LEAF) -> CoverTree:
        """A node of at most leaf points, or of equal points, isn't cut further."""
        order = np.arange(len(points))
        nodes = [[0, len(points), 0, roots(squared(points, points[0])) if len(points) else np.zeros(0)]]
        radius, first, last, at = [], [], [], 0
        while at < len(nodes):
            begin, end, centre, far = nodes[at]
            radius.append(float(far.max()) if len(far) else 0.0)
            first.append(len(nodes))
            if end - begin > leaf and radius[-1] > 0:
                cover = 2.0 ** (math.ceil(math.log2(radius[-1])) - 1)
                cover = cover if cover < radius[-1] else cover / 2
                rest, place, own, put = order[begin:end].copy(), begin, centre, far
                while len(rest):
                    near = put <= cover
                    near |= rest == own
                    members = rest[near]
                    order[place : place + len(members)] = members
                    nodes.append([place, place + len(members), own, put[near]])
                    place += len(members)
                    rest, far = rest[~near], far[~near]
                    if len(rest):
                        own = int(rest[np.argmax(far)])
                        put = roots(squared(points[rest], points[own]))
            nodes[at][3] = None
            last.append(len(nodes))
            at += 1
        columns = [np.array([n[k] for n in nodes], dtype=np.int64) for k in range(3)]
        return cls(order, *columns, np.array(radius), np.array(first, dtype=np.int64), np.array(last, dtype=np.int64))

    def packed(self) -> bytes:
        head = np.array([len(self.order), len(self.start)], dtype=np.int64)
        return b"".join(x.astype(np.int64).tobytes() for x in (head, self.order, self.start, self.end, self.centre, self.first, self.last)) + self.radius.tobytes()

    @classmethod
    def unpacked(cls, raw: bytes) -> CoverTree:
        n, m = np.frombuffer(raw, np.int64, 2).tolist()
        at, out = 16, []
        for size in (n, m, m, m, m, m):
            out.append(np.frombuffer(raw, np.int64, size, at))
            at += 8 * size
        order, start, end, centre, first, last = out
        return cls(order, start, end, centre, np.frombuffer(raw, np.float64, m, at), first, last)


class Walk:
    """Assigns points to their nearest centroids (ties: the smaller number).

    met counts the distances of nodes' centres, compared those of points in pairs of leaves.
    """

    def __init__(self, points: np.ndarray, tree: CoverTree, centroids: np.ndarray):
        self.met = self.compared = 0
        self.cluster = np.zeros(len(points), dtype=np.int32)
        if not len(points):
            return
        sites = CoverTree.of(centroids, leaf=1)
        # Equal centroids share a leaf; the smallest of their numbers stands for it.
        number = np.array([sites.order[a:b].min() for a, b in zip(sites.start.tolist(), sites.end.tolist(), strict=True)])
        q_leaf, r_leaf = tree.first == tree.last, sites.first == sites.last
        bound = np.full(len(tree.start), np.inf)
        q, r = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        while len(q):
            self.met += len(q)
            apart = roots(squared(points[tree.centre[q]], centroids[sites.centre[r]]))
            np.minimum.at(bound, q, apart + tree.radius[q])
            radii = tree.radius[q] + sites.radius[r]
            close = apart - radii <= bound[q] + 1e-9 * (bound[q] + apart + radii) + 1e-6
            q, r = q[close], r[close]
            # A vector node stays while its centroid nodes can be cut, so that its pairs are met together.
            cut = ~r_leaf[r] & (q_leaf[q] | (sites.radius[r] >= tree.radius[q]))
            waits = np.zeros(len(bound), dtype=bool)
            waits[q[cut]] = True
            many = np.bincount(q, minlength=len(bound))
            alone = ~waits[q] & (many[q] == 1) & r_leaf[r]
            for a, b, c in zip(tree.start[q[alone]].tolist(), tree.end[q[alone]].tolist(), number[r[alone]].tolist(), strict=True):
                self.cluster[tree.order[a:b]] = c
            exact = ~waits[q] & ~alone & q_leaf[q]
            pairs.append((q[exact], r[exact]))
            down = ~waits[q] & ~alone & ~q_leaf[q]
            stays = waits[q] & ~cut
            n_r, n_q = (sites.last - sites.first)[r[cut]], (tree.last - tree.first)[q[down]]
            lower = ragged(tree.first[q[down]], n_q)
            np.minimum.at(bound, lower, np.repeat(bound[q[down]], n_q))
            q, r = np.concatenate([q[stays], np.repeat(q[cut], n_r), lower]), np.concatenate([r[stays], ragged(sites.first[r[cut]], n_r), np.repeat(r[down], n_q)])
        self._compare(points, tree, centroids, number, [np.concatenate(x) for x in zip(*pairs, strict=True)])

    def _compare(self, points: np.ndarray, tree: CoverTree, centroids: np.ndarray, number: np.ndarray, pairs: list[np.ndarray]) -> None:
        q, r = pairs
        sizes = (tree.end - tree.start)[q]
        rows, sites = tree.order[ragged(tree.start[q], sizes)], np.repeat(number[r], sizes)
        self.compared = len(rows)
        best = [squared(points[rows[a : a + 65536]], centroids[sites[a : a + 65536]]) for a in range(0, len(rows), 65536)]
        if best:
            apart = np.concatenate(best)
            by = np.lexsort((-sites, -apart, rows)) if apart.dtype != object else np.array(sorted(range(len(rows)), key=lambda k: (rows[k], -apart[k], -sites[k])), dtype=np.int64)
            self.cluster[rows[by]] = sites[by]  # the nearest is written last


def usable(vectors: DataFrame, scale: int, width: int) -> DataFrame:
    """vec_id and floor(scale * x) of each component, of the vectors with width components, none null or non-finite."""
    x = F.col("embedding")
    fine = lambda v: F.coalesce(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False))
    most = float(1 << 62)

    def code(v):
        scaled = v.cast("double") * scale
        return F.when(F.abs(scaled) >= most, F.raise_error(F.lit("a component is too large for distances in 64 bits")).cast("long")).otherwise(F.floor(scaled))

    kept = vectors.filter(x.isNotNull() & (F.size(x) == width) & F.forall(x, fine))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, code).alias("codes"))


def first_centroids(codes: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors of the k least hashes of the seed and the id, in this order; a null id comes last, one id's vectors by their components."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = codes.select(hashed.alias("hash"), "codes").orderBy(F.asc_nulls_last("hash"), "codes").limit(k).collect()
    return np.array([r["codes"] for r in rows], dtype=np.int64)


def in_blocks(codes: DataFrame, width: int, block_rows: int) -> DataFrame:
    """A row for each block of vectors: their ids, components in the narrowest type, and cover tree."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def block() -> pa.RecordBatch:
            nonlocal held, n
            rows, rest = (whole := pa.Table.from_batches(held)).slice(0, block_rows), whole.slice(block_rows)
            held, n = rest.to_batches(), rest.num_rows
            values = rows.column(1).combine_chunks().flatten().to_numpy().reshape(-1, width)
            kind = next(t for t in ("i1", "i2", "i4", "i8") if np.iinfo(t).min <= values.min(initial=0) and values.max(initial=0) <= np.iinfo(t).max)
            tree = CoverTree.of(integers(values))
            ids = pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows.column(0).combine_chunks())
            return pa.RecordBatch.from_arrays([ids, pa.array([kind]), pa.array([values.astype(kind).tobytes()], pa.binary()), pa.array([tree.packed()], pa.binary())], ["ids", "kind", "codes", "tree"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            while n >= block_rows:
                yield block()
        if n:
            yield block()

    return codes.mapInArrow(work, "ids array<long>, kind string, codes binary, tree binary")


def _walks(batches: Iterator[pa.RecordBatch], centroids: list[list[int]], width: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, Walk]]:
    """(ids, codes, centroids, walk) of each block."""
    for batch in batches:
        for k in range(batch.num_rows):
            codes = integers(np.frombuffer(batch.column("codes")[k].as_py(), batch.column("kind")[k].as_py()).reshape(-1, width))
            sites = integers(np.array(centroids, dtype=np.int64).reshape(-1, width))
            if codes.dtype != sites.dtype:
                codes, sites = codes.astype(object), sites.astype(object)
            yield batch.column("ids")[k].values, codes, sites, Walk(codes, CoverTree.unpacked(batch.column("tree")[k].as_py()), sites)


@dataclass
class Clusters:
    """The centroids and a table of vec_id, cluster and distance."""

    centroids: list[list[int]]
    rows: DataFrame
    totals: list[Row]


def lloyd(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, width: int = 64, seed: int = 1, block_rows: int = 2048) -> Clusters:
    """Clusters of the vectors' integer components.

    Centroids become the floor of the exact mean; an empty cluster's stays. With fewer
    than k vectors there are as many centroids; without any, no rows. Vectors that are
    null, of another width, or with a null or non-finite component are left out; a null or
    repeated vec_id takes part like any other. A squared distance that doesn't fit 64 bits
    raises an error, as no row could hold it.
    """
    spark = vectors.sparkSession
    folder = shared_folder(spark)
    codes = usable(vectors, scale, width)
    centroids = first_centroids(codes, k, seed).reshape(-1, width).tolist()
    blocks = stored(in_blocks(codes, width, block_rows), folder, "blocks")
    for _ in range(rounds if centroids else 0):
        centroids = _moved(blocks, centroids, width)
    rows = stored(_assigned(blocks, centroids, width), folder, "assigned")
    totals = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).cast("long").alias("cluster_inertia")).orderBy("cluster").collect()
    return Clusters(centroids, rows, totals)


def _moved(blocks: DataFrame, centroids: list[list[int]], width: int) -> list[list[int]]:
    """The centroids after a round: a row for each cluster comes back."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = [0] * len(centroids), [[0] * width for _ in centroids]
        for _, codes, _, walk in _walks(batches, centroids, width):
            for c in np.unique(walk.cluster).tolist():
                own = codes[walk.cluster == c]
                n[c] += len(own)
                sums[c] = [a + int(b) for a, b in zip(sums[c], own.sum(axis=0).tolist(), strict=True)]
        full = [c for c in range(len(centroids)) if n[c]]
        if full:
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([n[c] for c in full], pa.int64()), pa.array([[Decimal(x) for x in sums[c]] for c in full], pa.list_(pa.decimal128(38, 0)))], ["cluster", "n", "sums"])

    parts = blocks.mapInArrow(work, "cluster int, n long, sums array<decimal(38,0)>")
    found = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[d]).alias(f"s{d}") for d in range(width)]).collect()
    out = [list(c) for c in centroids]
    for row in found:
        out[row["cluster"]] = [int(row[f"s{d}"]) // row["n"] for d in range(width)]
    return out


def _assigned(blocks: DataFrame, centroids: list[list[int]], width: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, codes, sites, walk in _walks(batches, centroids, width):
            apart = squared(codes, sites[walk.cluster])
            if len(apart) and int(apart.max()) >= 1 << 63:
                raise ValueError("a squared distance doesn't fit 64 bits")
            yield pa.RecordBatch.from_arrays([ids, pa.array(walk.cluster, pa.int32()), pa.array(apart.astype(np.int64))], ["vec_id", "cluster", "distance"])

    return blocks.mapInArrow(work, "vec_id long, cluster int, distance long")


def clustered(vectors: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector that takes part."""
    found = lloyd(vectors)
    spark, inertia = vectors.sparkSession, sum(r["cluster_inertia"] for r in found.totals)
    marks = [(r["cluster"], r["cluster_inertia"], inertia, hashlib.sha256(",".join(map(str, found.centroids[r["cluster"]])).encode()).hexdigest()) for r in found.totals]
    named = spark.createDataFrame(marks, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.rows.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
