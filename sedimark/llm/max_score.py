"""Exact top-k by inner product over shards, by MaxScore.

A shard holds rows of integer vectors. Each dimension is a term in two senses:
a query weight above zero looks for large components and one below for small
ones. Its posting list has the rows whose component lies beyond the shard's
quartile on that side, so rows outside the list add at most the weight times the
quartile. That sum over all terms is the base bound; a list's own bound is what
its best row adds beyond it.

For a query, lists are sorted by bound. Lists with small bounds that together
can't lift a row from the base bound to the k-th best score are non-essential;
rows in no essential list are never looked at. The rows of the essential lists
are probed in the other dimensions, largest weights first, and dropped as soon
as what is left can't bring them to the k-th best score: that is at most the sum
of the terms' bounds, and at most the product of the lengths of the query's and
the row's rests. Shards' results are merged by rank.

How much the split spares depends on the vectors. Where most components are zero,
most rows are in no essential list. Where all are of about the same size, as in
dense embeddings, the base bound alone exceeds the k-th score and every row is
probed, as far as the rests' lengths let it. Shards with components beyond 2^23 are
compared in full, in Python's integers.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimark.llm._common import ragged, runs

PROBE = 8
#: Components up to which bounds and scores of up to 2^16 dimensions are safe in 64 bits; beyond, Python's integers are used.
PLAIN = 1 << 23


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and floor(scale * x) of each component, as a double, which holds it exactly.

    Rows with a null id, a null vector, or a null, infinite or not-a-number
    component are left out. A component too large to be scaled is refused.
    """
    x = F.col("embedding")
    fine = lambda v: F.coalesce(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False))
    good = x.isNotNull() & F.col("vec_id").isNotNull() & F.forall(x, fine)

    def code(v):
        scaled = v.cast("double") * scale
        # Doubles from 2^53 on are whole numbers.
        whole = F.when(F.abs(scaled) < float(1 << 53), F.floor(scaled).cast("double")).otherwise(scaled)
        return F.when(F.abs(scaled) == float("inf"), F.raise_error(F.lit("a component is too large to be scaled")).cast("double")).otherwise(whole)

    return vectors.filter(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, code).alias("codes"))


class Shard:
    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.wide = ids[order], None
        if rows.size and not (-PLAIN <= rows.min() and rows.max() <= PLAIN):
            self.wide = [[int(x) for x in row] for row in rows[order].tolist()]
            return
        self.rows = rows[order].astype(np.int64)
        self.columns, self.squares = np.ascontiguousarray(self.rows.T), (self.rows.astype(np.float64) ** 2).sum(axis=1)
        self.looked_at = self.probed = 0
        n, dims = self.rows.shape
        by = np.argsort(self.rows, axis=0, kind="stable")
        quarter = n // 4
        self.low, self.high = by[:quarter], by[n - quarter :]
        column = np.arange(dims)
        self.least, self.most = self.rows[by[0], column], self.rows[by[-1], column]
        #: What rows outside the lists have at least and at most.
        self.low_rest, self.high_rest = self.rows[by[quarter], column], self.rows[by[n - quarter - 1], column]

    def search(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(row numbers, scores) of the k best rows that aren't own; ties to the smaller id."""
        if self.wide is not None or (query.size and not (-PLAIN <= query.min() and query.max() <= PLAIN)):
            return self._search_wide(own, [int(x) for x in query.tolist()], k)
        query = query.astype(np.int64)
        up = query > 0
        outside = np.where(up, query * self.high_rest, query * self.low_rest)
        most = np.where(up, query * self.most, query * self.least)
        bound = most - outside
        order = np.argsort(-bound, kind="stable")
        lists = [self.high[:, d] if up[d] else self.low[:, d] for d in order if query[d]]
        # A first k-th best score, from the rows of the lists with the largest bounds.
        seed = np.unique(np.concatenate([x[-16:] if up[d] else x[:16] for x, d in zip(lists[:PROBE], order, strict=False)])) if lists else np.zeros(0, np.int64)
        seed = seed[self.ids[seed] != own]
        scores = self.rows[seed] @ query
        kth = np.partition(scores, -k)[-k] if len(scores) >= k else None
        base = int(outside.sum())
        essential = len(lists)
        if kth is not None:
            left = base
            while essential and left + int(bound[order[essential - 1]]) < kth:
                left += int(bound[order[essential - 1]])
                essential -= 1
            everything = essential == len(lists) and base >= kth
        else:
            everything = True
        if everything:  # rows in no list at all are still competitive
            found = np.flatnonzero(self.ids != own)
        else:
            member = np.zeros(len(self.ids), dtype=bool)
            for rows in lists[:essential]:
                member[rows] = True
            found = np.flatnonzero(member & (self.ids != own))
        self.looked_at += len(found)
        partial, squares = np.zeros(len(found), dtype=np.int64), self.squares[found]
        probes = np.argsort(-np.abs(query), kind="stable")
        weights = query[probes].astype(np.float64) ** 2
        rests = np.sqrt(np.concatenate([np.cumsum(weights[::-1])[::-1], [0]]))
        remaining = np.concatenate([np.cumsum(most[probes][::-1])[::-1], [0]])
        for at in range(0, len(probes), PROBE):
            whole = len(found) == len(self.ids)
            for d in probes[at : at + PROBE].tolist():
                column = self.columns[d] if whole else self.columns[d][found]
                partial += column * query[d]
                squares -= column.astype(np.float64) ** 2
            self.probed += len(found) * min(PROBE, len(probes) - at)
            if kth is not None:
                after = min(at + PROBE, len(probes))
                # One more than the rounding of these sums can be.
                lengths = np.sqrt(np.maximum(squares, 0) + 1) * rests[after] + 1
                stays = np.flatnonzero(partial + np.minimum(lengths, remaining[after]) >= kth)
                found, partial, squares = found[stays], partial[stays], squares[stays]
        best = np.lexsort((self.ids[found], -partial))[:k]
        return found[best], partial[best]

    def _search_wide(self, own: int, query: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """All rows in Python's integers; a best score beyond 64 bits is refused."""
        rows = self.wide if self.wide is not None else self.rows.tolist()
        scored = ((sum(a * b for a, b in zip(query, row, strict=True)), i) for i, row in enumerate(rows) if self.ids[i] != own)
        best = heapq.nsmallest(k, ((-s, int(self.ids[i]), i) for s, i in scored))
        if any(not -(1 << 63) <= -s < 1 << 63 for s, _, _ in best):
            raise ValueError("a score doesn't fit 64 bits")
        return np.array([i for _, _, i in best], dtype=np.int64), np.array([-s for s, _, _ in best], dtype=np.int64)


def narrowest(most: float) -> str:
    """The smallest type that holds whole numbers up to most."""
    return "short" if most < 1 << 15 else "int" if most < 1 << 31 else "double"


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = 65_536, least_shards: int = 24, block_rows: int = 65_536) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows of vectors for each query.

    Both have vec_id and codes, whole numbers that doubles hold. Rows with the query's
    own id take no part; one id's rows are candidates each, and a repeated query asks for
    each of its rows, so that its ranks are over the best k rows of them all. Vectors
    of different lengths are compared as if zeros followed the shorter one. Scores
    are exact; one of the k best that doesn't fit 64 bits is refused with an error.

    Shards are hashed by vec_id; each block of queries meets each shard in one task. A
    query is copied once a shard and a vector once a block, in the narrowest type that
    holds all components, so shards and blocks are as large as a worker's memory
    allows: about 300 bytes a row and 8 bytes a component, four times.
    """
    spark = vectors.sparkSession
    largest = F.max(F.array_max(F.transform("codes", lambda v: F.abs(v.cast("double")))))
    n, width, most = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("codes")), F.lit(0)), F.coalesce(largest, F.lit(0.0))).first()
    n_queries, most_asked = queries.agg(F.count("*"), F.coalesce(largest, F.lit(0.0))).first()
    kind = f"array<{narrowest(max(most, most_asked))}>"
    vectors, queries = (df.select("vec_id", F.col("codes").cast(kind).alias("codes")) for df in (vectors, queries))
    shards, blocks = max(least_shards, -(-n // shard_rows)), max(1, -(-n_queries // block_rows))
    rows = vectors.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(False).alias("is_query"), "vec_id", "codes")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), F.lit(True).alias("is_query"), "vec_id", "codes")
    both = rows.unionByName(asked)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["shard", "block"]):
            codes = group.column("codes").combine_chunks()
            lengths, values = codes.value_lengths().to_numpy(), codes.flatten().to_numpy()
            matrix = np.zeros((group.num_rows, max(width, int(lengths.max(initial=0)))), dtype=values.dtype)
            matrix[np.repeat(np.arange(group.num_rows), lengths), ragged(np.zeros(group.num_rows, np.int64), lengths)] = values
            ids, asks = group.column("vec_id").to_numpy(), group.column("is_query").to_numpy()
            if asks.all() or not asks.any():
                continue
            shard, out = Shard(ids[~asks], matrix[~asks]), []
            for own, query in zip(ids[asks].tolist(), matrix[asks], strict=True):
                found, scores = shard.search(own, query, k)
                out.append((np.full(len(found), own), shard.ids[found], scores))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    parts = max(shards * blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = both.repartition(parts, "shard", "block").sortWithinPartitions("shard", "block")
    found = spread.mapInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def embedding_top_k(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """The rows whose id is divisible by every, against all rows."""
    codes = quantised(vectors)
    return top_k(codes, codes.filter(F.pmod("vec_id", F.lit(every)) == 0), k)
