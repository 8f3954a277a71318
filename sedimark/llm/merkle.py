"""A Merkle manifest of a data set: a tree for each group of rows, a tree over the groups' roots, and a proof for each row.

Rows are sorted over all partitions by group and order. The number of a row in its
group is its place in the partition's stretch of the group, plus the rows that
earlier partitions have of the partition's first group: one offset a partition.

A node is the SHA-256 of sixteen consecutive nodes below, as hex text (the last run of a
group may have fewer). Each stretch hashes its complete aligned runs where it lies,
level by level. The ragged nodes at its ends, at most thirty a level, are shuffled by
their coordinates (group, level, number) and finished level by level, sixteen at a
time. The sides of their runs go back to the stretches by partition, and a row's proof
is its sides inside the stretch, then those above. A proof is folded by SQL functions.

What passes through the driver is a row for each partition and the height of the
highest tree. A group that holds most rows is spread over as many partitions as
they need; rows that are equal in all columns are dealt out by their places.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sedimark.llm._common import partitions_for, runs, shared_folder, stored

FANOUT = 16
HEX = 64
PROOF = "array<struct<left: string, right: string>>"


def encoded(column: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = column.cast("string")
    return F.when(column.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(c) for c in columns]), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof lead to."""
    return F.aggregate(proof, leaf, lambda below, side: F.sha2(F.concat(side["left"], below, side["right"]), 256))


def levels_of(first: int, digests: list[str]) -> list[tuple[int, list[str]]]:
    """(number of the first node, digests) for each level that complete runs of a stretch give."""
    out = [(first, digests)]
    while True:
        first, nodes = out[-1]
        begin, end = -(-first // FANOUT), (first + len(nodes)) // FANOUT
        if begin >= end:
            return out
        joined = "".join(nodes[begin * FANOUT - first : end * FANOUT - first]).encode()
        out.append((begin, [hashlib.sha256(joined[at : at + FANOUT * HEX]).hexdigest() for at in range(0, len(joined), FANOUT * HEX)]))


def ragged_of(levels: list[tuple[int, list[str]]]) -> Iterator[tuple[int, int, str]]:
    """(level, number, digest) of the nodes whose run isn't complete in the stretch."""
    for level, (first, nodes) in enumerate(levels):
        begin, end = -(-first // FANOUT) * FANOUT, (first + len(nodes)) // FANOUT * FANOUT
        for k, digest in enumerate(nodes, first):
            if begin >= end or not begin <= k < end:
                yield level, k, digest


def _longer(schema: StructType, more: str) -> StructType:
    return StructType([*schema.fields, *StructType.fromDDL(more).fields])


class Forest:
    """A tree for each group of leaves, which have the columns grp (a string), leaf (hex text) and whatever order names.

    Equal rows of a group follow each other by leaf. Tables are written below folder.
    """

    def __init__(self, leaves: DataFrame, order: list[str], folder: str, per_partition: int):
        spark, self.folder = leaves.sparkSession, folder
        self.columns = [c for c in leaves.columns if c != "grp"]
        held = stored(leaves, folder, "leaves")
        self.parts = partitions_for(held.count(), per_partition, spark)
        self.rows = stored(self._numbered(held, order), folder, "rows")
        counts = self.rows.groupBy("p", "grp").agg(F.count("*").alias("n"))
        self.before = self._offsets(counts)
        sizes = counts.groupBy("grp").agg(F.sum("n").alias("n"))
        height = sum((F.when(F.col("n") > F.lit(FANOUT**k), 1).otherwise(0) for k in range(16)), F.lit(0))
        heights = stored(sizes.select("grp", height.alias("height")), folder, "heights")
        highest = heights.agg(F.max("height")).first()[0] or 0
        self.tops = stored(self._ragged().join(heights, "grp"), folder, "tops")
        self._finish(highest)

    def _numbered(self, leaves: DataFrame, order: list[str]) -> DataFrame:
        """The leaves in order, with their partition p and their place pos in the partition's stretch of the group."""
        keys = ["grp", *order, "leaf", "_place"]
        ordered = leaves.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(self.parts, *keys).sortWithinPartitions(*keys).drop("_place")

        def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            p, last, pos = TaskContext.get().partitionId(), None, 0
            for batch in batches:
                places = []
                for group in batch.column(at).to_pylist():
                    pos = pos + 1 if group == last else 0
                    last = group
                    places.append(pos)
                if places:
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([p] * len(places), pa.int32()), pa.array(places, pa.int64())], [*batch.schema.names, "p", "pos"])

        at = ordered.columns.index("grp")
        return ordered.mapInArrow(number, _longer(ordered.schema, "p int, pos long"))

    def _offsets(self, counts: DataFrame) -> dict[int, tuple[str, int]]:
        """For each partition its first group and the rows which earlier partitions have of it."""
        ends = counts.groupBy("p").agg(F.min("grp").alias("first"), F.min_by("n", "grp").alias("first_n"), F.max("grp").alias("last"), F.max_by("n", "grp").alias("last_n"))
        out, group, n = {}, None, 0
        for p, first, first_n, last, last_n in ends.orderBy("p").collect():
            before = n if first == group else 0
            out[p] = (first, before)
            group, n = last, before + first_n if first == last else last_n
        return out

    def _ragged(self) -> DataFrame:
        """p, grp, level, number and digest of the nodes that no stretch can take further."""
        before = self.before

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for stretch in runs(batches, ["p", "grp"]):
                p, group = stretch.column("p")[0].as_py(), stretch.column("grp")[0].as_py()
                places, digests = stretch.column("pos").to_pylist(), stretch.column("leaf").to_pylist()
                offset = before[p][1] if before[p][0] == group else 0
                # A task may read parts of a partition, but each part in order and without gaps.
                cuts = [0, *(k for k in range(1, len(places)) if places[k] != places[k - 1] + 1), len(places)]
                found = [x for a, b in zip(cuts, cuts[1:], strict=False) for x in ragged_of(levels_of(places[a] + offset, digests[a:b]))]
                level, number, digest = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(found), pa.int32()), pa.array([group] * len(found)), pa.array(level, pa.int32()), pa.array(number, pa.int64()), pa.array(digest)], ["p", "grp", "level", "number", "digest"])

        return self.rows.select("p", "grp", "pos", "leaf").mapInArrow(work, "p int, grp string, level int, number long, digest string")

    def _finish(self, highest: int) -> None:
        """Levels upwards from the ragged nodes, then the sides of runs downwards."""
        node = ["grp", "height", "level", "number", "digest"]
        roots, made, nodes = [], [], None
        for level in range(highest + 1):
            own = self.tops.filter(F.col("level") == level).select(node)
            nodes = own if nodes is None else own.unionByName(nodes)
            roots.append(nodes.filter(F.col("height") == level).select("grp", "digest"))
            if level < highest:
                below = nodes.filter(F.col("height") > level).withColumn("run", F.floor(F.col("number") / FANOUT))
                grouped = below.groupBy("grp", "height", "run").agg(F.array_sort(F.collect_list(F.struct("number", "digest"))).alias("nodes"))  # sixteen at most
                made.append(stored(grouped.withColumn("digest", F.sha2(F.array_join(F.transform("nodes", lambda x: x["digest"]), ""), 256)), self.folder, f"runs-{level}"))
                nodes = made[-1].select("grp", "height", F.lit(level + 1).alias("level"), F.col("run").alias("number"), "digest")
        self.roots = roots[0]
        for more in roots[1:]:
            self.roots = self.roots.unionByName(more)
        self.roots = stored(self.roots, self.folder, "roots")
        top = self.tops.select("grp", "level", "number").distinct()
        above, paths = None, []
        for level in reversed(range(highest)):
            joined = lambda part: F.array_join(F.transform(part, lambda x: x["digest"]), "")
            each = made[level].select("grp", "run", "nodes", F.posexplode("nodes").alias("at", "own"))
            side = F.struct(joined(F.slice("nodes", F.lit(1), F.col("at"))).alias("left"), joined(F.slice("nodes", F.col("at") + 2, F.lit(FANOUT))).alias("right"))
            each = each.select("grp", "run", F.col("own.number").alias("number"), F.array(side).alias("own"))
            if above is not None:
                upper = above.select("grp", F.col("number").alias("run"), F.col("path").alias("upper"))
                each = each.join(upper, ["grp", "run"], "left").withColumn("own", F.concat("own", F.coalesce("upper", F.array().cast(PROOF))))
            above = stored(each.select("grp", "number", F.col("own").alias("path")), self.folder, f"paths-{level}")
            paths.append(above.withColumn("level", F.lit(level)).join(top, ["grp", "level", "number"], "left_semi"))
        self.paths = None
        for part in paths:
            self.paths = part if self.paths is None else self.paths.unionByName(part)

    def proved(self, outer: DataFrame | None = None) -> DataFrame:
        """The leaves' columns with number, subroot, root and proof.

        outer has key, proof and root for each group: the tree over the groups' roots, if there is one.
        """
        none, tops = F.array().cast(PROOF), self.tops.select("p", "grp", "level", "number")
        tops = tops.withColumn("path", none) if self.paths is None else tops.join(self.paths, ["grp", "level", "number"], "left").withColumn("path", F.coalesce("path", none))
        roots = self.roots.withColumnRenamed("digest", "subroot")
        if outer is None:
            roots = roots.withColumn("root", F.col("subroot"))
        else:
            roots = roots.join(outer.select(F.col("key").alias("grp"), "root", F.col("proof").alias("outer")), "grp")
            tops = tops.join(roots.select("grp", "outer"), "grp").withColumn("path", F.concat("path", "outer")).drop("outer")
        tops = tops.join(roots.select("grp", "subroot", "root"), "grp")
        before, kept = self.before, self.columns
        both = self.rows.withColumn("number", F.col("pos")).unionByName(tops, allowMissingColumns=True)
        spread = both.repartitionByRange(self.parts, "p").sortWithinPartitions("p", "grp", F.col("level").asc_nulls_last(), "number")

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in runs(batches, ["p", "grp"]):
                n_tops = part.num_rows - part.column("level").null_count
                head, rows = part.slice(0, n_tops), part.slice(n_tops)
                above = {(level, k): path for level, k, path in zip(*(head.column(c).to_pylist() for c in ("level", "number", "path")), strict=True)}
                p, group, subroot, root = (head.column(c)[0].as_py() for c in ("p", "grp", "subroot", "root"))
                first = rows.column("pos")[0].as_py() + (before[p][1] if before[p][0] == group else 0)
                levels = [(start, "".join(nodes)) for start, nodes in levels_of(first, rows.column("leaf").to_pylist())]
                for at in range(0, rows.num_rows, 2000):
                    some = rows.slice(at, 2000)
                    left, right, ends = [], [], [0]
                    for own in range(first + at, first + at + some.num_rows):
                        level = 0
                        while (level, own) not in above:
                            start, nodes = levels[level]
                            begin, here = (own - own % FANOUT - start) * HEX, (own - start) * HEX
                            left.append(nodes[begin:here])
                            right.append(nodes[here + HEX : begin + FANOUT * HEX])
                            level, own = level + 1, own // FANOUT
                        for side in above[level, own]:
                            left.append(side["left"])
                            right.append(side["right"])
                        ends.append(len(left))
                    proof = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["left", "right"]))
                    numbers = pa.array(range(first + at, first + at + some.num_rows), pa.int64())
                    yield pa.RecordBatch.from_arrays([*(some.column(c).combine_chunks() for c in kept), numbers, pa.array([subroot] * some.num_rows), pa.array([root] * some.num_rows), proof], [*kept, "number", "subroot", "root", "proof"])

        return spread.mapInArrow(work, _longer(self.rows.select(kept).schema, f"number long, subroot string, root string, proof {PROOF}"))


def manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "source", order: str = "doc_id", extra: dict[str, Column] | None = None, per_partition: int = 100_000) -> DataFrame:
    """order, leaf, the columns of extra, number, subroot, root and proof of each row.

    A leaf is the digest of the columns. Rows of one group ascend by order, null first;
    equal ones by leaf, and rows that are the same in all columns have a leaf each. A
    null group is a group of its own, the first one. Other columns take no part. A
    table without rows has a manifest without rows. proof goes from the leaf's run to the
    root: the digests left and right of one's own, joined, for each level.
    """
    folder = shared_folder(docs.sparkSession)
    grp = F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit(""))
    more = [c.alias(name) for name, c in (extra or {}).items()]
    leaves = docs.select(grp.alias("grp"), F.col(order), leaf_digest([F.col(c) for c in columns]).alias("leaf"), *more)
    inner = Forest(leaves, [order], f"{folder}/inner", per_partition)
    outer = Forest(inner.roots.select(F.lit("").alias("grp"), F.col("grp").alias("key"), F.col("digest").alias("leaf")), ["key"], f"{folder}/outer", per_partition)
    return inner.proved(outer.proved())


def tampered_proofs(docs: DataFrame) -> DataFrame:
    """Each row's proof digest, and what its root becomes when every fifth row by crc32 of doc_id has its text lower-cased.

    Only A-Z change; a null text stays, and a null doc_id is never tampered with.
    """
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    text = F.when(hit, low).otherwise(F.col("text"))
    found = leaf_digest([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text])
    rows = manifest(docs, extra={"found": found})
    proof = F.sha2(F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    rows = rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded(F.col("found"), F.col("proof")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
