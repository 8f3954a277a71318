"""Exact duplicates by a cuckoo-filter index over text digests.

Texts aren't shuffled: the index works on their SHA-256. Every scan task runs
its rows through an index of its own and passes on one row for each digest, so
a text with any number of copies reaches the shuffle once for each time that
index is emptied, which happens at LOCAL digests. Digests are then dealt over as
many tasks as their number asks for, and each task's index merges what it gets.
The index lies in flat arrays: some 45 bytes a digest, and 25 for what is counted.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.llm._common import fresh, partitions_for, shared_folder, stored, text_of

SLOTS, MAX_KICKS, BYTES = 4, 200, 32
#: Digests that a scan task holds at once, and those that a task after the shuffle is meant for.
LOCAL, MERGED = 200_000, 1_000_000
GROUPS = "digest binary, keep_id long, keep_row long, group_size long"


class CuckooIndex:
    """SHA-256 digest to a number, for live digests.

    A digest may lie in two buckets of four slots; a slot has a 16-bit fingerprint
    and the number of a stored key. A fingerprint that matches is verified against
    the stored digest. When an insertion finds no place after MAX_KICKS moves, the
    buckets are doubled and filled again from the stored keys. Numbers are dense;
    that of a deleted digest is used again.
    """

    def __init__(self, buckets: int = 1024):
        self.keys, self.live, self.free = bytearray(), bytearray(), array("I")
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = array("H", bytes(2 * buckets * SLOTS))
        self.refs = array("I", bytes(4 * buckets * SLOTS))

    def __len__(self) -> int:
        return len(self.live) - len(self.free)

    @property
    def nbytes(self) -> int:
        return len(self.keys) + len(self.live) + sum(a.itemsize * len(a) for a in (self.free, self.prints, self.refs))

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[8:10], "little") or 1
        one = int.from_bytes(digest[:8], "little") & self.mask
        return mark, one, one ^ (mark * 0x5BD1E995 & self.mask)

    def _slot(self, digest: bytes) -> int:
        """The slot of a live digest, or -1."""
        mark, one, two = self._places(digest)
        prints, refs, keys = self.prints, self.refs, self.keys
        for bucket in (one, two):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if prints[slot] == mark and keys[refs[slot] * BYTES : refs[slot] * BYTES + BYTES] == digest:
                    return slot
        return -1

    def get(self, digest: bytes) -> int:
        """The digest's number, or -1."""
        slot = self._slot(digest)
        return -1 if slot < 0 else self.refs[slot]

    def insert(self, digest: bytes) -> int:
        """The number of a digest, which is added if it isn't live."""
        slot = self._slot(digest)
        if slot >= 0:
            return self.refs[slot]
        if self.free:
            ref = self.free.pop()
            self.keys[ref * BYTES : ref * BYTES + BYTES] = digest
            self.live[ref] = 1
        else:
            ref = len(self.live)
            self.keys += digest
            self.live.append(1)
        if not self._put(digest, ref):
            self._resize()
        return ref

    def _put(self, digest: bytes, ref: int) -> bool:
        mark, one, two = self._places(digest)
        prints, refs = self.prints, self.refs
        for bucket in (one, two):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not prints[slot]:
                    prints[slot], refs[slot] = mark, ref
                    return True
        bucket = two
        for kick in range(MAX_KICKS):
            slot = bucket * SLOTS + (kick * 7 + mark) % SLOTS
            prints[slot], mark, refs[slot], ref = mark, prints[slot], ref, refs[slot]
            bucket ^= mark * 0x5BD1E995 & self.mask
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not prints[slot]:
                    prints[slot], refs[slot] = mark, ref
                    return True
        return False

    def _resize(self) -> None:
        buckets = (self.mask + 1) * 2
        while True:
            self._clear(buckets)
            if all(self._put(digest, ref) for digest, ref in self.items()):
                return
            buckets *= 2

    def delete(self, digest: bytes) -> int:
        """The number that a live digest had; -1 if it wasn't live."""
        slot = self._slot(digest)
        if slot < 0:
            return -1
        ref = self.refs[slot]
        self.prints[slot] = self.live[ref] = 0
        self.free.append(ref)
        return ref

    def items(self) -> Iterator[tuple[bytes, int]]:
        return ((bytes(self.keys[ref * BYTES : ref * BYTES + BYTES]), ref) for ref, live in enumerate(self.live) if live)


class _Groups:
    """For each digest its rows' number and the largest (doc_id, row) of them; a null doc_id is the smallest."""

    def __init__(self):
        self.index, self.counts = CuckooIndex(), array("q")
        self.named, self.docs, self.rows = bytearray(), array("q"), array("q")

    def add(self, digest: bytes, doc: int | None, row: int, n: int) -> None:
        ref, named = self.index.insert(digest), doc is not None
        if ref == len(self.counts):
            self.counts.append(n)
            self.named.append(named)
            self.docs.append(doc or 0)
            self.rows.append(row)
            return
        self.counts[ref] += n
        if (named, doc or 0, row) > (self.named[ref], self.docs[ref], self.rows[ref]):
            self.named[ref], self.docs[ref], self.rows[ref] = named, doc or 0, row

    def batches(self, size: int = 10_000) -> Iterator[pa.RecordBatch]:
        keys, n = self.index.keys, len(self.counts)
        for at in range(0, n, size):
            part = range(at, min(at + size, n))
            docs = [self.docs[ref] if self.named[ref] else None for ref in part]
            digests = [bytes(keys[ref * BYTES : ref * BYTES + BYTES]) for ref in part]
            yield pa.RecordBatch.from_arrays(
                [pa.array(digests, pa.binary()), pa.array(docs, pa.int64()), pa.array(self.rows[at : part.stop], pa.int64()), pa.array(self.counts[at : part.stop], pa.int64())],
                ["digest", "keep_id", "keep_row", "group_size"],
            )


def _merged(most: int | None):
    """One row for each digest of a task, or, with most, for each digest among so many of the task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = _Groups()
        for batch in batches:
            for at in range(0, batch.num_rows, 10_000):
                for row in zip(*(c.to_pylist() for c in batch.slice(at, 10_000).columns), strict=True):
                    groups.add(*row)
                if most and len(groups.counts) >= most:
                    yield from groups.batches()
                    groups = _Groups()
        yield from groups.batches()

    return work


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of docs.

    Of equal texts the row with the largest doc_id stays (a null doc_id is the
    smallest); of rows equal in both, one. A null text counts as empty. Other
    columns of docs don't matter.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text_of(), 256)).alias("digest"), F.monotonically_increasing_id().alias("row"))
    rows = stored(rows, shared_folder(spark), "digests")
    local = rows.select("digest", "doc_id", "row", F.lit(1).cast("long").alias("n")).mapInArrow(_merged(LOCAL), GROUPS)
    # A count of its own, which adaptive execution leaves as it is: it bounds a task's index.
    tasks = partitions_for(rows.count(), MERGED, spark)
    groups = local.repartition(tasks, "digest").mapInArrow(_merged(None), GROUPS)
    return rows.join(groups, "digest").select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    What goes is listed by (doc_id, digest); the list grows with the corpus, so it
    is joined by a shuffle at any size.
    Rows that repeat both id and text are reduced to one in a step of their own,
    run only if there are any.
    """
    groups = stored(exact_groups(docs), shared_folder(docs.sparkSession), "groups").filter("NOT kept")
    old_id, old_digest, digest, row_id = fresh(docs, "_id", "_digest", "_text_digest", "_row_id")
    repeats = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    keys = [F.col("doc_id").alias(old_id), F.unhex("text_sha256").alias(old_digest)]
    gone, repeated = groups.filter(~repeats).select(*keys).distinct(), groups.filter(repeats).select(*keys).distinct()
    marked = docs.withColumns({digest: F.unhex(F.sha2(text_of(), 256)), row_id: F.col("doc_id").cast("long")})
    same = (F.col(digest) == F.col(old_digest)) & F.col(row_id).eqNullSafe(F.col(old_id))
    left = marked.join(gone.hint("merge"), same, "left_anti")
    if not repeated.isEmpty():
        several = left.join(repeated, same, "left_semi").dropDuplicates([row_id, digest])
        left = left.join(repeated, same, "left_anti").unionByName(several)
    return left.select(*docs.columns)
