"""Near duplicates by SuperMinHash, banding, verification on full sets and union-find.

1. Every text becomes a set of hashed word shingles, a digest of the set, and
   band keys of its SuperMinHash signature. Only these are written, not the sets.
2. Texts with equal sets are one class from here on, so copies cost nothing more.
3. Classes that share a band key are tied to the smallest class there: a row for
   each class and key, never pairs. Connected, they form families, which hold all
   candidate links.
4. A family's texts meet in one task, which rebuilds the full sets and searches
   breadth first: each class taken is compared with all that aren't reached yet and
   share one of its rarest shingles, so every link between different components is
   tested and links inside one needn't be. A family with more shingles than a block
   is dealt in blocks of about as many shingles each, and each pair of blocks is a
   task; the links found are connected once more. No family is cut short.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.llm._common import fresh, mix64, ragged, runs, shared_folder, stored, text_of
from sedimark.llm.components import connected_components

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class NearRules:
    """Documents are linked at 100 * intersection >= percent * union of their sets."""

    shingle: int = 5
    percent: int = 80
    bands: int = 42
    rows: int = 6
    #: Shingles of a block of a large family: a sixteenth of its own, between these bounds.
    least_block: int = 20_000
    most_block: int = 400_000

    def __post_init__(self):
        if not (1 <= self.bands * self.rows <= 256 and self.shingle >= 1 and 0 < self.percent <= 100 and 1 <= self.least_block <= self.most_block):
            raise ValueError("a signature has 256 values at most, and the other rules are positive")


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


class Shingles:
    """Texts (UTF-8) to sorted arrays of distinct shingle hashes.

    A-Z is lowered; words are runs of anything but ASCII white space. A text with
    fewer words than a shingle has is one shingle; one without words has none.
    """

    def __init__(self, size: int, memo: int = 200_000):
        self.size, self.memo = size, memo
        self.factors = mix64(np.arange(1, size + 1, dtype=np.uint64) * GOLDEN) | np.uint64(1)
        self.words = _WordHashes()

    def of(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        n = len(words)
        if not n:
            return np.zeros(0, dtype=np.uint64)
        if len(self.words) > self.memo:
            self.words.clear()
        hashes = np.fromiter(map(self.words.__getitem__, words), dtype=np.uint64, count=n)
        if n < self.size:
            return mix64((hashes * self.factors[:n]).sum(keepdims=True) + np.uint64(n))
        last = n - self.size + 1
        mixed = hashes[:last] * self.factors[0]
        for k in range(1, self.size):
            mixed += hashes[k : k + last] * self.factors[k]
        return np.unique(mix64(mixed))


def super_min_hash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """The SuperMinHash signatures (m unsigned 32-bit values each) of non-empty sets.

    Element x gives slot p(j) the value j + r for j = 0, 1, ..., where p is the
    element's own random permutation, built by swaps as far as needed, and r is
    uniform below 1 (24 bits here, j above them). A set is done when no slot has
    a value of j or more. All sets take step j together.
    """
    counts = np.array([len(s) for s in sets], dtype=np.int64)
    elements = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), counts)
    best = np.full(len(sets) * m, 0xFFFFFFFF, dtype=np.uint32)
    first = permutation = None
    for j in range(m):
        z = mix64(elements + np.uint64((j + 1) * int(GOLDEN) & 0xFFFFFFFFFFFFFFFF))
        k = j + ((z & np.uint64(0xFFFFFFFF)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        if j == 0:
            slot = first = k
        elif j == 1:
            slot = np.where(k == first, 0, k)
            second = k
        else:
            here = np.arange(len(elements))
            if permutation is None:
                permutation = np.tile(np.arange(m, dtype=np.uint16 if m > 256 else np.uint8), (len(elements), 1))
                permutation[here, first], permutation[:, 0] = 0, first
                moved = permutation[:, 1].copy()
                permutation[:, 1] = permutation[here, second]
                permutation[here, second] = moved
            moved = permutation[here, k]
            permutation[here, k] = permutation[:, j]
            permutation[:, j] = moved
            slot = moved.astype(np.int64)
        np.minimum.at(best, owner * m + slot, np.uint32(j << 24) | (z >> np.uint64(40)).astype(np.uint32))
        still = best.reshape(-1, m).max(axis=1) >= np.uint32(j + 1 << 24) if j < 255 else np.zeros(len(sets), bool)
        if not still.any():
            break
        stays = still[owner]
        if not stays.all():
            elements, owner = elements[stays], owner[stays]
            if j == 0:
                first = first[stays]
            elif permutation is None:
                first, second = first[stays], second[stays]
            else:
                permutation = permutation[stays]
    return best.reshape(-1, m)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    factors = mix64(np.arange(1, bands * rows + 1, dtype=np.uint64) * GOLDEN).reshape(bands, rows) | np.uint64(1)
    mixed = (signatures.reshape(len(signatures), bands, rows).astype(np.uint64) * factors).sum(axis=2, dtype=np.uint64)
    return mix64(mixed + np.arange(bands, dtype=np.uint64) * GOLDEN).view(np.int64)


SIGNED = "doc_id long, n_shingles long, digest binary, bands array<long>"


def signed(docs: DataFrame, rules: NearRules, group: int = 100_000) -> DataFrame:
    """doc_id, n_shingles, digest of the set and band keys; null and none for empty sets."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingles, m = Shingles(rules.shingle), rules.bands * rules.rows

        def made(ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
            full = [s for s in sets if len(s)]
            keys = iter(band_keys(super_min_hash(full, m), rules.bands, rules.rows) if full else ())
            bands = pa.array([next(keys) if len(s) else np.zeros(0, np.int64) for s in sets], pa.list_(pa.int64()))
            digests = pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), digests, bands], ["doc_id", "n_shingles", "digest", "bands"])

        ids, sets, size = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc)
                sets.append(shingles.of(text.as_py()))
                size += len(sets[-1])
                if size >= group or len(ids) >= 2000:
                    yield made(ids, sets)
                    ids, sets, size = [], [], 0
        if ids:
            yield made(ids, sets)

    return docs.select(F.col("doc_id").cast("long"), text_of().cast("binary").alias("text")).mapInArrow(work, SIGNED)


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the number of the first one of its component, breadth first.

    Two sets that are linked share one of the |a| - ceil(percent |a| / 100) + 1
    rarest elements of either, so only these are indexed; who shares one and is of
    a size that can do is compared in full.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    starts, owners = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
    _, codes, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rarity = np.empty(len(counts), dtype=np.int32)
    rarity[np.argsort(counts, kind="stable")] = np.arange(len(counts), dtype=np.int32)
    codes = rarity[codes]
    codes = codes[np.lexsort((codes, owners))]
    prefix = sizes + (-percent * sizes) // 100 + 1
    indexed = ragged(starts, prefix)
    by = np.argsort(codes[indexed], kind="stable")
    postings, n_postings = owners[indexed][by], np.bincount(codes[indexed], minlength=len(counts))
    first = np.cumsum(n_postings) - n_postings
    marks, root, left = np.zeros(len(counts), dtype=bool), np.full(len(sets), -1), len(sets)
    for seed in range(len(sets)):
        if not left:
            break
        if root[seed] >= 0:
            continue
        root[seed], queue, left = seed, [seed], left - 1
        while queue and left:
            taken = queue.pop()
            own = codes[starts[taken] : starts[taken] + sizes[taken]]
            rare = own[: prefix[taken]]
            met = postings[ragged(first[rare], n_postings[rare])]
            met = np.unique(met[root[met] < 0])
            met = met[100 * np.minimum(sizes[met], sizes[taken]) >= percent * np.maximum(sizes[met], sizes[taken])]
            if not len(met):
                continue
            marks[own] = True
            lengths = sizes[met]
            common = np.add.reduceat(marks[codes[ragged(starts[met], lengths)]], np.cumsum(lengths) - lengths, dtype=np.int64)
            marks[own] = False
            near = met[100 * common >= percent * (lengths + sizes[taken] - common)]
            root[near] = seed
            left -= len(near)
            queue += near.tolist()
    return root


def _verified(members: DataFrame, rules: NearRules) -> DataFrame:
    """a and b for classes of one component, over rows of (family, i, j, node, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, found = Shingles(rules.shingle), []

        def made() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.bool_())], ["a", "b", "split"])
            found.clear()
            return batch

        for group in runs(batches, ["family", "i", "j"]):
            nodes = group.column("node").to_pylist()
            order = sorted(range(len(nodes)), key=nodes.__getitem__)
            texts, split = group.column("text"), group.column("j")[0].as_py() > 0
            pairs = [(nodes[k], s) for k in order if len(s := shingles.of(texts[k].as_py()))]
            root = linked([s for _, s in pairs], rules.percent) if len(pairs) > 1 else []
            found += [(pairs[k][0], pairs[r][0], split) for k, r in enumerate(root) if pairs[k][0] != pairs[r][0]]
            if len(found) >= 10_000:
                yield made()
        yield made()

    return members.mapInArrow(work, "a long, b long, split boolean")


def near_components(docs: DataFrame, rules: NearRules | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs.

    component_id is the smallest doc_id that links lead to, its own included. Rows
    without words or with a null text are linked with nothing. A null doc_id takes
    no part: component_id null, kept true. Rows that repeat a doc_id are one node
    with all their texts' links.
    """
    rules, spark = rules or NearRules(), docs.sparkSession
    folder = shared_folder(spark)
    rows = stored(signed(docs, rules), folder, "signed")
    classes = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("mass"), F.first("bands").alias("bands"))
    classes = stored(classes, folder, "classes")
    keyed = classes.select("node", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("node").alias("center"), F.max("node").alias("last")).filter("center < last").select("key", "center")
    tied = keyed.join(buckets, "key").filter("node <> center").select(F.col("node").alias("a"), F.col("center").alias("b"))
    families = stored(connected_components(tied, folder, "tied"), folder, "families")
    families = families.unionByName(families.select(F.col("component").alias("node"), "component").distinct())

    weighed = families.hint("merge").join(classes.select("node", "mass"), "node")
    masses = weighed.groupBy("component").agg(F.sum("mass").alias("family_mass"))
    block = F.greatest(F.lit(rules.least_block), F.least(F.lit(rules.most_block), F.ceil(F.col("family_mass") / 16)))
    parts = F.when(F.col("family_mass") <= 2 * block, 1).otherwise(F.ceil(F.col("family_mass") / block))
    dealt = families.join(masses.select("component", parts.cast("int").alias("parts")), "component").withColumn("x", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("y", F.explode(F.expr("CASE WHEN parts = 1 THEN array(0) ELSE filter(sequence(0, parts - 1), y -> y <> x) END")))
    dealt = dealt.select("node", F.col("component").alias("family"), F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"))
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), text_of().cast("binary").alias("text"))
    members = dealt.hint("merge").join(texts, "node").select(  # members grow with the corpus: one plan, never a broadcast
        "family", "i", "j", "node", "text"
    )
    members = members.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")
    links = stored(_verified(members, rules), folder, "links")
    again = connected_components(links.filter("split").select("a", "b"), folder, "links-star")
    found = links.filter("NOT split").select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(again)

    named = classes.select("digest", "node").join(found.groupBy("node").agg(F.min("component").alias("component")), "node", "left")
    named = named.select("digest", F.coalesce("component", "node").alias("component"))
    joined = rows.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, rules: NearRules | None = None) -> DataFrame:
    """The rows of docs that stay: one document of each component, with all columns."""
    (old,) = fresh(docs, "_gone")
    gone = near_components(docs, rules).filter("NOT kept").select(F.col("doc_id").alias(old)).distinct()
    return docs.join(gone.hint("merge"), F.col("doc_id").cast("long") == F.col(old), "left_anti")
