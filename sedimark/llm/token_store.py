"""Token ids in files of directly addressable codes.

A file holds segments one after another; a segment holds whole documents. Each
id is split into chunks, lowest bits first. Level k has the k-th chunk of every
id that has one, a bitmap that tells which of them go on to level k+1, and a
rank directory with the number of set bits before each block of 512. Id number
i is read by following the bitmaps' ranks down the levels, without decoding
anything before it.

Segment: ``DAC1``, then unsigned 32-bit counts (ids, documents, levels) and for
each level its chunk bits and its codes; then document ids (int64), which of
these are null (uint8), the documents' first ids (uint32, one more than there
are documents), and for each level chunks, bitmap and directory. All of it is
little-endian.

Files go to the shared folder under names of their own for each attempt of a
task. The manifest, a table that Spark commits, names the segments that count,
so a lost executor or a task that runs twice leaves nothing that is read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimark.llm._common import open_filesystem, slices, stored, text_of
from sedimark.llm.word_tokens import encoder

BLOCK = 512
MANIFEST = "part int, segment int, path string, position long, bytes long, n_docs long, n_ids long"


def encode_segment(ids: np.ndarray, borders: np.ndarray, doc_ids: np.ndarray, nulls: np.ndarray, chunk_bits: tuple[int, ...] = (8, 8, 16)) -> bytes:
    """One segment; chunk_bits are multiples of 8 that add up to 32 at least."""
    levels, rest = [], ids.astype(np.uint32)
    for k, bits in enumerate(chunk_bits):
        more = rest >> np.uint32(bits) if bits < 32 else np.zeros_like(rest)
        go_on = more != 0
        if k == len(chunk_bits) - 1 and go_on.any():
            raise ValueError("chunk_bits are too few for these ids")
        bitmap = np.packbits(go_on, bitorder="little")
        blocks = np.add.reduceat(go_on, np.arange(0, len(go_on), BLOCK), dtype=np.uint32) if len(go_on) else np.zeros(0, np.uint32)
        rank = (np.cumsum(blocks) - blocks).astype("<u4")
        levels.append((bits, len(rest), (rest & np.uint32((1 << bits) - 1)).astype(f"<u{bits // 8}").tobytes(), bitmap.tobytes(), rank.tobytes()))
        rest = more[go_on]
        if not len(rest):
            break
    head = b"DAC1" + struct.pack("<3I", len(ids), len(doc_ids), len(levels)) + b"".join(struct.pack("<2I", bits, n) for bits, n, *_ in levels)
    parts = [head, doc_ids.astype("<i8").tobytes(), nulls.astype(np.uint8).tobytes(), borders.astype("<u4").tobytes()]
    return b"".join(parts + [x for _, _, *arrays in levels for x in arrays])


class Segment:
    """A segment read from a buffer; arrays are views of it."""

    def __init__(self, buffer):
        if bytes(buffer[:4]) != b"DAC1":
            raise ValueError("not a segment")
        self.n_ids, self.n_docs, n_levels = struct.unpack_from("<3I", buffer, 4)
        sizes = [struct.unpack_from("<2I", buffer, 16 + 8 * k) for k in range(n_levels)]
        at = 16 + 8 * n_levels

        def take(dtype: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(buffer, dtype=dtype, count=n, offset=at)
            at += got.nbytes
            return got

        self.doc_ids, self.nulls, self.borders = take("<i8", self.n_docs), take("u1", self.n_docs), take("<u4", self.n_docs + 1)
        self.levels = []
        for bits, n in sizes:
            chunks, bitmap, rank = take(f"<u{bits // 8}", n), take("u1", -(-n // 8)), take("<u4", -(-n // BLOCK))
            self.levels.append((bits, chunks, bitmap, rank))

    def token(self, i: int) -> int:
        """Id number i, by rank alone."""
        value = shift = 0
        for bits, chunks, bitmap, rank in self.levels:
            value |= int(chunks[i]) << shift
            if not bitmap[i >> 3] >> (i & 7) & 1:
                return value
            first = i // BLOCK * BLOCK
            inside = np.unpackbits(bitmap[first // 8 : i // 8 + 1], bitorder="little")[: i - first]
            i, shift = int(rank[i // BLOCK]) + int(inside.sum()), shift + bits
        raise ValueError("the last level goes on")

    def tokens(self) -> np.ndarray:
        """All the ids as unsigned 32-bit integers."""
        value, at, shift = np.zeros(self.n_ids, dtype=np.uint32), slice(None), 0
        for bits, chunks, bitmap, _ in self.levels:
            if shift:
                value[at] |= chunks.astype(np.uint32) << np.uint32(shift)
            else:
                value[:] = chunks
            go_on = np.unpackbits(bitmap, count=len(chunks), bitorder="little").view(bool)
            at = np.flatnonzero(go_on) if not shift else at[go_on]
            shift += bits
        return value

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        ids = self.tokens()
        for doc, null, a, b in zip(self.doc_ids.tolist(), self.nulls.tolist(), self.borders[:-1].tolist(), self.borders[1:].tolist(), strict=True):
            yield (None if null else doc), ids[a:b]


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, segment_ids: int = 1_000_000) -> DataFrame:
    """Encode doc_id and text, add end_id to each document, write files below folder.

    Documents are in ascending order of doc_id over all parts (null first, equal
    ids by checksum and text, so that one id's rows can be dealt out). Returns the manifest as a table in folder. A null text is
    empty and gives end_id alone.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, words = TaskContext.get().partitionId(), encoder(tokenizer)
        files, root = open_filesystem(f"{folder}/files")
        files.create_dir(root, recursive=True)
        path, rows, held, out = f"part-{part:06d}-{uuid.uuid4().hex}.dac", [], [], None
        end = np.array([end_id], dtype=np.int32)

        def flush() -> None:
            nonlocal out
            if out is None:
                out = files.open_output_stream(f"{root}/{path}")
            lengths = np.array([len(x) for _, x in held], dtype=np.int64)
            ids = np.concatenate([x for _, x in held])
            at = out.tell()
            body = encode_segment(ids, np.concatenate([[0], np.cumsum(lengths)]), np.array([d or 0 for d, _ in held]), np.array([d is None for d, _ in held]))
            out.write(body)
            rows.append((part, len(rows), f"{folder}/files/{path}", at, len(body), len(held), len(ids)))
            held.clear()

        size = 0
        for batch in slices(batches):
            for doc, ids in zip(batch.column(0).to_pylist(), words.encode(batch.column(1).to_pylist()), strict=True):
                if held and size + len(ids) + 1 > segment_ids:
                    flush()
                    size = 0
                held.append((doc, np.concatenate([ids, end])))
                size += len(ids) + 1
        if held:
            flush()
        if out is not None:
            out.close()
            names = [x.split()[0] for x in MANIFEST.split(", ")]
            types = [pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).withColumn("crc", F.crc32("text"))
    ordered = rows.repartitionByRange("doc_id", "crc").sortWithinPartitions("doc_id", "crc", "text").select("doc_id", "text")
    return stored(ordered.mapInArrow(write, MANIFEST), folder, "manifest")


class SegmentFile:
    """A segment in a file: ids by their numbers, from a few bytes each. read(position, length) gives bytes of the file."""

    def __init__(self, read, position: int):
        head = read(position, 16)
        if head[:4] != b"DAC1":
            raise ValueError("not a segment")
        self.read = read
        self.n_ids, n_docs, n_levels = struct.unpack_from("<3I", head, 4)
        raw = read(position + 16, 8 * n_levels)
        at, self.levels = position + 16 + 8 * n_levels + 9 * n_docs + 4 * (n_docs + 1), []
        for k in range(n_levels):
            bits, n = struct.unpack_from("<2I", raw, 8 * k)
            chunks, bitmap = at, at + n * bits // 8
            rank = bitmap + -(-n // 8)
            self.levels.append((bits, chunks, bitmap, rank))
            at = rank + 4 * -(-n // BLOCK)

    def token(self, i: int) -> int:
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = shift = 0
        for bits, chunks, bitmap, rank in self.levels:
            value |= int.from_bytes(self.read(chunks + i * bits // 8, bits // 8), "little") << shift
            shift += bits
            block, inside = divmod(i, BLOCK)
            marks = int.from_bytes(self.read(bitmap + block * BLOCK // 8, inside // 8 + 1), "little")
            if not marks >> inside & 1:
                break
            i = int.from_bytes(self.read(rank + 4 * block, 4), "little") + (marks & ((1 << inside) - 1)).bit_count()
        return value


def tokens_at(manifest: DataFrame, numbers: DataFrame, segment_ids: int = 1_000_000) -> DataFrame:
    """number and token for each row of numbers (a long column number): ids by their places in the whole store.

    A number beyond the store, below 0 or null has a null token. Segments and numbers
    meet in stretches of segment_ids, an equal join; a task reads a few bytes an id.
    """
    stretch = lambda c: F.floor(c / segment_ids).cast("long")
    last = F.col("start") + F.col("n_ids") - 1
    held = with_starts(manifest).select("path", "position", "start", last.alias("last"), F.explode(F.sequence(stretch(F.col("start")), stretch(last))).alias("stretch"))
    asked = numbers.select(F.col("number").cast("long").alias("number")).withColumn("stretch", stretch(F.col("number")))
    met = asked.join(held, "stretch").filter(F.col("number").between(F.col("start"), F.col("last"))).distinct()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for (path, position), rows in groupby(zip(*(batch.column(c).to_pylist() for c in ("path", "position", "number", "start")), strict=True), lambda r: r[:2]):
                files, name = open_filesystem(path)
                with files.open_input_file(name) as f:
                    segment = SegmentFile(lambda at, n, f=f: f.read_at(n, at), position)
                    found += [(number, segment.token(number - start)) for _, _, number, start in rows]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array([t for _, t in found], pa.int64())], ["number", "token"])

    tokens = met.select("path", "position", "number", "start").sortWithinPartitions("path", "position").mapInArrow(read, "number long, token long")
    return asked.select("number").join(tokens, "number", "left")


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with the number of ids before each segment.

    Parts are as many as the shuffle that ordered the documents had; their totals
    are what goes through the driver.
    """
    totals = manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    before, at = [], 0
    for row in totals:
        before.append((row["part"], at))
        at += row["n"]
    offsets = manifest.sparkSession.createDataFrame(before, "part int, before long")
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return manifest.join(offsets, "part").withColumn("start", F.col("before") + F.sum("n_ids").over(inside) - F.col("n_ids")).drop("before")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                files, path = open_filesystem(row["path"])
                with files.open_input_file(path) as f:
                    f.seek(row["position"])
                    segment = Segment(f.read(row["bytes"]))
                docs = [(d, len(ids), zlib.crc32(ids.tobytes())) for d, ids in segment.documents()]
                doc, n, crc = zip(*docs, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(row["start"] + segment.borders[:-1].astype(np.int64)), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = with_starts(manifest).repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
