"""Packing documents into training sequences by the sum-of-squares rule.

Each task packs the documents of its partition as they come, so nothing is
shuffled. A document longer than a window fills whole windows first. Its rest
goes where it makes the sum of N(h)^2 least, where N(h) is the number of open
windows filled to h: the level array holds N, full windows and new ones count
as nothing. What is open at the end of the partition is closed by cutting the
emptiest windows into the gaps of the fullest, so a partition leaves one window
with padding at most.

The rule itself needs the level array alone. Besides, the ids that wait in open
windows are held, two bytes each where the vocabulary allows it. That is less
than the texts of the partition even if nothing fits together (each rest more
than half a window), so Spark's partition size bounds it; windows are never
closed early.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.llm._common import slices, text_of
from sedimark.llm.word_tokens import encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long"
_NEVER = np.int64(1) << 60


class SumOfSquares:
    """An online packer. add() returns the windows that became full.

    A window is a list of pieces (document, start, length); finish() returns the
    rest, at most one of them not full.
    """

    def __init__(self, window: int):
        self.window = window
        self.levels = np.zeros(window + 1, dtype=np.int64)
        self.open: dict[int, list[list]] = defaultdict(list)

    def level_for(self, size: int) -> int:
        """The fill level to add size to; 0 opens a window. Ties go to the fullest."""
        top = self.window - size
        before = self.levels[: top + 1]
        cost = 2 * (self.levels[size:] - before) + 2
        cost[-1] -= 2 * self.levels[self.window] + 1
        cost[before == 0] = _NEVER
        cost[0] = 2 * self.levels[size] + 1 if top else 0
        return top - int(np.argmin(cost[::-1]))

    def add(self, document, size: int) -> list[list]:
        full = [[(document, at, self.window)] for at in range(0, size - self.window + 1, self.window)]
        rest = size % self.window
        if not rest:
            return full
        level = self.level_for(rest)
        pieces = self.open[level].pop() if level else []
        if level:
            self.levels[level] -= 1
        pieces.append((document, size - rest, rest))
        if level + rest == self.window:
            full.append(pieces)
        else:
            self._keep(level + rest, pieces)
        return full

    def _keep(self, level: int, pieces: list) -> None:
        self.open[level].append(pieces)
        self.levels[level] += 1

    def _close(self) -> list[list]:
        """Cut the emptiest open windows into the gaps of the fullest; keep what isn't full."""
        rest = [(level, pieces) for level in sorted(self.open) for pieces in self.open[level]]
        self.open.clear()
        self.levels[:] = 0
        full, first, donor = [], 0, []
        while first < len(rest):
            level, pieces = rest.pop()
            while level < self.window and (donor or first < len(rest)):
                if not donor:
                    donor = list(rest[first][1])
                    first += 1
                document, start, length = donor.pop()
                cut = min(length, self.window - level)
                pieces.append((document, start, cut))
                level += cut
                if cut < length:
                    donor.append((document, start + cut, length - cut))
            if level == self.window:
                full.append(pieces)
            else:
                self._keep(level, pieces)
        if donor:  # what the last donor still has
            self._keep(sum(x[2] for x in donor), donor)
        return full

    def finish(self) -> list[list]:
        full = self._close()
        return full + [pieces for level in self.open for pieces in self.open[level]]


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = 2048, memo_bytes: int = 128 << 20, keep_memo: bool = True) -> DataFrame:
    """Pieces of the documents' ids (with end_id added) in sequences of window ids.

    sequence_id is the partition's number times 2^32 plus the sequence's number
    there. padded_length is window, or the filled length itself where that is a
    power of two. A null text is empty and gives end_id alone; a null doc_id
    stays null; repeated rows are packed as often as they occur. Every id is in
    exactly one piece. Other columns don't matter. memo_bytes bounds the tokenizer's
    memo of a worker, which keeps it for its next task or (keep_memo false, where
    other work shares the workers) gives it back.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, words = TaskContext.get().partitionId() << 32, encoder(tokenizer, memo_bytes)
        waiting = np.uint16 if max(len(words.ends) - 1, end_id) < 1 << 16 else np.int32
        packer, end, rows, sequence = SumOfSquares(window), np.array([end_id], dtype=np.int32), [], 0

        def emit(windows: list[list]) -> None:
            """A piece is ((doc_id, ids, place of these ids in the document, all its ids' number), start, length)."""
            nonlocal sequence
            for pieces in windows:
                fill, offset = sum(x[2] for x in pieces), 0
                padded = fill if fill & (fill - 1) == 0 else window
                for (doc, ids, place, total), start, length in pieces:
                    rows.append((doc, place + start, length, zlib.crc32(ids[start : start + length].astype("<u4").tobytes()), total, base + sequence, offset, padded))
                    offset += length
                sequence += 1

        def batch_of() -> pa.RecordBatch:
            names = [x.split()[0] for x in PIECES.split(", ")]
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            made = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)
            rows.clear()
            return made

        for batch in slices(batches, 2000):
            for doc, ids in zip(batch.column(0).to_pylist(), words.encode(batch.column(1).to_pylist()), strict=True):
                ids = np.concatenate([ids, end])
                rest = len(ids) % window
                whole = len(ids) - rest
                emit([[((doc, ids, 0, len(ids)), at, window)] for at in range(0, whole, window)])
                if rest:  # what waits in an open window is a copy of the rest alone
                    emit(packer.add((doc, ids[whole:].astype(waiting), whole, len(ids)), rest))
            yield batch_of()
        if not keep_memo:
            words.forget()
        emit(packer.finish())
        yield batch_of()

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(packed, PIECES)
