"""SentencePiece BPE with seeded merge dropout, and lossless decoding.

A text gets a space in front, as the model asks for, and falls into units: spaces
and what follows them up to the next space. No piece of the model goes on after
a unit's end, so units are encoded one by one. A unit's agenda holds the adjacent
pairs that make a piece, best score first and then leftmost. A popped pair is
skipped where its coin falls; it comes back when a neighbour changes. The coin is
a hash of seed, doc_id, the unit's place in the text, the pair's place in the unit
and the piece it would make, so every occurrence of a unit has coins of its own.

Units of about the same length are taken together: their agendas are columns of an
array, and a step pops, skips or merges one pair in each. Long units have a heap.

Characters without a piece become byte pieces, and so does U+2581, the mark that
pieces use for a space; with dropout 0 all other texts give the library's ids.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.llm._common import mix64, ragged, text_of

PIECE_BPE = "piece_bpe_32k.model"
SPACE = "▁"
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
#: No symbol: after a unit's end, or merged into the one before.
_NONE = (1 << 21) - 1
_NEVER = np.int32(0x7FFFFFFF)
_COIN_BITS = 53


class PairTable:
    """(left, right) to the piece they make: an open hash table, looked up in arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, made: np.ndarray):
        bits = max(4, int(len(made) * 3).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.made = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, -1, dtype=np.int32)
        keys = left.astype(np.int64) << 21 | right
        slots = self._slots(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slots] < 0)
            taken, first = np.unique(slots[free], return_index=True)
            placed = free[first]
            self.keys[taken], self.made[taken] = keys[placed], made[placed]
            rest = np.ones(len(keys), dtype=bool)
            rest[placed] = False
            keys, made, slots = keys[rest], made[rest], (slots[rest] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * _SPREAD >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The pieces, -1 for pairs that make none."""
        keys = left.astype(np.int64) << 21 | right
        slots = self._slots(keys)
        seen = self.keys[slots]
        out = np.where(seen == keys, self.made[slots], np.int32(-1))
        far = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(far):
            slots[far] = (slots[far] + 1) & self.mask
            seen = self.keys[slots[far]]
            here = seen == keys[far]
            out[far[here]] = self.made[slots[far[here]]]
            far = far[~here & (seen >= 0)]
        return out


class PieceCodec:
    """Encodes and decodes with a SentencePiece BPE model."""

    def __init__(self, model: str, dropout: float = 0.1, seed: int = 7, columns: int = 4096, longest: int = 48):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        size, ids, out, scores = sp.get_piece_size(), {}, [], np.zeros(sp.get_piece_size())
        self.byte_ids = np.zeros(256, dtype=np.int32)
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[value := int(piece[1:-1], 16)] = i
                out.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                out.append(b"")
            else:
                ids[piece], scores[i] = i, sp.get_score(i)
                out.append(piece.replace(SPACE, " ").encode())
        if SPACE not in ids or any(SPACE in p.lstrip(SPACE) for p in ids):
            raise ValueError("the model has no mark for spaces alone, or a piece that goes on after one")
        self.ids, self.space = ids, ids[SPACE]
        self.symbols = np.full(0x110000, -1, dtype=np.int32)
        for piece, i in ids.items():
            if len(piece) == 1:
                self.symbols[ord(piece)] = i
        self.symbols[ord(SPACE)], self.symbols[ord(" ")] = -1, self.space
        pairs = [(ids[p[:cut]], ids[p[cut:]], i) for p, i in ids.items() for cut in range(1, len(p)) if p[:cut] in ids and p[cut:] in ids]
        self.pairs = PairTable(*(np.array(c, dtype=np.int32) for c in (zip(*pairs, strict=True) if pairs else ((), (), ()))))
        self.order = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        self.out_lengths = np.array([len(o) for o in out], dtype=np.int64)
        self.out_starts = np.cumsum(self.out_lengths) - self.out_lengths
        self.out_bytes = np.frombuffer(b"".join(out), dtype=np.uint8)
        self.limit, self.seed = np.uint64(int(dropout * (1 << _COIN_BITS))), np.uint64(seed)
        self.columns, self.longest = columns, longest

    def keys(self, doc_ids: np.ndarray, places: np.ndarray) -> np.ndarray:
        """One key for each occurrence of a unit."""
        return mix64(places.astype(np.uint64) + mix64(self.seed ^ mix64(doc_ids.astype(np.int64).view(np.uint64))))

    def skips(self, keys: np.ndarray, places: np.ndarray, pieces: np.ndarray) -> np.ndarray:
        """Whether the coins of pairs fall: by the unit's key, the pair's place and the piece it would make."""
        pair = (places.astype(np.uint64) << np.uint64(21)) + pieces.astype(np.uint64) + np.uint64(1)
        return mix64(keys + pair * _STEP) >> np.uint64(64 - _COIN_BITS) < self.limit

    def together(self, symbols: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """symbols with units as columns (_NONE below their ends), after all merges."""
        width, n = symbols.shape
        bits, done = width.bit_length(), symbols
        # The last row is the neighbour of those that have none.
        sym = np.concatenate([symbols, np.full((1, n), _NONE, dtype=np.int32)])
        after = np.minimum(np.repeat(np.arange(1, width + 2)[:, None], n, axis=1), width)
        after[:-1][np.concatenate([sym[1:-1] == _NONE, np.ones((1, n), bool)])] = width
        before = np.repeat(np.concatenate([[width], np.arange(width)])[:, None], n, axis=1)
        makes = np.full((width + 1, n), -1, dtype=np.int32)
        makes[:-1] = self.pairs.get(sym[:-1].ravel(), sym[1:].ravel()).reshape(width, n)
        turn = np.where(makes >= 0, self.order[makes] << bits | np.arange(width + 1, dtype=np.int32)[:, None], _NEVER)
        left = np.arange(n)
        while True:
            best = turn.min(axis=0)
            live = np.flatnonzero(best != _NEVER)
            if len(live) < 0.7 * len(left):
                done[:, left] = sym[:-1]
                left, keys, best = left[live], keys[live], best[live]
                sym, after, before, makes, turn = (np.ascontiguousarray(a[:, live]) for a in (sym, after, before, makes, turn))
                live = np.arange(len(left))
            if not len(live):
                break
            n = len(left)
            flat_sym, flat_after, flat_before, flat_makes, flat_turn = (a.reshape(-1) for a in (sym, after, before, makes, turn))
            at = (best[live] & ((1 << bits) - 1)).astype(np.int64)
            here = at * n + live
            piece = flat_makes[here]
            flat_turn[here] = _NEVER
            merged = ~self.skips(keys[live], at, piece)
            live, at, here, piece = live[merged], at[merged], here[merged], piece[merged]
            gone = flat_after[here] * n + live
            right, previous = flat_after[gone], flat_before[here]
            flat_sym[here], flat_sym[gone], flat_turn[gone], flat_after[here] = piece, _NONE, _NEVER, right
            right_at, previous_at = right * n + live, previous * n + live
            flat_before[right_at] = at
            changed, place = np.concatenate([here, previous_at]), np.concatenate([at, previous]).astype(np.int32)
            new = self.pairs.get(np.concatenate([piece, flat_sym[previous_at]]), np.concatenate([flat_sym[right_at], piece]))
            flat_makes[changed] = new
            flat_turn[changed] = np.where(new >= 0, self.order[new] << bits | place, _NEVER)
        return done

    def alone(self, symbols: list[int], key: int) -> list[int]:
        """The same for one unit, with its agenda as a heap."""
        n, agenda, symbols = len(symbols), [], list(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def propose(places: list[int]) -> None:
            made = self.pairs.get(np.array([symbols[i] for i in places], dtype=np.int64), np.array([symbols[after[i]] for i in places], dtype=np.int64))
            for i, piece in zip(places, made.tolist(), strict=True):
                if piece >= 0:
                    coin = self.skips(np.array([key], dtype=np.uint64), np.array([i]), np.array([piece]))[0]
                    heapq.heappush(agenda, (int(self.order[piece]), i, piece, symbols[i], symbols[after[i]], bool(coin)))

        propose(list(range(n - 1)))
        while agenda:
            _, i, piece, a, b, skipped = heapq.heappop(agenda)
            j = after[i]
            if skipped or j >= n or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], symbols[j], after[i] = piece, _NONE, after[j]
            if after[i] < n:
                before[after[i]] = i
            propose([k for k in (i, before[i]) if k >= 0 and after[k] < n])
        return [s for s in symbols if s != _NONE]

    def _symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The first symbols of the texts, each with a space in front, and the texts' borders."""
        spaced = [" " + t if t else "" for t in texts]
        points = np.frombuffer("".join(spaced).encode("utf-32-le"), dtype="<u4")
        borders = np.concatenate([[0], np.cumsum([len(t) for t in spaced], dtype=np.int64)])
        symbols = self.symbols[points]
        odd = np.flatnonzero(symbols < 0)
        if len(odd):
            raw = [chr(p).encode() for p in points[odd].tolist()]
            counts = np.ones(len(symbols), dtype=np.int64)
            counts[odd] = [len(r) for r in raw]
            moved = np.concatenate([[0], np.cumsum(counts)])
            symbols = np.repeat(symbols, counts)
            symbols[symbols < 0] = self.byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)]
            borders = moved[borders]
        return symbols, borders

    def encode_all(self, texts: list[str], doc_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and the borders between texts. An empty text has none."""
        symbols, borders = self._symbols(texts)
        if not len(symbols):
            return symbols, borders
        space = symbols == self.space
        opens = space.copy()
        opens[1:] &= ~space[:-1]
        opens[borders[:-1][borders[:-1] < borders[1:]]] = True
        starts = np.flatnonzero(opens)
        lengths = np.diff(starts, append=len(symbols))
        first = np.searchsorted(starts, borders)  # each text's first unit
        counts = np.diff(first)
        places = np.arange(len(starts)) - np.repeat(first[:-1], counts)
        keys = self.keys(np.repeat(doc_ids, counts), places)
        by_length = np.argsort(lengths, kind="stable")
        short = int(np.searchsorted(lengths[by_length], self.longest, "right"))
        made, sizes = [], np.zeros(len(starts), dtype=np.int64)
        for at in range(0, short, self.columns):
            units = by_length[at : min(at + self.columns, short)]
            row = np.arange(lengths[units[-1]])[:, None]
            inside = row < lengths[units]
            column = np.where(inside, symbols[np.where(inside, starts[units] + row, 0)], np.int32(_NONE))
            merged = self.together(column, keys[units]).T
            kept = merged != _NONE
            sizes[units] = kept.sum(axis=1)
            made.append(merged[kept])
        for unit in by_length[short:].tolist():
            ids = self.alone(symbols[starts[unit] : starts[unit] + lengths[unit]].tolist(), int(keys[unit]))
            sizes[unit] = len(ids)
            made.append(np.array(ids, dtype=np.int32))
        found = np.zeros(len(starts), dtype=np.int64)
        found[by_length] = np.cumsum(sizes[by_length]) - sizes[by_length]
        ids = np.concatenate(made)[ragged(found, sizes)]
        return ids, np.concatenate([[0], np.cumsum(sizes)])[first]

    def encode(self, text: str, doc_id: int = 0) -> list[int]:
        return self.encode_all([text], np.array([doc_id]))[0].tolist()

    def decode_all(self, ids: np.ndarray, borders: np.ndarray) -> list[str]:
        lengths = self.out_lengths[ids]
        raw = self.out_bytes[ragged(self.out_starts[ids], lengths)].tobytes()
        ends = np.concatenate([[0], np.cumsum(lengths)])[borders].tolist()
        return [raw[a:b].decode("utf-8", "replace")[1:] for a, b in zip(ends, ends[1:], strict=False)]

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(np.array(ids, dtype=np.int64), np.array([0, len(ids)]))[0]


_CODECS: dict[tuple, PieceCodec] = {}


def codec(*parameters) -> PieceCodec:
    """One codec for each set of parameters and worker process: tables of the model alone, which don't grow."""
    if parameters not in _CODECS:
        _CODECS[parameters] = PieceCodec(*parameters)
    return _CODECS[parameters]


def _groups(batch: pa.RecordBatch, chars: int = 300_000) -> Iterator[tuple[int, list[str], np.ndarray]]:
    """(first row, texts, doc_ids) of stretches of a batch of (doc_id, text)."""
    ids, texts, size, begin = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), [], 0, 0
    for row, text in enumerate(batch.column(1)):
        texts.append(text.as_py())
        size += len(texts[-1])
        if size >= chars or row == batch.num_rows - 1:
            yield begin, texts, ids[begin : row + 1]
            texts, size, begin = [], 0, row + 1


def encode_documents(docs: DataFrame, model: str, dropout: float = 0.1, seed: int = 7) -> DataFrame:
    """doc_id and ids (array of int) of every row. A null text is empty and has no ids; a null doc_id hashes as 0."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = codec(model, dropout, seed)
        for batch in batches:
            for begin, texts, doc_ids in _groups(batch):
                ids, borders = pieces.encode_all(texts, doc_ids)
                arrays = pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(texts)), arrays], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(work, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows with ids; null ids give a null text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = codec(model).decode
        for batch in batches:
            texts = [None if ids is None else decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str, dropout: float = 0.1, seed: int = 7) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 and lossless (whether decoding gives the text) of every row.

    A null text is empty and has no ids; rows with a null doc_id have the coins
    of id 0; repeated rows give the same ids. Other columns don't matter.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = codec(model, dropout, seed)
        for batch in batches:
            for begin, texts, doc_ids in _groups(batch):
                ids, borders = pieces.encode_all(texts, doc_ids)
                back, raw, ends = pieces.decode_all(ids, borders), ids.astype("<i4").tobytes(), (borders * 4).tolist()
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
                same = [a == b for a, b in zip(texts, back, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, len(texts)), pa.array(np.diff(borders), pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())],
                    ["doc_id", "n_tokens", "ids_crc32", "lossless"],
                )

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(work, "doc_id long, n_tokens long, ids_crc32 long, lossless boolean")
