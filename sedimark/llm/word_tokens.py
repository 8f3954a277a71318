"""Token ids of whole texts by a public tokenizer file, with memoised words.

The tokenizer drops white space, and none of its patterns spans white space, so
a text's ids are those of its white-space-separated chunks one after another.
Distinct chunks go through the library, as far as a memo of bounded bytes
reaches, and a text is then a gather over the ids of its chunks. A chunk that is a plain Latin word
with plain ASCII punctuation after it is split further into those two, which
the tokenizer's own pattern does as well. Texts with control characters that
Python takes for white space and the tokenizer doesn't are encoded whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np

from sedimark.llm._common import ragged

WORD_BPE = "word_bpe_49k.json"

_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!#$%&*,.:;?@|~-]*)").fullmatch
_CONTROL = re.compile("[\x1c-\x1f]").search
_ENCODERS: dict[tuple, WordEncoder] = {}
#: About what an entry of the memo takes besides its characters.
_ENTRY = 200


class _Grown:
    """An array that is appended to again and again."""

    def __init__(self, dtype):
        self.data, self.size = np.zeros(1024, dtype=dtype), 0

    def extend(self, values: np.ndarray) -> None:
        if self.size + len(values) > len(self.data):
            self.data = np.concatenate([self.data[: self.size], values, np.zeros(self.size + len(values), self.data.dtype)])
        else:
            self.data[self.size : self.size + len(values)] = values
        self.size += len(values)


class _Chunks(dict):
    """Chunk to its number; chunks asked for the first time are noted as new."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        n = self[chunk] = len(self)
        self.new.append(chunk)
        return n


class WordEncoder:
    """Encodes texts with a tokenizers file.

    memo_bytes bounds what the memo holds, by an estimate of _ENTRY bytes and the
    characters of each chunk and word; a full one is started anew. A tokenizer whose patterns could span white
    space, or that keeps case (plain words are lowered here), is refused.
    """

    def __init__(self, path: str, memo_bytes: int = 128 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._check()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
        self.memo_bytes = memo_bytes
        self.forget()

    def _check(self) -> None:
        """What this class takes for granted, tried on texts that would show otherwise."""
        whole = lambda *texts: [i for t in texts for i in self.tokenizer.encode(t, add_special_tokens=False).ids]
        parts = ["The", "a", "x,", "don't", "(12", "é", "...", "日本", "a-b"]
        for gap in (" ", "  ", "\n", "\t ", "\u00a0", "\u3000"):
            if whole(gap.join(parts)) != whole(*parts) or whole(f"{gap}a{gap}") != whole("a"):
                raise ValueError("a pattern of this tokenizer spans white space")
        if whole("The") != whole("the") or whole("x,") != whole("x", ","):
            raise ValueError("this tokenizer keeps case, or words and punctuation together")

    def forget(self) -> None:
        """Start the memo anew."""
        self.held, self.chunks = 0, _Chunks()
        self.starts, self.lengths, self.flat = _Grown(np.int64), _Grown(np.int64), _Grown(np.int32)
        self.words: dict[str, bytes] = {"": b""}  # ids as bytes: nothing for the garbage collector to walk

    def _encode_words(self, words: list[str]) -> None:
        """Plain words and plain punctuation: each is one pre-token, so its last id ends a word."""
        self.held += len(words) * _ENTRY + sum(map(len, words))
        for at in range(0, len(words), 4000):
            part = words[at : at + 4000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype=np.int32)
            borders = np.flatnonzero(self.ends[ids]) + 1
            if len(borders) == len(part):
                raw = ids.tobytes()
                begin = 0
                for word, end in zip(part, (borders * 4).tolist(), strict=True):
                    self.words[word] = raw[begin:end]
                    begin = end
            else:  # a tokenizer without word-end tokens
                for word, got in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                    self.words[word] = np.array(got.ids, dtype=np.int32).tobytes()

    def _learn(self) -> None:
        """Encode the chunks that weren't seen before."""
        new = self.chunks.new
        self.held += len(new) * _ENTRY + sum(map(len, new))
        split = [(m[1].lower(), m[2]) if (m := _PLAIN(c)) else None for c in new]
        words = self.words
        self._encode_words(list(dict.fromkeys(w for p in split if p for w in p if w not in words)))
        odd = [c for c, p in zip(new, split, strict=True) if p is None]
        whole = iter(self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)) if odd else iter(())
        ids = [words[p[0]] + words[p[1]] if p else np.array(next(whole).ids, dtype=np.int32).tobytes() for p in split]
        lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        self.starts.extend(self.flat.size + np.cumsum(lengths) - lengths)
        self.lengths.extend(lengths)
        self.flat.extend(np.frombuffer(b"".join(ids), dtype=np.int32))
        self.chunks.new = []

    def _encode_group(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all the texts together, and the borders between texts."""
        if self.held > self.memo_bytes:
            self.forget()
        number = self.chunks.__getitem__
        per_text = [np.fromiter(map(number, words := t.split()), dtype=np.int64, count=len(words)) for t in texts]
        if self.chunks.new:
            self._learn()
        chunk = np.concatenate(per_text)
        lengths = self.lengths.data[chunk]
        ids = self.flat.data[ragged(self.starts.data[chunk], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        counts = np.fromiter(map(len, per_text), dtype=np.int64, count=len(per_text))
        return ids, ends[np.concatenate([[0], np.cumsum(counts)])]

    def encode(self, texts: Iterable[str | None], group_chars: int = 300_000) -> Iterator[np.ndarray]:
        """The ids of each text, in order, as int32 arrays; a null text has none."""
        group: list[str] = []
        size = 0
        for text in texts:
            text = text or ""
            if _CONTROL(text):
                yield from self._arrays(group)
                group, size = [], 0
                yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.int32)
                continue
            group.append(text)
            size += len(text)
            if size >= group_chars:
                yield from self._arrays(group)
                group, size = [], 0
        yield from self._arrays(group)

    def _arrays(self, group: list[str]) -> Iterator[np.ndarray]:
        if group:
            ids, borders = self._encode_group(group)
            for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
                yield ids[a:b]


def encoder(path: str, memo_bytes: int = 128 << 20) -> WordEncoder:
    """One encoder for each file and worker process, kept between tasks with its bounded memo."""
    if (path, memo_bytes) not in _ENCODERS:
        _ENCODERS[path, memo_bytes] = WordEncoder(path, memo_bytes)
    return _ENCODERS[path, memo_bytes]


def tokenizer_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
