"""Secrets in texts: three fixed forms, and stretches of high entropy.

Candidates are runs of one character class: hexadecimal (also behind 0x), lower-
or upper-case letters with digits, and base-64. What an allow-list pattern matches
is cut out of a run, so that only windows that overlap the match are suppressed.
A window slides over what is left; its Shannon entropy is kept by the change in
sum(c * log2 c) when a character enters or leaves, so a step costs the same for any
window. Windows at or above the class's threshold are joined to spans. A stretch
shorter than the window, but not than the class's least, is one window of its own
length, with the threshold in the ratio of the lengths' logarithms. A stretch
without the mix of letters and digits that keys have is passed over. The fixed
forms are never suppressed.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.llm._common import slices, text_of

#: The three forms.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # the leftmost run of 16 or more starts where its whole run does
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64", "entropy_lower", "entropy_upper")


@dataclass(frozen=True)
class EntropyClass:
    """A character class: pattern's first group (or all of it) is a run; window and least in characters, threshold in bits."""

    kind: str
    pattern: str
    window: int
    threshold: float
    mixed: str = r"(?=.*[0-9])(?=.*[A-Za-z])"
    least: int = 16


@dataclass(frozen=True)
class ScanRules:
    classes: tuple[EntropyClass, ...] = (
        EntropyClass("entropy_hex", r"(?<![0-9A-Za-z])(?:0[xX])?([0-9a-fA-F]{16,})(?![0-9A-Za-z])", 24, 3.0),
        EntropyClass("entropy_base64", r"[A-Za-z0-9+/_=-]{20,}", 24, 3.9, r"(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])", 20),
        EntropyClass("entropy_lower", r"(?<![0-9A-Za-z])[a-z0-9]{16,}(?![0-9A-Za-z])", 24, 3.6, r"(?=(?:.*?[0-9][a-z]){2})(?=.*[g-z])"),
        EntropyClass("entropy_upper", r"(?<![0-9A-Za-z])[A-Z0-9]{16,}(?![0-9A-Za-z])", 24, 3.6, r"(?=(?:.*?[0-9][A-Z]){2})(?=.*[G-Z])"),
    )
    #: What is no secret wherever it stands in a run: UUIDs, placeholders, alphabets.
    allow: tuple[str, ...] = field(default=(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", r"(?i)example|placeholder|changeme|x{6,}|0{8,}", r"(?i)abcdefgh|0123456789abcdef|0123456789"))


def entropy_spans(candidate: str, window: int, threshold: float) -> list[tuple[int, int]]:
    """Joined windows of candidate with at least threshold bits a character."""
    if len(candidate) < window:
        return []
    term = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    least = window * (math.log2(window) - threshold) + 1e-9  # H = log2 w - sum(c log2 c) / w
    counts: dict[str, int] = {}
    total, spans = 0.0, []
    for at, char in enumerate(candidate):
        c = counts.get(char, 0)
        counts[char] = c + 1
        total += term[c + 1] - term[c]
        if at >= window:
            old = candidate[at - window]
            c = counts[old]
            counts[old] = c - 1
            total += term[c - 1] - term[c]
        if at >= window - 1 and total <= least:
            start = at - window + 1
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], at + 1)
            else:
                spans.append((start, at + 1))
    return spans


class Scanner:
    def __init__(self, rules: ScanRules):
        self.classes = [(c, re.compile(c.pattern), re.compile(c.mixed, re.DOTALL)) for c in rules.classes]
        self.allow = [re.compile(p) for p in rules.allow]

    def base(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) of the fixed forms, by start and then kind as listed."""
        found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
        if "AKIA" in text:
            found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
        found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
        return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))

    def added(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) of high entropy."""
        found = []
        for c, pattern, mixed in self.classes:
            for m in pattern.finditer(text):
                begin, end = m.span(1 if pattern.groups else 0)
                if end - begin < c.least or not mixed.match(text[begin:end]):
                    continue
                for a, b in self._left(text, begin, end):
                    part = text[a:b]
                    if b - a >= c.least and mixed.match(part):
                        window = min(c.window, b - a)
                        threshold = c.threshold * math.log2(window) / math.log2(c.window)
                        found += [(a + x, a + y, c.kind) for x, y in entropy_spans(part, window, threshold)]
        return found

    def _left(self, text: str, begin: int, end: int) -> list[tuple[int, int]]:
        """The stretches of a run that no allow-list pattern matches."""
        left, at = [], begin
        for a, b in sorted(m.span() for p in self.allow for m in p.finditer(text, begin, end)):
            if a > at:
                left.append((at, a))
            at = max(at, b)
        return [*left, (at, end)] if at < end else left

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        return sorted(self.base(text) + self.added(text), key=lambda s: (s[0], KINDS.index(s[2]) if s[2] in KINDS else len(KINDS), s[2]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """text with each stretch that spans cover replaced by mark."""
    out, at, end = [], 0, -1
    for a, b, _ in spans:
        if a >= end:
            out += [text[at:a], mark]
        end = max(end, b)
        at = end
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, rules: ScanRules | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row.

    A null text is empty and has no span; its base_sha256 is that of the empty
    string. Ids may be null or repeat; rows are looked at one by one.
    """
    rules = rules or ScanRules()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in slices(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                base = scanner.base(text)
                kinds = [k for *_, k in base]
                rows.append((*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + scanner.added(text), key=lambda s: (s[0], KINDS.index(s[2]))))))
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [*[pa.int64()] * 3, *[pa.string()] * 2], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(work, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(docs: DataFrame, rules: ScanRules | None = None) -> DataFrame:
    """docs with secrets in text replaced; n_chars, if there is one, follows. A null text stays null."""
    rules, columns = rules or ScanRules(), docs.columns
    at = columns.index("text")
    length = columns.index("n_chars") if "n_chars" in columns else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in slices(batches):
            old = batch.column(at).to_pylist()
            new = [t and redact(t, scanner.spans(t)) for t in old]
            arrays = list(batch.columns)
            arrays[at] = pa.array(new, batch.schema.field(at).type)
            if length is not None:
                kept = arrays[length].to_pylist()
                arrays[length] = pa.array([n if a == b else len(b) for a, b, n in zip(old, new, kept, strict=True)], batch.schema.field(length).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return docs.mapInArrow(work, docs.schema)
