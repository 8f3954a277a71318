"""A quality score by a generalised additive model with pairwise interactions.

Texts are described by a dozen shape features. Training bins each feature and
goes round the features again and again: each turn fits a tree of three leaves
to the bin's gradients and adds a small part of it to the feature's lookup
table. Then the pairs with most gain get tables of their own, from trees with a
cut on either feature. A score is the sum of looked-up bins through a logistic
curve; all of it is vectorised over a batch.

The model is fitted on at most max_rows labelled rows, chosen by a hash of
doc_id; the features of these alone reach the driver.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.llm._common import slices, text_of

FEATURES = ("log_chars", "word_chars", "upper", "digits", "symbols", "bars", "stops", "distinct", "top_word", "short", "lines", "distinct_lines", "distinct_pairs")


def features(text: str) -> tuple[float, ...]:
    """The shape of a text; zeros for one without words."""
    words = text.split()
    n = len(words)
    if not n:
        return (math.log1p(len(text)), *[0.0] * (len(FEATURES) - 1))
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8), minlength=256)
    size = int(raw.sum())
    upper, lower, digits = int(raw[65:91].sum()), int(raw[97:123].sum()), int(raw[48:58].sum())
    marks = int(raw[33:48].sum() + raw[58:65].sum() + raw[91:97].sum() + raw[123:127].sum())
    stops, bars = int(raw[46] + raw[44]), int(raw[124])
    counts = Counter(words)
    lines = text.split("\n")
    return (
        math.log1p(len(text)), len(text) / n, upper / max(1, upper + lower), digits / size, (marks - stops - bars) / size, bars / n, stops / n, len(counts) / n,
        max(counts.values()) / n, sum(c for w, c in counts.items() if len(w) <= 3) / n, len(lines) / n, len(set(lines)) / len(lines), len(set(zip(words, words[1:], strict=False))) / max(1, n - 1),
    )


@dataclass
class AdditiveModel:
    """Lookup tables: one a feature, and one for each pair that was kept."""

    bins: int = 32
    pair_bins: int = 8
    rounds: int = 200
    pair_rounds: int = 60
    pairs_kept: int = 10
    rate: float = 0.15
    smoothing: float = 2.0
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def _cut(self, column: np.ndarray, bins: int) -> np.ndarray:
        return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))

    def _leaves(self, g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
        """A tree over ordered bins: values of its leaves, bin by bin."""
        borders = [0, len(g)]
        gain = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + self.smoothing)
        while len(borders) <= leaves:
            best = (1e-9, None)
            for a, b in zip(borders, borders[1:], strict=False):
                if b - a < 2:
                    continue
                left_g, left_h = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
                right_g, right_h = g[a:b].sum() - left_g, h[a:b].sum() - left_h
                gains = left_g**2 / (left_h + self.smoothing) + right_g**2 / (right_h + self.smoothing) - gain(a, b)
                at = int(np.argmax(gains))
                best = max(best, (float(gains[at]), a + at + 1), key=lambda x: x[0])
            if best[1] is None:
                break
            borders = sorted([*borders, best[1]])
        out = np.zeros(len(g))
        for a, b in zip(borders, borders[1:], strict=False):
            out[a:b] = g[a:b].sum() / (h[a:b].sum() + self.smoothing)
        return out

    def _quadrants(self, g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        """The best cut on either axis: gain and values of the four leaves."""
        cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
        row_g, row_h, col_g, col_h, all_g, all_h = cg[:-1, -1:], ch[:-1, -1:], cg[-1:, :-1], ch[-1:, :-1], cg[-1, -1], ch[-1, -1]
        a_g, a_h = cg[:-1, :-1], ch[:-1, :-1]
        leaves = [(a_g, a_h), (row_g - a_g, row_h - a_h), (col_g - a_g, col_h - a_h), (all_g - row_g - col_g + a_g, all_h - row_h - col_h + a_h)]
        gains = sum(x**2 / (y + self.smoothing) for x, y in leaves)
        if not gains.size:
            return 0.0, np.zeros_like(g)
        i, j = np.unravel_index(int(np.argmax(gains)), gains.shape)
        values = [float(x[i, j] / (y[i, j] + self.smoothing)) for x, y in leaves]
        out = np.empty_like(g)
        out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = values
        return float(gains[i, j]), out

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.base = float(np.log(share / (1 - share)))
        columns = range(x.shape[1])
        self.edges = [self._cut(x[:, f], self.bins) if len(x) else np.zeros(0) for f in columns]
        self.coarse = [self._cut(x[:, f], self.pair_bins) if len(x) else np.zeros(0) for f in columns]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        if not len(x) or y.min() == y.max():
            return self
        binned = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)]
        score = np.full(len(y), self.base)

        def slopes() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-score))
            return y - p, p * (1 - p)

        for _ in range(self.rounds):
            for f in columns:
                g, h = slopes()
                n = len(self.tables[f])
                step = self.rate * self._leaves(np.bincount(binned[f], g, n), np.bincount(binned[f], h, n))
                self.tables[f] += step
                score += step[binned[f]]
        rough = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.coarse)]
        shape = [len(e) + 1 for e in self.coarse]

        def grid(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            g, h = slopes()
            at, n = rough[a] * shape[b] + rough[b], shape[a] * shape[b]
            return np.bincount(at, g, n).reshape(shape[a], shape[b]), np.bincount(at, h, n).reshape(shape[a], shape[b]), at

        ranked = sorted(((self._quadrants(*grid(a, b)[:2])[0], a, b) for a in columns for b in range(a)), reverse=True)
        self.pairs = [(a, b, np.zeros((shape[a], shape[b]))) for _, a, b in ranked[: self.pairs_kept]]
        for _ in range(self.pair_rounds):
            for a, b, values in self.pairs:
                g, h, at = grid(a, b)
                step = self.rate * self._quadrants(g, h)[1]
                values += step
                score += step.ravel()[at]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, (edges, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += values[np.searchsorted(edges, x[:, f], "right")]
        if self.pairs:
            rough = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.coarse)]
            for a, b, values in self.pairs:
                total += values[rough[a], rough[b]]
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def held_out(doc_id: str = "doc_id"):
    """Rows that training never sees: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def _described(docs: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            rows = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["label", "x"])

    return docs.mapInArrow(work, "label int, x array<double>")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> AdditiveModel:
    """A model of labels.quality (1 or 0; other rows are passed over) from at most max_rows labels.

    Of an id that repeats, each label counts with each row.
    """
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("label"))
    chosen = usable.orderBy(F.xxhash64("_id"), "_id", "label").limit(max_rows)
    known = docs.select(F.col("doc_id").alias("_doc"), text_of().alias("text")).join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))  # max_rows small rows at most
    rows = _described(known.select("label", "text")).collect()
    rows.sort(key=lambda r: (r["label"], r["x"]))
    x = np.array([r["x"] for r in rows], dtype=float).reshape(len(rows), len(FEATURES))
    return AdditiveModel().fit(x, np.array([r["label"] for r in rows], dtype=float))


def score_documents(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; a null text counts as empty."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            x = np.array([features(t) for t in batch.column(2).to_pylist()], dtype=float).reshape(batch.num_rows, len(FEATURES))
            score = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), text_of().alias("text")).mapInArrow(work, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """The rows of docs that the model takes for good, with all their columns."""
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            x = np.array([features(t or "") for t in batch.column(at).to_pylist()], dtype=float).reshape(batch.num_rows, len(FEATURES))
            yield batch.filter(pa.array(model.score(x) >= 0.5))

    return docs.mapInArrow(work, docs.schema)
