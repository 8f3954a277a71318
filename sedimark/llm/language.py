"""The language of a text: its family first, then the language among its relatives.

Texts become hashed counts of one to three neighbouring letters and borders, and of
words, over lower-cased runs of letters; counts are damped, weighted by the
inverse share of texts that have them, and brought to length one. A linear support
vector machine for each family separates it from the others; within the family that
wins, a machine for each pair of languages votes (ties: the larger sum of margins).

Machines are trained in Spark, one to a task, by dual coordinate descent on a bounded
sample: per_language texts of each language, chosen by a hash of doc_id and text. No more than
most_languages values of lang are accepted. What reaches the driver is the weights of
the machines.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimark.llm._common import mix64, shared_folder, slices, stored

#: Families of languages by their ISO 639-1 codes; a language that isn't named is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "celtic": ("br", "cy", "ga", "gd"),
    "baltic": ("lt", "lv"),
    "uralic": ("et", "fi", "hu"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "si", "ur"),
    "iranian": ("fa", "ku", "ps", "tg"),
    "semitic": ("am", "ar", "he", "mt"),
    "turkic": ("az", "kk", "ky", "tr", "tt", "ug", "uz"),
    "dravidian": ("kn", "ml", "ta", "te"),
    "malayic": ("id", "jv", "ms", "su"),
}

DIMS = 4096
UNKNOWN = "und"
#: Letters of one run that are looked at together; a run of more is cut there.
PIECE = 1 << 18


def family_of(lang: str) -> str:
    return next((name for name, members in FAMILIES.items() if lang in members), f"={lang}")


@cache
def _classes() -> np.ndarray:
    """1 for letters and the marks on them, 2 for letters alone, by code point."""
    out = np.zeros(0x110000, dtype=np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        out[c] = 2 if kind == "L" else 1 if kind == "M" else 0
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def _pieces(points: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in pieces that end outside words, as far as it has such places."""
    while len(points) > PIECE:
        gaps = np.flatnonzero(_classes()[points[:PIECE]] == 0)
        end = int(gaps[-1]) + 1 if len(gaps) else PIECE
        yield points[:end]
        points = points[end:]
    yield points


def _add_counts(points: np.ndarray, out: np.ndarray) -> None:
    """Adds the buckets of the piece's n-grams and words to out."""
    words = _classes()[points] > 0
    if not words.any():
        return
    # Each run of letters is followed by one border; other characters go.
    keep = words.copy()
    keep[1:] |= words[:-1]
    c = np.where(words, points, 0)[keep].astype(np.uint64)
    c = np.concatenate([np.zeros(1, np.uint64), c, np.zeros(1, np.uint64)])
    inner = c[1:-1] != 0
    p = np.uint64(0x9E3779B97F4A7C15)
    two, three = c[:-1] * p + c[1:], (c[:-2] * p + c[1:-1]) * p + c[2:]
    at = np.flatnonzero(c[1:] != 0) + 1
    begins = at[c[at - 1] == 0]
    place = np.arange(len(c), dtype=np.int64)
    place[at] -= np.repeat(begins, np.diff(np.concatenate([np.searchsorted(at, begins), [len(at)]])))
    powers = np.cumprod(np.full(int(place[at].max()) + 1, p, dtype=np.uint64))
    word = np.add.reduceat(mix64(c[at]) * powers[place[at]], np.searchsorted(at, begins))
    grams = [c[1:-1][inner], two[1:][inner] ^ np.uint64(1 << 60), three[inner] ^ np.uint64(2 << 60), word ^ np.uint64(3 << 60)]
    for g in grams:
        out += np.bincount((mix64(g * p) & np.uint64(DIMS - 1)).astype(np.int64), minlength=DIMS)


def counts(text: str) -> np.ndarray:
    """The hashed counts of a whole text."""
    out = np.zeros(DIMS, dtype=np.int64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    for piece in _pieces(points):
        _add_counts(piece, out)
    return out


def unit(vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
    x = np.log1p(vectors) * weights
    return (x / np.maximum(np.sqrt((x * x).sum(axis=-1, keepdims=True)), 1e-12)).astype(np.float32)


def train_machine(x: np.ndarray, y: np.ndarray, cost: float = 10.0, passes: int = 40, seed: int = 1) -> np.ndarray:
    """Weights and bias of a linear support vector machine (squared hinge), y being 1 or -1.

    Both sides weigh alike, whatever their numbers of rows.
    """
    x = np.hstack([x.astype(np.float64), np.ones((len(x), 1))])
    share = np.where(y > 0, (y > 0).mean(), (y < 0).mean())
    slack = 1 / (2 * cost * 0.5 / np.maximum(share, 1e-9))
    a, w, norms, rng = np.zeros(len(y)), np.zeros(x.shape[1]), (x * x).sum(axis=1), np.random.default_rng(seed)
    for _ in range(passes):
        worst = 0.0
        for i in rng.permutation(len(y)).tolist():
            slope = y[i] * (x[i] @ w) - 1 + slack[i] * a[i]
            if a[i] > 0 or slope < 0:
                new = max(0.0, a[i] - slope / (norms[i] + slack[i]))
                if new != a[i]:
                    w += (new - a[i]) * y[i] * x[i]
                    worst = max(worst, abs(new - a[i]) * (norms[i] + slack[i]))
                    a[i] = new
        if worst < 1e-3:
            break
    return w.astype(np.float32)


@dataclass
class LanguageModel:
    """families: names with a machine each (none for a single one); pairs: machines for two languages of a family."""

    weights: np.ndarray
    families: dict[str, list[str]]
    family_machines: dict[str, np.ndarray]
    pairs: dict[tuple[str, str], np.ndarray]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text; und and 0 without letters or without learned languages.

        A score is the logistic of twice the family's margin, times that of the least margin among its pairs.
        """
        if not self.families:
            return [(UNKNOWN, 0.0)] * len(texts)
        known = [has_letter(t) for t in texts]
        x = np.stack([counts(t) if k else np.zeros(DIMS, np.int64) for t, k in zip(texts, known, strict=True)]) if texts else np.zeros((0, DIMS), np.int64)
        x = np.hstack([unit(x, self.weights), np.ones((len(texts), 1), np.float32)])
        names = sorted(self.families)
        logistic = lambda m: 1 / (1 + np.exp(-np.clip(2 * m.astype(np.float64), -50, 50)))
        margins = np.stack([x @ self.family_machines[f] for f in names], axis=1) if len(names) > 1 else np.full((len(texts), 1), 25.0)
        best = margins.argmax(axis=1)
        lang, score = np.full(len(texts), UNKNOWN, dtype=object), logistic(margins.max(axis=1)) if len(texts) else np.zeros(0)
        for k, name in enumerate(names):
            rows, members = np.flatnonzero(best == k), self.families[name]
            votes, sums, least = np.zeros((len(rows), len(members))), np.zeros((len(rows), len(members))), np.full((len(rows), len(members)), 25.0)
            for i, a in enumerate(members):
                for j in range(i + 1, len(members)):
                    margin = x[rows] @ self.pairs[a, members[j]]
                    votes[:, i] += margin >= 0
                    votes[:, j] += margin < 0
                    for at, m in ((i, margin), (j, -margin)):
                        sums[:, at] += m
                        least[:, at] = np.minimum(least[:, at], m)
            if len(rows):
                order = np.lexsort((sums, votes), axis=1)[:, -1]
                lang[rows] = np.array(members, dtype=object)[order]
                score[rows] *= logistic(least[np.arange(len(rows)), order])
        return [(str(lang[i]), float(score[i])) if known[i] else (UNKNOWN, 0.0) for i in range(len(texts))]


def held_out() -> F.Column:
    """Rows that training never sees: crc32 of the id as text leaves 1 modulo 3; a null id is never held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, per_language: int = 400, most_languages: int = 200) -> LanguageModel:
    """A model of lang, from at most per_language texts with letters of each language; held-out rows take no part."""
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession)
    rows = docs.select("doc_id", "lang", "text").filter(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sizes = rows.groupBy("lang").count().limit(most_languages + 1).collect()
    if len(sizes) > most_languages:
        raise ValueError(f"lang has more than {most_languages} values")
    if not sizes:
        return LanguageModel(np.ones(DIMS, np.float32), {}, {}, {})
    languages = sorted(r["lang"] for r in sizes)
    # Hashes are even over 64 bits: about twice per_language rows of each language lie below its border.
    last = [(r["lang"], int(min(2.0 * per_language / r["count"], 1.0) * (2**64 - 2**12)) - 2**63) for r in sizes]
    border = F.broadcast(spark.createDataFrame(last, "lang string, last long"))  # a row a language
    near = rows.join(border, "lang").withColumn("_hash", F.xxhash64("doc_id", "text")).filter((F.col("_hash") <= F.col("last")) | (F.col("last") > 2**63 - 2**13))
    sample = near.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("_hash", "doc_id", "text"))).filter(F.col("n") <= per_language)
    vectors = stored(_vectors(sample), folder, "vectors")
    seen = vectors.select(F.posexplode("x").alias("at", "c")).filter("c > 0").groupBy("at").count().collect()
    n, weights = vectors.count(), np.zeros(DIMS, dtype=np.float64)
    for at, count in ((r["at"], r["count"]) for r in seen):
        weights[at] = np.log(1 + n / count)
    families: dict[str, list[str]] = {}
    for lang in languages:
        families.setdefault(family_of(lang), []).append(lang)
    jobs = [(f"{a}\n{b}", lang, sign) for members in families.values() for i, a in enumerate(members) for b in members[i + 1 :] for lang, sign in ((a, 1), (b, -1))]
    if len(families) > 1:
        jobs += [(name, lang, 1 if lang in members else -1) for name, members in families.items() for lang in languages]
    trained = _machines(vectors, jobs, weights)
    return LanguageModel(weights.astype(np.float32), families, {k: w for k, w in trained.items() if "\n" not in k}, {tuple(k.split("\n")): w for k, w in trained.items() if "\n" in k})


def _vectors(rows: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            x = [counts(t).astype(np.int32) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.int32()))], ["lang", "n", "x"])

    return rows.select("lang", "n", "text").mapInArrow(work, "lang string, n int, x array<int>")


def _machines(vectors: DataFrame, jobs: list[tuple[str, str, int]], weights: np.ndarray) -> dict[str, np.ndarray]:
    """The weights of each job; a job is a bounded sample, at most per_language rows of each language."""
    if not jobs:
        return {}
    import pandas as pd

    plan = F.broadcast(vectors.sparkSession.createDataFrame(jobs, "job string, lang string, y int"))  # some rows a pair of languages

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["lang", "n"])
        w = train_machine(unit(np.stack(part["x"].tolist()), weights), part["y"].to_numpy(dtype=float))
        return pd.DataFrame({"job": [part["job"].iloc[0]], "w": [w.astype(np.float32).tobytes()]})

    found = vectors.join(plan, "lang").groupBy("job").applyInPandas(fit, "job string, w binary").collect()
    return {r["job"]: np.frombuffer(bytes(r["w"]), np.float32) for r in found}


def predicted(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, from its whole text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            found = shared.value.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text").mapInArrow(work, "doc_id long, held_out boolean, lang_pred string, score double")
