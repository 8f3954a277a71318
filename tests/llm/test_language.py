"""Languages: held-out texts, families, machines and texts without letters."""

import random
import zlib

import numpy as np
import pytest

from sedimark.llm import language

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {
    "en": ["th", "ing", "and", "er", "ou", "wh", "ly"],
    "de": ["sch", "ung", "und", "er", "ei", "ß", "lich"],
    "nl": ["sch", "ing", "en", "ij", "oe", "lijk", "ver"],
    "fr": ["eau", "que", "ment", "é", "ou", "les", "tion"],
    "es": ["ción", "que", "mente", "ñ", "ar", "los", "ado"],
    "xx": ["ka", "zu", "mo", "ri", "ta"],
}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    out = [(k, prose(rng, lang, rng.randint(8, 60)), lang, "s", 1) for k, lang in enumerate(rng.choices(list(SYLLABLES), [20, 5, 4, 5, 4, 3], k=700))]
    return out + [(9000, None, "en", "s", 1), (9001, "", "fr", "s", 1), (9002, "12 34 !!", "de", "s", 1), (9003, prose(rng, "es", 30_000), None, None, None), (None, prose(rng, "fr", 20), None, "s", 1), (3, "  \n", None, "s", 1)]


def test_held_out_texts_are_known(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS n", "2 AS _hash", "3 AS last", "4 AS score").repartition(5)
    model = language.train(docs, per_language=60)
    assert set(model.families) == {"germanic", "romance", "=xx"} and set(model.pairs) == {("de", "en"), ("de", "nl"), ("en", "nl"), ("es", "fr")}
    found = language.predicted(docs, model).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    truth = {(i, lang) for i, t, lang, *_ in rows if t and any(c.isalpha() for c in t)}
    for r in found:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    held = [r for r in found if r.held_out and r.doc_id < 9000 and r.doc_id != 3]
    right = sum((r.doc_id, r.lang_pred) in truth for r in held)
    assert len(held) > 150 and right >= 0.98 * len(held)
    by = {r.doc_id: r for r in found}
    assert [by[k].lang_pred for k in (9000, 9001, 9002, 9003, None)] == ["und", "und", "und", "es", "fr"]
    assert sorted(r.lang_pred for r in found if r.doc_id == 3)[-1] == "und"


def test_other_columns_and_held_out_texts_never_count(spark, rows):
    """Neither lang of held-out rows nor source or doc_id change a prediction."""
    changed = [(i, t, "wrong" if i is not None and zlib.crc32(str(i).encode()) % 3 == 1 else lang, "other", None) for i, t, lang, _, _ in rows]
    a, b = (language.train(spark.createDataFrame(r, SCHEMA), per_language=40) for r in (rows, changed))
    assert a.families == b.families and all((a.pairs[k] == b.pairs[k]).all() for k in a.pairs)
    assert a.predict([t for _, t, *_ in rows]) == b.predict([t for _, t, *_ in rows])


def test_without_labels_all_is_undetermined(spark, rows, empty):
    docs = spark.createDataFrame([(i, t, None, s, n) for i, t, _, s, n in rows], SCHEMA)
    assert {r.lang_pred for r in language.predicted(docs, language.train(docs)).collect()} == {"und"}
    assert language.predicted(empty, language.train(empty)).collect() == []


def test_one_language_alone(spark):
    docs = spark.createDataFrame([(k, "some words", "en", "s", 1) for k in range(9)] + [(10, "5", "en", "s", 1)], SCHEMA)
    found = language.predicted(docs, language.train(docs)).collect()
    assert {r.lang_pred for r in found if r.doc_id < 10} == {"en"} and [r.lang_pred for r in found if r.doc_id == 10] == ["und"]


def test_too_many_languages_are_refused(spark):
    docs = spark.createDataFrame([(k, "word", f"l{k}", "s", 1) for k in range(30)], SCHEMA)
    with pytest.raises(ValueError, match="more than 5"):
        language.train(docs, most_languages=5)


def test_counts_by_hand_and_in_pieces(monkeypatch):
    def naive(text):
        out = np.zeros(language.DIMS, dtype=np.int64)
        for word in "".join(c if language._classes()[ord(c)] else " " for c in text.lower()).split():
            out += language.counts(word)
        return out

    rng = random.Random(2)
    text = prose(rng, "de", 400) + " été 1a2 🙂x"
    assert (language.counts(text) == naive(text)).all() and language.counts(text).sum() > 0
    whole = language.counts(text)
    monkeypatch.setattr(language, "PIECE", 50)
    assert (language.counts(text) == whole).all()


def test_machine_separates_with_the_margin_of_the_optimum():
    """At the optimum of the squared hinge the gradient is zero."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 5)).astype(np.float32)
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=80) > 0.4, 1.0, -1.0)
    w = language.train_machine(x, y, cost=1.0, passes=4000).astype(np.float64)
    full = np.hstack([x, np.ones((80, 1))])
    weight = 0.5 / np.where(y > 0, (y > 0).mean(), (y < 0).mean())
    gradient = w - 2 * (weight * np.maximum(0, 1 - y * (full @ w)) * y) @ full
    assert np.abs(gradient).max() < 0.05
