"""Commits over several tables: crashes, two writers, pinned readers, replays; and the trigram index on them."""

import random

import pytest
from pyspark.sql import functions as F

from sedimark.operators import trigrams
from sedimark.sources import commits
from sedimark.sources.commits import Tables, VersionTaken, append, replace, replace_keys


@pytest.fixture
def tables(spark, tmp_path):
    return Tables(spark, f"file://{tmp_path}/set")


def frame(spark, rows, schema="doc_id long, x string"):
    return spark.createDataFrame(rows, schema)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_versions_are_whole(spark, tables):
    assert tables.version() == 0 and tables.names() == []
    assert tables.commit({"a": append(frame(spark, [(1, "p")])), "b": append(frame(spark, [(1, "q")]))}) == 1
    assert tables.commit({"a": append(frame(spark, [(2, "r")]))}) == 2
    assert tables.commit({"a": replace_keys(frame(spark, [(1, "new"), (None, "n")]), ["doc_id"]), "b": replace(frame(spark, []))}) == 3
    assert tables.commit({"a": replace_keys(frame(spark, []), ["doc_id"], frame(spark, [(2, "-"), (None, "-")]).select("doc_id"))}) == 4
    assert [rows(tables.read("a", v)) for v in (1, 2, 3, 4)] == [[(1, "p")], [(1, "p"), (2, "r")], sorted([(1, "new"), (2, "r"), (None, "n")], key=str), [(1, "new")]]
    assert rows(tables.read("b", 2)) == [(1, "q")] and rows(tables.read("b")) == [] and tables.orphans() == []
    with pytest.raises(ValueError, match="columns"):
        tables.commit({"a": append(frame(spark, [(1,)], "doc_id long"))})
    assert tables.version() == 4


def test_a_crash_between_two_tables_changes_nothing(spark, tables):
    tables.commit({"a": append(frame(spark, [(1, "p")])), "b": append(frame(spark, [(1, "q")]))})
    broken = frame(spark, [(2, "s")]).withColumn("x", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        tables.commit({"a": append(frame(spark, [(2, "r")])), "b": append(broken)})
    assert tables.version() == 1 and rows(tables.read("a")) == [(1, "p")]
    left = tables.orphans()
    assert {n.split("-")[0] for n in left} >= {"a"} and tables.orphans(older_than_s=3600) == []
    assert tables.clean(older_than_s=0) == left and tables.orphans() == [] and rows(tables.read("b")) == [(1, "q")]


def test_a_crash_before_the_manifest_changes_nothing(spark, tables, monkeypatch):
    tables.commit({"a": append(frame(spark, [(1, "p")]))})
    with monkeypatch.context() as m:
        m.setattr(Tables, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            tables.commit({"a": replace(frame(spark, [(9, "z")])), "b": append(frame(spark, [(9, "z")]))})
    assert tables.version() == 1 and tables.names() == ["a"] and len(tables.orphans()) == 2


def test_of_two_writers_one_goes_through(spark, tables):
    tables.commit({"a": append(frame(spark, [(1, "p")]))})
    other = Tables(spark, tables.folder)
    seen = other.version()
    assert tables.commit({"a": append(frame(spark, [(2, "first")]))}) == 2
    with pytest.raises(VersionTaken):
        other.commit({"a": append(frame(spark, [(3, "second")]))}, expected=seen)
    assert rows(tables.read("a")) == [(1, "p"), (2, "first")] and len(tables.orphans()) == 1
    assert other.commit({"a": append(frame(spark, [(3, "second")]))}) == 3
    assert rows(tables.read("a", 1)) == [(1, "p")] and not [n for n, _ in tables._names(f"{tables.folder}/versions") if n.startswith("draft")]


def test_documents_with_pages_and_blocks(spark, tables):
    page = "doc_id long, page int"
    commits.publish_documents(tables, frame(spark, [(1, "a"), (2, "b")]), frame(spark, [(1, 1), (1, 2), (2, 1)], page), frame(spark, [(1, 1), (2, 7)], page))
    commits.publish_documents(tables, frame(spark, [(1, "again")]), frame(spark, [(1, 5)], page), frame(spark, [], page))
    assert [rows(tables.read(t)) for t in ("documents", "pages", "blocks")] == [[(1, "again"), (2, "b")], [(1, 5), (2, 1)], [(2, 7)]]


def test_entries_come_once_with_their_totals(spark, tables):
    entry = "session string, seq int, text string"
    first, second = [("s", 1, "a"), ("s", 2, "b"), ("t", 1, "c"), ("t", 1, "c")], [("s", 2, "b"), ("s", 3, "d"), ("u", 1, "e")]
    for batch in (first, second, second):
        commits.append_entries(tables, frame(spark, batch, entry))
    assert rows(tables.read("entries")) == sorted(set(first + second))
    assert rows(tables.read("totals")) == [("s", 3, 3), ("t", 1, 1), ("u", 1, 1)]


def test_index_after_batches_equals_a_rebuild(spark, tables, tmp_path):
    rng = random.Random(1)
    make = lambda: "".join(rng.choice("abAB é") for _ in range(rng.choice([0, 2, 3, 40, 200])))
    now = {}
    for batch in range(4):
        texts = [(rng.randint(0, 30), make()) for _ in range(20)] + [(100 + batch, None)]
        dropped = rng.sample(sorted(now), min(4, len(now)))
        args = frame(spark, texts + [(None, "no id")], "id long, text string"), frame(spark, [(i,) for i in dropped], "id long")
        trigrams.apply_batch(tables, batch, *args)
        version = tables.version()
        assert trigrams.apply_batch(tables, batch, *args) == version == tables.version()  # a batch that comes again
        for i in dropped:
            now.pop(i, None)
        greatest = {}
        for i, t in texts:
            greatest[i] = max(greatest.get(i) or "", t or "") if t is not None or greatest.get(i) is not None else None
        now |= greatest
    rebuilt = Tables(spark, f"file://{tmp_path}/again")
    trigrams.apply_batch(rebuilt, 0, frame(spark, list(now.items()), "id long, text string"))
    plain = lambda t: rows(trigrams.live_postings(t).select("gram", "id", F.col("places").cast("string")))
    assert plain(tables) == plain(rebuilt)
    before = tables.version()
    trigrams.merged(tables)
    assert plain(tables) == plain(rebuilt) and tables.read("postings").count() == trigrams.live_postings(tables).count() < tables.read("postings", before).count()
    for phrase in ("aba", "ABAB", "aaaa", "b é", "zzz", " a b"):
        low = phrase.lower()
        places = {i: [k for k in range(len(t) - len(low) + 1) if t.lower()[k : k + len(low)] == low] for i, t in now.items() if t}
        want = sorted((i, len(p), p[0]) for i, p in places.items() if p)
        assert rows(trigrams.search(tables, phrase)) == sorted(want, key=str) and rows(trigrams.search(tables, phrase, before)) == sorted(want, key=str)
    with pytest.raises(ValueError):
        trigrams.search(tables, "ab")


def test_a_search_reads_postings_alone(spark, tables):
    trigrams.apply_batch(tables, 0, frame(spark, [(k, f"text number {k}") for k in range(300)], "id long, text string"))
    plan = trigrams.search(tables, "number 25")._jdf.queryExecution().executedPlan().toString()
    assert "In(gram, [" in plan and "text" not in plan.replace(tables.folder, "")
    assert rows(trigrams.search(tables, "number 25").select("id")) == [(25,)] + [(k,) for k in range(250, 260)]
