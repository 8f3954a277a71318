import datetime as dt
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from sedimark.functions import rules
from sedimark.operators import catalog, evidence, sessions


def one(spark, column, row, schema):
    return spark.createDataFrame([row], schema).select(column).first()[0]


def test_quotes_and_numbers(spark):
    assert one(spark, evidence.quoted(F.col("t"), F.col("q")), ("Revenue  grew—by 12% “fast”", 'grew-by12% "FAST"'), "t string, q string")
    assert not one(spark, evidence.quoted(F.col("t"), F.col("q")), ("abc", "abc"), "t string, q string")
    assert one(spark, evidence.numbers_in(F.col("t")), ("up 1,234.5 or (20) at A12 and -3",), "t string") == [1234.5, -20.0, -3.0]
    assert not one(spark, evidence.number_quoted(F.lit(12.0), F.col("t")), ("in 2012 and 112",), "t string")


def test_claims_are_merged(spark):
    df = spark.createDataFrame([("k", 0.5, "low", ["e1"], ["q1"]), ("k", 0.9, "high", ["e2", "e1"], ["q2"])], "k string, confidence double, text string, ids array<string>, quotes array<string>")
    (got,) = evidence.deduplicated_claims(df, ["k"], "confidence", "ids", "quotes", 1).collect()
    assert (got.confidence, got.text, got.ids, got.quotes) == (0.9, "high", ["e1", "e2"], ["q1"])


def test_issuers(spark):
    registry = spark.createDataFrame([("ats", "Alpha Tech Inc.", ["AT"]), ("beta", "贝塔证券股份有限公司", None)], "issuer_key string, issuer_name string, aliases array<string>")
    mentions = spark.createDataFrame([("alpha-tech Ltd",), ("贝塔证券",), ("Alpha Technik",), ("Gamma",)], "name string")
    assert {r.name: r.issuer_key for r in evidence.resolved_issuers(mentions, registry, "name").collect()} == {"alpha-tech Ltd": "ats", "贝塔证券": "beta", "Alpha Technik": "ats", "Gamma": None}
    docs = spark.createDataFrame([(1, "alpha-2026.pdf", "Alpha said. Beta said.")], "doc_id int, filename string, text string")
    aliases = spark.createDataFrame([("ats", "alpha"), ("beta", "beta"), ("none", "zeta")], "issuer_key string, alias string")
    assert [(r.issuer_key, r.score) for r in evidence.issuer_scores(docs, aliases).orderBy("place").collect()] == [("ats", 0.79), ("beta", 0.19)]


def brute_scores(name, text, aliases, head, body):
    form = lambda v: unicodedata.normalize("NFKC", v or "").lower()
    shown, best = form(text)[:body], {}
    for key, alias in aliases:
        a = form(alias)
        if len(a) > 1:
            tail = shown[-head:] if len(shown) > head else ""
            score = 0.6 * (a in form(name)) + min(0.34, 0.17 * shown[:head].count(a)) + min(0.34, 0.17 * tail.count(a)) + min(0.1, 0.02 * shown.count(a))
            if a in form(name) or a in shown:
                best[key] = max(best.get(key, 0), round(min(1.0, score), 4))
    return sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5]


def test_issuer_scores_against_brute_force(spark):
    rng = random.Random(7)
    aliases = [("a", "ac"), ("a", "acme"), ("b", "x"), ("c", "aa"), ("d", "aaa"), ("e", "ＡＢ"), ("f", "ab"), ("g", "acme says"), ("h", "zz"), ("i", ""), ("j", None), ("k", "b a"), ("k", "b a")]
    docs = [(n, rng.choice(["acme.pdf", None, "AB", "x"]), "".join(rng.choice("aabcx zメ") for _ in range(rng.choice([0, 5, 40, 300])))) for n in range(60)]
    docs += [(100, "f", "acme says so"), (101, None, None), (102, "ＡＣＭＥ", "Acme " * 5000), (103, "n", "b" * 200 + " aaaa")]
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, filename string, text string, score int, place int").repartition(3)
    got = evidence.issuer_scores(frame, spark.createDataFrame(aliases, "issuer_key string, alias string"), head=30, body=120).collect()
    want = {(n, key, score, place) for n, name, text in docs for place, (key, score) in enumerate(brute_scores(name, text, [(k, a) for k, a in aliases if a], 30, 120), 1)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert ("g", 0.19) in {(r.issuer_key, r.score) for r in got if r.doc_id == 100}
    none = spark.createDataFrame([], "issuer_key string, alias string")
    assert evidence.issuer_scores(frame, none).collect() == [] and evidence.issuer_scores(frame.limit(0), none).collect() == []
    with pytest.raises(ValueError, match="more than 2 aliases"):
        evidence.issuer_scores(frame, spark.createDataFrame(aliases, "issuer_key string, alias string"), most_aliases=2)


def test_evidence_and_names(spark):
    ids = spark.createDataFrame([("page:1",), ("cell:S!A1",), ("page:9",)], "evidence_id string")
    kinds = {"page": spark.createDataFrame([(1, "p1")], "key int, location string"), "cell": spark.createDataFrame([("S!A1", "c")], "key string, location string")}
    assert {r.evidence_id: r.location for r in evidence.located(ids, kinds).collect()} == {"page:1": "p1", "cell:S!A1": "c", "page:9": None}
    answer = spark.createDataFrame([(1, "see [a](x:1) and [b](y:2)")], "id int, text string")
    assert [(r.label, r.target) for r in evidence.citations(answer, "text").collect()] == [("a", "x:1"), ("b", "y:2")]
    files = spark.createDataFrame([("Report.pdf",), ("My report.pdf",)], "name string")
    assert [r.name for r in evidence.named_documents(files, "name", "report").collect()] == ["Report.pdf"]
    assert [r.name for r in evidence.named_documents(files, "name", "my").collect()] == ["My report.pdf"]


def test_venue_clock_follows_summer_time(spark):
    clock = lambda code, at: one(spark, rules.venue_clock(F.col("c"), F.to_timestamp("t")), (code, at), "c string, t string")
    assert (clock("AAPL.O", "2026-07-01 20:00:00").minute, clock("AAPL.O", "2026-01-02 20:00:00").minute) == (960, 900)
    assert clock("0700.HK", "2026-07-01 08:00:00").after_close and not clock("0700.HK", "2026-07-04 08:00:00").after_close
    assert clock("X.ZZ", "2026-07-01 08:00:00") is None


def test_rules(spark):
    assert one(spark, rules.tiered_cost(F.lit(300_000), F.lit(1.0), F.col("t")), ([(200_000, 2.0), (100_000, 1.5)],), "t array<struct<above:long,rate:double>>") == pytest.approx(0.6)
    values = lambda op, v: one(spark, rules.scenario(op, F.col("v")), (v,), "v array<double>")
    assert values("compound", [100.0, 0.1, 2.0]) == pytest.approx(121) and values("ratio", [1.0, 0.0]) is None and values("sum", [1.0, None]) is None
    assert one(spark, rules.dates_in(F.col("t")), ("on 2026年1月31日, 2026/2/30 and 2026-03-04",), "t string") == [dt.date(2026, 1, 31), dt.date(2026, 3, 4)]
    assert one(spark, rules.importance(F.col("t"), ["annual report"], ["notice"]), ("Annual Report notice",), "t string") == "high"
    assert one(spark, rules.canonical_json(F.col("m")), ({"b": "1", "a": "2"},), "m map<string,string>") == '{"a":"2","b":"1"}'
    day = F.lit("2026-05-01").cast("date")
    got = one(spark, rules.published_date(F.lit("1999-01-01").cast("date"), F.lit(None).cast("date"), day, day, day), (1,), "x int")
    assert (got.date, got.source) == (dt.date(2026, 5, 1), "model")
    lines = spark.createDataFrame([("k", 1, "aé"), ("k", 2, "bb"), ("k", 3, "c")], "k string, n int, t string")
    assert [(r.n, r.truncated) for r in rules.byte_budget(lines, ["k"], "n", "t", 7).orderBy("n").collect()] == [(1, False), (2, True)]


def test_paths_forks_and_tools(spark):
    entries = spark.createDataFrame([("s", "a", None, "m"), ("s", "b", "a", "m"), ("s", "c", "b", "m"), ("s", "x", "y", "m"), ("s", "y", "x", "m")], "session string, id string, parent_id string, type string")
    tips = spark.createDataFrame([("s", "c"), ("s", "x"), ("s", "?")], "session string, leaf string")
    paths = sessions.leaf_paths(entries, tips)
    assert [r.id for r in paths.filter("leaf = 'c'").orderBy("position").collect()] == ["a", "b", "c"]
    assert paths.filter("leaf = 'x'").count() == 2 and paths.filter("leaf = '?'").count() == 0
    assert [(r.seq, r.id) for r in sessions.forked(entries, paths.filter("leaf = 'c'"), "t").orderBy("seq").collect()] == [(1, "a"), (2, "b"), (3, "c")]
    calls = spark.createDataFrame([("s", 1, "c1", "read"), ("s", 2, "c2", "read"), ("s", 3, "c3", "edit")], "session string, seq int, call_id string, tool string")
    results = spark.createDataFrame([("c1", False, 10), ("c3", True, 4)], "call_id string, is_error boolean, tokens int")
    assert {r.tool: (r.calls, r.results, r.errors, r.unresolved) for r in sessions.tool_results(calls, results).collect()} == {"read": (2, 1, 0, 1), "edit": (1, 1, 1, 0)}
    assert [(r.call_id, r.pending) for r in sessions.pending_calls(calls, results).collect()] == [("c2", 1)]
    used = spark.createDataFrame([("m", 95, True), ("m", 10, False)], "model string, prompt int, compacted boolean")
    (got,) = sessions.context_usage(used, ["model"], spark.createDataFrame([("m", 100)], "model string, window int")).collect()
    assert (got.over_80, got.over_90, got.over_100, got.compaction_rate) == (1, 1, 0, 0.5)
    tries = spark.createDataFrame([("o", 1, 1), ("o", 2, 3)], "op string, seq int, attempt int")
    assert [r.seq for r in sessions.attempt_gaps(tries, ["op"], "seq").collect()] == [2]


def test_collections(spark):
    assert catalog.one_dataset(spark.createDataFrame([("d",), (" ",), ("d",)], "dataset_id string")) == "d"
    with pytest.raises(ValueError):
        catalog.one_dataset(spark.createDataFrame([("d",), ("e",)], "dataset_id string"))
    pages = spark.createDataFrame([(1, 1), (1, 2), (2, 2)], "doc_id int, page_number int")
    assert {(r.doc_id, r.complete) for r in catalog.page_range(pages, 1, 2).collect()} == {(1, True), (2, False)}
    assert catalog.conformed(pages, {"doc_id": "long", "x": "string"}).dtypes == [("doc_id", "bigint"), ("x", "string")]
