import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from sedimark.operators import catalog, claims, graph, retrieval, sessions, stats, tracking


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_majority_ties_go_to_the_largest(spark):
    df = spark.createDataFrame([("a", "%", 1), ("a", "x", 2), ("b", "x", 1)], "item string, unit string, i int")
    assert rows(claims.majority(df, ["item"], ["unit"])) == [("a", "x", 1), ("b", "x", 1)]


def test_robust_stats_of_one_and_of_four(spark):
    df = spark.createDataFrame([("a", 5.0, "%")] + [("b", v, "%") for v in (1.0, 2.0, 3.0, 10.0)], "item string, v double, unit string")
    got = {r["item"]: r for r in claims.robust_stats(df, ["item"], "v", {"%": 3.0}, "unit").collect()}
    assert (got["a"].iqr, got["a"].mad, got["a"].divergent) == (0.0, 0.0, False)
    assert (got["b"].q1, got["b"].median, got["b"].q3, got["b"].mad, got["b"].spread, got["b"].divergent) == (1.75, 2.5, 4.75, 1.0, 9.0, True)


def test_consensus_leaves_out_other_units(spark):
    data = [("i", "a", 1.0, "元", 1), ("i", "a", 2.0, "元", 2), ("i", "b", 4.0, "元", 1), ("i", "c", 99.0, "x", 1)]
    (got,) = claims.consensus(spark.createDataFrame(data, "item string, issuer string, v double, unit string, at int"), ["item"], "issuer", "v", ["at"], ["unit"]).collect()
    assert (got.n, got.median, got.sample_size, got.excluded) == (2, 3.0, 3, 1)


def test_revision_chain_skips_the_same_source(spark):
    data = [(1, "s", "d1", 10.0, "buy", 1, "元"), (2, "s", "d1", 11.0, "buy", 2, "元"), (3, "s", "d2", 9.0, "buy", 3, "元"), (4, "s", "d2", 9.5, "buy", 4, "元"), (5, "s", "d1", None, "sell", 5, "元"), (6, "s", "d3", 1.0, "buy", 6, "x")]
    df = spark.createDataFrame(data, "claim_id int, series string, doc string, v double, stance string, at int, unit string")
    got = {r.claim_id: (r.prior_id, r.direction, r.delta) for r in claims.revision_chain(df, ["series"], "doc", "v", "stance", ["at"], ["unit"]).collect()}
    assert got == {1: (None, "new", None), 2: (None, "new", None), 3: (2, "down", -2.0), 4: (2, "down", -1.5), 5: (4, "changed", None), 6: (None, "new", None)}


def test_null_is_a_source_like_any_other(spark):
    data = [(1, None, 1.0, 1), (2, None, 2.0, 2), (3, "d", 3.0, 3), (4, None, 4.0, 4)]
    df = spark.createDataFrame([(i, "s", d, v, "buy", at, "元") for i, d, v, at in data], "claim_id int, series string, doc string, v double, stance string, at int, unit string")
    got = {r.claim_id: r.prior_id for r in claims.revision_chain(df, ["series"], "doc", "v", "stance", ["at"], ["unit"]).collect()}
    assert got == {1: None, 2: None, 3: 2, 4: 3}


def test_cycles_against_all_ways(spark):
    import random

    rng = random.Random(4)
    for n, m in ((12, 10), (25, 30), (40, 60)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        leads = {a: {b for x, b in edges if x == a} for a in range(n)}
        for _ in range(n):
            leads = {a: to.union(*(leads[b] for b in to)) for a, to in leads.items()}
        df = spark.createDataFrame([*edges, (None, 1), (1, None)], "src long, dst long")
        assert {r.node for r in graph.on_cycles(df).collect()} == {a for a, to in leads.items() if a in to}


def test_mode_with_share(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 1)] + [("d", 1)] * 5 + [("d", i) for i in range(2, 8)], "g string, v int")
    got = {r.g: (r.winner, r.status) for r in claims.mode_with_share(df, ["g"], "v", support=5).collect()}
    assert got == {"a": (1, "agreed"), "b": (None, "conflict"), "c": (None, "insufficient"), "d": (1, "agreed")}


def ledger(spark, trades):
    df = spark.createDataFrame([("k", i, *t) for i, t in enumerate(trades)], "key string, n int, kind string, quantity double, price double, fee double, amount double, ratio double")
    return tracking.with_returns(tracking.position_ledger(df, ["key"], ["n"]), F.lit(12.0)).first()


def test_ledger(spark):
    got = ledger(spark, [("buy", 10.0, 10.0, 1.0, None, None), ("sell", 4.0, 12.0, 0.5, None, None), ("dividend", None, None, None, 3.0, None), ("split", None, None, None, None, 2.0)])
    assert (got.qty, got.error) == (12.0, None)
    assert got.cost == pytest.approx(60.6) and got.realized == pytest.approx(4 * 12 - 0.5 - 40.4) and got.dividends == 3.0
    assert got.return_percent == pytest.approx((12 * 12 - 60.6 + 7.1 + 3) / 101 * 100)
    assert ledger(spark, [("buy", 1.0, 1.0, 0.0, None, None), ("sell", 2.0, 1.0, 0.0, None, None)]).error == "oversell"
    assert ledger(spark, [("dividend", None, None, None, 3.0, None)]).error == "no holding"
    assert ledger(spark, [("buy", 3.0, 1.0, 0.0, None, None), ("sell", 3.0, 2.0, 0.0, None, None)]).cost == 0.0


@pytest.mark.parametrize("most_pairs", [0, 20_000, 10**9])
def test_as_of_valuation_against_all_pairs(spark, most_pairs):
    import random

    draw = random.Random(5)
    day = lambda n: dt.date(1969, 6, 1) + dt.timedelta(n)  # noqa: E731  days before 1970 too
    values = [(draw.choice("aaab"), day(a), 0, n, day(a + draw.choice((-1, 0, 1, 7, 63, 64, 400, 9000))), 1.0, 2.0, 3.0) for n, a in enumerate(draw.randrange(900) for _ in range(150))]
    values += [("a", day(3), 0, 900, None, 1.0, 2.0, 3.0), ("a", None, 0, 901, day(3), 1.0, 2.0, 3.0), (None, day(3), 0, 902, day(9), 1.0, 2.0, 3.0)]
    bars = [(k, day(n), 2.5) for k in "abc" for n in range(0, 1200, 7)] + [("a", None, 1.0)]
    v = spark.createDataFrame(values, "key string, effective_date date, effective_at int, seq int, target_date date, bear double, base double, bull double")
    got = {(r.key, r.bar_date): r.valuation_seq for r in tracking.as_of_valuation(spark.createDataFrame(bars, "key string, bar_date date, close double"), v, "key", most_pairs).collect()}
    best = lambda k, d: max(((x[1], x[3]) for x in values if d and x[0] == k and x[1] and x[4] and x[1] <= d <= x[4]), default=(None, None))[1]
    assert got == {(k, d): best(k, d) for k, d, _ in bars}


@pytest.mark.parametrize("most_pairs", [0, 10**9])
def test_repeated_bars_come_back_as_often(spark, most_pairs):
    day = lambda n: dt.date(2026, 1, n)
    bars = spark.createDataFrame([("k", day(5), 10.0)] * 3 + [("k", day(1), 10.0)] * 2 + [("k", None, 1.0), ("k", None, 1.0), (None, day(5), None)], "key string, bar_date date, close double")
    values = spark.createDataFrame([("k", day(2), 1, 1, day(30), 8.0, 12.0, 14.0), ("k", day(2), 1, 1, day(30), 8.0, 12.0, 14.0)], "key string, effective_date date, effective_at int, seq int, target_date date, bear double, base double, bull double")
    got = tracking.as_of_valuation(bars, values, "key", most_pairs)
    assert got.columns == ["key", "bar_date", "close", "valuation_seq", "upside", "downside", "reward_risk"]
    assert sorted(((r.key, r.bar_date, r.valuation_seq) for r in got.collect()), key=str) == sorted([("k", day(5), 1)] * 3 + [("k", day(1), None)] * 2 + [("k", None, None)] * 2 + [(None, day(5), None)], key=str)


def test_fingerprints_follow_order_and_nulls(spark):
    import hashlib

    h = lambda x: hashlib.sha256(x.encode()).hexdigest()
    data = [("a", 2, "x", None), ("a", 1, "y", "z"), (None, 1, "n", "n"), ("b", None, "", ""), ("b", 3, "q", "q")] + [("big", n, "t", str(n)) for n in range(30_000)]
    got = {r.k: r.fingerprint for r in catalog.fingerprint(spark.createDataFrame(data, "k string, o int, p string, q string").repartition(4), ["k"], ["o"], ["p", "q"]).collect()}
    want = {}
    for key in ("a", "b", None, "big"):
        mine = sorted((r for r in data if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0))
        want[key] = h("\0".join(h((p or "") + "\0" + (q or "")) for _, _, p, q in mine))
    assert got == want


def test_numbers_within_spans(spark):
    df = spark.createDataFrame([("a", 5), ("a", 1), ("a", 12), ("b", 7), ("a", None), (None, 3), ("a", 11), (None, 30)], "k string, o int")
    assert {(r.k, r.o): r._n for r in catalog.numbered_within(df, "k", "o", 4).collect()} == {("a", None): 1, ("a", 1): 2, ("a", 5): 3, ("a", 11): 4, ("a", 12): 5, ("b", 7): 1, (None, 3): 1, (None, 30): 2}


def test_as_of_valuation(spark):
    day = lambda n: dt.date(2026, 1, n)
    bars = spark.createDataFrame([("k", day(n), 10.0) for n in (1, 5, 9)], "key string, bar_date date, close double")
    values = spark.createDataFrame([("k", day(2), 1, 1, day(30), 8.0, 12.0, 14.0), ("k", day(4), 1, 2, day(6), 9.0, 11.0, 13.0), ("k", day(8), 1, 3, day(8), 9.0, 11.0, 13.0)], "key string, effective_date date, effective_at int, seq int, target_date date, bear double, base double, bull double")
    got = {r.bar_date.day: (r.valuation_seq, r.reward_risk) for r in tracking.as_of_valuation(bars, values, "key").collect()}
    assert got == {1: (None, None), 5: (2, 3.0), 9: (1, 2.0)}


def test_active_time(spark):
    df = spark.createDataFrame([("s", 1, 0, "user"), ("s", 2, 5, "assistant"), ("s", 3, 100, "user"), ("s", 4, 90, "assistant"), ("s", 5, 97, "assistant"), ("s", 6, None, "assistant")], "s string, n int, at long, role string")
    assert rows(sessions.active_time(df, ["s"], ["n"], "at", F.col("role") == "user")) == [("s", 12)]


def test_cache_waste(spark):
    data = [(1, 5000, 0, 5000, False), (2, 6000, 1000, 0, False), (3, 0, 0, 0, False), (4, 7000, 5500, 0, False), (5, 0, 0, 0, True), (6, 7000, 0, 0, False), (7, 7000, 0, 0, False)]
    df = spark.createDataFrame([("s", *d) for d in data], "s string, n int, prompt int, cache_read int, cache_write int, reset boolean")
    assert [r.missed for r in sessions.cache_waste(df, ["s"], ["n"]).orderBy("n").collect()] == [0, 4000, 0, 0, 0, 0, 0]


def test_labels_are_cleared_by_a_later_null(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "y")], "k string, seq int, v string")
    assert rows(sessions.latest_fact(df, ["k"], "v", "seq")) == [("b", "y")]


def test_compaction_and_stop_bounds(spark):
    df = spark.createDataFrame([("s", 1, "message", None), ("s", 2, "message", None), ("s", 3, "message", None), ("s", 4, "compaction", 3), ("s", 5, "message", None)], "s string, pos int, type string, first_kept int")
    got = sessions.compacted_context(df, ["s"], "pos").orderBy("position").collect()
    assert [r.pos for r in got] == [4, 3, 5]
    assert [r.pos for r in sessions.stop_bounded(df, ["s"], "pos", F.col("pos") == 3).orderBy("pos").collect()] == [3, 4, 5]


def test_catalog(spark):
    old = spark.createDataFrame([("a", "c1", 1, False), ("a", "c2", 2, True)], "logical string, checksum string, version_no int, is_current boolean")
    new = spark.createDataFrame([("a", "c2", 1), ("a", "c3", 2), ("b", "c9", 3)], "logical string, checksum string, ord int")
    assert rows(catalog.registered(old, new, "logical", "checksum")) == [("a", "c1", 1, False), ("a", "c2", 2, False), ("a", "c3", 3, True), ("b", "c9", 1, True)]
    table = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    more = spark.createDataFrame([(2, "z", 1), (2, "w", 2), (3, "q", 1)], "k int, v string, n int")
    assert rows(catalog.upserted(table, more, ["k"], ["n"])) == [(1, "x"), (2, "w"), (3, "q")]
    assert rows(catalog.inserted_if_absent(table, more, ["k"], ["n"])) == [(1, "x"), (2, "y"), (3, "q")]


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "y"), ("y", "x")], "src string, dst string")
    start = spark.createDataFrame([("a", "a")], "root string, node string")
    assert rows(graph.reach(edges, start)) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 1), ("a", "d", 2)]
    assert rows(graph.reach(edges, start, 1)) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 1)]
    assert rows(graph.on_cycles(edges)) == [("x",), ("y",)]
    assert {r.node: r.path for r in graph.shortest_paths(edges, start).collect()}["d"] == ["a", "c", "d"]


def test_deep_graphs_are_walked_to_the_end(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(23)], "src int, dst int").coalesce(1)
    start = spark.createDataFrame([(0, 0)], "root int, node int")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
    assert set(rows(graph.reach(chain, start))) == {(0, i, i) for i in range(24)}
    assert {r.node: r.path for r in graph.shortest_paths(chain, start).collect()}[23] == list(range(24))
    ring = chain.union(spark.createDataFrame([(23, 0)], "src int, dst int")).coalesce(1)
    assert set(rows(graph.on_cycles(ring))) == {(i,) for i in range(24)}


def test_histogram_pairs_and_diff(spark):
    df = spark.createDataFrame([("g", "a", 1.0), ("g", "b", 2.0), ("h", "a", 1.0), ("h", "a", 3.0)], "g string, side string, v double")
    assert rows(stats.paired(df, ["g"], "side", "a", "b", "v")) == [("g", 1.0, 2.0)]
    assert rows(stats.diagnostics(df, ["g"], "side", ["a", "b"])) == [("g", "a", 1, "ok"), ("g", "b", 1, "ok"), ("h", "a", 2, "duplicate"), ("h", "b", 0, "missing")]
    old, new = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string"), spark.createDataFrame([(1, "y"), (2, None), (4, "z")], "k int, v string")
    assert rows(stats.full_diff(old, new, ["k"], "v")) == [(1, "changed"), (2, "same"), (3, "removed"), (4, "added")]


def test_lines(spark):
    df = spark.createDataFrame([("p", "Alpha beta\n  BETA beta gamma\nnothing\nalpha")], "page string, text string")
    found = retrieval.matched_lines(df, "text", ["alpha", "beta"])
    assert [(r.line_no, r.offset, r.matched) for r in found.orderBy("line_no").collect()] == [(0, 1, ["alpha", "beta"]), (1, 1, ["beta"]), (3, 1, ["alpha"])]
    assert [r.line_no for r in retrieval.best_lines(found, ["page"], 2).orderBy("line_no").collect()] == [0, 1]


def test_walks_send_no_table_of_edges_to_the_driver(spark):
    size = "spark.sql.maxBroadcastTableSize"
    edges = spark.range(2, 3001).select(F.floor(F.col("id") / 2).alias("src"), F.col("id").alias("dst"))
    start = spark.range(1, 2).select(F.col("id").alias("root"), F.col("id").alias("node"))
    spark.conf.set(size, 20_000)  # a larger one is refused
    try:
        assert graph.reach(edges, start).agg(F.count("*"), F.sum("node"), F.max("depth")).first()[:] == (3000, 4501500, 11)
        assert graph.shortest_paths(edges, start).agg(F.count("*"), F.sum(F.size("path"))).first()[:] == (3000, sum(n.bit_length() for n in range(1, 3001)))
    finally:
        spark.conf.unset(size)
