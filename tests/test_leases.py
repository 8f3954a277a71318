"""Leases: expiry, renewal, stale results, replays; a stream gives what the batch gives."""

import random

from sedimark.streaming import feeds, leases

EVENTS = "job string, at long, seq long, kind string, fence long"


def outcomes(spark, *events):
    rows = [("j", at, n, kind, fence) for n, (at, kind, fence) in enumerate(events)]
    got = leases.lease_outcomes(spark.createDataFrame(rows, EVENTS), lease_ms=10, most=2).orderBy("at", "seq").collect()
    return [(r.outcome, r.status, r.fence) for r in got]


def test_a_lease_is_renewed_and_ends(spark):
    got = outcomes(spark, (0, "claim", None), (1, "enqueue", None), (2, "claim", None), (3, "claim", None), (12, "heartbeat", 1), (22, "heartbeat", 1), (33, "heartbeat", 1), (34, "claim", None), (35, "done", 1), (36, "done", 2), (37, "claim", None), (38, "enqueue", None))
    assert got == [("closed", "unknown", 0), ("queued", "queued", 0), ("claimed", "running", 1), ("busy", "running", 1), ("renewed", "running", 1), ("renewed", "running", 1), ("refused", "retry_wait", 1), ("claimed", "running", 2), ("refused", "running", 2), ("accepted", "done", 2), ("closed", "done", 2), ("known", "done", 2)]


def test_attempts_run_out(spark):
    assert outcomes(spark, (0, "enqueue", None), (1, "claim", None), (2, "failed", 1), (3, "claim", None), (14, "done", 2), (15, "claim", None), (16, "nonsense", 2), (17, "done", None)) == [
        ("queued", "queued", 0), ("claimed", "running", 1), ("accepted", "retry_wait", 1), ("claimed", "running", 2), ("refused", "failed", 2), ("closed", "failed", 2), ("refused", "failed", 2), ("refused", "failed", 2),
    ]


def test_a_stream_in_any_split_gives_the_same(spark, tmp_path):
    rng, folder = random.Random(3), f"file://{tmp_path}"
    rows = [(f"j{n % 4}", n // 4 * 3, n, rng.choice(["claim", "claim", "heartbeat", "done", "failed", "enqueue"]), rng.choice([None, 1, 2, 3])) for n in range(160)]
    rows = [(f"j{k}", -1, -1, "enqueue", None) for k in range(4)] + rows
    want = {tuple(r) for r in leases.lease_outcomes(spark.createDataFrame(rows + rows[:9] + [(None, 1, 1, "claim", None), ("j0", None, 1, "claim", None)], EVENTS), 10).collect()}
    assert len(want) == len(rows) and {r[4] for r in want} > {"claimed", "refused", "accepted"}
    for n, (a, b) in enumerate([(0, 30), (20, 90), (90, 164)]):  # some events come again
        spark.createDataFrame(rows[a:b], EVENTS).repartition(2).write.parquet(f"{folder}/in/{n}")
        stream = feeds.read_stream(spark, f"{folder}/in/*", spark.createDataFrame([], EVENTS).schema)
        feeds.drained(leases.lease_stream(stream, 10), feeds.parquet_sink(f"{folder}/out"), f"{folder}/state")
    got = spark.read.parquet(f"{folder}/out").drop("batch").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert leases.lease_outcomes(spark.createDataFrame([], EVENTS), 10).collect() == []
