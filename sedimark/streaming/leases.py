"""Jobs that workers take on leases, with heartbeats and a fencing number that refuses late results."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sedimark.functions.folds import folded

EVENT = ["at", "seq", "kind", "worker", "fence"]
OUT = "at long, seq long, kind string, outcome string, status string, attempts int, fence long, lease_until long"
STATE = "status string, attempts int, fence long, lease_until long, last_at long, last_seq long"


@dataclass
class Job:
    """queued, running, retry_wait, done or failed; fence is the number of the last lease."""

    status: str = "unknown"
    attempts: int = 0
    fence: int = 0
    lease_until: int = 0
    last_at: int = -(1 << 62)
    last_seq: int = -1

    def take(self, at: int, seq: int, kind: str, fence: int | None, lease_ms: int, most: int) -> str:
        """What comes of an event; the job changes."""
        self.last_at, self.last_seq = at, seq
        if self.status == "running" and at > self.lease_until:
            self.status = "failed" if self.attempts >= most else "retry_wait"
        if kind == "enqueue":
            if self.status != "unknown":
                return "known"
            self.status = "queued"
            return "queued"
        if kind == "claim":
            if self.status not in ("queued", "retry_wait"):
                return "busy" if self.status == "running" else "closed"
            self.status, self.attempts, self.fence, self.lease_until = "running", self.attempts + 1, self.fence + 1, at + lease_ms
            return "claimed"
        if self.status != "running" or fence != self.fence:
            return "refused"
        if kind == "heartbeat":
            self.lease_until = at + lease_ms
            return "renewed"
        if kind == "done":
            self.status = "done"
        elif kind == "failed":
            self.status = "failed" if self.attempts >= most else "retry_wait"
        else:
            return "refused"
        return "accepted"


def _outcomes(job: Job, events: Iterable[tuple], lease_ms: int, most: int) -> Iterator[tuple]:
    for at, seq, kind, fence in events:
        if (at, seq) > (job.last_at, job.last_seq):  # an event that comes again has had its outcome
            outcome = job.take(at, seq, kind, fence, lease_ms, most)
            yield at, seq, kind, outcome, job.status, job.attempts, job.fence, job.lease_until


def _usable(events: DataFrame) -> DataFrame:
    rows = events.select(F.col("job").cast("string").alias("job"), F.col("at").cast("long").alias("at"), F.col("seq").cast("long").alias("seq"), F.col("kind").cast("string").alias("kind"), F.col("fence").cast("long").alias("fence"))
    return rows.filter("job IS NOT NULL AND at IS NOT NULL AND seq IS NOT NULL")


def lease_outcomes(events: DataFrame, lease_ms: int, most: int = 3) -> DataFrame:
    """job, the event and what came of it, and the job's state after it, for each event (job, at, seq, kind, fence).

    kind is enqueue, claim, heartbeat, done or failed; the last three name the fence that the claim
    gave. A lease that wasn't renewed within lease_ms is over: the job waits again, or has failed
    after most attempts, and what its worker still sends is refused. Events are taken by
    at and seq; of those with the same ones the first counts. Any number of events of a job takes one
    state.
    """
    return folded(_usable(events), ["job"], ["at", "seq", "kind", "fence"], lambda rows: _outcomes(Job(), rows, lease_ms, most), OUT)


def lease_stream(events: DataFrame, lease_ms: int, most: int = 3) -> DataFrame:
    """lease_outcomes of a stream, whose events of a job come in order; its state is six numbers a job, so a restart goes on where it was."""

    def work(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        job = Job(*state.get) if state.exists else Job()
        rows = [r for f in frames for r in f[["at", "seq", "kind", "fence"]].itertuples(index=False, name=None)]
        rows.sort(key=lambda r: (r[0], r[1], r[2] or "", -1 if r[3] is None or r[3] != r[3] else r[3]))
        out = list(_outcomes(job, rows, lease_ms, most))
        state.update(tuple(int(x) if not isinstance(x, str) else x for x in astuple(job)))
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=["job", "at", "seq", "kind", "outcome", "status", "attempts", "fence", "lease_until"])

    return _usable(events).groupBy("job").applyInPandasWithState(work, f"job string, {OUT}", STATE, "append", GroupStateTimeout.NoTimeout)
