"""Sessions and queue jobs as state machines over their logs, worked out by composing moves (`operators.ranges`).

A log is (id, key, ms, op, ...) in order of (ms, id) within a key; rows without a key or time are no events. An operation on
a thing that is not there, or from a status that does not allow it, is refused and changes nothing. Times that a status
leaves behind are aggregates over the accepted rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.lifecycle import JOB_MOVES, SESSION_MOVES
from sparkloom.operators.ranges import ANY, Machine, walked
from sparkloom.streaming.state import JOB_RESULTS

# Statuses of a session, those that end it, and what an operation makes of it.
SESSION_STATUSES = ["prepared", "queued", "starting", "running", "waiting_for_input", "completed", "failed", "cancelled", "lost"]
SESSION_ENDS = ["completed", "failed", "cancelled", "lost"]
SESSION_RESULTS = {"linkQueueJob": "queued", "fail": "failed", "markLost": "lost", "cancel": "cancelled"}
JOB_ENDS = ["succeeded", "failed", "cancelled"]


class Session(Machine):
    """Events are (op, to): `updateStatus` sets any known status, also after the end."""

    def entries(self):
        return [(s, 0, None) for s in ["", *SESSION_STATUSES]]

    def step(self, state, event):
        (status, _, _), (op, to) = state, event
        if op == "prepare":
            after = "prepared" if status == "" else None
        elif status == "":
            after = None
        elif op == "updateStatus":
            after = to if to in SESSION_STATUSES else None
        else:
            after = SESSION_RESULTS.get(op, status) if status in SESSION_MOVES.get(op, ()) else None
        now = after or status
        return (now, 0, None), (after is not None, now or None)


class Job(Machine):
    """Events are (op, token, due). A claim takes a queued job with attempts left and hands out its token; `claimNext` takes it
    only when it is due, `claimById` at any time. A job that was put back is due at once."""

    def __init__(self, most: int = 3) -> None:
        self.most = most

    def entries(self):
        some = [("", 0, None), *[(s, 0, None) for s in JOB_ENDS]]
        return some + [(s, n, m) for n in range(self.most + 1) for s, m in (("queued", None), ("requeued", None), ("claimed", ANY), ("running", ANY))] + [(s, n, None) for n in range(1, self.most + 1) for s in JOB_ENDS]

    def mark(self, event):
        op, token, _ = event
        return token if op in ("markRunning", "heartbeat", "complete", "fail") else None

    def step(self, state, event):
        (status, tries, mark), (op, token, due) = state, event
        after = None
        if op == "enqueue":
            after = ("queued", 0, None) if status == "" else None
        elif op in ("claimNext", "claimById"):
            if status in ("queued", "requeued") and tries < self.most and (op == "claimById" or status == "requeued" or due is True):
                after = "claimed", tries + 1, token
        elif ("queued" if status == "requeued" else status) in JOB_MOVES.get(op, ()):
            if op in ("requeue", "cancel") or (token is not None and token == mark) or (op == "fail" and token is None):
                to = "requeued" if op == "requeue" else JOB_RESULTS.get(op, status)
                after = to, tries, None if to in JOB_ENDS or to == "requeued" else mark
        now = after or state
        return now, (after is not None, "queued" if now[0] == "requeued" else now[0] or None, now[1])


def _known(log: DataFrame) -> DataFrame:
    return log.where("key is not null and ms is not null")


def session_log(log: DataFrame) -> DataFrame:
    """A session log (id, key, ms, op, to, ...) with accepted and status after it."""
    return walked(_known(log), Session(), ["op", "to"], {"accepted": "boolean", "status": "string"})


def _last(value, when):
    return F.max_by(F.when(when, value), F.when(when, F.struct("ms", "id")))


def session_stamps(moved: DataFrame) -> DataFrame:
    """One row a session that was prepared: its status, the times of its moves, why it failed, and refused operations.
    A session starts once; it ends anew with every move to an end, and a move away from one leaves the time there."""
    ok, op, run = F.col("accepted"), F.col("op"), (F.col("op") == "updateStatus") & (F.col("to") == "running")
    ends = ok & op.isin("updateStatus", "fail", "markLost", "cancel") & F.col("status").isin(SESSION_ENDS)
    at = lambda f, when: f(F.when(when, F.col("ms")))
    out = moved.groupBy("key").agg(
        at(F.min, ok & (op == "prepare")).alias("prepared_at"),
        at(F.max, ok & (op == "linkQueueJob")).alias("queued_at"),
        at(F.min, ok & run).alias("started_at"),
        at(F.max, ok & (run | (op == "heartbeat"))).alias("last_heartbeat_at"),
        at(F.max, ends).alias("completed_at"),
        _last(op, ok & op.isin("fail", "markLost")).alias("failed_by"),
        _last(F.col("status"), ok).alias("status"),
        F.count_if(~ok).alias("refused"),
    )
    return out.where("prepared_at is not null")


def job_log(log: DataFrame, most: int = 3) -> DataFrame:
    """A queue's log (id, key, ms, op, token, run_after, ...) with accepted, status and attempt after it. A job is due from
    the run_after of its first enqueue on; none is the time of the enqueue itself."""
    known = _known(log)
    first = known.where("op = 'enqueue'").groupBy("key").agg(F.min_by(F.coalesce("run_after", "ms"), F.struct("ms", "id")).alias("_due"))
    met = known.join(first, "key", "left").withColumn("due", F.coalesce(F.col("ms") >= F.col("_due"), F.lit(False))).drop("_due")
    return walked(met, Job(most), ["op", "token", "due"], {"accepted": "boolean", "status": "string", "attempt": "long"})


def job_stamps(moved: DataFrame) -> DataFrame:
    """One row a job that was enqueued: status, attempt and times; putting a job back takes its claim and heartbeat away."""
    ok, op = F.col("accepted"), F.col("op")
    claim = op.isin("claimNext", "claimById")
    of = lambda kinds: _last(F.when(op != "requeue", F.col("ms")), ok & (kinds | (op == "requeue")))
    return moved.groupBy("key").agg(
        _last(F.col("status"), ok).alias("status"),
        _last(F.col("attempt"), ok).alias("attempt"),
        F.min(F.when(ok & (op == "enqueue"), F.col("ms"))).alias("created_at"),
        of(claim).alias("claimed_at"),
        of(claim | op.isin("markRunning", "heartbeat")).alias("heartbeat_at"),
        F.max(F.when(ok & op.isin("complete", "fail", "cancel"), F.col("ms"))).alias("completed_at"),
        F.count_if(~ok).alias("refused"),
    ).where("created_at is not null")
