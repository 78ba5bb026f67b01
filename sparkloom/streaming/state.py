"""Keyed state over event streams: windows anchored at a key's first use, capped idle sessions, replay, live counts.

A key's events are walked in order by one task, as each step needs the one before; batches are handed on with the
state of the last key only, so a key of any length needs no more memory than a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkloom.operators.lifecycle import JOB_MOVES

# The status of a job after an operation; others leave it as it is.
JOB_RESULTS = {"markRunning": "running", "complete": "succeeded", "fail": "failed", "requeue": "queued", "cancel": "cancelled"}


def _walk(events: DataFrame, step: Callable, added: dict[str, str], more: dict[str, str] | None = None) -> DataFrame:
    """events (id, key, ms and the columns of `more`) with the columns that step(state, ms, *more) -> (state, values)
    adds; state starts as None."""
    names, more = list(added), more or {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, None
        for pdf in batches:
            out = []
            for key, ms, *own in zip(pdf["key"].tolist(), pdf["ms"].tolist(), *[pdf[c].tolist() for c in more]):
                if key != last:
                    last, held = key, None
                held, values = step(held, ms, *own)
                out.append(values)
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    ordered = events.where("key is not null and ms is not null").select("id", "key", "ms", *more).repartition("key").sortWithinPartitions("key", "ms", "id")
    return ordered.mapInPandas(run, "id long, key long, ms long, " + ", ".join(f"{n} {t}" for n, t in (more | added).items()))


def _admit(window_ms: int, burn_ms: int) -> Callable:
    def step(start, ms):
        if start is None or ms >= start + window_ms:
            start = ms
        return start, (start, ms < start + burn_ms)

    return step


def admissions(uses: DataFrame, window_ms: int, burn_ms: int) -> DataFrame:
    """(id, key, ms) uses against windows that start at the first use and restart at the first use after they lapse:
    adds window_start and admitted. Uses without a key or time are no uses."""
    return _walk(uses, _admit(window_ms, burn_ms), {"window_start": "long", "admitted": "boolean"})


def live_admissions(uses: DataFrame, window_ms: int, burn_ms: int) -> DataFrame:
    """The same over a stream: a key's window start is kept between micro-batches. Uses of one micro-batch are put in
    order; one that comes in a later batch than a younger use of its key is judged against the window as it is then."""
    step = _admit(window_ms, burn_ms)

    def fold(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start = state.get[0] if state.exists else None
        pdf = pd.concat(list(parts)).sort_values(["ms", "id"])
        out = []
        for ms in pdf["ms"].tolist():
            start, values = step(start, ms)
            out.append(values)
        state.update((start,))
        yield pdf.assign(window_start=[o[0] for o in out], admitted=[o[1] for o in out])[["id", "key", "ms", "window_start", "admitted"]]

    known = uses.where("key is not null and ms is not null").select("id", "key", "ms")
    return known.groupBy("key").applyInPandasWithState(fold, "id long, key long, ms long, window_start long, admitted boolean", "start long", "append", GroupStateTimeout.NoTimeout)


def capped_sessions(events: DataFrame, idle_ms: int, most_ms: int) -> DataFrame:
    """Sessions that end idle_ms after their last activity, and most_ms after their start at the latest; the first
    event after the end starts the next. Adds session_start and deadline as of each event."""
    most_ms = max(idle_ms, most_ms)

    def step(held, ms):
        if held is None or ms >= held[1]:
            held = (ms, ms + idle_ms)
        else:
            held = (held[0], min(ms + idle_ms, held[0] + most_ms))
        return held, held

    return _walk(events, step, {"session_start": "long", "deadline": "long"})


def throttled(events: DataFrame, gap_ms: int) -> DataFrame:
    """Adds kept: whether an event comes at least gap_ms after the last kept one of its key; the first one is."""

    def step(last, ms):
        kept = last is None or ms >= last + gap_ms
        return (ms if kept else last), (kept,)

    return _walk(events, step, {"kept": "boolean"})


def job_log(operations: DataFrame, max_attempts: int = 3) -> DataFrame:
    """A log of queue operations (id, key: the job, ms, op, token) with whether each was accepted, and the job's status
    and attempts after it. An operation on a job that is not there, from a status it is not allowed from, without
    attempts left or with another claim's token is refused and changes nothing."""

    def step(held, ms, op, token):
        status, claim, tries = held or (None, None, 0)
        if op == "enqueue":
            ok, after = status is None, ("queued", None, 0)
        elif op == "claim":
            ok, after = status == "queued" and tries < max_attempts, ("claimed", token, tries + 1)
        else:
            mine = op in ("requeue", "cancel") or token == claim or (op == "fail" and token is None)
            ok = status in JOB_MOVES.get(op, ()) and mine
            after = (JOB_RESULTS.get(op, status), None if op == "requeue" else claim, tries)
        held = after if ok else held
        return held, (ok, held[0] if held else None, held[2] if held else 0)

    return _walk(operations, step, {"accepted": "boolean", "status": "string", "attempt": "long"}, {"op": "string", "token": "string"})


def current_states(events: DataFrame, sticky: str = "aborted") -> DataFrame:
    """key and state: the last status by seq of events (key, seq, status), but `sticky` once it was there. One
    aggregation with partial counts, on a table or, in update or complete mode, on a stream."""
    last = F.when(F.bool_or(F.col("status") == sticky), sticky).otherwise(F.max_by("status", "seq"))
    return events.where("status is not null").groupBy("key").agg(last.alias("state"))


def fresh(rows: DataFrame, seen: str, now, ttl_ms: int) -> DataFrame:
    """Rows that were last seen at most ttl_ms ago; a row that never was is gone."""
    return rows.where(F.unix_millis(now) - F.unix_millis(F.col(seen)) <= ttl_ms)


def replay(events: DataFrame, since: int, retained: int = 10_000) -> DataFrame:
    """Events after a sequence number, as far back as the log retains."""
    last = events.agg(F.max("seq")).first()[0] or 0
    return events.where(F.col("seq") > max(since, last - retained))


def live_counts(stream: DataFrame, late: str = "10 minutes", every: str = "5 minutes") -> DataFrame:
    """Events by type in tumbling windows, with a watermark; works on a stream and on a table."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"))
