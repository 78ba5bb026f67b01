"""Logs walked by ranges against a plain walk, with hot keys and many ranges."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import ranges
from sparkloom.streaming import machines

RNG = random.Random(3)


def plain(machine, rows, columns):
    """rows: dicts in any order."""
    state, out = {}, {}
    for r in sorted((r for r in rows if r["key"] is not None and r["ms"] is not None), key=lambda r: (r["ms"], r["id"])):
        state[r["key"]], out[r["id"]] = machine.step(state.get(r["key"], machine.START), tuple(r[c] for c in columns))
    return out


def session_rows(n, keys):
    ops = ["prepare", "updateStatus", "updateStatus", "linkQueueJob", "heartbeat", "fail", "markLost", "cancel", "unknown"]
    return [{"id": i, "key": RNG.choice(keys), "ms": RNG.randrange(n // 2), "op": RNG.choice(ops), "to": RNG.choice([*machines.SESSION_STATUSES, "odd", None])} for i in range(n)]


@pytest.fixture()
def many(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_sessions_equal_a_walk(spark, many):
    rows = session_rows(3000, [0] * 30 + list(range(40)) + [None])
    table = spark.createDataFrame(rows, "id long, key long, ms long, op string, to string")
    moved = machines.session_log(table).cache()
    want = plain(machines.Session(), rows, ["op", "to"])
    assert {r["id"]: (r["accepted"], r["status"]) for r in moved.collect()} == want
    stamps = {r["key"]: r for r in machines.session_stamps(moved).collect()}
    for key in {r["key"] for r in rows if r["key"] is not None}:
        held = None  # a session as its store keeps it
        for r in sorted((r for r in rows if r["key"] == key), key=lambda r: (r["ms"], r["id"])):
            ok, status = want[r["id"]]
            if not ok:
                continue
            if r["op"] == "prepare":
                held = dict.fromkeys(["queued_at", "started_at", "last_heartbeat_at", "completed_at"]) | {"prepared_at": r["ms"]}
            elif r["op"] == "updateStatus":
                if status == "running":
                    held["started_at"] = held["started_at"] if held["started_at"] is not None else r["ms"]
                    held["last_heartbeat_at"] = r["ms"]
                if status in machines.SESSION_ENDS:
                    held["completed_at"] = r["ms"]
            elif r["op"] == "linkQueueJob":
                held["queued_at"] = r["ms"]
            elif r["op"] == "heartbeat":
                held["last_heartbeat_at"] = r["ms"]
            else:
                held["completed_at"] = r["ms"]
            held["status"] = status
        assert (key in stamps) == (held is not None)
        if held:
            assert {k: stamps[key][k] for k in held} == held


def job_rows(n, keys):
    ops = ["enqueue", "claimNext", "claimById", "markRunning", "heartbeat", "complete", "fail", "requeue", "requeue", "cancel"]
    weights = [3, 5, 3, 6, 6, 1, 1, 3, 3, 0.3]
    return [{"id": i, "key": RNG.choice(keys), "ms": RNG.randrange(n // 2), "op": RNG.choices(ops, weights)[0], "token": RNG.choice(["a", "b", "c", None]), "run_after": RNG.choice([None, RNG.randrange(n)])} for i in range(n)]


@pytest.mark.parametrize("most", [1, 3, 50])
def test_jobs_equal_a_walk(spark, many, most):
    rows = job_rows(3000, [0] * 30 + list(range(30)))
    table = spark.createDataFrame(rows, "id long, key long, ms long, op string, token string, run_after long")
    first = {}
    for r in sorted(rows, key=lambda r: (r["ms"], r["id"])):
        if r["op"] == "enqueue":
            first.setdefault(r["key"], r["run_after"] if r["run_after"] is not None else r["ms"])
    for r in rows:
        r["due"] = r["key"] in first and r["ms"] >= first[r["key"]]
    want = plain(machines.Job(most), rows, ["op", "token", "due"])
    moved = machines.job_log(table, most)
    assert {r["id"]: (r["accepted"], r["status"], r["attempt"]) for r in moved.collect()} == want
    for s in machines.job_stamps(moved).collect():
        claimed = None
        for r in sorted((r for r in rows if r["key"] == s["key"]), key=lambda r: (r["ms"], r["id"])):
            if want[r["id"]][0]:
                claimed = r["ms"] if r["op"].startswith("claim") else None if r["op"] == "requeue" else claimed
        assert s["claimed_at"] == claimed


def test_one_key_uses_all_tasks(spark, many):
    """A million events of one key lie on every range, none of which holds much more than its share."""
    n = 1_000_000
    log = spark.range(n).select("id", F.lit(1).alias("key"), F.col("id").alias("ms"), F.element_at(F.array(*map(F.lit, ["prepare", "linkQueueJob", "updateStatus", "heartbeat", "heartbeat"])), (F.col("id") % 5 + 1).cast("int")).alias("op"), F.when(F.col("id") % 2 == 0, "running").otherwise("prepared").alias("to"))
    moved = machines.session_log(log)
    sizes = [r["count"] for r in moved.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 23 and max(sizes) < 3 * n / 23
    got = moved.agg(F.count_if("accepted").alias("ok"), F.max_by("status", "id").alias("status")).first()
    state, ok = machines.Session.START, 0
    ops = ["prepare", "linkQueueJob", "updateStatus", "heartbeat", "heartbeat"]
    for i in range(n):
        state, (accepted, _) = machines.Session().step(state, (ops[i % 5], "running" if i % 2 == 0 else "prepared"))
        ok += accepted
    assert tuple(got) == (ok, state[0])


def test_runs_compose():
    """What two runs make of a state, one after another, is what the whole makes of it."""
    job = machines.Job(3)
    for _ in range(200):
        events = [(r["op"], r["token"], RNG.random() < 0.5) for r in job_rows(30, [0])]
        cut = RNG.randrange(len(events))
        parts = []
        for part in (events[:cut], events[cut:]):
            run = ranges.Run(job)
            for e in part:
                run.add(e)
            parts.append(run.ends())
        for start in [("", 0, None), ("running", 1, "a"), ("claimed", 2, "never named")]:
            state = start
            for e in events:
                state = job.step(state, e)[0]
            assert ranges.left(parts[1], ranges.left(parts[0], start)) == state


def test_no_events(spark):
    table = spark.createDataFrame([], "id long, key long, ms long, op string, to string")
    assert machines.session_log(table).count() == 0
