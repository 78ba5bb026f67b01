"""Streams against tables: buffers, firsts, runs, frames, the log and its replay."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import levels, ranges
from sparkloom.sources import framing, log
from sparkloom.streaming import buffers

RNG = random.Random(8)
T0 = 1_700_000_000_000


def streamed(spark, tmp_path, rows, schema, build, parts, watermark="2 hours"):
    """Rows of build(stream) after feeding `parts` files one after another, restarted between them."""
    source, name = tmp_path / "in", f"t{RNG.randrange(10**9)}"
    source.mkdir()
    size = -(-len(rows) // parts)
    for k in range(parts):
        table = spark.createDataFrame(rows[k * size : (k + 1) * size], schema)
        if "ms" in table.columns:
            table = table.withColumn("ts", F.timestamp_millis("ms"))
        table.coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(table.schema).parquet(str(source))
        if watermark and "ms" in table.columns:
            stream = stream.withWatermark("ts", watermark)
        out = build(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert out.awaitTermination(120)
        assert out.exception() is None
    return spark.read.parquet(str(tmp_path / "out"))


OPS = "key long, id long, ms long, op string, message string"


def ops(n, keys):
    ms, out = T0, []
    for i in range(n):
        ms += RNG.choice([0, 1, 500, 60_000, 900_000])
        out.append((RNG.randrange(keys), i, ms, RNG.choices(["push", "drain", "touch"], [6, 3, 1])[0], f"m{i}"))
    return out


def plain_drains(rows, ttl):
    held, last, out = {}, {}, []
    for key, i, ms, op, message in sorted(rows, key=lambda r: (r[2], r[1])):
        if key in last and ms - last[key] > ttl:
            held[key] = []
        last[key] = ms
        if op == "push":
            held.setdefault(key, []).append(message)
        elif op == "drain":
            out.append((key, i, ms, held.pop(key, [])))
    return sorted(out)


def as_tuples(df, columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_drains(spark, tmp_path):
    rows = ops(300, 5) + [(None, 900, T0, "push", "x"), (1, 901, None, "push", "x")]
    want = plain_drains(rows[:300], 3_600_000)
    columns = ["key", "id", "ms", "messages"]
    assert as_tuples(buffers.drains(spark.createDataFrame(rows, OPS)), columns) == want and any(len(w[3]) > 2 for w in want)
    assert buffers.drains(spark.createDataFrame([], OPS)).count() == 0
    assert as_tuples(streamed(spark, tmp_path, rows[:300], OPS, buffers.live_drains, 3), columns) == want


def test_buffers_are_freed(spark, tmp_path):
    """A session that nothing touches for an hour loses its messages by the timer, before anything comes again."""
    rows = [(1, 0, T0, "push", "a"), (2, 1, T0 + 60_000, "push", "b"), (2, 2, T0 + 20_000_000, "touch", None), (2, 3, T0 + 40_000_000, "touch", None), (1, 4, T0 + 40_000_001, "drain", None)]
    got = streamed(spark, tmp_path, rows, OPS, lambda s: buffers.live_drains(s), 5, "1 second")
    assert as_tuples(got, ["key", "id", "messages"]) == [(1, 4, [])]


SNAP = "scan long, ms long, findings array<struct<id: string, what: string>>"


def test_first_findings(spark, tmp_path):
    rows = []
    for n in range(12):  # each snapshot holds all findings so far
        for scan in (1, 2):
            rows.append((scan, T0 + n * 60_000, [(f"{scan}-{k // 2}", f"w{scan}{k // 2}") for k in range(n)] + [(None, "no id")]))
    want = sorted({(s, f[0], f[1]) for s, _, found in rows for f in found if f[0]})
    late = rows + [(1, T0 + 11 * 60_000, rows[-2][2])]
    pick = lambda df: sorted((r["scan"], r["finding_id"], r["finding"]["what"]) for r in df.collect())
    table = spark.createDataFrame(late, SNAP).withColumn("ts", F.timestamp_millis("ms"))
    assert pick(buffers.first_findings(table)) == want
    assert pick(streamed(spark, tmp_path, late, SNAP, lambda s: buffers.first_findings(s, "2 hours"), 4, None)) == want


DECIDED = "key long, decision string, id long, ms long, transport string"


def test_two_transports(spark, tmp_path):
    rows = [(RNG.randrange(6), f"d{RNG.randrange(8)}", i, T0 + i * 1000 + RNG.randrange(1000), RNG.choice(["http", "socket"])) for i in range(200)]
    rows.sort(key=lambda r: r[3])
    first = {}
    for r in sorted(rows, key=lambda r: (r[3], r[2])):
        first.setdefault((r[0], r[1]), r)
    want = sorted((k, d, i, ms, t) for k, d, i, ms, t in first.values())
    columns = ["key", "decision", "id", "ms", "transport"]
    table = spark.createDataFrame(rows, DECIDED)
    parts = lambda s: [s.where("transport = 'http'"), s.where("transport = 'socket'")]
    assert as_tuples(buffers.firsts(parts(table)), columns) == want
    assert as_tuples(streamed(spark, tmp_path, rows, DECIDED, lambda s: buffers.live_firsts(parts(s)), 3), columns) == want


TYPED = "key long, id long, ms long, type string"


def plain_runs(rows, types, most, wait):
    out, n = [], {}
    for key in sorted({r[0] for r in rows}):
        run = []
        for _, i, ms, kind in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
            if run and (kind != run[0][2] or ms - run[0][1] >= wait or len(run) >= most or run[0][2] not in types):
                out.append((key, [r[0] for r in run]))
                run = []
            run.append((i, ms, kind))
        if run:
            out.append((key, [r[0] for r in run]))
    return out


def test_runs_keep_the_order(spark, tmp_path):
    rows = [(RNG.randrange(3), i, T0 + 100 * i, RNG.choice(["log", "log", "log", "cost", "state"])) for i in range(240)]
    want = plain_runs(rows, ["log", "cost"], 4, 1_000)
    end = [(k, 1000 + k + 3 * j, T0 + 50_000_000 * (j + 1), "state") for j in range(2) for k in range(3)]  # moves the watermark on
    got = streamed(spark, tmp_path, rows + end, TYPED, lambda s: buffers.live_runs(s, ["log", "cost"], 4, 1_000), 6, "1 second").orderBy("key", "n").collect()
    got = [(r["key"], r["ids"]) for r in got if r["ids"][0] < 1000]
    assert got == want
    for key in range(3):
        assert [i for k, ids in got if k == key for i in ids] == [r[1] for r in rows if r[0] == key]
    assert max(len(ids) for _, ids in got) == 4


def test_a_run_that_nothing_follows_is_flushed(spark, tmp_path):
    rows = [(1, 0, T0, "log"), (1, 1, T0 + 10, "log"), (2, 2, T0 + 90_000, "state"), (2, 3, T0 + 190_000, "state")]
    got = streamed(spark, tmp_path, rows, TYPED, lambda s: buffers.live_runs(s, ["log"]), 4, "1 second").collect()
    assert [(r["key"], r["ids"]) for r in got if r["key"] == 1] == [(1, [0, 1])]


# -- frames


def chunks(text: bytes, cuts):
    at = [0, *sorted(cuts), len(text)]
    return [text[a:b] for a, b in zip(at, at[1:])]


TEXT = "größer\r\n\r\n  \n{\"a\": \"日本\"}\nlast € without end".encode()


def test_any_cutting_gives_the_same_lines(spark):
    want = [(0, "größer"), (3, '{"a": "日本"}'), (4, "last € without end")]
    rows = []
    for s in range(60):
        for seq, c in enumerate(chunks(TEXT, [RNG.randrange(len(TEXT) + 1) for _ in range(s % 30)])):
            rows.append((s, seq, c))
    rows += [(100, i, bytes([b])) for i, b in enumerate(TEXT)] + [(101, 0, None), (102, 0, b"\n"), (103, 0, b"a\xff\nb")]
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    got = {}
    for r in framing.framed(spark.createDataFrame(rows, "stream long, seq long, data binary")).collect():
        got.setdefault(r["stream"], []).append((r["n"], r["line"]))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {s: sorted(v) for s, v in got.items()} == {s: want for s in [*range(60), 100]} | {103: [(0, "a�"), (1, "b")]}


def test_frames_of_a_stream(spark, tmp_path):
    rows = []
    for s in range(6):
        parts = chunks(TEXT, [RNG.randrange(len(TEXT) + 1) for _ in range(7)])
        rows += [(s, i, c, i == len(parts) - 1) for i, c in enumerate(parts)]
    RNG.shuffle(rows)  # chunks that come too soon wait
    got = streamed(spark, tmp_path, rows, "stream long, seq long, data binary, last boolean", framing.live_framed, 3)
    want = sorted((s, n, line) for s in range(6) for n, line in [(0, "größer"), (3, '{"a": "日本"}'), (4, "last € without end")])
    assert as_tuples(got, ["stream", "n", "line"]) == want


# -- log


def test_commits(spark, tmp_path):
    path = str(tmp_path / "log")
    log.append(spark.range(10).selectExpr("concat('a', id % 3) id", "id + 1 seq", "concat('v', id) value").repartition(3), path, "one")
    log.append(spark.range(5).selectExpr("'x' id", "id + 50 seq", "'other' value"), path, "one")  # the same commit again
    assert as_tuples(log.rows(spark, path), ["seq"]) == [(i + 1,) for i in range(10)]
    broken = spark.range(20).repartition(4).selectExpr("'b' id", "id + 11 seq", "CASE WHEN id = 7 THEN raise_error('lost') ELSE 'v' END value")
    with pytest.raises(Exception, match="lost"):
        log.append(broken, path, "two")
    assert log.rows(spark, path).count() == 10 and not os.path.exists(f"{path}/commits/two.json")
    log.append(spark.range(1).selectExpr("'b' id", "11 seq", "'v' value"), path, "two")
    assert log.index(path) == (["a0", "a1", "a2", "b"], "two")
    assert as_tuples(log.documents(log.rows(spark, path)), ["id", "value"]) == [("a0", "v9"), ("a1", "v7"), ("a2", "v8"), ("b", "v")]
    assert not [f for f in os.listdir(f"{path}/commits") if f.startswith(".")]


def ran(frame, tmp_path, once=None):
    """Rows and batch sizes of a replay that is stopped when it has all there is."""
    seen = []
    q = frame.writeStream.foreachBatch(lambda df, n: seen.append([r["seq"] for r in df.collect()])).option("checkpointLocation", str(tmp_path / "r")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return [s for s in seen if s]


def test_replay(spark, tmp_path):
    path = str(tmp_path / "log")
    add = lambda a, b: log.append(spark.range(a, b + 1).selectExpr("'e' id", "id seq", "'v' value").repartition(3), path)
    add(1, 250)
    got = ran(log.replayed(spark, path), tmp_path)
    assert sum(got, []) == list(range(1, 251)) and max(map(len, got)) == 100
    add(251, 380)
    assert sum(ran(log.replayed(spark, path), tmp_path), []) == list(range(251, 381))  # nothing lost, nothing again
    assert ran(log.replayed(spark, path), tmp_path) == []


def test_replay_behind_the_ring(spark, tmp_path):
    path = str(tmp_path / "log")
    log.append(spark.range(1, 501).selectExpr("'e' id", "id seq", "'v' value"), path)
    assert sum(ran(log.replayed(spark, path, since=30, retained=120, most=50), tmp_path), []) == list(range(381, 501))


def test_live_append(spark, tmp_path):
    path, source = str(tmp_path / "log"), str(tmp_path / "src")
    for k in range(2):
        spark.range(5 * k, 5 * k + 5).selectExpr("concat('k', id) id", "id seq", "'v' value").coalesce(1).write.mode("append").parquet(source)
        q = log.live_append(spark.readStream.schema("id string, seq long, value string").parquet(source), path, str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
    assert as_tuples(log.rows(spark, path), ["seq"]) == [(i,) for i in range(10)]
    done = log._StreamWriter({"path": path})  # the second batch once more, as after a lost driver
    done.commit([done.write(iter([{"id": "z", "seq": 99, "value": "v"}]))], 1)
    assert log.rows(spark, path).count() == 10
    assert all(json.load(open(f"{path}/commits/{f}")) for f in os.listdir(f"{path}/commits") if f.endswith(".json"))


def test_fan_out(spark):
    events = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, None, "z")], "seq long, mission string, value string")
    wants = spark.createDataFrame([("p", "a"), ("q", None), ("q", "a"), ("r", "c"), (None, None), ("p", "a")], "subscriber string, mission string")
    assert as_tuples(log.fanned_out(events, wants), ["subscriber", "seq"]) == [("p", 1), ("q", 1), ("q", 2), ("q", 3)]


# -- levels


def test_levels(spark):
    rows = [(RNG.choice("ab"), s, RNG.choice([None, s + RNG.randrange(-1, 30)])) for s in (RNG.randrange(100) for _ in range(300))] + [("a", None, 5)]
    spans = spark.createDataFrame(rows, "route string, start long, end long")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    got = as_tuples(levels.levels(spans, ["route"]), ["route", "at", "level"])
    gauge = as_tuples(levels.gauges(spans, ["route"], F.lit(60)), ["route", "highest", "at", "current"])
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    good = [(r, s, e) for r, s, e in rows if s is not None and (e is None or e >= s)]
    level = lambda route, at: sum(r == route and s <= at and (e is None or at < e) for r, s, e in good)
    times = sorted({(r, t) for r, s, e in good for t in (s, e) if t is not None})
    assert got == [(r, t, level(r, t)) for r, t in times]
    for route, highest, at, current in gauge:
        assert highest == max(lv for r, _, lv in got if r == route) and at == min(t for r, t, lv in got if r == route and lv == highest) and current == level(route, 60)


def plain_sessions(rows, idle, most):
    """Step by step, with the timer that is set again while a call is open."""
    out = {}
    for key in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0]))
        span = {}
        for _, _, ms, op, call in own:
            if call is not None and op == "start":
                span.setdefault(call, [ms, None])
        for _, _, ms, op, call in own:
            if op == "end" and call in span and span[call][1] is None and ms >= span[call][0]:
                span[call][1] = ms
        start = fire = None
        for i, _, ms, op, call in own:
            if start is None or ms >= fire:
                start, fire, calls = ms, ms, []
            if op == "start" and call is not None and span[call][0] == ms:
                calls.append(span[call])
            fire = max(fire, ms + idle, *[(start + most if e is None else e + idle) for s, e in calls])
            fire = min(fire, start + most)
            out[i] = (start, fire)
    return out


def test_open_calls_keep_sessions(spark):
    rows = []
    for i in range(900):
        call = RNG.choice([None, None, f"c{RNG.randrange(250)}"])
        rows.append((i, RNG.choice([0, 0, 0, 1, 2]), 10 * i + RNG.choice([0, 0, 40, 400]), "note" if call is None else RNG.choice(["start", "end"]), call))
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    for idle, most in ((60, 400), (15, 10_000), (300, 300)):
        got = levels.kept_sessions(spark.createDataFrame(rows, "id long, key long, ms long, op string, call string"), idle, most)
        assert {r["id"]: (r["session_start"], r["deadline"]) for r in got.collect()} == plain_sessions(rows, idle, most)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_running_values_over_ranges(spark):
    rows = [(RNG.choice(["a", "b", None]), i, RNG.choice([None, RNG.randrange(50)])) for i in range(400)]
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    dealt = ranges.dealt(spark.createDataFrame(rows, "key string, i long, v long"), ["key"], ["i"])
    got = {(r["key"], r["i"]): (r["s"], r["h"]) for r in ranges.running(dealt, ["key"], ["i"], {"s": "v"}, {"h": "v"}).collect()}
    before = {(r["key"], r["i"]): (r["s"], r["h"]) for r in ranges.running(dealt, ["key"], ["i"], {"s": "v"}, {"h": "v"}, inclusive=False).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    for key in ("a", "b", None):
        own = [(i, v) for k, i, v in rows if k == key]
        for n, (i, _) in enumerate(own):
            upto, less = ([v for _, v in own[:m] if v is not None] for m in (n + 1, n))
            assert got[key, i] == (sum(upto), max(upto, default=None)) and before[key, i] == (sum(less), max(less, default=None))
