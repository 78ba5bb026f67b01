"""Keyed state with lists, maps and expiry: messages buffered for a session, firsts of several deliveries, and runs of
events that are flushed together. Each has a plan over a table and one over a stream that gives the same rows.

Streams keep their state in Spark's state store by `transformWithState`: lists for what waits, maps for what was seen,
and timers that free both. Events of one micro-batch are put in order of (ms, id); what comes in a later micro-batch than a
younger event is taken as it arrives. Times are event times; the caller sets the watermark, which also says when timers are due.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sparkloom.operators.ranges import dealt, running

HOUR_MS = 3_600_000
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_store(spark: SparkSession) -> SparkSession:
    """Lists, maps and timers need the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    return spark


class _Keyed(StatefulProcessor):
    """Rows of a key in order, and one timer, which moves with the key's last access."""

    def rows(self, parts: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        pdf = pd.concat(list(parts)).sort_values(["ms", "id"], kind="stable")
        return pdf.itertuples(index=False)

    def wake(self, handle: StatefulProcessorHandle, at: int) -> None:
        for t in list(handle.listTimers()):
            handle.deleteTimer(t if isinstance(t, int) else t[0])
        handle.registerTimer(at)

    def close(self) -> None:
        pass


# -- messages of a session ---------------------------------------------------------------------------------------


class _Bus(_Keyed):
    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle):
        self.handle = handle
        self.waiting = handle.getListState("waiting", "message string")
        self.touched = handle.getValueState("touched", "ms long")

    def handleInputRows(self, key, rows, timerValues):
        last = self.touched.get()[0] if self.touched.exists() else None
        held = [m for (m,) in self.waiting.get()] if self.waiting.exists() else []
        out = []
        for r in self.rows(rows):
            if last is not None and r.ms - last > self.ttl_ms:
                held = []
            last = r.ms
            if r.op == "push":
                held.append(r.message)
            elif r.op == "drain":
                out.append((key[0], r.id, r.ms, held))
                held = []
        self.touched.update((last,))
        if held:
            self.waiting.put([(m,) for m in held])
        else:
            self.waiting.clear()
        self.wake(self.handle, last + self.ttl_ms + 1)
        yield pd.DataFrame(out, columns=["key", "id", "ms", "messages"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.waiting.clear()
        self.touched.clear()
        yield pd.DataFrame(columns=["key", "id", "ms", "messages"])


_DRAINED = "key long, id long, ms long, messages array<string>"


def live_drains(ops: DataFrame, ttl_ms: int = HOUR_MS) -> DataFrame:
    """A stream of (key, id, ms, ts, op, message) with a watermark on ts: what each drain takes out."""
    with_store(ops.sparkSession)
    return ops.groupBy("key").transformWithStateInPandas(_Bus(ttl_ms), _DRAINED, "Append", "EventTime")


def drains(ops: DataFrame, ttl_ms: int = HOUR_MS) -> DataFrame:
    """(key, id, ms, op, message): every drain with the messages pushed since the one before, in order. What waits is
    lost when nothing touches its key for longer than ttl_ms. A key of any length is dealt by ranges: a drain ends a
    group, and so does a silence; messages meet by group."""
    known = ops.where("key is not null and ms is not null").select("key", "id", "ms", "op", "message")
    ends = dealt(known.withColumn("_end", (F.col("op") == "drain").cast("long")), ["key"], ["ms", "id"])
    before = running(ends, ["key"], ["ms", "id"], {"_drains": "_end"}, {"_last": "ms"}, inclusive=False)
    gaps = before.withColumn("_gap", (F.col("ms") - F.col("_last") > ttl_ms).cast("long"))
    grouped = running(gaps, ["key"], ["ms", "id"], {"_gaps": "_gap"})
    pushed = F.array_sort(F.collect_list(F.when((F.col("op") == "push"), F.struct("ms", "id", "message"))))
    met = grouped.groupBy("key", "_drains", "_gaps").agg(F.max(F.when(F.col("op") == "drain", F.struct("ms", "id"))).alias("d"), pushed.alias("p"))
    return met.where("d is not null").select("key", "d.id", "d.ms", F.transform("p", lambda x: x["message"]).alias("messages"))


# -- the first of several deliveries -----------------------------------------------------------------------------


def first_findings(snapshots: DataFrame, late: str | None = None) -> DataFrame:
    """Cumulative progress (scan, ts, findings: array of structs with an id) as single findings, each once a scan. On a
    stream, where `late` is the watermark's delay on ts, repeats are dropped as long as they come within it of the first;
    all copies of a finding are the same."""
    if not late:  # what the snapshot before holds was there earlier: only what is new becomes rows
        before = Window.partitionBy("scan").orderBy("ts")
        known = F.lag(F.when(F.col("ts").isNotNull(), F.transform("findings", lambda x: x["id"]))).over(before)
        new = F.filter("findings", lambda x: ~F.coalesce(F.array_contains(F.col("_known"), x["id"]), F.lit(False)))
        snapshots = snapshots.select("scan", "ts", "findings", known.alias("_known")).select("scan", "ts", new.alias("findings"))
    each = snapshots.select("scan", "ts", F.explode("findings").alias("finding")).withColumn("finding_id", F.col("finding.id")).where("finding_id is not null")
    if late:
        return each.withWatermark("ts", late).dropDuplicatesWithinWatermark(["scan", "finding_id"]).select("scan", "finding_id", "finding")
    return each.groupBy("scan", "finding_id").agg(F.min_by("finding", "ts").alias("finding"))


class _First(_Keyed):
    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle):
        self.handle = handle
        self.seen = handle.getMapState("seen", "decision string", "ms long")

    def handleInputRows(self, key, rows, timerValues):
        seen = {k[0]: v[0] for k, v in self.seen.iterator()}
        out, last = [], None
        for r in self.rows(rows):
            last = r.ms
            if r.decision not in seen or r.ms - seen[r.decision] > self.ttl_ms:
                seen[r.decision] = r.ms
                self.seen.updateValue((r.decision,), (r.ms,))
                out.append((key[0], r.decision, r.id, r.ms, r.transport))
        self.wake(self.handle, last + self.ttl_ms + 1)
        yield pd.DataFrame(out, columns=["key", "decision", "id", "ms", "transport"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.seen.clear()
        yield pd.DataFrame(columns=["key", "decision", "id", "ms", "transport"])


def live_firsts(parts: list[DataFrame], ttl_ms: int = HOUR_MS) -> DataFrame:
    """Streams (key, decision, id, ms, ts, transport) of one set of decisions by several transports: of each decision of a key
    the delivery that arrives first. It is remembered for ttl_ms, as is all of a key that long after its last delivery."""
    from functools import reduce

    one = reduce(DataFrame.unionByName, parts)
    with_store(one.sparkSession)
    return one.where("decision is not null").groupBy("key").transformWithStateInPandas(_First(ttl_ms), "key long, decision string, id long, ms long, transport string", "Append", "EventTime")


def firsts(parts: list[DataFrame]) -> DataFrame:
    """The same over tables, remembered for good: one aggregation with partial results."""
    from functools import reduce

    one = reduce(DataFrame.unionByName, parts).where("decision is not null")
    first = one.groupBy("key", "decision").agg(F.min(F.struct("ms", "id", "transport")).alias("f"))
    return first.select("key", "decision", "f.id", "f.ms", "f.transport")


# -- runs of one type --------------------------------------------------------------------------------------------


class _Runs(_Keyed):
    def __init__(self, types: list[str], most: int, wait_ms: int) -> None:
        self.types, self.most, self.wait_ms = types, most, wait_ms

    def init(self, handle):
        self.handle = handle
        self.waiting = handle.getListState("waiting", "id long, ms long, type string")
        self.number = handle.getValueState("number", "n long")

    def handleInputRows(self, key, rows, timerValues):
        held = list(self.waiting.get()) if self.waiting.exists() else []
        n, out = (self.number.get()[0] if self.number.exists() else 0), []

        def flush():
            nonlocal held, n
            if held:
                out.append((key[0], n, held[0][2], [h[0] for h in held]))
                held, n = [], n + 1

        for r in self.rows(rows):
            # a run ends before an event of another type, before one that comes too late for it, and when it is full
            if held and (r.type != held[0][2] or r.ms - held[0][1] >= self.wait_ms):
                flush()
            held.append((r.id, r.ms, r.type))
            if r.type not in self.types or len(held) >= self.most:
                flush()
        self._keep(held, n)
        yield pd.DataFrame(out, columns=["key", "n", "type", "ids"])

    def _keep(self, held, n):
        self.number.update((n,))
        if held:
            self.waiting.put(held)
            self.wake(self.handle, held[0][1] + self.wait_ms)
        else:
            self.waiting.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = list(self.waiting.get()) if self.waiting.exists() else []
        if not held or held[0][1] + self.wait_ms > timerValues.getCurrentWatermarkInMs():
            return  # the run that the timer was for has been flushed; the one that waits has its own
        n = self.number.get()[0]
        yield pd.DataFrame([(key[0], n, held[0][2], [h[0] for h in held])], columns=["key", "n", "type", "ids"])
        self._keep([], n + 1)


def live_runs(events: DataFrame, types: list[str], most: int = 100, wait_ms: int = 1_000) -> DataFrame:
    """A stream (key, id, ms, ts, type) as runs in the order of the events: rapid events of one of `types` go together, at
    most `most` and within wait_ms of the first; any other event goes alone, after what waits. A run that nothing
    follows is flushed by a timer."""
    with_store(events.sparkSession)
    return events.groupBy("key").transformWithStateInPandas(_Runs(types, most, wait_ms), "key long, n long, type string, ids array<long>", "Append", "EventTime")


def runs(events: DataFrame, types: list[str], most: int = 100, wait_ms: int = 1_000) -> DataFrame:
    """The same over a table: (key, n, type, ids). A run ends for certain where the type changes or does not go together, and
    where the next event comes wait_ms later; these places are counted by ranges, and only what lies between is walked."""
    known = events.where("key is not null and ms is not null").select("key", "id", "ms", "type")
    ranges = dealt(known.withColumn("_at", F.struct("ms", "id", "type")), ["key"], ["ms", "id"])
    before = running(ranges, ["key"], ["ms", "id"], None, {"_last": "_at"}, inclusive=False)
    single = ~F.coalesce(F.col("type").isin(types), F.lit(False))
    cut = before.withColumn("_cut", F.coalesce(single | ~F.col("type").eqNullSafe(F.col("_last.type")) | (F.col("ms") - F.col("_last.ms") >= wait_ms), F.lit(True)).cast("long"))
    parts = running(cut, ["key"], ["ms", "id"], {"part": "_cut"})

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, first, size, n = None, 0, 0, 0
        for pdf in batches:
            out = []
            for key, part, ms in zip(pdf["key"].tolist(), pdf["part"].tolist(), pdf["ms"].tolist()):
                if (key, part) != last:
                    last, first, size, n = (key, part), ms, 0, 0
                elif size >= most or ms - first >= wait_ms:
                    first, size, n = ms, 0, n + 1
                size += 1
                out.append(n)
            yield pdf.assign(piece=out)[["key", "id", "ms", "type", "part", "piece"]]

    kind = {f.name: f.dataType.simpleString() for f in known.schema.fields}
    ordered = parts.select("key", "id", "ms", "type", "part").repartition("key", "part").sortWithinPartitions("key", "part", "ms", "id")
    walked = ordered.mapInPandas(walk, f"key {kind['key']}, id {kind['id']}, ms {kind['ms']}, type {kind['type']}, part long, piece long")
    own = walked.groupBy("key", "part", "piece").agg(F.array_sort(F.collect_list(F.struct("ms", "id"))).alias("e"), F.first("type").alias("type"))
    numbered = running(dealt(own.withColumn("_one", F.lit(1)), ["key"], ["part", "piece"]), ["key"], ["part", "piece"], {"n": "_one"}, inclusive=False)
    return numbered.select("key", "n", "type", F.transform("e", lambda x: x["id"]).alias("ids"))
