"""How many of something are open over time, and sessions that open work keeps alive: sweeps over starts and ends."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.ranges import dealt, running


def levels(spans: DataFrame, keys: list[str]) -> DataFrame:
    """keys, at, level, delta: after each moment at which a span (keys, start, end) begins or ends, how many are open. A
    span is open from its start up to, not including, its end; one without an end stays open; one without a start, or
    that ends before it starts, is none."""
    good = spans.where("start is not null and (end is null or end >= start)")
    edges = good.select(*keys, F.col("start").alias("at"), F.lit(1).alias("d")).unionByName(good.where("end is not null").select(*keys, F.col("end").alias("at"), F.lit(-1).alias("d")))
    moments = edges.groupBy(*keys, "at").agg(F.sum("d").alias("delta"))
    return running(dealt(moments, keys, ["at"]), keys, ["at"], {"level": "delta"}).drop("_range")


def gauges(spans: DataFrame, keys: list[str], now) -> DataFrame:
    """keys, highest, at (its first moment), current (level at `now`): levels are added up by ranges of time, so a busy
    route is no single task's."""
    over = levels(spans, keys)
    out = over.groupBy(*keys).agg(F.max("level").alias("highest"), F.coalesce(F.max_by(F.when(F.col("at") <= now, F.col("level")), F.when(F.col("at") <= now, F.col("at"))), F.lit(0)).alias("current"))
    first = over.join(out.select(*keys, F.col("highest").alias("level")), [*keys, "level"]).groupBy(*keys).agg(F.min("at").alias("at"))
    return out.join(first, keys)


def opened(calls: DataFrame) -> DataFrame:
    """Calls (key, call, ms, op: start or end) as spans (key, call, start, end): the first start, and the first end that is
    not before it. A call without a start is none."""
    starts = calls.where("op = 'start'").groupBy("key", "call").agg(F.min("ms").alias("start"))
    ends = calls.where("op = 'end'").select("key", "call", F.col("ms").alias("end"))
    met = starts.join(ends, ["key", "call"], "left")
    return met.groupBy("key", "call", "start").agg(F.min(F.when(F.col("end") >= F.col("start"), F.col("end"))).alias("end"))


def kept_sessions(events: DataFrame, idle_ms: int, most_ms: int) -> DataFrame:
    """events (id, key, ms, op, call) with session_start and deadline as of each. A session ends idle_ms after its last event,
    but not while a call that was started in it is open, and most_ms after its start at the latest; the first event
    after that starts the next one, in which calls of before no longer count.

    Each event keeps its session alive until idle_ms later, a start until idle_ms after its call's end. Where no event
    before reaches, a session starts for certain: a highest value over ranges tells these places, so a key is walked
    in as many groups as it has silences, and only unbroken activity stays together."""
    most_ms = max(idle_ms, most_ms)
    known = events.where("key is not null and ms is not null").select("id", "key", "ms", "op", "call")
    spans = opened(known.where("call is not null")).select("key", "call", F.col("start").alias("ms"), F.lit("start").alias("op"), "end", F.lit(True).alias("_first"))
    met = known.join(spans, ["key", "call", "ms", "op"], "left")
    far = F.col("ms") + most_ms  # no event reaches further
    until = F.when(F.col("_first"), F.least(F.coalesce(F.col("end") + idle_ms, far), far)).otherwise(F.col("ms") + idle_ms)
    ranges = dealt(met.select("id", "key", "ms", "op", until.alias("until")), ["key"], ["ms", "id"])
    reached = running(ranges, ["key"], ["ms", "id"], None, {"_reach": "until"}, inclusive=False)
    begun = reached.withColumn("_new", F.coalesce(F.col("ms") >= F.col("_reach"), F.lit(True)).cast("long"))
    parts = running(begun, ["key"], ["ms", "id"], {"part": "_new"})

    def walk(batches):
        last, start, end = None, 0, 0
        for pdf in batches:
            out = []
            for key, part, ms, until in zip(pdf["key"].tolist(), pdf["part"].tolist(), pdf["ms"].tolist(), pdf["until"].tolist()):
                if (key, part) != last or ms >= end:
                    last, start, end = (key, part), ms, ms
                end = min(max(end, until), start + most_ms)
                out.append((start, end))
            yield pd.concat([pdf[["id", "key", "ms"]].reset_index(drop=True), pd.DataFrame(out, columns=["session_start", "deadline"])], axis=1)

    kind = events.schema
    ordered = parts.select("id", "key", "part", "ms", "until").repartition("key", "part").sortWithinPartitions("key", "part", "ms", "id")
    return ordered.mapInPandas(walk, f"id {kind['id'].dataType.simpleString()}, key {kind['key'].dataType.simpleString()}, ms long, session_start long, deadline long")
