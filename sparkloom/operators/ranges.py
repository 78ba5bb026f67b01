"""Ordered work on keys of any size: rows are dealt by ranges of (key, order), so a hot key lies on many tasks, and what
one range needs to know of those before it is one small row.

`dealt` stores such ranges once; `running` adds sums over all rows of a key before each row; `walked` runs a state machine.
"""

from __future__ import annotations

import pickle
import re
import tempfile
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary folder only where none is set and all tasks run on this machine."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found:
            if not re.match(r"local(\[[^]]*\])?$", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            found = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        context.setCheckpointDir(found)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, stored in the shared folder with its partitions and their order."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def spread(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: it is dealt out to tasks, whatever size it is taken for. A side that is
    sent to all tasks goes through the driver whole, and guesses of size know nothing of exploded rows or long texts."""
    return side.hint("merge")


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def dealt(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df in ranges of (keys, order), each sorted, with its number as `_range`."""
    sorted_ = df.repartitionByRange(width(df.sparkSession), *keys, *order).sortWithinPartitions(*keys, *order)
    return checkpointed(sorted_.withColumn("_range", F.spark_partition_id()))


def running(ranges: DataFrame, keys: list[str], order: list[str], sums: dict[str, str] | None = None, highest: dict[str, str] | None = None, inclusive: bool = True) -> DataFrame:
    """`dealt` rows with sums and highest values (new name: column) over the rows of their key up to them, or before them;
    a sum of nothing is 0, a highest of nothing is null. Each range is summed up by itself; what it starts from comes from
    one row for each key and range before it."""
    end = Window.currentRow if inclusive else -1
    within = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    made = [(n, c, F.sum, lambda a, b: zero(a) + zero(b)) for n, c in (sums or {}).items()] + [(n, c, F.max, F.greatest) for n, c in (highest or {}).items()]
    per = ranges.groupBy(*keys, "_range").agg(*[f(c).alias(f"_{n}") for n, c, f, _ in made])
    start = per.select(*keys, "_range", *[f(f"_{n}").over(before).alias(f"_{n}") for n, _, f, _ in made])
    own = ranges.withColumns({n: f(c).over(within) for n, c, f, _ in made})
    met = own.alias("a").join(start.alias("b"), (F.col("a._range") == F.col("b._range")) & _same(keys)).select("a.*", *[f"b._{n}" for n, *_ in made])
    return met.withColumns({n: both(F.col(n), F.col(f"_{n}")) for n, _, _, both in made}).drop(*[f"_{n}" for n, *_ in made])


def _same(keys: list[str]):
    both = F.lit(True)
    for k in keys:
        both = both & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return both


class Machine:
    """A state machine whose states are tuples (status, count, mark): `status` is one of few, `count` is bounded, and
    `mark` is None or any value that events are compared with.

    `step(state, event)` returns (state, value of the event). It may not look at a mark but by `event_mark(event) ==
    mark`, and may only keep it, drop it, or replace it by the event's own."""

    START: tuple = ("", 0, None)

    def entries(self) -> list[tuple]:
        """Every state a run may be entered in, with ANY for a mark."""
        raise NotImplementedError

    def mark(self, event: tuple) -> Any:
        """The mark that the event is held against; None if it is held against none."""
        return None

    def step(self, state: tuple, event: tuple) -> tuple[tuple, Any]:
        raise NotImplementedError


class _Any:
    """The mark of a state that was entered from outside: equal to no event's."""

    def __reduce__(self) -> str:
        return "ANY"


ANY = _Any()


class Run:
    """What a run of events makes of every state that it may be entered in: runs compose, so a key's runs can be worked
    out side by side. Entries whose states have met go on as one. An unknown mark is told apart from those that events name:
    the first event to name one splits off the entry with this very mark."""

    def __init__(self, machine: Machine) -> None:
        self.machine = machine
        self.groups = {e: [e] for e in machine.entries()}  # current state: entries
        self.named = set()

    def add(self, event: tuple) -> None:
        mark = self.machine.mark(event)
        if mark is not None:
            for now, entries in list(self.groups.items()):
                if now[2] is ANY:
                    fresh = [(e[0], e[1], mark) for e in entries if e[2] is ANY and (e[0], e[1], mark) not in self.named]
                    self.named.update(fresh)
                    self.groups.setdefault((now[0], now[1], mark), []).extend(fresh)
        met: dict = {}
        for now, entries in self.groups.items():
            after = self.machine.step(now, event)[0]
            if after in met:
                small, large = sorted((met[after], entries), key=len)
                large.extend(small)
                met[after] = large
            else:
                met[after] = entries
        self.groups = met

    def ends(self) -> dict[tuple, tuple]:
        """The state behind the run of each entry."""
        return {e: now for now, entries in self.groups.items() for e in entries}


def left(ends: dict[tuple, tuple], state: tuple) -> tuple:
    """The state in which a run is left that is entered in `state`."""
    if state in ends:
        return ends[state]
    status, count, mark = ends[state[0], state[1], ANY]
    return status, count, state[2] if mark is ANY else mark


def walked(events: DataFrame, machine: Machine, columns: list[str], added: dict[str, str], key: str = "key", order: tuple[str, ...] = ("ms", "id")) -> DataFrame:
    """events with what `machine` says of each (columns of `added`), in order within each key.

    First all ranges are walked side by side. Only the first key of a range may have begun before it, so a range hands on what
    it makes of each state that this key may be in, and the state in which its last key leaves it, walked from the start:
    a bounded number of rows for each range, put together in order of the ranges. Then all ranges are walked again, each from the state it is
    entered in. A key with all events lies on all tasks."""
    ranges = dealt(events, [key], list(order))
    names = list(added)

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, last, run, tail = None, None, None, None
        for pdf in batches:
            for k, *event in zip(pdf[key].tolist(), *[pdf[c].tolist() for c in columns]):
                if run is None:
                    first, run = k, Run(machine)
                elif k != last:
                    tail = machine.START
                last = k
                if tail is None:
                    run.add(tuple(event))
                else:
                    tail = machine.step(tail, tuple(event))[0]
        if run is not None:
            yield pd.DataFrame({"range": [TaskContext.get().partitionId()], "run": [pickle.dumps((first, last, run.ends(), tail))]})

    entered, key_before, state = {}, None, machine.START
    for r in sorted(ranges.select(key, *columns).mapInPandas(runs, "range int, run binary").collect(), key=lambda r: r["range"]):
        first, last, ends, tail = pickle.loads(r["run"])
        entered[r["range"]] = state if first == key_before else machine.START
        state = left(ends, entered[r["range"]]) if tail is None else tail
        key_before = last

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, entered.get(TaskContext.get().partitionId())
        for pdf in batches:
            out = []
            for k, *event in zip(pdf[key].tolist(), *[pdf[c].tolist() for c in columns]):
                if k != last and last is not None:
                    state = machine.START
                last = k
                state, value = machine.step(state, tuple(event))
                out.append(value)
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    out = ranges.drop("_range")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields)
    return out.mapInPandas(walk, schema + "".join(f", {n} {t}" for n, t in added.items()))
