"""Connected components of a link table, by alternating large-star and small-star steps.

Links are pairs of longs; nodes are joined to the smallest neighbour round by round until nothing changes. A
partition first reduces its own links to a forest, so what is shuffled is never more than nodes times
partitions. Nothing is gathered on the driver but a checksum a round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.store import drop, written


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node) that join the same nodes as the given links."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = np.arange(len(nodes))
    x, y = at[: len(a)], at[len(a) :]
    while True:
        rx, ry = root[x], root[y]
        low, high = np.minimum(rx, ry), np.maximum(rx, ry)
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while True:  # to the root of each
            up = root[root]
            if (up == root).all():
                break
            root = up
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _locally(links: DataFrame) -> DataFrame:
    """Each partition's links as a forest, over pieces of bounded size."""

    def run(batches):
        held_a, held_b, n = [], [], 0
        for batch in batches:
            held_a.append(batch.column("a").to_numpy())
            held_b.append(batch.column("b").to_numpy())
            n += batch.num_rows
            if n >= 500_000:
                a, b = forest(np.concatenate(held_a), np.concatenate(held_b))
                held_a, held_b, n = [a], [b], 0
                if len(a) > 250_000:
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                    held_a, held_b = [], []
        if held_a:
            a, b = forest(np.concatenate(held_a), np.concatenate(held_b))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return links.select("a", "b").mapInArrow(run, "a long, b long")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (its smallest member) for every node of a link other than the smallest ones."""
    now = written(_locally(links.where("a <> b")), "links")
    before = None
    for _ in range(rounds):
        # large star: a node's larger neighbours, and the node, go to the smallest of them
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: a node and its smaller neighbours go to the smallest of them
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        new = written(_locally(small.where("a <> b").distinct()), "links")
        drop(now)
        now = new
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
