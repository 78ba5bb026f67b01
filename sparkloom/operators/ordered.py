"""Operators over relations that carry their source order: keep-first, keep-last-n, latest version, ranked lookup,
disjunctive equi-joins, running totals and budgets. All are plain plans; ties always end at the order columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.operators.ranges import spread


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def keep_last_n(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The last n rows of each key."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))).where(F.col("_rn") <= n).drop("_rn")


def latest(df: DataFrame, keys: list[str], version: str, order: str, ties: str = "first") -> DataFrame:
    """The row with the highest version of each key; equal versions go to the first or last row by order."""
    tie = F.asc(order) if ties == "first" else F.desc(order)
    return keep_first(df, keys, [F.desc(version), tie])


def ranked_lookup(probe: DataFrame, key: list[str], stages: list[DataFrame], order: list) -> DataFrame:
    """The best match of each probe row: the first stage that has one, within it by `order`. Stages hold the key,
    the order columns and what is looked up; probe rows without a match keep nulls."""
    every = reduce(DataFrame.unionByName, [s.withColumn("stage", F.lit(i)) for i, s in enumerate(stages)])
    return probe.join(keep_first(every, key, [F.col("stage"), *order]), key, "left")


def cascade(probe: DataFrame, name: str, nodes: DataFrame, hotspots: DataFrame) -> DataFrame:
    """probe with `resolved` and `stage`: what the entry point `name`, without slashes at its end, stands for. Stages are
    0 and 2, the node and the hotspot of that id if there is just one; 1 and 3, the node and the hotspot whose id ends in it
    after a slash; 4 and 5, those whose last part it is. Nodes and hotspots hold id, score and ord; the highest score
    wins, then the first. Nothing found leaves the entry point and no stage. Candidates are first brought to one a key by
    aggregation, so that a common key does not multiply."""

    def best(known: DataFrame, exact: int, suffix: int, base: int) -> list[DataFrame]:
        top = F.min(F.struct((-F.col("score")).alias("score"), "ord", "id"))["id"].alias("hit")
        parts = F.split("id", "/")
        n = F.size(parts)
        # an id of n parts ends in n - 1 shorter ones
        ends = F.when(n > 1, F.transform(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), lambda i: F.array_join(F.slice(parts, i, n), "/")))
        one = known.groupBy(F.col("id").alias("key")).agg(F.count("*").alias("n"), F.min("id").alias("hit")).where("n = 1").select("key", "hit")
        by_end = known.select(F.explode(ends).alias("key"), "id", "score", "ord").groupBy("key").agg(top)
        by_base = known.select(F.element_at(parts, -1).alias("key"), "id", "score", "ord").groupBy("key").agg(top)
        return [x.select("key", F.lit(i).alias("stage"), "hit") for i, x in ((exact, one), (suffix, by_end), (base, by_base))]

    every = reduce(DataFrame.unionByName, [*best(nodes, 0, 1, 4), *best(hotspots, 2, 3, 5)])
    first = every.groupBy("key").agg(F.min(F.struct("stage", "hit")).alias("_first"))
    met = probe.join(spread(first), F.regexp_replace(name, "/+$", "") == F.col("key"), "left")
    return met.select(*[probe[c] for c in probe.columns], F.coalesce("_first.hit", name).alias("resolved"), F.col("_first.stage").alias("stage"))


def either_key_join(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], row: list[str]) -> DataFrame:
    """left join right on any of several equalities, as a union of equi-joins without repeats: an OR of keys in one
    join would be planned as a nested loop. `row` names columns that identify a pair of rows."""
    parts = [left.join(right, left[a] == right[b]) for a, b in pairs]
    return reduce(DataFrame.unionByName, parts).dropDuplicates(row)


def running(value: Column, keys: list[str], order: list[str]) -> Column:
    return F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def repeats(df: DataFrame, keys: list[str], order: list[str], value: str, length: int) -> DataFrame:
    """Rows at which the last `length` values of the key are all the same."""
    w = Window.partitionBy(*keys).orderBy(*order)
    same = F.sum(F.when(F.col(value) == F.col("_before"), 0).otherwise(1)).over(w)
    runs = df.withColumn("_before", F.lag(value).over(w)).withColumn("_run", same)
    return runs.withColumn("run_length", F.row_number().over(Window.partitionBy(*keys, "_run").orderBy(*order))).where(F.col("run_length") >= length).drop("_before", "_run")


def union_in_order(parts: list[DataFrame]) -> DataFrame:
    """All parts with the number of the part, which is the tie-break of later sorts."""
    return reduce(DataFrame.unionByName, [p.withColumn("generator", F.lit(i)) for i, p in enumerate(parts)])


def positions(df: DataFrame, coarse: list[str], order: str, fine: list[str], width: int = 1_000_000) -> DataFrame:
    """df with its 1-based position by (coarse, order, fine), without sorting all rows in one task: rows are counted by
    coarse keys and ranges of `order` (an integer), ranked within these, and shifted by what lies before."""
    parts = df.withColumn("_part", F.floor(F.col(order) / F.lit(width)))
    keys = [*coarse, "_part"]
    sizes = parts.groupBy(*keys).agg(F.count("*").alias("_n"))  # one row a range, ordered by one task
    shift = sizes.select(*keys, F.coalesce(F.sum("_n").over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_shift"))
    ranked = parts.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(order, *fine)))
    return ranked.join(shift, keys).withColumn("position", F.col("_shift") + F.col("_rank")).drop("_part", "_rank", "_shift")
