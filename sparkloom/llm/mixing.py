"""Mixing sources to target weights by systematic sampling.

Every document of a source expects target / size copies. Within its source the documents stand in
order of (size, doc_id, hash of the text); the running sum of expected copies plus one random offset is cut at the
integers, and a document is emitted once for each integer it crosses. Standing in order of size
makes the draw stratified: the words taken miss the target by about one large document at most.

Edge cases: a null text has size 0; a null source is a source of its own and stands last; null
doc_ids stand after the others; repeated rows are sampled each for itself; an empty table gives an
empty result; columns of other names are ignored here and kept by `mixed`.
"""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sparkloom.llm.arrowtext import steps, words
from sparkloom.llm.store import carried, drop, partitions, written

#: Weights that sources get in turn, in order of their names.
WEIGHTS = (5, 2, 1)
#: All targets together, as a share of all words, and the most a source may be repeated.
BUDGET, REPEATS = 1.5, 2
SEED = 42


def offset(seed: int = SEED) -> float:
    """The one random offset in [0, 1)."""
    return random.Random(seed).random()


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and a hash of the text, one row for each document."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("source", T.StringType()), T.StructField("th", T.LongType()), T.StructField("size", T.LongType())])

    def count(batches):
        for batch in batches:
            for part in steps(batch):
                _, at = words(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), part.column("th"), pa.array(at[1:] - at[:-1], pa.int64())], names=["doc_id", "source", "th", "size"])

    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("th"), "text").mapInArrow(count, schema)


def targets(sized: DataFrame, weights=WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS) -> DataFrame:
    """source, source_size, target: weights share the budget, none above its cap.

    With sources in order of cap / weight, level k is what is left of the budget once the sources before k
    are full, by unit of weight from k on. The levels rise until the first source that does not fill up
    and fall after it, so the highest one is the water level and target = least(cap, level * weight).
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_fill = Window.orderBy(F.col("fill"), F.col("source").asc_nulls_last())
    each = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    each = each.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    each = each.withColumn("cap", F.col("source_size") * F.lit(float(repeats))).withColumn("fill", F.col("cap") / F.col("weight"))
    each = each.withColumn("total", F.sum("source_size").over(Window.partitionBy()) * F.lit(float(budget)))
    before = by_fill.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = (F.col("total") - (F.sum("cap").over(before) - F.col("cap"))) / (F.sum("weight").over(Window.partitionBy()) - F.sum("weight").over(before) + F.col("weight"))
    each = each.withColumn("level", level).withColumn("level", F.max("level").over(Window.partitionBy()))
    return each.select("source", "source_size", F.least(F.col("cap"), F.col("level") * F.col("weight")).alias("target"))


def copies(rank: Column, expected: Column, shift: float) -> Column:
    """Integers crossed between the running sums before and after this document."""
    return (F.floor(F.lit(shift) + expected * rank) - F.floor(F.lit(shift) + expected * (rank - 1))).cast("long")


def sampled(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """doc_id, source, th, size, source_size, target, copies for every document.

    The rank within a source is computed without gathering a source anywhere: narrow rows are range
    partitioned by (source, size, doc_id, th), written with their partition number, ranked inside a partition,
    and shifted by the counts of the partitions before. A hot source spreads over many partitions.
    """
    spark = docs.sparkSession
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id").asc_nulls_last(), F.col("th")]
    sized = written(sizes(docs), "sizes")
    dealt = written(sized.repartitionByRange(partitions(spark), *order).withColumn("pid", F.spark_partition_id()), "ranges")
    drop(sized)
    goal = targets(dealt, weights, budget, repeats)
    part = dealt.groupBy("source", "pid").agg(F.count("*").alias("n"))
    part = part.withColumn("ahead", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    plan = part.join(goal, part["source"].eqNullSafe(goal["source"])).select(part["source"].alias("s"), part["pid"].alias("p"), "ahead", "source_size", "target")
    ranked = dealt.withColumn("rn", F.row_number().over(Window.partitionBy("pid", "source").orderBy(*order)))
    out = ranked.join(plan, (ranked["pid"] == plan["p"]) & ranked["source"].eqNullSafe(plan["s"]))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return out.select("doc_id", "source", "th", "size", "source_size", "target", copies(F.col("ahead") + F.col("rn"), expected, offset(seed)).alias("copies"))


@carried
def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mixture: each document as often as it was drawn, with all its columns."""
    drawn = sampled(docs, **how)
    key = ["doc_id", "source", "th", "size"]
    per = drawn.groupBy(*key).agg(F.sum("copies").alias("total"), F.count("*").alias("rows")).where("total > 0")
    left = docs.withColumn("_th", F.xxhash64("text"))
    met = left.join(per.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("th").alias("_t"), F.col("total").alias("_total"), F.col("rows").alias("_rows")), left["doc_id"].eqNullSafe(F.col("_d")) & left["source"].eqNullSafe(F.col("_s")) & (left["_th"] == F.col("_t")))
    met = met.withColumn("_n", F.floor(F.col("_total") / F.col("_rows")))
    once = met.where("_rows = 1")
    many = met.where("_rows > 1")  # rows repeated whole share what was drawn for them
    turn = F.row_number().over(Window.partitionBy("_d", "_s", "_t").orderBy(F.lit(0)))
    many = many.withColumn("_turn", turn).withColumn("_n", F.col("_n") + F.when(F.col("_turn") <= F.col("_total") - F.col("_n") * F.col("_rows"), 1).otherwise(0)).drop("_turn")
    return once.unionByName(many).withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_n").cast("int")))).select(*docs.columns)


def op8_mixing(docs: DataFrame) -> DataFrame:
    return sampled(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


OP8_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
each AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INT)]::DOUBLE AS weight
  FROM sized GROUP BY source),
filled AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS fill, CAST(sum(source_size) OVER () AS BIGINT) * 1.5::DOUBLE AS total FROM each),
levels AS (
  SELECT *, (total - (sum(cap) OVER w - cap)) / (sum(weight) OVER () - sum(weight) OVER w + weight) AS level
  FROM filled WINDOW w AS (ORDER BY fill, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
goal AS (SELECT source, source_size, least(cap, max(level) OVER () * weight) AS target FROM levels),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id ASC NULLS LAST) AS i FROM sized),
drawn AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS e, i
  FROM ranked JOIN goal ON ranked.source IS NOT DISTINCT FROM goal.source)
SELECT doc_id, size, source_size, target,
       CAST(floor({offset()!r}::DOUBLE + e * i) - floor({offset()!r}::DOUBLE + e * (i - 1)) AS BIGINT) * size AS taken,
       CAST(floor({offset()!r}::DOUBLE + e * i) - floor({offset()!r}::DOUBLE + e * (i - 1)) AS BIGINT) AS copies
FROM drawn
"""
