"""SimHash near-duplicates found by covering locality-sensitive hashing.

A fingerprint has 64 bits: bit i is set if it is set in more than half of the hashes of a text's shingles.
Two fingerprints are linked if at most RADIUS bits differ. To find all links, each bit position gets a random
non-zero vector of RADIUS + 1 bits; every non-zero vector v gives a table whose mask keeps the positions with
odd inner product with v. Up to RADIUS differing positions leave a v orthogonal to all of them, and in that
table the two masked fingerprints are equal: every linked pair meets in one of 2^(RADIUS + 1) - 1 tables.

Documents of one fingerprint are one node. A bucket of a table is not expanded into pairs: a walk removes each
node from the unvisited ones when it is reached and hands on one link a node, which joins the same nodes as
all links would. Buckets over BLOCK nodes are compared block by block in separate tasks.

Edge cases: null, empty and blank texts have fingerprint 0 and are linked like any other; texts under four
words hash their whole word sequence; rows with a null doc_id share the components but never name one (their
component is null if it has no other document); repeated rows are rows of their own; extra columns are ignored.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.arrowtext import LOWER, raw, steps
from sparkloom.llm.components import components
from sparkloom.llm.store import carried, partitions, row_hash, written

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Nodes of a bucket that one task compares at once.
BLOCK = 20_000
#: Large buckets whose keys are sent to every task; more of them are joined by a shuffle.
HOT_BROADCAST = 100_000


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of one text (lower-cased bytes)."""
    own = text.split()
    if not own:
        return 0
    joined = b" ".join(own)
    x = xxhash.xxh64_intdigest
    n = len(own) - shingle + 1
    if n <= 1:
        return x(joined, seed)  # one hash: its bits are the majority
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
    begin = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    h = np.array([x(joined[a:b], seed) for a, b in zip(begin, ends[shingle - 1 :].tolist())], np.uint64)
    total = np.zeros(64, np.int64)
    for low in range(0, n, 1 << 16):
        total += np.unpackbits(h[low : low + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of `keep` and fp, the fingerprint as a signed long."""
    schema = T.StructType([docs.schema["doc_id"], *[docs.schema[c] for c in keep], T.StructField("fp", T.LongType())])

    def run(batches):
        for batch in batches:
            for part in steps(batch):
                offsets, data = raw(part.column("text"))
                data = data.translate(LOWER)
                at = offsets.tolist()
                fp = np.array([fingerprint(data[a:b], shingle, seed) for a, b in zip(at, at[1:])], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(part.column, keep), pa.array(fp.view(np.int64))], names=schema.names)

    return docs.select("doc_id", *keep, "text").mapInArrow(run, schema)


def masks(radius: int = RADIUS, seed: int = SEED) -> list[int]:
    """The covering masks: 64-bit integers, one a table."""
    rng = random.Random(seed)
    vector = [rng.randrange(1, 1 << (radius + 1)) for _ in range(64)]
    return [sum(1 << i for i, a in enumerate(vector) if (a & v).bit_count() & 1) for v in range(1, 1 << (radius + 1))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def walk(fp: np.ndarray, node: np.ndarray, radius: int) -> tuple[list, list]:
    """Links that join what is within the radius: each node leaves the unvisited when it is reached."""
    left_fp, left_node = fp.copy(), node.copy()
    a, b = [], []
    while len(left_fp):
        queue = [(left_fp[0], left_node[0])]
        left_fp, left_node = left_fp[1:], left_node[1:]
        while queue and len(left_fp):
            f, n = queue.pop()
            near = np.bitwise_count(left_fp ^ f) <= radius
            if near.any():
                got = left_node[near]
                a.append(np.full(len(got), n))
                b.append(got)
                queue += zip(left_fp[near], got)
                left_fp, left_node = left_fp[~near], left_node[~near]
    return a, b


def links(nodes: DataFrame, radius: int = RADIUS, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """(a, b) node pairs that join all nodes within the radius; nodes has fp and node."""
    spark = nodes.sparkSession
    tables = F.array(*[F.struct(F.lit(t).cast("byte").alias("t"), F.lit(_signed(m)).alias("m")) for t, m in enumerate(masks(radius, seed))])
    spread = nodes.select("fp", "node", F.explode(tables).alias("x")).select("fp", "node", F.col("x.t").alias("t"), F.col("fp").bitwiseAND(F.col("x.m")).alias("key"))
    # buckets over a block, counted before rows are shuffled; all others are whole in one task
    hot = written(spread.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > block), "hot")
    known = hot.count()
    if known <= HOT_BROADCAST:
        hot = F.broadcast(hot)
    small = spread.join(hot.drop("n"), ["t", "key"], "left_anti") if known else spread
    small = small.select("t", "key", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp", "node").repartition(partitions(spark), "t", "key")
    # blocks of a large bucket meet in pairs: block i goes to the tasks (i, j) and (j, i) of all j
    k = F.ceil(F.col("n") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("node"), k.cast("long")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.struct(F.least(F.col("own"), j).alias("i"), F.greatest(F.col("own"), j).alias("j")))
    large = spread.join(hot, ["t", "key"]).withColumn("k", k).withColumn("own", own)
    large = large.select("t", "key", F.explode(pair).alias("p"), "fp", "node").select("t", "key", "p.i", "p.j", "fp", "node").repartition(partitions(spark), "t", "key", "i", "j")

    def run(batches):
        # rows come sorted by bucket; the last bucket of a batch may go on in the next
        rest = None
        for batch in batches:
            if rest is not None:
                batch = pa.concat_batches([rest, batch])
            c = [batch.column(x).to_numpy(zero_copy_only=False) for x in ("t", "key", "i", "j")]
            new = np.zeros(batch.num_rows, bool)
            for x in c:
                new[1:] |= x[1:] != x[:-1]
            cut = np.flatnonzero(new)
            edge = [0, *cut.tolist()]
            yield from _walked(batch, edge, radius)
            rest = batch.slice(edge[-1])
        if rest is not None and rest.num_rows > 1:
            yield from _walked(rest, [0, rest.num_rows], radius)

    both = small.sortWithinPartitions("t", "key", "i", "j").mapInArrow(run, "a long, b long")
    if not known:
        return both
    return both.unionByName(large.sortWithinPartitions("t", "key", "i", "j").mapInArrow(run, "a long, b long"))


def _walked(batch: pa.RecordBatch, edge: list[int], radius: int):
    fp = batch.column("fp").to_numpy().view(np.uint64)
    node = batch.column("node").to_numpy()
    a, b = [], []
    for low, high in zip(edge, edge[1:]):
        if high - low == 2:
            if int(fp[low] ^ fp[low + 1]).bit_count() <= radius:
                a.append(node[low : low + 1])
                b.append(node[low + 1 : low + 2])
        elif high - low > 2:
            x, y = walk(fp[low:high], node[low:high], radius)
            a += x
            b += y
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of `keep`, fp, component_id of every document, and n_class, the documents of its fingerprint."""
    kind = docs.schema["doc_id"].dataType
    prints = written(fingerprints(docs, shingle, seed, keep), "prints")
    # classes of one fingerprint: copies are counted before they are shuffled
    classes = written(prints.groupBy("fp").agg(F.min(F.col("doc_id").cast("long")).alias("least"), F.count("*").alias("n_class")), "classes")
    nodes = classes.where("least is not null").select("fp", F.col("least").alias("node"))
    unnamed = classes.where("least is null").select("fp", F.xxhash64("fp").alias("h"))  # only rows without a doc_id
    nodes = nodes.unionByName(unnamed.select("fp", (F.lit(1 << 62) + F.pmod("h", F.lit(1 << 61))).alias("node")))
    found = components(links(nodes, radius, seed).distinct())
    named = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("c"))
    named = written(named.join(classes.select("fp", "n_class"), "fp").select("fp", F.when(F.col("c") < (1 << 62), F.col("c")).cast(kind).alias("component_id"), "n_class"), "named")
    # fingerprints that hold over a thousandth of all rows: at most a thousand, sent to where their rows are
    least = max(2, prints.count() // 1000)
    hot = named.where(F.col("n_class") > least)
    first = prints.join(F.broadcast(hot.select(F.col("fp").alias("hot_fp"), F.col("component_id").alias("hot_c"), F.col("n_class").alias("hot_n"))), F.col("fp") == F.col("hot_fp"), "left")
    rest = first.where("hot_fp is null").select("doc_id", *keep, "fp").join(named.where(F.col("n_class") <= least), "fp").select("doc_id", *keep, "fp", "component_id", "n_class")
    return first.where("hot_fp is not null").select("doc_id", *keep, "fp", F.col("hot_c").alias("component_id"), F.col("hot_n").alias("n_class")).unionByName(rest)


@carried
def kept_one(docs: DataFrame, **how) -> DataFrame:
    """Of each component one row stays, that of the smallest doc_id; of rows that share it, the one with the smallest hash of
    the whole row. Rows without a doc_id stay, as they can't be ordered."""
    named = docs.where("doc_id is not null").withColumn("_rh", row_hash(docs))
    least = near_duplicates(named, keep=("_rh",), **how).groupBy("component_id").agg(F.min(F.struct("doc_id", "_rh")).alias("k"))
    kept = named.join(least.select("k.doc_id", "k._rh"), ["doc_id", "_rh"], "left_semi")
    return kept.dropDuplicates(["doc_id", "_rh"]).select(*docs.columns).unionByName(docs.where("doc_id is null"))


def op10_simhash(docs: DataFrame) -> DataFrame:
    out = near_duplicates(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_class")
