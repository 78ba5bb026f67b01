"""Near copies by SimHash fingerprints and by shingles of five words: two texts are linked if their fingerprints differ in 4
bits at most, found by op10's covering tables, or if their shingle sets have a Jaccard similarity of 0.8 or more.

Candidates come from minimum hashes: BANDS keys of ROWS minima each. A pair of similarity s shares a key with probability
1 - (1 - s^ROWS)^BANDS, which is 0.9999 at 0.8 and more above. Texts are joined with the smallest one of each key into
coarse groups; all pairs of a coarse group, whether they share a key or not, are then held to the similarity of their
whole shingle sets, so no link is an estimate and a link is lost only if no chain of shared keys joins its texts.

Texts of one shingle set are one node. A walk takes each node from the unvisited ones when it is reached, which joins the
same nodes as all links would. Coarse groups over BLOCK shingles are compared block by block in separate tasks.

Edge cases: words are divided by ASCII white space and A-Z are folded; texts under five words are one shingle, their whole
word sequence; null, empty and blank texts are copies of each other; rows with a null doc_id join groups but always stay;
rows that share a doc_id are told apart by a hash of the whole row, so each is judged by its own text, and of rows that are
equal throughout one stays.
"""

from __future__ import annotations

import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm import simhash
from sparkloom.llm.arrowtext import LOWER, raw, steps
from sparkloom.llm.components import components
from sparkloom.llm.store import carried, partitions, row_hash, written

SHINGLE, SIMILARITY, SEED = 5, Fraction(4, 5), 42
#: Text bytes read at once; less than elsewhere, as workers keep what they once took.
STEP = 2_000_000
BANDS, ROWS = 31, 6
#: Groups of more than a block up to which their sizes are sent to all tasks.
LARGE_GROUPS = 100_000
#: Shingles of a coarse group that one block holds; a task compares two blocks.
BLOCK = 300_000

_rng = random.Random(SEED)
_A = np.array([_rng.getrandbits(64) | 1 for _ in range(BANDS * ROWS)], np.uint64)
_B = np.array([_rng.getrandbits(64) for _ in range(BANDS * ROWS)], np.uint64)
_C = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles (lower-cased bytes), in order."""
    own = text.split()
    if not own:
        return np.zeros(0, np.uint64)
    joined = b" ".join(own)
    x = xxhash.xxh64_intdigest
    n = len(own) - size + 1
    if n <= 1:
        return np.array([x(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
    begin = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    return np.unique(np.array([x(joined[a:b], SEED) for a, b in zip(begin, ends[size - 1 :].tolist())], np.uint64))


def digest(h: np.ndarray) -> int:
    """A signed long that stands for a whole shingle set."""
    x = xxhash.xxh64_intdigest(h.tobytes(), SEED)
    return x - (1 << 64) if x >= 1 << 63 else x


def keys(h: np.ndarray) -> np.ndarray:
    """One key a band, from the minima of ROWS hash functions; none for an empty set."""
    if not len(h):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for low in range(0, len(h), 1024):
        least = np.minimum(least, (h[low : low + 1024, None] * _A + _B).min(axis=0))
    k = np.arange(1, BANDS + 1, dtype=np.uint64) * _C
    for column in least.reshape(BANDS, ROWS).T:
        k = (k ^ (k >> np.uint64(29)) ^ column) * _C
    return (k ^ (k >> np.uint64(32))).view(np.int64)


def _read(batches, what):
    """The batches' slices with the results of `what` for each text, as lower-cased bytes."""
    for batch in batches:
        for part in steps(batch, most=STEP):
            offsets, data = raw(part.column("text"))
            data = data.translate(LOWER)
            at = offsets.tolist()
            yield part, [what(data[a:b]) for a, b in zip(at, at[1:])]


def prints(docs: DataFrame) -> DataFrame:
    """doc_id, rh (the row's hash), node (the digest of the shingle set), n (its size), fp (op10's fingerprint) and keys."""
    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string("rh long, node long, n long, fp long, keys array<long>").fields])

    def of(text):
        h = shingles(text)
        return digest(h), len(h), keys(h), simhash.fingerprint(text)

    def run(batches):
        for part, got in _read(batches, of):
            at = np.cumsum([0, *[len(k) for _, _, k, _ in got]]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([k for _, _, k, _ in got])))
            fp = pa.array(np.array([x for *_, x in got], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("rh"), pa.array([x for x, *_ in got], pa.int64()), pa.array([n for _, n, *_ in got], pa.int64()), fp, lists], names=schema.names)

    return docs.select("doc_id", row_hash(docs).alias("rh"), "text").mapInArrow(run, schema)


def walk(sets: list[np.ndarray], similarity: Fraction = SIMILARITY) -> list[tuple[int, int]]:
    """Links (by position) that join what is similar; sets hold distinct hashes."""
    if len(sets) < 2:
        return []
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    size = np.array([len(sets[i]) for i in order], np.int64)
    distinct, ids = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    start = np.cumsum(size) - size
    p, q = similarity.numerator, similarity.denominator
    mark = np.zeros(len(distinct), np.int64)
    own = [ids[s : s + m] for s, m in zip(start.tolist(), size.tolist())]
    here = np.arange(len(order))  # unvisited, by size; ids, size and start are kept to these
    out = []
    while len(here) > 1:
        queue = [int(here[0])]
        here, ids, start, size = here[1:], ids[size[0] :], start[1:] - size[0], size[1:]
        while queue and len(here):
            x = queue.pop()
            m = len(own[x])
            low = int(np.searchsorted(size, -(-p * m // q)))
            high = int(np.searchsorted(size, q * m // p, "right"))
            if low == high:
                continue
            mark[own[x]] = 1
            end = int(start[high - 1] + size[high - 1])
            shared = np.add.reduceat(mark[ids[start[low] : end]], start[low:high] - start[low])
            mark[own[x]] = 0
            near = np.zeros(len(here), bool)
            near[low:high] = shared * (p + q) >= p * (m + size[low:high])
            if near.any():
                got = here[near].tolist()
                out += [(order[x], order[y]) for y in got]
                queue += got
                ids = ids[~np.repeat(near, size)]
                here, size = here[~near], size[~near]
                start = np.cumsum(size) - size
    return out


def coarse(classes: DataFrame) -> DataFrame:
    """node, coarse: the nodes that share a key with another one, and the smallest node that chains of keys lead to."""
    spread = classes.select("node", F.explode("keys").alias("key"))
    met = spread.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    found = components(spread.join(met, "key").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")))
    found = written(found.select("node", F.col("component").alias("coarse")), "coarse")
    return found.unionByName(found.select(F.col("coarse").alias("node"), "coarse").distinct())


def links(docs: DataFrame, classes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b) node pairs of similar shingle sets that join all such pairs of a coarse group."""
    spark = docs.sparkSession
    members = written(coarse(classes).join(classes.select("node", "n", "least"), "node"), "members")
    large = written(members.groupBy("coarse").agg(F.sum("n").alias("n")).where(F.col("n") > block).select("coarse", F.ceil(F.col("n") / F.lit(block)).cast("int").alias("k")), "large")
    if large.count() <= LARGE_GROUPS:
        large = F.broadcast(large)
    members = members.join(large, "coarse", "left").select("node", "coarse", "least", F.coalesce("k", F.lit(1)).alias("k"))
    texts = members.where("least is not null").join(docs.where("doc_id is not null").select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), row_hash(docs).alias("rh")).alias("least"), "text"), "least")
    unnamed = docs.where("doc_id is null")  # their nodes are found by reading them again
    schema = "node long, text string"

    def again(batches):
        for part, got in _read(batches, lambda text: digest(shingles(text))):
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.int64()), part.column("text")], names=["node", "text"])

    unnamed = unnamed.select("text").mapInArrow(again, schema).dropDuplicates(["node"])
    columns = ["node", "coarse", "k", "text"]
    texts = texts.select(*columns).unionByName(members.where("least is null").join(unnamed, "node").select(*columns))
    own = F.pmod(F.xxhash64("node"), F.col("k").cast("long")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.struct(F.least(F.col("own"), j).alias("i"), F.greatest(F.col("own"), j).alias("j")))
    dealt = texts.withColumn("own", own).select("node", "coarse", "text", F.explode(pair).alias("p")).select("coarse", "p.i", "p.j", "node", "text")
    dealt = dealt.repartition(partitions(spark), "coarse", "i", "j").sortWithinPartitions("coarse", "i", "j")

    def run(batches):
        # rows come sorted by group and block pair
        now, sets = None, {}
        for batch in batches:
            for part in steps(batch, most=STEP):
                c = [part.column(x).to_pylist() for x in ("coarse", "i", "j", "node")]
                offsets, data = raw(part.column("text"))
                data = data.translate(LOWER)
                for r, key in enumerate(zip(*c[:3])):
                    if key != now:
                        yield from _linked(sets)
                        now, sets = key, {}
                    h = shingles(data[offsets[r] : offsets[r + 1]])
                    sets[c[3][r]] = h
        yield from _linked(sets)

    return dealt.mapInArrow(run, "a long, b long")


def _linked(sets: dict):
    nodes = list(sets)
    if got := walk(list(sets.values())):
        yield pa.RecordBatch.from_arrays([pa.array([nodes[x] for x, _ in got], pa.int64()), pa.array([nodes[y] for _, y in got], pa.int64())], names=["a", "b"])


def by_fingerprint(read: DataFrame) -> DataFrame:
    """(a, b) node pairs that join all nodes whose fingerprints are the same or within op10's radius."""
    own = read.select("node", "fp").distinct()
    first = written(own.groupBy("fp").agg(F.min("node").alias("first")), "fingerprints")
    same = own.join(first, "fp").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    return simhash.links(first.select("fp", F.col("first").alias("node"))).unionByName(same)


def grouped(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """node, group and least (the smallest doc_id and row hash of the node) of every distinct shingle set."""
    read = written(prints(docs), "prints")
    classes = written(read.groupBy("node").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct(F.col("doc_id").cast("long").alias("doc_id"), "rh"))).alias("least"), F.first("n").alias("n"), F.first("keys").alias("keys")), "classes")
    # written, so that a task does not hold a worker that walks and one that reduces links at once
    found = components(written(by_fingerprint(read), "close").unionByName(written(links(docs, classes, block), "walked")))
    return classes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("group"), "least")


@carried
def kept_one(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Of each group one row stays, that of the smallest doc_id (and row hash); rows without a doc_id stay, as they can't
    be ordered."""
    keep = grouped(docs, block).groupBy("group").agg(F.min("least").alias("least")).where("least is not null")
    keep = keep.select(F.col("least.doc_id").alias("_keep"), F.col("least.rh").alias("_rh"))
    named = docs.where("doc_id is not null").withColumns({"_id": F.col("doc_id").cast("long"), "_hash": row_hash(docs)})
    named = named.join(keep, (F.col("_id") == F.col("_keep")) & (F.col("_hash") == F.col("_rh")), "left_semi")
    return named.dropDuplicates(["_id", "_hash"]).select(*docs.columns).unionByName(docs.where("doc_id is null"))
