"""Benchmark decontamination over a distributed positional inverted index.

The index is a table of segments. A segment is one row and holds a few MB of documents: its number, its terms, and
for each term the list of positions at which it stands. Documents follow one another with a gap of one position,
so no phrase reaches over an end. Segments are built where the documents lie and hold every word; nothing is
shuffled to build or to search them, and a lost executor costs the segments it was working on.

A search takes the test items in blocks of bounded size, PASS_BLOCKS of them in one reading of the index. In a
segment each test phrase starts from the posting list of its rarest term; the list is shifted by the term's place
in the phrase and intersected with the shifted lists of the other terms, rarest first. Proximity queries intersect
within a slop instead. What several readings find of a document is put together by segment and row, which are
stored with the index, so rows that share a doc_id, or have none, stay apart.

Edge cases: null and empty texts have no words and no hits; an item without words is never met; repeated
items count once by id; repeated documents are rows of their own, whether their texts are equal or not; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from itertools import batched, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.arrowtext import ALNUM, coded, ragged, steps, words
from sparkloom.llm.store import carried, written

WINDOW = 10
#: Words of test items in one block (an item is never divided), and blocks in one reading of the index: what a search
#: sends to each worker stays below some 50 MB. More blocks are searched in further readings.
BLOCK_WORDS, PASS_BLOCKS = 100_000, 8
#: Candidate places that one step of a search holds.
CANDIDATES = 250_000


def index(docs: DataFrame, fold: bytes = ALNUM) -> DataFrame:
    """The segments: seg (a number of its own), doc_ids, n_words, terms, n_postings and all positions, as a stored table."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("seg", T.LongType()), T.StructField("doc_ids", T.ArrayType(kind)), T.StructField("n_words", T.BinaryType()), T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("n_postings", T.BinaryType()), T.StructField("postings", T.BinaryType())])

    def one(values: pa.Array) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    def build(batches):
        seg = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in steps(batch):
                flat, at = words(part.column("text"), fold)
                code, terms = coded(flat)
                n = (at[1:] - at[:-1]).astype(np.int32)
                place = np.arange(len(code), dtype=np.int32) + np.repeat(np.arange(len(n), dtype=np.int32), n)
                order = np.argsort(code, kind="stable")
                lists = np.bincount(code, minlength=len(terms)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([seg], pa.int64()), one(part.column("doc_id")), pa.array([n.tobytes()], pa.binary()), one(terms.cast(pa.string())), pa.array([lists.tobytes()], pa.binary()), pa.array([place[order].tobytes()], pa.binary())], names=schema.names)
                seg += 1

    return written(docs.select("doc_id", "text").mapInArrow(build, schema), "postings")


class Segment:
    """One row of the index, opened."""

    def __init__(self, n_words: bytes, terms: pa.Array, n_postings: bytes, postings: bytes):
        self.n = np.frombuffer(n_words, np.int32)
        self.begin = np.cumsum(self.n.astype(np.int64) + 1) - self.n - 1
        self.terms = terms
        self.count = np.frombuffer(n_postings, np.int32)
        self.first = np.cumsum(self.count.astype(np.int64)) - self.count
        self.postings = np.frombuffer(postings, np.int32)
        self.length = int((self.n.astype(np.int64) + 1).sum())
        self._keys: np.ndarray | None = None

    @property
    def keys(self) -> np.ndarray:
        """All posting lists one after another, as term * length + position: sorted, so that a search among them is
        one within the list of its term."""
        if self._keys is None:
            self._keys = np.repeat(np.arange(len(self.count), dtype=np.int64) * self.length, self.count) + self.postings
        return self._keys

    def within(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Which positions stand in the lists of their terms."""
        key = term * self.length + position
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return self.keys[at] == key

    def codes(self, vocabulary: pa.Array) -> np.ndarray:
        """This segment's number of each word, or -1."""
        return pc.fill_null(pc.index_in(vocabulary, value_set=self.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def list_of(self, term: int) -> np.ndarray:
        return self.postings[self.first[term] : self.first[term] + self.count[term]]

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, position, "right") - 1

    def phrases(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (phrase, position) at which phrases (rows of term numbers, all of one length) stand."""
        alive = np.flatnonzero((terms >= 0).all(axis=1))
        found_phrase, found_start = [], []
        if len(alive) == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        terms = terms[alive]
        frequency = self.count[terms]
        rarest_first = np.argsort(frequency, axis=1, kind="stable")
        load = np.cumsum(frequency[np.arange(len(terms)), rarest_first[:, 0]].astype(np.int64))
        low = 0
        while low < len(terms):
            base = load[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(load, base + CANDIDATES, "right")))
            row = np.arange(low, high)
            shift = rarest_first[row, 0]
            term = terms[row, shift]
            which, place = ragged(self.first[term], self.count[term])
            start = self.postings[place] - shift[which]
            keep = (start >= 0) & (start + terms.shape[1] <= self.length)
            which, start = row[which[keep]], start[keep].astype(np.int64)
            for turn in range(1, terms.shape[1]):
                shift = rarest_first[which, turn]
                keep = self.within(terms[which, shift], start + shift)
                which, start = which[keep], start[keep]
            found_phrase.append(alive[which])
            found_start.append(start)
            low = high
        return np.concatenate(found_phrase), np.concatenate(found_start)

    def near(self, terms: np.ndarray, slop: int) -> np.ndarray:
        """Positions of the rarest term that have all other terms within `slop` positions, in the same document."""
        if (terms < 0).any():
            return np.zeros(0, np.int64)
        order = terms[np.argsort(self.count[terms], kind="stable")]
        spot = self.list_of(order[0]).astype(np.int64)
        for term in order[1:]:
            doc = self.doc_of(spot)
            other = self.list_of(term)
            low = np.maximum(spot - slop, self.begin[doc])
            high = np.minimum(spot + slop, self.begin[doc] + self.n[doc] - 1)
            spot = spot[np.searchsorted(other, low, "left") < np.searchsorted(other, high, "right")]
        return spot


def opened(batches):
    """The segments of Arrow batches, each with its number and doc_ids."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            yield row.column("seg")[0].as_py(), row.column("doc_ids").flatten(), Segment(row.column("n_words")[0].as_py(), row.column("terms").flatten(), row.column("n_postings")[0].as_py(), row.column("postings")[0].as_py())


def test_blocks(items: DataFrame, window: int = WINDOW, fold: bytes = ALNUM, most: int = BLOCK_WORDS):
    """The items' distinct windows, in blocks: (vocabulary, item names, {length: (term numbers, from where and how many
    items of each window, their numbers)}).

    Items are read one partition at a time and given out as soon as a block is full.
    """
    held, size = [], 0
    for row in items.select(F.col("item_id").cast("string").alias("i"), "text").toLocalIterator():
        own = words(pa.array([row["text"]], pa.string()), fold)[0].to_pylist()
        if own:
            held.append((row["i"], own))
            size += len(own)
        if size >= most:
            yield _block(held, window)
            held, size = [], 0
    if held:
        yield _block(held, window)


def _block(held, window):
    number: dict[str, int] = {}
    names: dict[str, int] = {}
    by_length: dict[int, dict[tuple, set]] = {}
    for item, own in held:
        code = [number.setdefault(w, len(number)) for w in own]
        who = names.setdefault(item, len(names))
        length = min(window, len(code))
        group = by_length.setdefault(length, {})
        for i in range(len(code) - length + 1):
            group.setdefault(tuple(code[i : i + length]), set()).add(who)
    out = {}
    for length, group in by_length.items():
        many = np.array([len(x) for x in group.values()], np.int32)
        out[length] = np.array(list(group), np.int32), np.cumsum(many) - many, many, np.array([i for x in group.values() for i in sorted(x)], np.int32)
    return pa.array(list(number), pa.string()), list(names), out


def _found(seg: Segment, block, edge: np.ndarray, met: dict[int, set]) -> None:
    """Adds what of a block stands in a segment: where words inside matches begin and end, and the items by document."""
    vocabulary, names, windows = block
    code = seg.codes(vocabulary)
    for length, (rows, first, many, items) in windows.items():
        phrase, start = seg.phrases(code[rows])
        np.add.at(edge, start, 1)
        np.add.at(edge, start + length, -1)
        pairs = np.unique(seg.doc_of(start) * len(rows) + phrase)
        of, place = ragged(first[pairs % len(rows)], many[pairs % len(rows)])
        for pair in np.unique(pairs[of] // len(rows) * len(names) + items[place]).tolist():
            met.setdefault(pair // len(names), set()).add(names[pair % len(names)])


def matches(segments: DataFrame, blocks: Iterable) -> DataFrame:
    """For each document its id, n_words, the [from, to) ranges of words inside matches, and the items met.

    Blocks are broadcast in a bounded number. Where there are more, each reading of the index is stored and what
    they found for a row put together.
    """
    spark = segments.sparkSession
    kind = segments.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("seg", T.LongType()), T.StructField("row", T.IntegerType()), T.StructField("n_words", T.LongType()), T.StructField("ranges", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType()))])

    def search_with(some: tuple) -> DataFrame:
        sent = spark.sparkContext.broadcast(some)

        def search(batches):
            for number, ids, seg in opened(batches):
                edge = np.zeros(seg.length + 1, np.int32)
                met: dict[int, set] = {}
                for block in sent.value:
                    _found(seg, block, edge, met)
                inside = np.concatenate([[0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0]])
                change = np.flatnonzero(np.diff(inside))
                doc = seg.doc_of(change[::2])
                ranges: dict[int, list] = {}
                for d, a, b in zip(doc.tolist(), (change[::2] - seg.begin[doc]).tolist(), (change[1::2] - seg.begin[doc]).tolist()):
                    ranges.setdefault(d, []).extend((a, b))
                n = len(seg.n)
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(n, number, np.int64)), pa.array(np.arange(n, dtype=np.int32)), pa.array(seg.n.astype(np.int64)), pa.array([ranges.get(i, []) for i in range(n)], pa.list_(pa.int32())), pa.array([sorted(met.get(i, ())) for i in range(n)], pa.list_(pa.string()))], names=schema.names)

        return segments.mapInArrow(search, schema)

    passes = batched(blocks, PASS_BLOCKS)
    first, second = next(passes, ()), next(passes, None)
    if second is None:
        return search_with(first).drop("seg", "row")
    every = written(search_with(first), "found")
    for more in chain([second], passes):
        every = every.unionByName(written(search_with(more).where("size(ranges) > 0"), "found"))
    rows = every.groupBy("seg", "row").agg(F.min("doc_id").alias("doc_id"), F.min("n_words").alias("n_words"), F.flatten(F.collect_list("ranges")).alias("ranges"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return rows.select("doc_id", "n_words", "ranges", "items")


def digest(found: DataFrame) -> DataFrame:
    """n_hit and the items' hash from ranges and items."""
    kind = found.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType())])

    def sums(batches):
        for b in batches:
            hit = []
            for flat in b.column("ranges").to_pylist():
                total = end = 0
                for a, z in sorted(zip(flat[::2], flat[1::2])):
                    total += max(0, z - max(a, end))
                    end = max(end, z)
                hit.append(total)
            items = b.column("items").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()), pa.array([h > 0 for h in hit], pa.bool_())], names=schema.names)

    return found.mapInArrow(sums, schema)


def proximity(segments: DataFrame, queries: list[list[str]], slop: int) -> DataFrame:
    """doc_id, query (its number) and position (word of the document) of every place of a query's rarest term with
    all its other terms within `slop` words."""
    kind = segments.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("query", T.IntegerType()), T.StructField("position", T.LongType())])

    def search(batches):
        for _, ids, seg in opened(batches):
            for q, terms in enumerate(queries):
                spot = seg.near(seg.codes(pa.array(list(dict.fromkeys(terms)), pa.string())), slop)
                doc = seg.doc_of(spot)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), pa.array(np.full(len(spot), q, np.int32)), pa.array((spot - seg.begin[doc]).astype(np.int64))], names=schema.names)

    return segments.mapInArrow(search, schema)


def op5_decontamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    return digest(matches(index(docs), test_blocks(items)))


@carried
def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no window of a test item."""
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64("text").cast("string"))
    keyed = docs.withColumn("_key", key)
    met = matches(index(keyed.select(F.col("_key").alias("doc_id"), "text")), test_blocks(items)).where("size(ranges) > 0")
    return keyed.join(met.select(F.col("doc_id").alias("_key")).distinct(), "_key", "left_anti").select(*docs.columns)


OP5_SQL = r"""
WITH dw AS (
  SELECT rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM documents)),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT k FROM win),
hits AS (
  SELECT rid, i, d.k, item_id
  FROM (SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS s
        FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, lens WHERE len(w) >= k)) d
  JOIN win ON win.k = d.k AND win.s = d.s),
covered AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, unnest(range(i, i + k)) AS p FROM hits) GROUP BY rid),
met AS (
  SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(m.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered c USING (rid) LEFT JOIN met m USING (rid)
"""
