"""Substring dedup with fixed-block anchors.

A window of 50 words always holds one whole block of 25 words that starts at a multiple of 25 of its document.
So the blocks at multiples of 25 are the reference index, every rolling 25-word window of every document is a
probe, and two documents that share a window meet at a block of the one and a probe of the other. Around the
anchors that met, the match is extended word by word to all 50-word windows that hold them; the runs of windows
that another document starts as well are the maximal exact repeats.

How it runs: documents are dealt into groups by a hash of doc_id (one shuffle of the texts, used three times).
1. Probes and blocks travel as sorted, delta-coded 40-bit hashes, about three bytes each, in one row for each
   group and hash range; a range tells each group which of its hashes are anchors (a block in one document and
   a probe in another).
2. Groups send 96 bits of two hashes of the 50-word windows around anchors with the smallest doc_id that has them; a
   range tells each group which windows start in a smaller document elsewhere.
3. Groups mark the words covered by such windows. No step compares documents in pairs, and a hash that
   thousands of documents share is one entry for each group.

Edge cases: null and empty texts have no words; rows without a doc_id neither lose words nor make others lose
them; rows that repeat a doc_id are of one document, so they do not cover each other; an empty table gives an empty result;
extra columns are passed on by `deduplicated`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.arrowtext import coded, hashes, raw, steps, words
from sparkloom.llm.store import carried, partitions

WINDOW = 50
#: Odd bases and seeds of the two hashes of windows.
_FIRST, _SECOND = (0x9E3779B97F4A7C15, 7), (0xC2B2AE3D27D4EB4F, 11)
#: Bits of an anchor's hash. A chance meeting costs a few more windows in step 2, never a wrong result.
ANCHOR_BITS = 40


class Rolled:
    """The words of some texts as numbers, and hashes of their rolling windows."""

    def __init__(self, texts: pa.Array):
        flat, self.at = words(texts)
        self.code, self.distinct = coded(flat)
        self.n = self.at[1:] - self.at[:-1]
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        self.first, self.second = self._rolled(*_FIRST), None

    def _rolled(self, base: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Running sums of the words' hashes times powers of a base, and the powers of its inverse."""
        size = len(self.code)
        token = hashes(self.distinct, seed)[self.code] if size else np.zeros(0, np.uint64)
        total = np.zeros(size + 1, np.uint64)
        power, back = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        power[:1] = back[:1] = 1
        with np.errstate(over="ignore"):
            np.cumprod(power, out=power)
            np.cumsum(token * power, out=total[1:])
            np.cumprod(back, out=back)
        return total, back

    def starts(self, length: int) -> np.ndarray:
        """Where windows of so many words begin."""
        return np.flatnonzero(np.arange(len(self.doc)) + length <= self.at[1:][self.doc]) if len(self.doc) else np.zeros(0, np.int64)

    def windows(self, starts: np.ndarray, length: int) -> np.ndarray:
        return _mixed(*self.first, starts, length)

    def checks(self, starts: np.ndarray, length: int) -> np.ndarray:
        """32 bits of a second hash, made only where windows are compared for good."""
        if self.second is None:
            self.second = self._rolled(*_SECOND)
        return (_mixed(*self.second, starts, length) >> np.uint64(32)).astype(np.uint32)


def _mixed(total: np.ndarray, back: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (total[starts + length] - total[starts]) * back[starts]
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def packed(values: np.ndarray) -> bytes:
    """Sorted numbers as differences, in as many bytes each as the largest needs; bytes of one weight together."""
    step = np.diff(values, prepend=np.uint64(0))
    width = max(1, -(-int(step.max()).bit_length() // 8))
    return bytes([width]) + np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    plane = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    step = np.zeros((plane.shape[1], 8), np.uint8)
    step[:, :width] = plane.T
    return np.cumsum(step.view(np.uint64).ravel())


#: Text bytes of a group of documents and of a range of hashes. Both follow from the size of the input, so that a
#: row between a group and a range holds hundreds of hashes at 50 GB and still tens at a hundred times that.
GROUP_BYTES, RANGE_BYTES = 8 << 20, 16 << 20


def _shape(docs: DataFrame, n: int) -> tuple[int, int]:
    """How many groups, and bits of the range number; small inputs are split finer to use up to n tasks."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    split = lambda by: max(1, -(-size // by), min(n, size >> 20))
    return split(GROUP_BYTES), min(32, (split(RANGE_BYTES) - 1).bit_length())


def _runs(*values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin; of several arrays, of values that are equal in all."""
    new = np.zeros(max(0, len(values[0]) - 1), bool)
    for v in values:
        new |= v[1:] != v[:-1]
    return np.flatnonzero(np.concatenate([[True], new])) if len(values[0]) else np.zeros(0, np.int64)


def _cut(sorted_: np.ndarray, shift: int) -> list[tuple[int, int, int]]:
    """(range, from, to) of sorted hashes by their upper bits."""
    at = _runs(sorted_ >> np.uint64(shift))
    ends = np.append(at[1:], len(sorted_))
    return [(int(sorted_[a] >> np.uint64(shift)), int(a), int(b)) for a, b in zip(at, ends)]


def _ids(column) -> tuple[np.ndarray, np.ndarray]:
    """doc_ids as longs, and which of them are there."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    there = pc.is_valid(column).to_numpy(zero_copy_only=False)
    return pc.fill_null(column.cast(pa.int64()), 0).to_numpy(zero_copy_only=False), there


def _probes(bits: int, block: int):
    shift = ANCHOR_BITS - bits

    def run(batches):
        for batch in batches:
            for part in steps(batch):
                r = Rolled(part.column("text"))
                _, there = _ids(part.column("doc_id"))
                start = r.starts(block)
                start = start[there[r.doc[start]]] if len(start) else start
                if not len(start):
                    continue
                h = r.windows(start, block) >> np.uint64(64 - ANCHOR_BITS)
                doc = r.doc[start]
                is_block = (start - r.at[doc]) % block == 0
                group = part.column("_g").to_numpy()[doc]
                rows: dict[str, list] = {"r": [], "g": [], "h": [], "f": []}
                for g in np.unique(group):
                    own = np.flatnonzero(group == g)
                    order = own[np.argsort(h[own], kind="stable")]
                    hs, ds = h[order], doc[order]
                    first = _runs(hs)
                    same = np.concatenate([[False], (hs[1:] == hs[:-1]) & (ds[1:] != ds[:-1])])
                    flags = np.logical_or.reduceat(is_block[order], first).astype(np.uint8) | np.logical_or.reduceat(same, first).astype(np.uint8) << 1
                    hs = hs[first]
                    for k, a, b in _cut(hs, shift):
                        rows["r"].append(k)
                        rows["g"].append(int(g))
                        rows["h"].append(packed(hs[a:b] & np.uint64((1 << shift) - 1)))
                        rows["f"].append(np.packbits(flags[a:b, None] >> np.arange(2, dtype=np.uint8) & 1).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(rows["r"], pa.int32()), pa.array(rows["g"], pa.int32()), pa.array(rows["h"], pa.binary()), pa.array(rows["f"], pa.binary())], names=["r", "g", "h", "f"])

    return run


def _anchored(bits: int):
    shift = ANCHOR_BITS - bits

    def run(table: pa.Table) -> pa.Table:
        r = table.column("r")[0].as_py()
        g = table.column("g").to_pylist()
        each = [unpacked(x) for x in table.column("h").to_pylist()]
        flags = [np.unpackbits(np.frombuffer(f, np.uint8), count=2 * len(h)).reshape(-1, 2) for f, h in zip(table.column("f").to_pylist(), each)]
        every = np.concatenate(each)
        flag = np.concatenate(flags)
        order = np.argsort(every, kind="stable")
        hs = every[order]
        first = _runs(hs)
        many = np.diff(np.append(first, len(hs))) > 1
        hit = np.logical_or.reduceat(flag[order, 0], first).astype(bool) & (many | np.logical_or.reduceat(flag[order, 1], first).astype(bool))
        anchors = hs[first[hit]]
        out_g, out_h = [], []
        if len(anchors):
            base = np.uint64(r << shift)
            for own, h in zip(g, each):
                i = np.minimum(np.searchsorted(anchors, h), len(anchors) - 1)
                got = h[anchors[i] == h]
                if len(got):
                    out_g.append(own)
                    out_h.append(packed(got | base))
        return pa.table({"_g": pa.array(out_g, pa.int32()), "h": pa.array(out_h, pa.binary())})

    return run


def _within(values: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(values), bool)
    i = np.searchsorted(sorted_, values)
    i[i == len(sorted_)] = 0
    return sorted_[i] == values


def _extended(bits: int, window: int, block: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: dict[str, list] = {"r": [], "g": [], "h": [], "d": []}
        anchors = np.unique(np.concatenate([unpacked(x) for x in right.column("h").to_pylist()])) if right.num_rows and left.num_rows else []
        if len(anchors):
            g = left.column("_g")[0].as_py()
            for batch in left.combine_chunks().to_batches():
                for part in steps(batch):
                    r = Rolled(part.column("text"))
                    ids, there = _ids(part.column("doc_id"))
                    start = r.starts(block)
                    met = np.zeros(len(r.doc) + 1, np.int64)
                    if len(start):
                        met[start + 1] = _within(r.windows(start, block) >> np.uint64(64 - ANCHOR_BITS), anchors)
                    met = np.cumsum(met)
                    start = r.starts(window)
                    start = start[(met[start + window - block + 1] > met[start]) & there[r.doc[start]]] if len(start) else start
                    if not len(start):
                        continue
                    h, c, d = r.windows(start, window), r.checks(start, window), ids[r.doc[start]]
                    order = np.lexsort((d, c, h))
                    order = order[_runs(h[order], c[order])]
                    h, c, d = h[order], c[order], d[order]
                    for k, a, b in _cut(h, 64 - bits):
                        by_doc = np.argsort(d[a:b], kind="stable")
                        rows["r"].append(k)
                        rows["g"].append(g)
                        rows["h"].append(h[a:b][by_doc].tobytes() + c[a:b][by_doc].tobytes())
                        own = d[a:b][by_doc]
                        at = _runs(own)
                        rows["d"].append(own[at].tobytes() + np.diff(np.append(at, len(own))).astype(np.int32).tobytes())
        return pa.table({"r": pa.array(rows["r"], pa.int32()), "g": pa.array(rows["g"], pa.int32()), "h": pa.array(rows["h"], pa.binary()), "d": pa.array(rows["d"], pa.binary())})

    return run


def _hashes_read(rows: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Both hashes of each row's windows."""
    return [(np.frombuffer(x, np.uint64, len(x) // 12), np.frombuffer(x, np.uint32, -1, len(x) // 12 * 8)) for x in rows]


def _runs_read(data: bytes) -> np.ndarray:
    n = len(data) // 12
    return np.repeat(np.frombuffer(data, np.int64, n), np.frombuffer(data, np.int32, n, 8 * n))


def _earlier(table: pa.Table) -> pa.Table:
    """For each group the windows of this range that start in a smaller document, with the smallest one."""
    each = _hashes_read(table.column("h").to_pylist())
    docs = [_runs_read(x) for x in table.column("d").to_pylist()]
    h, c, d = np.concatenate([x[0] for x in each]), np.concatenate([x[1] for x in each]), np.concatenate(docs)
    order = np.lexsort((d, c, h))
    first = _runs(h[order], c[order])
    size = np.diff(np.append(first, len(h)))
    least = np.empty(len(h), np.int64)
    least[order] = np.repeat(d[order][first], size)
    at = np.cumsum([0, *map(len, docs)])
    out = {"_g": [], "h": [], "d": []}
    for g, a, b in zip(table.column("g").to_pylist(), at, at[1:]):
        got = np.flatnonzero(least[a:b] < d[a:b])
        if len(got):
            by = got[np.argsort(least[a:b][got], kind="stable")]
            m = least[a:b][by]
            run = _runs(m)
            out["_g"].append(g)
            out["h"].append(h[a:b][by].tobytes() + c[a:b][by].tobytes())
            out["d"].append(m[run].tobytes() + np.diff(np.append(run, len(m))).astype(np.int32).tobytes())
    return pa.table({"_g": pa.array(out["_g"], pa.int32()), "h": pa.array(out["h"], pa.binary()), "d": pa.array(out["d"], pa.binary())})


def covered_words(texts: pa.Array, ids: np.ndarray, there: np.ndarray, window: int, known: np.ndarray, check: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words of texts (in order of doc_id) are covered, and where each text's words begin.

    known, check, least: both hashes, in order, of windows that start in a smaller document of another group, and that document.
    """
    r = Rolled(texts)
    start = r.starts(window)
    start = start[there[r.doc[start]]] if len(start) else start
    edge = np.zeros(len(r.doc) + 1, np.int32)
    if len(start):
        h, c, d = r.windows(start, window), r.checks(start, window), ids[r.doc[start]]
        order = np.lexsort((d, c, h))
        first = _runs(h[order], c[order])
        best, own, sure = d[order][first], h[order][first], c[order][first]
        if len(known):
            at = np.searchsorted(known, own)
            for step in range(int(np.diff(np.append(_runs(known), len(known))).max())):  # one step, but for chance collisions
                i = np.minimum(at + step, len(known) - 1)
                best = np.where((known[i] == own) & (check[i] == sure), np.minimum(best, least[i]), best)
        low = np.empty(len(h), np.int64)
        low[order] = np.repeat(best, np.diff(np.append(first, len(h))))
        hit = start[low < d]
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + window, -1)
    return np.cumsum(edge[:-1]) > 0, r.at


def _marked(window: int, columns: list[str], digest: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.take(pc.sort_indices(left, sort_keys=[("doc_id", "ascending")])).combine_chunks()
        known, check, least = np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if right.num_rows:
            each = _hashes_read(right.column("h").to_pylist())
            known, check = np.concatenate([x[0] for x in each]), np.concatenate([x[1] for x in each])
            least = np.concatenate([_runs_read(x) for x in right.column("d").to_pylist()])
            order = np.lexsort((least, check, known))
            order = order[_runs(known[order], check[order])]
            known, check, least = known[order], check[order], least[order]
        ids, there = _ids(left.column("doc_id"))
        gone, at = covered_words(left.column("text").combine_chunks(), ids, there, window, known, check, least)
        offsets, data = raw(left.column("text"))
        off = offsets.tolist()
        total = np.concatenate([[0], np.cumsum(gone)])
        removed = total[at[1:]] - total[at[:-1]]
        kept = []
        for i, n in enumerate(removed.tolist()):
            own = data[off[i] : off[i + 1]].split()
            if n:
                own = [w for w, x in zip(own, gone[at[i] : at[i + 1]].tolist()) if not x]
            joined = b" ".join(own)
            kept.append(hashlib.sha256(joined).hexdigest() if digest else joined.decode("utf-8", "replace") if n else None)
        out = {c: left.column(c) for c in columns}
        return pa.table([*out.values(), pa.array(at[1:] - at[:-1], pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=[*columns, "_n_words", "_n_removed", "_kept"])

    return run


def deduplicated(docs: DataFrame, window: int = WINDOW, digest: bool = False) -> DataFrame:
    """The documents with _n_words, _n_removed and _kept: the hash of the kept words if `digest`, else the kept
    words of documents that lose some (null for the others, whose text stays as it is)."""
    spark = docs.sparkSession
    block = window // 2
    n = partitions(spark)
    groups, bits = _shape(docs, n)
    id_hash = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")))
    columns = ["doc_id"] if digest else docs.columns
    dealt = docs.select(*dict.fromkeys([*columns, "doc_id", "text"])).withColumn("_g", F.pmod(id_hash, F.lit(groups)).cast("int")).repartition(n, "_g").sortWithinPartitions("_g")
    probes = dealt.select("doc_id", "text", "_g").mapInArrow(_probes(bits, block), "r int, g int, h binary, f binary")
    anchors = probes.groupBy("r").applyInArrow(_anchored(bits), "_g int, h binary")
    by_group = dealt.groupBy("_g")
    around = by_group.cogroup(anchors.groupBy("_g")).applyInArrow(_extended(bits, window, block), "r int, g int, h binary, d binary")
    earlier = around.groupBy("r").applyInArrow(_earlier, "_g int, h binary, d binary")
    fields = [docs.schema[c] for c in columns]
    schema = T.StructType([*fields, T.StructField("_n_words", T.LongType()), T.StructField("_n_removed", T.LongType()), T.StructField("_kept", T.StringType())])
    return by_group.cogroup(earlier.groupBy("_g")).applyInArrow(_marked(window, columns, digest), schema)


@carried
def cleaned(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without what they repeat of smaller ones; those that lose all their words are dropped."""
    out = deduplicated(docs, window).where("_n_removed = 0 or _n_removed < _n_words")
    text = F.coalesce("_kept", "text")
    size = {"n_chars": F.when(F.col("_n_removed") > 0, F.length("_kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {}
    return out.withColumns({"text": text} | size).select(*docs.columns)


def op9_anchors(docs: DataFrame) -> DataFrame:
    out = deduplicated(docs.select("doc_id", "text"), digest=True)
    return out.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.col("_kept").alias("kept_sha256"))


OP9_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT rid, doc_id, i, hash(array_to_string(w[i:i + 49], ' ')) AS h, md5(array_to_string(w[i:i + 49], ' ')) AS m
  FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50 AND doc_id IS NOT NULL)),
hit AS (SELECT rid, i FROM (SELECT rid, i, doc_id, min(doc_id) OVER (PARTITION BY h, m) AS least FROM win) WHERE least < doc_id),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 50)) AS p FROM hit),
lost AS (SELECT rid, count(*) AS n, list(p) AS p FROM gone GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ')
              ELSE coalesce((SELECT string_agg(x, ' ' ORDER BY k) FROM (SELECT unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k) WHERE NOT list_contains(p, k)), '') END) AS kept_sha256
FROM d LEFT JOIN lost USING (rid)
"""
