"""Hard-negative mining: integer inner products of anchors with all rows, pruned in an orthogonal PCA rotation.

Rows are vectors of integers, floor(256 x). The second moments of all rows are summed by Spark; their eigenvectors give a
rotation that moves most of a vector into its leading components and keeps every inner product. Anchors meet all rows in
blocks: a block of anchors and a slab of rows are one task's group, of bounded bytes. There the partial products over the
leading components are taken, a quarter at a time; what the rest can add is at most the product of the two residual
norms, plus a slack for rounding, and pairs that can't reach what is asked for any more are dropped. Those that remain
are verified by the product of the integers themselves, so every score is exact.

First each anchor's best rows of its own label are found (its positives); then, for each of them, the best rows of other
labels whose score lies between two shares of the positive's. Each group hands on a few rows for each anchor, and a
window picks the best of them.

Edge cases: a row with a null label, a null vector or a null or non-finite component takes no part, nor does one
whose squared norm exceeds 2^50, so that scores are exact as doubles too. Vectors of other lengths count as filled up with
zeros. Repeated rows, and different ones of one id, are rows of their own, and positives or anchors of their own; an anchor
is never its own positive. A null id is no anchor, and stands behind other ids at equal scores. Other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.llm.store import partitions, written

#: Digits of a component, which rows are anchors, how many positives and negatives, and their shares in hundredths.
SCALE, EVERY, POSITIVES, NEGATIVES, LEAST, MOST = 256, 50, 5, 3, 50, 95
#: The largest squared norm: no product of two rows is above it, and doubles hold it exactly.
NORM_LIMIT = 1 << 50
#: Bytes of a block of anchors and of a slab of rows, each as doubles, and pairs that a step looks at.
BLOCK_BYTES, SLAB_BYTES, STEP_PAIRS = 16 << 20, 32 << 20, 1 << 21
#: Rows of a slab at least, so that small tables aren't cut into crumbs.
LEAST_SLAB = 512
#: Rounding slack, as a share of the product of two norms: far above d * 2^-53 for d up to a million components.
SLACK = 1e-9
#: Pairs that are left, as a share, from which on they are listed instead of multiplied as whole blocks.
FEW = 0.02


def prepared(vectors: DataFrame, label: Column | None = None) -> DataFrame:
    """rid, vec_id, label, ints: the rows that take part, numbered."""
    ints = F.transform("embedding", lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(2.0**31)), F.lit(False)))
    norm = F.aggregate("ints", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    whole = vectors.select("vec_id", F.col("label").alias("_label"), "embedding").where(F.col("_label").isNotNull() & F.col("embedding").isNotNull())
    out = whole.select("vec_id", (F.col("_label") if label is None else label).cast("long").alias("label"), F.when(finite, ints).alias("ints"))
    return out.where(F.col("ints").isNotNull() & (norm <= float(NORM_LIMIT))).select(F.monotonically_increasing_id().alias("rid"), "vec_id", "label", "ints")


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """A list column as a matrix of d columns, filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = column.offsets.to_numpy()
    flat = column.values.to_numpy()
    size = np.diff(at)
    if (size == d).all():
        return flat[at[0] : at[-1]].reshape(-1, d)
    out = np.zeros((len(size), d), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(at[0], at[-1]) - at[:-1][row]] = flat[at[0] : at[-1]]
    return out


def rotation(rows: DataFrame, d: int) -> np.ndarray:
    """An orthogonal matrix whose first columns hold the most of the rows' second moments. The d x d sums are added up by
    Spark; what reaches the driver is one matrix."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros((d, d)), False
        for b in batches:
            x = matrix(b.column(0), d).astype(np.float64)
            total += x.T @ x
            some = some or len(x) > 0
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d), pa.int32()), pa.array(total.ravel())], names=["at", "s"])

    got = rows.select("ints").mapInArrow(sums, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).toPandas()
    moments = np.zeros(d * d)
    moments[got["at"].to_numpy()] = got["s"].to_numpy()
    moments = moments.reshape(d, d)
    _, axes = np.linalg.eigh((moments + moments.T) / 2)
    return np.ascontiguousarray(axes[:, ::-1])


class _Best:
    """The best few (score, id) of each anchor and band, as rows come in."""

    def __init__(self, many: int) -> None:
        self.many = many
        self.cell, self.score, self.id, self.null = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.bool_))

    def add(self, cell: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        c, s, i, n = (np.concatenate(p) for p in ((self.cell, cell), (self.score, score), (self.id, ids), (self.null, null)))
        order = np.lexsort((i, n, -s, c))
        c = c[order]
        nth = np.arange(len(c)) - np.searchsorted(c, c, "left")
        keep = order[nth < self.many]
        self.cell, self.score, self.id, self.null = c[nth < self.many], s[keep], i[keep], n[keep]

    def bar(self, cells: int) -> np.ndarray:
        """The last score that counts of each cell, once it is full."""
        out = np.full(cells, -np.inf)
        nth = np.arange(len(self.cell)) - np.searchsorted(self.cell, self.cell, "left")
        full = nth == self.many - 1
        out[self.cell[full]] = self.score[full]
        return out


def _pairs(xa, xb, ya, yb, wanted, low, high, pick=0):
    """Exact scores of all wanted pairs that can lie between low and high of their anchor: (anchor, row, score). With
    `pick`, low rises to the pick-th best that a whole product shows. Bounds are those of the rotated vectors: after each
    quarter of the components the rest adds at most the product of the residual norms, and the slack."""
    d = ya.shape[1]
    na, nb = np.sqrt((ya * ya).sum(1)), np.sqrt((yb * yb).sum(1))
    slack = SLACK * np.outer(na, nb) + 1e-6
    part, alive, at, listed = np.zeros((len(ya), len(yb))), wanted, 0, None
    for to in [max(1, d * k // 4) for k in (1, 2, 3)] + [d] if d else []:
        if to == at:
            continue
        ra, rb = (np.sqrt((y[:, to:] ** 2).sum(1)) for y in (ya, yb))
        if listed is None:
            part += ya[:, at:to] @ yb[:, at:to].T
            rest = np.outer(ra, rb) + slack
            alive = alive & (part + rest >= low[:, None]) & (part - rest <= high[:, None])
            if to == d and pick and alive.shape[1] > pick:
                sure = np.where(alive, part - slack, -np.inf)
                low = np.maximum(low, np.partition(sure, -pick, axis=1)[:, -pick])
                alive &= part + slack >= low[:, None]
            if to < d and alive.sum() <= FEW * alive.size:
                ia, ib = np.nonzero(alive)
                listed = ia, ib, part[ia, ib]
        else:
            ia, ib, s = listed
            s = s + np.einsum("ij,ij->i", ya[ia, at:to], yb[ib, at:to])
            rest = ra[ia] * rb[ib] + slack[ia, ib]
            keep = (s + rest >= low[ia]) & (s - rest <= high[ia])
            listed = ia[keep], ib[keep], s[keep]
        at = to
    ia, ib = np.nonzero(alive) if listed is None else listed[:2]
    score = np.empty(len(ia), np.int64)
    step = max(1, (8 << 20) // (8 * max(1, d)))
    for k in range(0, len(ia), step):  # the integers themselves
        score[k : k + step] = np.einsum("ij,ij->i", xa[ia[k : k + step]], xb[ib[k : k + step]])
    return ia, ib, score


def met(anchors: DataFrame, rows: DataFrame, axes: np.ndarray, counts: tuple[int, int], many: int, same: bool) -> DataFrame:
    """rid (the anchor's), band, score, vec_id: the best `many` rows of each band (arrays low and high) of each anchor, of
    its label or of the others, within each slab of rows."""
    d = len(axes)
    width = 8 * max(1, d)
    blocks = -(-counts[0] * width // BLOCK_BYTES) or 1
    slabs = max(-(-counts[1] * width // SLAB_BYTES), min(partitions(rows.sparkSession), -(-counts[1] // LEAST_SLAB)), 1)
    home = axes.tobytes()

    said = {"rid": pa.int64(), "band": pa.int32(), "score": pa.int64(), "vec_id": pa.int64()}

    def group(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.schema(said).empty_table()
        r = np.frombuffer(home).reshape(d, d)
        best = _Best(many)
        xa, xb = matrix(left.column("ints"), d), matrix(right.column("ints"), d)
        la, lb = left.column("label").to_numpy(), right.column("label").to_numpy()
        aid, bid = left.column("rid").to_numpy(), right.column("rid").to_numpy()
        id_null = right.column("vec_id").is_null().to_numpy()
        ids = right.column("vec_id").fill_null(0).to_numpy()
        lows, highs = left.column("low").to_pylist(), left.column("high").to_pylist()
        bands = max((len(x) for x in lows), default=0)
        low, high = np.full((len(xa), bands), np.inf), np.full((len(xa), bands), -np.inf)
        for k, (a, b) in enumerate(zip(lows, highs)):
            low[k, : len(a)], high[k, : len(b)] = a, b
        ya = xa.astype(np.float64) @ r
        step = max(1, STEP_PAIRS // max(1, len(xa)))
        for k in range(0, len(xb), step) if bands and len(xa) else ():
            to = slice(k, k + step)
            wanted = (la[:, None] == lb[None, to]) == same
            if same:
                wanted &= aid[:, None] != bid[None, to]
            bar = np.maximum(low, best.bar(low.size).reshape(low.shape))
            ia, ib, score = _pairs(xa, xb[to], ya, xb[to].astype(np.float64) @ r, wanted, np.where(low <= high, bar, np.inf).min(1), high.max(1), many if same else 0)
            for band in range(bands):
                within = (score >= bar[ia, band]) & (score <= high[ia, band])
                best.add(ia[within] * bands + band, score[within], ids[to][ib[within]], id_null[to][ib[within]])
        row, band = np.divmod(best.cell, max(1, bands))
        return pa.table([aid[row], band, best.score, pa.array(best.id, mask=best.null)], names=list(said)).cast(pa.schema(said))

    deal = lambda n: F.pmod(F.xxhash64("rid"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # both sides stem from one table; without new names Spark would take columns of the one for those of the other
    left = anchors.select("rid", "label", "ints", "low", "high", deal(blocks).alias("block"), every(slabs).alias("slab"))
    right = rows.select(*[F.col(c).alias(c) for c in ("rid", "vec_id", "label", "ints")], deal(slabs).alias("slab"), every(blocks).alias("block"))
    return left.groupBy("block", "slab").cogroup(right.groupBy("block", "slab")).applyInArrow(group, "rid long, band int, score long, vec_id long")


def _first(found: DataFrame, keys: list[str], many: int) -> DataFrame:
    order = [F.desc("score"), F.col("vec_id").asc_nulls_last()]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= many)


def mined(vectors: DataFrame, anchor: Column, label: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST) -> DataFrame:
    """anchor_id, positive_id, positive (its place), rank, negative_id, positive_score, negative_score. `anchor` says which
    rows (by vec_id, label) are anchors; `label` replaces the label (`_label`, vec_id); shares are in hundredths."""
    rows = written(prepared(vectors, label), "vectors")
    asked = F.coalesce(anchor, F.lit(False))
    n, n_anchors, d = rows.agg(F.count("*"), F.count_if(asked), F.coalesce(F.max(F.size("ints")), F.lit(0))).first()
    axes = rotation(rows, d) if d else np.zeros((0, 0))
    own = rows.where(asked)
    any_ = own.select("*", F.array(F.lit(float("-inf"))).alias("low"), F.array(F.lit(float("inf"))).alias("high"))
    good = _first(met(any_, rows, axes, (n_anchors, n), positives, True), ["rid"], positives)
    good = written(good.select("rid", (F.col("rank") - 1).alias("band"), F.col("score").alias("positive_score"), F.col("vec_id").alias("positive_id")), "positives")
    # 100 s lies between least p and most p: the least and the largest integer s
    p = F.col("positive_score")
    hundredth = lambda x: ((x - F.pmod(x, F.lit(100).cast("long"))) / 100).cast("double")
    bands = good.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("band", (-hundredth(-p * least)).alias("low"), hundredth(p * most).alias("high")))).alias("b"))
    bands = bands.select("rid", F.col("b.low").alias("low"), F.col("b.high").alias("high"))
    bad = _first(met(own.join(bands, "rid"), rows, axes, (n_anchors, n), negatives, False), ["rid", "band"], negatives)
    names = own.select("rid", F.col("vec_id").alias("anchor_id"))
    return bad.join(good, ["rid", "band"]).join(names, "rid").select("anchor_id", "positive_id", (F.col("band") + 1).alias("positive"), "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_negatives(vectors: DataFrame) -> DataFrame:
    """Every row whose id is divisible by 50 is an anchor; the label of ids divisible by 7 is the next one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("_label").cast("long") + 1) % 10).otherwise(F.col("_label").cast("long"))
    out = mined(vectors, F.col("vec_id") % EVERY == 0, label)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


OP13_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda x: floor({SCALE}.0::DOUBLE * x::DOUBLE)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (
  SELECT a.rid AS aid, a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.rid <> b.rid WHERE a.vec_id % {EVERY} = 0),
good AS (SELECT *, row_number() OVER (PARTITION BY aid ORDER BY score DESC, vec_id) AS place FROM scored WHERE same QUALIFY place <= {POSITIVES})
SELECT g.anchor_id, g.vec_id AS positive_id,
       CAST(row_number() OVER (PARTITION BY g.aid, g.place ORDER BY s.score DESC, s.vec_id) AS INT) AS rank,
       s.vec_id AS negative_id, g.score AS positive_score, s.score AS negative_score
FROM good g JOIN scored s ON g.aid = s.aid AND NOT s.same AND {LEAST} * g.score <= 100 * s.score AND 100 * s.score <= {MOST} * g.score
QUALIFY rank <= {NEGATIVES}
"""
