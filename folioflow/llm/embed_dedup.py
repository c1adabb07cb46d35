"""Embedding near-duplicates by PCA-ordered tiled comparison.

Unit vectors are turned into the axes of a principal component analysis, leading axis first. For a pair
the products of the leading axes are added up first; the rest is at most the product of the norms of
the two suffixes, so a pair whose sum and bound stay below the threshold is left. What remains goes on
to the next axes, and at the end is verified by the cosine of the given vectors in double precision.

Vectors lie in tiles, made by cutting the leading ``BOX_AXES`` axes at medians, the widest first, and each tile has the box of its vectors
on those axes. Two tiles meet only if their boxes are near enough (the distance of two vectors at the threshold is sqrt(2 - 2 t)),
each pair of tiles in a task of its own; of other pairs no vector is shipped.

Scale: the axes and cuts come from at most ``SAMPLE_ROWS`` vectors; any orthogonal axes and cuts give the same links. Equal
vectors are one class first. A tile holds ``TILE_BYTES``; a leaf of the cuts with more vectors is several tiles. Links are counted and reduced
to a spanning forest inside each task. Where vectors have no leading axes (the spectrum is flat), no box is far from another, and each vector goes to all tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._graph import LINK_SCHEMA, LinkTally, connected_components
from ._shared import free_name, join_counted, release, table, written

THRESHOLD = 0.95
SAMPLE_ROWS = 20_000
#: Bytes in double precision of the vectors of a tile.
TILE_BYTES = 8 << 20
#: The most leaves of the cuts; the driver holds their boxes.
MAX_LEAVES = 1 << 12
BOX_AXES = 8
#: Products held at a time.
_STRIP = 1 << 22
#: More than the rounding of single-precision sums of unit vectors.
_MARGIN = 2e-5


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_dim(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    size = np.asarray(column.value_lengths())
    for d in np.unique(size).tolist():
        yield d, np.flatnonzero(size == d)


def tile_links(x: np.ndarray, y: np.ndarray | None, axes: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of x with rows of y (or with later rows of x) whose cosine is the threshold or more."""
    d = x.shape[1]
    ux = _unit(x)
    uy = ux if y is None else _unit(y)
    rx, ry = (ux @ axes).astype(np.float32), (uy @ axes).astype(np.float32)
    cuts = sorted({max(1, d // 4), max(1, d // 2), d})
    rest = lambda r: [np.sqrt(np.maximum(0, (r[:, c:].astype(np.float64) ** 2).sum(1))).astype(np.float32) for c in cuts]
    sx, sy = rest(rx), rest(ry)
    first = cuts[0]
    lead_y = np.concatenate([ry[:, :first], sy[0][:, None]], axis=1).T.copy()
    step = max(16, _STRIP // max(1, len(uy)))
    for lo in range(0, len(x), step):
        hi = min(lo + step, len(x))
        skip = lo + 1 if y is None else 0
        bound = np.concatenate([rx[lo:hi, :first], sx[0][lo:hi, None]], axis=1) @ lead_y[:, skip:]
        a, b = np.divmod(np.flatnonzero(bound.ravel() >= threshold - _MARGIN), max(1, bound.shape[1]))
        a, b = a + lo, b + skip
        if y is None:
            a, b = a[b > a], b[b > a]
        for at in range(0, len(a), 1 << 18):
            i, j = a[at : at + (1 << 18)], b[at : at + (1 << 18)]
            total = np.einsum("ij,ij->i", rx[i, :first], ry[j, :first])
            for k in range(1, len(cuts)):
                total = total + np.einsum("ij,ij->i", rx[i, cuts[k - 1] : cuts[k]], ry[j, cuts[k - 1] : cuts[k]])
                on = total + sx[k][i] * sy[k][j] >= threshold - _MARGIN
                i, j, total = i[on], j[on], total[on]
            sure = np.einsum("ij,ij->i", ux[i], uy[j]) >= threshold
            if sure.any():
                yield i[sure], j[sure]


class Cuts:
    """A tree of median cuts along the widest of some axes, with ``n`` leaves."""

    def __init__(self, points: np.ndarray, n: int):
        self.axis, self.cut, self.child, self.leaf = [], [], [], []
        self.leaves = 0
        self._grow(points, max(1, n))
        self.axis, self.cut, self.child, self.leaf = (np.array(x) for x in (self.axis, self.cut, self.child, self.leaf))

    def _grow(self, points: np.ndarray, n: int) -> int:
        node = len(self.axis)
        for own, value in ((self.axis, 0), (self.cut, 0.0), (self.child, (node, node)), (self.leaf, -1)):
            own.append(value)
        if n == 1 or len(points) < 2:
            self.leaf[node], self.leaves = self.leaves, self.leaves + 1
            return node
        self.axis[node] = axis = int(np.argmax(points.var(axis=0)))
        self.cut[node] = cut = float(np.quantile(points[:, axis], (n // 2) / n))
        up = points[:, axis] > cut
        self.child[node] = (self._grow(points[~up], n // 2), self._grow(points[up], n - n // 2))
        return node

    def place(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        at = np.arange(len(points))
        while len(at := at[self.leaf[node[at]] < 0]):
            own = node[at]
            node[at] = self.child[own, (points[at, self.axis[own]] > self.cut[own]).astype(int)]
        return self.leaf[node]


def near_boxes(low: np.ndarray, high: np.ndarray, reach: float) -> list[np.ndarray]:
    """Of each box those at a distance of at most ``reach``, itself included; an empty box (low above high) is near none but itself."""
    full = (low <= high).all(1)
    out = []
    for k in range(len(low)):
        gap = np.maximum(0, np.maximum(low - high[k], low[k] - high))
        out.append(np.flatnonzero((full & full[k] & ((gap**2).sum(1) <= reach**2)) | (np.arange(len(low)) == k)))
    return out


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, tile_rows: int | None = None,
                    sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, n_links, component_id) of every row of ``vectors``.

    Vectors that are null, empty or zero, or that hold a null or non-finite component, link with nothing;
    vectors of different lengths don't link. Rows that repeat an id are rows of their own. Other columns play no part; without rows there are none.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is a cosine above 0")
    spark = vectors.sparkSession
    v = F.col("v")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).withColumn("fine", F.coalesce(fine, F.lit(False)))
    classes = written(
        rows.where("fine").groupBy("v").agg(F.count("*").alias("n"), F.min("id").alias("least")).withColumn("cid", F.monotonically_increasing_id()), "vectors")

    # Axes and cuts, by length of vector.
    sizes = {r[0]: r[1] for r in classes.groupBy(F.size("v")).count().collect()}
    sample = classes.orderBy(F.xxhash64("v"), "v").limit(sample_rows).select("v").toArrow().column("v").combine_chunks()
    axes, cuts, base, per, total = {}, {}, {}, {}, 0
    found = {d: _unit(_matrix(sample.take(pa.array(at)), d)) for d, at in _by_dim(sample)} if len(sample) else {}
    all_rows = max(1, sum(sizes.values()))
    for d, count in sorted(sizes.items()):
        u = found.get(d, np.zeros((0, d)))
        per[d] = tile_rows or max(256, TILE_BYTES // (8 * d))
        axes[d] = np.linalg.eigh(np.cov(u.T).reshape(d, d) if len(u) > 1 else np.eye(d))[1][:, ::-1]
        cuts[d] = Cuts(u @ axes[d][:, :BOX_AXES], min(-(-count // per[d]), max(1, MAX_LEAVES * count // all_rows)))
        base[d], total = total, total + cuts[d].leaves
    model = spark.sparkContext.broadcast((axes, cuts, base))

    def leaves(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each vector and its coordinates on the leading axes."""
        axes, cuts, base = model.value
        leaf, lead = np.zeros(len(column), np.int64), np.zeros((len(column), BOX_AXES))
        for d, at in _by_dim(column):
            x = _unit(_matrix(column.take(pa.array(at)), d)) @ axes[d][:, :BOX_AXES]
            leaf[at], lead[at, : x.shape[1]] = base[d] + cuts[d].place(x), x
        return leaf, lead

    bounds = [f"{side}{k}" for side in ("low", "high") for k in range(BOX_AXES)]

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, lead = leaves(batch.column(0))
            by = np.argsort(leaf, kind="stable")
            values, first, n = np.unique(leaf[by], return_index=True, return_counts=True)
            if len(values):
                low, high = np.minimum.reduceat(lead[by], first), np.maximum.reduceat(lead[by], first)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n), *map(pa.array, low.T), *map(pa.array, high.T)], names=["leaf", "n", *bounds])

    held, low, high = np.zeros(total, np.int64), np.full((total, BOX_AXES), np.inf), np.full((total, BOX_AXES), -np.inf)
    measured = classes.select("v").mapInArrow(boxes, ", ".join(["leaf long", "n long", *(f"{c} double" for c in bounds)]))
    ends = [(F.min if c[0] == "l" else F.max)(c) for c in bounds]
    for r in measured.groupBy("leaf").agg(F.sum("n"), *ends).collect():  # MAX_LEAVES rows, or one per length
        held[r[0]], low[r[0]], high[r[0]] = r[1], r[2 : 2 + BOX_AXES], r[2 + BOX_AXES :]
    reach = np.sqrt(2 - 2 * threshold) + 1e-9
    parts, start = np.ones(total, np.int64), np.zeros(total + 1, np.int64)
    near: list[np.ndarray] = []
    for d in sorted(sizes):
        own = slice(base[d], base[d] + cuts[d].leaves)
        parts[own] = np.maximum(1, -(-held[own] // per[d]))
        near += [base[d] + x for x in near_boxes(low[own], high[own], reach)]
    start[1:] = np.cumsum(parts)
    tiles = [np.concatenate([np.arange(start[j], start[j + 1]) for j in js]) for js in near]
    first_of = np.concatenate([[0], np.cumsum([len(t) for t in tiles])]).astype(np.int64)
    plan = spark.sparkContext.broadcast((parts, start, first_of, np.concatenate(tiles) if tiles else np.zeros(0, np.int64)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, start, first_of, tiles = plan.value
        for batch in batches:
            b, cid = leaves(batch.column(2))[0], np.asarray(batch.column(0))
            tile = start[b] + (cid * 2654435761 % 4294967291) % parts[b]
            for first in range(0, len(b), 1024):
                r = np.arange(first, min(first + 1024, len(b)))
                times = first_of[b[r] + 1] - first_of[b[r]]
                row = np.repeat(r, times)
                other = tiles[np.repeat(first_of[b[r]] - np.cumsum(times) + times, times) + np.arange(times.sum())]
                own = tile[row]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.minimum(own, other)), pa.array(np.maximum(own, other)), pa.array((own > other).astype(np.int8)), *(c.take(pa.array(row)) for c in batch.columns),
                ], names=["i", "j", "side", "cid", "n", "v"])

    kind = classes.schema["v"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes = model.value[0]

        def links(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            cid, side, v = np.asarray(t["cid"].combine_chunks()), np.asarray(t["side"].combine_chunks()), t["v"].combine_chunks()
            tally = LinkTally(np.asarray(t["n"].combine_chunks()))
            x, at = _matrix(v, len(v[0])), np.flatnonzero(side == 0)
            if t["i"][0] == t["j"][0]:
                for a, b in tile_links(x, None, axes[x.shape[1]], threshold):
                    tally.add(a, b)
            elif 0 < len(at) < len(x):
                for a, b in tile_links(x[at], x[len(at) :], axes[x.shape[1]], threshold):
                    tally.add(a, b + len(at))
            return tally.rows(cid)

        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            i, j = np.asarray(batch.column("i")), np.asarray(batch.column("j"))
            cuts = [0, *(np.flatnonzero((i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1).tolist(), len(i)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if held and key != (i[lo], j[lo]):
                    yield links(held)
                    held = []
                key = (i[lo], j[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield links(held)

    met = classes.select("cid", "n", "v").mapInArrow(place, f"i long, j long, side tinyint, cid long, n long, v {kind}")
    linked = written(met.repartition("i", "j").sortWithinPartitions("i", "j", "side").mapInArrow(compare, LINK_SCHEMA), "vector-links")
    near = linked.where("b IS NULL").groupBy(F.col("a").alias("cid")).agg(F.sum("near").alias("near"))
    joined = connected_components(linked.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "cid")
    named = classes.join(joined, "cid", "left").join(near, "cid", "left").select(
        "v", "n", "least", F.coalesce("component", "cid").alias("component"), (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = written(named.join(smallest, "component").select("v", "n", "n_links", "component_id"), "vector-classes")
    release(classes, linked)
    return join_counted(rows.where("fine"), of_class, "v", "n").select("id", "n_links", "component_id").unionByName(
        rows.where("NOT fine").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))


def keep_one(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``vectors`` whose id names their component, with all their columns, whatever their names.

    Rows that repeat an id stay or go together: all stay if any of them is the one that names its component, as do all without an id where one
    of those has only vectors without an id about it. So unlike rows are never lost for having the id of another; equal vectors of one id all stay.
    """
    name = free_name(vectors, "kept_id")
    kept = near_duplicates(vectors, id_col, vector_col, threshold).where(F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias(name)).distinct()
    return vectors.join(kept, F.col(id_col).cast("long").eqNullSafe(F.col(name)), "left_semi")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_duplicates(table(spark, sf_dir, "embeddings"))
    return got.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


OP6_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a),
c AS (SELECT vec_id, vec_id AS r FROM embeddings UNION SELECT l.b, c.r FROM c JOIN l ON l.a = c.vec_id WHERE c.r < l.b),
m AS (SELECT vec_id, min(r) AS component_id FROM c GROUP BY vec_id)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM m LEFT JOIN n ON n.a = m.vec_id
"""
