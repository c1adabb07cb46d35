"""Conflict-constrained best-fit packing of documents into training sequences.

A document longer than a sequence is cut: its full pieces are sequences of their own and its remainder
is packed. Remainders go in order of falling size into the open bin with the least residual that takes them and that
holds no document of the same source and none of the same duplicate cluster. Bins are ordered by
residual; each carries a bitmap of its sources and one of its clusters, and the successor search goes on
from residual to residual until it finds a compatible bin, or else a bin is opened.

Sizes are UTF-8 bytes, the tokens of a byte-level model, unless a column of token counts is named.

Scale: best-fit is sequential, so the documents are spread by hash over groups of about ``GROUP_ROWS``, each packed on its own;
a conflict never reaches beyond a bin, so groups need no talk. A hot source or cluster is spread over all groups.
Inside a group the keys of more than 1/16 of the rows have an index of the residuals at which a bin
without them lies, so that they skip the bins that hold them instead of trying each. Only ids, sizes and hashes are shuffled.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table, written

CAPACITY = 8192
GROUP_ROWS = 8192


class BestFit:
    """Bins of a capacity, ordered by residual; ``keys`` of an item are its source and its cluster."""

    def __init__(self, capacity: int, hot: set = frozenset()):
        self.capacity, self.hot = capacity, hot
        self.level: dict[int, dict[int, None]] = defaultdict(dict)
        self.some = 0  # bit r: a bin has residual r
        self.free = dict.fromkeys(hot, 0)  # bit r: a bin without the key has residual r
        self.without: dict = {k: Counter() for k in hot}
        self.residual: list[int] = []
        self.bitmaps: list[list[int]] = []
        self.held: list[set] = []

    def _count(self, b: int, r: int, by: int) -> None:
        for k in self.hot:
            if k not in self.held[b]:
                c = self.without[k]
                c[r] += by
                if c[r]:
                    self.free[k] |= 1 << r
                else:
                    self.free[k] &= ~(1 << r)

    def add(self, size: int, keys: tuple, bits: tuple[int, int]) -> int:
        """Places an item; its bin."""
        open_ = self.some >> size << size
        for k in keys:
            if k in self.free:
                open_ &= self.free[k]
        found = -1
        while open_ and found < 0:
            r = (open_ & -open_).bit_length() - 1
            found = next((b for b in self.level[r] if not (self.bitmaps[b][0] & bits[0] or self.bitmaps[b][1] & bits[1])), -1)
            open_ &= open_ - 1
        if found < 0:
            found = len(self.residual)
            self.residual.append(self.capacity)
            self.bitmaps.append([0, 0])
            self.held.append(set())
        else:
            r = self.residual[found]
            self._count(found, r, -1)
            del self.level[r][found]
            if not self.level[r]:
                self.some &= ~(1 << r)
        self.residual[found] -= size
        self.bitmaps[found][0] |= bits[0]
        self.bitmaps[found][1] |= bits[1]
        self.held[found].update(k for k in keys if k in self.hot)
        r = self.residual[found]
        self.level[r][found] = None
        self.some |= 1 << r
        self._count(found, r, 1)
        return found


def pack_group(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[int]:
    """The bin of each item; items come in order of falling size. A null source or cluster conflicts with nothing."""
    keys = [(None if s is None else ("s", s), None if c is None else ("c", c)) for s, c in zip(sources, clusters, strict=True)]
    times = Counter(k for pair in keys for k in pair if k is not None)
    bit: dict = {}
    number = {"s": 0, "c": 0}
    for k, n in times.items():
        if n > 1:  # a key that occurs once conflicts with nothing
            bit[k] = 1 << number[k[0]]
            number[k[0]] += 1
    fit = BestFit(capacity, {k for k, n in times.items() if n > max(16, len(sizes) // 16)})
    return [fit.add(size, pair, (bit.get(pair[0], 0), bit.get(pair[1], 0))) for size, pair in zip(sizes, keys, strict=True)]


_PACKED = "bin_id long, slot int, id long, source string, cluster long, piece int, start long, length long"


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None, size_col: str | None = None,
         capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Rows (bin_id, slot, id, source, cluster, piece, start, length), one for each piece of each document.

    Without ``cluster_col`` (a long) the cluster is the hash of the text with letters lowered and white space
    collapsed. Null and empty texts are one piece of length 0, in a bin like any other; a null source or null text conflicts with nothing.
    Rows that repeat an id are documents of their own; ties go by id, then by cluster and source. A document longer than a sequence is cut, whatever
    its length. Other columns of ``docs`` play no part; without rows there are none.
    """
    t = F.col(text_col).cast("string")
    cluster = F.col(cluster_col).cast("long") if cluster_col else F.when(t.isNotNull(), F.xxhash64(F.lower(F.trim(F.regexp_replace(t, r"\s+", " ")))))
    size = F.col(size_col).cast("long") if size_col else F.octet_length(t).cast("long")
    rows = written(docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), cluster.alias("cluster"),
                               F.greatest(F.lit(0), F.coalesce(size, F.lit(0))).alias("size")).withColumn("row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-rows.count() // group_rows))
    grouped = rows.withColumn("grp", F.pmod(F.xxhash64("id", "cluster", "size", "row"), F.lit(groups)))  # the row's number spreads rows that agree in all else

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            sizes = np.asarray(t["size"].combine_chunks())
            ids, sources, clusters = (t[c].to_pylist() for c in ("id", "source", "cluster"))
            full, rest = sizes // capacity, sizes % capacity
            in_bin = np.flatnonzero((rest > 0) | (sizes == 0))
            order = sorted(in_bin.tolist(), key=lambda k: (-int(rest[k]), ids[k] is None, ids[k] or 0, clusters[k] or 0, sources[k] or ""))
            bins = pack_group(rest[order].tolist(), [sources[k] for k in order], [clusters[k] for k in order], capacity)
            base, slots = int(t["grp"][0].as_py()) << 32, Counter()
            out: list[tuple] = []
            for k, b in zip(order, bins, strict=True):
                out.append((base + b, slots[b], ids[k], sources[k], clusters[k], int(full[k]), int(full[k]) * capacity, int(rest[k])))
                slots[b] += 1
            at = base + len(set(bins))
            for k in np.flatnonzero(full).tolist():
                for piece in range(int(full[k])):
                    out.append((at, 0, ids[k], sources[k], clusters[k], piece, piece * capacity, capacity))
                    at += 1
                    if len(out) >= 1 << 16:
                        yield batch_of(out)
                        out = []
            if out:
                yield batch_of(out)

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split()[0] for c in _PACKED.split(", ")])

        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            g = np.asarray(batch.column("grp"))
            cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if held and key != g[lo]:
                    yield from packed(held)
                    held = []
                key = g[lo]
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from packed(held)

    return grouped.repartition("grp").sortWithinPartitions("grp").mapInArrow(run, _PACKED)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
