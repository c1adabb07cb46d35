"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Equal texts form a group that stays together. Groups sorted by size enter the shard with the tightest
remaining capacity that takes them, found in a balanced tree of (remaining, shard) (a treap), and a new
shard is opened only where none takes the group: this keeps the number of shards of a fixed capacity small. For
a fixed number of shards the capacity is the mean (or somewhat less), and a group that no shard takes any more
goes to the shard with the most capacity left, so that sizes come out near equal.

Scale: groups of one size are alike, so the driver packs the histogram of group sizes, each size with its number, in the very order
and to the very shards that one group after the other would have. Different sizes add up to the input, so there are at most
sqrt(2 x bytes) of them, and of documents of up to a megabyte at most a million or so. Runs of groups that go to one shard
are as few as shards and sizes at which the shard changes; groups find theirs by their rank among those of their size, which is counted in two steps, by
cell of the digest and within a cell. A group with a large share of the rows is joined by broadcast. Slots
are numbered in two steps as well, so no task sorts a whole shard.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import join_counted, release, table, written

SHARDS = 16
#: Cells in which ranks and slots are numbered.
CELLS = 1 << 16

Run = tuple[int, int, int, int]


class Treap:
    """A balanced search tree of distinct tuples with insertion, deletion and successor search."""

    def __init__(self) -> None:
        self._root: list | None = None
        self._random = random.Random(0)

    def _merge(self, a: list | None, b: list | None) -> list | None:
        if a is None or b is None:
            return a or b
        if a[1] < b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def _cut(self, node: list | None, key: tuple) -> tuple[list | None, list | None]:
        """Nodes before ``key``, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], rest = self._cut(node[3], key)
            return node, rest
        rest, node[2] = self._cut(node[2], key)
        return rest, node

    def insert(self, key: tuple) -> None:
        low, high = self._cut(self._root, key)
        self._root = self._merge(self._merge(low, [key, self._random.random(), None, None]), high)

    def remove(self, key: tuple) -> None:
        low, high = self._cut(self._root, key)
        _, high = self._cut(high, (*key, 0))  # (*key, 0) comes right after key
        self._root = self._merge(low, high)

    def last(self) -> tuple | None:
        node = self._root
        while node is not None and node[3] is not None:
            node = node[3]
        return node and node[0]

    def successor(self, key: tuple) -> tuple | None:
        """The first element that isn't before ``key``."""
        node, best = self._root, None
        while node is not None:
            if node[0] < key:
                node = node[3]
            else:
                best, node = node[0], node[2]
        return best


def _spread(size: int, count: int, left: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(bin, number) of ``count`` items of a size, each put where most is left, of equal ones in the last; ``left`` has (remaining, bin)."""
    above = lambda t: sum((r - t - 1) // size + 1 for r, _ in left if r > t)
    low, high = min(r for r, _ in left) - count * size - 1, max(r for r, _ in left)
    while low < high:  # the least remainder above which no more than ``count`` items go
        mid = (low + high) // 2
        low, high = (low, mid) if above(mid) <= count else (mid + 1, high)
    out = {k: (r - low - 1) // size + 1 if r > low else 0 for r, k in left}
    rest = count - sum(out.values())
    for r, k in sorted(left, key=lambda x: -x[1]):
        if rest and r - out[k] * size == low:
            out[k], rest = out[k] + 1, rest - 1
    return sorted(out.items())


def best_fit_decreasing(histogram: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[Run]:
    """(size, first, number, bin) of runs of items of a size that go to one bin; ``histogram`` has (size, number), sizes falling.

    An item larger than the capacity has a bin of its own. Once ``most`` bins are open, an item that fits
    none goes to the one with the most capacity left (the last of those), which it overfills.
    """
    tree, out, opened = Treap(), [], 0
    for size, count in histogram:
        done = 0
        while done < count:
            fit = tree.successor((size, -1))
            if fit is None and opened == most:
                left = []
                while (last := tree.last()) is not None:
                    tree.remove(last)
                    left.append(last)
                given = dict(_spread(size, count - done, left))
                for r, k in left:
                    tree.insert((r - given[k] * size, k))
                    if given[k]:
                        out.append((size, done, given[k], k))
                        done += given[k]
                break
            if fit is None:
                fit, opened = (capacity, opened), opened + 1
            else:
                tree.remove(fit)
            n = max(1, min(count - done, fit[0] // size))  # the tightest bin stays so until it is full
            out.append((size, done, n, fit[1]))
            tree.insert((fit[0] - n * size, fit[1]))
            done += n
    return out


def pack(histogram: list[tuple[int, int]], shards: int) -> list[Run]:
    """Best-fit-decreasing into ``shards`` bins of near-equal size.

    The capacity is the mean. Where few items leave sizes more than a thousandth of the mean apart, smaller
    capacities, which leave more of the small items for evening out, are tried as well, and the most even one is taken.
    """
    mean = -(-sum(s * n for s, n in histogram) // shards)
    best: tuple[int, list[Run]] | None = None
    for share in (1.0, 0.99, 0.97, 0.95, 0.9, 0.85, 0.8, 0.7, 0.6, 0.5):
        got = best_fit_decreasing(histogram, max(1, int(mean * share)), shards)
        held = [0] * shards
        for size, _, n, k in got:
            held[k] += size * n
        apart = max(held) - min(held)
        if best is None or apart < best[0]:
            best = apart, got
        if apart * 1000 <= mean:
            break
    return best[1]


def _starts(runs: list[Run]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the bin changes, in falling order of size and rising order of rank: (size, rank, bin)."""
    size, first, _, k = (np.array(c, np.int64) for c in zip(*runs, strict=True)) if runs else (np.zeros(0, np.int64),) * 4
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    return size[new], first[new], k[new]


def _ranked(groups: DataFrame, by: str, order: list[str], cell: str, name: str) -> DataFrame:
    """``groups`` with ``name``, the place of each row among those of its ``by``, from 0: by cell, then in the given order within it."""
    counts = groups.groupBy(by, cell).agg(F.count("*").alias("n_cell"))
    before = counts.select(by, cell, (F.sum("n_cell").over(Window.partitionBy(by).orderBy(cell)) - F.col("n_cell")).alias("before"))
    within = F.row_number().over(Window.partitionBy(by, cell).orderBy(*order)) - 1
    return groups.withColumn("within", within).join(before, [by, cell]).withColumn(name, F.col("before") + F.col("within")).drop("within", "before")


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, capacity: int | None = None, cells: int = CELLS) -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row of ``docs``.

    With a ``capacity`` in bytes, ``shards`` doesn't count: a shard is opened wherever no other takes a group, and only a group
    that is larger by itself exceeds the capacity.

    Size is the UTF-8 bytes of the text plus 1. Null texts are a group, apart from that of empty texts;
    their crc32 is null. Rows that repeat an id are rows of their own; groups of equal size go by the hash of their digest. A group larger
    than a shard's share, as one text with a third of all rows, makes its shard larger. Other columns play no part; without rows there are none.
    """
    spark, t = docs.sparkSession, F.col("t")
    rows = written(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).select(
        "id", (F.coalesce(F.octet_length(t), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"),
        F.coalesce(F.unhex(F.sha2(t, 256)), F.lit(b"")).alias("g"), F.monotonically_increasing_id().alias("row")), "sizes")
    groups = written(rows.groupBy("g").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).withColumn("cell", F.pmod(F.xxhash64("g"), F.lit(cells)).cast("int")), "groups")
    sizes = groups.groupBy("bytes").agg(F.count("*").alias("n")).toArrow()
    histogram = sorted(zip(sizes["bytes"].to_pylist(), sizes["n"].to_pylist(), strict=True), reverse=True)
    plan = spark.sparkContext.broadcast(_starts(pack(histogram, shards) if capacity is None else best_fit_decreasing(histogram, capacity)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_size, at_rank, bins = plan.value
        for batch in batches:
            size, rank = (np.asarray(batch.column(c)) for c in ("bytes", "rank"))
            # Rows among the starts of runs: each belongs to the last start that isn't after it.
            both = np.lexsort((np.concatenate([np.zeros(len(bins)), np.ones(len(rank))]), np.concatenate([at_rank, rank]), -np.concatenate([at_size, size])))
            last = np.maximum.accumulate(np.where(both < len(bins), both, -1))
            own = np.empty(len(both), np.int64)
            own[both] = last
            yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("n"), pa.array(bins[own[len(bins) :]].astype(np.int32))], names=["g", "n", "shard"])

    placed = written(_ranked(groups, "bytes", ["g"], "cell", "rank").select("g", "n", "bytes", "rank").mapInArrow(place, "g binary, n long, shard int"), "placed")
    release(groups)
    # The row's number spreads rows that agree in all else.
    where = join_counted(rows, placed, "g", "n").select("id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("id", "text_crc32", "row"), F.lit(cells)).cast("int").alias("cell"))
    return _ranked(where, "shard", ["id", "text_crc32", "size"], "cell", "slot").select("id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
