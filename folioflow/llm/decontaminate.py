"""Benchmark decontamination with suffix arrays over the training texts.

The training documents are the indexed side: each block of documents (a shard) gets a suffix array
over its words, and every benchmark suffix is binary-searched in it, all at once, a few words at a
time. A suffix counts from ``window`` words on, or as a whole if its item is shorter. Matches of
neighbouring suffixes on the same diagonal are joined to longest verbatim matches with their place in
the document and in the item. Documents with a match are then removed.

Scale: the documents stay where they are read (no shuffle). Shards are built and dropped one at a
time within a task. The benchmark is written to the shared folder in blocks of about ``BENCH_BYTES`` by tasks of their own, so the driver holds
none of it; each shard is searched with one block after the other, of which a worker holds one. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table, written
from ._text import ALNUM_CLASS, Words, blocks, filesystem, slice_hash, utf8

WINDOW = 10
#: UTF-8 bytes of benchmark texts in one block of windows; an item that is longer is a block of its own.
BENCH_BYTES = 8 << 20


class SuffixArray:
    """The suffixes of an integer sequence (0 ends a text) in order of their first ``depth`` words at least."""

    def __init__(self, seq: np.ndarray, top: int, depth: int):
        self.seq, n = seq, len(seq)
        self.bits = max(1, int(top).bit_length())
        self.step = min(63 // self.bits, depth)
        padded = np.concatenate([seq, np.zeros(self.step, np.int64)])
        key = np.zeros(n, np.int64)
        for k in range(self.step):
            key = (key << self.bits) | padded[k : k + n]
        self.key = np.concatenate([key, [0]])  # the next ``step`` words at each place
        order = np.argsort(key)
        done, tied = self.step, np.arange(n)
        ordered = key[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if n else np.zeros(0, bool)
        rank = np.empty(n + 1, np.int64)
        rank[n] = -1
        while n:
            rank[order[tied]] = np.maximum.accumulate(np.where(new[tied], tied, 0))
            if done >= depth:
                break
            # Places whose suffix has not got a rank of its own: double the words compared.
            alone = new & np.concatenate([new[1:], [True]])
            tied = np.flatnonzero(~alone)
            if not len(tied):
                break
            own = order[tied]
            by = rank[own] * (n + 1) + rank[np.minimum(own + done, n)] + 1
            sorting = np.argsort(by)
            order[tied], by = own[sorting], by[sorting]
            new[tied[1:]] = by[1:] != by[:-1]
            new[tied[0]] = True
            done *= 2
        self.order = order
        self.first_key = key[order]

    def _bound(self, lo: np.ndarray, hi: np.ndarray, at: int, value: np.ndarray, right: bool) -> np.ndarray:
        """The first place in each range of suffixes whose words from ``at`` on are not before (not up to) value."""
        lo, hi, last = lo.copy(), hi.copy(), len(self.key) - 1
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            found = self.key[np.minimum(self.order[np.minimum(mid, last - 1)] + at, last)]
            up = open_ & ((found <= value) if right else (found < value))
            lo, hi = np.where(up, mid + 1, lo), np.where(open_ & ~up, mid, hi)
        return lo

    def ranges(self, patterns: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row of ``patterns`` (its first ``size`` words) the range of suffixes that begin with it."""
        q = len(patterns)
        lo, hi = np.zeros(q, np.int64), np.full(q, len(self.seq), np.int64)
        hi[(np.where(np.arange(patterns.shape[1]) < size[:, None], patterns, 1) <= 0).any(1)] = 0
        for at in range(0, patterns.shape[1], self.step):
            on = np.flatnonzero((hi > lo) & (size > at))
            if not len(on):
                break
            low, high = np.zeros(len(on), np.int64), np.zeros(len(on), np.int64)
            for k in range(at, at + self.step):
                used = size[on] > k
                word = np.where(used, patterns[on, min(k, patterns.shape[1] - 1)], 0)
                low = (low << self.bits) | word
                high = (high << self.bits) | np.where(used, word, (1 << self.bits) - 1)
            if at == 0:
                lo[on], hi[on] = np.searchsorted(self.first_key, low, "left"), np.searchsorted(self.first_key, high, "right")
            else:
                lo[on], hi[on] = self._bound(lo[on], hi[on], at, low, False), self._bound(lo[on], hi[on], at, high, True)
        return lo, hi


def benchmark_windows(ids: list[int | None], texts: list[bytes], window: int = WINDOW) -> dict:
    """The windows of a block of items: hashed words, sizes, and the (item, place) of each window."""
    words = Words(texts, ALNUM_CLASS)
    h = slice_hash(words.buf, words.start, words.end)
    count = np.diff(words.first)
    n = np.where(count >= window, count - window + 1, np.minimum(count, 1))
    item = np.repeat(np.arange(len(texts)), n)
    place = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
    size = np.minimum(count[item], window)
    names, code = np.unique(h, return_inverse=True)
    at = (words.first[item] + place)[:, None] + np.arange(window)
    grid = np.where(np.arange(window) < size[:, None], code[np.minimum(at, max(0, len(code) - 1))] + 1 if len(code) else 0, 0)
    unique, which = np.unique(grid, axis=0, return_inverse=True)
    by = np.argsort(which.ravel(), kind="stable")
    return {"names": names, "windows": unique, "size": (unique > 0).sum(1), "from": np.searchsorted(which.ravel()[by], np.arange(len(unique) + 1)),
            "item": item[by], "place": place[by], "ids": ids}


def search_shard(texts: list[bytes], bench: Iterable[dict], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, list[list[tuple]]]:
    """Of each text: its words, those hit, and its longest matches (item's id, place in item, place in text, words)."""
    words = Words(texts, ALNUM_CLASS)
    count, n_texts = np.diff(words.first), len(texts)
    code, names = pd.factorize(slice_hash(words.buf, words.start, words.end))
    owner = words.text_of()
    seq = np.zeros(len(words) + n_texts, np.int64)
    seq[np.arange(len(words)) + owner] = code + 1
    owner = np.repeat(np.arange(n_texts), count + 1)
    begin = words.first[:-1] + np.arange(n_texts)
    array, index = SuffixArray(seq, len(names), window), pd.Index(names)
    edge = np.zeros(len(seq) + 1, np.int64)
    found: list[list[tuple]] = [[] for _ in range(n_texts)]
    for block in bench:
        known = np.concatenate([[0], index.get_indexer(block["names"]) + 1])  # 0: not in this shard
        lo, hi = array.ranges(known[block["windows"]], block["size"])
        hit = np.flatnonzero(hi > lo)
        if not len(hit):
            continue
        times = hi[hit] - lo[hit]
        which = np.repeat(hit, times)
        at = array.order[np.repeat(lo[hit] - np.cumsum(times) + times, times) + np.arange(times.sum())]
        size = block["size"][which]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + size, -1)
        # Each place with each item that has the window; runs on a diagonal are one match.
        uses = block["from"][which + 1] - block["from"][which]
        use = np.repeat(block["from"][which] - np.cumsum(uses) + uses, uses) + np.arange(uses.sum())
        at, size = np.repeat(at, uses), np.repeat(size, uses)
        item, place = block["item"][use], block["place"][use]
        by = np.lexsort((place, at - place, item))
        at, size, item, place = at[by], size[by], item[by], place[by]
        starts = np.ones(len(at), bool)
        starts[1:] = (item[1:] != item[:-1]) | (at[1:] - at[:-1] != 1) | (place[1:] - place[:-1] != 1)
        s = np.flatnonzero(starts)
        e = np.concatenate([s[1:], [len(at)]]) - 1
        for d, i, p, a, n in zip(owner[at[s]].tolist(), item[s].tolist(), place[s].tolist(), (at[s] - begin[owner[at[s]]]).tolist(), (place[e] + size[e] - place[s]).tolist(), strict=True):
            found[d].append((block["ids"][i], p, a, n))
    covered = (np.cumsum(edge[:-1]) > 0) & (seq > 0)
    return count, np.bincount(owner[covered], minlength=n_texts), found


def benchmark_blocks(bench: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block_bytes: int = BENCH_BYTES) -> list[str]:
    """Writes the windows of ``bench`` in blocks of texts of at most ``block_bytes`` together, each a file in the shared folder; the files' paths."""
    rows = bench.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        texts: list[bytes] = []

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(benchmark_windows(ids, texts, window))], pa.binary())], names=["windows"])

        held = 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                if texts and held + len(t) > block_bytes:
                    yield block()
                    ids, texts, held = [], [], 0
                ids.append(i)
                texts.append(t)
                held += len(t)
        if texts:
            yield block()

    # Texts are dealt out over as many tasks as fill a block each, or fewer blocks.
    dealt = rows.repartition(-(-total // block_bytes), F.xxhash64("id", "t")) if total > block_bytes else rows.coalesce(1)
    made = written(dealt.mapInArrow(run, "windows binary"), "benchmark", file_rows=1)
    return [r[0] for r in made.select(F.input_file_name()).distinct().collect()]


@lru_cache(maxsize=1)
def load_block(path: str) -> dict:
    """The windows of a block; a worker holds that of the last call."""
    fs, at = filesystem(path)
    return pickle.loads(pq.read_table(at, columns=["windows"], filesystem=fs).column(0)[0].as_buffer())


def _loaded(paths: list[str]) -> Iterator[dict]:
    for path in paths:
        yield load_block(path)


_MATCH = "item_id long, item_word long, doc_word long, n_words long"


def benchmark_matches(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                      window: int = WINDOW, block_bytes: int = BENCH_BYTES) -> DataFrame:
    """(id, n_words, n_hit, items, matches) of every row of ``docs``.

    items are the distinct ids of the items with a matching suffix, in order as strings; matches are
    the longest verbatim matches. Null and empty texts have no words and no match, an item without
    words is no item; items with equal texts match alike; rows that repeat an id are rows of their
    own. With an empty benchmark nothing matches. An item whose id is null hits words but isn't named.
    """
    paths = benchmark_blocks(bench, item_col, item_text_col, window, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(1))
            for lo, hi in blocks(texts):
                n_words, n_hit, found = search_shard(texts[lo:hi], _loaded(paths), window)
                matches = [[{"item_id": i, "item_word": p, "doc_word": a, "n_words": n} for i, p, a, n in sorted(f, key=lambda m: (m[0] is None, m))] for f in found]
                items = [sorted({m["item_id"] for m in ms} - {None}, key=str) for ms in matches]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[lo:hi], pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.int64())),
                    pa.array([hashlib.sha256(",".join(map(str, i)).encode()).hexdigest() for i in items]),
                    pa.array(matches, pa.list_(pa.struct([(c.split()[0], pa.int64()) for c in _MATCH.split(", ")]))),
                ], names=["id", "n_words", "n_hit", "items", "items_sha256", "matches"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(
        run, f"id long, n_words long, n_hit long, items array<long>, items_sha256 string, matches array<struct<{_MATCH.replace(' ', ':')}>>".replace(",:", ", "))


def decontaminate(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                  block_bytes: int = BENCH_BYTES) -> DataFrame:
    """The rows of ``docs`` whose text has no match, with all their columns, whatever their names; each row is judged by its own text.

    Null and empty texts have no match and stay, as do all rows where the benchmark is empty; rows that repeat an id or a text stay or go each by itself.
    """
    paths = benchmark_blocks(bench, item_col, item_text_col, window, block_bytes)

    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        given = utf8(texts)
        hits = [search_shard(given[lo:hi], _loaded(paths), window)[1] for lo, hi in blocks(given)]
        return pa.array(np.concatenate(hits) == 0 if hits else np.zeros(0, bool))

    return docs.where(clean(F.col(text_col).cast("string")))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


OP1_SQL = r"""
WITH t AS (SELECT translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t, doc_id FROM documents),
d AS (SELECT doc_id, coalesce(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM t),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS g
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT pos.doc_id, pos.n, pos.p, win.item_id FROM pos JOIN win ON pos.n = win.n AND pos.g = win.g),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, n, p FROM m)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s
        FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
