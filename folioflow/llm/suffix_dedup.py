"""Repeated passages across documents, by a sparse suffix array.

A suffix is kept where its leading ``SEED`` words have the least hash of ``WINDOW`` neighbouring places (a
content-selected minimiser), so any passage of ``MIN_WORDS = SEED + WINDOW - 1`` words or more that occurs twice has a
kept suffix at the same place in both. Suffixes whose seed occurs once in the corpus can't match and
go first. The others are sorted by seed and by the words that follow it; each is compared with its neighbour in that order, which gives the words
they share to the right, and with its neighbour in the order of the words before the seed (read backwards), which
gives those to the left. A run of MIN_WORDS words that begins b words before a suffix is held by all suffixes that share b words
to the left and the rest to the right: those that lie together in both orders without a shorter common part between them. If they are of
more than one document the match holds, and a suffix's matches extend left and right as far as such runs go. They add up to a document's maximal repeated spans.

Scale: seeds are counted with pre-aggregation and joined back. Suffixes of a seed
with at most ``GROUP_ROWS`` meet in one task, some ten thousand rows at a time. The runs of hotter seeds are
counted instead: for each run the least and greatest document that has it, pre-aggregated and joined back, so that no task
holds a hot seed; both ways find the same runs. Words are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import free_name, join_counted, release, table, written
from ._text import NONSPACE_CLASS, U64, Words, _mix, blocks, slice_hash, utf8

MIN_WORDS, SEED = 50, 26
WINDOW = MIN_WORDS - SEED + 1
#: Suffixes of one seed that are compared in one task.
GROUP_ROWS = 1 << 14
_ROWS = 1 << 14
_BACK = MIN_WORDS - SEED
_BASE = U64(0x9E3779B97F4A7C15)


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n words in a row, by doubling; len(h) - n + 1 of them along the last axis."""
    out: np.ndarray | None = None
    done, power, width = 0, h.astype(U64), 1
    while n:
        if n & 1:
            size = h.shape[-1] - done - width + 1
            part = power[..., done : done + size]
            out = part if out is None else _mix(out[..., :size] * _BASE + part)
            done += width
        n >>= 1
        if n:
            power = _mix(power[..., : power.shape[-1] - width] * _BASE + power[..., width:])
            width *= 2
    return out


def minimisers(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, seed hashes) of the kept suffixes of texts whose words h[first[k]:first[k+1]] are."""
    if len(h) < MIN_WORDS:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    seed = _grams(h, SEED)
    n = len(h) - MIN_WORDS + 1
    best, at = seed[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, WINDOW):
        less = seed[j : j + n] < best
        best[less] = seed[j : j + n][less]
        at[less] = j
    left = np.repeat(first[1:], np.diff(first))[:n] - np.arange(n)
    places = np.unique((np.arange(n) + at)[left >= MIN_WORDS])
    return places, seed[places]


def _hashed(texts: list[bytes]) -> Words:
    words = Words(texts, NONSPACE_CLASS)
    words.hash = slice_hash(words.buf, words.start, words.end)
    return words


def _suffixes(docs: DataFrame) -> DataFrame:
    """(h, id, pos) of all kept suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = utf8(batch.column(1)), batch.column(0)
            for lo, hi in blocks(texts):
                words = _hashed(texts[lo:hi])
                places, seed = minimisers(words.hash, words.first)
                owner = np.searchsorted(words.first, places, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), ids.take(pa.array(owner + lo)), pa.array((places - words.first[owner]).astype(np.int32))], names=["h", "id", "pos"])

    return docs.mapInArrow(run, "h long, id long, pos int")


_CONTEXT = "h long, suffix binary, prefix binary, id long, pos int, before int, after int, hot boolean"


def _contexts(rows: DataFrame) -> DataFrame:
    """Of (id, t, places) the kept suffixes with the words that follow their seed and (backwards) precede it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids, listed = utf8(batch.column(1)), batch.column(0), batch.column(2)
            for lo, hi in blocks(texts):
                words = _hashed(texts[lo:hi])
                count = np.diff(words.first)
                own = listed.slice(lo, hi - lo)
                text = np.repeat(np.arange(hi - lo), np.asarray(own.value_lengths()))
                flat = own.flatten()
                pos, hot = np.asarray(flat.field(0)).astype(np.int64), np.asarray(flat.field(1).cast(pa.int8())).astype(bool)
                fits = pos + SEED <= count[text]  # rows that repeat an id have each other's places
                text, pos, hot = text[fits], pos[fits], hot[fits]
                for a in range(0, len(pos), 1 << 14):
                    k, p = text[a : a + (1 << 14)], pos[a : a + (1 << 14)]
                    at, h_all = words.first[k] + p, words.hash.astype("<u8")
                    before, after = np.minimum(p, _BACK), np.minimum(count[k] - p, MIN_WORDS)
                    span = np.arange(_BACK)
                    follow = np.where(SEED + span < after[:, None], h_all[np.minimum(at[:, None] + SEED + span, len(h_all) - 1)], U64(0))
                    lead = np.where(span < before[:, None], h_all[np.maximum(at[:, None] - 1 - span, 0)], U64(0))
                    h = _grams(h_all[np.minimum(at[:, None] + np.arange(SEED), len(h_all) - 1)], SEED)[:, 0]
                    fixed = lambda x: pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.shape[1] * 8), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([
                        pa.array(h.view(np.int64)), fixed(follow), fixed(lead), ids.take(pa.array(k + lo)), pa.array(p.astype(np.int32)),
                        pa.array(before.astype(np.int32)), pa.array(after.astype(np.int32)), pa.array(hot[a : a + (1 << 14)]),
                    ], names=[c.split()[0] for c in _CONTEXT.split(", ")])

    return rows.mapInArrow(run, _CONTEXT)


def _words_of(t: pa.Table, column: str) -> np.ndarray:
    return np.frombuffer(b"".join(t[column].to_pylist()), "<u8").reshape(t.num_rows, -1)


def _shared_with_next(words: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many leading words each row shares with the next one; no more than either has."""
    same = words[1:] == words[:-1]
    width = words.shape[1]
    shared = np.where(same.all(1), width, np.argmin(same, axis=1)) if width else np.zeros(len(same), np.int64)
    return np.minimum(shared, np.minimum(size[1:], size[:-1]))


def _places(rank: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """The number of the group of each row: rows in the order of ``rank`` form groups, between which ``breaks`` lie."""
    out = np.empty(len(rank), np.int64)
    out[rank] = np.concatenate([[0], np.cumsum(breaks)]) if len(rank) else 0
    return out


def repeated_runs(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, word after) of the matches of each suffix with suffixes of other documents, extended left and right, of MIN_WORDS words or more.

    Rows may be in any order; those of a seed are all there.
    """
    n, pos = t.num_rows, np.asarray(t["pos"].combine_chunks()).astype(np.int64)
    who = pd.factorize(t["id"].to_pandas().astype("Int64"), use_na_sentinel=False)[0]
    seed = np.asarray(t["h"].combine_chunks()).view(U64)
    before, after = (np.asarray(t[c].combine_chunks()).astype(np.int64) for c in ("before", "after"))
    follow, lead = _words_of(t, "suffix"), _words_of(t, "prefix")

    def order(words: np.ndarray) -> np.ndarray:
        rows = np.ascontiguousarray(np.concatenate([seed[:, None], words], axis=1).astype(">u8"))
        return np.argsort(rows.view(np.dtype((np.void, rows.shape[1] * 8))).ravel(), kind="stable")

    right, left = order(follow), order(lead)
    ends = seed[right][1:] != seed[right][:-1]
    lcp = np.where(ends, 0, SEED + _shared_with_next(follow[right], after[right] - SEED))
    lcs = np.where(seed[left][1:] != seed[left][:-1], -1, _shared_with_next(lead[left], before[left]))
    rows, offs = [], []
    for b in range(WINDOW):
        whole = np.flatnonzero((before >= b) & (after >= MIN_WORDS - b))
        if len(whole) < 2:
            continue
        key = _places(right, lcp < MIN_WORDS - b)[whole] * n + _places(left, lcs < b)[whole]
        by = np.lexsort((who[whole], key))
        k, w = key[by], who[whole][by]
        begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        size = np.diff(np.concatenate([begin, [len(k)]]))
        hit = np.repeat(w[begin] != w[begin + size - 1], size)
        rows.append(whole[by[hit]])
        offs.append(np.full(int(hit.sum()), _BACK - b))
    row, off = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, offs))
    by = np.lexsort((off, row))
    row, off = row[by], off[by]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (off[1:] != off[:-1] + 1)
    s = np.flatnonzero(fresh)
    e = np.concatenate([s[1:], [len(row)]]) - 1 if len(s) else s
    return row[s], pos[row[s]] - _BACK + off[s], pos[row[e]] - _BACK + off[e] + MIN_WORDS


def _run_keys(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, key) of each run of MIN_WORDS words around each suffix; the seed's hash stands for the seed's words."""
    seed = np.asarray(t["h"].combine_chunks()).view(U64)[:, None]
    words = np.concatenate([_words_of(t, "prefix")[:, ::-1], seed, _words_of(t, "suffix")], axis=1)
    before, after, pos = (np.asarray(t[c].combine_chunks()).astype(np.int64) for c in ("before", "after", "pos"))
    offset = np.arange(WINDOW)
    row, off = np.nonzero((_BACK - offset <= before[:, None]) & (MIN_WORDS - (_BACK - offset) <= after[:, None]))
    return row, pos[row] - _BACK + off, _grams(words, WINDOW)[row, off]


_FOUND = "key long, id long, first int, stop int"


def _compare(contexts: DataFrame) -> DataFrame:
    """(key, id, first, stop): with a null key the matches of suffixes that lie together by seed, with a key each run around a suffix of a hot seed."""

    def batches_of(t: pa.Table, row: np.ndarray, first: np.ndarray, stop: np.ndarray, key: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        keys = pa.nulls(len(row), pa.int64()) if key is None else pa.array(key.view(np.int64))
        ids = t["id"].combine_chunks().take(pa.array(row))
        yield pa.RecordBatch.from_arrays([keys, ids, pa.array(first.astype(np.int32)), pa.array(stop.astype(np.int32))], names=["key", "id", "first", "stop"])

    def near(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        yield from batches_of(t, *repeated_runs(t), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            n_near = batch.num_rows - int(np.asarray(batch.column("hot").cast(pa.int8())).sum())  # hot rows are last
            for lo in range(n_near, batch.num_rows, 4096):
                t = pa.Table.from_batches([batch.slice(lo, 4096)]).combine_chunks()
                row, first, key = _run_keys(t)
                yield from batches_of(t, row, first, first + MIN_WORDS, key)
            if not n_near:
                continue
            batch = batch.slice(0, n_near)
            held.append(batch)
            rows += n_near
            if rows >= _ROWS:
                h = np.asarray(batch.column(0))
                new = np.flatnonzero(h != h[-1])
                if not len(new):
                    continue  # one seed in all of the batch, which may go on in the next
                cut = int(new[-1]) + 1
                yield from near([*held[:-1], batch.slice(0, cut)])
                held, rows = [batch.slice(cut)], n_near - cut
        if rows:
            yield from near(held)

    spread = F.when(F.col("hot"), F.pmod(F.xxhash64("id", "pos"), F.lit(1 << 20))).otherwise(-1)
    return contexts.repartition(F.col("h"), spread).sortWithinPartitions("hot", "h").mapInArrow(run, _FOUND)


def _matches(found: DataFrame) -> DataFrame:
    """(id, first, stop) of ``found``; a run of a hot seed counts if the least and the greatest document that has it differ."""
    who = F.coalesce("id", F.lit(-(1 << 63)))
    runs = found.where("key IS NOT NULL")
    shared = written(runs.groupBy("key").agg(F.min(who).alias("a"), F.max(who).alias("b"), F.count("*").alias("n")).where("a <> b").select("key", "n"), "shared-runs")
    return found.where("key IS NULL").select("id", "first", "stop").unionByName(join_counted(runs, shared, "key", "n").select("id", "first", "stop"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_rows: int = GROUP_ROWS) -> DataFrame:
    """(id, start_word, end_word) of the maximal spans of a document covered by runs of MIN_WORDS words that another document has as well.

    Words are runs of other than ASCII white space, ASCII letters lowered; places count from 0, the end is exclusive. Repeats
    within a document alone don't count; documents of fewer words, null and empty texts have none. Rows that repeat an id are one document.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    suffixes = written(_suffixes(rows), "suffixes")
    twice = written(suffixes.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "seeds")
    found_at = join_counted(suffixes, twice, "h", "n").select("id", F.struct("pos", (F.col("n") > group_rows).alias("hot")).alias("place"))
    places = written(found_at.groupBy("id").agg(F.array_sort(F.collect_set("place")).alias("places")), "places")
    release(suffixes, twice)
    contexts = _contexts(rows.join(places, rows["id"].eqNullSafe(places["id"])).select(rows["id"], "t", "places"))
    runs = _matches(written(_compare(contexts), "matches"))
    release(places)
    return merged_spans(runs).select("id", F.col("first").cast("long").alias("start_word"), F.col("stop").cast("long").alias("end_word"))


def merged_spans(spans: DataFrame) -> DataFrame:
    """(id, first, stop) of the unions of touching or overlapping spans of an id."""
    order = Window.partitionBy("id").orderBy("first", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = spans.distinct().withColumn("fresh", F.coalesce(F.col("first") > reach, F.lit(True)).cast("int")).withColumn("k", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return begins.groupBy("id", "k").agg(F.min("first").alias("first"), F.max("stop").alias("stop")).drop("k")


def drop_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the words of ``spans`` (id, start_word, end_word); the other words of a changed text are joined by single spaces.

    Spans may overlap or repeat. Rows that repeat an id each lose the id's spans, as ``repeated_spans`` takes them for one document; ids should be unique
    where texts are to be cut. Null texts, texts without spans and rows without an id stay as they are, as do all other columns, whatever their names.
    """
    key, cut_col = free_name(docs, "span_id"), free_name(docs, "spans")
    by = spans.groupBy(F.col("id").alias(key)).agg(F.array_sort(F.collect_list(F.struct("start_word", "end_word"))).alias(cut_col))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, listed: pd.Series) -> pd.Series:
        out = []
        for t, ss in zip(texts, listed, strict=True):
            if t is None or ss is None:
                out.append(t)
                continue
            words = t.encode().split()
            gone = np.zeros(len(words), bool)
            for x in ss:
                gone[x["start_word"] : x["end_word"]] = True
            out.append(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g).decode())
        return pd.Series(out, dtype=object)

    return docs.join(by, F.col(id_col).cast("long") == F.col(key), "left").withColumn(text_col, cut(F.col(text_col).cast("string"), F.col(cut_col))).select(*docs.columns)


def op5_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = repeated_spans(table(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)),
dup AS (SELECT g FROM g GROUP BY g HAVING min(doc_id) <> max(doc_id)),
hit AS (SELECT doc_id, p - 1 AS p, CASE WHEN p > 50 + lag(p) OVER (PARTITION BY doc_id ORDER BY p) THEN 1 ELSE 0 END AS fresh FROM g SEMI JOIN dup USING (g)),
isl AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM hit)
SELECT doc_id, CAST(min(p) AS BIGINT) AS start_word, CAST(max(p) + 50 AS BIGINT) AS end_word, CAST(max(p) + 50 - min(p) AS BIGINT) AS n_words FROM isl GROUP BY doc_id, k
"""
