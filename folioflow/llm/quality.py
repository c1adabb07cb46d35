"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting: round after round, a shallow tree on one binned feature at a time takes a small step
along the log loss, so that the sum of its trees is a lookup table of that feature. Then the pairs
of features that explain most of what is left get tables of their own, boosted the same way with
shallow trees over both. A text's score is the logistic of the intercept and the table entries of
its bins, added up for all texts of a batch at once.

The features are measures of the whole text: character classes, word lengths, repetition of words and lines.
The language, the source, the ids and the labels are never features.

Scale: the tables are fitted on the driver on at most ``TRAIN_ROWS`` labelled rows (those with the
smallest hashed id). Scoring is one pass without a shuffle; the model is a few kilobytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table
from ._text import NONSPACE_CLASS, Words, blocks, slice_hash, utf8

#: The most labelled rows that a model is fitted on.
TRAIN_ROWS = 20_000
FEATURES = ["log_bytes", "log_words", "word_length", "longest_word", "upper", "digits", "stops", "exclaims", "symbols", "pipes", "lines", "non_ascii",
            "distinct_words", "top_word", "repeated_next", "repeated_lines", "capitalised", "odd_ends", "brackets"]

_KIND = np.full(256, 10, np.uint8)
for _k, _chars in enumerate([b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b".,;:?'\"-", b"!", b"#$%&*@^~`+=<>_/\\", b"|", b"\n"]):
    _KIND[list(_chars)] = _k
_KIND[0x80:] = 9
_ODD_END = np.isin(_KIND, [5, 6, 7])


def features(texts: list[bytes]) -> np.ndarray:
    """A row of FEATURES for each text; shares of nothing are 0, so an empty text is a row of zeros."""
    out = np.zeros((len(texts), len(FEATURES)))
    for lo, hi in blocks(texts):
        words = Words(texts[lo:hi], NONSPACE_CLASS, lower=False)
        n = hi - lo
        size = np.diff(words.offset)
        at = np.repeat(np.arange(n), size)
        kinds = np.bincount(at * 16 + _KIND[words.buf[: len(at)]], minlength=16 * n).reshape(n, 16).astype(float)
        kinds[:, 8] -= 1  # the separator after each text
        length = np.maximum(size - 1.0, 1)
        count = np.diff(words.first)
        per_word = np.maximum(count, 1)
        owner, width = words.text_of(), words.end - words.start
        h = slice_hash(words.buf, words.start, words.end)
        code, names = pd.factorize(h)
        pair, times = np.unique(owner * max(1, len(names)) + code, return_counts=True)
        pair_owner = pair // max(1, len(names))
        top = np.zeros(n, np.int64)
        np.maximum.at(top, pair_owner, times)
        longest = np.zeros(n, np.int64)
        np.maximum.at(longest, owner, width)
        total = lambda mask: np.bincount(owner[mask], minlength=n)
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
        line_end = np.flatnonzero(words.buf[: len(at)] == 10)
        line_start = np.concatenate([[0], line_end[:-1] + 1])
        line_owner = at[line_end]
        line_key = pd.factorize(slice_hash(words.buf, line_start, line_end))[0] * np.int64(n) + line_owner
        kept_lines = np.bincount(np.unique(line_key) % n, minlength=n)
        all_lines = np.bincount(line_owner, minlength=n)
        letters = np.maximum(kinds[:, 0] + kinds[:, 1], 1)
        first, last = _KIND[words.buf[words.start]], _ODD_END[words.buf[words.end - 1]]
        out[lo:hi] = np.stack([
            np.log1p(size - 1), np.log1p(count), width_sum(owner, width, n) / per_word, np.log1p(longest), kinds[:, 1] / letters,
            *(kinds[:, k] / length for k in (2, 4, 5, 6, 7, 8, 9)),
            np.bincount(pair_owner, minlength=n) / per_word, top / per_word, total(same) / per_word, 1 - kept_lines / np.maximum(all_lines, 1),
            total(first == 1) / per_word, total(last) / per_word, kinds[:, 10] / length,
        ], axis=1)
    return out


def width_sum(owner: np.ndarray, width: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, width, n)


class AdditiveModel:
    """Lookup tables by feature and by pair of features, fitted by cyclic boosting."""

    def __init__(self, bins: int = 32, pair_bins: int = 12, pairs: int = 6, rounds: int = 120, rate: float = 0.1, smooth: float = 1.0):
        self.bins, self.pair_bins, self.n_pairs, self.rounds, self.rate, self.smooth = bins, pair_bins, pairs, rounds, rate, smooth
        self.intercept, self.edges, self.coarse, self.tables, self.pairs, self.pair_tables = 0.0, [], [], [], [], []

    def _edges(self, x: np.ndarray, bins: int) -> np.ndarray:
        return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)

    @staticmethod
    def _bin(x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)]

    def _split(self, g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
        """The gain of the best cut of a row of bins and its place."""
        if len(g) < 2:
            return 0.0, 0
        left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        all_g, all_h, s = g.sum(), h.sum(), self.smooth
        gain = left_g**2 / (left_h + s) + (all_g - left_g) ** 2 / (all_h - left_h + s) - all_g**2 / (all_h + s)
        k = int(np.argmax(gain))
        return float(gain[k]), k + 1

    def _tree(self, g: np.ndarray, h: np.ndarray, depth: int) -> tuple[np.ndarray, float]:
        """The step of a shallow tree over the bins (of one feature or two) and its gain."""
        best = max(((*self._split(g.sum(axis=tuple(a for a in range(g.ndim) if a != axis)), h.sum(axis=tuple(a for a in range(g.ndim) if a != axis))), axis) for axis in range(g.ndim)), key=lambda b: b[0])
        if depth == 0 or best[0] <= 1e-12:
            return np.full(g.shape, g.sum() / (h.sum() + self.smooth)), 0.0
        gain, at, axis = best
        parts = [self._tree(np.take(g, r, axis), np.take(h, r, axis), depth - 1) for r in (range(at), range(at, g.shape[axis]))]
        return np.concatenate([p for p, _ in parts], axis), gain + sum(x for _, x in parts)

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        y = y.astype(float)
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.intercept = float(np.log(share / (1 - share)))
        self.edges = [self._edges(x[:, f], self.bins) for f in range(x.shape[1])]
        self.coarse = [self._edges(x[:, f], self.pair_bins) for f in range(x.shape[1])]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        if not 0 < y.sum() < len(y):
            return self
        bins, coarse = self._bin(x, self.edges), self._bin(x, self.coarse)
        z = np.full(len(y), self.intercept)

        def boost(where: list[np.ndarray], tables: list[np.ndarray], rounds: int) -> None:
            for _ in range(rounds):
                for b, t in zip(where, tables, strict=True):
                    p = 1 / (1 + np.exp(-z))
                    g, h = (np.bincount(b, v, t.size).reshape(t.shape) for v in (y - p, p * (1 - p)))
                    step = self.rate * self._tree(g, h, 2)[0]
                    t += step
                    z[:] += step.ravel()[b]

        boost(bins, self.tables, self.rounds)
        shapes = [len(e) + 1 for e in self.coarse]
        p = 1 / (1 + np.exp(-z))
        ranked = []
        for a, b in combinations(range(x.shape[1]), 2):
            cell, shape = coarse[a] * shapes[b] + coarse[b], (shapes[a], shapes[b])
            g, h = (np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (y - p, p * (1 - p)))
            ranked.append((-self._tree(g, h, 2)[1], a, b))
        self.pairs = [(a, b) for _, a, b in sorted(ranked)[: self.n_pairs]]
        self.pair_tables = [np.zeros((shapes[a], shapes[b])) for a, b in self.pairs]
        boost([coarse[a] * shapes[b] + coarse[b] for a, b in self.pairs], self.pair_tables, self.rounds // 2)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for b, t in zip(self._bin(x, self.edges), self.tables, strict=True):
            z += t[b]
        if self.pairs:
            coarse = self._bin(x, self.coarse)
            for (a, b), t in zip(self.pairs, self.pair_tables, strict=True):
                z += t[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-z))


def held_out(id_col: str) -> F.Column:
    """Whether a row is kept from the fit: crc32 of the id as text leaves 1 when divided by 3. A null id doesn't."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> AdditiveModel:
    """A model of the labels of rows that aren't held out.

    Labels that are null don't count; of several for an id the mean decides, a tie for 1. Of several texts of an id the one with the smallest
    hash is taken, a null text as empty. Without labels, or with labels of one kind, every score is the (smoothed) share of label 1. Columns may have any other names.
    """
    votes = labels.where(F.col(label_col).isNotNull() & ~held_out(id_col) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(
        (F.avg(label_col) >= 0.5).cast("int").alias("y"))
    sample = votes.orderBy(F.xxhash64("id"), "id").limit(train_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(features(utf8(batch.column(1)))), pa.list_(pa.float64()))], names=["y", "x"])

    text = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    one = text.join(F.broadcast(sample), "id").groupBy("id").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t", "y")).alias("x"))
    got = one.select("x.y", "x.t").mapInArrow(run, "y int, x array<double>").toArrow()
    x = np.array(got.column("x").combine_chunks().flatten()).reshape(-1, len(FEATURES))
    y = np.array(got.column("y").combine_chunks())
    by = np.lexsort([*x.T, y])  # the fit doesn't depend on the order of rows
    return AdditiveModel().fit(x[by], y[by])


def score(docs: DataFrame, model: AdditiveModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row of ``docs``, by its whole text; null is scored as empty, repeated rows alike."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.score(features(utf8(batch.column(1)))))], names=["id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns, whatever their names.

    Rows are judged by their texts alone, so repeated ones stay or go together; null and empty texts get the score of an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col))

    @F.arrow_udf("double")
    def quality(texts: pa.Array) -> pa.Array:
        return pa.array(sent.value.score(features(utf8(texts))))

    return docs.where(quality(F.col(text_col).cast("string")) >= threshold)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return got.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
