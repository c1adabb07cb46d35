"""Edit-aware token counts.

For each document a segment tree is kept over its pre-tokens (pieces of the tokenizer's splitting pattern, within which
byte-pair merges stay): its leaves are short runs of pre-tokens with their lengths and token counts, its nodes
the sums of their subtrees. An edit finds its place by the sums of lengths, re-splits the text from a
boundary before the edit that its context can't move, until a new boundary meets an old one again, encodes only those pre-tokens
and updates the sums on the paths to the root.

Trees are kept as a table: a row a document, with the root's sums, the lengths and counts of its pre-tokens (a byte each, more for one of 255 or over) and the digest of
the text they are of. Counting edits reads that table, and encodes no text from its start; it gives the table of the trees after the edits.

The vocabulary file is read where it lies on each machine; its path is a parameter.

Scale: trees are made in one pass without a shuffle. Only documents with edits are shuffled with their text, to meet their trees.
A worker keeps token counts of at most ``CACHE`` pre-tokens.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table, written

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 300_000
SEGMENT = 64
#: Characters before an edit, apart from white space, that may decide on a boundary; the longest fixed piece of the pattern has 3.
CONTEXT = 4

Edit = tuple[int, int, str]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class _Counts(dict):
    """Token counts by pre-token; a missing one is encoded."""

    def __init__(self, encoding: tiktoken.Encoding):
        self.encoding = encoding

    def __missing__(self, piece: str) -> int:
        got = len(self.encoding.encode_ordinary(piece))
        if len(piece) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = got
        return got


class Counter:
    """Splits text into pre-tokens and counts the tokens of each."""

    def __init__(self, path: str, pattern: str = PATTERN):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.encoding = tiktoken.Encoding("counted", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.count = _Counts(self.encoding).__getitem__

    def split(self, text: str) -> tuple[list[int], list[int]]:
        """Lengths and token counts of the pre-tokens."""
        pieces = self.pattern.findall(text)
        return list(map(len, pieces)), list(map(self.count, pieces))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


class TokenTree:
    """Sums of lengths and token counts over runs of pre-tokens."""

    def __init__(self, lengths: list[int], counts: list[int]):
        self._build(lengths, counts)

    def _build(self, lengths: list[int], counts: list[int]) -> None:
        n = max(1, -(-len(lengths) // SEGMENT))
        self.lengths = [lengths[k * SEGMENT : (k + 1) * SEGMENT] for k in range(n)]
        self.counts = [counts[k * SEGMENT : (k + 1) * SEGMENT] for k in range(n)]
        self.size = 1 << (n - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for k in range(n):
            self.chars[self.size + k], self.tokens[self.size + k] = sum(self.lengths[k]), sum(self.counts[k])
        for k in range(self.size - 1, 0, -1):
            self.chars[k], self.tokens[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def leaves(self) -> tuple[list[int], list[int]]:
        """Lengths and token counts of the pre-tokens."""
        return [x for part in self.lengths for x in part], [x for part in self.counts for x in part]

    def pieces(self) -> int:
        return sum(map(len, self.lengths))

    def locate(self, at: int) -> tuple[int, int, int]:
        """(segment, place in it, first character) of the pre-token that holds character ``at``; the end of the text counts to the last one."""
        at = max(0, min(at, self.chars[1] - 1))
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if at - start >= self.chars[node]:
                start, node = start + self.chars[node], node + 1
        s, i = node - self.size, 0
        if s >= len(self.lengths):
            return 0, 0, 0
        while i + 1 < len(self.lengths[s]) and start + self.lengths[s][i] <= at:
            start, i = start + self.lengths[s][i], i + 1
        return s, i, start

    def replace(self, s: int, i: int, t: int, j: int, lengths: list[int], counts: list[int]) -> None:
        """Pre-tokens from (s, i) up to (t, j), without it, become the given ones."""
        tail = (self.lengths[t][j:], self.counts[t][j:]) if t < len(self.lengths) else ([], [])
        for own, new, rest in ((self.lengths, lengths, tail[0]), (self.counts, counts, tail[1])):
            if t == s:
                own[s] = own[s][:i] + new + rest
            else:
                own[s] = own[s][:i] + new
                for k in range(s + 1, min(t, len(own))):
                    own[k] = []
                if t < len(own):
                    own[t] = rest
        if len(self.lengths[s]) > 4 * SEGMENT:
            self._build(*self.leaves())
            return
        for k in range(s, min(t, len(self.lengths) - 1) + 1):
            node = self.size + k
            self.chars[node], self.tokens[node] = sum(self.lengths[k]), sum(self.counts[k])
            while node := node // 2:
                self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
                self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]


def proper_edits(edits: list[Edit], length: int) -> list[Edit]:
    """Edits in order, within the text; one that begins inside an earlier one is left out."""
    out: list[Edit] = []
    for s, e, r in sorted((max(0, min(s, length)), max(0, min(e, length)), r or "") for s, e, r in edits):
        if e >= s and (not out or s >= out[-1][1] and (s, e) != (out[-1][0], out[-1][1])):
            out.append((s, e, r))
    return out


def edited(text: str, edits: list[Edit]) -> str:
    out, at = [], 0
    for s, e, r in edits:
        out += [text[at:s], r]
        at = e
    return "".join(out) + text[at:]


def _settled(text: str, at: int) -> int:
    """A place whose pre-token, and all before it, can't change by an edit at ``at``."""
    while at > 0 and text[at - 1].isspace():
        at -= 1
    return max(0, at - CONTEXT)


def apply_edits(tree: TokenTree, text: str, edits: list[Edit], split: Counter) -> tuple[str, int]:
    """Brings the tree of ``text`` up to date with the edits; (the new text, pre-tokens encoded again)."""
    edits = proper_edits(edits, len(text))
    new, shift, k, again = edited(text, edits), 0, 0, 0
    while k < len(edits):
        s, e, r = edits[k]
        at, until, moved = s + shift, s + shift + len(r), len(r) - (e - s)
        seg, i, start = tree.locate(_settled(new, at))
        t, j, old = seg, i, start  # the pre-token after the last old boundary that was passed
        lengths: list[int] = []
        counts: list[int] = []
        here, end = start, len(new)
        while True:
            while t < len(tree.lengths) and old < here - moved:  # old boundaries up to the new one
                if j < len(tree.lengths[t]):
                    old, j = old + tree.lengths[t][j], j + 1
                else:
                    t, j = t + 1, 0
            met = here >= until and (old == here - moved or here >= end)
            if met and k + 1 < len(edits) and (here >= end or _settled(new, edits[k + 1][0] + shift + moved) < here):
                k += 1  # the next edit lies within reach of this one
                s, e, r = edits[k]
                until, moved = s + shift + moved + len(r), moved + len(r) - (e - s)
                continue
            if met:
                break
            m = split.pattern.match(new, here)
            lengths.append(m.end() - here)
            counts.append(split.count(m.group()))
            here = m.end()
        if here >= end:
            t, j = len(tree.lengths) - 1, len(tree.lengths[-1])
        tree.replace(seg, i, t, j, lengths, counts)
        again, shift, k = again + len(lengths), shift + moved, k + 1
    return new, again


_EMAIL = regex.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBER = regex.compile(r"\+?\d(?:[ ().-]?\d){6,}")


def redactions(text: str) -> list[Edit]:
    """The edits of a pass that masks e-mail addresses and numbers of 7 or more digits."""
    mail = [(m.start(), m.end(), "<EMAIL>") for m in _EMAIL.finditer(text)] if "@" in text else []
    return mail + [(m.start(), m.end(), "<NUMBER>") for m in _NUMBER.finditer(text) if not any(s < m.end() and m.start() < e for s, e, _ in mail)]


_TREES = "id long, digest string, n_chars long, n_pretokens long, n_tokens long, lengths binary, counts binary"
_TREE_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
_COUNTED = "n_chars long, n_pretokens long, n_tokens long, n_edits long, n_reencoded long, n_tokens_after long"


def packed(values: list[int]) -> bytes:
    """The values in a byte each; 255 says that the next byte belongs to the same value."""
    try:
        got = bytes(values)
        if 255 not in got:
            return got
    except ValueError:
        pass
    return b"".join(b"\xff" * (v // 255) + bytes([v % 255]) for v in values)


def unpacked(data: bytes) -> list[int]:
    x = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(x < 255)
    return x.tolist() if len(ends) == len(x) else np.add.reduceat(x.astype(np.int64), np.concatenate([[0], ends[:-1] + 1])).tolist()


def _tree_row(text: str, lengths: list[int], counts: list[int]) -> tuple:
    return len(text), len(lengths), sum(counts), packed(lengths), packed(counts)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), t.alias("t")).withColumn("digest", F.md5(F.col("t").cast("binary")))


def token_trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, digest, n_chars, n_pretokens, n_tokens, lengths, counts) of every row of ``docs``: the root's sums and the leaves of its tree, and the MD5 of the text.

    Null and empty texts have trees without leaves; rows that repeat an id are rows of their own. Other columns play no part.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = counter(path)
        for batch in batches:
            rows = [_tree_row(t, *split.split(t)) for t in (v.as_py() for v in batch.column(1))]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c, k) for c, k in zip(columns, _TREE_KINDS[2:], strict=True))], names=_names(_TREES))

    return _keyed(docs, id_col, text_col).mapInArrow(run, _TREES)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def edit_trees(trees: DataFrame, changed: DataFrame, vocabulary: str | None = None, leaves: bool = True) -> DataFrame:
    """Every row of ``trees`` after the edits of ``changed`` (id, digest, t, edits): the counts before and after, and with ``leaves`` the new tree as column ``tree``.

    A tree meets the changes of its id and text; those of other texts are left aside. ``changed`` has each id and digest once.
    """
    path = vocabulary or default_vocabulary()
    own, new = trees.select(*_names(_TREES)), changed.select(F.col("id").alias("i"), F.col("digest").alias("d"), "t", "edits")
    met = own.join(new, own["id"].eqNullSafe(new["i"]) & (own["digest"] == new["d"]), "left").select(*_names(_TREES), "t", "edits")
    kind = f"id long, {_COUNTED}" + (f", tree struct<{_TREES.replace(' ', ':').replace(',:', ', ')}>" if leaves else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = counter(path)
        for batch in batches:
            before = np.asarray(batch.column("n_tokens"))
            n_edits, again, after = np.zeros(len(before), np.int64), np.zeros(len(before), np.int64), before.copy()
            fresh: dict[int, tuple] = {}
            texts = batch.column("t")
            for k in np.flatnonzero(~np.asarray(texts.is_null())).tolist():
                text = texts[k].as_py()
                edits = proper_edits([(x["s"], x["e"], x["r"]) for x in batch.column("edits")[k].as_py()], len(text))
                tree = TokenTree(*(unpacked(batch.column(c)[k].as_py()) for c in ("lengths", "counts")))
                text, again[k] = apply_edits(tree, text, edits, split)
                n_edits[k], after[k] = len(edits), tree.total
                if leaves:
                    fresh[k] = (hashlib.md5(text.encode()).hexdigest(), *_tree_row(text, *tree.leaves()))
            out = [batch.column(c) for c in ("id", "n_chars", "n_pretokens", "n_tokens")] + list(map(pa.array, (n_edits, again, after)))
            if leaves:
                old = [batch.column(c).to_pylist() for c in _names(_TREES)]
                for k, row in fresh.items():
                    for c, v in zip(old[1:], row, strict=True):
                        c[k] = v
                out.append(pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(old, _TREE_KINDS, strict=True)], _names(_TREES)))
            yield pa.RecordBatch.from_arrays(out, names=["id", *_names(_COUNTED), *(["tree"] if leaves else [])])

    return met.mapInArrow(run, kind)


def count_tokens(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, trees: DataFrame | None = None,
                 leaves: bool = False) -> DataFrame:
    """(id, n_chars, n_pretokens, n_tokens, n_edits, n_reencoded, n_tokens_after) of every row of ``docs``; with ``leaves`` also the ``tree`` after the edits.

    ``edits`` holds (id, start, end, replacement) in code points of the text as it is, end exclusive, a null
    replacement deletes; each row with an id gets that id's edits, and those of a null id are left aside. Places beyond the text are moved to its end; an edit that
    begins inside an earlier one, or repeats its place, is left out. Null and empty texts have no tokens but can be inserted into.
    ``trees`` are the kept trees of ``docs``; without them they are made first.
    """
    trees = written(token_trees(docs, id_col, text_col, vocabulary), "trees") if trees is None else trees
    by = edits.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.collect_list(F.struct(
        F.col("start").cast("long").alias("s"), F.col("end").cast("long").alias("e"), F.col("replacement").cast("string").alias("r"))).alias("edits"))
    return edit_trees(trees, _keyed(docs, id_col, text_col).join(by, "id").dropDuplicates(["id", "digest"]), vocabulary, leaves)


def redacted_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, t, edits) of the texts that ``redactions`` changes, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64()), ("r", pa.string())]))
        for batch in batches:
            edits = [redactions(t) for t in batch.column(1).to_pylist()]
            some = pa.array([k for k, x in enumerate(edits) if x], pa.int64())
            listed = pa.array([[{"s": s, "e": e, "r": r} for s, e, r in x] for x in edits if x], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(some), batch.column(2).take(some), batch.column(1).take(some), listed], names=["id", "digest", "t", "edits"])

    return _keyed(docs, id_col, text_col).mapInArrow(run, "id long, digest string, t string, edits array<struct<s:long,e:long,r:string>>").dropDuplicates(["id", "digest"])


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents from their trees, before and after the redacting edits of each."""
    docs = table(spark, sf_dir, "documents")
    trees = written(token_trees(docs), "trees")
    return edit_trees(trees, redacted_rows(docs), leaves=False).withColumnRenamed("id", "doc_id")
