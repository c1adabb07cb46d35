"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint is the bitwise majority of the XXH64 values of a text's 2-word shingles. Two
fingerprints that differ in at most ``max_bits`` of 64 bits share at least ``8 - max_bits`` of
their eight positional bytes (two, at 6 bits). The inverted index lists fingerprints by as many positional
bytes as that guaranteed minimum (one or two), so only candidates that can reach it meet. In a list the shared positional
bytes of each pair are tallied; pairs below the minimum go, of the others the list of the first shared bytes
has the pair for its own (a pair is verified once), and those are verified by their Hamming distance.

Scale: fingerprints that are equal are one class before anything else, so copies cost nothing. A
posting list longer than ``LIST_ROWS`` is cut into blocks and its block pairs are spread over the
tasks. Links are counted per class and reduced to a spanning forest inside each task; the links of a
class are never written out. Classes with a large share of all rows are joined back by broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._graph import LINK_SCHEMA, LinkTally, connected_components
from ._shared import free_name, join_counted, release, table, written
from ._text import NONSPACE_CLASS, U64, Words, blocks, join_words, utf8, xxh64

MAX_BITS = 6
#: Fingerprints of a posting list that one task compares with each other.
LIST_ROWS = 2048
#: Fingerprints of which a task compares the lists at a time.
_RUN_ROWS = 1 << 16

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float32)


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """The fingerprint of each text."""
    out = np.zeros(len(texts), U64)
    for lo, hi in blocks(texts):
        words = Words(texts[lo:hi], NONSPACE_CLASS)
        if not len(words):
            continue
        buf, start, end = join_words(words)
        count = np.diff(words.first)
        shingles = np.where(count > 1, count - 1, count)
        # A text's last word begins no shingle, unless it is the only one.
        begins = np.ones(len(words), bool)
        begins[words.first[1:][count > 1] - 1] = False
        at = np.flatnonzero(begins)
        text = words.text_of()
        last = np.where(count[text[at]] > 1, np.minimum(at + 1, len(words) - 1), at)
        h = xxh64(buf, start[at], end[last]).astype("<u8").view(np.uint8).reshape(-1, 8)
        # Bit totals from histograms of each positional byte, a few texts at a time.
        owner, bound = text[at], np.concatenate(([0], np.cumsum(shingles)))
        for a in range(0, hi - lo, 512):
            b = min(a + 512, hi - lo)
            rows = slice(bound[a], bound[b])
            base = (owner[rows] - a) * 256
            set_ = np.concatenate(
                [np.bincount(base + h[rows, p], minlength=(b - a) * 256).reshape(-1, 256).astype(np.float64) @ _BITS for p in range(8)], axis=1
            )
            bits = (2 * set_ > shingles[a:b, None]).astype(np.uint8)
            out[lo + a : lo + b] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: Sequence[str] = ()) -> DataFrame:
    """(id, fingerprint: long) of every row, with the columns ``more``, which have other names."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"), *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = fingerprints(utf8(batch.column(1))).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got), *batch.columns[2:]], names=["id", "fp", *more])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(["id long", "fp long", *(f"{c} {kinds[c]}" for c in more)]))


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """Of each exclusive or of two fingerprints the positions of equal bytes, as a mask of 8 bits."""
    low = U64(0x7F7F7F7F7F7F7F7F)
    differ = (((x & low) + low) | x) & ~low  # the top bit of each byte that isn't zero
    return ~((differ * U64(0x0002040810204081)) >> U64(56)).astype(np.uint8)


def _pairs_of_runs(key: np.ndarray, side: np.ndarray, fp: np.ndarray, shared: list[tuple[int, ...]], max_bits: int):
    """Linked index pairs among rows of equal key; two rows of a mixed block pair meet only across its sides."""
    which = (key >> 40 >> 16).astype(np.uint8)  # the number of the combination of positions
    at, d = np.arange(len(key)), 1
    # A pair belongs to the list of the first combination of the positions in which it agrees; 255: it agrees in too few.
    first = np.full(256, 255, np.uint8)
    for c in range(len(shared) - 1, -1, -1):
        need = sum(1 << p for p in shared[c])
        first[[m for m in range(256) if m & need == need]] = c
    first[np.bitwise_count(np.arange(256, dtype=np.uint8)) < 8 - max_bits] = 255  # count filter
    while True:
        at = at[at + d < len(key)]
        at = at[key[at] == key[at + d]]
        if not len(at):
            return
        for lo in range(0, len(at), 1 << 15):
            a = at[lo : lo + (1 << 15)]
            x = (fp[a] ^ fp[a + d]).view(U64)  # the population count of signed numbers is that of their magnitude
            own = np.flatnonzero(first[shared_bytes(x)] == which[a])
            near = own[np.bitwise_count(x[own]) <= max_bits]
            near = near[(side[a[near]] < 0) | (side[a[near]] != side[a[near] + d])]
            if len(near):
                yield a[near], a[near] + d
        d += 1


def class_links(classes: DataFrame, max_bits: int = MAX_BITS, list_rows: int = LIST_ROWS) -> DataFrame:
    """Of (fp, n) with distinct fp: rows (a, b, near).

    Rows with b null say that fingerprint a has ``near`` further rows linked (to be summed); rows
    with b set are edges that join what is linked.
    """
    minimum = 8 - max_bits
    if not 1 <= minimum <= 2:
        raise ValueError("the index holds one or two positional bytes: max_bits is 6 or 7")
    shared = list(combinations(range(8), minimum))
    postings = classes.select("fp", "n", F.explode(F.array(*[
        F.lit(c << 16) + sum(F.shiftrightunsigned("fp", 8 * p).bitwiseAND(255) * (1 << (8 * k)) for k, p in enumerate(ps))
        for c, ps in enumerate(shared)
    ])).alias("key"))
    # Long lists, of at most 28 x 65,536 possible keys, are cut into blocks that meet in pairs.
    cut = written(postings.groupBy("key").count().where(F.col("count") > list_rows).select(
        "key", F.ceil(F.col("count") / list_rows).cast("int").alias("parts")), "lists")
    part = F.pmod(F.xxhash64("fp", F.lit(7)), F.coalesce("parts", F.lit(1))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    rows = (
        postings.join(F.broadcast(cut), "key", "left").select("fp", "n", "key", part.alias("own"), other.alias("o"))
        .select("fp", "n", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "own", "key")
        .select("fp", "n", (F.shiftleft(F.col("key").cast("long"), 40) + F.col("i") * (1 << 20) + F.col("j")).alias("key"),
                F.when(F.col("i") == F.col("j"), -1).otherwise(F.col("own")).alias("side"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        held = 0

        def flush(end: bool):
            nonlocal kept, held
            if not kept:
                return None
            key, side, fp, n = (np.concatenate(c) for c in zip(*kept, strict=True))
            upto = len(key) if end else int(np.searchsorted(key, key[-1]))
            kept, held = [(key[upto:], side[upto:], fp[upto:], n[upto:])], len(key) - upto
            if not upto:
                return None
            key, side, fp, n = key[:upto], side[:upto], fp[:upto], n[:upto]
            values, node = np.unique(fp, return_inverse=True)
            weight = np.zeros(len(values), np.int64)
            weight[node] = n
            tally = LinkTally(weight)
            for a, b in _pairs_of_runs(key, side, fp, shared, max_bits):
                tally.add(node[a], node[b])
            return tally.rows(values)

        for batch in batches:
            kept.append((batch.column("key").to_numpy(), batch.column("side").to_numpy(), batch.column("fp").to_numpy(), batch.column("n").to_numpy()))
            held += batch.num_rows
            if held >= _RUN_ROWS and (out := flush(False)) is not None:
                yield out
        if (out := flush(True)) is not None:
            yield out

    return rows.select("key", "side", "fp", "n").repartition("key").sortWithinPartitions("key").mapInArrow(run, LINK_SCHEMA)


def _linked(classes: DataFrame, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """(links, rows of ``classes`` with the component that their fingerprint belongs to)."""
    links = written(class_links(classes.select("fp", "n"), max_bits), "links")
    joined = connected_components(links.where("b IS NOT NULL").select("a", "b"))
    named = classes.join(joined.withColumnRenamed("node", "fp"), "fp", "left")
    return links, named.withColumn("component", F.coalesce("component", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """(id, fp, n_near, component_id) of every row of ``docs``.

    n_near counts the other rows at ``max_bits`` or fewer differing bits; component_id is the smallest
    id reachable over such links. Null and empty texts, and texts without words, have fingerprint
    zero and link like any other; rows that repeat an id are rows of their own. A row whose id is
    null links like any other and is named by no component that has another id. Texts are taken whole, whatever their length.
    Other columns of ``docs`` play no part. Without rows there are no rows.
    """
    prints = written(fingerprint_table(docs, id_col, text_col), "fingerprints")
    classes = written(prints.groupBy("fp").agg(F.count("*").alias("n"), F.min("id").alias("least")), "classes")
    links, named = _linked(classes, max_bits)
    near = links.where("b IS NULL").groupBy(F.col("a").alias("fp")).agg(F.sum("near").alias("near"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = written(named.join(smallest, "component").join(near, "fp", "left").select(
        "fp", "n", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("n_near"), "component_id"), "print-classes")
    release(classes, links)
    return join_counted(prints, of_class, "fp", "n").select("id", "fp", "n_near", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each component of ``docs``, with all its columns: that of the smallest id, null after all others.

    Ids need not be set or unique: of rows of one component and id the one with the smallest text digest stays, and of those that agree in
    both the one with the smallest hash of all columns (then whichever, as such rows are equal). Null and empty texts, and texts without words,
    are near one another. Columns may have any names. Without rows there are no rows.
    """
    id_, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    digest = F.coalesce(F.unhex(F.md5(text.cast("binary"))), F.lit(b""))
    whole = F.xxhash64(*[c for c, kind in docs.dtypes if "map<" not in kind])  # a map has no hash
    name, n = free_name(docs, "row"), free_name(docs, "n")
    keyed = docs.withColumn(name, F.struct(id_.isNull().alias("no_id"), F.coalesce(id_, F.lit(0)).alias("id"), digest.alias("digest"), whole.alias("whole")))
    # Equal rows are counted first, so a minimum says how many rows it stands for.
    rows = fingerprint_table(keyed, id_col, text_col, [name]).groupBy("fp", F.col(name).alias("row")).agg(F.count("*").alias("times"))
    classes = written(rows.groupBy("fp").agg(F.sum("times").alias("n"), F.min(F.struct("row", "times")).alias("least")), "classes")
    links, named = _linked(classes, max_bits)
    kept = written(named.groupBy("component").agg(F.min("least").alias("least")).select(F.col("least.row").alias(name), F.col("least.times").alias(n)), "kept")
    release(classes, links)
    one = join_counted(keyed, kept, name, n)
    if kept.where(F.col(n) > 1).limit(1).count():  # rows equal in all columns
        one = one.where(F.col(n) == 1).unionByName(one.where(F.col(n) > 1).dropDuplicates([name]))
    return one.select(*docs.columns)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_duplicates(table(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "n_near", "component_id")
