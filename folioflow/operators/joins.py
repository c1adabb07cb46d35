"""Join semantics: as-of lookups, containment, positional joins, lookups with defaults."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_match
from ..sources.shared import release, written
from .windows import word_windows

#: Slots by which runs of words that no needle has are left out early. Needles fill them as far as they go; the join decides on what is left.
SLOTS = 1 << 20
#: Bytes of text whose words are hashed at a time.
_TEXT_BYTES = 4 << 20


def asof_backward(left: DataFrame, right: DataFrame, on: str, right_on: str, order: str, by: list[str] | None = None, buckets: int = 0) -> DataFrame:
    """Each row of ``left`` with the right row of the greatest ``right_on`` that isn't above ``on``; of ties the first by ``order``.

    Right columns are a struct ``match``, null without a match. The sides are unioned and the last right row is carried along
    in order. With ``by`` each group is a task's share; without it, or for groups too large for one, ``buckets`` cuts the range into as many parts,
    by the quantiles of the right side, and a part starts from the last right row before it.
    """
    by = list(by or [])
    keys = [F.col(k) for k in by]
    first = Window.partitionBy(*by, right_on).orderBy(order)
    best = right.withColumn("__k", F.row_number().over(first)).where("__k = 1").drop("__k")
    r = best.select(*keys, F.col(right_on).alias("__v"), F.lit(0).alias("__side"), F.struct(*right.columns).alias("match"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("__l"))
    l = left.select(*keys, F.col(on).alias("__v"), F.lit(1).alias("__side"), F.lit(None).cast(best.select(F.struct(*right.columns)).schema[0].dataType).alias("match"), F.struct(*left.columns).alias("__l"))
    both = r.unionByName(l)
    part = list(by)
    if buckets > 1:
        cuts = [c for c in (right.where(F.col(right_on).isNotNull()).approxQuantile(right_on, [k / buckets for k in range(1, buckets)], 0.01) or []) if c is not None]
        slot = sum((F.when(F.col("__v") >= F.lit(c), 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0))
        both = both.withColumn("__b", slot)
        part = [*by, "__b"]
        # The last right row of each part starts the later ones.
        last = both.where("__side = 0").groupBy(*part).agg(F.max_by("match", "__v").alias("match"), F.max("__v").alias("__v"))
        parts = len(set(cuts)) + 1
        seeds = last.withColumn("__to", F.explode(F.filter(F.sequence(F.lit(0), F.lit(parts - 1)), lambda x: x > F.col("__b")))).groupBy(*by, "__to").agg(
            F.max_by("match", "__v").alias("match"), F.max("__v").alias("__v")).select(*keys, "__v", F.lit(0).alias("__side"), "match", F.lit(None).cast(both.schema["__l"].dataType).alias("__l"), F.col("__to").alias("__b"))
        both = both.unionByName(seeds)
    run = Window.orderBy("__v", "__side").rowsBetween(Window.unboundedPreceding, 0) if not part else Window.partitionBy(*part).orderBy("__v", "__side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("match", F.last("match", True).over(run)).where("__side = 1").select("__l.*", F.when(F.col("__v").isNotNull(), F.col("match")).alias("match"))


def next_start(starts: DataFrame, key: str = "pdf", page: str = "page") -> DataFrame:
    """(key, page, next_page): of each distinct page of a file the next greater one that anything starts on."""
    w = Window.partitionBy(key).orderBy(page)
    return starts.select(key, page).distinct().withColumn("next_page", F.lead(page).over(w))


def asof_forward(left: DataFrame, starts: DataFrame, key: str = "pdf", page: str = "page") -> DataFrame:
    """``left`` with ``next_page``, the smallest page of ``starts`` in the same file above its own."""
    w = Window.partitionBy(key).orderBy(F.col(page).desc(), "__side").rowsBetween(Window.unboundedPreceding, 0)
    s = starts.select(key, page).distinct().withColumn("__side", F.lit(1))
    l = left.select(F.col(key), F.col(page), F.lit(0).alias("__side"), F.struct(*left.columns).alias("__l"))
    # Greatest page first; at one page the left rows come before the starts, which are then not above them.
    both = s.withColumn("__l", F.lit(None).cast(l.schema["__l"].dataType)).unionByName(l)
    return both.withColumn("next_page", F.last(F.when(F.col("__side") == 1, F.col(page)), True).over(w)).where("__side = 0").select("__l.*", "next_page")


def with_expected(counts: DataFrame, expected: DataFrame, key: str = "id") -> DataFrame:
    """Left join with expected numbers; unknown ones stay null."""
    return counts.join(expected.select(key, "expected"), key, "left")


def in_dictionary(tokens: DataFrame, dictionary: DataFrame, token: str = "token", word: str = "word", anti: bool = False) -> DataFrame:
    """Tokens that are (or with ``anti`` aren't) in the dictionary."""
    return tokens.join(dictionary.select(F.col(word).alias(token)).distinct(), token, "left_anti" if anti else "left_semi")


def contains_window(needles: DataFrame, haystacks: DataFrame, needle: str, hay: str, window: int = 8, stride: int = 4, margin: int = 4, short: bool = True) -> DataFrame:
    """Pairs whose haystack holds one of the needle's word windows as a substring, so that a window may begin or end within a word.

    Both texts are normalized for matching. All words of a window but its first and last are whole words of such a haystack, so windows meet haystacks by
    an equi-join of up to four of them (of two words by the characters about the space, of one word by its first three characters); only ids and hashes
    are shuffled for that, of a haystack those that a bitmap of the needles' hashes lets through. Pairs that meet are verified on the texts. A needle of fewer than 4 words must be held whole, or with ``short`` false is
    left out; a needle without words is in nothing. Rows: all columns of both sides, which have different names, once for each pair of rows.
    """
    if both := {c.lower() for c in needles.columns} & {c.lower() for c in haystacks.columns}:
        raise ValueError(f"columns of both sides: {sorted(both)}")
    words = lambda t: F.filter(F.split(t, " "), lambda w: w != "")
    row = lambda df: F.xxhash64(*df.columns)  # noqa: E731 - equal rows share it, unlike ones that share it part at the verification
    w = F.col("w")
    wins = F.when(F.size(w) >= 4, word_windows(w, margin, window, stride))
    wins = wins.when(F.size(w) > 0, F.array(F.array_join(w, " "))) if short else wins
    n = needles.select(row(needles).alias("nid"), F.struct(*needles.columns).alias("n"), words(normalize_match(F.col(needle))).alias("w")).withColumn("wins", wins).drop("w")
    part = n.select("nid", F.explode(F.array_distinct("wins")).alias("s")).withColumn("w", F.split("s", " ")).withColumn("k", F.least(F.lit(4), F.size("w") - 2))
    inner = F.array_join(F.slice(w, F.lit(2), F.greatest("k", F.lit(0))), " ")
    about = lambda a, b: F.concat(F.right(a, F.lit(1)), F.lit(" "), F.left(b, F.lit(1)))
    key = F.when(F.col("k") >= 1, inner).when(F.col("k") == 0, about(F.get(w, F.lit(0)), F.get(w, F.lit(1)))).otherwise(F.left("s", F.lit(3)))
    tried = part.select("nid", F.when(F.col("k") < 0, -F.length(key)).otherwise(F.col("k")).alias("k"), key.alias("key"))
    tried = written(tried.select("nid", "k", F.when(F.col("k") >= 1, _run_hash(F.col("key"))).otherwise(F.xxhash64("k", "key")).alias("key")).distinct(), "window-keys")
    kinds = sorted(r[0] for r in tried.select("k").distinct().collect())  # of 1 to 4 words, 0, and 1 to 3 characters as -1 to -3
    h = haystacks.select(row(haystacks).alias("hid"), normalize_match(F.col(hay)).alias("t"))

    def keys(k: int) -> Column:
        count = F.size(w) - 1 if k == 0 else F.length("t") + k + 1
        at = F.when(count >= 1, F.sequence(F.lit(1), F.greatest(count, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        if k == 0:
            return F.transform(at, lambda i: F.xxhash64(F.lit(k), about(F.get(w, i - 1), F.get(w, i))))
        return F.transform(at, lambda i: F.xxhash64(F.lit(k), F.substring("t", i, F.lit(-k))))

    listed = _runs_met(h, tried, [k for k in kinds if k > 0])
    if short := [k for k in kinds if k <= 0]:
        listed = listed.unionByName(h.withColumn("w", words(F.col("t"))).select("hid", F.explode(F.array_distinct(F.concat(*map(keys, short)))).alias("key")))
    # Written, so that its size is known: while it is small the texts aren't shuffled.
    met = written(listed.join(tried.select("nid", "key").distinct(), "key").select("nid", "hid").distinct(), "windows-met")
    release(tried)
    texts = haystacks.select(row(haystacks).alias("hid"), F.struct(*haystacks.columns).alias("h"))
    held = texts.join(met, "hid").join(n, "nid").withColumn("t", normalize_match(F.col(f"h.{hay}")))
    return held.where(F.exists("wins", lambda x: F.contains(F.col("t"), x))).select("n.*", "h.*")


def _runs_met(texts: DataFrame, tried: DataFrame, kinds: list[int]) -> DataFrame:
    """(hid, key) of the runs of ``kinds`` words of texts normalized for matching whose slot a key of ``tried`` fills: each once in a text, at the least all that a needle has."""
    filled = np.zeros(SLOTS, bool)
    for r in tried.where("k > 0").select(F.pmod("key", F.lit(SLOTS)).cast("int").alias("slot")).distinct().toLocalIterator():
        filled[r.slot] = True
    bits = np.packbits(filled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = np.unpackbits(bits).astype(bool)
        for b in batches:
            step = max(1, int(len(b) * _TEXT_BYTES / max(1, b.nbytes)))
            for at in range(0, len(b), step):
                ids, rows, keys = np.asarray(b["hid"][at : at + step]), [], []
                for row, key in word_runs(b["t"][at : at + step], kinds):
                    kept = filled[key & np.uint64(SLOTS - 1)]
                    rows.append(row[kept])
                    keys.append(key[kept])
                if rows:
                    once = np.unique(np.stack([np.concatenate(rows).astype(np.uint64), np.concatenate(keys)]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[once[0].astype(np.int64)], pa.int64()), pa.array(once[1].view(np.int64), pa.int64())], ["hid", "key"])

    return texts.where("t IS NOT NULL").select("hid", "t").mapInArrow(run, "hid long, key long")


def word_runs(texts: pa.Array, kinds: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each number of words the runs of so many in texts of words with single spaces: the text's place and the run's 64-bit hash."""
    lists = pc.split_pattern(texts, " ")
    coded = pc.dictionary_encode(lists.flatten())
    hashed = np.array([int.from_bytes(blake2b(w.encode(), digest_size=8).digest(), "little") for w in coded.dictionary.to_pylist()], np.uint64)
    hashes, rows = hashed[np.asarray(coded.indices)], np.asarray(pc.list_parent_indices(lists))
    for k in kinds:
        n = max(0, len(hashes) - k + 1)
        key = np.full(n, k, np.uint64)
        for j in range(k):
            key = (key ^ (key >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
        whole = rows[:n] == rows[k - 1 : k - 1 + n]
        yield rows[:n][whole], key[whole]


def _run_hash(run: Column) -> Column:
    """The hash that ``word_runs`` gives to a text's only run of all its words."""
    @F.arrow_udf("long")
    def hashed(runs: pa.Array) -> pa.Array:
        out = np.zeros(len(runs), np.uint64)
        sizes = np.asarray(pc.fill_null(pc.list_value_length(pc.split_pattern(runs, " ")), 0))
        for k in set(sizes.tolist()) - {0}:
            own = np.flatnonzero(sizes == k)
            for row, key in word_runs(runs.take(pa.array(own)), [k]):
                out[own[row]] = key
        return pa.array(out.view(np.int64), pa.int64())

    return hashed(run)


def contains_text(needles: DataFrame, haystacks: DataFrame, windows: Column, hay: Column) -> DataFrame:
    """Pairs whose haystack holds one of the needle's windows as a substring, words cut at the ends included.

    This condition has no key: it is a nested loop, for few and short haystacks, as of one page range. ``contains_window`` is the one for large inputs.
    """
    n = needles.withColumn("__wins", windows)
    return n.join(haystacks.withColumn("__hay", hay), F.expr("exists(__wins, w -> w <> '' AND contains(__hay, w))")).drop("__wins", "__hay")


def zip_rows(left: DataFrame, right: DataFrame, left_order: str, right_order: str, key: list[str] | None = None) -> DataFrame:
    """The i-th row of each side, left rows without a counterpart with nulls. Without ``key`` both sides are to be small lists."""
    key = list(key or [])
    part = key or [F.lit(0)]
    number = lambda df, o: df.withColumn("__i", F.row_number().over(Window.partitionBy(*part).orderBy(o)))
    return number(left, left_order).join(number(right, right_order), [*key, "__i"], "left").drop("__i")


def lookup(mapping: dict[str, str], key: Column) -> Column:
    """Value of a key, null where there is none."""
    if not mapping:
        return F.lit(None).cast("string")
    return F.element_at(F.create_map(*[F.lit(x) for kv in sorted(mapping.items()) for x in kv]), key)


def piecewise_page(printed: Column, files: list[tuple[str, int]]) -> Column:
    """Struct (pdf, page) of a printed page; ``files`` are (name, first printed page less 1), in order."""
    out = None
    for k, (name, before) in enumerate(files):
        value = F.struct(F.lit(name).alias("pdf"), (printed - before).cast("int").alias("page"))
        last = k + 1 == len(files)
        cond = F.lit(True) if last else printed <= files[k + 1][1]
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out


def printed_page(pdf: Column, page: Column, files: list[tuple[str, int]]) -> Column:
    """The printed page of a page of a file; null for an unknown file."""
    out = F.lit(None).cast("int")
    for name, before in files:
        out = F.when(pdf == name, page + before).otherwise(out)
    return out
