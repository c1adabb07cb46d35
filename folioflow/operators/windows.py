"""Sequence operators: gaps, samples, anchors and their interpolation, page ranges, navigation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_gap(rows: DataFrame, key: list[str], pos: str = "pos", number: str = "n") -> DataFrame:
    """Of each group whose numbers aren't 1, 2, ... in order of ``pos`` the first that differs: (key, got, expected). ``pos`` counts from 0."""
    off = ~F.col(number).eqNullSafe(F.col(pos) + 1)
    return rows.where(off).groupBy(*key).agg(F.min_by(number, pos).alias("got"), (F.min(pos) + 1).alias("expected"))


def sample_positions(count: Column) -> Column:
    """First, middle and last position of a list, without repeats."""
    return F.when(count > 0, F.array_sort(F.array_distinct(F.array(F.lit(0), F.floor(count / 2).cast("int"), (count - 1).cast("int"))))).otherwise(F.array().cast("array<int>"))


def sample_rows(rows: DataFrame, key: list[str], pos: str = "pos") -> DataFrame:
    """The rows at those positions of each group. The group sizes are counted apart and joined, so that no group is held in one place."""
    sizes = rows.groupBy(*key).agg(F.count("*").alias("__n"))
    return rows.join(sizes, key).where(F.col(pos).isin(0) | (F.col(pos) == F.floor(F.col("__n") / 2)) | (F.col(pos) == F.col("__n") - 1)).drop("__n")


def sample_chapters(count: Column) -> Column:
    """First, middle and last chapter of three or more, else all; repeats stay."""
    return F.when(count >= 3, F.array(F.lit(1), F.floor(count / 2).cast("int"), count.cast("int"))).when(count >= 1, F.sequence(F.lit(1), count.cast("int"))).otherwise(F.array().cast("array<int>"))


def first_pages(found: DataFrame, key: list[str]) -> DataFrame:
    """The first page on which each chapter was found: (key, page)."""
    return found.groupBy(*key).agg(F.min("page").alias("page"))


def interpolate(anchors: DataFrame, extents: DataFrame, book: str = "id", ch: str = "ch", page: str = "page") -> DataFrame:
    """Pages of chapters 1 to ``chapter_count`` of each book: (book, ch, page, anchored).

    Between two anchors the page is on the line through them, rounded half to even; before the first and after the last
    it is that of the nearest one. A book without anchors has null pages.
    """
    wanted = extents.where("chapter_count >= 1").select(book, F.explode(F.sequence(F.lit(1), F.col("chapter_count").cast("int"))).alias(ch))
    rows = wanted.join(anchors.select(book, F.col(ch).cast("int").alias(ch), F.col(page).alias("__p")), [book, ch], "left")
    back = Window.partitionBy(book).orderBy(ch).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(book).orderBy(ch).rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("__p").isNotNull(), F.struct(F.col(ch).alias("c"), F.col("__p").alias("p")))
    both = rows.withColumn("l", F.last(known, True).over(back)).withColumn("r", F.first(known, True).over(ahead))
    between = F.col("l.p") + F.bround((F.col("r.p") - F.col("l.p")) * (F.col(ch) - F.col("l.c")) / (F.col("r.c") - F.col("l.c")), 0).cast("int")
    value = F.when(F.col("__p").isNotNull(), F.col("__p")).when(F.col("l").isNotNull() & F.col("r").isNotNull(), between).otherwise(F.coalesce("l.p", "r.p"))
    return both.select(book, ch, value.cast("int").alias(page), F.col("__p").isNotNull().alias("anchored"))


def interpolate_cumulative(anchors: DataFrame, extents: DataFrame, book: str = "id", ch: str = "ch", page: str = "page", default: str | None = None) -> DataFrame:
    """As ``interpolate``, but a filled chapter serves as the left anchor of the next one.

    A book's anchors are folded in order of chapter; ``default`` names a column of ``extents`` for books without any.
    """
    listed = anchors.groupBy(book).agg(F.array_sort(F.collect_list(F.struct(F.col(ch).cast("int").alias("c"), F.col(page).cast("int").alias("p")))).alias("known"))
    rows = extents.where("chapter_count >= 1").join(listed, book, "left")
    base = F.col(default).cast("int") if default else F.lit(None).cast("int")

    def step(acc: Column, c: Column) -> Column:
        own = F.get(F.filter("known", lambda k: k.c == c), F.lit(0))
        right = F.get(F.filter("known", lambda k: k.c > c), F.lit(0))
        left = F.element_at(acc, -1)
        line = left.p + F.bround((right.p - left.p) * (c - left.c) / (right.c - left.c), 0).cast("int")
        value = F.when(own.isNotNull(), own.p).when(F.size(acc) > 0, F.when(right.isNotNull(), line).otherwise(left.p)).when(right.isNotNull(), right.p).otherwise(base)
        return F.concat(acc, F.array(F.struct(c.alias("c"), value.alias("p"))))

    filled = F.aggregate(F.sequence(F.lit(1), F.col("chapter_count").cast("int")), F.array().cast("array<struct<c:int,p:int>>"), step)
    return rows.select(book, F.inline(filled)).select(book, F.col("c").alias(ch), F.col("p").alias(page))


def chapter_ranges(anchors: DataFrame, starts: DataFrame, book: str = "id", tail: int = 6, cap: int | None = 12) -> DataFrame:
    """Page range of each chapter of ``anchors`` (book, ch, pdf, page): (book, ch, pdf, first, last).

    Up to the page of the next chapter if that lies in the same file, else to the page before the next anchor of any book
    in it (``starts``: pdf, page, next_page), else ``tail`` pages on; these two at most ``cap`` pages on.
    """
    w = Window.partitionBy(book).orderBy("ch")
    step = F.struct("ch", "pdf", "page")
    rows = anchors.withColumn("__n", F.lead(step).over(w)).join(starts, ["pdf", "page"], "left")
    follows = (F.col("__n.ch") == F.col("ch") + 1) & (F.col("__n.pdf") == F.col("pdf"))
    open_end = F.coalesce(F.col("next_page") - 1, F.col("page") + tail)
    if cap is not None:
        open_end = F.least(open_end, F.col("page") + cap)
    return rows.select(book, "ch", "pdf", F.col("page").alias("first"), F.when(F.coalesce(follows, F.lit(False)), F.greatest("page", F.col("__n.page"))).otherwise(open_end).cast("int").alias("last"))


def word_windows(word_list: Column, margin: int = 4, size: int = 8, stride: int = 4) -> Column:
    """Windows of ``size`` words at every ``stride``-th word before the last ``margin``, at least one; the audit's margin is 4, the check's 5."""
    stops = F.greatest(F.lit(1), F.size(word_list) - margin)
    return F.transform(F.sequence(F.lit(0), stops - 1, F.lit(stride)), lambda i: F.array_join(F.slice(word_list, i + 1, F.lit(size)), " "))


def neighbours(rows: DataFrame, ch: str = "ch", count: str = "chapter_count") -> DataFrame:
    """With the chapters before and after, null at the ends of the book."""
    return rows.withColumn("prev_ch", F.when(F.col(ch) > 1, F.col(ch) - 1)).withColumn("next_ch", F.when(F.col(ch) < F.col(count), F.col(ch) + 1))


def take_while(rows: DataFrame, key: list[str], order: str, holds: Column) -> DataFrame:
    """Rows of each group up to the first, after its first row, for which ``holds`` is false.

    The first failing place is a pre-aggregated minimum, joined back.
    """
    first = rows.groupBy(*key).agg(F.min(order).alias("__first"))
    fails = rows.join(first, key).where((F.col(order) > F.col("__first")) & ~F.coalesce(holds, F.lit(False))).groupBy(*key).agg(F.min(order).alias("__stop"))
    return rows.join(fails, key, "left").where(F.col("__stop").isNull() | (F.col(order) < F.col("__stop"))).drop("__stop")
