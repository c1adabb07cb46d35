"""Chapter anchors: where chapters begin, found in page texts and completed by interpolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import DIGIT, SPACE, from_roman, normalize_heading
from .windows import first_pages, interpolate, interpolate_cumulative

_CAPITAL = r"A-Z\x{C0}-\x{FFFF}"


def find_chapters(pages: DataFrame, pattern: str | Column, value: Column | None = None, skip: int = 0, confirm: str | None = None, window: int = 200) -> DataFrame:
    """(id, ch, page) of every heading in ``pages`` (id, page, text): the first group of the pattern, or what ``value`` makes of the column ``found``.

    ``skip`` leaves out that many pages at the start; ``confirm`` must match within the ``window`` characters after the heading.
    """
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    after = F.slice(F.split("text", p, -1), F.lit(2), F.size(F.regexp_extract_all("text", p, F.lit(0))))
    # The text after a heading goes on over the headings behind it.
    heads = F.concat(F.slice(F.regexp_extract_all("text", p, F.lit(0)), F.lit(2), F.greatest(F.size(F.regexp_extract_all("text", p, F.lit(0))) - 1, F.lit(0))), F.array(F.lit("")))
    tail = F.transform(after, lambda t, i: F.concat(t, F.get(heads, i), F.coalesce(F.get(after, i + 1), F.lit(""))))
    rows = pages.where(F.col("page") > skip).select("id", "page", F.inline(F.zip_with(F.regexp_extract_all("text", p, F.lit(1)), tail, lambda f, t: F.struct(f.alias("found"), F.substring(t, 1, window).alias("tail")))))
    if confirm is not None:
        rows = rows.where(F.col("tail").rlike(confirm))
    return rows.select("id", (F.col("found").try_cast("int") if value is None else value).alias("ch"), "page").where("ch IS NOT NULL")


def bounded(found: DataFrame, extents: DataFrame) -> DataFrame:
    """First page of each chapter that the book has, by ``extents`` (id, chapter_count)."""
    return first_pages(found.join(extents.select("id", "chapter_count"), "id").where(F.col("ch").between(1, F.col("chapter_count"))), ["id", "ch"])


def numbered_anchors(pages: DataFrame, extents: DataFrame, pattern: str = r"(?U)Chapter\s+(\d+)") -> DataFrame:
    """Anchors at ``Chapter N`` headings, completed between fixed anchors: (id, ch, page, anchored)."""
    return interpolate(bounded(find_chapters(pages, pattern), extents), extents)


def roman_anchors(pages: DataFrame, extents: DataFrame, pattern: str = rf"(?U)(?:^|\n){SPACE}*([CILVX]+){SPACE}*\n", skip: int = 6, confirm: str = f"(?U)^{SPACE}*1{SPACE}+[A-Z“\"']") -> DataFrame:
    """Anchors at Roman headings after the contents pages that verse 1 follows."""
    return interpolate(bounded(find_chapters(pages, pattern, from_roman(F.col("found")), skip, confirm), extents), extents)


def body_anchors(pages: DataFrame, extents: DataFrame) -> DataFrame:
    """Anchors of the primary layout, completed cumulatively: (id, ch, page).

    ``extents`` has id, match_name, start, last and chapter_count. Chapter 1 begins at the start. The first page's banner may name its chapter; on all pages a
    number alone on its line before a capital begins a chapter, except on the first line.
    """
    own = pages.join(extents.select("id", "match_name", "start", "last", "chapter_count"), "id").where(F.col("page").between(F.col("start"), F.col("last")))
    body = F.when(F.contains(F.col("text"), F.lit("\n")), F.expr("substring(text, locate('\n', text) + 1)")).otherwise(F.col("text"))
    starts = find_chapters(own.withColumn("text", body).select("id", "page", "text"), rf"(?U)(?:^|\n){SPACE}*({DIGIT}+){SPACE}*\n{SPACE}*(?=[{_CAPITAL}\"“‘'])")
    name = normalize_heading(F.col("match_name"))
    quoted = lambda c: F.concat(F.lit("\\Q"), c, F.lit("\\E"))
    head = normalize_heading(F.substring("text", 1, 200))
    spaced, tight = (F.call_function("regexp_extract", head, F.concat(F.lit("(?U)"), quoted(n), F.lit(rest)), F.lit(1)) for n, rest in ((name, r"\s+(\d+)"), (F.replace(name, F.lit(" "), F.lit("")), r"\s*(\d+)")))
    banner = own.where("page = start").select("id", F.when(spaced != "", spaced).otherwise(tight).try_cast("int").alias("ch"), F.col("start").alias("page")).where("ch > 1")
    first = extents.select("id", F.lit(1).alias("ch"), F.col("start").alias("page"))
    # Chapter 1 and the banner's chapter come before any later find.
    ranked = first.withColumn("r", F.lit(0)).unionByName(banner.withColumn("r", F.lit(0))).unionByName(starts.withColumn("r", F.lit(1)))
    kept = ranked.join(extents.select("id", "chapter_count"), "id").where(F.col("ch").between(1, F.col("chapter_count"))).groupBy("id", "ch").agg(F.min_by("page", F.struct("r", "page")).alias("page"))
    return interpolate_cumulative(kept, extents, default="start")


def opener_pages(pages: DataFrame, pattern: str = rf"(?U)1{SPACE}+1[,\s]*{DIGIT}*{SPACE}+The copy of") -> DataFrame:
    """(page) on which a text of the collection opens."""
    return pages.where(F.col("text").rlike(pattern)).select("page").distinct()


def offset_pages(anchors: DataFrame, offset: int, last: Column | None = None) -> DataFrame:
    """Anchors by printed page with the page of the file, that many pages on and at most ``last``."""
    page = F.col("printed") + offset
    return anchors.withColumn("page", (page if last is None else F.least(page, last)).cast("int"))
