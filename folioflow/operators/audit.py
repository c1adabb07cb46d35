"""Audits of an extracted corpus against its index and its pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_match, words
from . import aggregates, windows


def _ranges(anchors: DataFrame) -> DataFrame:
    """Page range of each chapter: to the next chapter's page in the same file, else five pages on."""
    starts = anchors.select("pdf", "page").distinct().withColumn("next_page", F.lit(None).cast("int"))
    return windows.chapter_ranges(anchors.select("id", "ch", "pdf", "page"), starts, tail=5, cap=None)


def _sampled(verses: DataFrame, ranges: DataFrame) -> DataFrame:
    return windows.sample_rows(verses.select("id", "ch", "pos", "n", "t"), ["id", "ch"]).join(ranges, ["id", "ch"])


def _not_found(sampled: DataFrame, page_texts: list[DataFrame], margin: int, short: bool) -> DataFrame:
    """Sampled verses none of whose word windows is in the joined text of their pages, in any of the readings (pdf, page, text)."""
    # The words are a column of their own, or each window would normalize the text again; so would a filter on the windows, which is pushed down into them.
    w = F.col("__w")
    wins = F.when(F.size(w) >= 4, windows.word_windows(w, margin))
    wins = wins.when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>")) if short else wins
    tried = sampled.withColumn("__w", words(F.col("t"))).withColumn("wins", wins).drop("__w")
    wanted = sampled.select("pdf", "first", "last").distinct().select("pdf", "first", "last", F.explode(F.sequence("first", F.greatest("first", "last"))).alias("page"))
    found = F.lit(False)
    for k, pages in enumerate(page_texts):
        joined = wanted.join(pages.select("pdf", "page", "text"), ["pdf", "page"]).groupBy("pdf", "first", "last").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p.text), "\n").alias("text"))
        tried = tried.join(joined.select("pdf", "first", "last", normalize_match(F.col("text")).alias(f"hay{k}")), ["pdf", "first", "last"], "left")
        found = found | _any_in(F.col(f"hay{k}"))
    # Null windows are those of texts left out.
    return tried.where(~F.coalesce(found, F.lit(True))).select("id", "ch", "n", "t", "pdf", "first", "last")


def _any_in(hay: Column) -> Column:
    return F.exists("wins", lambda x: F.contains(F.coalesce(hay, F.lit("")), x))


def audit_books(books_meta: DataFrame, chapters: DataFrame, verses: DataFrame, anchors: DataFrame, page_texts: list[DataFrame]) -> DataFrame:
    """One row a book of the index: counts, empty chapters, first gaps, sampled verses that their pages don't hold, issues and status.

    ``books_meta`` (id, hebrew, english, section, chapter_count) lists the index, ``chapters`` (id, ch, verses) and ``verses`` the texts; a book without
    chapters is MISSING.
    """
    totals = verses.groupBy("id").agg(F.count("*").alias("verse_total"))
    empty = chapters.groupBy("id").agg(F.array_sort(F.collect_list(F.when(F.coalesce(F.size("verses"), F.lit(0)) <= 0, F.col("ch")))).alias("no_verses"))
    gaps = windows.first_gap(verses, ["id", "ch"]).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ch", "got", "expected"))).alias("gaps"))
    lost = _not_found(_sampled(verses, _ranges(anchors)), page_texts, margin=4, short=True).groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("ch", "n", F.substring("t", 1, 100).alias("text"), "pdf", "first", "last"))).alias("missing_text"))
    rows = books_meta.join(empty, "id", "left").join(totals, "id", "left").join(gaps, "id", "left").join(lost, "id", "left")
    there = F.col("no_verses").isNotNull()
    filled = rows.withColumn("there", there)
    for c, kind in (("no_verses", "array<int>"), ("gaps", "array<struct<ch:int,got:int,expected:int>>"), ("missing_text", "array<struct<ch:int,n:int,text:string,pdf:string,first:int,last:int>>")):
        filled = filled.withColumn(c, F.coalesce(F.col(c), F.array().cast(kind)))
    issues = F.when(F.col("there"), aggregates.issues([
        (F.size("no_verses"), "chapter(s) with NO verses", F.col("no_verses")), (F.size("gaps"), "chapter(s) with verse-number gaps", None), (F.size("missing_text"), "sampled verse(s) NOT FOUND in PDF", None),
    ])).otherwise(F.array(F.lit("no JSON file")))
    status = F.when(~F.col("there"), "MISSING").when(F.size("issues") == 0, "OK").otherwise("ISSUES")
    return filled.withColumn("verse_total", F.coalesce("verse_total", F.lit(0))).withColumn("issues", issues).withColumn("status", status).drop("there")


def check_books(books_meta: DataFrame, verses: DataFrame, chapters: DataFrame, expected: DataFrame, pages: DataFrame) -> DataFrame:
    """One row a book: extracted and expected verses, recovery in percent, gaps, sampled verses not found, errors and status.

    Chapters 1, middle and last of a book of three or more are sampled; verses of fewer than four words are left out. Chapter pages come from the texts.
    """
    totals = verses.groupBy("id").agg(F.count("*").alias("extracted_verses"))
    gaps = windows.first_gap(verses, ["id", "ch"]).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ch", "got", "expected"))).alias("gaps"))
    sampled = books_meta.select("id", F.explode(F.array_distinct(windows.sample_chapters(F.col("chapter_count")))).alias("ch"))
    own = verses.join(sampled, ["id", "ch"], "left_semi")
    lost = _not_found(_sampled(own, _ranges(chapters.select("id", "ch", "pdf", "page"))), [pages], margin=5, short=False).groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("ch", "n", F.substring("t", 1, 120).alias("text")))).alias("missing_in_pdf"))
    present = chapters.select("id").distinct().withColumn("there", F.lit(True))
    rows = books_meta.join(present, "id", "left").join(totals, "id", "left").join(expected.select("id", F.col("expected").alias("expected_verses")), "id", "left").join(gaps, "id", "left").join(lost, "id", "left")
    total, due = F.coalesce("extracted_verses", F.lit(0)), F.col("expected_verses")
    none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind))
    errors = F.array_compact(F.concat(F.array(aggregates.recovery_issue(total, due)), aggregates.issues([
        (F.size("gaps"), "chapter(s) with verse-number gaps", None), (F.size("missing_in_pdf"), "sampled verse(s) not found in PDF", None)])))
    return (rows.withColumn("extracted_verses", total).withColumn("gaps", none("gaps", "array<struct<ch:int,got:int,expected:int>>")).withColumn("missing_in_pdf", none("missing_in_pdf", "array<struct<ch:int,n:int,text:string>>"))
            .withColumn("recovery", aggregates.recovery(total, due)).withColumn("errors", F.when(F.col("there"), errors).otherwise(F.array(F.lit("no JSON file"))))
            .withColumn("status", F.when(F.col("there").isNull(), "MISSING").when(F.size("errors") == 0, "OK").otherwise("ISSUES")).drop("there"))


def containing(needle: Column, hay: Column, margin: int = 4) -> Column:
    """Whether a text normalized for matching holds one of the needle's word windows; of fewer than four words all of them, of none never."""
    w = words(needle)
    wins = F.when(F.size(w) >= 4, windows.word_windows(w, margin)).when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))
    return F.exists(wins, lambda x: F.contains(normalize_match(hay), x))
