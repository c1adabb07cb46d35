"""Filters and point lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bare_upper


def by_id(rows: DataFrame, value: str, key: str = "id") -> DataFrame:
    return rows.where(F.col(key) == value).limit(1)


def search(rows: DataFrame, query: str | None, columns: list[str]) -> DataFrame:
    """Rows of which a column holds the trimmed query, whatever the case; an empty query takes all."""
    wanted = (query or "").strip().lower()
    if not wanted:
        return rows
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.contains(F.lower(c), F.lit(wanted)), F.lit(False))
    return rows.where(found)


def chapter_of(chapters: Column, ch: Column) -> Column:
    """The chapter of a number in a map by text keys, null where there is none."""
    return F.try_element_at(chapters, ch.cast("string"))


def id_contains(rows: DataFrame, part: str | None, key: str = "id") -> DataFrame:
    return rows.where(F.contains(F.col(key), F.lit(part))) if part else rows


def in_pages(rows: DataFrame, first: Column, last: Column, page: str = "page") -> DataFrame:
    return rows.where(F.col(page).between(first, last))


def banner_tokens(*names: Column) -> Column:
    """The capitalized words of three or more letters in a book's names, without apostrophes, in capitals."""
    found = [F.regexp_extract_all(F.coalesce(n, F.lit("")), F.lit("[A-Z][A-Za-z'’\\x{C0}-\\x{24F}\\x{1E00}-\\x{1EFF}]{2,}"), F.lit(0)) for n in names]
    return F.array_distinct(F.transform(F.concat(*found), bare_upper))


def banner_holds(page_text: Column, tokens: Column) -> Column:
    """Whether one of the first three lines of a page holds a token; with no tokens every page does."""
    head = bare_upper(F.substring_index(page_text, "\n", 3))
    return (F.size(tokens) == 0) | F.exists(tokens, lambda t: F.contains(head, t))


def substantial_notes(notes: DataFrame, stop: tuple[str, ...] = ("And", "But", "For", "Now", "See", "Then", "When"), least_term: int = 3, least_body: int = 30) -> DataFrame:
    return notes.where((F.length("term") >= least_term) & ~F.col("term").isin(*stop) & (F.length("body") >= least_body))


def non_blank(rows: DataFrame, text: str = "t") -> DataFrame:
    return rows.where(F.trim(F.coalesce(text, F.lit(""))) != "")
