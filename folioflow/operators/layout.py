"""Page geometry: lines, columns, headers and footnotes out of placed words and characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE, collapse_space

_PAGE = ["pdf", "page"]
_WORD = "struct<top:double,pos:int,x0:double,text:string>"


def cluster_lines(words: Column, tolerance: float = 5.0) -> Column:
    """Texts of the lines of a page's words (array of top, pos, x0, text).

    Words from the top down join the first line whose mean top is within the tolerance, which moves that mean; lines go by
    their mean, the words of a line from left to right, ties by first sight.
    """
    def step(acc: Column, w: Column) -> Column:
        place = F.array_position(F.transform(acc, lambda b: F.abs(w.top - b.total / F.size(b.words)) <= tolerance), F.lit(True))
        grown = F.transform(acc, lambda b, i: F.when(i + 1 == place, F.struct((b.total + w.top).alias("total"), F.concat(b.words, F.array(w)).alias("words"))).otherwise(b))
        return F.when(place > 0, grown).otherwise(F.concat(acc, F.array(F.struct(w.top.alias("total"), F.array(w).alias("words")))))

    buckets = F.aggregate(F.array_sort(words), F.array().cast(f"array<struct<total:double,words:array<{_WORD}>>>"), step)
    ordered = F.array_sort(F.transform(buckets, lambda b, i: F.struct((b.total / F.size(b.words)).alias("mean"), i.alias("i"), b.words.alias("words"))))
    across = lambda ws: F.array_sort(F.transform(ws, lambda w, i: F.struct(w.x0.alias("x0"), i.alias("i"), w.text.alias("text"))))
    return F.transform(ordered, lambda b: F.array_join(F.transform(across(b.words), lambda w: w.text), " "))


def _words(rows: DataFrame, where: Column) -> Column:
    word = F.struct(F.col("top").cast("double").alias("top"), F.col("pos").cast("int").alias("pos"), F.col("x0").cast("double").alias("x0"), "text")
    return F.collect_list(F.when(where, word))


def page_text(words: DataFrame) -> DataFrame:
    """(pdf, page, text) of placed words (pdf, page, pos, text, x0, x1, top, bottom, page_width, page_height).

    Words across the middle in the top 15 % of a page make everything above their lower edge its header. The rest is
    read in two columns, unless these overlap and one has under a fifth of the words. A page is the unit held in one place.
    """
    mid = F.col("page_width") / 2
    spans = (F.col("x0") < mid - 5) & (F.col("x1") > mid + 5) & (F.col("top") < F.col("page_height") * 0.15)
    band = words.groupBy(*_PAGE).agg(F.coalesce(F.max(F.when(spans, F.col("bottom"))), F.lit(0.0)).alias("header_y"), F.max("page_width").alias("__w"))
    rows = words.join(band, _PAGE)
    header = F.col("top") < F.col("header_y") - 0.5
    right = F.col("x0") + (F.col("x1") - F.col("x0")) / 2 >= mid
    sides = rows.groupBy(*_PAGE).agg(
        _words(rows, header).alias("head"), _words(rows, ~header & ~right).alias("l"), _words(rows, ~header & right).alias("r"), _words(rows, ~header).alias("body"),
        F.max(F.when(~header & ~right, F.col("x1"))).alias("left_end"), F.min(F.when(~header & right, F.col("x0"))).alias("right_start"))
    small = (F.size("r") < 0.2 * F.size("body")) | (F.size("l") < 0.2 * F.size("body"))
    apart = (F.size("r") == 0) | (F.size("l") == 0) | (F.col("right_start") >= F.col("left_end") - 5)
    lines = F.when((F.size("body") > 0) & ~apart & small, F.concat(cluster_lines(F.col("head")), cluster_lines(F.col("body")))).otherwise(
        F.concat(cluster_lines(F.col("head")), cluster_lines(F.col("l")), cluster_lines(F.col("r"))))
    return sides.select(*_PAGE, F.array_join(lines, "\n").alias("text"))


def body_size(chars: DataFrame) -> DataFrame:
    """(pdf, page, body_size): the most frequent rounded size of a page, of ties the first seen, of those seen at one position the smallest."""
    counted = chars.groupBy(*_PAGE, F.bround("size", 0).alias("s")).agg(F.count("*").alias("c"), F.min("pos").alias("p"))
    return counted.groupBy(*_PAGE).agg(F.max_by("s", F.struct("c", -F.col("p"), -F.col("s"))).alias("body_size"))


def drop_footnotes(chars: DataFrame) -> DataFrame:
    """Characters of a page but those that are smaller than its body and below it."""
    sized = chars.join(body_size(chars), _PAGE)
    bottom = sized.where(F.abs(F.col("size") - F.col("body_size")) <= 0.7).groupBy(*_PAGE).agg(F.max("bottom").alias("__b"))
    rows = sized.join(bottom, _PAGE, "left")
    return rows.where(~F.coalesce((F.col("size") < F.col("body_size") - 0.7) & (F.col("top") >= F.col("__b") - 1), F.lit(False))).drop("__b", "body_size")


def footnote_chars(chars: DataFrame, size: float = 10.0, margin: float = 0.5) -> DataFrame:
    """Characters of a page that are smaller than the given body size and below the last body line; none of a page without body."""
    bottom = chars.where(F.abs(F.col("size") - size) <= margin).groupBy(*_PAGE).agg(F.max("bottom").alias("__b"))
    return chars.join(bottom, _PAGE).where((F.col("size") < size - margin) & (F.col("top") >= F.col("__b") - 1)).drop("__b")


def footnote_text(chars: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """(pdf, page, text) of footnote characters.

    In order of rounded top and of x0 a character within the tolerance of the line's anchor joins it, and the anchor moves half way to it;
    another begins a line. In a line, from left to right, a gap of more than half a character's width is a space.
    """
    kind = "struct<top:double,x0:double,pos:int,x1:double,width:double,text:string>"
    listed = chars.groupBy(*_PAGE).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.bround("top", 0).alias("k"), F.col("x0"), F.col("pos"), F.struct(
        F.col("top").cast("double").alias("top"), F.col("x0").cast("double").alias("x0"), F.col("pos").cast("int").alias("pos"), F.col("x1").cast("double").alias("x1"), F.col("width").cast("double").alias("width"), "text").alias("c")))), lambda x: x.c).alias("cs"))

    def step(acc: Column, c: Column) -> Column:
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & (F.abs(c.top - last.anchor) <= tolerance)
        more = F.struct(((last.anchor + c.top) / 2).alias("anchor"), F.concat(last.cs, F.array(c)).alias("cs"))
        return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(more))).otherwise(F.concat(acc, F.array(F.struct(c.top.alias("anchor"), F.array(c).alias("cs")))))

    lines = F.aggregate("cs", F.array().cast(f"array<struct<anchor:double,cs:array<{kind}>>>"), step)
    across = lambda cs: F.transform(F.array_sort(F.transform(cs, lambda c, i: F.struct(c.x0.alias("x0"), i.alias("i"), c.alias("c")))), lambda x: x.c)
    spaced = lambda cs: F.array_join(F.transform(cs, lambda c, i: F.when((i > 0) & (c.x0 - F.get(cs, i - 1).x1 > c.width * 0.5), F.concat(F.lit(" "), c.text)).otherwise(c.text)), "")
    text = F.array_join(F.transform(lines, lambda line: F.trim(spaced(across(line.cs)))), "\n")
    return listed.select(*_PAGE, F.regexp_replace(text, r"^\s+|\s+$", "").alias("text"))


_PART = r"[A-Za-z\x{100}-\x{4FF}\x{1E02}-\x{1EFF}'-]+"
_TERM = f"[A-Z]{_PART}"
_COLON = rf"{SPACE}*[:—]{SPACE}+"
NOTE = rf"(?sU)({_TERM}(?:{SPACE}[A-Za-z]{_PART}){{0,3}}){_COLON}([A-Za-z“”'\"].*?)(?=\n{_TERM}{_COLON}[A-Za-z]|\z)"


def split_notes(text: Column) -> Column:
    """Array of (term, body) of ``Term: body`` notes; a body reaches up to the next term at the start of a line."""
    part = lambda k: F.regexp_extract_all(text, F.lit(NOTE), F.lit(k))
    return F.zip_with(part(1), part(2), lambda term, body: F.struct(F.regexp_replace(term, r"(?U)^\s+|\s+$", "").alias("term"), collapse_space(body).alias("body")))


def page_notes(pages: DataFrame, least: int = 50) -> DataFrame:
    """(pdf, page, pos, term, body) of footnote texts of at least ``least`` characters."""
    return pages.where(F.length("text") >= least).select(*_PAGE, F.posexplode(split_notes(F.col("text"))).alias("pos", "note")).select(*_PAGE, "pos", "note.*")
