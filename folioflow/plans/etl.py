"""The batch stages from page texts to a repaired corpus, and the reading path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape_markup, is_prose
from ..operators import filters, joins, layout, repair, segment, translit, windows
from ..sources import corpus
from ..sources.pdf import page_range_text

#: Layout of a book's chapters, by section or id.
GRAMMARS = ("primary", "enoch", "jasher", "adam-eve-1", "adam-eve-2", "clement", "colon", "apocrypha", "testament")
#: The file of the Testaments and their names in it, by book.
TESTAMENT_FILE = "THE TESTAMENTS OF THE TWELVE PATRIARCHS.pdf"
TESTAMENT_NAMES = {"testament-reuben": "reuben", "testament-shimeon": "simeon", "testament-levi": "levi", "testament-yahudah": "judah", "testament-issakar": "issachar", "testament-zebulun": "zebulun",
                   "testament-dan": "dan", "testament-naphtali": "naphtali", "testament-gad": "gad", "testament-asher": "asher", "testament-yoseph": "joseph", "testament-benyamin": "benjamin"}


def chapter_verses(grammar: Column, text: Column, chapter: Column) -> Column:
    """The verses of a chapter's text in the layout of its book; null for an unknown layout, and for the Testaments, whose chapters are cut all at once."""
    apocrypha = segment.apocrypha_chapter(text, chapter, grammar)
    return (F.when(grammar == "primary", segment.primary_chapter(text, chapter)).when(grammar == "enoch", segment.enoch_chapter(text, chapter))
            .when(grammar == "jasher", segment.jasher_chapter(text, chapter))
            .when(grammar.startswith("adam-eve-"), segment.adam_eve_chapter(text, chapter, grammar == "adam-eve-2"))
            .when(grammar.isin("clement", "colon", "apocrypha"), apocrypha))


def book_pages(pages: DataFrame, ranges: DataFrame, names: DataFrame) -> DataFrame:
    """Pages of each chapter up to the first that no longer shows the book's name: (id, ch, page, text)."""
    wanted = ranges.select("id", "ch", "pdf", F.explode(F.sequence("first", F.greatest("first", "last"))).alias("page")).join(pages, ["pdf", "page"]).join(
        names.select("id", filters.banner_tokens(F.col("hebrew"), F.col("english")).alias("tokens")), "id")
    return windows.take_while(wanted, ["id", "ch"], "page", filters.banner_holds(F.col("text"), F.col("tokens"))).select("id", "ch", "page", "text")


def testaments(pages: DataFrame, anchors: DataFrame, grammars: DataFrame, names: dict[str, str] = TESTAMENT_NAMES, file: str = TESTAMENT_FILE) -> DataFrame:
    """(id, ch, verses, page, pdf) of every chapter of the books of ``grammars`` in the layout ``testament``.

    Each book is cut out of the whole text of its file by ``names``; all its chapters have the page of its first anchor, or page
    1 of ``file`` without one. A book whose name doesn't occur there has no chapters.
    """
    known = pages.sparkSession.createDataFrame([*names.items()], "id string, name string")
    first = anchors.where("ch = 1").select("id", "page", "pdf")
    books = grammars.where("grammar = 'testament'").select("id").join(known, "id").join(first, "id", "left").select(
        "id", "name", F.coalesce("page", F.lit(1)).alias("page"), F.coalesce("pdf", F.lit(file)).alias("pdf"))
    text = F.coalesce(segment.strip_testament_page(F.col("text")), F.lit(""))
    whole = pages.join(books.select("pdf").distinct(), "pdf").groupBy("pdf").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", text.alias("t")))), lambda p: p.t), "\n").alias("text"))
    slices = whole.select("pdf", F.explode(segment.testament_slices(F.col("text"), stripped=True)).alias("s")).select("pdf", "s.name", "s.text")
    found = books.join(slices, ["pdf", "name"]).select("id", F.explode(segment.testament_chapters(F.col("text"))).alias("c"), "page", "pdf")
    return found.select("id", "c.ch", "c.verses", "page", "pdf")


def reindex(index: DataFrame, anchors: DataFrame, chapters: DataFrame, grammars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``index`` (id, chapter_count, and more) and ``anchors`` with the extracted ``chapters`` of the Testaments; a book without any counts as one chapter and keeps its anchors."""
    books = grammars.where("grammar = 'testament'").select("id")
    found = chapters.join(books, "id", "left_semi")
    counts = books.join(found.groupBy("id").agg(F.count("*").cast("int").alias("__n")), "id", "left").select("id", F.coalesce("__n", F.lit(1)).alias("__n"))
    counted = index.join(counts, "id", "left").withColumn("chapter_count", F.coalesce("__n", "chapter_count")).select(*index.columns)
    listed = anchors.select("id", "ch", "pdf", "page").join(found.select("id").distinct(), "id", "left_anti")
    return counted, listed.unionByName(found.select("id", "ch", "pdf", "page"))


def extract(pages: DataFrame, anchors: DataFrame, grammars: DataFrame) -> DataFrame:
    """(id, ch, verses, page, pdf) of every anchored chapter of ``anchors`` (id, ch, pdf, page), by ``grammars`` (id, grammar, hebrew, english); of the Testaments all chapters found."""
    ranges = windows.chapter_ranges(anchors, joins.next_start(anchors))
    key = F.struct("id", "ch")
    plain = page_range_text(pages, ranges.withColumn("key", key)).select("key.id", "key.ch", "text")
    banner = book_pages(pages, ranges, grammars.where("grammar = 'primary'"))
    primary = banner.groupBy("id", "ch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", segment.strip_headers(F.col("text")).alias("t")))), lambda p: p.t), "\n").alias("own"))
    rows = anchors.join(grammars.select("id", "grammar"), "id", "left").where("NOT grammar <=> 'testament'").join(plain, ["id", "ch"], "left").join(primary, ["id", "ch"], "left")
    text = F.when(F.col("grammar") == "primary", F.coalesce("own", F.lit(""))).when(F.col("grammar").isin("clement", "colon", "apocrypha"), segment.strip_apocrypha_page(F.coalesce("text", F.lit("")))).otherwise(F.coalesce("text", F.lit("")))
    single = rows.select("id", "ch", F.coalesce(chapter_verses(F.col("grammar"), text, F.col("ch")), F.array().cast(segment.SPANS)).alias("verses"), "page", "pdf")
    return single.unionByName(testaments(pages, anchors, grammars))


def notes(chars: DataFrame, anchors: DataFrame, files: list[tuple[str, int]], buckets: int = 32) -> DataFrame:
    """Distinct footnotes with the book and chapter that their page belongs to; ``anchors`` has ord, id, hebrew, ch, printed. ``buckets``: parts of the range of pages."""
    from ..operators.aggregates import keep_first_note

    found = filters.substantial_notes(layout.page_notes(layout.footnote_text(layout.footnote_chars(chars))))
    placed = found.withColumn("printed_page", joins.printed_page(F.col("pdf"), F.col("page"), files))
    known = joins.asof_backward(placed, anchors.select("ord", "id", "hebrew", "ch", "printed"), "printed_page", "printed", "ord", buckets=buckets)
    rows = known.select("term", "body", F.col("printed_page").alias("page"), "pdf", "pos", F.col("match.id").alias("book_id"), F.col("match.hebrew").alias("book"), F.col("match.ch").alias("chapter"))
    return keep_first_note(rows, F.struct("page", "pos")).drop("pos")


def refine(verses: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Verses transliterated, then repaired; the order of the two matters."""
    keyed = verses.withColumn("t", translit.transliterate(F.col("t"))).withColumn("key", F.concat_ws("/", "id", "ch", "pos"))
    return repair.fix_text(keyed, "key", "t", dictionary).drop("key")


def read_chapter(books: DataFrame, book: str, ch: int) -> DataFrame:
    """A chapter as its page shows it: (id, ch, n, html, is_prose, prev_ch, next_ch)."""
    own = books.where(F.col("id") == book).select("id", "chapter_count", filters.chapter_of(F.col("chapters"), F.lit(ch)).alias("c")).where("c IS NOT NULL").withColumn("ch", F.lit(ch))
    rows = windows.neighbours(own).withColumn("is_prose", is_prose(F.col("c.verses")))
    return rows.select("id", "ch", "prev_ch", "next_ch", "is_prose", F.posexplode("c.verses").alias("pos", "v")).select("id", "ch", "v.n", escape_markup(F.col("v.t")).alias("html"), "is_prose", "prev_ch", "next_ch")


def flat(books: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chapters, verses) of nested books."""
    return corpus.chapters(books), corpus.verses(books)
