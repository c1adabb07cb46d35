"""Scans and sinks of the book corpus: nested JSON outside, flat DataFrames inside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSES = "array<struct<n:int,t:string>>"
BOOK_SCHEMA = f"id string, hebrew string, english string, section string, chapter_count int, chapters map<string,struct<verses:{VERSES},page:int,pdf:string>>"
ANCHOR = "struct<pdf:string,page:int,printed:int>"
INDEX_SCHEMA = f"books array<struct<id:string,hebrew:string,english:string,section:string,chapter_count:int,chapters:map<string,{ANCHOR}>>>"


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """One row a book, by id. The schema is given: inferred, chapters would be a struct with a field a number."""
    return spark.read.schema(BOOK_SCHEMA).option("multiLine", True).json(path).orderBy("id")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """One row a book of the index, with ``ord``, its place in the list."""
    rows = spark.read.schema(INDEX_SCHEMA).option("multiLine", True).json(path)
    return rows.select(F.posexplode("books").alias("ord", "b")).select("ord", "b.*")


def chapters(books: DataFrame) -> DataFrame:
    """(id, ch, verses, page, pdf); keys that aren't numbers are left out."""
    return (books.select("id", F.explode("chapters").alias("key", "c")).select("id", F.col("key").try_cast("int").alias("ch"), "c.verses", "c.page", "c.pdf")
            .where("ch IS NOT NULL"))


def verses(books: DataFrame) -> DataFrame:
    """(id, ch, pos, n, t, page, pdf); pos is the place in the list, from 0."""
    return chapters(books).select("id", "ch", "page", "pdf", F.posexplode("verses").alias("pos", "v")).select("id", "ch", "pos", "v.n", "v.t", "page", "pdf")


def anchors(index: DataFrame) -> DataFrame:
    """(ord, id, hebrew, section, ch, pdf, page, printed) of every chapter of the index; ``ord`` counts anchors in list order."""
    flat = index.select(F.col("ord").alias("book_ord"), "id", "hebrew", "section", F.explode("chapters").alias("key", "a")).select(
        "book_ord", "id", "hebrew", "section", F.col("key").try_cast("int").alias("ch"), "a.pdf", "a.page", "a.printed")
    return flat.withColumn("ord", F.struct("book_ord", "ch")).drop("book_ord")


def nest(verse_rows: DataFrame, meta: DataFrame) -> DataFrame:
    """Books again, of ``verses`` rows and (id, hebrew, english, section, chapter_count)."""
    by_chapter = verse_rows.groupBy("id", "ch").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "n", "t"))), lambda v: F.struct(v.n.alias("n"), v.t.alias("t"))).alias("verses"), F.first("page").alias("page"), F.first("pdf").alias("pdf"))
    by_book = by_chapter.groupBy("id").agg(F.map_from_entries(F.transform(
        F.array_sort(F.collect_list(F.struct("ch", "verses", "page", "pdf"))),
        lambda c: F.struct(c.ch.cast("string").alias("key"), F.struct(c.verses.alias("verses"), c.page.alias("page"), c.pdf.alias("pdf")).alias("value")))).alias("chapters"))
    return meta.join(by_book, "id", "left").select("id", "hebrew", "english", "section", "chapter_count", "chapters")


def write_books(books: DataFrame, path: str) -> None:
    """One folder a book, JSON."""
    books.withColumn("book", F.col("id")).repartition("book").write.mode("overwrite").partitionBy("book").json(path)


def write_index(books: DataFrame, path: str) -> None:
    """One row with the list of books in order of ``ord``."""
    cols = ["id", "hebrew", "english", "section", "chapter_count", "chapters"]
    books.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.to_json(F.struct(*cols)).alias("j")))), lambda b: b.j).alias("rows")).select(
        F.concat(F.lit('{"books":['), F.array_join("rows", ","), F.lit("]}")).alias("value")).write.mode("overwrite").text(path)


def changed(old: DataFrame, new: DataFrame, key: list[str], value: str) -> DataFrame:
    """Rows of ``new`` whose value isn't that of the row of ``old`` with the same key."""
    before = old.select(*key, F.col(value).alias("__old"))
    return new.join(before, key, "left").where(~F.col(value).eqNullSafe(F.col("__old"))).drop("__old")


def rewrite_changed(spark: SparkSession, old: DataFrame, new: DataFrame, path: str, key: list[str], value: str, partition: str) -> None:
    """Overwrites only the partitions in which a value changed."""
    touched = changed(old, new, key, value).select(partition).distinct()
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        new.join(touched, partition, "left_semi").write.mode("overwrite").partitionBy(partition).parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def write_notes(notes: DataFrame, path: str) -> None:
    notes.write.mode("overwrite").json(path)


def missing_files(index: DataFrame, books: DataFrame) -> DataFrame:
    """Books of the index without a text."""
    return index.join(books.select("id"), "id", "left_anti")
