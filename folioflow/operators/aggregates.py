"""Corpus statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_tokens


def token_frequency(texts: DataFrame, text: str = "text") -> DataFrame:
    """(token, freq) of lower-cased ASCII words outside tags."""
    return texts.select(F.explode(ascii_tokens(F.col(text))).alias("token")).groupBy("token").agg(F.count("*").alias("freq"))


def count_by(rows: DataFrame, key: str = "id", name: str = "n_verses") -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias(name))


#: Bytes of a table's files, as far as its columns are read, whose groups are a task's share.
SHARE = 2 << 20


def shares(rows: DataFrame, key: list[str], share: int = SHARE) -> DataFrame:
    """``rows`` dealt out by ``key`` over tasks as many as their size asks for (up to 32,768), whatever the session's number; a task's memory doesn't grow with the table."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(min(max(1, -(-size // share)), 1 << 15), *key)


def first_mode(rows: DataFrame, key: list[str], value: Column, pos: list[str]) -> DataFrame:
    """The most frequent value of each group, of ties the one that comes first by ``pos``: (key, mode)."""
    own = shares(rows.select(*key, *pos, value.alias("__v")), key)
    counted = own.groupBy(*key, "__v").agg(F.count("*").alias("__c"), F.min(F.struct(*pos)).alias("__p"))
    return counted.groupBy(*key).agg(F.min_by("__v", F.struct(-F.col("__c"), "__p")).alias("mode"))


def first_examples(rows: DataFrame, key: str, value: str, pos: str, top: int = 20) -> DataFrame:
    """(key, value): the first value of each key; the ``top`` longest of them, in order of first sight within a length."""
    seen = rows.groupBy(key).agg(F.min_by(value, pos).alias(value), F.min(pos).alias("__p"))
    return seen.orderBy(F.length(value).desc(), "__p").limit(top).drop("__p")


def sorted_set(rows: DataFrame, key: str, value: str) -> DataFrame:
    return rows.groupBy(key).agg(F.sort_array(F.collect_set(value)).alias(f"{value}s"))


def keep_first(rows: DataFrame, keys: list[Column], pos: Column) -> DataFrame:
    """The first row by ``pos`` of each key; a minimum of structs, so partial results are combined before the shuffle."""
    named = [k.alias(f"__k{i}") for i, k in enumerate(keys)]
    kept = rows.groupBy(*named).agg(F.min_by(F.struct(*rows.columns), pos).alias("__r"))
    return kept.select("__r.*")


def keep_first_note(notes: DataFrame, order: Column) -> DataFrame:
    """Notes without later ones of the same term (letters lowered) and first 80 characters of the body."""
    return keep_first(notes, [F.lower("term"), F.substring("body", 1, 80)], order)


def concat_ordered(rows: DataFrame, key: list[str], pos: str, text: str, separator: str = "\n") -> DataFrame:
    """The texts of each group in order, joined."""
    return rows.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(text).alias("t")))), lambda x: x.t), separator).alias(text))


def recovery(counted: Column, expected: Column) -> Column:
    """Percentage of what was expected, to one decimal, half to even; null without an expectation."""
    return F.when(expected > 0, F.bround(counted / expected * 100, 1))


def recovery_issue(counted: Column, expected: Column, least: float = 0.7) -> Column:
    return F.when((expected > 0) & (counted / expected < least), F.format_string("recovery %d%% below %d%%", F.bround(counted / expected * 100, 0).cast("int"), F.lit(round(least * 100))))


def by_section(books: DataFrame, sections: DataFrame) -> DataFrame:
    """Books by section in the sections' order; empty sections don't appear: (ord, label, books)."""
    return books.join(F.broadcast(sections), books["section"] == sections["key"]).groupBy("ord", "label").agg(F.count("*").alias("books")).orderBy("ord")


def section_rank(books: DataFrame, sections: DataFrame, order: str) -> DataFrame:
    """Books with their place within their section."""
    return books.join(F.broadcast(sections), books["section"] == sections["key"]).withColumn("place", F.row_number().over(Window.partitionBy("ord").orderBy(order)))


def issues(parts: list[tuple[Column, str, Column | None]]) -> Column:
    """Texts of the parts (number, text after it, list to show the first five of) whose number isn't 0."""
    out = []
    for number, text, shown in parts:
        line = F.concat(number.cast("string"), F.lit(f" {text}"))
        if shown is not None:
            line = F.concat(line, F.lit(": ["), F.array_join(F.transform(F.slice(shown, 1, 5), lambda x: x.cast("string")), ", "), F.lit("]"))
        out.append(F.when(number > 0, line))
    return F.array_compact(F.array(*out))


def first_values(rows: DataFrame, key: list[str], value: str, top: int = 5) -> DataFrame:
    """(key, n, values): how many rows each key has and its ``top`` least values, of which no more are gathered."""
    ranked = rows.withColumn("__k", F.row_number().over(Window.partitionBy(*key).orderBy(value))).where(F.col("__k") <= top)
    return rows.groupBy(*key).agg(F.count("*").cast("int").alias("n")).join(ranked.groupBy(*key).agg(F.array_sort(F.collect_list(value)).alias("values")), key, "left")


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All rows of all frames, repeats included."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def extend_dictionary(dictionary: DataFrame, more: DataFrame) -> DataFrame:
    return dictionary.select(F.lower("word").alias("word")).unionByName(more.select(F.lower("word").alias("word"))).distinct()
