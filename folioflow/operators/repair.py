"""Repair of words broken or fused by extraction, by a dictionary and corpus frequencies.

Both are tables, joined to the words that the texts ask about; neither is sent whole to the tasks.
"""

from __future__ import annotations

import re
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables
from ..functions.text import initial_like, normalize_citation
from ..sources.shared import release, written
from .aggregates import token_frequency
from .translit import map_matches

_TOKENS = re.compile("<[^>]+>|[A-Za-z]+|[^A-Za-z<]+|<")
_TITLED = re.compile("[A-Z][a-z]*")
#: Before a word: that it isn't one that always stands alone; by first letter, so that few are tried.
_NO_STOP = "(?!(?i:" + "|".join(f"{c}(?:{'|'.join(w[1:] for w in group)})" for c, group in groupby(sorted(tables.STOP_GLUE), lambda w: w[0])) + ")(?![A-Za-z]))"
_BREAK = r"(?U)<[^>]+>|\b[A-Za-z]{2,}-\s+[a-z][a-z]{1,15}\b"
_SUFFIXES = tuple("ed er es ied ies ing ly s".split())
#: Pieces of a word that are looked up at once; words of more pieces take a further look-up each.
PIECES = 3


def stems(word: Column) -> Column:
    """The dictionary forms that make a lower-cased word English: itself, and what its inflections leave."""
    out = [word]
    for suffix in _SUFFIXES:
        fits = word.endswith(suffix) & (F.length(word) > len(suffix) + 1)
        stem = F.substring(word, F.lit(1), F.length(word) - len(suffix))
        out.append(F.when(fits, stem))
        if suffix in ("ies", "ied"):
            out.append(F.when(fits, F.concat(stem, F.lit("y"))))
        if suffix in ("ing", "ed"):
            out.append(F.when(fits, F.concat(stem, F.lit("e"))))
            doubled = (F.length(stem) >= 2) & (F.substring(stem, -1, 1) == F.substring(stem, -2, 1))
            out.append(F.when(fits & doubled, F.substring(stem, F.lit(1), F.length(stem) - 1)))
    return F.array_distinct(F.array_compact(F.array(*out)))


def english_words(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(word, direct) of the distinct lower-cased ``words`` that are English: in the dictionary themselves, or inflections of what is."""
    asked = words.select("word").distinct().where(F.col("word").rlike(r"^\p{L}+$"))
    known = dictionary.select(F.lower("word").alias("stem")).distinct()
    return asked.select("word", F.explode(stems(F.col("word"))).alias("stem")).join(known, "stem").groupBy("word").agg((F.max((F.col("word") == F.col("stem")).cast("int")) == 1).alias("direct"))


def word_facts(words: DataFrame, dictionary: DataFrame, frequency: DataFrame) -> DataFrame:
    """(word, direct, english, freq) of the distinct lower-cased ``words`` (word)."""
    asked = words.select("word").distinct()
    return asked.join(english_words(asked, dictionary), "word", "left").join(frequency.select(F.col("token").alias("word"), "freq"), "word", "left").select(
        "word", F.coalesce("direct", F.lit(False)).alias("direct"), F.col("direct").isNotNull().alias("english"), F.coalesce("freq", F.lit(0)).alias("freq"))


_FACTS = "map<string,struct<direct:boolean,english:boolean,freq:bigint>>"


def _with_facts(texts: DataFrame, key: str, asked: DataFrame, dictionary: DataFrame, frequency: DataFrame) -> DataFrame:
    """``texts`` with ``facts``, a map of the words each asks about (``asked``: __id, word) that the dictionary or the corpus knows."""
    facts = word_facts(asked.select("word"), dictionary, frequency).where("english OR freq > 0")
    by = asked.distinct().join(facts, "word").groupBy("__id").agg(F.map_from_entries(F.collect_list(F.struct("word", F.struct("direct", "english", "freq")))).alias("facts"))
    return texts.join(by, texts[key] == by["__id"], "left").drop("__id").withColumn("facts", F.coalesce(F.col("facts").cast(_FACTS), F.create_map().cast(_FACTS)))


def _fact(word: Column, what: str) -> Column:
    got = F.try_element_at(F.col("facts"), F.lower(word))
    return F.coalesce(got.getField(what), F.lit(0 if what == "freq" else False))


def _stop(word: Column) -> Column:
    return F.lower(word).isin(*sorted(tables.STOP_GLUE))


def join_hyphen_breaks(texts: DataFrame, key: str, text: str, dictionary: DataFrame, frequency: DataFrame) -> DataFrame:
    """``texts`` with ``moun- tains`` joined where neither part always stands alone and the joined word is English and in the dictionary itself or at least twice in
    the corpus; ``n_hyphen`` counts the joins. Tags stay as they are."""
    whole = lambda m: F.regexp_replace(m, r"(?U)-\s+", "")
    first, second = (lambda m: F.regexp_extract(m, r"^[A-Za-z]+", 0)), (lambda m: F.regexp_extract(m, "[A-Za-z]+$", 0))
    candidates = F.transform(F.filter(F.regexp_extract_all(F.col(text), F.lit(_BREAK), F.lit(0)), lambda m: ~m.startswith("<")), lambda m: F.lower(whole(m)))
    rows = _with_facts(texts, key, texts.select(F.col(key).alias("__id"), F.explode(F.array_distinct(candidates)).alias("word")), dictionary, frequency)

    def fits(m: Column) -> Column:
        return ~m.startswith("<") & ~_stop(first(m)) & ~_stop(second(m)) & _fact(whole(m), "english") & (_fact(whole(m), "direct") | (_fact(whole(m), "freq") >= 2))

    count = F.size(F.filter(F.regexp_extract_all(F.col(text), F.lit(_BREAK), F.lit(0)), fits))
    return rows.withColumn("n_hyphen", count).withColumn(text, map_matches(F.col(text), _BREAK, lambda m: F.when(fits(m), whole(m)).otherwise(m))).drop("facts")


def merge_soft_wraps(texts: DataFrame, key: str, text: str, dictionary: DataFrame, frequency: DataFrame) -> DataFrame:
    """``texts`` with ``moun tains`` joined; ``n_soft`` counts the joins.

    From left to right two words with one space between them become one if neither always stands alone, the second
    has no capital, the joined word is English, and in the dictionary itself, or at least twice in the corpus, or one part is at most twice in it,
    and not both parts are English. A capitalized first part needs the joined word itself in the dictionary. A joined word
    is tried with the next one again, however many pieces it has.

    Words of up to PIECES pieces are looked up at once. A longer one is only asked about where the word without its last piece is English, one piece more
    at a time, until no such word grows. A text gets the facts of its English joins and of their parts alone, so few that a look-up is short.
    """
    plain = texts.select(F.col(key).alias("__id"), F.regexp_replace(F.col(text), "<[^>]+>", "<>").alias("__p"))
    longest = (dictionary.agg(F.max(F.length("word"))).first()[0] or 0) + 4  # with an inflection

    def runs_of(k: int) -> Column:
        """All runs of k + 1 words with single spaces, of which only the first may have a capital and none always stands alone."""
        return F.regexp_extract_all("__p", F.lit(f"(?<![A-Za-z])(?=({_NO_STOP}[A-Za-z]++(?: {_NO_STOP}[a-z][A-Za-z]*+){{{k}}}))[A-Za-z]"), F.lit(1))

    tight = lambda c: F.lower(F.replace(c, F.lit(" "), F.lit("")))

    def english_joins(runs: DataFrame) -> DataFrame:
        """Of (__id, run) those that join to an English word. Only words, no texts' ids, meet the dictionary; the English ones are few."""
        tried = runs.withColumn("word", tight(F.col("run"))).where(F.length("word") <= longest)
        known = written(english_words(tried, dictionary).select("word"), "english-joins")
        joined = written(tried.join(known, "word").select("__id", "run"), "joined-words")
        release(known)
        return joined

    asked = grown = english_joins(plain.select("__id", F.explode(F.array_distinct(F.flatten(F.array(*map(runs_of, range(1, PIECES)))))).alias("run")))
    pieces = lambda: F.size(F.split("run", " "))
    k = PIECES - 1
    while True:
        # The longest joins go on where they are English.
        last = grown.where(pieces() == k + 1).select("__id", F.col("run").alias("__head")).distinct()
        k += 1
        longer = plain.join(last.select("__id").distinct(), "__id").select("__id", F.explode(F.array_distinct(runs_of(k))).alias("run")).withColumn("__head", F.substring_index("run", " ", k))
        grown = english_joins(longer.join(last, ["__id", "__head"]).select("__id", "run"))
        if not grown.limit(1).count():
            release(grown)
            break
        asked = asked.unionByName(grown)
    head, tail = F.expr("substring_index(run, ' ', size(split(run, ' ')) - 1)"), F.substring_index("run", " ", -1)
    rows = _with_facts(texts, key, asked.select("__id", F.explode(F.array(*map(tight, (F.col("run"), head, tail)))).alias("word")), dictionary, frequency)
    # A text without English joins stays as it is.
    some = F.size("facts") > 0
    return rows.withColumn("__f", _merged(F.when(some, F.col(text)), F.when(some, F.map_entries("facts")))).withColumn(text, F.coalesce("__f.text", F.col(text))).withColumn(
        "n_soft", F.coalesce("__f.n", F.lit(0))).drop("__f", "facts")


def _merged(text: Column, entries: Column) -> Column:
    """Struct (text, n) of a text whose wraps are joined by the entries of its facts; null for a null."""
    stop = frozenset(tables.STOP_GLUE)

    @F.arrow_udf("struct<text:string,n:int>")
    def run(texts: pa.Array, facts: pa.Array) -> pa.Array:
        done = [None if t is None else merge_tokens(t, {e["key"]: (e["value"]["direct"], e["value"]["english"], e["value"]["freq"]) for e in f}, stop) for t, f in zip(texts.to_pylist(), facts.to_pylist())]
        return pa.array([None if d is None else {"text": d[0], "n": d[1]} for d in done], pa.struct([("text", pa.string()), ("n", pa.int32())]))

    return run(text, entries)


def merge_tokens(text: str, facts: dict[str, tuple[bool, bool, int]], stop: frozenset[str]) -> tuple[str, int]:
    """A text with its soft wraps joined, and how many; ``facts``: (direct, english, freq) of lower-cased words. One pass, a look-up a word."""
    none, out, n = (False, False, 0), [], 0
    for t in _TOKENS.findall(text):
        if "a" <= t[0] <= "z" and len(out) > 1 and out[-1] == " ":
            a, low = out[-2], t.lower()
            first = a.lower()
            direct, english, freq = facts.get(first + low, none)
            if english and "a" <= first[0] <= "z" and first not in stop and low not in stop and (direct or not _TITLED.fullmatch(a)):
                (_, a_known, a_freq), (_, t_known, t_freq) = facts.get(first, none), facts.get(low, none)
                if (direct or freq >= 2 or a_freq <= 2 or t_freq <= 2) and not (a_known and t_known):
                    out[-2:] = [a + t]
                    n += 1
                    continue
        out.append(t)
    return "".join(out), n


def _glued(table: dict[str, str]) -> str:
    """Tags, and the fused tokens whatever their case."""
    return rf"(?U)<[^>]+>|\b(?i:{'|'.join(sorted(table, key=len, reverse=True))})\b"


def unglue(text: Column, glued: dict[str, str] | None = None) -> Column:
    """Fused tokens taken apart by the table, outside tags."""
    table = tables.GLUED if glued is None else glued
    if not table:
        return text
    to = F.create_map(*[F.lit(x) for kv in sorted(table.items()) for x in kv])
    return map_matches(text, _glued(table), lambda t: F.when(t.startswith("<"), t).otherwise(F.coalesce(initial_like(F.try_element_at(to, F.lower(t)), t), t)))


def fix_text(texts: DataFrame, key: str, text: str, dictionary: DataFrame, frequency: DataFrame | None = None) -> DataFrame:
    """Citations, hyphen breaks, soft wraps and fused tokens, in that order, with the counts of each pass. ``key`` is unique."""
    frequency = written(token_frequency(texts, text), "frequency") if frequency is None else frequency
    cited = texts.withColumn("n_citation", F.size(F.filter(F.regexp_extract_all(F.col(text), F.lit(r"(?U)\b[1lI][Cc]\s*lem\s+\d+\s*:\s*\d+"), F.lit(0)), lambda m: normalize_citation(m) != m))).withColumn(text, normalize_citation(F.col(text)))
    # Each pass reads its texts more than once.
    hyphened = written(join_hyphen_breaks(written(cited, "cited"), key, text, dictionary, frequency), "hyphened")
    soft = merge_soft_wraps(hyphened, key, text, dictionary, frequency)
    count = F.size(F.filter(F.regexp_extract_all(F.col(text), F.lit(_glued(tables.GLUED)), F.lit(0)), lambda t: ~t.startswith("<")))
    return soft.withColumn("n_unglued", count).withColumn(text, unglue(F.col(text)))


def pass_totals(fixed: DataFrame) -> DataFrame:
    """Sums of the pass counts; counted from rows, so that tasks that run again add nothing."""
    return fixed.agg(*[F.sum(c).alias(c) for c in ("n_citation", "n_hyphen", "n_soft", "n_unglued")])
