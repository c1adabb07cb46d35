from __future__ import annotations

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from folioflow.functions import tables
from folioflow.functions import text as tx


def test_normalize_match_agrees_with_unicodedata(spark):
    texts = ["Ḥanoḵ’s “Day”,  then", "Ça va? ÉTÉ x", "a_b-c ½ ²", "", "ﬁ ǅ Ω", "é x", "日本 ガ", "\tA\n"]

    def expected(s: str) -> str:
        s = "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn")
        return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", s.lower())).strip()

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.normalize_match(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in rows} == {t: expected(t) for t in texts}


@pytest.mark.parametrize(("number", "roman"), [(4, "IV"), (9, "IX"), (44, "XLIV"), (99, "XCIX"), (110, "CX"), (0, "")])
def test_roman(value, number, roman):
    assert value(tx.to_roman(F.lit(number))) == roman
    assert value(tx.from_roman(F.lit(roman))) == number


def test_from_roman_is_unchecked(value):
    assert value(tx.from_roman(F.lit("iix"))) == 8
    assert value(tx.from_roman(F.lit("Q"))) == 0


@pytest.mark.parametrize(("source", "expected"), [("GOD", "ALUAHIM"), ("God", "Aluahim"), ("god", "aluahim"), ("gOD", "aluahim"), ("The Lord", "Aluahim")])
def test_case_like(value, source, expected):
    assert value(tx.case_like(F.lit("aluahim"), F.lit(source))) == expected


def test_escape_keeps_two_spans(value):
    assert value(tx.escape_markup(F.lit('a<b> <span class="dn">X</span> <span class="x">y</span>'))) == 'a&lt;b&gt; <span class="dn">X</span> &lt;span class="x"&gt;y&lt;/span&gt;'


def test_urls_and_routes(value):
    assert value(tx.chapter_url(F.lit("a b'é"), F.lit(3), F.lit(None).cast("int"))) == "chapter.html?id=a%20b'%C3%A9&ch=3"
    assert tuple(value(tx.parse_route(F.lit("#/book/a%20b/3/4")))) == ("a b", 3, 4)
    assert tuple(value(tx.parse_route(F.lit("#/other")))) == (None, None, None)
    assert value(tx.reference_label(F.lit("B"), F.lit(2), F.lit(1), F.lit(None).cast("int"))) == "B"


@pytest.mark.parametrize(("text", "number"), [("12a", 12), ("0", 7), ("x", 7), ("-3", -3), (None, 7), ("99999999999", 7)])
def test_int_or(value, text, number):
    assert value(tx.int_or(F.lit(text).cast("string"), 7)) == number


def test_prose_counts_utf16_units(value):
    verses = lambda t: F.array(F.struct(F.lit(1).alias("n"), F.lit(t).alias("t")))
    assert not value(tx.is_prose(verses("x" * 600)))
    assert value(tx.is_prose(verses("x" * 599 + "😀")))


def test_tables():
    assert len(tables.DIVINE) + len(tables.PLAIN) == 164
    assert sum(tables.EXPECTED.values()) == 31102
    assert len(tables.GLUED) == 87
