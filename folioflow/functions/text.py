"""Scalar text functions as Column expressions; all run inside the JVM."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = r"A-Za-z\x{80}-\x{FFFF}"
UPPERS = r"A-Z\x{80}-\x{FFFF}"
OPEN_QUOTES = "\"“‘'"
TAG = r"<[^>]+>"
#: Parts of patterns; with the flag U they are those of Unicode.
SPACE, DIGIT = r"\s", r"\p{Nd}"
_SPANS = "hwhy|dn"


@lru_cache(maxsize=1)
def _bases() -> tuple[str, str]:
    """Precomposed characters and the single characters that are left of them without their marks."""
    src, dst = [], []
    for code in range(0xC0, 0x30000):
        c = chr(code)
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF or not unicodedata.decomposition(c):
            continue
        left = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if len(left) == 1 and left != c:
            src.append(c)
            dst.append(left)
    return "".join(src), "".join(dst)


def strip_marks(text: Column) -> Column:
    """Canonical decomposition without non-spacing marks. Hangul syllables stay composed."""
    return F.regexp_replace(F.translate(text, *_bases()), r"\p{Mn}", "")


def collapse_space(text: Column) -> Column:
    """Unicode white space runs to one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def normalize_match(text: Column) -> Column:
    """For matching: no marks, lower case, punctuation as spaces, spaces collapsed."""
    return collapse_space(F.regexp_replace(F.lower(strip_marks(text)), r"(?U)[^\p{L}\p{N}_\s]", " "))


def normalize_heading(text: Column) -> Column:
    """For headings: no marks, plain quotes and dashes, upper case."""
    return F.upper(F.translate(strip_marks(text), "‘’“”—–", "''\"\"--"))


def bare_upper(text: Column) -> Column:
    """No apostrophes of any kind, upper case."""
    return F.upper(F.translate(text, "'’ʼ‘`", ""))


def words(text: Column) -> Column:
    """The words of a text normalized for matching; none for an empty one."""
    return F.filter(F.split(normalize_match(text), " "), lambda w: w != "")


def to_roman(number: Column) -> Column:
    """Roman numeral of a positive integer; hundreds are repeated C, as deep as needed."""
    steps = [(100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]
    out, rest = F.lit(""), number.cast("int")
    for value, sign in steps:
        out = F.concat(out, F.repeat(F.lit(sign), F.floor(rest / value).cast("int")))
        rest = F.pmod(rest, F.lit(value))
    return F.when(number > 0, out).otherwise(F.lit(""))


_ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def from_roman(text: Column) -> Column:
    """Value of a numeral, unchecked: from the right, a smaller value than the last one added is taken off; other characters count 0."""
    value = lambda c: F.coalesce(F.element_at(F.create_map(*[x for k, v in _ROMAN.items() for x in (F.lit(k), F.lit(v))]), c), F.lit(0))
    step = lambda acc, c: F.when(value(c) < acc.last, F.struct((acc.total - value(c)).alias("total"), acc.last.alias("last"))).otherwise(
        F.struct((acc.total + value(c)).alias("total"), value(c).alias("last")))
    signs = F.filter(F.split(F.reverse(F.upper(text)), ""), lambda c: c != "")
    return F.aggregate(signs, F.struct(F.lit(0).alias("total"), F.lit(0).alias("last")), step, lambda acc: acc.total)


def case_like(replacement: Column, source: Column) -> Column:
    """Replacement in the case of source: capitals, or a capital first letter for a title-cased source, else as it is."""
    titled = F.concat(F.upper(F.substring(replacement, 1, 1)), F.substring(replacement, 2, 1_000_000))
    return (F.when(is_upper(source), F.upper(replacement))
            .when(is_title(source), titled)
            .otherwise(replacement))


def is_upper(text: Column) -> Column:
    """Whether there is a cased letter and none in lower case."""
    return text.rlike(r"[\p{Lu}\p{Lt}]") & ~text.rlike(r"[\p{Ll}\p{Lt}]")


def is_title(text: Column) -> Column:
    """Whether every run of cased letters starts with its only capital."""
    return text.rlike(r"\p{Lu}") & ~text.rlike(r"[\p{Lu}\p{Ll}]\p{Lu}") & ~text.rlike(r"(?<![\p{Lu}\p{Ll}])\p{Ll}")


def initial_like(replacement: Column, source: Column) -> Column:
    """Replacement with a capital first letter if source has one."""
    titled = F.concat(F.upper(F.substring(replacement, 1, 1)), F.substring(replacement, 2, 1_000_000))
    return F.when(F.substring(source, 1, 1).rlike(r"^\p{Lu}"), titled).otherwise(replacement)


def tags_and_text(text: Column) -> Column:
    """The tags and the texts between them, in order."""
    return F.regexp_extract_all(text, F.lit(TAG + "|[^<]+|<"), F.lit(0))


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, TAG, "")


def ascii_tokens(text: Column) -> Column:
    """Lower-cased ASCII letter runs outside tags."""
    return F.transform(F.regexp_extract_all(strip_tags(text), F.lit("[A-Za-z]+"), F.lit(0)), F.lower)


def normalize_citation(text: Column) -> Column:
    """Misread and split chapter prefixes of 1 Clement citations to ``1Clem c:v``."""
    return F.regexp_replace(text, rf"(?U)\b[1Il][cC]{SPACE}*lem{SPACE}+({DIGIT}+{SPACE}*:{SPACE}*{DIGIT}+)", "1Clem $1")


def escape_markup(text: Column) -> Column:
    """HTML-escaped, but for spans of the two kinds that the corpus uses."""
    safe = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.regexp_replace(safe, rf'(?s)&lt;span class="({_SPANS})"&gt;(.*?)&lt;/span&gt;', '<span class="$1">' + "$2</span>")


def is_prose(verses: Column) -> Column:
    """Whether a chapter is one verse of more than 600 UTF-16 units."""
    first = F.get(verses, F.lit(0)).t
    units = F.length(first) + F.length(F.regexp_replace(first, r"[^\x{10000}-\x{10FFFF}]", ""))
    return (F.size(verses) == 1) & (units > 600)


def reference_label(name: Column, chapter: Column, chapter_count: Column, verse: Column) -> Column:
    """``Name c:v``; the chapter only for books of several, the verse only if there is one."""
    return F.concat(name, F.when(chapter_count > 1, F.concat(F.lit(" "), chapter.cast("string"))).otherwise(F.lit("")),
                    F.when(verse.isNotNull(), F.concat(F.lit(":"), verse.cast("string"))).otherwise(F.lit("")))


def encode_component(text: Column) -> Column:
    """URI component encoding, in which !'()*~ stay and a space is %20."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for code, c in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(c))
    return out


def chapter_url(book: Column, chapter: Column, verse: Column, page: str = "chapter.html") -> Column:
    return F.concat(F.lit(f"{page}?id="), encode_component(book), F.lit("&ch="), chapter.cast("string"),
                    F.when(verse.isNotNull(), F.concat(F.lit("&v="), verse.cast("string"))).otherwise(F.lit("")))


def parse_route(route: Column) -> Column:
    """Struct (book, chapter, verse) of ``#/book/<id>/<chapter>/<verse>``; null book for another route."""
    part = lambda k: F.nullif(F.regexp_extract(route, r"^#/book/([^/]+)(?:/(\d+))?(?:/(\d+))?$", k), F.lit(""))
    return F.struct(F.url_decode(F.replace(part(1), F.lit("+"), F.lit("%2B"))).alias("book"), part(2).try_cast("int").alias("chapter"), part(3).try_cast("int").alias("verse"))


def int_or(text: Column, default: int | None) -> Column:
    """The integer that a text starts with; ``default`` where there is none or it is 0."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"(?U)^\s*([+-]?[0-9]+)", 1).try_cast("int"), F.lit(0)), F.lit(default).cast("int"))


def script_safe(json: Column) -> Column:
    """JSON that can stand inside a script element."""
    return F.replace(json, F.lit("</"), F.lit("<\\/"))
