"""Segmentation of running text at numbered markers.

A marker pattern has the number as its first group. A segment reaches from the end of its marker to the next match of the
pattern, whether that is accepted or not, so text behind a rejected marker is lost with it. A marker is
accepted if its number is within bounds, not before the expected one and at most ``gap`` after it, and its
segment isn't blank; the next number is then expected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import DIGIT, LETTERS, OPEN_QUOTES, SPACE, UPPERS, collapse_space, to_roman

SPANS = "array<struct<n:int,t:string>>"


@dataclass(frozen=True)
class Marker:
    """How a text numbers its segments. ``gap`` None takes numbers in any order, repeats included."""

    pattern: str
    low: int | None = 1
    high: int | None = 200
    gap: int | None = 5
    whole_text: bool = True
    leading_text: bool = False


_NUMBER = rf"({DIGIT}+)"
_WORD_START = r"(?<!\S)"
_LINE_START = rf"(?:^|\n){SPACE}*"
_MORE = rf"(?:[,\s]+{DIGIT}+)*"

PRIMARY = Marker(rf"(?U){_WORD_START}{_NUMBER}{SPACE}*(?=[{LETTERS}{OPEN_QUOTES}])", whole_text=False)
SPACED = Marker(rf"(?U){_WORD_START}{_NUMBER}{SPACE}+(?=[{LETTERS}“\"'])")
LINED = Marker(rf"(?U){_LINE_START}{_NUMBER}{SPACE}+(?=[{LETTERS}“\"'])")
LINED_ASCII = Marker(rf"(?U){_LINE_START}{_NUMBER}{SPACE}+(?=[A-Za-z“\"'])", leading_text=True)
BRACKETED = Marker(rf"(?U)\[{_NUMBER}(?:{SPACE}*-{SPACE}*{DIGIT}+)?\]{SPACE}*", whole_text=False)
RANGED = Marker(rf"(?U)(?:^|{SPACE}){_NUMBER}{_MORE}{SPACE}*(?=[A-Za-z{OPEN_QUOTES}]|--)", low=None, high=None, gap=8, whole_text=False)


def _col(pattern: str | Column) -> Column:
    return F.lit(pattern) if isinstance(pattern, str) else pattern


def pieces(text: Column, pattern: str | Column) -> tuple[Column, Column]:
    """(numbers as text, the texts around them: one before the first and one after each)."""
    return F.regexp_extract_all(text, _col(pattern), F.lit(1)), F.split(text, _col(pattern), -1)


def after_first(text: Column, pattern: str | Column, prefix: str = "") -> Column:
    """What follows the first match, with ``prefix``; all of the text if there is none."""
    parts = F.split(text, _col(pattern), 2)
    return F.when(F.size(parts) == 2, F.concat(F.lit(prefix), F.get(parts, F.lit(1)))).otherwise(text)


def before_first(text: Column, pattern: str | Column) -> Column:
    return F.get(F.split(text, _col(pattern), 2), F.lit(0))


def accept(numbers: Column, texts: Column, low: int | None = 1, high: int | None = 200, gap: int | None = 5) -> Column:
    """The accepted (n, t) of parallel arrays of numbers (int) and texts, in order."""
    return _accept(F.zip_with(numbers, texts, lambda n, t: F.struct(n.alias("n"), t.alias("t"))), F.array().cast(SPANS), F.lit(1), low, high, gap)


def _accept(pairs: Column, start: Column, expected: Column, low: int | None, high: int | None, gap: int | None) -> Column:
    def step(acc: Column, x: Column) -> Column:
        fits = x.n.isNotNull() & (x.t != "")
        if low is not None:
            fits = fits & (x.n >= low)
        if high is not None:
            fits = fits & (x.n <= high)
        if gap is not None:
            fits = fits & (x.n >= acc.expected) & (x.n <= acc.expected + gap)
        return F.when(F.coalesce(fits, F.lit(False)), F.struct(F.concat(acc.out, F.array(F.struct(x.n.alias("n"), x.t.alias("t")))).alias("out"), (x.n + 1).alias("expected"))).otherwise(acc)

    return F.aggregate(pairs, F.struct(start.alias("out"), expected.cast("int").alias("expected")), step, lambda acc: acc.out)


def segments(text: Column, marker: Marker, relabel: Column | None = None, pattern: Column | None = None) -> Column:
    """The array of (n, t) of a text.

    ``relabel``: a first marker of this number counts as 1. A marker with ``leading_text`` takes what precedes a first
    marker of 2 as segment 1; one with ``whole_text`` makes a text without accepted markers one segment.
    """
    numbers, texts = pieces(text, pattern if pattern is not None else marker.pattern)
    numbers = F.transform(numbers, lambda n: n.try_cast("int"))
    if relabel is not None:
        numbers = F.transform(numbers, lambda n, i: F.when((i == 0) & (n == relabel), F.lit(1)).otherwise(n))
    bodies = F.transform(F.slice(texts, F.lit(2), F.greatest(F.size(texts) - 1, F.lit(0))), collapse_space)
    start, expected = F.array().cast(SPANS), F.lit(1)
    if marker.leading_text:
        lead = collapse_space(F.get(texts, F.lit(0)))
        led = (F.get(numbers, F.lit(0)) == 2) & (lead != "")
        start = F.when(led, F.array(F.struct(F.lit(1).alias("n"), lead.alias("t")))).otherwise(start)
        expected = F.when(led, F.lit(2)).otherwise(F.lit(1))
    found = _accept(F.zip_with(numbers, bodies, lambda n, t: F.struct(n.alias("n"), t.alias("t"))), start, expected, marker.low, marker.high, marker.gap)
    return or_whole(found, text) if marker.whole_text else found


def or_whole(found: Column, text: Column) -> Column:
    """``found``, or the collapsed text as segment 1 where nothing was found and the text isn't blank."""
    all_ = collapse_space(text)
    return F.when((F.size(found) == 0) & (all_ != ""), F.array(F.struct(F.lit(1).alias("n"), all_.alias("t")))).otherwise(found)


def primary_chapter(text: Column, chapter: Column) -> Column:
    """Chapters that begin with their own number before a capital; the number stands for verse 1."""
    at = lambda c: F.concat(F.lit(r"(?U)(?:^|\n|\s)"), c.cast("string"), F.lit(rf"\s+(?=[{UPPERS}{OPEN_QUOTES}])"))
    return segments(before_first(after_first(text, at(chapter), "1 "), at(chapter + 1)), PRIMARY)


def _headed(text: Column, head: str, chapter: Column, tail: str) -> tuple[Column, Column]:
    at = lambda c: F.concat(F.lit(head), c.cast("string"), F.lit(tail))
    return at(chapter), at(chapter + 1)


def enoch_chapter(text: Column, chapter: Column) -> Column:
    """``Chapter N`` headings, a subtitle line of letters after them, running ``Book N: ...`` titles left out."""
    this, following = _headed(text, r"(?U)Chapter\s+", chapter, r"\b")
    text = F.replace(text, F.lit("\t"), F.lit(" "))
    rest = F.when(F.size(F.split(text, this, 2)) == 2, F.regexp_replace(after_first(text, this), r"(?U)^\s*\n[A-Z][A-Za-z\s]+\n", "")).otherwise(text)
    return segments(F.regexp_replace(before_first(rest, following), rf"(?U)\bBook{SPACE}+{DIGIT}+:{SPACE}*[A-Za-z\s]+", ""), SPACED)


def drop_number_lines(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~line.rlike(r"(?U)^\s*\d+\s*$")), "\n")


def jasher_chapter(text: Column, chapter: Column) -> Column:
    """Roman numerals alone on their line as headings."""
    at = lambda c: F.concat(F.lit(r"(?U)(?:^|\n)\s*"), to_roman(c), F.lit(r"\s*(?:\n|$)"))
    return segments(drop_number_lines(before_first(after_first(text, at(chapter)), at(chapter + 1))), LINED)


def adam_eve_chapter(text: Column, chapter: Column, second: Column) -> Column:
    """``Chapter IV`` headings, or ``CHAP. IV.`` in the second book; a first line that ends a sentence and is no verse is a subtitle."""
    at = lambda c: F.when(second, F.concat(F.lit(r"(?U)CHAP\.\s+"), to_roman(c), F.lit(r"\."))).otherwise(F.concat(F.lit(r"(?U)Chapter\s+"), to_roman(c), F.lit(r"\b")))
    body = F.regexp_replace(after_first(text, at(chapter)), r"^[\n\r ]+", "")
    line, end = collapse_space(F.substring_index(body, "\n", 1)), F.locate("\n", body) - 1
    subtitle = (F.size(F.split(text, at(chapter), 2)) == 2) & (end > 0) & (end < 200) & ~line.rlike(r"(?U)^1\s") & line.endswith(".")
    rest = F.when(subtitle, F.substring(body, end + 2, F.length(body))).otherwise(F.when(F.size(F.split(text, at(chapter), 2)) == 2, body).otherwise(text))
    clean = F.regexp_replace(F.regexp_replace(before_first(rest, at(chapter + 1)), r"(?U)http\S+", ""), "(?i)blackmask", "")
    return segments(clean, LINED_ASCII)


_OPENER = rf"(?iU)(?:1{SPACE}+){{0,2}}The{SPACE}+(?:book|copy){SPACE}+of(?:{SPACE}+the)?{SPACE}+(?:words|Testament){SPACE}+of{SPACE}+([A-Za-z]{{2,}})"
_CHAPTER = rf"(?U)\b{_NUMBER}{SPACE}+[l1]{_MORE}{SPACE}*(?=[A-Z{OPEN_QUOTES}]|--)"


def strip_testament_page(text: Column) -> Column:
    """Without page numbers, web addresses and bracketed titles of the collection."""
    for noise in (r"(?U)Page\s*\|\s*\d+\s*", r"www\.[A-Za-z-]+\.com", r"\[The Apocrypha and Pseudepigrapha[^\]]*\]"):
        text = F.regexp_replace(text, noise, "")
    return text


def testament_slices(text: Column, stripped: bool = False) -> Column:
    """Array of (name, text) by opener, the opener included; of a name that occurs again the last one counts.

    ``stripped``: the text's pages went through ``strip_testament_page`` one by one.
    """
    clean = text if stripped else strip_testament_page(text)
    names = F.regexp_extract_all(clean, F.lit(_OPENER), F.lit(1))
    parts = F.split(clean, _OPENER, -1)
    heads = F.regexp_extract_all(clean, F.lit(_OPENER), F.lit(0))
    every = F.transform(names, lambda name, i: F.struct(F.lower(name).alias("name"), collapse_space(F.concat(F.get(heads, i), F.get(parts, i + 1))).alias("text"), i.alias("i")))
    return F.transform(F.filter(every, lambda x: ~F.exists(every, lambda y: (y["name"] == x["name"]) & (y.i > x.i))), lambda x: F.struct(x["name"].alias("name"), x.text.alias("text")))


def testament_chapters(text: Column) -> Column:
    """Array of (ch, verses) of one testament: accepted chapter markers, and what precedes the first as chapter 1 unless that is marked too."""
    numbers, parts = pieces(text, _CHAPTER)
    heads = F.regexp_extract_all(text, F.lit(_CHAPTER), F.lit(0))
    step = lambda acc, x: F.when((x.ch > acc.last) & (x.ch <= acc.last + 5), F.struct(
        F.concat(acc.out, F.array(F.struct(x.ch.alias("ch"), x.t.alias("t")))).alias("out"), x.ch.alias("last"), acc.lead.alias("lead"))).otherwise(
        # A rejected marker is text of the chapter before it, or of what leads.
        F.when(F.size(acc.out) == 0, F.struct(acc.out.alias("out"), acc.last.alias("last"), F.concat(acc.lead, x.t).alias("lead"))).otherwise(F.struct(
            F.concat(F.slice(acc.out, F.lit(1), F.size(acc.out) - 1), F.array(F.struct(F.element_at(acc.out, -1).ch.alias("ch"), F.concat(F.element_at(acc.out, -1).t, x.t).alias("t")))).alias("out"),
            acc.last.alias("last"), acc.lead.alias("lead"))))
    items = F.transform(numbers, lambda n, i: F.struct(F.coalesce(n.try_cast("int"), F.lit(0)).alias("ch"), F.concat(F.get(heads, i), F.get(parts, i + 1)).alias("t")))
    start = F.struct(F.array().cast("array<struct<ch:int,t:string>>").alias("out"), F.lit(0).alias("last"), F.coalesce(F.get(parts, F.lit(0)), F.lit("")).alias("lead"))
    folded = F.aggregate(items, start, step)
    verses = lambda t, ch: segments(t, RANGED, relabel=ch)
    marked = F.transform(folded.out, lambda c: F.struct(c.ch.alias("ch"), verses(c.t, c.ch).alias("verses")))
    lead = F.array(F.struct(F.lit(1).alias("ch"), or_whole(verses(folded.lead, F.lit(0)), folded.lead).alias("verses")))
    own_first = F.exists(folded.out, lambda c: c.ch == 1)
    return F.when((collapse_space(folded.lead) != "") & ~own_first, F.concat(lead, marked)).otherwise(marked)


def strip_apocrypha_page(text: Column, banners: tuple[str, ...] = ()) -> Column:
    """Without the given banners (patterns), inline chapter labels and lines of a number alone."""
    for banner in banners:
        text = F.regexp_replace(text, banner, "")
    return drop_number_lines(F.regexp_replace(text, r"(?U)\b(?:Esd|Mac|IVMac|IIIMac|IIMac|IMac|Bel|Bar|Tob|Sir|Jdt|Wis)\.\s*\d+\b", ""))


def apocrypha_chapter(text: Column, chapter: Column, grammar: Column) -> Column:
    """``grammar``: 'clement' (1Clem c:v), 'colon' (c:v) or any other value (``Chapter N`` with [v] or plain numbers)."""
    c, following = chapter.cast("string"), (chapter + 1).cast("string")
    free = Marker("", low=1, high=100, gap=None)

    def cited(head: str, tail: str, next_tail: str) -> Column:
        this = F.concat(F.lit(head), c, F.lit(tail))
        parts = F.split(text, this, 2)
        # Segments begin at the first marker: what precedes it is never part of one.
        begun = F.when(F.size(parts) == 2, F.substring(text, F.length(F.get(parts, F.lit(0))) + 1, F.length(text))).otherwise(text)
        body = before_first(begun, F.concat(F.lit(head), following, F.lit(next_tail)))
        return segments(body, free, pattern=this)

    clement = cited(r"(?U)1Clem\s+", r"\s*:\s*(\d+)\s*", r"\s*:\s*\d+")
    colon = cited(r"(?U)(?:^|\n|\s)", r"\s*:\s*(\d+)\s", r"\s*:\s*1\s")
    this, then = _headed(text, r"(?U)Chapter\s+", chapter, r"\b")
    body = before_first(after_first(text, this), then)
    bracketed = segments(body, BRACKETED)
    return F.when(grammar == "clement", clement).when(grammar == "colon", colon).otherwise(F.when(F.size(bracketed) > 0, bracketed).otherwise(segments(body, SPACED)))


def strip_headers(text: Column) -> Column:
    """A page of the primary layout without its running headers (at most four lines) and its trailing footnotes."""
    capital, letters, blank = UPPERS, LETTERS, r"[\t ]"
    page_first = r"^\d+\s*$"
    prefix, suffix = rf"(?:{DIGIT}{SPACE}+)?[{capital}]", rf"(?:{SPACE}+{DIGIT}+){{0,2}}{SPACE}*$"
    banner = [rf"^{DIGIT}+{SPACE}+{prefix}[\s'{letters}-]*?{suffix}", rf"^{prefix}[\s'{letters}-]+{suffix}"]

    def step(acc: Column, raw: Column) -> Column:
        line = F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")
        number = F.regexp_extract(line, r"(?U)^(\d+)\s*$", 1).try_cast("bigint")
        is_banner = (F.length(line) <= 35) & (line.rlike("(?U)" + banner[0]) | line.rlike("(?U)" + banner[1]))
        titled = line.rlike(rf"(?U)^[A-Z][\sA-Z]+{SPACE}*[–—-]{SPACE}*{DIGIT}+{SPACE}*[A-Z][A-Za-z]*{SPACE}*$")
        drop = (line.rlike("(?U)" + page_first) & ((number > 200) | (acc.drops == 0))) | is_banner | titled
        open_ = acc.open & (acc.drops < 4)
        return (F.when(open_ & (line == ""), acc)
                .when(open_ & F.coalesce(drop, F.lit(False)), F.struct((acc.drops + 1).alias("drops"), F.lit(True).alias("open"), acc.out.alias("out")))
                .otherwise(F.struct(acc.drops.alias("drops"), F.lit(False).alias("open"), F.concat(acc.out, F.array(raw)).alias("out"))))

    start = F.struct(F.lit(0).alias("drops"), F.lit(True).alias("open"), F.array().cast("array<string>").alias("out"))
    body = F.aggregate(F.split(text, "\n"), start, step, lambda acc: F.array_join(acc.out, "\n"))
    body = F.regexp_replace(body, rf"(?mU)^{blank}*(?:{DIGIT}{blank}+)?[{capital}][\s'{capital}-]{{2,}}(?:{blank}+{DIGIT}+){{0,3}}{blank}*$", "")
    mark = rf"(?U)(?:^|\s|\n)\d+(?=[{capital}{OPEN_QUOTES}])"
    pieces_ = F.split(body, mark, -1)
    tail = F.element_at(pieces_, -1)
    part = rf"['{letters}-]+"
    note = rf"(?U)\n[A-Z]{part}(?:[\s/-]{part}){{0,4}}{SPACE}*[:—]{SPACE}+[A-Za-z“‘\"']"
    return F.substring(body, 1, F.length(body) - F.length(tail) + F.length(before_first(tail, note)))
