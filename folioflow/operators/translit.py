"""Rule-driven transliteration of verse text, as one chain of Column expressions.

All word rules form one alternation, longest source first, so a single pass over a text finds the matches that ordered
passes with protected replacements would find: matches of whole words can only overlap between phrases, and of those the
first in the text is the longer or equal one. What lies between matches then gets the prefix rule.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import tables
from ..functions.text import case_like

_NAME = r"A-Za-z\x{C0}-\x{24F}\x{1E00}-\x{1EFF}"
DIVINE_SPAN, NAME_SPAN = '<span class="dn">', '<span class="hwhy">'
PREFIXES = tuple((first + "l", "Al") for first in "ĔE")


def map_matches(text: Column, pattern: str, replace: Callable[[Column], Column], between: Callable[[Column], Column] | None = None) -> Column:
    """The text with ``replace`` of each match and ``between`` of each part between matches."""
    matches = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), replace)
    parts = F.split(text, pattern, -1)
    if between is not None:
        parts = F.transform(parts, between)
    return F.array_join(F.zip_with(parts, matches, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")


def _quote(source: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+?^$|-])", r"\\\1", source)


def word_pattern(sources: list[str], guarded: tuple[str, ...] = ("Ĕl", "El")) -> str:
    """Whole words of the sources, whatever the case, with a plural or possessive s behind them left outside; guarded ones not right after an apostrophe."""
    ordered = sorted(sources, key=lambda s: -len(s))
    return r"(?iuU)(?:" + "|".join((r"(?<!['’])" if s in guarded else "") + r"\b" + _quote(s) for s in ordered) + r")(?=(?:'?s)?\b)"


def apply_rules(text: Column, divine: dict[str, str] | None = None, plain: dict[str, str] | None = None, prefixes: tuple[tuple[str, str], ...] = PREFIXES,
                exceptions: frozenset[str] | None = None) -> Column:
    """Word rules, then the prefix rules on the parts that no word rule touched."""
    divine = tables.DIVINE if divine is None else divine
    plain = tables.PLAIN if plain is None else plain
    exceptions = tables.EL_PREFIX_EXCEPTIONS if exceptions is None else exceptions
    targets: dict[str, tuple[str, bool]] = {}
    for is_divine, rules in ((True, divine), (False, plain)):
        for source, target in rules.items():
            targets.setdefault(source.lower(), (target, is_divine))

    def prefixed(part: Column) -> Column:
        for source, target in prefixes:
            part = map_matches(part, rf"(?iuU)\b{_quote(source)}[{_NAME}]+", new_prefix(len(source), target))
        return part

    def new_prefix(n: int, target: str) -> Callable[[Column], Column]:
        return lambda w: F.when(F.lower(w).isin(*sorted(exceptions)), w).otherwise(F.concat(case_like(F.lit(target), F.substring(w, 1, n)), F.substring(w, n + 1, 1_000_000)))

    if not targets:
        return prefixed(text)
    to = F.create_map(*[F.lit(x) for s, (t, _) in sorted(targets.items()) for x in (s, t)])
    named = sorted(s for s, (_, d) in targets.items() if d)

    def replaced(match: Column) -> Column:
        word = case_like(F.element_at(to, F.lower(match)), match)
        return F.when(F.lower(match).isin(*named), F.concat(F.lit(DIVINE_SPAN), word, F.lit("</span>"))).otherwise(word) if named else word

    return map_matches(text, word_pattern([*divine, *plain]), replaced, prefixed)


def repair_stranded(text: Column) -> Column:
    """Spans stranded inside a name by an earlier run: plural, then singular, then the bare name."""
    head = rf"Yisra['’]?{DIVINE_SPAN}Al</span>"
    text = F.regexp_replace(F.regexp_replace(text, head + "ites", "Yasharalites"), head + "ite", "Yasharalite")
    return F.regexp_replace(text, head, f"{DIVINE_SPAN}Yasharal</span>")


def yi_ye_prefix(text: Column, exceptions: frozenset[str] | None = None) -> Column:
    """Yi- and Ye- of names to Yah-, YE- and YI- to YAH-."""
    words = sorted(tables.YI_YE_EXCEPTIONS if exceptions is None else exceptions)
    return map_matches(text, rf"(?U)\bY[eEiI][{_NAME}'’]+\b", lambda w: F.when(F.lower(w).isin(*words), w).otherwise(
        F.concat(F.substring(w, 1, 1), F.when(F.substring(w, 2, 1).isin("E", "I"), "AH").otherwise("ah"), F.substring(w, 3, 1_000_000))))


def el_suffix(text: Column, exceptions: frozenset[str] | None = None) -> Column:
    """-el of capitalized names to -al, each letter in its case.

    A name may have several such parts, set off by apostrophes. They change from the last part on, as if each pass took the longest name that ends in
    -el, until no pass changes anything; a name that is an exception up to the end of a part keeps that part and those before it.
    """
    words = sorted(tables.EL_SUFFIX_EXCEPTIONS if exceptions is None else exceptions)

    def changed(name: Column) -> Column:
        parts = F.split(name, r"(?<=[Ll])(?=[^\p{L}\p{N}_])", -1)
        upto = F.transform(parts, lambda _, i: F.array_join(F.slice(parts, F.lit(1), i + 1), ""))
        ends = F.transform(upto, lambda u: u.rlike("^..+[EeĔĕ][Ll]$"))
        stays = F.transform(upto, lambda u, i: F.get(ends, i) & F.lower(u).isin(*words))
        kept = F.array_position(F.reverse(stays), F.lit(True))  # from the end
        last_kept = F.when(kept > 0, F.size(parts) - kept).otherwise(-1)

        def part(p: Column, i: Column) -> Column:
            e, el = F.substring(p, -2, 1), F.substring(p, -1, 1)
            new = F.concat(F.substring(p, F.lit(1), F.length(p) - 2), F.when(e.isin("E", "Ĕ"), "A").otherwise("a"), F.when(el == "L", "L").otherwise("l"))
            return F.when(F.get(ends, i) & (i > last_kept), new).otherwise(p)

        return F.array_join(F.transform(parts, part), "")

    return map_matches(text, rf"(?U)\b[A-Z\x{{100}}-\x{{24F}}\x{{1E00}}-\x{{1EFF}}][{_NAME}'’]+[EeĔĕ][Ll]\b", changed)


def annotate_name(text: Column) -> Column:
    """The spoken form before each HWHY; what has it already stays."""
    return F.regexp_replace(text, r'(?U)(?<!"hwhy">)\bHWHY\b', f"({DIVINE_SPAN}YAHUAH</span>) {NAME_SPAN}HWHY</span>")


def transliterate(text: Column) -> Column:
    """All passes in their order, with the default tables."""
    return annotate_name(el_suffix(yi_ye_prefix(repair_stranded(apply_rules(text)))))
