from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from folioflow.operators import aggregates, anchors, audit, joins, layout, marks, repair, segment, translit, windows


def spans(rows):
    return [tuple(r) for r in rows]


def test_markers_lose_rejected_segments(value):
    assert spans(value(segment.segments(F.lit("1 aa 9 bb 2 cc"), segment.SPACED))) == [(1, "aa"), (2, "cc")]


def test_forward_progress(value):
    got = value(segment.accept(F.array(*map(F.lit, [1, 2, 2, 9, 4, 11, 5, 6])), F.array(*[F.lit("x")] * 8)))
    assert [r.n for r in got] == [1, 2, 4, 5, 6]


def test_text_without_markers_is_one_segment(value):
    assert spans(value(segment.segments(F.lit(" no  marks "), segment.SPACED))) == [(1, "no marks")]
    assert value(segment.segments(F.lit("no marks"), segment.PRIMARY)) == []
    assert value(segment.segments(F.lit(""), segment.SPACED)) == []


@pytest.mark.parametrize(("expr", "expected"), [
    (lambda: segment.primary_chapter(F.lit("foo 3 In the beginning 2 the 4 Next One"), F.lit(3)), [(1, "In the beginning"), (2, "the")]),
    (lambda: segment.enoch_chapter(F.lit("x\nChapter\t2\nThe Title\n1 one two 2 three\nChapter 3\n1 no"), F.lit(2)), [(1, "one two"), (2, "three")]),
    (lambda: segment.jasher_chapter(F.lit("I\n1 And a\n2 And b\n44\nII\n1 c"), F.lit(1)), [(1, "And a"), (2, "And b")]),
    (lambda: segment.adam_eve_chapter(F.lit("Chapter IV\nThe grief. Cain goes.\nFirst para\n2 And so\nChapter V\n1 x"), F.lit(4), F.lit(False)), [(1, "First para"), (2, "And so")]),
    (lambda: segment.adam_eve_chapter(F.lit("CHAP. IV.\n1 And\nCHAP. V.\n1 x"), F.lit(4), F.lit(True)), [(1, "And")]),
    (lambda: segment.apocrypha_chapter(F.lit("zz 1Clem 2:1 aa 1Clem 2:2 bb 1Clem 3:1 c"), F.lit(2), F.lit("clement")), [(1, "aa"), (2, "bb")]),
    (lambda: segment.apocrypha_chapter(F.lit("zz 2:1 aa 2:1 bb 3:1 c"), F.lit(2), F.lit("colon")), [(1, "aa"), (1, "bb")]),
    (lambda: segment.apocrypha_chapter(F.lit("Chapter 2 [1-3] aa [4] bb Chapter 3"), F.lit(2), F.lit("")), [(1, "aa"), (4, "bb")]),
    (lambda: segment.apocrypha_chapter(F.lit("Chapter 2 1 aa 2 bb Chapter 3"), F.lit(2), F.lit("")), [(1, "aa"), (2, "bb")]),
])
def test_layouts(value, expr, expected):
    assert spans(value(expr())) == expected


def test_testaments(value):
    slices = value(segment.testament_slices(F.lit("foo 1 1 The copy of the words of Judah, x 2 1 And y Page | 3 The book of Testament of Dan z The copy of the words of Judah, again")))
    assert spans(slices) == [("dan", "The book of Testament of Dan z"), ("judah", "The copy of the words of Judah, again")]
    chapters = value(segment.testament_chapters(F.lit("The copy of Judah, open text. 2 1, 2 And this chief 3 came 3 1 Then he 2 said 7 law")))
    assert [(c.ch, spans(c.verses)) for c in chapters] == [(1, [(1, "The copy of Judah, open text.")]), (2, [(1, "And this chief"), (3, "came")]), (3, [(1, "Then he"), (2, "said"), (7, "law")])]


def test_headers_and_footnotes_go(value):
    text = value(segment.strip_headers(F.lit("44    GENESIS 2\n\n3 And he said 4And she\nELOHIM 3\nwent 5They\nElohim: The ending is")))
    assert text.split() == "3 And he said 4And she went 5They".split()


def test_interpolation(spark):
    extents = spark.createDataFrame([("x", 6), ("y", 3), ("z", 2)], "id string, chapter_count int")
    found = spark.createDataFrame([("x", 1, 10), ("x", 5, 12), ("y", 1, 10), ("y", 3, 11)], "id string, ch int, page int")
    pages = lambda df, b: [r.page for r in df.where(F.col("id") == b).orderBy("ch").collect()]
    fixed, grown = windows.interpolate(found, extents), windows.interpolate_cumulative(found, extents)
    assert pages(fixed, "x") == [10, 10, 11, 12, 12, 12]
    assert pages(grown, "x") == [10, 10, 11, 11, 12, 12]
    assert pages(fixed, "y") == [10, 10, 11]  # half to even
    assert pages(fixed, "z") == pages(grown, "z") == [None, None]


@pytest.mark.parametrize("buckets", [0, 3])
def test_asof_backward(spark, buckets):
    right = spark.createDataFrame([(0, "b1", 1, 10), (1, "b1", 2, 12), (2, "b2", 1, 12), (3, "b2", 2, 20)], "ord int, id string, ch int, printed int")
    left = spark.createDataFrame([(9,), (11,), (12,), (30,), (None,)], "p int")
    got = {r.p: r.match and (r.match.id, r.match.ch) for r in joins.asof_backward(left, right, "p", "printed", "ord", buckets=buckets).collect()}
    assert got == {9: None, 11: ("b1", 1), 12: ("b1", 2), 30: ("b2", 2), None: None}


def test_asof_forward_is_strict(spark):
    starts = spark.createDataFrame([("f", 1), ("f", 5), ("g", 9)], "pdf string, page int")
    left = spark.createDataFrame([("f", 0), ("f", 1), ("f", 5), ("h", 1)], "pdf string, page int")
    assert {(r.pdf, r.page): r.next_page for r in joins.asof_forward(left, starts).collect()} == {("f", 0): 1, ("f", 1): 5, ("f", 5): None, ("h", 1): None}


def test_windows(value):
    words = lambda n: F.array(*[F.lit(str(i)) for i in range(n)])
    starts = lambda n, m: [int(w.split()[0]) for w in value(windows.word_windows(words(n), m))]
    assert [starts(n, 4) for n in (4, 5, 8, 9, 12)] == [[0], [0], [0], [0, 4], [0, 4]]
    assert [starts(n, 5) for n in (4, 5, 8, 9, 12)] == [[0], [0], [0], [0], [0, 4]]


def test_gap_reports_the_first_only(spark):
    rows = spark.createDataFrame([("a", p, n) for p, n in enumerate([2, 3, 4])] + [("b", p, n) for p, n in enumerate([1, 2])], "id string, pos int, n int")
    assert spans(windows.first_gap(rows, ["id"]).collect()) == [("a", 2, 1)]


def test_containment_plans_agree(spark):
    rnd = random.Random(5)
    hay = [(k, " ".join(rnd.choice("abcdef") for _ in range(40))) for k in range(12)]
    needles = [(k, " ".join(h.split()[k : k + rnd.choice([2, 4, 9])])) for k, (_, h) in enumerate(hay)] + [(99, ""), (98, "zz zz zz zz zz")]
    n, h = spark.createDataFrame(needles, "i int, needle string"), spark.createDataFrame(hay, "j int, hay string")
    fast = {(r.i, r.j) for r in joins.contains_window(n, h, "needle", "hay").collect()}
    slow = {(r.i, r.j) for r in n.crossJoin(h).where(audit.containing(F.col("needle"), F.col("hay"))).collect()}
    assert fast == slow and len(fast) >= 12


def test_keep_first_note(spark):
    body = "x" * 80
    rows = spark.createDataFrame([(1, "Term", body + "a"), (2, "TERM", body + "b"), (3, "Term", "y")], "p int, term string, body string")
    assert sorted(r.p for r in aggregates.keep_first_note(rows, F.col("p")).collect()) == [1, 3]


def test_rules(spark):
    span = '<span class="dn">{}</span>'.format
    cases = {
        "God's Gods": f"{span('Aluahim')}'s {span('Aluahim')}s", "the Lord God": f"{span('Yahuah')} {span('Aluahim')}", "Elect Elam elbow": "Elect Alam Albow",
        "Yehallel'ĕl wheel Wheel": "Yahhallal'al wheel Wheel", "YERUSHALAYIM Year": "YAHRUSHALAYIM Year", "Israelites": "Yasharalites", "": "",
    }
    rows = spark.createDataFrame([(c,) for c in cases], "t string").select("t", translit.transliterate(F.col("t")).alias("o")).collect()
    assert {r.t: r.o for r in rows} == cases


def test_annotation_is_idempotent(value):
    once = translit.annotate_name(F.lit("HWHY said"))
    assert value(translit.annotate_name(once)) == value(once)


def test_repair(spark):
    words = spark.createDataFrame([(w,) for w in "the mountains city make".split()], "word string")
    texts = spark.createDataFrame([(1, "the moun tains"), (2, "Aram is"), (3, "Twentyone <i>ci ties</i>"), (4, "moun- tains"), (5, None)], "k int, t string")
    fixed = repair.fix_text(texts, "k", "t", words)
    assert {r.k: r.t for r in fixed.collect()} == {1: "the mountains", 2: "Aram is", 3: "Twenty-one <i>cities</i>", 4: "mountains", 5: None}
    assert tuple(repair.pass_totals(fixed).first()) == (0, 1, 2, 1)


def _cluster(words, tolerance=5.0):
    lines = []
    for w in sorted(words):
        line = next((b for b in lines if abs(w[0] - sum(x[0] for x in b) / len(b)) <= tolerance), None)
        line.append(w) if line is not None else lines.append([w])
    lines.sort(key=lambda b: sum(x[0] for x in b) / len(b))
    return [" ".join(w[3] for w in sorted(b, key=lambda w: w[2])) for b in lines]


def test_lines_agree_with_a_plain_loop(spark):
    rnd = random.Random(7)
    pages = [[(float(rnd.randint(0, 60)), i, float(rnd.randint(0, 1000)), f"w{i}") for i in range(rnd.randint(0, 30))] for _ in range(12)]
    df = spark.createDataFrame(list(enumerate(pages)), "p int, w array<struct<top:double,pos:int,x0:double,text:string>>")
    assert {r.p: r.lines for r in df.select("p", layout.cluster_lines(F.col("w")).alias("lines")).collect()} == {k: _cluster(w) for k, w in enumerate(pages)}


def test_columns_and_header(spark):
    words = [("f", 1, i, *x, 100.0, 100.0) for i, x in enumerate([("BANNER", 40.0, 60.0, 1.0, 5.0), ("a", 1.0, 5.0, 20.0, 25.0), ("b", 7.0, 9.0, 18.0, 25.0), ("c", 60.0, 70.0, 20.0, 25.0), ("d", 1.0, 5.0, 40.0, 45.0)])]
    df = spark.createDataFrame(words, "pdf string, page int, pos int, text string, x0 double, x1 double, top double, bottom double, page_width double, page_height double")
    assert layout.page_text(df).first().text == "BANNER\na b\nd\nc"


def test_footnotes(spark):
    body = [("f", 1, i, c, float(i), i + 1.0, 10.0, 20.0, 10.0, 1.0) for i, c in enumerate("body")]
    foot = [("f", 1, 9 + i, c, x, x + 1.0, 30.0, 38.0, 8.0, 1.0) for i, (c, x) in enumerate([("a", 0.0), ("b", 1.0), ("c", 3.0)])]
    df = spark.createDataFrame(body + foot, "pdf string, page int, pos int, text string, x0 double, x1 double, top double, bottom double, size double, width double")
    assert layout.footnote_text(layout.footnote_chars(df)).first().text == "ab c"
    assert layout.drop_footnotes(df).count() == 4


def test_note_split(value):
    got = value(layout.split_notes(F.lit("Elohim: The ending is really YM.\nSabbath: Shin means  cease")))
    assert spans(got) == [("Elohim", "The ending is really YM."), ("Sabbath", "Shin means cease")]


def test_chapters_are_found_and_confirmed(spark):
    pages = spark.createDataFrame([("j", 1, "I\n1 no contents"), ("j", 7, "x\nII\n1 And so"), ("j", 8, "IX\nnot a verse"), ("j", 9, "\nIII\n1 “Go")], "id string, page int, text string")
    extents = spark.createDataFrame([("j", 4)], "id string, chapter_count int")
    assert [(r.ch, r.page) for r in anchors.roman_anchors(pages, extents).orderBy("ch").collect()] == [(1, 7), (2, 7), (3, 9), (4, 9)]
    numbered = spark.createDataFrame([("e", 3, "Chapter 1 and Chapter\t2"), ("e", 5, "Chapter 4")], "id string, page int, text string")
    assert [r.page for r in anchors.numbered_anchors(numbered, spark.createDataFrame([("e", 4)], "id string, chapter_count int")).orderBy("ch").collect()] == [3, 3, 4, 5]


def test_body_anchors(spark):
    pages = spark.createDataFrame([("b", 10, "BOOK 1\nthe text"), ("b", 12, "BOOK 2\n 3 \nAnd it was")], "id string, page int, text string")
    extents = spark.createDataFrame([("b", "Book", 10, 14, 4)], "id string, match_name string, start int, last int, chapter_count int")
    assert [(r.ch, r.page) for r in anchors.body_anchors(pages, extents).orderBy("ch").collect()] == [(1, 10), (2, 11), (3, 12), (4, 12)]


def _events(spark, actions):
    rows = [(1, i, i, a, "b", 1, v) for i, (a, v) in enumerate(actions)]
    return spark.createDataFrame(rows, "user_id long, ts long, seq int, action string, book string, chapter int, verse int")


def _verses(df):
    return [m.verse for m in df.first().marks]


def test_marks(spark):
    assert _verses(marks.fold_marks(_events(spark, [("add", 1), ("add", 2), ("add", 1)]))) == [1, 2]
    assert _verses(marks.fold_marks(_events(spark, [("add", 1), ("add", 2), ("add", 3), ("remove", 3)]), cap=2)) == [2]  # what the cap took doesn't come back
    assert _verses(marks.fold_marks(_events(spark, [("add", None), ("add", 3), ("toggle", None), ("toggle", 5)]))) == [5, 3]
    cleared = marks.fold_marks(_events(spark, [("add", 1), ("read", None), ("clear", None)])).first()
    assert cleared.marks == [] and cleared.last_read is None


def test_marks_export_and_import(spark):
    state = marks.fold_marks(_events(spark, [("add", 1), ("read", None)]))
    files = marks.export_marks(state)
    back = marks.import_marks(state.limit(0), files).first()
    assert back.last_read.book == "b" and [m.verse for m in back.marks] == [1]
    broken = files.withColumn("json", F.lit("{"))
    assert _verses(marks.import_marks(state, broken)) == [1]
    assert marks.marked_verses(state, "b", 1).first().verses == [1]


def test_audit_and_check(spark):
    meta = spark.createDataFrame([("a", "H", "E", "s", 1), ("m", "H", "E", "s", 1)], "id string, hebrew string, english string, section string, chapter_count int")
    verses = spark.createDataFrame([("a", 1, 0, 1, "alpha beta gamma delta"), ("a", 1, 1, 3, "nowhere to be found at all")], "id string, ch int, pos int, n int, t string")
    chapters = spark.createDataFrame([("a", 1, ["x"], 1, "f"), ("a", 2, [], 3, "f")], "id string, ch int, verses array<string>, page int, pdf string")
    found = spark.createDataFrame([("a", 1, "f", 1)], "id string, ch int, pdf string, page int")
    pages = spark.createDataFrame([("f", 2, "so Alpha, beta gamma DELTA it is")], "pdf string, page int, text string")
    got = {r.id: r for r in audit.audit_books(meta, chapters, verses, found, [pages]).collect()}
    assert got["m"].status == "MISSING" and got["a"].status == "ISSUES"
    assert got["a"].no_verses == [2] and [tuple(g) for g in got["a"].gaps] == [(1, 3, 2)] and [m.n for m in got["a"].missing_text] == [3]
    assert got["a"].issues[0] == "1 chapter(s) with NO verses: [2]"
    expected = spark.createDataFrame([("a", 3)], "id string, expected int")
    checked = {r.id: r for r in audit.check_books(meta, verses, chapters, expected, pages).collect()}
    assert checked["a"].recovery == 66.7 and checked["a"].errors[0] == "recovery 67% below 70%" and checked["m"].status == "MISSING"


def plain_merge(text, english, direct, freq, stop):
    """The left fold over words with one space between them, in plain Python; tags are left aside."""
    out, joins = [], 0
    for piece in re.split(r"(<[^>]+>)", text):
        if piece.startswith("<") and piece.endswith(">") and len(piece) > 2:
            out.append(piece)
            continue
        tokens, i = re.findall(r"[A-Za-z]+|[^A-Za-z]+", piece), 0
        while i + 2 < len(tokens):
            a, gap, b = tokens[i : i + 3]
            j = a + b
            trap = a[0].isupper() and (len(a) == 1 or a[1:].islower()) and j.lower() not in direct
            if (a.isalpha() and b.isalpha() and gap == " " and not {a.lower(), b.lower()} & stop and not b[0].isupper() and not trap and english(j.lower())
                    and (j.lower() in direct or freq.get(j.lower(), 0) >= 2 or freq.get(a.lower(), 0) <= 2 or freq.get(b.lower(), 0) <= 2) and not (english(a.lower()) and english(b.lower()))):
                tokens[i : i + 3] = [j]
                joins += 1
            else:
                i += 1
        out += tokens
    return "".join(out), joins


def test_soft_wraps_agree_with_a_plain_fold(spark):
    from folioflow.functions import tables

    rnd = random.Random(6)
    syllables = "ka lo mi nu pe ro su ti vu za ed ing s".split()
    direct = {"".join(rnd.choice(syllables[:10]) for _ in range(n)) for n in (1, 2, 2, 2, 2, 3, 3, 3, 3, 3) for _ in range(12)} | {"".join(syllables[:k]) for k in range(2, 11)}

    def english(w):
        return any(w == d or any(w.endswith(x) and len(w) > len(x) + 1 and stem == d for x in ("s", "ed", "ing", "es", "ly", "er", "ies", "ied") for stem in stems_of(w, x)) for d in direct)

    def stems_of(w, x):
        base = w[: -len(x)]
        yield base
        if x in ("ies", "ied"):
            yield base + "y"
        if x in ("ing", "ed"):
            yield base + "e"
            if len(base) >= 2 and base[-1] == base[-2]:
                yield base[:-1]

    stop = sorted(tables.STOP_GLUE)[:3]
    pick = lambda: rnd.choice([*syllables, *syllables, *syllables, "Ka", "Lo", "X", *stop, "<b>", "é", "9"])
    texts = ["".join(pick() + rnd.choice([" ", " ", " ", " ", "", "  ", "\n"]) for _ in range(rnd.choice([0, 1, 5, 40]))) for _ in range(150)]
    texts += [" ".join(syllables[:10]), "x " + " ".join(syllables[:10]) + " y", "the " + "ka lo " * 700]
    freq = {s: rnd.choice([0, 1, 3, 9]) for s in [*syllables, *sorted(direct)]}
    words = spark.createDataFrame([(w,) for w in sorted(direct)], "word string")
    frequency = spark.createDataFrame([(w, n) for w, n in freq.items() if n], "token string, freq long")
    rows = repair.merge_soft_wraps(spark.createDataFrame([*enumerate(texts), (-1, None)], "k int, t string"), "k", "t", words, frequency)
    got = {r.k: (r.t, r.n_soft) for r in rows.collect()}
    assert got.pop(-1) == (None, 0)
    assert {k: plain_merge(t, english, direct, freq, set(tables.STOP_GLUE)) for k, t in enumerate(texts)} == got
    assert max(n for _, n in got.values()) > 4


def test_names_change_to_a_fixed_point(spark):
    from folioflow.functions import tables

    pattern = re.compile(r"\b[A-ZĀ-ɏḀ-ỿ][A-Za-zÀ-ɏḀ-ỿ'’]+[EeĔĕ][Ll]\b")

    def one(m):
        w = m[0]
        return w if w.lower() in tables.EL_SUFFIX_EXCEPTIONS else w[:-2] + ("A" if w[-2].isupper() else "a") + ("L" if w[-1].isupper() else "l")

    def plain(t):
        while (new := pattern.sub(one, t)) != t:
            t = new
        return t

    rnd = random.Random(1)
    parts = ["Yael", "el", "Uriel", "’", "'", "ĕl", "EL", " ", "wheel", "Wheel", "x", "Gabri", "-", ".", "Èl", "él", "9", *(w.title() for w in sorted(tables.EL_SUFFIX_EXCEPTIONS)[:6])]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 9))) for _ in range(1000)] + ["Yael’el’el’el’el’el"]
    got = [r.o for r in spark.createDataFrame([(t,) for t in texts], "t string").select(translit.el_suffix(F.col("t")).alias("o")).collect()]
    assert got == list(map(plain, texts))


def test_containment_is_a_substring_test(spark):
    rnd = random.Random(2)
    words = ["a", "ab", "nation", "nations", "the", "of", "x", "bb"]
    make = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    needles = [make(rnd.choice([0, 1, 1, 2, 2, 3, 4, 5, 6, 9, 14])) for _ in range(60)] + ["n", "tion", "nation of the", "s of"]
    hays = [make(rnd.choice([0, 1, 3, 12, 40])) for _ in range(40)] + [needles[k] + "s and more" for k in range(10)] + [""]
    n, h = spark.createDataFrame(list(enumerate(needles)), "i int, needle string"), spark.createDataFrame([*enumerate(hays), (-1, None)], "j int, hay string")

    def windows_of(t):
        w = t.split()
        return [" ".join(w)] if 0 < len(w) < 4 else [" ".join(w[s : s + 8]) for s in range(0, max(1, len(w) - 4), 4)] if w else []

    for short in (True, False):
        expected = {(i, j) for i, t in enumerate(needles) if short or len(t.split()) >= 4 for j, x in enumerate(hays) if any(w in " ".join(x.split()) for w in windows_of(t))}
        got = [(r.i, r.j) for r in joins.contains_window(n, h, "needle", "hay", short=short).collect()]
        assert set(got) == expected and len(got) == len(expected)
    with pytest.raises(ValueError, match="both sides"):
        joins.contains_window(n, n, "needle", "needle")


def test_values_kept_by_key(spark):
    store = spark.createDataFrame([("a", "1"), ("b", "{")], "key string, value string")
    changes = spark.createDataFrame([("a", None, 3), ("b", '{"x": 2}', 1), ("c", "[", 2), ("c", "{}", 1)], "key string, value string, seq int")
    kept = marks.keep_value(store, changes)
    assert {r.key: r.value for r in kept.collect()} == {"a": "1", "b": '{"x": 2}', "c": "["}
    assert {r.key: r.x for r in kept.select("key", marks.kept_value(F.col("value"), "x int").x.alias("x")).collect()} == {"a": None, "b": 2, "c": None}


def test_soft_wraps_of_a_long_text_are_one_pass_with_looked_up_facts(spark):
    facts = {"moun": (False, False, 1), "tains": (False, False, 1), "mountains": (True, True, 0), "mountainsed": (False, True, 0), "aram": (True, True, 9), "is": (True, True, 9), "aramis": (True, True, 1)}
    stop = frozenset(["is"])
    assert repair.merge_tokens("the moun tains <b>Moun tains</b> moun  tains Aram is moun Tains", facts, stop) == ("the mountains <b>Mountains</b> moun  tains Aram is moun Tains", 2)
    assert repair.merge_tokens("Moun tains ed", facts, stop) == ("Mountains ed", 1)  # a capital needs the joined word itself
    assert repair.merge_tokens("moun tains ed", facts, stop) == ("mountainsed", 2)
    assert repair.merge_tokens("moun tains " * 50_000, facts, stop) == ("mountains " * 50_000, 50_000)
    texts = spark.createDataFrame([(1, "moun tains")], "k int, t string")
    rows = repair.merge_soft_wraps(texts, "k", "t", spark.createDataFrame([("mountains",)], "word string"), spark.createDataFrame([("moun", 1)], "token string, freq long"))
    assert "lambdafunction" not in rows._jdf.queryExecution().optimizedPlan().toString().split("ArrowEvalPython")[0]
    assert tuple(rows.first()) == (1, "mountains", 1)


def test_runs_of_words_leave_haystacks_only_where_a_needle_may_have_them(spark):
    rnd = random.Random(3)
    vocabulary = [a + b for a in "abcdefgh" for b in "ijklm"]
    line = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    hay = [line(rnd.randint(0, 60)) for _ in range(300)] + ["", None, "Ai, BJ! ck"]
    cut = lambda t, n: " ".join(t.split()[k : k + n]) if (k := rnd.randint(0, max(0, len(t.split()) - n))) >= 0 else ""
    needles = [cut(rnd.choice(hay[:300]), n) + rnd.choice(["", "", "x"]) for n in range(1, 14) for _ in range(6)] + ["", None]
    n, h = spark.createDataFrame([*enumerate(needles)], "i int, n string"), spark.createDataFrame([*enumerate(hay)], "j int, t string")

    def windows_of(t):
        w = t.split()
        return [" ".join(w[i : i + 8]) for i in range(0, max(1, len(w) - 4), 4)] if len(w) >= 4 else [" ".join(w)] if w else []

    norm = lambda t: " ".join(re.sub(r"[^\w\s]", " ", (t or "").lower()).split())
    expected = {(i, j) for i, a in enumerate(needles) for j, b in enumerate(hay) if any(x in norm(b) for x in windows_of(norm(a)))}
    assert {(r.i, r.j) for r in joins.contains_window(n, h, "n", "t").collect()} == expected
    tried = spark.createDataFrame([(0, 4, 5)], "nid int, k int, key long")
    far = spark.createDataFrame([(k, line(100)) for k in range(100)], "hid long, t string")
    assert joins._runs_met(far, tried, [4]).count() < 10  # of 9,700 runs


def test_windows_of_a_verse_are_cut_from_words_normalized_once(spark):
    pages = spark.createDataFrame([("f", 1, "aa bb cc dd ee ff gg hh"), ("f", 2, "x")], "pdf string, page int, text string")
    texts = ["Áa, bb cc dd ee ff gg hh", "aa bb cc dd ee ff gg ii", "bb cc", None, ""]
    sampled = spark.createDataFrame([("b", k, 1, t, "f", 1, 2) for k, t in enumerate(texts)], "id string, ch int, n int, t string, pdf string, first int, last int")
    for short, lost in ((False, [1]), (True, [1, 3, 4])):
        rows = audit._not_found(sampled, [pages], margin=5, short=short)
        assert sorted(r.ch for r in rows.collect()) == lost
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("translate(") == 2  # of the verses and of the pages


def test_modes_are_counted_in_shares_of_bounded_size(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(rnd.randrange(3000), rnd.randrange(1, 5), float(rnd.randrange(50))) for _ in range(20_000)]
    path = str(tmp_path / "rows")
    spark.createDataFrame(rows, "k long, line int, q double").write.parquet(path)
    expected = {}
    for k in {r[0] for r in rows}:
        values = [int(q // 10) for _, _, q in sorted(r for r in rows if r[0] == k)]
        expected[k] = max(values, key=lambda v: (values.count(v), -values.index(v)))
    table = spark.read.parquet(path)
    got = aggregates.first_mode(table, ["k"], F.floor(F.col("q") / 10).cast("int"), ["line", "q"])
    assert {r.k: r["mode"] for r in got.collect()} == expected
    # Not by the session's number of partitions, of which a task's memory would grow with the table.
    assert got.rdd.getNumPartitions() == 1
    assert aggregates.shares(table, ["k"], 4 << 10).rdd.getNumPartitions() > 8
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_body_size_of_a_full_tie_is_the_smallest_whatever_the_order_of_rows(spark):
    sizes = [6.0, 8.0, 10.0]
    for order in (sizes, sizes[::-1], [8.0, 6.0, 10.0]):
        chars = spark.createDataFrame([("f", 1, 3, s) for s in order] + [("f", 1, 4, s) for s in order], "pdf string, page int, pos int, size double").coalesce(1)
        assert layout.body_size(chars).collect() == [("f", 1, 6.0)]
