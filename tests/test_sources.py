from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from folioflow.plans import etl
from folioflow.sources import corpus, reports
from folioflow.sources.pdf import page_range_text

#: A folder of book files to hold against known totals.
SAMPLE = os.environ.get("FOLIOFLOW_SAMPLE_BOOKS", "")


@pytest.fixture()
def books(spark, tmp_path):
    chapter = lambda page, *texts: {"verses": [{"n": k, "t": t} for k, t in enumerate(texts, 1)], "page": page, "pdf": "f"}
    chapters = {"1": chapter(3, "one <b>", "two"), "10": chapter(9, "ten"), "2": chapter(4)}
    (tmp_path / "a.json").write_text(json.dumps({"id": "a", "hebrew": "H", "english": "E", "section": "s", "chapter_count": 10, "chapters": chapters}))
    return corpus.read_books(spark, str(tmp_path))


def test_flat_and_nested(spark, books):
    verses = corpus.verses(books)
    assert [(r.ch, r.pos, r.n) for r in verses.orderBy("ch", "pos").collect()] == [(1, 0, 1), (1, 1, 2), (10, 0, 1)]
    again = corpus.nest(verses, books.select("id", "hebrew", "english", "section", "chapter_count")).first()
    assert [v.t for v in again.chapters["1"].verses] == ["one <b>", "two"] and "2" not in again.chapters


def test_write_and_rewrite(spark, books, tmp_path):
    corpus.write_books(books, str(tmp_path / "out"))
    assert corpus.read_books(spark, str(tmp_path / "out/*")).count() == 1
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "id string, n int, t string")
    path = str(tmp_path / "t")
    old.write.partitionBy("id").parquet(path)
    before = {p.parent.name: p.name for p in (tmp_path / "t").glob("id=*/*.parquet")}
    corpus.rewrite_changed(spark, old, old.withColumn("t", F.when(F.col("id") == "a", "z").otherwise(F.col("t"))), path, ["id", "n"], "t", "id")
    after = {p.parent.name: p.name for p in (tmp_path / "t").glob("id=*/*.parquet")}
    assert after["id=b"] == before["id=b"] and after["id=a"] != before["id=a"]


def test_index(spark, tmp_path):
    anchor = {"pdf": "f", "page": 1, "printed": 1}
    (tmp_path / "i.json").write_text(json.dumps({"books": [{"id": "b", "hebrew": "H", "english": "E", "section": "s", "chapter_count": 2, "chapters": {"2": anchor, "1": anchor}}, {"id": "a", "chapters": {}}]}))
    index = corpus.read_index(spark, str(tmp_path / "i.json"))
    assert [r.id for r in index.orderBy("ord").collect()] == ["b", "a"]
    assert corpus.anchors(index).count() == 2
    corpus.write_index(index, str(tmp_path / "w"))
    assert [r.id for r in corpus.read_index(spark, str(tmp_path / "w")).orderBy("ord").collect()] == ["b", "a"]


def test_read_chapter(books):
    rows = etl.read_chapter(books, "a", 1).orderBy("n").collect()
    assert [(r.n, r.html, r.prev_ch, r.next_ch, r.is_prose) for r in rows] == [(1, "one &lt;b&gt;", None, 2, False), (2, "two", None, 2, False)]
    assert etl.read_chapter(books, "a", 3).count() == 0


def test_page_ranges(spark):
    pages = spark.createDataFrame([("f", 1, "a"), ("f", 2, "b"), ("g", 1, "c")], "pdf string, page int, text string")
    ranges = spark.createDataFrame([(1, "f", 1, 5), (2, "f", 7, 8)], "key int, pdf string, first int, last int")
    assert {r.key: r.text for r in page_range_text(pages, ranges).collect()} == {1: "a\nb", 2: ""}


def test_extract_takes_all_chapters_of_a_testament(spark):
    text = "1 1 The copy of the words of Reuben, as 2 he spake. 2 1 And now 2 hear"
    pages = spark.createDataFrame([("t", 1, text + "Page | 1"), ("t", 2, "3 me. 4 1 But flee")], "pdf string, page int, text string")
    anchors = spark.createDataFrame([("testament-reuben", 1, "t", 5), ("testament-gad", 1, "t", 6), ("none", 1, "t", 1)], "id string, ch int, pdf string, page int")
    grammars = spark.createDataFrame([("testament-reuben", "testament", "", ""), ("testament-gad", "testament", "", "")], "id string, grammar string, hebrew string, english string")
    rows = etl.extract(pages, anchors, grammars)
    got = {(r.id, r.ch, r.page): [tuple(v) for v in r.verses] for r in rows.collect()}
    assert got == {("testament-reuben", 1, 5): [(1, "The copy of the words of Reuben, as"), (2, "he spake.")], ("testament-reuben", 2, 5): [(1, "And now"), (2, "hear"), (3, "me.")],
                   ("testament-reuben", 4, 5): [(1, "But flee")], ("none", 1, 1): []}
    index, listed = etl.reindex(spark.createDataFrame([("testament-reuben", 1), ("testament-gad", 1), ("none", 8)], "id string, chapter_count int"), anchors, rows, grammars)
    assert sorted(map(tuple, index.collect())) == [("none", 8), ("testament-gad", 1), ("testament-reuben", 3)]
    assert sorted(map(tuple, listed.collect())) == [("none", 1, "t", 1), ("testament-gad", 1, "t", 6)] + [("testament-reuben", c, "t", 5) for c in (1, 2, 4)]


def test_extract(spark):
    pages = spark.createDataFrame([("f", 1, "GENESIS 1\n1 In the 2And"), ("f", 2, "GENESIS 2\n3Then"), ("f", 3, "Appendix\n4 Not this"), ("e", 1, "Chapter 1\n1 one 2 two")], "pdf string, page int, text string")
    found = spark.createDataFrame([("gen", 1, "f", 1), ("en", 1, "e", 1), ("un", 1, "e", 1)], "id string, ch int, pdf string, page int")
    grammars = spark.createDataFrame([("gen", "primary", "Genesis", None), ("en", "enoch", "X", "Y"), ("un", "unknown", "X", "Y")], "id string, grammar string, hebrew string, english string")
    got = {r.id: [tuple(v) for v in r.verses] for r in etl.extract(pages, found, grammars).collect()}
    assert got == {"gen": [(1, "In the"), (2, "And"), (3, "Then")], "en": [(1, "one"), (2, "two")], "un": []}


def test_reports(spark):
    kinds = "id string, hebrew string, english string, status string, no_verses array<int>, gaps array<struct<ch:int,got:int,expected:int>>, missing_text array<struct<ch:int,n:int,text:string,pdf:string,first:int,last:int>>"
    df = spark.createDataFrame([("a", "H", "E", "ISSUES", [2], [(1, 3, 2)], [(1, 3, "t", "f", 1, 2)]), ("b", "H", "E", "OK", [], [], [])], kinds)
    text = reports.audit_markdown(df)
    assert "2 books: 1 OK, 1 with issues." in text and "ch1 (v3 for v2)" in text
    assert tuple(reports.summary_line(df).first()) == (2, 1, 1)
    data = spark.createDataFrame([("</script>",)], "x string")
    assert reports.bundle("<s>__D__</s>", {}, {"__D__": data}) == '<s>[{"x":"<\\/script>"}]</s>'


@pytest.mark.skipif(not SAMPLE, reason="FOLIOFLOW_SAMPLE_BOOKS names no folder")
def test_sample_corpus(spark):
    from folioflow.operators import aggregates, windows

    books = corpus.read_books(spark, SAMPLE)
    chapters, verses = etl.flat(books)
    verses = verses.cache()
    assert (books.count(), chapters.count(), verses.count()) == (50, 273, 3421)
    assert windows.first_gap(verses, ["id", "ch"]).count() == 58
    top = aggregates.token_frequency(verses, "t").orderBy(F.desc("freq")).limit(3).collect()
    assert [(r.token, r.freq) for r in top] == [("the", 5371), ("and", 4900), ("of", 3340)]
    tags = verses.agg(*[F.sum(F.size(F.regexp_extract_all("t", F.lit(p), F.lit(0)))) for p in ('<span class="dn">', '<span class="hwhy">', "</span>")]).first()
    assert tuple(tags) == (1782, 269, 2051)


@pytest.fixture()
def readers(spark, tmp_path):
    """Stand-ins for the optional readers: a file's pages are lines, its first word fails."""
    (tmp_path / "pypdf.py").write_text(
        "class Page:\n    def __init__(self, t): self.t = t\n    def extract_text(self): return self.t or None\n"
        "class PdfReader:\n    def __init__(self, f): self.pages = [Page(t) for t in f.read().decode().split('\\n')]\n")
    (tmp_path / "pdfplumber.py").write_text(
        "class Page:\n    width, height = 100.0, 200.0\n    def __init__(self, t):\n"
        "        self.chars = [dict(text=c, x0=float(i), x1=i + 1.0, top=2.0, bottom=3.0, size=9.0, width=1.0) for i, c in enumerate(t)]\n"
        "class Document:\n    def __init__(self, f): self.pages = [Page(t) for t in f.read().decode().split('\\n')]\n"
        "    def __enter__(self): return self\n    def __exit__(self, *a): pass\n"
        "def open(f): return Document(f)\n")
    for name in ("pypdf.py", "pdfplumber.py"):
        spark.sparkContext.addPyFile(str(tmp_path / name))
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "a.pdf").write_text("\n".join(f"page {k}" for k in range(1, 601)))
    (folder / "b.pdf").write_text("xy\n\nz")
    return str(folder)


def test_pages_of_files(spark, readers):
    from folioflow.sources import pdf

    texts = {(r.pdf, r.page): r.text for r in pdf.read_page_text(spark, readers).collect()}
    assert texts == {("a.pdf", k): f"page {k}" for k in range(1, 601)} | {("b.pdf", 1): "xy", ("b.pdf", 2): "", ("b.pdf", 3): "z"}
    chars = pdf.read_page_chars(spark, readers + "/b.pdf").orderBy("page", "pos").collect()
    assert [(r.pdf, r.page, r.pos, r.text, r.x0, r.page_width) for r in chars] == [("b.pdf", 1, 0, "x", 0.0, 100.0), ("b.pdf", 1, 1, "y", 1.0, 100.0), ("b.pdf", 3, 0, "z", 0.0, 100.0)]


def test_rewritten_partitions_and_notes(spark, tmp_path):
    path = str(tmp_path / "books")
    old = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "id string, n int, t string")
    old.write.partitionBy("id").parquet(path)
    before = {p.name for p in (tmp_path / "books" / "id=b").iterdir()}
    new = spark.createDataFrame([("a", 1, "X"), ("a", 2, "y"), ("b", 1, "z")], "id string, n int, t string")
    corpus.rewrite_changed(spark, old, new, path, ["id", "n"], "t", "id")
    assert sorted((r.id, r.n, r.t) for r in spark.read.parquet(path).collect()) == [("a", 1, "X"), ("a", 2, "y"), ("b", 1, "z")]
    assert {p.name for p in (tmp_path / "books" / "id=b").iterdir()} == before
    corpus.write_notes(spark.createDataFrame([("T", "b", 1)], "term string, body string, page int"), str(tmp_path / "notes"))
    assert [tuple(r) for r in spark.read.schema("term string, body string, page int").json(str(tmp_path / "notes")).collect()] == [("T", "b", 1)]
