"""PDF pages as rows. The readers are optional packages, imported only when a scan runs."""

from __future__ import annotations

import io
import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Pages whose texts go on together.
PAGES = 256
PAGE_TEXT = "pdf string, page int, text string"
PAGE_CHARS = "pdf string, page int, pos int, text string, x0 double, x1 double, top double, bottom double, size double, width double, page_width double, page_height double"


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).selectExpr("element_at(split(path, '/'), -1) AS pdf", "content")


def read_page_text(spark: SparkSession, path: str) -> DataFrame:
    """(pdf, page, text) with pypdf; pages count from 1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pypdf import PdfReader

        for batch in batches:
            for pdf, content in zip(batch["pdf"], batch["content"], strict=True):
                texts = (page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages)
                for first in itertools.count(1, PAGES):
                    part = list(itertools.islice(texts, PAGES))
                    if not part:
                        break
                    yield pd.DataFrame({"pdf": pdf, "page": range(first, first + len(part)), "text": part})

    return _files(spark, path).mapInPandas(run, PAGE_TEXT)


def read_page_chars(spark: SparkSession, path: str) -> DataFrame:
    """The characters of each page with their places, with pdfplumber."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pdfplumber

        for batch in batches:
            for pdf, content in zip(batch["pdf"], batch["content"], strict=True):
                with pdfplumber.open(io.BytesIO(content)) as document:
                    for k, page in enumerate(document.pages, 1):
                        yield pd.DataFrame([(pdf, k, i, c["text"], c["x0"], c["x1"], c["top"], c["bottom"], c["size"], c["width"], page.width, page.height) for i, c in enumerate(page.chars)],
                                           columns=[x.split()[0] for x in PAGE_CHARS.split(", ")])

    return _files(spark, path).mapInPandas(run, PAGE_CHARS)


def page_range_text(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """Of ``ranges`` (key, pdf, first, last) the joined page texts, in page order; pages that don't exist are skipped."""
    from pyspark.sql import functions as F

    wanted = ranges.select("key", "pdf", F.explode(F.sequence("first", F.greatest("first", "last"))).alias("page"))
    joined = wanted.join(pages, ["pdf", "page"]).groupBy("key").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p.text), "\n").alias("text"))
    return ranges.select("key").join(joined, "key", "left").select("key", F.coalesce("text", F.lit("")).alias("text"))
