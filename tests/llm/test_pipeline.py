from __future__ import annotations

import math
import os

import duckdb
import pytest

import corpus_pipeline
from folioflow.llm import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


def plain(v):
    return ("nan" if math.isnan(v) else repr(round(v, 9))) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = duck.execute(registry.SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())


def test_every_operator_has_its_query():
    assert {n.split("_")[0] for n in registry.QUERIES} == {f"op{k}" for k in range(1, 11)}


def test_the_pipeline_agrees_with_its_parts(spark, duck):
    from tests.llm.test_dedup import components, fingerprint
    from tests.llm.test_decontaminate import brute
    from tests.llm.test_tokens_warc_secrets import base_spans

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, DATA).collect(), docs.schema)
        rows[name] = before, {r.doc_id: r for r in docs.collect()}
    good, bad = ({r[0] for r in duck.execute(f"SELECT doc_id FROM labels WHERE quality = {k}").fetchall()} for k in (1, 0))
    before, after = rows["quality"]
    assert not bad & after.keys() and good <= after.keys() | (good - before.keys())
    before, after = rows["near_duplicates"]
    ids = sorted(before)
    prints = [fingerprint(before[k].text) for k in ids]
    label = components(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 6])
    assert set(after) == {ids[k] for k in set(label)}
    before, after = rows["decontamination"]
    items = duck.execute("SELECT item_id, text FROM benchmark").fetchall()
    assert set(after) == {k for k, (_, hit, _) in zip(before, brute([r.text for r in before.values()], items, 10), strict=True) if not hit}
    before, after = rows["secrets"]
    assert before.keys() == after.keys() and all(not base_spans(r.text) and r.n_chars == len(r.text) for r in after.values())
    assert all(before[k].text == r.text for k, r in after.items() if "[SECRET]" not in r.text)
    packed = corpus_pipeline.run(spark, DATA).collect()
    assert sum(r.length for r in packed) == sum(len(r.text.encode()) for r in after.values()) and {r.doc_id for r in packed} == set(after)


def test_every_stage_takes_odd_rows(spark):
    schema = spark.read.parquet(f"{DATA}/documents.parquet").schema
    words = lambda seed: " ".join(f"{seed}{k * 7919 % 997}" for k in range(120))
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, None, "en", None, 0), (3, "word " * 300_000, "en", "s", 1), (None, words("a"), "en", "s", 1), (None, words("b"), "en", "s", 1),
            (7, words("c"), "en", "s", 1), (7, words("d"), None, "s", 1), (7, words("d"), None, "s", 1), (8, words("e") + " " + item, "en", "s", 1), (9, words("f") + " password=hunter2222", "en", "s", 1)]
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.createDataFrame(rows, schema)
    ids = lambda df: sorted((r.doc_id, r.text or "") for r in df.collect() if r.doc_id is not None)
    for df in (docs, spark.createDataFrame([], schema)):
        for name, stage in stages.items():
            out = stage(spark, df, DATA)
            assert name == "packing" or out.columns == df.columns
            n = out.count()
            assert n == 0 if df is not docs else n >= 1
    # Rows without words are one group, of which the smallest id stays, as are the two equal ones of 7; all else is apart.
    kept = stages["near_duplicates"](spark, docs, DATA)
    assert ids(kept) == sorted((k, t or "") for k, t, *_ in {rows[1], rows[4], rows[7], rows[8], rows[10], rows[11]}) and kept.where("doc_id IS NULL").count() == 2
    assert sorted(map(str, stages["decontamination"](spark, docs, DATA).collect())) == sorted(str(r) for r in docs.collect() if r.doc_id != 8)
    masked = stages["secrets"](spark, docs, DATA).collect()
    assert len(masked) == len(rows) and [r.text for r in masked if r.doc_id == 9] == [words("f") + " [SECRET]"] and sum(r.text is None for r in masked) == 2
    assert stages["packing"](spark, docs, DATA).select("doc_id").distinct().count() == 7
    good = stages["quality"](spark, docs, DATA)
    by_text: dict = {}
    for r in docs.collect():
        by_text.setdefault(r.text or "", []).append(str(r))
    stay = sorted(map(str, good.collect()))
    assert all(sorted(x for x in stay if x in same) in ([], sorted(same)) for same in by_text.values())
