from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from folioflow.llm import quality as Q


def corpus(n=400):
    rnd = random.Random(1)
    voc = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9))) for _ in range(300)]
    good = lambda: " ".join(rnd.choice(voc) for _ in range(rnd.randint(30, 200))).capitalize() + "."
    bad = [lambda: " ".join([rnd.choice(voc)] * rnd.randint(30, 90)), lambda: good().upper().replace(" ", "!! "), lambda: good().replace(" ", "### ")]
    return [(k, good() if k % 4 else rnd.choice(bad)(), int(k % 4 > 0)) for k in range(n)]


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame([(k, t, "en", 0.0) for k, t, _ in rows] + [(900, None, None, None), (901, "", "x", 1.0), (5, "repeated id", "x", 1.0)], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(k, y, 0) for k, _, y in rows] + [(901, None, 0), (5, 1, 0), (5000, 1, 0)], "doc_id long, quality int, toxic int")
    model = Q.train(docs, labels)
    got = {}
    for r in Q.score(docs, model).collect():
        got.setdefault(r.id, r.score)
    test = [(k, y) for k, _, y in rows if zlib.crc32(str(k).encode()) % 3 == 1]
    assert sum((got[k] >= 0.5) == (y == 1) for k, y in test) / len(test) > 0.97
    assert all(0 <= s <= 1 for s in got.values()) and len(model.pairs) == 6
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() >= 290
    assert Q.train(docs, labels).score(np.zeros((1, len(Q.FEATURES)))) == model.score(np.zeros((1, len(Q.FEATURES))))


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in Q.score(docs, Q.train(docs, none)).collect()] == [0.5, 0.5]
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert Q.keep_good(docs, one).count() == 2
    assert Q.keep_good(docs.limit(0), one).count() == 0


def test_features_of_empty_and_long_texts():
    x = Q.features([b"", b"\n\n", b"word", "é ".encode() * 3_000_000])
    assert np.isfinite(x).all() and (x[0] == 0).all()


def test_tables_fit_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.uniform(-1, 1, (4000, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    model = Q.AdditiveModel(pairs=1).fit(x, y)
    assert model.pairs == [(0, 1)]
    assert ((model.score(x) >= 0.5) == y).mean() > 0.9


def test_held_out_rule(spark):
    rows = spark.range(50).select("id", Q.held_out("id").alias("h")).collect()
    assert [r.h for r in rows] == [zlib.crc32(str(r.id).encode()) % 3 == 1 for r in rows]


def plain_features(text):
    """The features of a text, one after the other."""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    b, words = text.encode(), [x.encode() for x in w]
    share = lambda chars: sum(c in chars for c in b) / max(1, len(b))
    upper, lower = (sum(lo <= c <= hi for c in b) for lo, hi in ((65, 90), (97, 122)))
    n, lines, times = max(1, len(w)), b.split(b"\n"), Counter(words)
    symbols, known = b"#$%&*@^~`+=<>_/\\", b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 \t\r\x0b\x0c.,;:?'\"-!#$%&*@^~`+=<>_/\\|\n"
    stops = b".,;:?'\"-"
    return [
        math.log1p(len(b)), math.log1p(len(w)), sum(map(len, words)) / n, math.log1p(max(map(len, words), default=0)), upper / max(1, upper + lower), share(b"0123456789"), share(stops), share(b"!"), share(symbols), share(b"|"),
        b.count(b"\n") / max(1, len(b)), sum(c >= 0x80 for c in b) / max(1, len(b)), len(times) / n, max(times.values(), default=0) / n, sum(x == y for x, y in zip(words, words[1:], strict=False)) / n, 1 - len(set(lines)) / len(lines),
        sum(65 <= x[0] <= 90 for x in words) / n, sum(x[-1:] in [bytes([c]) for c in b"!" + symbols + b"|"] for x in words) / n, sum(c < 0x80 and c not in known for c in b) / max(1, len(b)),
    ]


def plain_score(model, x):
    z = model.intercept
    for v, edges, table in zip(x, model.edges, model.tables, strict=True):
        z += table[sum(e < v for e in edges)]
    for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
        z += table[sum(e < x[a] for e in model.coarse[a])][sum(e < x[b] for e in model.coarse[b])]
    return 1 / (1 + math.exp(-z))


def test_query_scores_as_plain_look_ups_do(spark):
    data = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    model = Q.train(docs, labels)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = {r.doc_id: r for r in Q.op2_quality(spark, data).collect()}
    assert got.keys() == texts.keys()
    for k, t in texts.items():
        x = plain_features(t)
        assert np.allclose(x, Q.features([t.encode()])[0], atol=1e-12), (k, x)
        assert abs(got[k].score - plain_score(model, Q.features([t.encode()])[0])) < 1e-9 and got[k].predicted == (got[k].score >= 0.5)
        assert got[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1)


def test_of_several_texts_of_an_id_one_is_chosen(spark):
    docs = [(1, "a b c d"), (1, "E!! F!!"), (2, "g h"), (3, "| | |"), (4, None)]
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 0)], "doc_id long, quality int")
    at = np.zeros((1, len(Q.FEATURES)))
    scores = {float(Q.train(spark.createDataFrame(rows, "doc_id long, text string"), labels).score(at)[0]) for rows in (docs, docs[::-1])}
    assert len(scores) == 1
