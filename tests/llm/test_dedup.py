from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from folioflow.llm import _graph, _text, embed_dedup, simhash, suffix_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(n, links):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


@pytest.mark.parametrize("limit", [10**6, 0])
def test_components(spark, limit):
    rnd = random.Random(3)
    edges = [(k, k + 1) for k in range(100, 130)] + [(rnd.randrange(60), rnd.randrange(60)) for _ in range(40)] + [(7, 7)]
    expected = components(140, edges)
    df = spark.createDataFrame([*edges, (3, None)], "a long, b long")
    got = {r.node: r.component for r in _graph.connected_components(df, limit).collect()}
    assert all(got[k] == expected[k] for e in edges for k in e)
    assert _graph.connected_components(df.limit(0), limit).count() == 0


def test_xxh64_agrees_with_the_library():
    rnd = random.Random(1)
    parts = [rnd.randbytes(n) for n in [*range(70), 300, 1000]]
    buf = np.frombuffer(b"".join(parts) + bytes(16), np.uint8)
    end = np.cumsum([len(p) for p in parts])
    assert _text.xxh64(buf, end - [len(p) for p in parts], end).tolist() == [xxhash.xxh64_intdigest(p, seed=42) for p in parts]


def fingerprint(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if x]
    s = [" ".join(w[k : k + 2]) for k in range(len(w) - 1)] if len(w) > 1 else w
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_fingerprints():
    rnd = random.Random(2)
    texts = ["", " \t\n", "One", "a b", "A  b\x0bc\r\nd", "é x ÉÉ", "x" * 500 + " y"] + ["".join(rnd.choice("abC é日\t\n  ") for _ in range(rnd.randint(0, 200))) for _ in range(200)]
    assert [int(x) for x in simhash.fingerprints([t.encode() for t in texts])] == [fingerprint(t) for t in texts]


@pytest.mark.parametrize(("list_rows", "max_bits"), [(2048, 6), (3, 6), (2048, 7)])
def test_links_agree_with_all_pairs(spark, list_rows, max_bits):
    rnd = random.Random(4)
    fps = {rnd.getrandbits(64) for _ in range(60)} | {0, 1}
    for f in list(fps):
        for _ in range(3):
            g = f
            for b in rnd.sample(range(64), rnd.choice([1, 5, 6, 7, 8])):
                g ^= 1 << b
            fps.add(g)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    weight = [rnd.choice([1, 1, 3]) for _ in fps]
    links = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= max_bits]
    near = [0] * len(fps)
    for a, b in links:
        near[a] += weight[b]
        near[b] += weight[a]
    rows = simhash.class_links(spark.createDataFrame(list(zip(signed, weight, strict=True)), "fp long, n long"), max_bits, list_rows).collect()
    at = {f: k for k, f in enumerate(signed)}
    got = [0] * len(fps)
    for r in rows:
        if r.b is None:
            got[at[r.a]] += r.near
    assert got == near
    assert components(len(fps), [(at[r.a], at[r.b]) for r in rows if r.b is not None]) == components(len(fps), links)


def test_simhash_of_odd_rows(spark):
    base = " ".join(f"word{k}" for k in range(200))
    docs = spark.createDataFrame([(5, base, "a"), (3, base, "b"), (9, base + " more", "c"), (7, None, None), (8, "", "d"), (1, "other text here", "e"), (1, "other text here", "f"), (None, base, "g")], "doc_id long, text string, fp string")
    got = {}
    for r in simhash.near_duplicates(docs).collect():
        got.setdefault(r.id, []).append((r.n_near, r.component_id))
    assert got[5] == got[3] == got[9] == [(3, 3)] and got[None] == [(3, 3)]
    assert got[7] == got[8] == [(1, 7)] and got[1] == [(1, 1), (1, 1)]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 7]
    assert simhash.keep_one(docs.limit(0)).count() == simhash.near_duplicates(docs.limit(0)).count() == 0


def test_one_row_of_each_component_stays_whatever_the_ids(spark):
    rnd = random.Random(8)
    texts = [" ".join(rnd.choice("abcdefghij") * rnd.randint(1, 9) + str(rnd.randrange(500)) for _ in range(150)) for _ in range(12)]
    # Distinct texts without an id, exact and near copies of them, and ids that two components share.
    rows = [(None, t) for t in texts[:6]] + [(None, texts[0]), (None, texts[1] + " more"), (20, texts[2])]
    rows += [(1, texts[6]), (1, texts[7]), (1, texts[7]), (2, texts[7]), (2, texts[8]), (3, texts[9]), (0, texts[9] + " more"), (0, texts[10]), (None, texts[10]), (None, None), (None, "")]
    prints = [fingerprint(t) for _, t in rows]
    label = components(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 6])
    least = {}
    for k, (i, _) in enumerate(rows):
        least[label[k]] = min(least.get(label[k], (True, 0)), (i is None, i or 0))
    assert len(least) == 12
    of = dict(zip(rows, label, strict=True))
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame([(i, t, f"s{k}") for k, (i, t) in enumerate(order)], "doc_id long, text string, source string")
        got = [(r.doc_id, r.text) for r in simhash.keep_one(docs).collect()]
        assert sorted(of[r] for r in got) == sorted(least)
        assert all((i is None, i or 0) == least[of[i, t]] for i, t in got)


def test_columns_of_any_name_pass_through(spark):
    rnd = random.Random(12)
    text = lambda: " ".join(str(rnd.randrange(10**6)) for _ in range(60))
    texts = [text() for _ in range(4)]
    rows = [(None, texts[0], 1, 2, 3), (None, texts[1], 4, 5, 6), (7, texts[2], 7, 8, 9), (7, texts[3], 10, 11, 12), (7, texts[3], 10, 11, 12), (7, texts[3], 10, 11, 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int, n int, __n int")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.distinct().collect()))
    spans_of = spark.createDataFrame([(7, 0, 2)], "id long, start_word long, end_word long")
    odd = spark.createDataFrame([(7, "a b c", 1, 2), (None, "a b", 3, 4), (8, None, 5, 6)], "doc_id long, text string, span_id int, spans int")
    assert sorted(map(str, suffix_dedup.drop_spans(odd, spans_of).collect())) == sorted(map(str, spark.createDataFrame([(7, "c", 1, 2), (None, "a b", 3, 4), (8, None, 5, 6)], odd.schema).collect()))


def test_query_links_as_all_pairs_do(spark):
    data = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect())
    prints = [fingerprint(t) for _, t in docs]
    links = [(a, b) for a in range(len(docs)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 6]
    label, near = components(len(docs), links), [0] * len(docs)
    for a, b in links:
        near[a] += 1
        near[b] += 1
    expected = [(k, f"{p:016x}", n, docs[c][0]) for (k, _), p, n, c in zip(docs, prints, near, label, strict=True)]
    got = simhash.op9_simhash(spark, data).select("doc_id", "fingerprint", "n_near", "component_id").collect()
    assert sorted(map(tuple, got)) == expected


def test_shared_bytes():
    rnd = random.Random(13)
    x = [rnd.getrandbits(64) & sum(0xFF << 8 * p for p in range(8) if rnd.random() < 0.5) for _ in range(500)] + [0, 0x80, 0x8000000000000000, (1 << 64) - 1]
    assert simhash.shared_bytes(np.array(x, np.uint64)).tolist() == [sum(1 << p for p in range(8) if not v >> 8 * p & 0xFF) for v in x]


def test_hot_keys_are_joined_like_others(spark):
    from folioflow.llm._shared import join_counted

    rows = spark.createDataFrame([(k % 3 if k % 2 else k, k) for k in range(4000)], "key long, v long")
    by_key = rows.groupBy("key").count().withColumnRenamed("count", "n")
    got = join_counted(rows, by_key, "key", "n")
    counts = {r.key: r.n for r in by_key.collect()}
    assert max(counts.values()) > 600 and sorted(map(tuple, got.select("key", "v", "n").collect())) == sorted((r.key, r.v, counts[r.key]) for r in rows.collect())
    assert join_counted(rows.limit(0), by_key.limit(0), "key", "n").count() == 0


def test_embeddings_agree_with_all_pairs(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 8))
    x = np.concatenate([x, x[:20] + rng.normal(scale=0.12, size=(20, 8)), x[:10], 3 * x[:5]]).astype(np.float32)
    rows = [(100 - k, v.tolist(), 1) for k, v in enumerate(x)] + [(200, None, 1), (201, [], 1), (202, [0.0] * 8, 1), (203, [float("nan")] * 8, 1), (204, [float("inf")] + [0.0] * 7, 1), (205, [None] * 8, 1), (206, [1.0, 2.0], 1), (207, [2.0, 4.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = [(a, b) for a in range(len(u)) for b in range(a) if u[a] @ u[b] >= 0.95]
    ids = [100 - k for k in range(len(x))]
    label = components(len(x), links)
    least = {c: min(ids[k] for k in range(len(x)) if label[k] == c) for c in label}
    expected = {ids[k]: (sum(k in e for e in links), least[label[k]]) for k in range(len(x))} | {k: (0, k) for k in range(200, 206)} | {206: (1, 206), 207: (1, 206)}
    for tile in (None, 7):
        assert {r.id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicates(df, tile_rows=tile).collect()} == expected
    assert embed_dedup.near_duplicates(df, tile_rows=7, sample_rows=3).where("n_links > 0").count() == sum(n > 0 for n, _ in expected.values())
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0
    assert embed_dedup.keep_one(df).columns == df.columns


def test_the_bound_never_loses_a_pair():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 16))
    x[150:] = x[:150] + rng.normal(scale=0.25, size=(150, 16))
    axes = np.linalg.eigh(np.cov(x.T))[1][:, ::-1]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {(int(a), int(b)) for i, j in embed_dedup.tile_links(x, None, axes, 0.9) for a, b in zip(i, j, strict=True)}
    assert got == {(a, b) for a in range(300) for b in range(a + 1, 300) if u[a] @ u[b] >= 0.9}


def test_boxes_leave_no_pair_out():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 5)) * [4, 2, 1, 1, 1]
    x[200:] = x[:200] + rng.normal(scale=0.1, size=(200, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cuts = embed_dedup.Cuts(x[:90, :3], 13)
    leaf = cuts.place(x[:, :3])
    assert cuts.leaves == 13 and set(leaf) == set(range(13))
    low, high = (np.array([f(x[leaf == k, :3], axis=0) for k in range(13)]) for f in (np.min, np.max))
    near = embed_dedup.near_boxes(low, high, np.sqrt(2 - 2 * 0.98) + 1e-9)
    linked = {(leaf[a], leaf[b]) for a, b in zip(*np.nonzero(x @ x.T >= 0.98), strict=True)}
    assert linked <= {(a, b) for a in range(13) for b in near[a]} and sum(map(len, near)) < 13 * 13
    same = embed_dedup.Cuts(np.zeros((10, 2)), 4)
    assert len(set(same.place(np.zeros((10, 2))))) == 1


def spans(docs):
    words = {k: [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(LOWER)) if x] for k, t in docs}
    seen = {}
    for k, w in words.items():
        for p in range(len(w) - 49):
            seen.setdefault(tuple(w[p : p + 50]), set()).add(k)
    out = []
    for k, w in words.items():
        end = -1
        for p in range(len(w) - 49):
            if len(seen[tuple(w[p : p + 50])]) > 1:
                if p > end:
                    out.append([k, p, p + 50])
                out[-1][2] = end = p + 50
    return sorted(map(tuple, out))


@pytest.mark.parametrize("seed", range(3))
def test_repeated_spans_agree_with_brute_force(spark, seed):
    rnd = random.Random(seed)
    make = lambda n, voc: [rnd.choice(voc) for _ in range(n)]
    wide = [f"w{k}" for k in range(500)]
    passages = [make(n, wide) for n in (49, 50, 51, 60, 90, 130)]
    docs = []
    for k in range(40):
        text = make(rnd.choice([0, 10, 60, 150]), wide)
        for _ in range(rnd.choice([0, 1, 2])):
            p = rnd.choice(passages)
            a = rnd.choice([0, 0, 5, 20])
            cut = p[a : len(p) - rnd.choice([0, 0, 3, 12])]
            at = rnd.randint(0, len(text))
            text = text[:at] + cut + text[at:]
        docs.append((k, rnd.choice([" ", "\n", "  "]).join(text)))
    docs += [(90, " ".join(["same"] * 80)), (91, " ".join(["same"] * 70)), (92, " ".join(["ab", "cd"] * 40)), (93, None), (94, "")]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in docs], "doc_id long, text string, id string, pos int")
    for rows in (4096, 1):
        got = sorted((r.id, r.start_word, r.end_word) for r in suffix_dedup.repeated_spans(df, group_rows=rows).collect())
        assert got == spans(docs)
    assert suffix_dedup.repeated_spans(df.limit(0)).count() == 0


def test_a_seed_of_more_rows_than_a_batch_holds(spark):
    text = " ".join(f"w{k}" for k in range(50))
    docs = spark.range(17_000).selectExpr("id AS doc_id", f"CASE WHEN id = 5 THEN 'x {text}' ELSE '{text}' END AS text")
    for rows in (1 << 20, 1 << 14):  # all compared in one task; counted
        got = suffix_dedup.repeated_spans(docs, group_rows=rows).groupBy("start_word", "end_word").count().collect()
        assert sorted(map(tuple, got)) == [(0, 50, 16_999), (1, 51, 1)]


def test_a_repeat_within_one_document_is_no_span(spark):
    text = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([(1, text + " x " + text), (2, "clean")], "doc_id long, text string")
    assert suffix_dedup.repeated_spans(df).count() == 0
    twice = df.unionByName(df.where("doc_id = 1"))
    assert suffix_dedup.repeated_spans(twice).count() == 0
    other = df.unionByName(spark.createDataFrame([(3, "y " + text)], "doc_id long, text string"))
    found = suffix_dedup.repeated_spans(other)
    assert sorted(map(tuple, found.collect())) == [(1, 0, 60), (1, 61, 121), (3, 1, 61)]
    cut = {r.doc_id: r.text for r in suffix_dedup.drop_spans(other, found.where("id = 3")).collect()}
    assert cut == {1: text + " x " + text, 2: "clean", 3: "y"}
