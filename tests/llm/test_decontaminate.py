from __future__ import annotations

import random
import re

import pytest

from folioflow.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window):
    wins = {}
    for i, t in items:
        w = split(t)
        n = min(len(w), window)
        for p in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[p : p + n]), set()).add(i)
    out = []
    for t in docs:
        w, hit, its = split(t), set(), set()
        for n in {len(k) for k in wins}:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in wins:
                    hit |= set(range(p, p + n))
                    its |= wins[tuple(w[p : p + n])]
        out.append((len(w), len(hit), its))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_agrees_with_brute_force(seed):
    rnd = random.Random(seed)
    for _ in range(60):
        voc = ["".join(rnd.choice("abZéÉ9") for _ in range(rnd.randint(1, 12))) for _ in range(rnd.choice([2, 5, 50, 300]))]
        make = lambda n: rnd.choice([" ", "--", "\n"]).join(rnd.choice(voc) for _ in range(n))  # noqa: B023, E731
        items = [(k, make(rnd.choice([0, 1, 2, 3, 5, 9, 10, 11, 25]))) for k in range(rnd.choice([0, 1, 3, 8]))]
        docs = [make(rnd.choice([0, 1, 5, 30, 60])) for _ in range(rnd.choice([1, 4, 9]))]
        for _, t in items:
            if rnd.random() < 0.7:
                docs[rnd.randrange(len(docs))] += " " + t
        window = rnd.choice([3, 10])
        bench = [D.benchmark_windows([i], [t.encode()], window) for i, t in items] if seed % 2 else [D.benchmark_windows([i for i, _ in items], [t.encode() for _, t in items], window)]
        counts, hits, found = D.search_shard([d.encode() for d in docs], bench, window)
        for k, expected in enumerate(brute(docs, items, window)):
            assert (counts[k], hits[k], {i for i, *_ in found[k]}) == expected


def test_longest_matches():
    item = " ".join(f"w{k}" for k in range(20))
    text = "x y " + " ".join(f"w{k}" for k in range(3, 18)) + " z"
    _, hits, found = D.search_shard([text.encode()], [D.benchmark_windows([7], [item.encode()])])
    assert hits[0] == 15 and found[0] == [(7, 3, 2, 15)]


def test_suffix_array_orders_all_suffixes():
    import numpy as np

    rnd = np.random.default_rng(1)
    for top in (1, 3, 1000):
        seq = np.concatenate([rnd.integers(1, top + 1, 200), [0]])
        order = D.SuffixArray(seq, top, 16).order
        suffixes = [seq[k : k + 16].tolist() for k in order]
        assert suffixes == sorted(suffixes)


def test_odd_rows_and_blocks(spark):
    schema = "doc_id long, text string, source string, item_id int"
    passage = " ".join(f"p{k}" for k in range(12))
    docs = spark.createDataFrame([(1, passage, "s", 1), (1, passage, "s", 1), (2, None, None, None), (3, "", "s", 2), (None, passage + " more", "s", 3), (4, "clean text", "s", 4)], schema)
    bench = spark.createDataFrame([(5, passage, 1), (40, passage, 2), (6, None, 3), (7, "", 4), (None, "other words", 5)], "item_id long, text string, doc_id int")
    for block_bytes in (1 << 20, 10):
        got = sorted(((r.id, r.n_words, r.n_hit, r["items"]) for r in D.benchmark_matches(docs, bench, block_bytes=block_bytes).collect()), key=str)
        assert got == sorted([(1, 12, 12, [40, 5]), (1, 12, 12, [40, 5]), (2, 0, 0, []), (3, 0, 0, []), (None, 13, 12, [40, 5]), (4, 2, 0, [])], key=str)
    kept = D.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
    assert D.benchmark_matches(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert D.benchmark_matches(docs.limit(0), bench).count() == 0 and D.decontaminate(docs.limit(0), bench).count() == 0


def test_a_worker_holds_one_block(spark):
    items = [(k, " ".join(f"i{k}w{j}" for j in range(30))) for k in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    paths = D.benchmark_blocks(bench, block_bytes=600)
    assert len(paths) > 8
    loaded = [D.load_block(p) for p in paths]
    assert sorted(i for b in loaded for i in b["ids"]) == list(range(40)) and D.load_block.cache_info().currsize == 1
    hit = D.search_shard([t.encode() for _, t in items], D._loaded(paths))
    assert [[m[0] for m in f] for f in hit[2]] == [[k] for k in range(40)]


def test_a_text_longer_than_a_block():
    passage = " ".join(f"p{k}" for k in range(12))
    long = ("filler words " * 400_000 + passage).encode()
    from folioflow.llm._text import blocks

    assert list(blocks([b"a", long, b"b"])) == [(0, 1), (1, 2), (2, 3)]
    assert D.search_shard([long], [D.benchmark_windows([1], [passage.encode()])])[1][0] == 12
