from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import pytest

from folioflow.llm import packing as P
from folioflow.llm import shard as S


def test_each_item_goes_to_the_tightest_compatible_bin():
    rnd = random.Random(1)
    for _ in range(200):
        m = rnd.randint(0, 200)
        sizes = sorted((rnd.randint(0, 40) for _ in range(m)), reverse=True)
        sources = [rnd.choice(["a", "a", "a", "b", "c", None]) for _ in range(m)]
        clusters = [rnd.choice([1, 1, 2, 3, None, *range(10, 60)]) for _ in range(m)]
        bins: dict = {}
        for size, s, c, b in zip(sizes, sources, clusters, P.pack_group(sizes, sources, clusters, 60), strict=True):
            fits = {k: x[0] for k, x in bins.items() if x[0] >= size and (s is None or s not in x[1]) and (c is None or c not in x[2])}
            assert (b in fits and fits[b] == min(fits.values())) if fits else b not in bins
            bins.setdefault(b, [60, set(), set()])
            bins[b][0] -= size
            bins[b][1].add(s)
            bins[b][2].add(c)


def test_pack_keeps_every_byte(spark):
    rnd = random.Random(2)
    rows = [(k, "x" * rnd.choice([0, 1, 50, 99, 100, 101, 350]), rnd.choice(["hot", "hot", "s", None]), 1) for k in range(200)] + [(500, None, "s", 1), (501, "same", "a", 1), (502, "Same ", "b", 1), (501, "same", "a", 1), (None, "é" * 70, "z", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, bin_id int")
    for group_rows in (8192, 40):
        got = P.pack(docs, capacity=100, group_rows=group_rows).collect()
        length, held = Counter(), defaultdict(list)
        for r in got:
            length[r.id] += r.length
            held[r.bin_id].append(r)
        want = Counter()
        for k, t, *_ in rows:
            want[k] += len((t or "").encode())
        assert length == want and len({r.id for r in got}) == len({r[0] for r in rows})
        for b in held.values():
            assert sum(r.length for r in b) <= 100 and sorted(r.slot for r in b) == list(range(len(b)))
            for f in ("source", "cluster"):
                keys = [r[f] for r in b if r[f] is not None]
                assert len(keys) == len(set(keys))
    assert P.pack(docs.limit(0)).count() == 0


def test_best_fit_decreasing_agrees_with_a_list():
    rnd = random.Random(3)
    for _ in range(200):
        sizes = sorted((rnd.randint(1, rnd.choice([10, 100])) for _ in range(rnd.randint(0, 60))), reverse=True)
        capacity, most = rnd.choice([20, 100, 150]), rnd.choice([None, 3])
        free: list[int] = []
        expected = []
        for s in sizes:
            fits = [(f, k) for k, f in enumerate(free) if f >= s]
            if fits:
                k = min(fits)[1]
            elif len(free) == most:
                k = max((f, k) for k, f in enumerate(free))[1]
            else:
                k = len(free)
                free.append(capacity)
            free[k] -= s
            expected.append(k)
        got: dict = defaultdict(list)
        runs = S.best_fit_decreasing(sorted(Counter(sizes).items(), reverse=True), capacity, most)
        for size, first, n, k in runs:
            assert len(got[size]) == first
            got[size] += [k] * n
        of_list = defaultdict(list)
        for s, k in zip(sizes, expected, strict=True):
            of_list[s].append(k)
        assert {s: sorted(k) for s, k in got.items()} == {s: sorted(k) for s, k in of_list.items()}
        size, rank, bins = S._starts(runs)
        assert len(bins) <= len(runs) and sum(n for _, _, n, _ in runs) == len(sizes)


def test_many_equal_groups_are_packed_at_once():
    runs = S.pack([(1000, 3), (700, 10**9), (1, 10**10)], 16)
    held = Counter()
    for size, _, n, k in runs:
        held[k] += size * n
    assert sum(n for _, _, n, _ in runs) == 3 + 10**9 + 10**10 and max(held.values()) - min(held.values()) <= 16 and len(runs) < 100


def test_shards(spark):
    rnd = random.Random(4)
    rows = [(k, "".join(rnd.choice("abc é") for _ in range(rnd.randint(0, 300))), 1) for k in range(600)] + [(700 + k, "copy", 1) for k in range(50)] + [(800, None, 1), (801, None, 1), (802, "", 1), (None, "copy", 1), (1, "repeated", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    for cells in (1 << 16, 3):
        got = S.shard(docs, cells=cells).collect()
        assert len(got) == len(rows)
        sizes, slots = Counter(), defaultdict(list)
        for r in got:
            sizes[r.shard] += r.size
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))
        mean = sum(sizes.values()) / 16
        assert max(sizes.values()) < 1.2 * mean and min(sizes.values()) > 0.8 * mean
        by = {r.id: r for r in got if r.id != 1}
        assert len({by[k].shard for k in range(700, 750)} | {by[None].shard}) == 1 and by[800].shard == by[801].shard
        assert by[800].size == 1 and by[800].text_crc32 is None and by[802].text_crc32 == 0
        assert all(by[k].text_crc32 == zlib.crc32(t.encode()) and by[k].size == len(t.encode()) + 1 for k, t, _ in rows if t is not None and k != 1)
    assert S.shard(docs.limit(0)).count() == 0


def test_shards_of_a_fixed_capacity(spark):
    sizes = [60, 60, 50, 40, 40, 30, 20, 150]
    docs = spark.createDataFrame([(k, chr(97 + k) * (n - 1)) for k, n in enumerate(sizes)], "doc_id long, text string")
    got = S.shard(docs, capacity=100).collect()
    held = {}
    for r in got:
        held.setdefault(r.shard, []).append(r.size)
    assert sorted(r.id for r in got) == list(range(8)) and sorted(map(sum, held.values())) == [100, 100, 100, 150]


def test_the_query_packs_as_a_list_would(spark):
    data = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = {r.doc_id: r for r in S.op4_shards(spark, data).collect()}
    groups = Counter()
    for t in texts.values():
        groups[t] += len((t or "").encode()) + 1
    held = Counter()
    for k, t in texts.items():
        held[got[k].shard] += len((t or "").encode()) + 1
    plain = Counter()
    for size, _, n, k in S.pack(sorted(Counter(groups.values()).items(), reverse=True), 16):
        plain[k] += size * n
    assert got.keys() == texts.keys() and held == plain and all(len({got[k].shard for k, t in texts.items() if t == text}) == 1 for text in groups)


def test_the_query_packs_as_a_plain_search_would(spark):
    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    got = P.op3_packing(spark, data).collect()
    pieces: dict = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append((r.start, r.length))
    for d in docs:
        size = len((d.text or "").encode())
        assert sorted(pieces[d.doc_id]) == [(k, min(8192, size - k)) for k in range(0, max(1, size), 8192)]
    # Remainders in falling order, each into the tightest compatible bin of all.
    cluster = {r.doc_id: r.cluster for r in got}
    rest = sorted(((-(len((d.text or "").encode()) % 8192), d.doc_id, d.source) for d in docs if len((d.text or "").encode()) % 8192 or not d.text))
    bins: list = []
    for size, k, source in rest:
        fits = [b for b in bins if b[0] >= -size and source not in b[1] and cluster[k] not in b[2]]
        best = min(fits, key=lambda b: b[0]) if fits else [8192, set(), set()]
        if not fits:
            bins.append(best)
        best[0] += size
        best[1].add(source)
        best[2].add(cluster[k])
    full = sum(len((d.text or "").encode()) // 8192 for d in docs)
    held = Counter()
    for r in got:
        held[r.bin_id] += r.length
    assert sorted(held.values()) == sorted([8192 - b[0] for b in bins] + [8192] * full)
