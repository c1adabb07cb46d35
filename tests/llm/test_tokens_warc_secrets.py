from __future__ import annotations

import base64
import hashlib
import io
import random
import re

import pytest

from folioflow.llm import secret_scan as X
from folioflow.llm import token_count as T
from folioflow.llm import warc as W
from folioflow.llm._shared import shared_dir


@pytest.fixture(scope="module")
def split():
    return T.counter(T.default_vocabulary())


ALPHABET = ["a", "b", "the", " ", "  ", "\n", "'", "s", "ll", "'re", "1", "23", "é", "日本", "!", "--", "\t", "can't", "x" * 70, "\r\n", " "]


@pytest.mark.parametrize("seed", range(3))
def test_edits_give_the_tree_of_the_new_text(split, seed):
    rnd = random.Random(seed)
    make = lambda n: "".join(rnd.choice(ALPHABET) for _ in range(n))
    again = total = 0
    for _ in range(500):
        text = make(rnd.choice([0, 1, 3, 20, 200, 600]))
        tree = T.TokenTree(*split.split(text))
        assert tree.total == len(split.encoding.encode_ordinary(text))
        for _ in range(2):
            edits = []
            for _ in range(rnd.choice([0, 1, 1, 2, 3, 8])):
                s = rnd.randint(0, len(text))
                edits.append((s, min(len(text), s + rnd.choice([0, 0, 1, 2, 5, 30])), make(rnd.choice([0, 1, 2, 5]))))
            text, n = T.apply_edits(tree, text, edits, split)
            lengths, counts = split.split(text)
            assert [x for p in tree.lengths for x in p] == lengths and [x for p in tree.counts for x in p] == counts
            assert (tree.total, tree.chars[1], tree.pieces()) == (sum(counts), len(text), len(lengths))
            again, total = again + n, total + len(lengths)
    assert again < total / 4


def test_token_counts_of_odd_rows(spark, split):
    docs = spark.createDataFrame([(1, "call me at a.b@c.org or 555-123-4567 now", 0), (2, None, 0), (3, "", 0), (1, "again", 0), (None, "no id", 0)], "doc_id long, text string, n_tokens int")
    edits = spark.createDataFrame([(1, 0, 4, "ring", 9), (1, 900, 901, "!", 9), (2, 0, 0, "new", 9), (3, 0, 3, None, 9)], "doc_id long, start int, end int, replacement string, n_edits int")
    got = {(r.id, r.n_chars): (r.n_edits, r.n_tokens_after) for r in T.count_tokens(docs, edits).collect()}
    count = lambda t: len(split.encoding.encode_ordinary(t))
    assert got == {(1, 40): (2, count("ring me at a.b@c.org or 555-123-4567 now!")), (2, 0): (1, count("new")), (3, 0): (1, 0), (1, 5): (2, count("ringn!")), (None, 5): (0, 2)}
    assert T.count_tokens(docs.limit(0), edits).count() == 0
    assert all(r.n_edits == 0 and r.n_tokens == r.n_tokens_after for r in T.count_tokens(docs, edits.limit(0)).collect())
    assert {r.id: (r.n_tokens, bytes(r.counts)) for r in T.token_trees(docs.where("doc_id > 1")).collect()} == {2: (0, b""), 3: (0, b"")}
    for values in ([], [0, 3, 254], [255], [254, 255, 256, 0, 1000, 510, 7]):
        assert T.unpacked(T.packed(values)) == values
    assert T.edited("mail a.b@c.org or 555-123-4567 x", T.proper_edits(T.redactions("mail a.b@c.org or 555-123-4567 x"), 99)) == "mail <EMAIL> or <NUMBER> x"


def test_kept_trees_serve_edit_after_edit(spark, split):
    text = " ".join(f"word{k} can't" for k in range(3000))
    docs = spark.createDataFrame([(1, text, 0), (1, text, 1), (2, "other one", 2), (None, text, 3)], "doc_id long, text string, counts int")
    edits = spark.createDataFrame([(1, 10, 12, "XY Z"), (2, 0, 0, "an ")], "doc_id long, start int, end int, replacement string")
    first = T.count_tokens(docs, edits, leaves=True)
    new = text[:10] + "XY Z" + text[12:]
    after = spark.createDataFrame([(1, new), (1, new), (2, "an other one"), (None, text)], "doc_id long, text string")
    fresh = sorted(map(str, T.token_trees(after).collect()))
    assert sorted(str(r) for r in first.select("tree.*").collect()) == fresh
    got = first.where("id = 1").collect()
    assert len(got) == 2 and all(r.n_pretokens > 6000 and 0 < r.n_reencoded <= 8 for r in got)  # near the edit alone
    again = T.count_tokens(after, spark.createDataFrame([(1, 10, 14, text[10:12])], "doc_id long, start int, end int, replacement string"), trees=first.select("tree.*"), leaves=True)
    assert {r.tree.digest for r in again.where("id = 1").collect()} == {hashlib.md5(text.encode()).hexdigest()}


def test_query_counts_tokens_of_whole_texts(spark, split):
    data = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = T.op7_token_counts(spark, data).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r.doc_id]
        edits = T.proper_edits(T.redactions(text), len(text))
        count = lambda t: len(split.encoding.encode_ordinary(t))
        assert (r.n_chars, r.n_tokens, r.n_edits, r.n_tokens_after) == (len(text), count(text), len(edits), count(T.edited(text, edits)))
    assert sum(r.n_edits for r in got) > 0


def test_records_come_back_in_pieces():
    payloads = [b"", b"x", bytes(range(256)) * 1000, b"\r\n\r\n" * 50]
    out = io.BytesIO()
    for k, p in enumerate(payloads):
        W.write_record(out, f"urn:page:{k}", "u\nv", memoryview(p), hashlib.sha1(p).hexdigest(), None)
    W.write_record(out, "urn:page:9", None, memoryview(b"gone"), hashlib.sha1(b"gone").hexdigest(), "urn:page:1")
    out.seek(0)
    got: dict = {}
    most = 0
    for head, number, chunk, digest, total, last in W.records(W.unpacked(out, 1000), 1000):
        most = max(most, len(chunk))
        had = got.setdefault(head["WARC-Record-ID"], [b"", 0, None, None])
        assert had[1] == number
        had[0], had[1], had[2], had[3] = had[0] + chunk, number + 1, digest if last else None, head
        assert total == len(had[0])
    assert [got[f"<urn:page:{k}>"][0] for k in range(4)] == payloads and most <= 1000
    assert [got[f"<urn:page:{k}>"][2] for k in range(4)] == [hashlib.sha1(p).hexdigest() for p in payloads]
    head = got["<urn:page:9>"][3]
    assert head["WARC-Type"] == "revisit" and base64.b32decode(head["WARC-Payload-Digest"][5:]).hex() == hashlib.sha1(b"gone").hexdigest()


def test_archives_round_trip(spark):
    big = "é" * 5000
    rows = [(1, "u", big, 0), (7, "v", big, 0), (3, "w", "y" * 999, 0), (4, None, "y" * 999, 0), (5, "n", None, 0), (6, "e", "", 0), (7, "again", big, 0), (8, "x", "<p>" * 100_000, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha1 int")
    listed = W.write_archives(pages, shared_dir(spark, "test-warc"), file_bytes=1000)
    assert listed.agg({"records": "sum"}).first()[0] == len(rows) and listed.count() > 2
    chunks = W.read_chunks(listed, chunk_bytes=1024)
    got: dict = {}
    for r in sorted(chunks.collect(), key=lambda r: r.chunk_no):
        got.setdefault((r.record_id, r.target_uri), []).append(r)
    assert b"".join(bytes(r.bytes) for r in got["urn:page:7", "v"]).decode() == big
    assert {k: (v[-1].record_type, v[-1].refers_to) for k, v in got.items()} == {
        ("urn:page:1", "u"): ("revisit", "urn:page:7"), ("urn:page:7", "v"): ("response", None), ("urn:page:7", "again"): ("response", None), ("urn:page:3", "w"): ("response", None),
        ("urn:page:4", ""): ("response", None), ("urn:page:5", "n"): ("response", None), ("urn:page:6", "e"): ("response", None), ("urn:page:8", "x"): ("response", None)}
    last = W.read_chunks(listed, payload=False, last_only=True).where("record_id = 'urn:page:8'").collect()
    assert [(r.bytes_so_far, r.digest_so_far) for r in last] == [(300_000, hashlib.sha1(b"<p>" * 100_000).hexdigest())]
    assert W.read_chunks(W.write_archives(pages.limit(0), shared_dir(spark, "test-warc"))).count() == 0


def test_hot_payloads_and_pages_without_ids(spark):
    rows = [(k, "same" * 400) for k in range(300)] + [(None, "same" * 400)] * 50 + [(k, f"{k}" * 300) for k in range(300, 1500)] + [(5, "other" * 300), (9, "other" * 300)]
    pages = spark.createDataFrame([(k, "u", t) for k, t in rows], "page_id long, url string, html string")
    got = W.roles(pages).select("id", "payload", "refers_to").collect()
    last: dict = {}
    for k, t in rows:
        last[t] = max(last.get(t, -1), -1 if k is None else k)
    expected = [(k, t, last[t] if k is not None and len(t) >= 1000 and k < last[t] else None) for k, t in rows]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, expected))


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return [(k, s, e) for s, k, e in sorted(out)]


def test_base_spans_agree_with_plain_patterns():
    rnd = random.Random(3)
    parts = ["password", "TOKEN", "apiKey", "api_key", "secret", "passwd", ":", "=", " ", '"', "'", "AKIA", "AKIA" + "X9" * 9, "deadbeef" * 3, "0123456789abcdef" * 2, "é", "ſecret", "Kelvin", "\n", "token:token", "Zz+/", "AKIAAKIA" + "B" * 13, "日本", "-_."]
    for _ in range(1500):
        texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(3)]
        assert X.scan([t.encode() for t in texts])[0] == [base_spans(t) for t in texts]


def test_random_tokens_stand_out_and_text_does_not():
    rnd = random.Random(4)
    random_tokens = [base64.b64encode(rnd.randbytes(36)) for _ in range(200)]
    passed = [X.battery(t.strip(b"="))[1:] for t in random_tokens]
    assert sum(r >= X.RANDOM_P for r, _ in passed) > 190
    assert sorted(p for _, p in passed)[150] < 1e-4
    words = b"the and of nation government which administration thought interesting people because another different between important".split()
    text = [b"-".join(rnd.choice(words) for _ in range(5)) for _ in range(200)]
    assert sum(r >= X.RANDOM_P and p < 1e-4 for r, p in (X.battery(t)[1:] for t in text)) == 0
    assert [X.infer_encoding(t) for t in (b"0" * 20, b"deadbeef1", b"XYZ234", b"Ab9")] == ["digits", "hex", "base32", "base62"]
    X.battery(b"a" * 40)


def text_token(rnd):
    words = "quick service response handler manager factory implementation network protocol internal request update image upload version release public static analysis storage engine machine learning".split()
    parts = [rnd.choice(words) for _ in range(rnd.randint(4, 8))]
    return rnd.choice([lambda: "".join(w.title() for w in parts), lambda: "-".join(parts), lambda: "_".join(parts).upper(), lambda: "/".join(parts) + f"/{rnd.randint(1990, 2030)}-{rnd.randint(10, 12)}"])().encode()


@pytest.mark.parametrize(("alphabet", "size", "least"), [(62, 20, 0.8), (62, 24, 0.9), (62, 32, 0.95), (62, 40, 0.95), (16, 40, 0.8), (16, 64, 0.95)])
def test_recall_of_planted_keys(alphabet, size, least):
    rnd = random.Random(size)
    keys = ["".join(rnd.choice("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"[:alphabet]) for _ in range(size)).encode() for _ in range(60)]
    tokens = [(t, False) for t in (text_token(rnd) for _ in range(2000)) if len(t) >= 30] + [(k, True) for k in keys]
    scored = [(p if r >= X.RANDOM_P else 1.0, len(t), k) for t, k in tokens for _, r, p in [X.battery(t)]]
    mean = sum(n for _, n, _ in scored) / len(scored)
    ranked = sorted((p * mean / n, k) for p, n, k in scored)
    cut = max((i for i, (q, _) in enumerate(ranked, 1) if q <= X.FDR * i / len(ranked)), default=0)
    found = [k for _, k in ranked[:cut]]
    assert sum(found) >= least * len(keys) and found.count(False) <= 0.1 * max(1, len(found))


def test_p_values_keep_their_precision():
    rnd = random.Random(9)
    p = [X.battery("".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n)).encode())[2] for n in (40, 80, 120)]
    assert 1e-60 < p[2] < p[1] < p[0]
    assert X._binomial_tail(8, 10, 0.5) == pytest.approx(56 / 1024) and X._binomial_tail(10, 10, 0.1) == pytest.approx(1e-10) and X._binomial_tail(0, 10, 0.1) == 1.0


def test_the_procedure_agrees_with_a_sorted_list(spark):
    rnd = random.Random(11)
    rows = [[(0, n, rnd.random() ** rnd.choice([1, 9, 30])) for n in (rnd.randint(20, 60) for _ in range(rnd.randint(0, 4)))] for _ in range(80)]
    found = spark.createDataFrame([(k, [], r) for k, r in enumerate(rows)], X._SCANNED)
    mean, limit = X.discovery_limit(found)
    flat = sorted(p * mean / n for r in rows for _, n, p in r)
    assert mean == pytest.approx(sum(n for r in rows for _, n, _ in r) / len(flat))
    cut = max((i for i, q in enumerate(flat, 1) if q <= X.FDR * i / len(flat)), default=0)
    assert abs(sum(q <= limit for q in flat) - cut) <= 1 + cut // 20  # cells of a hundredth of a decade


def test_query_finds_the_base_of_whole_texts(spark):
    data = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = X.op10_secrets(spark, data).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        base = base_spans(texts[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == n for k, _, _ in base) for n in range(3)] and r.base_sha256 == X.digest(base)
        listed = {tuple(x.split(":")) for x in r.spans.split(",") if x}
        assert {(X.KINDS[k], str(s), str(e)) for k, s, e in base} <= listed


def test_findings_and_redaction(spark):
    rnd = random.Random(5)
    key = base64.b64encode(rnd.randbytes(48)).decode()
    docs = spark.createDataFrame([(1, f"é uses {key} here", 0), (2, "password=hunter22 x", 0), (3, None, 0), (4, "", 0), (2, "again", 0), (None, "internationalization-of-administration", 0)], "doc_id long, text string, spans int")
    got = {}
    for r in X.find_secrets(docs).collect():
        got.setdefault(r.id, []).append([tuple(s) for s in r.spans])
    assert got[1] == [[(7, 3, 71)]] and sorted(got[2]) == [[], [(0, 0, 17)]] and got[3] == got[4] == got[None] == [[]]
    clean = X.redact(docs)
    assert clean.columns == docs.columns
    assert sorted((r.text or "") for r in clean.collect()) == sorted(["é uses [SECRET] here", "[SECRET] x", "", "", "again", "internationalization-of-administration"])
    assert X.find_secrets(docs.limit(0)).count() == X.redact(docs.limit(0)).count() == 0
