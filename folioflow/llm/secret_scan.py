"""Secret scans: three plain patterns, and a battery of randomness tests for all other tokens.

Patterns (the base; they always stay): assignments to password-like names, access key ids, long hex runs.

Battery: a token is a run of 20 or more characters of ``[A-Za-z0-9+/_=-]``. Its encoding is inferred from its letters and digits, without
the separators (digits, hex, letters of one case, base32, base36, base62), and its symbols are tested in that alphabet for
uniformity (chi-squared), for runs about the middle of the alphabet and for correlation with the next
symbol. A token that any test rejects as random (at ``RANDOM_P``, Bonferroni over the three) is text.

The others are findings only if they are unlike text in the same three respects, which makes a p-value of the token under the
null hypothesis of text: its symbols coincide less often than those of text do in that alphabet (``_COINCIDENCE``; lower tail of
the chi-squared statistic), it has more runs than the words and numbers that text tokens are made of (``TEXT_BREAK``; upper binomial tail
of the breaks), or its symbols are less correlated with the next ones (``TEXT_SERIAL``; lower normal tail). The latter two tell of the order of the symbols, so
the lesser, doubled, is joined with the first, which tells of their multiset, by Fisher's method. These
p-values go through a Benjamini-Hochberg procedure over all tokens of the corpus with weights in proportion to length
(false-discovery rate ``FDR``), so a longer token passes at a greater p-value.

Scale: one pass without a shuffle finds spans and p-values; the procedure needs only a histogram of
``_BINS`` cells. A token is tested as a whole, whatever its length.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import release, table, written
from ._text import Words, blocks, utf8

MIN_TOKEN, MIN_HEX, MIN_ACCESS, MIN_VALUE = 20, 24, 20, 6
RANDOM_P, FDR = 1e-3, 0.05
#: Text tokens: the chance that a run ends at a symbol, and the correlation of a symbol with the next where letter cases or digits mix.
TEXT_BREAK, TEXT_SERIAL = 0.15, 0.1
KINDS = ["assign", "access", "hex", "random"]
_BINS, _PER_DECADE = 8000, 100

_ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_DIGITS, _LOW, _UP = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TOKEN, _HEX, _UPPER = _class(_DIGITS + _LOW + _UP + "+/_=-"), _class("0123456789abcdef"), _class(_UP + _DIGITS)

#: Encodings from the narrowest: name, alphabet.
_ENCODINGS = [("digits", _DIGITS), ("hex", _DIGITS + "abcdef"), ("HEX", _DIGITS + "ABCDEF"), ("lower", _LOW), ("upper", _UP), ("base32", _UP + "234567"), ("base36", _UP + _DIGITS),
              ("lower36", _LOW + _DIGITS), ("base62", _DIGITS + _UP + _LOW)]
#: How often two symbols of text coincide, as a multiple of chance in the alphabet: letters of text coincide at about 0.066.
_COINCIDENCE = {name: {"digits": 2.0, "hex": 1.6, "HEX": 1.6}.get(name, 0.066 * len(chars)) for name, chars in _ENCODINGS}
_CODES = {name: {c: k for k, c in enumerate(chars.encode())} for name, chars in _ENCODINGS}
_SEPARATORS = b"-_/+="
#: Runs of a token: words of one letter case or of two, one after the other, capitals, digits, and single letters.
_RUN = re.compile(rb"(?:[A-Z]?[a-z]{2,})+|[A-Z]+|[0-9]+|[a-z]")


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _binomial_tail(k: int, n: int, q: float) -> float:
    """The chance of k or more of n at chance q each; terms fall fast above the mean, where alone the tail is small."""
    if k <= n * q:
        return 1.0
    j = np.arange(k, min(n, k + 400) + 1)
    rise = np.log((n - j[:-1]) / (j[:-1] + 1) * (q / (1 - q))) if len(j) > 1 else np.zeros(0)
    first = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(q) + (n - k) * math.log1p(-q)
    return min(1.0, math.exp(first) * float(np.exp(np.concatenate([[0.0], np.cumsum(rise)])).sum()))


def infer_encoding(symbols: bytes) -> str:
    seen = set(symbols)
    return next(name for name, _ in _ENCODINGS if seen <= _CODES[name].keys())


def battery(token: bytes) -> tuple[str, float, float]:
    """(encoding, p of randomness, p of text) of a token, by its letters and digits."""
    symbols = token.translate(None, _SEPARATORS)
    name = infer_encoding(symbols)
    codes = _CODES[name]
    x = np.array([codes[c] for c in symbols], dtype=float)
    n, k = len(x), len(codes)
    if n < 2:
        return name, 0.0, 1.0
    chi = k / n * float((np.bincount(x.astype(int), minlength=k) ** 2).sum()) - n
    # Uniformity: Wilson-Hilferty, with the variance of a multinomial of n draws.
    shape = 2 * (k - 1) ** 2 / max(1e-9, 2 * (k - 1) * (n - 1) / n)
    uniform = _normal_tail(((chi / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * shape))) / math.sqrt(2 / (9 * shape)))
    high = x >= k / 2
    a, b = int(high.sum()), int(n - high.sum())
    runs_p = 0.0
    if a and b:
        mean, var = 2 * a * b / n + 1, 2 * a * b * (2 * a * b - n) / (n * n * max(1, n - 1))
        runs_p = 2 * _normal_tail(abs(1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(var)) if var > 0 else 1.0
    d = x - x.mean()
    varies = float((d * d).sum())
    serial = float((d[1:] * d[:-1]).sum()) / varies if varies else 1.0
    serial_p = 2 * _normal_tail(abs(serial) * math.sqrt(n)) if varies else 0.0
    # The same three against text.
    excess = _COINCIDENCE[name] - 1
    text_chi = _normal_tail(-(chi - (k - 1) - (n - 1) * excess) / math.sqrt(2 * (k - 1) + 4 * n * excess))
    text_runs = _binomial_tail(len(_RUN.findall(symbols)) - 1, n - 1, TEXT_BREAK)
    mixed = name not in ("digits", "lower", "upper")  # one kind of symbols has no order that text would show
    text_serial = _normal_tail(-(serial - TEXT_SERIAL) * math.sqrt(n / (1 - TEXT_SERIAL**2))) if mixed else 1.0
    both = max(text_chi, 1e-150) * max(min(1.0, 2 * min(text_runs, text_serial)), 1e-150)
    return name, min(1.0, 3 * min(uniform, runs_p, serial_p)), min(1.0, max(both * (1 - math.log(both)), 1e-70))


def scan(texts: list[bytes]) -> tuple[list[list[tuple]], list[list[tuple]]]:
    """Of each text its base spans (kind number, start, end) and its tokens that pass for random (start, end, p of text), in code points."""
    base: list[list[tuple]] = [[] for _ in texts]
    tokens: list[list[tuple]] = [[] for _ in texts]
    for lo, hi in blocks(texts):
        runs = Words(texts[lo:hi], _TOKEN, lower=False)
        found: list[tuple[int, int, int]] = []
        for m in _ASSIGN.finditer(runs.raw.lower()):  # bytes.lower changes A to Z alone; no match holds the line break between texts
            if m.end(1) - m.start(1) >= MIN_VALUE:
                found.append((0, m.start(), m.end()))
        for kind, chars, least in ((1, _UPPER, MIN_ACCESS), (2, _HEX, MIN_HEX)):
            inside = chars[runs.buf[: len(runs.inside)]]
            edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
            edge = np.concatenate([[0], edge]) if len(inside) and inside[0] else edge
            start, end = edge[::2], edge[1::2]
            for k in np.flatnonzero(end - start >= least).tolist():
                s, e = int(start[k]), int(end[k])
                if kind == 1:
                    s = runs.raw.find(b"AKIA", s, e)
                if s >= 0 and e - s >= least:
                    found.append((kind, s, e))
        long_ = np.flatnonzero(runs.end - runs.start >= MIN_TOKEN)
        tried = [(s, e) for s, e in zip(runs.start[long_].tolist(), runs.end[long_].tolist(), strict=True)]
        if not found and not tried:
            continue
        spot = np.array([x for _, s, e in found for x in (s, e)] + [x for t in tried for x in t])
        owner = np.searchsorted(runs.offset, spot[::2], side="right") - 1
        for d in np.unique(owner).tolist():
            chars_before = np.concatenate([[0], np.cumsum((runs.buf[runs.offset[d] : runs.offset[d + 1]] & 0xC0) != 0x80)])
            for k in np.flatnonzero(owner == d).tolist():
                s, e = (int(chars_before[x - runs.offset[d]]) for x in spot[2 * k : 2 * k + 2])
                if k < len(found):
                    base[lo + d].append((s, found[k][0], e))
                    continue
                s_byte, e_byte = tried[k - len(found)]
                whole = runs.raw[s_byte:e_byte]
                core = whole.strip(_SEPARATORS)
                if len(core.translate(None, _SEPARATORS)) < MIN_TOKEN or any(b0 < e and s < b1 for b0, _, b1 in base[lo + d]):
                    continue
                random_p, text_p = battery(core)[1:]
                if random_p >= RANDOM_P:
                    at = s + whole.index(core)
                    tokens[lo + d].append((at, at + len(core), text_p))
                else:
                    tokens[lo + d].append((-1, len(core), 1.0))  # tested, and text: counts in the procedure
    return [[(k, s, e) for s, k, e in sorted(b)] for b in base], tokens


_SCANNED = "id long, base array<struct<kind:int,s:long,e:long>>, tokens array<struct<s:long,e:long,p:double>>"


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, tokens) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("kind", pa.int32()), ("s", pa.int64()), ("e", pa.int64())]))
        tested = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64()), ("p", pa.float64())]))
        for batch in batches:
            base, tokens = scan(utf8(batch.column(1)))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([[dict(zip(("kind", "s", "e"), b, strict=True)) for b in x] for x in base], spans),
                pa.array([[dict(zip(("s", "e", "p"), t, strict=True)) for t in x] for x in tokens], tested),
            ], names=["id", "base", "tokens"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, _SCANNED)


def _length() -> Column:
    return F.when(F.col("s") < 0, F.col("e")).otherwise(F.col("e") - F.col("s"))


def discovery_limit(found: DataFrame, fdr: float = FDR) -> tuple[float, float]:
    """(mean token length, limit of p x mean / length) of the weighted Benjamini-Hochberg procedure over ``found``; a limit of 0 finds nothing.

    Equal p-values share a cell of the histogram and so a fate. Tokens of repeated rows count as often as they occur; without tokens the limit is 0.
    """
    tokens = found.select(F.inline("tokens"))
    mean = tokens.agg(F.avg(_length())).first()[0] or 1.0
    score = F.least(F.lit(_BINS - 1), F.greatest(F.lit(0), F.floor(-F.log10(F.col("p") * mean / _length()) * _PER_DECADE))).cast("int")
    held = np.zeros(_BINS)
    for k, n in tokens.groupBy(score.alias("k")).count().collect():
        held[k] = n
    rank, total = np.cumsum(held[::-1])[::-1], held.sum()
    upper = 10.0 ** (-np.arange(_BINS) / _PER_DECADE)  # p is at most this in the bin and those after it
    fits = np.flatnonzero((rank > 0) & (upper * total <= fdr * rank))
    return float(mean), float(upper[fits[0]]) if len(fits) else 0.0


def redacted(texts: list[bytes], mean: float, limit: float, mark: str = "[SECRET]") -> list[str]:
    """The texts with their secrets replaced by ``mark``; overlapping spans are one."""
    done = []
    for text, base, tokens in zip(texts, *scan(texts), strict=True):
        spans = sorted([(s, e) for _, s, e in base] + [(s, e) for s, e, p in tokens if s >= 0 and p * mean / (e - s) <= limit])
        chars, out, at = text.decode(), [], 0
        for s, e in spans:
            if s >= at:
                out += [chars[at:s], mark]
            at = max(at, e)
        done.append("".join(out) + chars[at:] if spans else chars)
    return done


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret of ``text_col`` replaced by ``mark``; null stays null, all else stays as it is.

    The procedure's limit is that of all rows together, repeated ones included. An empty table stays empty, other columns may have any names,
    and texts are taken whole, whatever their length.
    """
    found = written(scanned(docs.select(F.lit(0).alias("id"), F.col(text_col).alias("text")), "id"), "scanned")
    mean, limit = discovery_limit(found)
    release(found)

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        return pa.array(redacted(utf8(texts), mean, limit, mark), pa.string(), mask=np.asarray(texts.is_null()))

    return docs.withColumn(text_col, clean(F.col(text_col).cast("string")))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """(id, base, spans: arrays of kind, s, e) of every row of ``docs``.

    spans hold the base and the findings of the battery that no base span overlaps. Null and empty texts
    have none; rows that repeat an id are rows of their own.
    """
    found = written(scanned(docs, id_col, text_col), "scanned")
    mean, limit = discovery_limit(found, fdr)
    own = F.transform(F.filter("tokens", lambda t: (t.s >= 0) & (t.p * mean / (t.e - t.s) <= limit)),
                      lambda t: F.struct(t.s.alias("s"), F.lit(3).alias("kind"), t.e.alias("e")))
    base = F.transform("base", lambda b: F.struct(b.s.alias("s"), b.kind.alias("kind"), b.e.alias("e")))
    return found.select("id", base.alias("base"), F.array_sort(F.concat(base, own)).alias("spans"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, KINDS))
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.get(names, x.kind), x.s, x.e)), ",")
    count = lambda k: F.size(F.filter("base", lambda b: b.kind == k)).cast("long")
    return find_secrets(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))


def digest(spans: list[tuple[int, int, int]]) -> str:
    """base_sha256 of (kind number, start, end)."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], x[0]))).encode()).hexdigest()
