"""Vectorised text kernels shared by the corpus operators.

Documents arrive as Arrow batches. They are processed in *blocks*: whole documents whose UTF-8
bytes sum to at most ``BLOCK_BYTES`` (a longer document is a block of its own), so that memory in a
Python worker is bounded by the block and the longest document, never by the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash

BLOCK_BYTES = 4 << 20

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: Words of the decontamination contract: digits, ASCII letters and every byte of a non-ASCII character.
ALNUM_CLASS = np.zeros(256, bool)
ALNUM_CLASS[0x30:0x3A] = ALNUM_CLASS[0x41:0x5B] = ALNUM_CLASS[0x61:0x7B] = ALNUM_CLASS[0x80:] = True
#: Words of the SimHash contract: everything but space, tab, line breaks, vertical tab and form feed.
NONSPACE_CLASS = np.ones(256, bool)
NONSPACE_CLASS[[0x20, *range(0x09, 0x0E)]] = False

U64 = np.uint64
_P1, _P2, _P3 = U64(0x9E3779B185EBCA87), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9)
_P4, _P5 = U64(0x85EBCA77C2B2AE63), U64(0x27D4EB2F165667C5)
_LANE_MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=U64)


def filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system and the path in it; a path without a scheme is local."""
    if "://" not in path and not path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), path
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pyarrow.fs.FileSystem.from_uri(path)


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The texts as UTF-8; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def blocks(texts: list[bytes], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` bytes together, or of one text."""
    first, total = 0, 0
    for k, t in enumerate(texts):
        if k > first and total + len(t) > limit:
            yield first, k
            first, total = k, 0
        total += len(t)
    if first < len(texts):
        yield first, len(texts)


class Words:
    """Words of a block: ``start`` and ``end`` in ``buf``; those of text k are ``first[k]:first[k+1]``."""

    def __init__(self, texts: list[bytes], word_class: np.ndarray, lower: bool = True):
        joined = b"\n".join(texts) + b"\n"
        self.raw = joined.translate(_LOWER) if lower else joined
        n = len(joined)
        self.buf = np.frombuffer(self.raw + bytes(16), np.uint8)
        self.inside = inside = word_class[self.buf[:n]]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if n and inside[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[::2], edge[1::2]  # the last byte is a line break, in no class
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.offset = np.concatenate(([0], np.cumsum(sizes)))
        self.first = np.searchsorted(self.start, self.offset)

    def __len__(self) -> int:
        return len(self.start)

    def text_of(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U64(r)) | (x >> U64(64 - r))


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(33))
    h *= _P2
    h ^= h >> U64(29)
    h *= _P3
    h ^= h >> U64(32)
    return h


def lanes(buf: np.ndarray) -> np.ndarray:
    """``buf`` as little-endian 64-bit words at every byte offset; buf has 8 spare bytes at its end."""
    return np.ndarray(len(buf) - 8, "<u8", buf, strides=(1,))


def slice_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ``buf[start:end]``, the same for the same bytes wherever they lie."""
    lane, size = lanes(buf), (end - start).astype(np.int64)
    h = _mix((lane[start] & _LANE_MASK[np.minimum(size, 8)]) ^ (size.astype(U64) * _P4))
    left = np.flatnonzero(size > 8)
    for at in range(8, 264, 8):
        if not len(left):
            return h
        h[left] = _mix((h[left] * _P1) ^ (lane[start[left] + at] & _LANE_MASK[np.minimum(size[left] - at, 8)]))
        left = left[size[left] > at + 8]
    for k in left.tolist():
        h[k] ^= U64(xxhash.xxh64_intdigest(buf[start[k] : end[k]].tobytes()))
    return h


def xxh64(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """Standard XXH64 of each ``buf[start:end]``: short slices together by length, long ones singly."""
    size = end - start
    out = np.empty(len(size), U64)
    lane = lanes(buf)
    short = np.minimum(size, 32).astype(np.uint8)
    order = np.argsort(short, kind="stable")
    bound = np.searchsorted(short[order], np.arange(34))
    base = U64(seed) + _P5
    for n in range(32):
        own = order[bound[n] : bound[n + 1]]
        for lo in range(0, len(own), 1 << 15):  # small pieces stay in the cache
            k = own[lo : lo + (1 << 15)]
            at, h, left = start[k], np.full(len(k), base + U64(n), U64), n
            while left >= 8:
                x = lane[at] * _P2
                h = _rotl(h ^ (_rotl(x, 31) * _P1), 27) * _P1 + _P4
                at, left = at + 8, left - 8
            tail = lane[at]
            if left >= 4:
                h = _rotl(h ^ ((tail & U64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
                tail, left = tail >> U64(32), left - 4
            for _ in range(left):
                h = _rotl(h ^ ((tail & U64(0xFF)) * _P5), 11) * _P1
                tail = tail >> U64(8)
            out[k] = _mix(h)
    raw = memoryview(buf)
    for k in order[bound[32] :].tolist():
        out[k] = xxhash.xxh64_intdigest(raw[start[k] : end[k]], seed=seed)
    return out


def join_words(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with one space after each, as (buffer with spare bytes, start, end)."""
    size = words.end - words.start
    end = np.cumsum(size + 1) - 1
    keep = words.inside.copy()
    keep[words.end] = True
    spaced = words.buf[: len(keep)].copy()
    spaced[words.end] = 0x20
    return np.concatenate([spaced[keep], np.full(16, 0x20, np.uint8)]), end - size, end
