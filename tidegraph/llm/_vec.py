"""Whole Arrow batches of texts as byte arrays: words, their 64-bit hashes and word shingles, by NumPy and without a Python loop per word.

A word's hash takes in 8 bytes a step, and mixes all bits after each. Unlike a polynomial modulo 2**64, for which whole families of
words are known that collide whatever its base, it has no algebra that bytes could cancel out in; two words' hashes are taken for equal
by chance with a probability of about 2**-64."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 2_000_000
_rng = np.random.default_rng(20240607)
SEED = np.uint64(_rng.integers(1, 2**64 - 1, dtype=np.uint64, endpoint=True))
BASE = 0x9E3779B97F4A7C15
LONG = 512
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """From an Arrow string array: pieces of whole texts of about `size` bytes, as first row, end row, bytes, and offsets of rows in them. Null: empty."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs without white space, none across texts, and each word's text."""
    ink = ~SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before, after = np.empty_like(ink), np.empty_like(ink)
    before[:1], after[-1:] = True, True
    before[1:], after[:-1] = ~ink[:-1], ~ink[1:]
    starts = np.flatnonzero(ink & (before | edge[:-1]))
    ends = np.flatnonzero(ink & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def blocks_of(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as a number, zeros after the end: a view, without a copy for each place."""
    return np.ndarray((len(data) + 1,), dtype="<u8", buffer=np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))


#: For a last step of 0 to 8 bytes: which bits of the number are its bytes, and what marks its length in the top byte. With the mark that byte is none that UTF-8 has.
_BITS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_MARK = np.array([(0xF8 ^ k) << 56 for k in range(8)] + [0], dtype=np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte strings between starts and ends: 8 bytes at a time, each step mixed with all before it; different UTF-8 strings of 8 bytes at
    most have different ones. Of strings over LONG bytes by BLAKE2."""
    size, eight = ends - starts, blocks_of(data)
    left = np.minimum(size, 8)
    out = mixed((eight[starts] & _BITS[left]) ^ _MARK[left] ^ SEED)
    at, open_ = 8, np.flatnonzero((size > 8) & (size <= LONG))
    while len(open_):
        left = np.minimum(size[open_] - at, 8)
        out[open_] = mixed((out[open_] ^ (eight[starts[open_] + at] & _BITS[left]) ^ _MARK[left]) * np.uint64(BASE) + SEED)
        at += 8
        open_ = open_[size[open_] > at]
    for i in np.flatnonzero(size > LONG):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "big")
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Each word's hash (A-Z lower-cased on request) and text."""
    data = LOWER[data] if lower else data
    starts, ends, row = word_bounds(data, offsets)
    return span_hashes(data, starts, ends), row


_PLACE = _rng.integers(1, 2**64 - 1, 64, dtype=np.uint64, endpoint=True) | np.uint64(1)


def shingles(words: np.ndarray, row: np.ndarray, rows: int, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n-word shingles in order, with bounds per text (rows + 1); a text of fewer words, but not none, has one, of them all."""
    count = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(count)])
    made = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(made)])
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - first[:-1], made)
    long = np.repeat(np.minimum(count, n), made)
    total = long.astype(np.uint64)
    for k in range(n):
        there = long > k
        total = total + np.where(there, words[np.minimum(at + k, len(words) - 1)] * _PLACE[k], np.uint64(0)) if len(words) else total
    return mixed(total), bounds
