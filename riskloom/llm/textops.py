"""Byte-level text primitives on Arrow string columns, vectorised over many texts.

An Arrow string column is one UTF-8 buffer plus offsets. Words, lines and
n-gram hashes are found on that buffer with a constant number of numpy passes,
so the cost per text is a few nanoseconds a byte and no per-word Python runs.
A word is a maximal run of bytes outside {0x20, 0x09-0x0D}; bytes of multi-byte
characters never fall in that set, so byte and code-point words are the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19  # texts handled in one numpy call; a longer text is a chunk of its own

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32

_rng = np.random.default_rng(20240917)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE[ASCII_LOWER]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_NGRAM = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(which: str, n: int) -> np.ndarray:
    have = _powers[which]
    if len(have) < n:
        base = _BASE if which == "up" else _BASE_INV
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        _powers[which] = have = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def mix64(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def utf8(col) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, valid) of an Arrow string column; a null is an empty text with valid False."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    valid = np.asarray(col.is_valid())
    if col.null_count:
        col = col.fill_null("")
    _, ob, db = col.buffers()
    offs = np.frombuffer(ob, np.int64)[col.offset:col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(db, np.uint8)[offs[0]:offs[-1]] if db is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0], valid


def chunks(offs: np.ndarray, most: int = CHUNK_BYTES, most_texts: int = 1 << 15) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of texts of at most ``most`` bytes together (one text at least)."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        j = min(j, n, i + most_texts)
        yield i, j
        i = j


def per_text(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` over each text's bytes."""
    c = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=c[1:])
    return c[offs[1:]] - c[offs[:-1]]


@dataclass
class Words:
    start: np.ndarray   # first byte
    end: np.ndarray     # one past the last byte
    text: np.ndarray    # index of the text
    first: np.ndarray   # per text: its first word; length texts + 1
    hash: np.ndarray    # 64 bits


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of bytes [start, end) from the prefix sums of ``prefix_sums``."""
    h = (prefix[end] - prefix[start]) * _power("down", len(prefix))[start]
    return mix64(h + (end - start).astype(np.uint64))


def prefix_sums(data: np.ndarray, lower: bool = False) -> np.ndarray:
    p = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * _power("up", len(data)), dtype=np.uint64, out=p[1:])
    return p


def words(data: np.ndarray, offs: np.ndarray, prefix: np.ndarray | None = None, lower: bool = False) -> Words:
    """All words of all texts; ``lower`` folds A-Z in the hashes."""
    n = len(data)
    inside = ~IS_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | cut[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:n]
    start, end = np.flatnonzero(begin), np.flatnonzero(last) + 1
    first = np.searchsorted(start, offs)
    text = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    prefix = prefix_sums(data, lower) if prefix is None else prefix
    return Words(start, end, text, first, span_hash(prefix, start, end))


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Order-sensitive hash of every n consecutive words (windows across texts included)."""
    m = max(0, len(hashes) - n + 1)
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out = out * _NGRAM + hashes[j:j + m]
    return mix64(out)
