"""Word shingles of many texts at once, on the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Words of a shingle; a text of fewer words, but not none, is one shingle.
SIZE = 5
#: Bytes handled at a time.
BLOCK = 1 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads them evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64, and of its inverse."""
    base = 0xD1342543DE82EF95
    up, down = np.full(n, base, dtype=np.uint64), np.full(n, pow(base, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of the column's texts, of about `size` bytes; null counts as empty."""
    column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        last = min(last, len(column))
        yield first, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every word: runs of bytes that aren't ASCII white space, within a text."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inner = (data != 32) & (data - np.uint8(9) > 4)  # no ASCII white space
    edges = np.flatnonzero(inner[1:] != inner[:-1]) + 1
    edges = np.concatenate([[0] * int(inner[0]), edges, [len(data)] * int(inner[-1])]).astype(np.int64)
    inside = offsets[(offsets > 0) & (offsets < len(data))]
    inside = np.unique(inside[inner[inside - 1] & inner[inside]])  # texts that begin where a word goes on
    edges = np.insert(edges, np.repeat(np.searchsorted(edges, inside), 2), np.repeat(inside, 2))
    starts, ends = edges[::2], edges[1::2]
    up, down = powers(1 << max(20, int(len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * ODD)
    return hashes, np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every shingle, repeats included."""
    word, text = words(data, offsets)
    scale = mix(np.arange(1, size + 1, dtype=np.uint64) * ODD) | np.uint64(1)
    whole = np.flatnonzero(text[: len(text) - size + 1] == text[size - 1 :]) if len(text) >= size else np.zeros(0, np.int64)
    total = np.zeros(len(whole), dtype=np.uint64)
    for k in range(size):
        total += word[whole + k] * scale[k]
    counts = np.bincount(text, minlength=len(offsets) - 1)
    few = np.flatnonzero((counts > 0) & (counts < size))
    if len(few):
        at = np.searchsorted(text, few)
        short = np.zeros(len(few), dtype=np.uint64)
        for k in range(size - 1):
            has = counts[few] > k
            short[has] += word[at[has] + k] * scale[k]
        total, whole_text = np.concatenate([total, short + ODD]), np.concatenate([text[whole], few])
        order = np.argsort(whole_text, kind="stable")
        return mix(total[order]), whole_text[order]
    return mix(total), text[whole]


def multisets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, times, text) of every distinct shingle of each text, texts in order."""
    sh, text = shingles(data, offsets)
    own = mix(sh + mix(text.astype(np.uint64) * ODD))
    order = np.lexsort((own, text))
    own, sh, text = own[order], sh[order], text[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    return sh[first], np.diff(np.append(first, len(own))), text[first]


def pack(units: np.ndarray, size: int = 5) -> bytes:
    """Integers of size bytes each."""
    return units.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def unpack(raw: bytes, size: int = 5) -> np.ndarray:
    out = np.zeros((len(raw) // size, 8), dtype=np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8).reshape(-1, size)
    return out.view("<u8").ravel()
