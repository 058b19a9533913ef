"""Vectorised word access over Arrow text columns.

A text column of an Arrow batch is one byte buffer with offsets. ``Words`` finds
every word of every text in that buffer with numpy and gives each word a 64-bit
polynomial hash, so operators work on arrays of word hashes instead of Python
strings. Nulls have no words; words never span two texts.

Equality of words, shingles and windows is equality of these hashes: a false
match needs a 64-bit collision.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)      # of the GNU C library
SLICE_BYTES = 1 << 18          # text bytes held in numpy form at a time (about 60 bytes each)
_MUL = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D


def _inverse(a: int) -> int:
    return pow(a, -1, 1 << 64)


class _Powers:
    """Powers of the hash base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self):
        self.n = 0
        self.up = self.down = np.empty(0, np.uint64)

    def upto(self, n: int):
        if n > self.n:
            self.n = max(n, SLICE_BYTES)
            self.up = np.full(self.n, _BASE, np.uint64)
            self.down = np.full(self.n, _inverse(_BASE), np.uint64)
            self.up[0] = self.down[0] = 1
            np.multiply.accumulate(self.up, out=self.up)
            np.multiply.accumulate(self.down, out=self.down)
        return self.up[:n], self.down


_POWERS = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Alphabet:
    """Which bytes belong to words, and the hash value of each byte."""

    def __init__(self, separators: bytes, fold_ascii_case: bool):
        self.inside = np.ones(256, bool)
        self.inside[list(separators)] = False
        value = mix(np.arange(1, 257, dtype=np.uint64) * _MUL)
        if fold_ascii_case:
            for of in (value, self.inside):
                of[ord("A"):ord("Z") + 1] = of[ord("a"):ord("z") + 1]
        self.value = value


WHITE = bytes([0x20, *range(0x09, 0x0E)])
NOT_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


class Words:
    """Words of the texts in ``data`` cut at ``offsets`` (n + 1 of them).

    start, end: byte range of each word; hash: its hash; first: index of each
    text's first word (n + 1 entries).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, alphabet: Alphabet):
        n = len(data)
        inside = alphabet.inside[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | edge[:n]))
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets).astype(np.int64)
        up, down = _POWERS.upto(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(alphabet.value[data] * up, out=total[1:])
        length = (self.end - self.start).astype(np.uint64)
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start] + length * _MUL)

    def __len__(self):
        return len(self.start)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive entries of h (len(h) - k + 1 of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _POWERS.upto(len(h))
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up, out=total[1:])
    return mix((total[k:] - total[:n]) * down[:n] + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64)))


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; nulls become empty."""
    width = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) else "")
    _, off, data = texts.buffers()
    at = np.frombuffer(off, width)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64) \
        if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


_KEPT: dict[str, object] = {}


def kept(name: str, make: Callable):
    """What a Python worker keeps between the tasks of one operator. Tasks of any other
    operator free it: workers are reused, and what each keeps is the executor's memory."""
    if name not in _KEPT:
        give_back()
        _KEPT[name] = make()
    return _KEPT[name]


def give_back(keeps: str | None = None) -> None:
    """Returns freed memory to the system, and all that is ``kept`` but under ``keeps``:
    an executor's workers share what its heap leaves."""
    others = [name for name in _KEPT if name != keeps]
    if others:
        for name in others:
            del _KEPT[name]
        gc.collect()
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES,
           keeps: str | None = None) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about ``limit`` text bytes (at least a row).
    Frees what the worker has ``kept`` but under ``keeps``."""
    give_back(keeps)
    for b in batches:
        _, off = text_buffer(b.column(text))
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
            yield b.slice(i, j - i)
            i = j
        del b, off
        give_back(keeps)


def byte_views(raw: np.ndarray, off: np.ndarray) -> list[str]:
    """The texts of a buffer as Python strings."""
    data = raw.tobytes()
    return [data[a:b].decode("utf-8", "replace") for a, b in zip(off[:-1], off[1:])]
