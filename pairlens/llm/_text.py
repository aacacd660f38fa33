"""Words of whole Arrow batches as numpy arrays: positions and hashes, no Python loop over words."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer single text is handled alone.
STEP_BYTES = 1 << 20

SPACES = np.ones(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = False
"""Word bytes where words are what lies between space, tab, LF, VT, FF and CR."""

_MASK = np.array([0, *((1 << 8 * k) - 1 for k in range(1, 9))], np.uint64)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offset of each; a null is an empty text."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of each piece have about `limit` bytes."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        lo = 0
        while lo < len(sizes):
            before = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi
    give_back()


def tidy(run: Callable) -> Callable:
    """run (batches to batches), after whose end the tables that it has held are given back, too."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def give_back() -> None:
    """A worker is used again: what a task has freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


class Words:
    """starts, ends: byte range of each word; first[d]:first[d + 1]: the words of document d."""

    def __init__(self, texts: pa.Array, is_word: np.ndarray = SPACES, mapped: np.ndarray | None = None):
        self.data, self.offsets = text_buffer(texts)
        if mapped is not None:
            self.data = mapped[self.data]
        inside = is_word[self.data]
        n = len(inside)
        opens, closes = inside.copy(), inside.copy()
        if n:
            opens[1:] &= ~inside[:-1]
            closes[:-1] &= ~inside[1:]
            at = self.offsets[:-1][self.offsets[:-1] < n]
            opens[at] |= inside[at]
            to = self.offsets[1:]
            to = to[to > 0] - 1
            closes[to] |= inside[to]
        self.starts, self.ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.starts, self.offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self, which: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each word, eight bytes a step."""
        starts, ends = (self.starts, self.ends) if which is None else (self.starts[which], self.ends[which])
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        lanes = np.ndarray((len(self.data) + 1,), "<u8", buffer=padded.data, strides=(1,))
        left = ends - starts
        h = mixed(left.astype(np.uint64) * _M2)
        lane = lanes[starts] & _MASK[np.minimum(left, 8)]
        h = mixed(h ^ lane)
        more, at = np.flatnonzero(left > 8), 8
        while len(more):
            lane = lanes[starts[more] + at] & _MASK[np.minimum(left[more] - at, 8)]
            h[more] = mixed(h[more] + _M1 ^ lane)
            at += 8
            more = more[left[more] > at]
        return h

    def joined(self, keep: np.ndarray) -> list[str]:
        """Each document's words for which keep holds, joined by one space."""
        lengths = np.where(keep, self.ends - self.starts + 1, 0)
        byte = np.zeros(len(self.data) + 1, np.int8)
        byte[self.starts[keep]] += 1
        byte[self.ends[keep]] -= 1
        taken = np.cumsum(byte[:-1], dtype=np.int8).astype(bool)
        # one separator byte follows each word; words that touch the next document's first byte get one too
        out = np.full(int(lengths.sum()), 0x20, np.uint8)
        to = np.cumsum(lengths[keep]) - lengths[keep]
        size = lengths[keep] - 1
        spot = np.zeros(len(out) + 1, np.int8)
        spot[to] += 1
        np.add.at(spot, to + size, -1)
        out[np.cumsum(spot[:-1], dtype=np.int8).astype(bool)] = self.data[taken]
        per_doc = np.concatenate([[0], np.cumsum(lengths)])[self.first]
        flat = out.tobytes()
        return [flat[a : max(a, b - 1)].decode("utf-8", "replace") for a, b in zip(per_doc[:-1].tolist(), per_doc[1:].tolist(), strict=True)]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h * _M1
    h ^= h >> np.uint64(32)
    h *= _M2
    h ^= h >> np.uint64(29)
    return h


def position_keys(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers."""
    return np.random.default_rng(seed).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def window_hashes(h: np.ndarray, at: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Hash of the len(keys) words from each position in `at`."""
    out = np.zeros(len(at), np.uint64)
    for k, key in enumerate(keys):
        out += h[at + k] * key
    return mixed(out)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every range, one after the other."""
    if not len(starts) or not lengths.sum():
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)
