"""Byte-pair merges of many words at once, exactly in the order of the ranks."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ._pretokens import load_tokenizer
from ._text import ranges

_NONE = np.int64(1) << np.int64(62)
_ODD = 0x9E3779B97F4A7C15
#: Bytes beyond which a word goes through the library: all words are merged in lockstep, one merge of each at a time.
LONG = 512


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: printable bytes for themselves, the rest in order from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Pairs:
    """Rank of a pair of ids, from tables of which each takes what found its slot used in the one before."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        key = self._key(left, right)
        self.tables: list[tuple[np.uint64, np.uint64, np.ndarray, np.ndarray]] = []
        rest, bits = np.arange(len(key)), max(8, int(4 * max(1, len(key))).bit_length())
        for level in range(64):
            if not len(rest):
                break
            odd = np.uint64(_ODD * (2 * level + 1) % (1 << 64))
            shift = np.uint64(64 - bits)
            slot = self._slot(key[rest], odd, shift)
            keys, values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, _NONE)
            _, first = np.unique(slot, return_index=True)
            keys[slot[first]], values[slot[first]] = key[rest[first]], rest[first]
            self.tables.append((odd, shift, keys, values))
            rest = np.delete(rest, first)
            bits = max(8, bits - 2)
        assert not len(rest)

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint64) << np.uint64(32)) + right.astype(np.uint64) + np.uint64(1)

    @staticmethod
    def _slot(key: np.ndarray, odd: np.uint64, shift: np.uint64) -> np.ndarray:
        return (((key ^ (key >> np.uint64(31))) * odd) >> shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = self._key(left, right)
        out = np.full(len(key), _NONE)
        todo = np.arange(len(key))
        for odd, shift, keys, values in self.tables:
            slot = self._slot(key[todo], odd, shift)
            held = keys[slot]
            same = held == key[todo]
            out[todo[same]] = values[slot[same]]
            todo = todo[~same & (held != 0)]
            if not len(todo):
                break
        return out


class Merger:
    """A byte-level BPE model from a file of the tokenizers library."""

    def __init__(self, path: str, tokenizer=None):
        """tokenizer: the library's, where it has been loaded from the path already."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        # of a pair named twice the library keeps the later rank
        last = {(vocab[a], vocab[b]): k for k, (a, b) in enumerate(pairs)}
        order = sorted(last, key=last.get)
        self.pairs = Pairs(np.array([a for a, _ in order], np.int64), np.array([b for _, b in order], np.int64))
        self.result = np.array([vocab[pairs[last[p]][0] + pairs[last[p]][1]] for p in order], np.int32)
        letters = byte_alphabet()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.final = np.array([vocab[c + suffix] for c in letters], np.int32)
        self.strings = {i: s for s, i in vocab.items()}
        self.letters, self.model = letters, (tokenizer or load_tokenizer(path)).model

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all words, and the number of each word's ids."""
        long = pc.greater(pc.binary_length(words), LONG)
        at = np.flatnonzero(long.to_numpy(zero_copy_only=False))
        if not len(at):
            return self._lockstep(words)
        flat, count = self._lockstep(pc.if_else(long, pa.scalar("", words.type), words))
        own = [np.array([t.id for t in self.model.tokenize("".join(map(self.letters.__getitem__, words[k].as_py().encode())))], np.int32) for k in at.tolist()]
        parts = np.split(flat, (np.cumsum(count) - count)[at])
        count[at] = [len(x) for x in own]
        return np.concatenate([parts[0], *(x for pair in zip(own, parts[1:], strict=True) for x in pair)]), count

    def _lockstep(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        kind = np.int64 if pa.types.is_large_string(words.type) else np.int32
        ends = np.frombuffer(words.buffers()[1], kind)[words.offset : words.offset + len(words) + 1].astype(np.int64) if len(words) else np.zeros(1, np.int64)
        raw = words.buffers()[2] if len(words) else None
        data = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
        size = np.diff(ends)
        sym = self.inner[data]
        filled = np.flatnonzero(size)
        stop = (ends - ends[0])[1:][filled] - 1
        sym[stop] = self.final[data[stop]]
        done_word, done_size, done_sym = [], [], []
        word, size = filled, size[filled]
        rank = self._ranks(sym, size)
        while len(word):
            start = np.cumsum(size) - size
            best = np.minimum.reduceat(rank + np.where(rank < _NONE, np.arange(len(rank)), 0), start)
            live = best < _NONE
            if not live.all():
                done_word.append(word[~live])
                done_size.append(size[~live])
                on = np.repeat(live, size)
                done_sym.append(sym[~on])
                moved = np.cumsum(on) - 1
                sym, rank, word, size, best = sym[on], rank[on], word[live], size[live], best[live]
                p = moved[(best & 0xFFFFFFFF)]
                if not len(word):
                    break
                start = np.cumsum(size) - size
            else:
                p = best & 0xFFFFFFFF
            sym[p] = self.result[best >> 32]
            keep = np.ones(len(sym), bool)
            keep[p + 1] = False
            last = np.zeros(len(sym), bool)
            last[start + size - 1] = True
            closing = last[p + 1]
            p = p - np.arange(len(p))  # one symbol goes in each word before
            sym, rank = sym[keep], rank[keep]
            rank[p[closing]] = _NONE
            q = p[~closing]
            rank[q] = self._packed(sym[q], sym[q + 1])
            q = p[p > start - np.arange(len(start))]
            rank[q - 1] = self._packed(sym[q - 1], sym[q])
            size = size - 1
        word = np.concatenate([*done_word, np.zeros(0, np.int64)]).astype(np.int64)
        count = np.zeros(len(words), np.int64)
        sizes = np.concatenate([*done_size, np.zeros(0, np.int64)]).astype(np.int64)
        count[word] = sizes
        flat = np.concatenate([*done_sym, np.zeros(0, np.int32)])
        order = np.argsort(word, kind="stable")
        begin = np.cumsum(sizes) - sizes
        return flat[ranges(begin[order], sizes[order])], count

    def _packed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        r = self.pairs.rank(a, b)
        return np.where(r < _NONE, r << np.int64(32), _NONE)

    def _ranks(self, sym: np.ndarray, size: np.ndarray) -> np.ndarray:
        rank = np.full(len(sym), _NONE)
        if len(sym) > 1:
            rank[:-1] = self._packed(sym[:-1], sym[1:])
        rank[np.cumsum(size) - 1] = _NONE
        return rank
