"""Pre-tokens of whole Arrow batches, cut with numpy where the tokenizers library would cut them.

The classes of characters (letter, number, other, white space) are asked of the library itself, once for each character
that occurs. Texts that hold the string of an added token are left to the library as a whole. For the lower-casing
tokenizer a stretch between white space that has a character which composition or lower-casing could change together with
its neighbours (marks, vowels of Hangul) is one odd word, spelled as it stands: no composition, case or pre-token reaches
over white space, so the library gives the same ids for the stretch alone.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ._text import text_buffer

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

SPACE, LETTER, NUMBER, OTHER, UNKNOWN, HARD = 0, 1, 2, 3, 255, 254
_QUOTE, _BLANK = ord("'"), 0x20
_ONE = np.array([ord(c) for c in "stmd"], np.uint32)
_TWO = [(ord(a), ord(b)) for a, b in ("re", "ve", "ll")]


def load_tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Characters:
    """Class and lower case of each character, as the tokenizer has them."""

    def __init__(self, tokenizer, fold: bool):
        self.tokenizer, self.fold = tokenizer, fold
        self.kind = np.full(0x110000, UNKNOWN, np.uint8)
        self.lower = np.arange(0x110000, dtype=np.uint32)

    def learn(self, codes: np.ndarray) -> None:
        new = np.unique(codes[self.kind[codes] == UNKNOWN])
        for c in new.tolist():
            self.kind[c] = self._kind(c)

    def _kind(self, c: int) -> int:
        char = chr(c)
        if self.fold:
            lowered = self.tokenizer.normalizer.normalize_str(char)
            # what may join with a neighbour in composition: marks, and the vowels and finals of Hangul syllables
            joins = unicodedata.category(char)[0] == "M" or 0x1160 <= c <= 0x11FF or 0xD7B0 <= c <= 0xD7FF
            if len(lowered) != 1 or joins or c == 0x3A3:
                return HARD
            self.lower[c] = ord(lowered)
            char = lowered
        spans = lambda text: [tuple(b) for _, b in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        if spans(f"b{char}") == [(0, 2)]:
            return LETTER
        # a digit joins a digit, or stands alone in both places
        if (0, 2) in (a := spans(f"#{char}")):
            return OTHER
        return SPACE if char.isspace() or not any(s <= 1 < e for s, e in a) else NUMBER


def _starts(codes: np.ndarray, kind: np.ndarray, doc_start: np.ndarray, attach: bool, single_numbers: bool) -> np.ndarray:
    """Where a pre-token begins. attach: a blank goes with what follows it, as in ` ?\\p{L}+`."""
    n = len(codes)
    start = np.ones(n, bool)
    start[1:] = (kind[1:] != kind[:-1]) | doc_start[1:]
    if single_numbers:
        start |= kind == NUMBER
    run = np.flatnonzero(start)
    # contractions: a quote that begins a run and is followed by s, t, m, d, re, ve or ll
    quote = run[(codes[run] == _QUOTE) & (kind[run] == OTHER)]
    if attach:
        quote = quote[~((codes[np.maximum(quote - 1, 0)] == _BLANK) & ~doc_start[quote] & (quote > 0))]
    quote = quote[quote + 1 < n]
    quote = quote[~doc_start[quote + 1]]
    one = quote[np.isin(codes[quote + 1], _ONE)]
    two = quote[quote + 2 < n]
    two = two[~doc_start[two + 2]]
    two = two[np.any([(codes[two + 1] == a) & (codes[two + 2] == b) for a, b in _TWO], axis=0)] if len(two) else two
    if attach:
        # the last blank before a run belongs to it; what is before that blank stays together
        first = run[(kind[run] != SPACE) & (run > 0)]
        first = first[~doc_start[first] & (kind[first - 1] == SPACE)]
        start[first - 1] = True
        start[first[codes[first - 1] == _BLANK]] = False
    for at, k in ((one, 1), (two, 2)):
        start[at + 1] = False
        after = at + 1 + k
        start[after[after < n]] = True
    return start


#: White space that nothing composes with.
_WHITE = np.array([0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20], np.uint32)


def _odd_stretches(codes: np.ndarray, kind: np.ndarray, doc_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which characters are in a stretch with one that is HARD, and where such stretches begin."""
    white = np.isin(codes, _WHITE) & (kind == SPACE)
    new = doc_start | white
    new[1:] |= white[:-1]
    stretch = np.cumsum(new) - 1
    odd = np.zeros(int(stretch[-1]) + 1, bool)
    odd[stretch[kind == HARD]] = True
    inside = odd[stretch]
    return inside, inside & new


class PreTokens:
    """words: all pre-tokens of the documents that are not hard, in order; first[d]:first[d + 1] are those of document d;
    odd: which of them are for the library to encode."""

    def __init__(self, texts: pa.Array, characters: Characters, special: list[str], attach: bool, fold: bool):
        hard = np.zeros(len(texts), bool)
        for s in special:
            hard |= pc.fill_null(pc.match_substring(texts, s), False).to_numpy(zero_copy_only=False)
        data, offsets = text_buffer(texts)
        if hard.any():
            keep = np.repeat(~hard, np.diff(offsets))
            data = data[keep]
            offsets = np.concatenate([[0], np.cumsum(np.where(hard, 0, np.diff(offsets)))])
        self.hard = hard
        codes, at = _codes(data, offsets)
        characters.learn(codes)
        kind = characters.kind[codes]
        doc_start = np.zeros(len(codes) + 1, bool)
        doc_start[at[:-1]] = True
        doc_start = doc_start[:-1]
        odd = np.zeros(len(codes), bool)
        if fold:
            lower = characters.lower[codes]
            if (kind == HARD).any():
                odd, begins = _odd_stretches(codes, kind, doc_start)
                lower = np.where(odd, codes, lower)
                kind = np.where(odd, LETTER, kind)
            codes = lower
        start = _starts(codes, kind, doc_start, attach, single_numbers=fold) if len(codes) else np.zeros(0, bool)
        if odd.any():
            start[odd] = begins[odd]
        if fold:
            solid = kind != SPACE
            at = np.concatenate([[0], np.cumsum(solid)])[at]
            codes, start, odd = codes[solid], start[solid], odd[solid]
            data = np.frombuffer(codes.tobytes().decode("utf-32-le").encode(), np.uint8)
        where = np.flatnonzero(start)
        self.odd = odd[where]
        self.first = np.searchsorted(where, at)
        byte = np.flatnonzero((data & 0xC0) != 0x80)
        ends = np.append(byte[where], len(data)).astype(np.int64)
        self.words = pa.Array.from_buffers(pa.large_string(), len(where), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


def _codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points, and the offsets in code points."""
    codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return codes, lead[offsets]
