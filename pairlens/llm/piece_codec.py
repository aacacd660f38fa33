"""SentencePiece encoding and decoding by vectorised merge rounds.

A text becomes code points, blanks as U+2581 and one more of these in front. It is cut into words where no piece of the
vocabulary can reach across: before a run of U+2581, and around characters that are in no longer piece. The distinct words of
a batch of texts lie in one flat array of symbols. In each round

1. every pair of neighbours has a rank, by the score of the piece that it makes, and each word the least of its pairs' ranks;
2. all pairs of that rank are merged at once, from the left where they overlap;
3. the array is closed up, and words without a pair left are taken out,

until no word is left. The library merges one pair at a time. That is the same unless a merge makes a pair of the same or a
better rank while others of its round are still open; a word in which this happens (runs of blanks, whose pieces share one
score) starts again and has only its leftmost merge in each round.

Characters without a piece are spelled as byte pieces. Words of more than LONG characters go to the library, since they alone
would keep the rounds running; the ids are the same. Nothing is shuffled; a task holds about a MB of texts, or one text.

Files may hold a BPE model with byte fallback, without normalisation and without pieces defined by users or unused; others are
refused. Defined cases: a null text is empty; an empty one has the end id alone and decodes to an empty text; U+2581 in a text
decodes to a blank, as with the library; repeated rows each give a row; an empty table gives an empty one.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._merges import Pairs
from ._text import ranges, steps

#: Characters of a word beyond which it is left to the library.
LONG = 1024
_BLANK = 0x2581
_NONE = np.int64(1) << np.int64(62)
_GUARD = "\n"
#: How UTF-8 marks the first byte of a character of so many bytes.
_LEAD = np.array([0, 0, 0xC0, 0xE0, 0xF0])


class PieceModel:
    """The vocabulary as arrays: symbols below `size` are ids of pieces, those above are code points without a piece."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece.sentencepiece_model_pb2 import ModelProto

        with open(path, "rb") as f:
            proto = ModelProto.FromString(f.read())
        kinds, rules = [p.type for p in proto.pieces], proto.normalizer_spec
        plain = rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces and not rules.precompiled_charsmap
        if not plain or proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or {4, 5} & set(kinds):
            raise ValueError(f"{path}: not a BPE model with byte fallback and without normalisation")
        self.library = SentencePieceProcessor(model_file=path)
        self.size, self.end = len(kinds), self.library.eos_id()
        words = {p.piece: k for k, p in enumerate(proto.pieces) if kinds[k] == 1}
        self.symbol = np.arange(0x110000, dtype=np.int32) + np.int32(self.size)
        self.alone = np.ones(0x110000, bool)
        inner = False
        for piece, k in words.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = k
            else:
                self.alone[[ord(c) for c in piece]] = False
                inner |= chr(_BLANK) in piece.lstrip(chr(_BLANK))
        # where a piece may hold a blank after another character, blanks are no border
        self.border = not inner
        self.bytes = np.zeros(256, np.int32)
        spelled = [b""] * self.size
        for k, p in enumerate(proto.pieces):
            if kinds[k] == 6:
                b = int(p.piece[3:-1], 16)
                self.bytes[b], spelled[k] = k, bytes([b])
            elif kinds[k] == 1:
                spelled[k] = p.piece.replace(chr(_BLANK), " ").encode()
        self.spelled = pa.array(spelled, pa.large_binary())
        # a pair's rank is that of the piece it makes; pieces of one score share a rank
        score = {k: -proto.pieces[k].score for k in words.values()}
        place = {s: r for r, s in enumerate(sorted(set(score.values())))}
        made = [(words[p[:c]], words[p[c:]], k) for p, k in words.items() for c in range(1, len(p)) if p[:c] in words and p[c:] in words]
        left, right, self.made = np.array(made, np.int64).reshape(-1, 3).T
        self.pairs = Pairs(left, right)
        self.made = np.append(self.made, 0).astype(np.int32)
        self.rank = np.append(np.array([place[score[k]] for *_, k in made], np.int64), _NONE)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair of symbols, and the piece it makes."""
        found = self.pairs.rank(left, right)
        found = np.where(found < _NONE, found, len(self.rank) - 1)
        return self.rank[found], self.made[found]

    def merged(self, codes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of `size` code points each, one after the other, to symbols and their number in each word."""
        done = _Done()
        doubtful = self._rounds(self.symbol[codes], size, np.arange(len(size)), done, False)
        if len(doubtful):
            begin = np.cumsum(size) - size
            self._rounds(self.symbol[codes[ranges(begin[doubtful], size[doubtful])]], size[doubtful], doubtful, done, True)
        return done.in_order(len(size))

    def _rounds(self, sym: np.ndarray, size: np.ndarray, word: np.ndarray, done: _Done, single: bool) -> np.ndarray:
        """Merges until no pair remains; words whose merges may not be made at once are returned."""
        doubtful = [np.zeros(0, np.int64)]
        rank, made = np.full(len(sym), _NONE), np.zeros(len(sym), np.int32)
        if len(sym):
            rank[:-1], made[:-1] = self.ranks(sym[:-1], sym[1:])
            rank[np.cumsum(size) - 1] = _NONE
        while len(word):
            start = np.cumsum(size) - size
            best = np.minimum.reduceat(rank, start)
            live = best < _NONE
            if not live.all():
                on = np.repeat(live, size)
                done.add(word[~live], size[~live], sym[~on])
                sym, rank, made, word, size, best = sym[on], rank[on], made[on], word[live], size[live], best[live]
                if not len(word):
                    break
                start = np.cumsum(size) - size
            at = np.flatnonzero(rank == np.repeat(best, size))
            if single:
                at = at[np.searchsorted(at, start)]
            else:
                # of overlapping pairs every other one, from the left
                run = np.flatnonzero(np.concatenate([[True], np.diff(at) != 1]))
                at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
            of = np.searchsorted(start, at, "right") - 1
            sym[at] = made[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            fewer = np.bincount(of, minlength=len(word))
            at = at - np.arange(len(at))
            sym, rank, made, size = sym[keep], rank[keep], made[keep], size - fewer
            start = np.cumsum(size) - size
            last = start + size - 1
            worst = np.full(len(at), _NONE)
            ends = at == last[of]
            rank[at[ends]] = _NONE
            for fresh, q in ((~ends, at[~ends]), (at > start[of], at[at > start[of]] - 1)):
                rank[q], made[q] = self.ranks(sym[q], sym[q + 1])
                worst[fresh] = np.minimum(worst[fresh], rank[q])
            if not single:
                bad = np.zeros(len(word), bool)
                bad[of[(worst <= best[of]) & (fewer[of] > 1)]] = True
                if bad.any():
                    doubtful.append(word[bad])
                    on = np.repeat(~bad, size)
                    sym, rank, made, word, size = sym[on], rank[on], made[on], word[~bad], size[~bad]
        return np.sort(np.concatenate(doubtful))

    def spell(self, sym: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols to ids: code points without a piece become the pieces of their bytes."""
        code = sym.astype(np.int64) - self.size
        wide = np.where(code < 0, 1, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))
        at = np.repeat(np.arange(len(sym)), wide)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(wide) - wide, wide)
        code, w = code[at], wide[at]
        byte = np.where(nth == 0, _LEAD[w], 0x80) | ((code >> (6 * (w - 1 - nth))) & np.where((nth == 0) & (w == 1), 0x7F, 0x3F))
        total = np.concatenate([[0], np.cumsum(wide)])
        ends = np.cumsum(count)
        return np.where(code < 0, sym[at], self.bytes[np.where(code < 0, 0, byte)]), total[ends] - total[ends - count]

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of distinct words, and the number of each word's ids."""
        long = np.flatnonzero(pc.greater(pc.utf8_length(words), LONG).to_numpy(zero_copy_only=False))
        short = words if not len(long) else pc.if_else(pc.greater(pc.utf8_length(words), LONG), pa.scalar(chr(_BLANK), words.type), words)
        codes = np.frombuffer("".join(short.to_pylist()).encode("utf-32-le"), np.uint32)
        flat, count = self.spell(*self.merged(codes, pc.utf8_length(short).to_numpy().astype(np.int64)))
        if not len(long):
            return flat, count
        # what stands before the word is no part of it: the blank of the beginning and a character that merges with nothing
        head = len(self.library.encode(_GUARD))
        own = [np.array(self.library.encode(_GUARD + words[k].as_py())[head:], flat.dtype) for k in long.tolist()]
        parts = np.split(flat, (np.cumsum(count) - count)[long])
        count[long] = [len(x) for x in own]
        return np.concatenate([parts[0], *(x for pair in zip(own, (p[1:] for p in parts[1:]), strict=True) for x in pair)]), count


class _Done:
    """Words that are finished, in any order."""

    def __init__(self):
        self.word, self.size, self.sym = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]

    def add(self, word: np.ndarray, size: np.ndarray, sym: np.ndarray) -> None:
        self.word.append(word)
        self.size.append(size)
        self.sym.append(sym)

    def in_order(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        word, size, sym = map(np.concatenate, (self.word, self.size, self.sym))
        order = np.argsort(word, kind="stable")
        count = np.zeros(words, np.int64)
        count[word] = size
        return sym[ranges((np.cumsum(size) - size)[order], size[order])], count


@functools.lru_cache(2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


def _words(texts: pa.Array, model: PieceModel) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and which of them are each text's."""
    blank = chr(_BLANK)
    held = [blank + x.replace(" ", blank) if x else "" for x in texts.to_pylist()]
    whole = "".join(held)
    codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, held), np.int64, len(held)))])
    opens = np.zeros(len(codes) + 1, bool)
    if len(codes):
        alone = model.alone[codes]
        opens[:-1] = alone
        opens[1:] |= alone
        if model.border:
            is_blank = codes == _BLANK
            opens[1:-1] |= is_blank[1:] & ~is_blank[:-1]
    opens[ends] = True
    starts = np.flatnonzero(opens[:-1])
    at = np.concatenate([[0], np.cumsum(1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000))])
    edges = np.append(at[starts], at[-1])
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(whole.encode())])
    return words, np.searchsorted(starts, ends)


def _joined(parts: pa.Array, first: np.ndarray) -> pa.Array:
    """Parts first[k]:first[k + 1] as one byte string each."""
    ends = np.frombuffer(parts.buffers()[1], np.int64)[parts.offset : parts.offset + len(parts) + 1] if len(parts) else np.zeros(1, np.int64)
    raw = parts.buffers()[2] if len(parts) else None
    return pa.Array.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends[first])), raw if raw is not None else pa.py_buffer(b"")])


def _encoded(path: str, decode: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in steps(batches, "_text"):
            words, first = _words(batch.column("_text"), model)
            coded = words.dictionary_encode()
            index = coded.indices.to_numpy(zero_copy_only=False)
            ids, count = model.encode(coded.dictionary)
            begin, size = np.cumsum(count) - count, count[index]
            flat = ids[ranges(begin[index], size)]
            ends = np.concatenate([[0], np.cumsum(size)])[first]
            flat = np.insert(flat, ends[1:], model.end)
            out = [pa.ListArray.from_arrays(pa.array((ends + np.arange(len(ends))).astype(np.int32)), pa.array(flat, pa.int32()))]
            if decode:
                spelled = _joined(model.spelled.take(pa.array(ids)), np.concatenate([[0], np.cumsum(count)]))
                texts = _joined(spelled.take(pa.array(index)), first).cast(pa.large_string())
                out.append(pc.utf8_slice_codeunits(texts, 1).cast(pa.string()))  # without the blank of the beginning
            names = batch.schema.names[1:]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *out], [*names, "ids", *["decoded"] * decode])

    return run


def encode_pieces(docs: DataFrame, path: str, decode: bool = False, text: str = "text") -> DataFrame:
    """docs without its text, with ids array<int>, the end id last, and, if asked for, decoded string, the text of the ids. Of
    other columns of these names the older ones go."""
    kept = [f for f in docs.schema if f.name != text and f.name.lower() not in ("ids", *["decoded"] * decode)]
    rows = docs.select(F.col(f"`{text}`").cast("string").alias("_text"), *(F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(kept)))
    schema = ", ".join([*(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(kept)), "ids array<int>", *["decoded string"] * decode])
    out = rows.mapInArrow(_encoded(path, decode), schema)
    return out.select(*(F.col(f"c{i}").alias(f.name) for i, f in enumerate(kept)), "ids", *["decoded"] * decode)


def decode_pieces(frame: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """frame with a last column decoded: the texts of any ids, as the library decodes them; a null list gives a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = load(path).library
        for batch in batches:
            texts = [None if x is None else library.decode(x) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    kept = frame.select(*(c for c in frame.columns if c.lower() != "decoded"))
    return kept.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "decoded string"]))


def op12_sentencepiece_codec(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), decode=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
