"""BPE encoding and decoding over a lexicon of frequent words.

The words (pre-tokens) of all documents are counted; the LEXICON most frequent are encoded once and compiled into a
minimal acyclic transducer: words share prefixes and suffixes, and the numbers on the arcs of a word's path add up to
its place in the lexicon, which leads to its ids. The transducer is one flat buffer, broadcast; each Python worker puts
it into a private file, unlinked at once, and maps it (2 MB or so: executors share no folder for scratch files that could
hold one copy for all). All distinct words of a batch walk the transducer in lockstep; words that it lacks are merged
exactly, pair by pair in rank order. LEXICON bounds the driver's and the workers' part.

Stretches between white space with characters that compose or fold together with their neighbours (marks of Arabic, Hebrew,
Hindi or Thai, decomposed letters) are words like all others in the lexicon; those that it lacks are encoded by the library,
each distinct one once for a batch.

Decoding joins the tokens' strings as the library does for a file without a decoder.

Defined cases: a null text is empty, has no ids and decodes to an empty text; repeated rows each give a row; texts
with strings of added tokens go through the library as a whole.
"""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._merges import Merger
from ._pretokens import HARD, Characters, PreTokens, load_tokenizer
from ._shared import stored
from ._text import give_back, ranges, steps, tidy

#: Words in the transducer, and the most bytes of each.
LEXICON, WORD_BYTES = 16_384, 48


class Transducer:
    """words: sorted distinct byte strings; ids[k] for the k-th."""

    NAMES = ("keys", "targets", "skips", "final", "begin", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]):
        for name in self.NAMES:
            setattr(self, name, arrays[name])

    @classmethod
    def build(cls, words: list[bytes], ids: list[list[int]]) -> Transducer:
        known: dict[tuple, int] = {}
        states: list[tuple] = []

        def settled(node: list) -> int:
            """node: [final, {byte: state}]; equal nodes become one state."""
            shape = (node[0], tuple(sorted(node[1].items())))
            if shape not in known:
                known[shape] = len(states)
                states.append(shape)
            return known[shape]

        path, before = [[False, {}]], b""
        for word in words:
            same = len(os.path.commonprefix([before, word]))
            while len(path) > same + 1:
                node = path.pop()
                path[-1][1][before[len(path) - 1]] = settled(node)
            path += [[False, {}] for _ in word[same:]]
            path[-1][0] = True
            before = word
        while len(path) > 1:
            node = path.pop()
            path[-1][1][before[len(path) - 1]] = settled(node)
        root = settled(path[0])
        # states are numbered after the states they lead to
        held = []
        for final, arcs in states:
            held.append(final + sum(held[t] for _, t in arcs))
        rows = [(s, b, t) for s, (_, arcs) in enumerate(states) for b, t in arcs]
        skips, at = [], None
        for s, _, t in rows:
            if s != at:
                at, below = s, int(states[s][0])
            skips.append(below)
            below += held[t]
        number = {s: (s + 1) % len(states) for s in range(len(states))}  # the root becomes state 0
        assert root == len(states) - 1
        keys = np.array([number[s] * 256 + b for s, b, _ in rows], np.int64)
        order = np.argsort(keys)
        final = np.zeros(len(states), bool)
        final[[number[s] for s, (f, _) in enumerate(states) if f]] = True
        sizes = np.array([len(x) for x in ids], np.int64)
        return cls({
            "keys": keys[order], "targets": np.array([number[t] for *_, t in rows], np.int64)[order], "skips": np.array(skips, np.int64)[order],
            "final": final, "begin": np.concatenate([[0], np.cumsum(sizes)]), "ids": np.array([i for x in ids for i in x], np.int32),
        })

    def packed(self) -> bytes:
        arrays = [np.ascontiguousarray(getattr(self, n)) for n in self.NAMES]
        head = json.dumps([[n, a.dtype.str, len(a)] for n, a in zip(self.NAMES, arrays, strict=True)]).encode()
        head = len(head).to_bytes(8, "little") + head
        out = head + b"\0" * (-len(head) % 8)
        for a in arrays:
            out += a.tobytes() + b"\0" * (-a.nbytes % 8)
        return out

    @classmethod
    def mapped(cls, packed: bytes) -> Transducer:
        with tempfile.TemporaryFile() as f:
            f.write(packed)
            f.flush()
            whole = np.memmap(f, np.uint8, "r")
        n = int.from_bytes(whole[:8].tobytes(), "little")
        at, arrays = 8 + n + -(8 + n) % 8, {}
        for name, kind, size in json.loads(whole[8 : 8 + n].tobytes()):
            wide = np.dtype(kind).itemsize * size
            arrays[name] = whole[at : at + wide].view(kind)
            at += wide + -wide % 8
        return cls(arrays)

    def find(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Place in the lexicon of each word (bytes data[ends[k]:ends[k + 1]]), or -1."""
        size = np.diff(ends)
        out = np.full(len(size), -1, np.int64)
        if not len(self.keys):
            return out
        on = np.flatnonzero((size > 0) & (size <= WORD_BYTES))
        state, place, at = np.zeros(len(on), np.int64), np.zeros(len(on), np.int64), ends[:-1][on]
        stop = ends[1:][on]
        while len(on):
            key = state * 256 + data[at]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            held = self.keys[arc] == key
            arc, on, at, stop = arc[held], on[held], at[held] + 1, stop[held]
            state, place = self.targets[arc], place[held] + self.skips[arc]
            over = at == stop
            ended = over & self.final[state]
            out[on[ended]] = place[ended]
            state, place, on, at, stop = state[~over], place[~over], on[~over], at[~over], stop[~over]
        return out


def _cutters(path: str):
    tokenizer = load_tokenizer(path)
    return tokenizer, [t.content for t in tokenizer.get_added_tokens_decoder().values()], Characters(tokenizer, fold=True)


def _tools(path: str):
    tokenizer, special, characters = _cutters(path)
    merger = Merger(path, tokenizer)
    give_back()  # the file as Python read it
    return tokenizer, special, characters, merger


def _word_counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, special, characters = _cutters(path)
        for batch in steps(batches):
            coded = PreTokens(batch.column("text"), characters, special, attach=False, fold=True).words.dictionary_encode()
            n = np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(coded.dictionary))
            rows = pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.string()), pa.array(n.astype(np.int64))], ["word", "n"])
            yield rows.filter(pc.less_equal(pc.binary_length(rows.column("word")), WORD_BYTES))

    return tidy(run)


def frequent_words(docs: DataFrame, path: str, size: int = LEXICON) -> list[str]:
    """The most frequent words of all documents, at most `size` of them; of equally frequent ones the smaller."""
    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_word_counts(path), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    chosen = most_frequent(stored(counts, "words"), size)
    return [r.word for r in chosen.orderBy("word").collect()]


def most_frequent(counts: DataFrame, size: int) -> DataFrame:
    """The `size` rows of counts (word, n, ...) that have the highest n; of equal ones those of smaller words."""
    # a histogram of a few hundred rows tells from which count on there are enough words
    step = F.floor(F.log2("n") * 8)
    held, least = 0, 0
    for r in sorted(counts.groupBy(step.alias("b")).count().collect(), key=lambda r: -r.b):
        held, least = held + r["count"], r.b
        if held >= size:
            break
    # written, so that the cut to `size` rows is made in a task and not on the driver
    return stored(counts.filter(step >= least).orderBy(F.desc("n"), "word").limit(size), "lexicon")


def compile_lexicon(words: list[str], path: str) -> Transducer:
    tokenizer, _, characters, merger = _tools(path)
    spelled = sorted({w.encode() for w in words})
    texts = pa.array([w.decode() for w in spelled], pa.large_string())
    odd = np.zeros(len(texts), bool)
    if len(texts):
        codes = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
        characters.learn(codes)
        ends = np.cumsum(pc.utf8_length(texts).to_numpy())
        odd = np.diff(np.concatenate([[0], np.cumsum(characters.kind[codes] == HARD)])[np.concatenate([[0], ends])]) > 0
    ids = _ids_of(texts, odd, tokenizer, merger)
    return Transducer.build(spelled, [x.tolist() for x in ids])


def _ids_of(words: pa.Array, odd: np.ndarray, tokenizer, merger: Merger) -> list[np.ndarray]:
    """The ids of each word: by the library where it is odd, else merged."""
    flat, count = merger.encode(words.filter(pa.array(~odd)))
    merged = iter(np.split(flat, np.cumsum(count)[:-1])) if len(count) else iter(())
    asked = iter(tokenizer.encode(w, add_special_tokens=False).ids for w in words.filter(pa.array(odd)).to_pylist())
    return [np.array(next(asked), np.int64) if x else next(merged) for x in odd.tolist()]


def _encoded(path: str, packed, text: str, decode: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, special, characters, merger = _tools(path)
        lexicon = Transducer.mapped(packed.value)
        strings = pa.array([merger.strings.get(i, "") + " " for i in range(max(merger.strings) + 1)], pa.large_string()) if decode else None
        merger.strings = None
        give_back()
        for batch in steps(batches, text):
            pre = PreTokens(batch.column(text), characters, special, attach=False, fold=True)
            coded = pre.words.dictionary_encode()
            index, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
            odd = np.zeros(len(words), bool)
            odd[index[pre.odd]] = True
            begin, count, ids = _word_ids(words, odd, lexicon, tokenizer, merger)
            size = count[index]
            flat = ids[ranges(begin[index], size)]
            ends = np.concatenate([[0], np.cumsum(size)])[pre.first]
            out = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat, pa.int32()))]
            if decode:
                out.append(_spelled(strings, ids, begin, count, index, pre.first))
            rest = [c for c in batch.schema.names if c != text]
            rows = pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *out], [*rest, "ids", *["decoded"] * decode])
            yield rows.filter(pa.array(~pre.hard)) if pre.hard.any() else rows
            if pre.hard.any():
                at = pa.array(np.flatnonzero(pre.hard))
                own = [tokenizer.encode(x.as_py(), add_special_tokens=False).ids for x in batch.column(text).take(at)]
                out = [pa.array(own, pa.list_(pa.int32()))]
                if decode:
                    out.append(pa.array([tokenizer.decode(x, skip_special_tokens=False) for x in own], pa.string()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in rest), *out], rows.schema.names)

    return tidy(run)


def _word_ids(words: pa.Array, odd: np.ndarray, lexicon: Transducer, tokenizer, merger: Merger) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """begin, count and ids, so that word k has ids[begin[k]:begin[k] + count[k]]."""
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    raw = words.buffers()[2] if len(words) else None
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    place = lexicon.find(data, ends)
    strange = np.flatnonzero((place < 0) & odd)
    unseen = np.flatnonzero((place < 0) & ~odd)
    merged, size = merger.encode(words.take(pa.array(unseen)))
    if len(strange):
        asked = [tokenizer.encode(w, add_special_tokens=False).ids for w in words.take(pa.array(strange)).to_pylist()]
        unseen, size = np.concatenate([unseen, strange]), np.concatenate([size, [len(x) for x in asked]]).astype(np.int64)
        merged = np.concatenate([merged, np.array([i for x in asked for i in x], merged.dtype)])
    begin, count = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    seen = place >= 0
    begin[seen] = lexicon.begin[place[seen]]
    count[seen] = lexicon.begin[place[seen] + 1] - begin[seen]
    begin[unseen] = len(lexicon.ids) + np.cumsum(size) - size
    count[unseen] = size
    return begin, count, np.concatenate([lexicon.ids, merged])


def _spelled(strings: pa.Array, ids: np.ndarray, begin: np.ndarray, count: np.ndarray, index: np.ndarray, first: np.ndarray) -> pa.Array:
    """Each document's token strings, joined by blanks."""
    tokens = strings.take(pa.array(ids[ranges(begin, count)]))
    words = _regrouped(tokens, np.concatenate([[0], np.cumsum(count)]))
    return pc.utf8_rtrim(_regrouped(words.take(pa.array(index)), first), " ").cast(pa.string())


def _regrouped(parts: pa.Array, first: np.ndarray) -> pa.Array:
    """Parts first[k]:first[k + 1] as one string each."""
    ends = np.frombuffer(parts.buffers()[1], np.int64)[parts.offset : parts.offset + len(parts) + 1] if len(parts) else np.zeros(1, np.int64)
    raw = parts.buffers()[2] if len(parts) else None
    return pa.Array.from_buffers(pa.large_string(), len(first) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends[first])), raw if raw is not None else pa.py_buffer(b"")])


def encode_texts(docs: DataFrame, path: str, lexicon: Transducer, decode: bool = False, text: str = "text") -> DataFrame:
    """docs without its text, with ids array<int> and, if asked for, decoded string after its other columns."""
    packed = docs.sparkSession.sparkContext.broadcast(lexicon.packed())
    rest = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text]
    schema = ", ".join([*rest, "ids array<int>", *["decoded string"] * decode])
    return docs.withColumn(text, F.col(text).cast("string")).mapInArrow(_encoded(path, packed, text, decode), schema)


def decode_ids(frame: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """frame with a column decoded: the texts of its ids, as the library decodes them; a null list gives a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(path)
        for batch in batches:
            texts = [None if x is None else tokenizer.decode(x, skip_special_tokens=False) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return frame.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema), "decoded string"]))


def with_ids(docs: DataFrame, path: str, size: int = LEXICON) -> DataFrame:
    """docs with all its columns, token_ids array<int> and n_tokens long (of such names, the older columns go)."""
    own = [c for c in docs.columns if c.lower() not in ("token_ids", "n_tokens")]
    lexicon = compile_lexicon(frequent_words(docs, path, size), path)
    rows = docs.select(F.col("text").cast("string").alias("_text"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)))
    out = encode_texts(rows, path, lexicon, text="_text")
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(own)), F.col("ids").alias("token_ids"), F.size("ids").cast("long").alias("n_tokens"))


def op8_bpe_codec(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = encode_texts(docs, path, compile_lexicon(frequent_words(docs, path), path), decode=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
