"""Benchmark passages in documents, found by Wu-Manber search over words.

Texts are lower-cased in A-Z; words are runs of digits, letters and non-ASCII characters. A window is 10 consecutive
words of an item; an item of fewer words, but not none, is one window. A document word inside any occurrence of a window
is hit.

The windows of one length m are one pattern set. For each pair of neighbouring words (the block; one word where m is 1)
the shift table has the distance from its last place in any pattern to the pattern's end, or m - 1 where no pattern has
it. A cursor stands on the last block of a possible window and moves on by the shift; where that is 0, the block's hash
bucket gives the patterns that end so, a hash of the whole window picks among them and a comparison of the bytes
confirms. Each document is cut into stretches with one cursor each, and all cursors of a batch step together.

The patterns are broadcast in blocks compiled from at most BLOCK_BYTES of benchmark text each. One pass over the documents
searches all blocks, of which a task holds one at a time, so a growing benchmark adds time, not memory.

Defined cases: null texts have no words; items of equal id count as one; items are named by their id as a string, null
ids by "null"; repeated rows each give a row; empty documents or benchmarks give no hits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import STEP_BYTES, Words, position_keys, ranges, steps, window_hashes

WINDOW = 10
BLOCK_BYTES = 4 << 20
#: Text searched at once if there are several blocks, so that a block is seldom loaded.
PIECE_BYTES = 16 << 20
#: Words that one cursor goes over.
STRETCH = 256

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_BLOCK = position_keys(2, 11)


def alnum_words(texts: pa.Array) -> Words:
    return Words(texts, ALNUM, LOWER)


def _blocks(h: np.ndarray, ends: np.ndarray, wide: int) -> np.ndarray:
    return window_hashes(h, ends - wide + 1, _BLOCK[:wide])


def _same_words(a: Words, at: np.ndarray, b: Words, to: np.ndarray, m: int) -> np.ndarray:
    """Whether the m words of a from each `at` are, byte for byte, those of b from each `to`."""
    step = np.arange(m)
    i, j = at[:, None] + step, to[:, None] + step
    size = a.ends[i] - a.starts[i]
    same = (size == b.ends[j] - b.starts[j]).all(1)
    some = np.flatnonzero(same)
    if not len(some):
        return same
    size = size[some].ravel()
    differ = a.data[ranges(a.starts[i[some]].ravel(), size)] != b.data[ranges(b.starts[j[some]].ravel(), size)]
    ends = np.cumsum(size.reshape(-1, m).sum(1))
    total = np.concatenate([[0], np.cumsum(differ)])
    same[some] = total[ends] == total[np.concatenate([[0], ends[:-1]])]
    return same


class PatternSet:
    """Patterns of m words each, from windows that begin at `first` (words of `words`, hashes h) and are of `item`s."""

    def __init__(self, m: int, words: Words, h: np.ndarray, first: np.ndarray, item: np.ndarray):
        self.m, self.wide, self.words = m, min(2, m), words
        whole = window_hashes(h, first, position_keys(m, 12))
        suffix = _blocks(h, first + m - 1, self.wide)
        order = np.lexsort((whole, suffix))
        whole, suffix, first, item = whole[order], suffix[order], first[order], item[order]
        # equal windows are one pattern: those of a run of equal hashes that have the bytes of its first
        new = np.ones(len(first), bool)
        new[1:] = (whole[1:] != whole[:-1]) | (suffix[1:] != suffix[:-1])
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        new |= ~_same_words(words, first, words, first[head], m)
        head = np.where(new, np.arange(len(first)), head)
        pattern = (np.cumsum(new) - 1)[head]
        pairs = np.unique(np.stack([pattern, item], axis=1), axis=0)
        self.begin, self.item = np.searchsorted(pairs[:, 0], np.arange(new.sum() + 1)), pairs[:, 1]
        # the bucket of a suffix holds its patterns in order of their whole hash
        self.whole, self.first = whole[new], first[new]
        self.suffix, self.bucket = np.unique(suffix[new], return_index=True)
        self.bucket = np.append(self.bucket, len(self.first))
        n = len(self.first)
        self.bits = max(10, math.ceil(math.log2(16 * n * m)))
        self.shift = np.full(1 << self.bits, m - self.wide + 1, np.uint16)
        for end in range(self.wide - 1, m):
            np.minimum.at(self.shift, self.slot(_blocks(h, self.first + end, self.wide)), m - 1 - end)

    def slot(self, block: np.ndarray) -> np.ndarray:
        return (block >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, words: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word and pattern of every occurrence."""
        m, n = self.m, words.counts()
        docs = np.flatnonzero(n >= m)
        ends = n[docs] - m + 1  # possible last words of windows in each document
        pieces = -(-ends // STRETCH)
        piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = np.repeat(words.first[docs], pieces) + m - 1 + piece * STRETCH
        to = np.minimum(at + STRETCH, np.repeat(words.first[docs] + n[docs], pieces))
        last, blocks = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        while len(at):
            block = _blocks(h, at, self.wide)
            move = self.shift[self.slot(block)].astype(np.int64)
            here = np.flatnonzero(move == 0)
            if len(here):
                last.append(at[here])
                blocks.append(block[here])
                move[here] = 1
            at = at + move
            on = at < to
            at, to = at[on], to[on]
        return self.confirmed(words, h, np.concatenate(last), np.concatenate(blocks))

    def confirmed(self, words: Words, h: np.ndarray, last: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bucket = np.minimum(np.searchsorted(self.suffix, block), len(self.suffix) - 1)
        some = self.suffix[bucket] == block
        start, bucket = last[some] - self.m + 1, bucket[some]
        whole = window_hashes(h, start, position_keys(self.m, 12))
        lo, stop = self.bucket[bucket], self.bucket[bucket + 1]
        # the first pattern of each bucket whose hash isn't smaller, for all at once
        hi = stop.copy()
        while (on := lo < hi).any():
            mid = (lo + hi) // 2
            less = on & (self.whole[np.minimum(mid, len(self.whole) - 1)] < whole)
            lo, hi = np.where(less, mid + 1, lo), np.where(on & ~less, mid, hi)
        starts, patterns = [], []
        while True:  # patterns of one hash stand side by side
            on = (lo < stop) & (self.whole[np.minimum(lo, len(self.whole) - 1)] == whole)
            start, lo, stop, whole = start[on], lo[on], stop[on], whole[on]
            if not len(start):
                break
            same = _same_words(words, start, self.words, self.first[lo], self.m)
            starts.append(start[same])
            patterns.append(lo[same])
            lo = lo + 1
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *starts]), np.concatenate([none, *patterns])


def compiled(items: list[tuple[str, str | None]], window: int = WINDOW) -> tuple[list[str], list[PatternSet]]:
    """Names of items, and a pattern set for each length of windows."""
    names = sorted({i for i, _ in items})
    place = {x: k for k, x in enumerate(names)}
    words = alnum_words(pa.array([t for _, t in items], pa.large_string()))
    h, n = words.hashes(), words.counts()
    item, m = np.array([place[i] for i, _ in items], np.int64), np.minimum(n, window)
    sets = []
    for size in np.unique(m[m > 0]).tolist():
        own = np.flatnonzero(m == size)
        many = n[own] - size + 1
        sets.append(PatternSet(size, words, h, ranges(words.first[own], many), np.repeat(item[own], many)))
    return names, sets


def _searched(blocks: list, text: str):
    """A row's own columns, then n_words, n_hit and items. blocks: broadcasts of compiled patterns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text, STEP_BYTES if len(blocks) == 1 else PIECE_BYTES):
            words = alnum_words(batch.column(text))
            h = words.hashes()
            edge = np.zeros(len(h) + 1, np.int32)
            held: dict[int, set[str]] = {}
            for shared in blocks:
                names, sets = shared.value
                for p in sets:
                    start, pattern = p.search(words, h)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + p.m, -1)
                    doc = np.searchsorted(words.first, start, "right") - 1
                    many = p.begin[pattern + 1] - p.begin[pattern]
                    found = np.unique(np.stack([np.repeat(doc, many), p.item[ranges(p.begin[pattern], many)]], axis=1), axis=0)
                    for d, k in found.tolist():
                        held.setdefault(d, set()).add(names[k])
                if len(blocks) > 1:
                    del names, sets, shared._value  # is read from the task's copy of the broadcast when asked for again
            total = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
            hit = total[words.first[1:]] - total[words.first[:-1]]
            rest = [c for c in batch.schema.names if c != text]
            listed = pa.array([sorted(held.get(d, ())) for d in range(len(batch))], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(words.counts().astype(np.int64)), pa.array(hit.astype(np.int64)), listed], [*rest, "n_words", "n_hit", "items"])

    return run


def _with_hits(rows: DataFrame, benchmark: DataFrame, text: str, window: int, block_bytes: int) -> DataFrame:
    """rows without `text`, with n_words, n_hit and items."""
    spark = rows.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("string").alias("text"))
    held = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-held // block_bytes))
    blocks = []
    for k in range(count):
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k) if count > 1 else items
        blocks.append(spark.sparkContext.broadcast(compiled([tuple(r) for r in part.collect()], window)))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != text]
    return rows.mapInArrow(_searched(blocks, text), ", ".join([*fields, "n_words long", "n_hit long", "items array<string>"]))


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, n_hit, items (ids of items with occurring windows, sorted)."""
    return _with_hits(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), benchmark, "text", window, block_bytes)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents in which no benchmark window occurs, with their columns."""
    rows = docs.select(F.col("text").cast("string").alias("_text"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)))
    clean = _with_hits(rows, benchmark, "_text", window, BLOCK_BYTES).filter("n_hit = 0")
    return clean.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))


def op5_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP5_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), pat AS (
  SELECT DISTINCT item_id, m, array_to_string(list_slice(ws, p, p + m - 1), ' ') AS seq
  FROM (SELECT item_id, ws, least(10, len(ws)) AS m, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS p FROM b WHERE len(ws) > 0)
), win AS (
  SELECT doc_id, p, m, array_to_string(list_slice(ws, p, p + m - 1), ' ') AS seq
  FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS p FROM d, (SELECT DISTINCT m FROM pat) WHERE len(ws) >= m)
), occ AS (
  SELECT doc_id, p, win.m AS m, item_id FROM win JOIN pat ON win.m = pat.m AND win.seq = pat.seq
), hit AS (
  SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(p, p + m)) AS k FROM occ) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM occ) GROUP BY doc_id
)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""
