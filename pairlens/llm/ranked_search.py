"""The best documents for each of many items, by weak-AND search over shards of documents.

Terms are runs of digits, letters and characters beyond ASCII, A-Z lower-cased. With N documents that hold a term, L terms in
all, n terms in a document, df documents that hold a term and tf its occurrences in one, a term adds

    w * (10^9 tf div (1000 tf + 20 m)),   w = floor(1000 ln((2N + 2) / (2 df + 1))),   m = 50 + 50 n N div L

to the document's score (BM25 in whole numbers).

1. The items, in blocks of BLOCK_BYTES of text, make a vocabulary. One pass over the documents writes the index: for each
   document n and the vocabulary's terms in it. Terms are found by 64-bit hashes and compared byte by byte. N, L and df are
   sums over the index.
2. A task gathers documents until they have SHARD postings, and orders these by term: a shard, whose terms have a maximum
   impact each. All items of a block go through it in lockstep. An item's lists are ordered by their current document;
   the pivot is the first one at which the maxima of the lists so far reach the item's threshold, the K-th best score it
   has found. What lies before the pivot can't be among the K best and is skipped; the pivot is scored exactly.
3. Heaps go on from shard to shard of a task, and the heaps of all tasks are merged. Thresholds begin at what the same search
   finds in one document of PRIME: a score that K documents reach, so nothing that belongs to the K best is lost, and a task
   passes on little.

Documents aren't shuffled, so no document, term or item is a hot key; a task holds one shard and the heaps of a block.

Defined cases: a null text has no terms; items without terms, or whose terms occur nowhere, have no rows; equal scores are
ordered by doc_id, null ids last; repeated documents are documents of their own, and repeated items are answered each; terms
that nearly all documents hold have the weight 0 and add nothing; of other columns none is looked at. 10^9 tf, 50 n N and the
scores must fit in 63 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import LAST_ID, id_order, stored
from ._text import Words, steps

K = 50
#: Bytes of text in a block of items, postings of a shard, of how many documents one sets the first thresholds.
BLOCK_BYTES, SHARD, PRIME = 4 << 20, 1 << 20, 32
#: Lists of items that go through a shard in lockstep.
LANES = 1 << 15

_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_OVER = np.int32((1 << 31) - 1)


def _cut(texts: pa.Array) -> Words:
    return Words(texts, _TERM, _LOWER)


@dataclass
class Vocabulary:
    """The distinct terms of a block of items, and which of them each item has."""

    spelled: pa.Array
    begin: np.ndarray
    terms: np.ndarray

    @classmethod
    def of(cls, texts: list[str | None]) -> Vocabulary:
        words = _cut(pa.array(texts, pa.large_string()))
        flat = words.data.tobytes()
        held = [flat[a:b] for a, b in zip(words.starts.tolist(), words.ends.tolist(), strict=True)]
        number = {t: k for k, t in enumerate(sorted(set(held)))}
        own = [sorted({number[t] for t in held[a:b]}) for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)]
        begin = np.cumsum([0, *map(len, own)])
        return cls(pa.array([t.decode() for t in number], pa.large_string()), begin, np.array([t for x in own for t in x], np.int64))


class _Finder:
    """Which of the vocabulary's terms a word is."""

    def __init__(self, spelled: pa.Array):
        self.words = _cut(spelled)
        h = self.words.hashes()
        self.order = np.argsort(h)
        self.hashes = h[self.order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two terms of a block share a hash")

    def find(self, words: Words) -> np.ndarray:
        """The term's number, or -1."""
        out = np.full(len(words.starts), -1, np.int64)
        if not len(self.hashes) or not len(out):
            return out
        h = words.hashes()
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        which = np.flatnonzero(self.hashes[at] == h)
        term = self.order[at[which]]
        same = self._same(words, which, term)
        out[which[same]] = term[same]
        return out

    def _same(self, words: Words, which: np.ndarray, term: np.ndarray) -> np.ndarray:
        a, b = words.starts[which], self.words.starts[term]
        size = words.ends[which] - a
        same = size == self.words.ends[term] - b
        left, right = (np.concatenate([x.data, np.zeros(1, np.uint8)]) for x in (words, self.words))
        more, at = np.flatnonzero(same & (size > 0)), 0
        while len(more):
            same[more] &= left[a[more] + at] == right[b[more] + at]
            at += 1
            more = more[same[more] & (size[more] > at)]
        return same


def _indexed(spelled: pa.Array):
    """doc_id, n, and the vocabulary's terms of each document that has a term, with their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, v = _Finder(spelled), max(1, len(spelled))
        for batch in steps(batches):
            words = _cut(batch.column("text"))
            n, found = words.counts(), finder.find(words)
            held = np.flatnonzero(found >= 0)
            key, tf = np.unique(words.doc_of()[held] * np.int64(v) + found[held], return_counts=True)
            some = np.flatnonzero(n > 0)
            ends = np.searchsorted(key, np.arange(len(n) + 1) * v).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x, pa.int32())).take(pa.array(some)) for x in ((key % v).astype(np.int32), tf.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(some)), pa.array(n[some].astype(np.int64)), *lists], ["doc_id", "n", "terms", "tfs"])

    return run


def _spread(size: int):
    """How many documents hold each term, a row for each term that a task has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], ["term", "df"])

    return run


@dataclass
class Query:
    """What the tasks of a block know: statistics, weights of terms, the items' terms, first thresholds."""

    documents: int
    length: int
    weights: np.ndarray
    begin: np.ndarray
    terms: np.ndarray
    least: np.ndarray
    k: int


class Heaps:
    """The best `k` of each item so far; a free place has the score 0."""

    def __init__(self, query: Query):
        items = len(query.begin) - 1
        self.score, self.doc = np.zeros((items, query.k), np.int64), np.full((items, query.k), LAST_ID)
        self.floor = np.maximum(query.least, 1)
        self.least = self.floor.copy()

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        """A candidate for each of some items, that reaches their thresholds."""
        held, docs = self.score[item], self.doc[item]
        low = held.min(1)
        worst = np.where(held == low[:, None], docs, np.iinfo(np.int64).min).argmax(1)
        better = (score > low) | (doc < docs[np.arange(len(item)), worst])
        item, worst = item[better], worst[better]
        self.score[item, worst], self.doc[item, worst] = score[better], doc[better]
        self.least[item] = np.maximum(self.floor[item], self.score[item].min(1))


class Shard:
    """Postings of some documents, ordered by term and document."""

    def __init__(self, query: Query, doc_id: np.ndarray, n: np.ndarray, count: np.ndarray, terms: np.ndarray, tfs: np.ndarray):
        self.doc_id, self.docs = doc_id, len(doc_id)
        doc, tf = np.repeat(np.arange(self.docs), count), tfs.astype(np.int64)
        m = 50 + 50 * n * query.documents // max(1, query.length)
        impact = query.weights[terms] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
        kept = np.flatnonzero(impact)
        key = terms[kept].astype(np.int64) * self.docs + doc[kept]
        order = np.argsort(key)
        self.key = key[order]
        # a last posting of no document, where lists that are through stand
        self.doc = np.append((self.key % max(1, self.docs)).astype(np.int32), _OVER)
        self.impact = np.append(impact[kept][order], 0)
        self.begin = np.searchsorted(self.key, np.arange(len(query.weights) + 1) * np.int64(self.docs))
        self.most = np.zeros(len(query.weights), np.int64)
        some = np.flatnonzero(np.diff(self.begin))
        if len(some):
            self.most[some] = np.maximum.reduceat(self.impact[:-1], self.begin[:-1][some])

    def search(self, items: np.ndarray, terms: np.ndarray, heaps: Heaps) -> None:
        """terms: a row for each item, filled up with -1."""
        none, last = terms < 0, len(self.doc) - 1
        at, end = np.where(none, last, self.begin[terms]), np.where(none, last, self.begin[terms + 1])
        at = np.where(at < end, at, last)
        current, most = self.doc[at], np.where(at < last, self.most[terms], 0)
        while True:
            order = np.argsort(current, axis=1)
            reached = np.cumsum(np.take_along_axis(most, order, 1), axis=1) >= heaps.least[items][:, None]
            on = np.flatnonzero(reached[:, -1])
            if len(on) < len(items):
                items, terms, at, end, current, most, order, reached = (x[on] for x in (items, terms, at, end, current, most, order, reached))
            if not len(items):
                return
            pivot = current[np.arange(len(items)), order[np.arange(len(items)), reached.argmax(1)]]
            row, column = np.nonzero(current < pivot[:, None])
            self._moved(row, column, np.searchsorted(self.key, terms[row, column] * self.docs + pivot[row]), at, end, current, most)
            row, column = np.nonzero(current == pivot[:, None])
            here = at[row, column]
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            score = np.add.reduceat(self.impact[here], first)
            owner = row[first]
            good = score >= heaps.least[items[owner]]
            if good.any():
                heaps.add(items[owner[good]], score[good], self.doc_id[pivot[owner[good]]])
            self._moved(row, column, here + 1, at, end, current, most)

    def _moved(self, row: np.ndarray, column: np.ndarray, to: np.ndarray, at: np.ndarray, end: np.ndarray, current: np.ndarray, most: np.ndarray) -> None:
        over = to >= end[row, column]
        to[over] = len(self.doc) - 1
        at[row, column], current[row, column] = to, self.doc[to]
        most[row[over], column[over]] = 0


def _lanes(query: Query, lanes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Items of about as many terms together, with their terms as a matrix filled up with -1."""
    size = np.diff(query.begin)
    order = np.argsort(size, kind="stable")
    order, lo = order[size[order] > 0], 0
    while lo < len(order):
        # the widest item decides how many fit
        wide = size[order[lo:]] * np.arange(1, len(order) - lo + 1)
        items = order[lo : lo + max(1, int(np.searchsorted(wide, lanes, "right")))]
        out = np.full((len(items), size[items].max()), -1, np.int64)
        for k, i in enumerate(items.tolist()):
            out[k, : size[i]] = query.terms[query.begin[i] : query.begin[i + 1]]
        yield items, out
        lo += len(items)


def _searched(shared, shard: int):
    """Rows of index: the best of each item among a task's documents, as item, doc_id and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query: Query = shared.value
        heaps, lanes = Heaps(query), list(_lanes(query, LANES))
        for parts in _gathered(batches, shard):
            columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
            made = Shard(query, *columns)
            for items, terms in lanes:
                made.search(items, terms, heaps)
        item, place = np.nonzero(heaps.score)
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(heaps.doc[item, place]), pa.array(heaps.score[item, place])], ["item", "doc_id", "score"])

    return run


def _gathered(batches: Iterator[pa.RecordBatch], shard: int) -> Iterator[list[tuple[np.ndarray, ...]]]:
    """doc_id, n, numbers of terms, terms and occurrences of documents that have about `shard` postings together."""
    parts, held = [], 0
    for batch in batches:
        terms, tfs = batch.column("terms"), batch.column("tfs")
        edges = terms.offsets.to_numpy()
        lo = 0
        while lo < len(batch):
            hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + shard - held, "right")) - 1)
            hi = min(hi, len(batch))
            a, b = edges[lo] - edges[0], edges[hi] - edges[0]
            values = (x.flatten().to_numpy()[a:b] for x in (terms, tfs))
            parts.append((batch.column("doc_id").to_numpy()[lo:hi], batch.column("n").to_numpy()[lo:hi], np.diff(edges[lo : hi + 1]), *values))
            held, lo = held + int(b - a), hi
            if held >= shard:
                yield parts
                parts, held = [], 0
    if parts:
        yield parts


def _blocks(items: DataFrame, most: int) -> Iterator[list]:
    """Items with a text, a block of about `most` bytes of text at a time."""
    rows = stored(items.filter(F.length("text") > 0).withColumn("_row", F.monotonically_increasing_id()), "items")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // most))
    for b in range(blocks if total else 0):
        yield rows.filter(F.pmod(F.xxhash64("_row"), F.lit(blocks)) == b).orderBy("_row").collect()


def best_documents(docs: DataFrame, items: DataFrame, k: int = K, block: int = BLOCK_BYTES, shard: int = SHARD) -> DataFrame:
    """For each of items (item_id, text) the k documents of docs (doc_id, text) of the highest score above 0: item_id, rank
    (from 1), doc_id, score; ties go to the smaller doc_id."""
    spark = docs.sparkSession
    content = lambda rows, *names: rows.select(*names, F.col("text").cast("string").alias("text"))
    asked, out = content(items, "item_id"), None
    for rows in _blocks(asked, block):
        found = _searched_block(content(docs, id_order().alias("doc_id")), [r.text for r in rows], k, shard)
        names = spark.createDataFrame([(n, r.item_id) for n, r in enumerate(rows)], f"item long, item_id {asked.schema['item_id'].dataType.simpleString()}")
        found = found.join(F.broadcast(names), "item").select("item_id", "rank", F.when(F.col("doc_id") != LAST_ID, F.col("doc_id")).alias("doc_id"), "score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], f"item_id {asked.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    return out


def _searched_block(docs: DataFrame, texts: list[str], k: int, shard: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = Vocabulary.of(texts)
    index = stored(docs.mapInArrow(_indexed(vocabulary.spelled), "doc_id long, n long, terms array<int>, tfs array<int>"), "index")
    facts = index.agg(F.count("*").alias("documents"), F.sum("n").alias("length")).first()
    size = len(vocabulary.spelled)
    df = index.select("terms").mapInArrow(_spread(size), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    weights = np.zeros(size, np.int64)
    for r in df:
        weights[r.term] = math.floor(1000 * math.log((2 * facts.documents + 2) / (2 * r.df + 1)))
    query = Query(facts.documents, facts.length or 0, weights, vocabulary.begin, vocabulary.terms, np.zeros(len(texts), np.int64), k)
    held, best = index.filter(F.size("terms") > 0), "item long, doc_id long, score long"
    some = held.filter(F.pmod(F.xxhash64("doc_id", "n"), F.lit(PRIME)) == 0)
    for r in _merged(some.mapInArrow(_searched(spark.sparkContext.broadcast(query), shard), best), k).filter(F.col("rank") == k).collect():
        query.least[r.item] = r.score
    return _merged(held.mapInArrow(_searched(spark.sparkContext.broadcast(query), shard), best), k)


def _merged(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def op13_ranked_search(spark, sf_dir: str) -> DataFrame:
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return best_documents(table("documents").select("doc_id", "text"), table("benchmark").select("item_id", "text"))


OP13_SQL = r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL
), len AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id
), tot AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM len
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), w AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, tot WHERE term IN (SELECT term FROM q) GROUP BY term, docs
), m AS (SELECT doc_id, 50 + (50 * n * docs) // total AS m FROM len, tot
), s AS (
  SELECT item_id, tf.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM q JOIN tf ON q.term = tf.term JOIN w ON w.term = tf.term JOIN m ON m.doc_id = tf.doc_id GROUP BY item_id, tf.doc_id
), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 50
"""
