"""Removal of long repeated passages, found through difference-cover anchors.

Words lie between space, tab, LF, VT, FF and CR. A window is `window` consecutive words of one document. Every word
goes that is covered by a window whose word sequence also starts earlier: in a document of smaller id, or earlier in
the same one. Windows are judged on the input.

The positions of a document that belong to the cover D modulo v are its anchors. For any two positions i, j some
delta < v puts both i + delta and j + delta into the cover, so two equal windows share an aligned anchor of
window - v + 1 words. The steps:

1. hash the anchors only (4 of 13 positions), count each hash over the corpus, keep those that occur twice;
2. give each row the repeated anchors it holds; only windows around such an anchor can be repeated, and those
   are extended to their full length and hashed with 96 bits, taken by two keys from 64-bit hashes of the words: two
   sequences are taken for one if the hashes of differing words agree, which for one pair of words has a chance of 2 ** -64;
3. find the first start of each such window; all later ones are removed.

Copies of a whole text are settled by a digest of the text: only the first copy goes through step 2 and 3, the others
lose all their words (a text shorter than a window keeps them). No pairs are made anywhere. Hot anchors are counted
map-side first and reach the rows through joins that Spark can split; a hot window leaves each task about once, and is
gone through as a sorted stream; hot digests are joined by broadcast.

Defined cases: a null text or one without words has no words; a text shorter than a window loses nothing; null ids
come after all others and count as one id, but their rows are kept apart by their texts; rows that share an id are ordered
among themselves by position alone, so what they repeat of each other at the same position stays; repeated rows each give a
row, but are searched once; an empty table gives an empty one; other columns keep their names, whatever these are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import LAST_ID, id_order, joined_spread, mark, release, stored, unused
from ._text import Words, position_keys, ranges, steps, window_hashes

WINDOW = 20
#: A difference cover: every difference modulo PERIOD is one of two of its members.
PERIOD, COVER = 13, (0, 1, 3, 9)
#: Windows of earlier batches that a task keeps in mind.
MIND = 1 << 13
_SIDE = np.zeros(PERIOD, bool)
_SIDE[list(COVER)] = True


def _anchor_positions(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents and word positions (in the piece) of the anchors of all documents that have a window."""
    span = window - PERIOD + 1
    n = words.counts()
    docs = np.flatnonzero(n >= window)
    most = n[docs] - span + 1
    local = ranges(np.zeros(len(docs), np.int64), most)
    doc = np.repeat(docs, most)
    taken = _SIDE[local % PERIOD]
    doc = doc[taken]
    return doc, words.first[doc] + local[taken]


def _anchor_hashes(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    doc, at = _anchor_positions(words, window)
    return doc, at, window_hashes(words.hashes(), at, position_keys(window - PERIOD + 1, 1)).view(np.int64)


def _counted(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            h, n = np.unique(_anchor_hashes(Words(batch.column("text")), window)[2], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.minimum(n, 2).astype(np.int32))], ["h", "n"])

    return run


def _held(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            doc, _, h = _anchor_hashes(Words(batch.column("text")), window)
            ids = batch.column("k").to_numpy()
            order = np.lexsort((doc, h))
            doc, h = doc[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(h[new]), pa.array(ids[doc[new]])], ["h", "k"])

    return run


WINDOWS = "h1 long, h2 int, _id long, dg long, at int, sure binary"


def _extended(window: int):
    """96-bit hashes of the windows that hold a repeated anchor: a row for each that may be the first of its hash, and for
    each text one with the starts (sure) of those that are later than another of the same task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mind = tuple(np.zeros(0, t) for t in (np.int64, np.int32, np.int64, np.int32))
        for batch in steps(batches):
            words = Words(batch.column("text"))
            hashes = words.hashes()
            doc, at = _anchor_positions(words, window)
            h = window_hashes(hashes, at, position_keys(window - PERIOD + 1, 1)).view(np.int64)
            lists = batch.column("hs")
            of = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            # pairs (document, hash) as one sortable value each
            known = np.unique(_pair(of, lists.flatten().to_numpy()))
            hit = np.isin(_pair(doc, h), known)
            doc, at = doc[hit], at[hit]
            # an anchor at a lies in the windows that start at a - PERIOD + 1 .. a
            edge = np.zeros(len(hashes) + 1, np.int32)
            np.add.at(edge, np.maximum(at - PERIOD + 1, words.first[doc]), 1)
            np.add.at(edge, at + 1, -1)
            start = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
            of = np.searchsorted(words.first, start, "right") - 1
            fits = start + window <= words.first[of + 1]
            start, of = start[fits], of[fits]
            h1 = window_hashes(hashes, start, position_keys(window, 2)).view(np.int64)
            h2 = (window_hashes(hashes, start, position_keys(window, 3)) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            own_id, own_dg = batch.column("_id").to_numpy(), batch.column("dg").to_numpy()
            old = len(mind[0])
            h1, h2, ids, at = (np.concatenate([x, y]) for x, y in zip(mind, (h1, h2, own_id[of], (start - words.first[of]).astype(np.int32)), strict=True))
            of = np.concatenate([np.full(old, -1), of])
            order = np.lexsort((at, ids, h2, h1))
            h1, h2, ids, at, of = (x[order] for x in (h1, h2, ids, at, of))
            later, first = _after_first(h1, h2, ids, at)
            new = of >= 0
            rows = np.flatnonzero(new & ~later)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (h1[rows], h2[rows], ids[rows], own_dg[of[rows]], at[rows])] + [pa.nulls(len(rows), pa.binary())], ["h1", "h2", "_id", "dg", "at", "sure"]
            )
            rows = np.flatnonzero(new & later)
            own, dg, listed = _listed(ids[rows], own_dg[of[rows]], at[rows])
            yield pa.RecordBatch.from_arrays(
                [pa.array((own ^ dg) * np.int64(0x5851F42D4C957F2D)), pa.array(np.zeros(len(own), np.int32)), pa.array(own), pa.array(dg), pa.nulls(len(own), pa.int32()), pa.array(listed, pa.binary())],
                ["h1", "h2", "_id", "dg", "at", "sure"],
            )
            # kept in mind is what has occurred again, then what is new, then what is old
            heads, size = np.unique(first, return_counts=True)
            rank = np.where(size > 1, 0, np.where(new[heads], 1, 2))
            kept = heads[np.argsort(rank, kind="stable")[:MIND]]
            mind = tuple(x[kept] for x in (h1, h2, ids, at))

    return run


def _after_first(h1: np.ndarray, h2: np.ndarray, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by hash, id and position: which start later than the first of their hash, and where hashes begin."""
    new = np.ones(len(h1), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(new) else np.zeros(0, np.int64)
    return (ids != ids[first]) | (at != at[first]), first


def _listed(ids: np.ndarray, dg: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The starts of each text, named by id and digest."""
    order = np.lexsort((dg, ids))
    ids, dg, at = ids[order], dg[order], at[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (dg[1:] != dg[:-1])
    begin = np.flatnonzero(new)
    return ids[begin], dg[begin], [x.tobytes() for x in np.split(at.astype(np.int32), begin[1:])] if len(begin) else []


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by hash, id and position; only the first of the current hash is kept in mind."""
    mind = None
    for batch in batches:
        sure = batch.filter(pc.is_valid(batch.column("sure")))
        batch = batch.filter(pc.is_null(batch.column("sure")))
        columns = [batch.column(c).to_numpy() for c in ("h1", "h2", "_id", "at", "dg")]
        if mind is not None:
            columns = [np.concatenate([[x], y]).astype(y.dtype) for x, y in zip(mind, columns, strict=True)]
        later, first = _after_first(*columns[:4])
        if len(first):
            mind = tuple(x[first[-1]] for x in columns)
        _, _, ids, at, dg = (x[later] for x in columns)
        ids, dg, listed = _listed(ids.astype(np.int64), dg.astype(np.int64), at)
        yield pa.RecordBatch.from_arrays(
            [pa.concat_arrays([pa.array(ids), sure.column("_id")]), pa.concat_arrays([pa.array(dg), sure.column("dg")]), pa.concat_arrays([pa.array(listed, pa.binary()), sure.column("sure")])], ["_id", "dg", "at"]
        )


def _pair(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A wrong match only makes a window be looked at that needn't be."""
    return h.astype(np.int64) ^ (doc.astype(np.int64) * np.int64(0x5851F42D4C957F2D))


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            words = Words(batch.column("text"))
            n = words.counts()
            gone = np.zeros(len(words.starts) + 1, np.int32)
            lists = batch.column("later")
            size = [sum(map(len, x)) // 4 for x in lists.to_pylist()]
            of = np.repeat(np.arange(len(lists)), size)
            at = np.frombuffer(b"".join(lists.flatten().to_pylist()), np.int32).astype(np.int64)
            fits = at + window <= n[of]  # of several texts under one id, a position may belong to another
            at = at[fits] + words.first[of[fits]]
            np.add.at(gone, at, 1)
            np.add.at(gone, at + window, -1)
            whole = batch.column("copy").to_numpy(zero_copy_only=False).astype(bool) & (n >= window)
            removed = (np.cumsum(gone[:-1]) > 0) | np.repeat(whole, n)
            total = np.concatenate([[0], np.cumsum(removed)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("dg"), pa.array(n.astype(np.int64)), pa.array((total[words.first[1:]] - total[words.first[:-1]]).astype(np.int64)), pa.array(words.joined(~removed), pa.string())],
                ["_id", "dg", "n_words", "n_removed", "kept"],
            )

    return run


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, n_removed, kept (the kept words joined by one space)."""
    cut = _cut_rows(docs.select(id_order().alias("_id"), F.col("text").cast("string").alias("text")), window)
    return cut.select(F.when(F.col("_id") != LAST_ID, F.col("_id")).alias("doc_id"), "n_words", "n_removed", "kept")


def _once(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """One row of each id and text; texts: _id, dg of the rows. Only rows that are repeated move, one of each from a task."""
    again = stored(texts.groupBy("_id", "dg").count().filter("count > 1").select("_id", "dg"), "repeated")
    if again.isEmpty():
        return rows
    some = rows.join(again, ["_id", "dg"], "left_semi").groupBy("_id", "dg").agg(F.any_value("text").alias("text"))
    return rows.join(again, ["_id", "dg"], "left_anti").select(*rows.columns).unionByName(stored(some, "one of each"))


def _later_copies(texts: DataFrame) -> DataFrame:
    """(_id, dg) of texts that a smaller id has, too; one row each."""
    first = texts.groupBy("m").agg(F.min("_id").alias("first"), F.max("_id").alias("last"), F.count("*").alias("c")).filter("first < last").select("m", "first", "c")
    return joined_spread(texts, first, "m", "c").filter("_id > first").select("_id", "dg").distinct()


def _cut_rows(rows: DataFrame, window: int, each: bool = True) -> DataFrame:
    """rows: _id, text. Steps 1 to 3; k stands for a row's id and text where a confusion does no harm, (_id, dg) where it would.
    each: repeated rows each give a row, else an id and text give one."""
    spark, since = rows.sparkSession, mark()
    rows = rows.withColumn("dg", F.xxhash64("text"))
    k = F.xxhash64("_id", "dg").alias("k")
    texts = stored(rows.filter(F.length("text") > 0).select("_id", "dg", F.unhex(F.md5("text")).alias("m")), "digests")
    # rows of one id and text repeat each other at the same places, which stay: one of them tells what goes of all
    once = _once(rows, texts)
    repeated = rows.select("text").mapInArrow(_counted(window), "h long, n int").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h")
    held = once.select(k, "text").mapInArrow(_held(window), "h long, k long").join(repeated, "h", "left_semi")
    per_row = held.groupBy("k").agg(F.collect_set("h").alias("hs"))
    copies = _later_copies(texts).groupBy(k).agg(F.collect_set(F.struct("_id", "dg")).alias("copies"))
    facts = stored(per_row.join(copies, "k", "full_outer"), "anchors")
    if once is rows:
        release(spark, since, facts)

    def full(rows: DataFrame) -> DataFrame:
        found = rows.withColumn("k", k).join(facts, "k", "left")
        return found.withColumn("copy", F.coalesce(F.array_contains("copies", F.struct("_id", "dg")), F.lit(False)))

    windows = full(once).filter(~F.col("copy") & (F.size("hs") > 0)).select("_id", "dg", "text", "hs").mapInArrow(_extended(window), WINDOWS)
    # within a task, all but the first of a window are known to be later: a hot window is dealt about once for each task
    dealt = windows.repartition("h1", "h2").sortWithinPartitions("h1", "h2", "_id", "at")
    found = dealt.mapInArrow(_later, "_id long, dg long, at binary")
    later = stored(found.groupBy(k).agg(F.collect_list(F.struct("_id", "dg", "at")).alias("later")), "later")
    whole = full(rows if each else once).select("k", "_id", "text", "dg", "copy").join(later, "k", "left")
    own = F.transform(F.filter("later", lambda x: (x["_id"] == F.col("_id")) & (x["dg"] == F.col("dg"))), lambda x: x["at"])
    none = F.array().cast("array<binary>")
    return whole.select("_id", "dg", "text", "copy", F.coalesce(own, none).alias("later")).mapInArrow(_cut(window), "_id long, dg long, n_words long, n_removed long, kept string")


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the repeated passages cut out of text (and n_chars, if there is one, counted anew). Texts from which
    nothing goes stay as they are, character for character; a document that loses its last word goes. All other
    columns stay. Several rows under one id and text each stay or go alike."""
    names = docs.columns
    own, dg, cut = (unused(names, c) for c in ("id", "dg", "cut"))
    given = docs.withColumns({own: id_order(), dg: F.coalesce(F.xxhash64(F.col("text").cast("string")), F.lit(0))})
    made = _cut_rows(given.select(F.col(own).alias("_id"), F.col("text").cast("string").alias("text")), window, each=False).filter("n_removed > 0")
    # a text without words isn't stored with the digests: several rows of it may be left
    made = made.groupBy(F.col("_id").alias(own), F.col("dg").alias(dg)).agg(F.max(F.struct("n_removed", "n_words", "kept")).alias(cut))
    found = F.col(cut)
    out = given.join(made, [own, dg], "left").filter(found.isNull() | (found["n_removed"] < found["n_words"]))
    text = F.when(found.isNull(), F.col("text").cast("string")).otherwise(found["kept"])
    out = out.withColumn("text", text)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(found.isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*(F.col(f"`{c}`") for c in names))


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, p, array_to_string(list_slice(ws, p, p + 19), ' ') AS seq
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS p FROM w WHERE len(ws) >= 20)
), firsts AS (
  SELECT md5(seq) AS seq, min({'d': doc_id, 'a': p}) AS f FROM win GROUP BY 1 HAVING count(*) > 1
), later AS (
  SELECT doc_id, p FROM win JOIN firsts ON md5(win.seq) = firsts.seq WHERE {'d': doc_id, 'a': p} > f
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS k FROM later
), listed AS (
  SELECT doc_id, list(k) AS ks FROM gone GROUP BY 1
), kept AS (
  SELECT w.doc_id, len(ws) AS n, coalesce(len(ks), 0) AS r, ks, ws FROM w LEFT JOIN listed ON w.doc_id = listed.doc_id
), k2 AS (
  SELECT doc_id, n, r, string_agg(word, ' ' ORDER BY k) FILTER (NOT coalesce(list_contains(ks, k), false)) AS t
  FROM (SELECT doc_id, n, r, ks, unnest(ws) AS word, unnest(range(1, n + 1)) AS k FROM kept) GROUP BY doc_id, n, r
)
SELECT kept.doc_id, kept.n::BIGINT AS n_words, kept.r::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM kept LEFT JOIN k2 ON kept.doc_id = k2.doc_id
"""
