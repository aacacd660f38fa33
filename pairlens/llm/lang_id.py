"""Language identification by a string kernel.

A text's features are the byte n-grams of 1 to 4 bytes that it holds (A-Z lower-cased, other ASCII but letters read as
blanks), each hashed to one of BUCKETS; only presence counts, and all lengths are blended. The kernel of two texts is the
number of common features over the geometric mean of their numbers. Kernel ridge regression, one language against the
rest, is solved on Nyström landmarks. The landmark part of the solution folds into one matrix, so that a batch of texts is
scored by one product of its presence matrix with it, divided by the norms.

A text of more than STRETCH bytes holds so many n-grams that nearly all buckets would be taken, whatever its language. It is cut
into stretches of equal length, at most STRETCH bytes each; its score for a language is the mean of theirs, weighted by length.

What is learned from, a bounded sample of the labelled rows: at most PER_LANGUAGE distinct texts of each language (fewer
where there are so many languages that these would be more than SAMPLE in all), chosen by a hash of the text, copies once; of a
long text one stretch with a letter, which that hash picks. The rows' features are computed where the rows are, and BUCKETS / 8
bytes of each go to the driver, 64 MB at most. Every language is learned; more than LANGUAGES of them are an error, so that the
weights, which are broadcast, have 128 MB at most and the driver solves a system of 4,096 rows at most. There are LANDMARKS
landmarks, or four for each language.

Defined cases: a null text, or one without a letter, is `und` with score 0, as is everything if nothing can be learned; a
language that has no text with a letter isn't learned; a null doc_id counts as held out; repeated rows each give a row; an
empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._text import steps, text_buffer, tidy

BUCKETS, GRAMS = 1 << 15, 4
PER_LANGUAGE, SAMPLE, LANDMARKS, RIDGE = 500, 16_384, 512, 1e-4
STRETCH, LANGUAGES = 1 << 14, 1 << 10
NONE = "und"
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_BITS = BUCKETS.bit_length() - 1


class _Stretches:
    """The stretches of texts: the text that each is of, and its range of bytes. A short or empty text is one."""

    def __init__(self, texts: pa.Array):
        self.data, offsets = text_buffer(texts)
        self.sizes = np.diff(offsets)
        many = np.maximum(1, -(-self.sizes // STRETCH))
        self.text = np.repeat(np.arange(len(texts)), many)
        k, many, size = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many), many[self.text], self.sizes[self.text]
        self.start, self.end = (offsets[:-1][self.text] + size * x // many for x in (k, k + 1))
        self.stop = offsets[1:][self.text]

    def presence(self) -> Iterator[np.ndarray]:
        """A boolean row of BUCKETS for each; n-grams that begin in a stretch are its own."""
        data = _FOLD[self.data].astype(np.uint32)
        buckets, code = [], np.zeros(0, np.uint32)
        for n in range(1, GRAMS + 1):
            code = data.copy() if n == 1 else (code[:-1] << np.uint32(8)) | data[n - 1 :]
            buckets.append((((code ^ np.uint32(n * 0x51ED27)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - _BITS)).astype(np.uint16))
        for lo, hi, stop in zip(self.start.tolist(), self.end.tolist(), self.stop.tolist(), strict=True):
            row = np.zeros(BUCKETS, bool)
            for n, b in enumerate(buckets, 1):
                row[b[lo : max(lo, min(hi, stop - n + 1))]] = True
            yield row

    def with_letter(self) -> np.ndarray:
        plain = (self.data | 0x20) - np.uint8(ord("a")) < 26
        total = np.concatenate([[0], np.cumsum(plain)])
        some = total[self.end] > total[self.start]
        for k in np.flatnonzero(~some & (self.end > self.start)).tolist():
            # whole characters: those that begin in the stretch
            lo, hi = (self._character(at, self.stop[k]) for at in (self.start[k], self.end[k]))
            some[k] = any(c.isalpha() for c in self.data[lo:hi].tobytes().decode("utf-8", "replace"))
        return some

    def _character(self, at: int, stop: int) -> int:
        while at < stop and self.data[at] & 0xC0 == 0x80:
            at += 1
        return at


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        cut = _Stretches(batch.column("text"))
        some = np.flatnonzero(cut.with_letter())
        text, first, many = np.unique(cut.text[some], return_index=True, return_counts=True)
        hashes = batch.column("h").to_numpy()[text]
        chosen = set(some[first + hashes % many].tolist())
        packed = [np.packbits(row).tobytes() for k, row in enumerate(cut.presence()) if k in chosen]
        keep = batch.take(pa.array(text))
        yield pa.RecordBatch.from_arrays([keep.column("lang"), keep.column("h"), pa.array(packed, pa.binary())], ["lang", "h", "bits"])


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages, and the matrix (BUCKETS x languages). labelled: text, lang."""
    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("text is not null and lang is not null")
    h = F.xxhash64("text")
    # distinct texts decide how large a part of a language is taken
    copies = rows.select("lang", h.alias("h")).distinct()
    counts = copies.groupBy("lang").agg(F.count("*").alias("texts")).orderBy("lang").limit(LANGUAGES + 1).collect()
    if not counts:
        return [], np.zeros((BUCKETS, 0), np.float32)
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    most = min(per_language, SAMPLE // len(counts))
    # half as many again, for texts without letters
    facts = labelled.sparkSession.createDataFrame([(r.lang, min(1 << 30, int(1.5 * most / r.texts * (1 << 30)) + 1)) for r in counts], "lang string, part long")
    sample = rows.withColumn("h", h).join(F.broadcast(facts), "lang").filter(F.pmod("h", F.lit(1 << 30)) < F.col("part"))
    # copies of a text count once, however many there are
    sample = sample.groupBy("lang", "h").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy("h")
    sample = sample.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= 2 * most)
    found = sample.mapInArrow(tidy(_featured), "lang string, h long, bits binary").collect()
    by: dict[str, dict[int, bytes]] = {r.lang: {} for r in counts}
    for r in found:
        by[r.lang][r.h % (1 << 62)] = bytes(r.bits)
    chosen = [(lang, bits) for lang in sorted(by) for _, bits in sorted(by[lang].items())[:most]]
    langs = sorted({lang for lang, _ in chosen})
    if not langs:
        return [], np.zeros((BUCKETS, 0), np.float32)
    at = {c: k for k, c in enumerate(langs)}
    bits = np.frombuffer(b"".join(b for _, b in chosen), np.uint8).reshape(len(chosen), -1)
    return langs, ridge(bits, np.array([at[lang] for lang, _ in chosen]), len(langs))


def ridge(bits: np.ndarray, label: np.ndarray, languages: int) -> np.ndarray:
    """Weights (BUCKETS x languages) of packed presence rows, ordered by label."""

    def unit(rows: np.ndarray) -> np.ndarray:
        x = np.unpackbits(rows, axis=1).astype(np.float32)
        return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))

    at = np.unique(np.linspace(0, len(bits) - 1, min(max(LANDMARKS, 4 * languages), len(bits))).astype(int))
    near = bits[at]
    # all but bits in pieces, so that memory doesn't grow with the landmarks
    cuts = [near[lo : lo + 128] for lo in range(0, len(near), 128)]
    k = np.concatenate([np.concatenate([x @ unit(c).T for c in cuts], axis=1) for x in (unit(bits[lo : lo + 128]) for lo in range(0, len(bits), 128))]).astype(np.float64)
    g = k[at]
    y = np.zeros((len(bits), languages))
    y[np.arange(len(bits)), label] = 1
    alpha = np.linalg.solve(k.T @ k + RIDGE * len(bits) * g + 1e-6 * np.eye(len(at)), k.T @ y)
    return sum(unit(c).T @ alpha[lo : lo + 128] for lo, c in zip(range(0, len(near), 128), cuts, strict=True)).astype(np.float32)


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, weights = model.value
        names = np.array([*langs, NONE], object)
        for batch in steps(batches, "_text"):
            cut = _Stretches(batch.column("_text"))
            letters = np.bincount(cut.text, cut.with_letter(), len(batch)) > 0
            total, rows, size = np.zeros((len(batch), len(langs))), cut.presence(), cut.end - cut.start
            for lo in range(0, len(cut.text), 128) if langs else ():
                hi = min(lo + 128, len(cut.text))
                x = np.array([next(rows) for _ in range(lo, hi)], np.float32)
                out = (x @ weights) / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
                np.add.at(total, cut.text[lo:hi], out * size[lo:hi, None].astype(np.float64))
            total /= np.maximum(cut.sizes, 1)[:, None]
            label, score = (total.argmax(1), total.max(1)) if langs else (np.full(len(batch), 0), np.zeros(len(batch)))
            label[~letters], score[~letters] = len(langs), 0
            rest = [c for c in batch.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(names[label], pa.string()), pa.array(np.clip(score, 0, 1).astype(np.float64))], [*rest, "lang_pred", "score"])

    return tidy(run)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """docs (with all its columns as c0, c1, ...), lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("text").cast("string").alias("_text"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)))
    schema = ", ".join([*(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema)), "lang_pred string", "score double"])
    return rows.mapInArrow(_scored(shared), schema)


def held_out(name: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(name).cast("string")) % 5 == 0, F.lit(True))


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Per row of docs (doc_id, text, lang): doc_id, held_out, lang_pred, score. Learns from the rows not held out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = fit(rows.filter(~held_out()), per_language)
    out = predict(rows.select("doc_id", "text"), model).withColumnRenamed("c0", "doc_id")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def with_language(docs: DataFrame, per_language: int = PER_LANGUAGE, least: float = 0.0) -> DataFrame:
    """docs without the rows that have no language (no text, no letter in it, or a score below `least`). Where lang is null,
    the predicted language takes its place; if there is no such column, or nothing to learn from, texts with letters stay as
    they are."""
    names = docs.columns
    known = "lang" in names and "doc_id" in names
    langs, weights = fit(docs.filter(~held_out()), per_language) if known else ([], None)
    model = (langs, weights) if langs else (["any"], np.zeros((BUCKETS, 1), np.float32))
    out = predict(docs, model).filter((F.col("lang_pred") != NONE) & (F.col("score") >= least if langs else F.lit(True)))
    kept = {c: F.col(f"c{i}") for i, c in enumerate(names)}
    if langs:
        kept["lang"] = F.coalesce(kept["lang"], F.col("lang_pred")).cast(docs.schema["lang"].dataType)
    return out.select(*(x.alias(c) for c, x in kept.items()))


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))


def learnable(doc_id: int) -> bool:
    """For tests: whether a row may be learned from."""
    return zlib.crc32(str(doc_id).encode()) % 5 != 0
