"""Token counts of whole texts, without ids of texts.

1. The texts are cut into pre-tokens; each distinct pre-token of the corpus is a row with its frequency.
2. The pieces of each of those rows are counted, once.
3. The counts are joined to the documents' pre-token frequencies and summed. The COMMON most frequent pre-tokens, which
   make up nearly all of the text and all hot keys, are joined by broadcast (at most COMMON * WORD_BYTES bytes); what is
   left, frequencies of rare pre-tokens, is joined by a shuffle on the pre-token. Every pre-token is joined in one of the
   two ways.

Pre-tokens of more than WORD_BYTES bytes are counted where they stand, so that no long string is a key. Frequencies are
taken within pieces of text, so memory is bounded by a piece.

Defined cases: a null text is empty and has no tokens; repeated rows each give a row, also with null ids; the string of
an added token counts as the library's default has it; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._merges import Merger
from ._pretokens import Characters, PreTokens, load_tokenizer
from ._shared import stored
from ._text import steps
from .bpe_lexicon import most_frequent

LIMIT = 512
#: Pre-tokens that are broadcast, and the most bytes of a pre-token that is a key.
COMMON, WORD_BYTES = 131_072, 256
PIECE_BYTES = 2 << 20


def _tools(path: str):
    tokenizer = load_tokenizer(path)
    return tokenizer, [t.content for t in tokenizer.get_added_tokens_decoder().values()], Characters(tokenizer, fold=False)


def _frequencies(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, special, characters = _tools(path)
        for batch in steps(batches, limit=PIECE_BYTES):
            coded = PreTokens(batch.column("text"), characters, special, attach=True, fold=False).words.dictionary_encode()
            n = np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(coded.dictionary))
            rows = pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.string()), pa.array(n.astype(np.int64))], ["word", "n"])
            yield rows.filter(pc.less_equal(pc.binary_length(rows.column("word")), WORD_BYTES))

    return run


def _pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = Merger(path)
        for batch in steps(batches, "word"):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(merger.encode(batch.column("word"))[1])], ["word", "n", "pieces"])

    return run


def _joined(path: str, common):
    """For each document a row (no word) with the pieces of what is common, and rows of the words that are not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, special, characters = _tools(path)
        merger = Merger(path)
        words, pieces = common.value
        words = pa.array(words, pa.large_string())
        pieces = np.append(pieces, 0)
        for batch in steps(batches, limit=PIECE_BYTES):
            texts = batch.column("text")
            pre = PreTokens(texts, characters, special, attach=True, fold=False)
            coded = pre.words.dictionary_encode()
            held = pc.fill_null(pc.index_in(coded.dictionary, words), len(words)).to_numpy().astype(np.int64)
            count, left = pieces[held], held == len(words)
            long = np.flatnonzero(pc.greater(pc.binary_length(coded.dictionary), WORD_BYTES).to_numpy(zero_copy_only=False))
            if len(long):
                count[long] = merger.encode(coded.dictionary.take(pa.array(long)))[1]
                left[long] = False
            index = coded.indices.to_numpy(zero_copy_only=False)
            n = np.diff(np.concatenate([[0], np.cumsum(count[index])])[pre.first])
            for d in np.flatnonzero(pre.hard).tolist():
                n[d] = len(tokenizer.encode(texts[d].as_py(), add_special_tokens=False))
            rest = [batch.column(c) for c in ("row", "doc_id", "n_bytes")]
            yield pa.RecordBatch.from_arrays([*rest, pa.nulls(len(n), pa.string()), pa.array(n.astype(np.int64))], ["row", "doc_id", "n_bytes", "word", "n"])
            at = np.flatnonzero(left[index])
            doc = np.searchsorted(pre.first, at, "right") - 1
            of, times = np.unique(doc * np.int64(len(left)) + index[at], return_counts=True)
            own, word = of // max(1, len(left)), of % max(1, len(left))
            yield pa.RecordBatch.from_arrays(
                [rest[0].take(pa.array(own)), pa.nulls(len(own), pa.int64()), pa.nulls(len(own), pa.int64()), coded.dictionary.take(pa.array(word)).cast(pa.string()), pa.array(times.astype(np.int64))],
                ["row", "doc_id", "n_bytes", "word", "n"],
            )

    return run


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, common: int = COMMON) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_bytes, n_tokens, over_limit; path: a byte-level BPE file of the tokenizers library."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    words = rows.select("text").mapInArrow(_frequencies(path), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = stored(words.mapInArrow(_pieces(path), "word string, n long, pieces long"), "words")
    found = most_frequent(words, common).select("word", "pieces").collect()
    shared = docs.sparkSession.sparkContext.broadcast(([r.word for r in found], np.array([r.pieces for r in found], np.int64)))
    # numbers of rows are made once, as what they are in is written
    parts = rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_joined(path, shared), "row long, doc_id long, n_bytes long, word string, n long")
    parts = stored(parts, "frequencies")
    rare = parts.filter("word is not null").join(words.select("word", "pieces"), "word")
    none = F.lit(None).cast("long")
    sums = parts.filter("word is null").select("row", "doc_id", "n_bytes", "n").unionByName(rare.select("row", none.alias("doc_id"), none.alias("n_bytes"), (F.col("n") * F.col("pieces")).alias("n")))
    out = sums.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
