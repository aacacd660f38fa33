"""The queries that SQL can't express, and the pipeline, over whole small tables, against brute force."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F
from test_llm import SCHEMA, brute_classes, brute_substrings, corpus

from pairlens.llm import queries

P = pytest.importorskip("public_tokenizers")
BENCH = [(0, "one two three four five six seven eight nine ten eleven"), (1, "Short item"), (2, None), (3, "")]


def rows():
    out = corpus(7, 90)
    out += [(200, "12 34 !!", "en", "s", 8, "x", "y"), (201, "a b " + BENCH[0][1].upper() + " c", "en", None, None, None, None), (202, "a short ITEM here", None, "s", 1, "x", "y")]
    return out


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(f"file://{at}/documents.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"file://{at}/benchmark.parquet")
    return f"file://{at}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path(name))


def test_op4(spark, sf):
    import zlib

    got = {r.doc_id: r for r in queries.QUERIES["op4_language_id"](spark, sf).collect()}
    assert set(got) == {r[0] for r in rows()}
    for d, text, *_ in rows():
        assert got[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= got[d].score <= 1
        assert (got[d].lang_pred == "und") == (not any(c.isalpha() for c in text or ""))
        assert got[d].lang_pred in ("en", "fr", "und")


def test_sharding_layout(spark, sf):
    out = queries.QUERIES["sharding_layout"](spark, sf).collect()
    assert sum(r.n_rows for r in out) == len(rows()) and {r.shards_before for r in out} == {16} and len(out) < 4
    assert queries.QUERIES["op7_sharding"](spark, sf).count() == len(rows())


def test_op6(spark, sf):
    t = library("byte_bpe_50k.json")
    got = {tuple(r) for r in queries.QUERIES["op6_token_counts"](spark, sf).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()}
    counts = {d: len(t.encode(x or "", add_special_tokens=False).ids) for d, x, *_ in rows()}
    assert got == {(d, len((x or "").encode()), counts[d], counts[d] > 512) for d, x, *_ in rows()}


def test_op8(spark, sf):
    t = library("word_bpe_49k.json")
    got = {tuple(r) for r in queries.QUERIES["op8_bpe_codec"](spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    ids = {d: t.encode(x or "", add_special_tokens=False).ids for d, x, *_ in rows()}
    assert got == {(d, len(i), sha(" ".join(map(str, i))), sha(t.decode(i, skip_special_tokens=False))) for d, i in ids.items()}


def brute_pipeline():
    t = library("word_bpe_49k.json")
    left = {d: x for d, x, *_ in rows() if any(c.isalpha() for c in x or "")}
    classes = brute_classes(list(left.items()))
    left = {d: x for d, x in left.items() if classes[d][0] == d}
    for d, (n, gone, kept) in brute_substrings(list(left.items())).items():
        if gone:
            left[d] = kept
        if gone and gone == n:
            del left[d]
    words = lambda x: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
    windows = {tuple(w[s : s + 10]) for _, x in BENCH for w in [words(x)] for s in range(max(1, len(w) - 9)) if w}
    dirty = {d for d, x in left.items() for w in [words(x)] if any(tuple(w[s : s + len(p)]) == p for p in windows for s in range(len(w)))}
    return {d: (x, t.encode(x, add_special_tokens=False).ids) for d, x in left.items() if d not in dirty}, dirty


def test_pipeline(spark, sf):
    import corpus_pipeline

    want, dirty = brute_pipeline()
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == [*spark.read.parquet(f"{sf}/documents.parquet").columns, "token_ids", "n_tokens"]
    got = {r.doc_id: (r.text, r.token_ids) for r in out.collect()}
    assert got == want and dirty == {201, 202} and len(want) < len(rows()) - 4
    assert out.filter(F.col("n_tokens") != F.size("token_ids")).count() == 0
    cut = [d for d, x, *_ in rows() if d in want and want[d][0] != x]
    assert all(r.n_chars == len(r.text) for r in out.filter(F.col("doc_id").isin(cut)).collect()) and cut


def test_pipeline_of_nothing(spark, sf, tmp_path):
    import corpus_pipeline

    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").limit(0).write.parquet(f"file://{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
