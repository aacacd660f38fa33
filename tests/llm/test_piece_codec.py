"""The SentencePiece codec against the library, on texts that are hard to cut, merge and spell."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from pairlens.llm import piece_codec, queries

P = pytest.importorskip("public_tokenizers")
PATH = P.path("piece_bpe_32k.model")
PARTS = [
    "a", "b", "the", "ing", " ", "  ", "     ", "▁", "\n", "\t", "\r\n", "é", "é", "中文", "日", "שָׁלוֹם", "مَرحبا", "\U0001f600", "x", "=", "==", "----", "0", "12345", "<s>", "</s>", "<unk>",
    "<0x41>", "\x00", "\x85", " ", "ﬁ", "Ａ", "aaaa", "haha", "lalala", "퟿", "İΣ",
]


def texts():
    rng = random.Random(1)
    out = [None, "", " ", "   ", "▁", " ▁ ", "\n", "\n\n "]
    out += ["".join(rng.choices(PARTS, k=rng.randint(1, 60))) for _ in range(1500)]
    out += [c * k for c in (" ", "=", "a", "ha", "-", "▁", "\n", "é") for k in range(1, 40)]
    out += [" " * k + "x" for k in range(1, 40)]
    # words beyond LONG, with and without what opens a word
    out += ["".join(rng.choices("abcdefghij", k=3000)), "a" * 5000, " " * 5000, "x\n" + "=-" * 2000, "".join(chr(rng.randint(1, 0xD7FF)) for _ in range(4000))]
    return out


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=PATH)


def test_ids_and_texts_equal_the_library(spark, library):
    rows = [(d, t, [d], "c", 1) for d, t in enumerate(texts())]
    rows += [rows[9]] * 2 + [(None, "null id", [0], "c", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids array<long>, c0 string, decoded int").repartition(3)
    got = piece_codec.encode_pieces(frame, PATH, decode=True)
    assert got.columns == ["doc_id", "c0", "ids", "decoded"]
    key = lambda r: (str(r[0]), r[1])
    want = sorted(((d, library.encode(t or "", add_eos=True)) for d, t, *_ in rows), key=key)
    found = got.collect()
    assert sorted(((r.doc_id, r.ids) for r in found), key=key) == want
    assert all(r.decoded == library.decode(r.ids) for r in found)
    again = piece_codec.decode_pieces(got, PATH).collect()
    assert [r.decoded for r in again] == [library.decode(r.ids) for r in again] and len(again) == len(rows)
    assert piece_codec.encode_pieces(frame.limit(0), PATH).count() == 0
    assert piece_codec.encode_pieces(frame, PATH).columns == ["doc_id", "c0", "decoded", "ids"]


def test_any_ids_decode_as_the_library_does(spark, library):
    rng = random.Random(2)
    rows = [([rng.randrange(32_000) for _ in range(rng.randint(0, 9))],) for _ in range(300)] + [(None,), ([],)]
    for r in piece_codec.decode_pieces(spark.createDataFrame(rows, "ids array<int>"), PATH).collect():
        assert r.decoded == (None if r.ids is None else library.decode(r.ids))


def test_words_whose_merges_depend_on_each_other_start_again(library, monkeypatch):
    """Runs of blanks have pieces of one score: merged all at once they would come out otherwise."""
    model, seen = piece_codec.load(PATH), []
    rounds = piece_codec.PieceModel._rounds
    monkeypatch.setattr(piece_codec.PieceModel, "_rounds", lambda self, *a: seen.append(a[-1]) or rounds(self, *a))
    words = [chr(0x2581) * k + "x" for k in range(1, 60)]
    ids, count = model.encode(pa.array(words, pa.large_string()))
    assert seen == [False, True]
    for w, own in zip(words, np.split(ids, np.cumsum(count)[:-1]), strict=True):
        assert own.tolist() == library.encode(w[1:])


def test_other_files_are_refused(tmp_path):
    from sentencepiece.sentencepiece_model_pb2 import ModelProto

    with open(PATH, "rb") as f:
        proto = ModelProto.FromString(f.read())
    proto.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "other.model").write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError, match="other.model"):
        piece_codec.PieceModel(str(tmp_path / "other.model"))


def test_pieces_that_reach_over_blanks_take_the_border_away(tmp_path):
    """A vocabulary with a piece of two words: texts are then not cut at blanks."""
    from sentencepiece import SentencePieceProcessor
    from sentencepiece.sentencepiece_model_pb2 import ModelProto

    with open(PATH, "rb") as f:
        proto = ModelProto.FromString(f.read())
    by = {p.piece: p for p in proto.pieces}
    by["▁quickly"].piece = "▁of▁the"  # a late piece, made of ▁of and ▁the
    (tmp_path / "own.model").write_bytes(proto.SerializeToString())
    own = str(tmp_path / "own.model")
    model, library = piece_codec.PieceModel(own), SentencePieceProcessor(model_file=own)
    assert not model.border
    sample = ["one of the two", "of the of the  of the", "often", *texts()[8:200]]
    words, first = piece_codec._words(pa.array(sample, pa.string()), model)
    ids, count = model.encode(words)
    ends = np.concatenate([[0], np.cumsum(count)])[first]
    for t, a, b in zip(sample, ends[:-1], ends[1:], strict=True):
        assert ids[a:b].tolist() == library.encode(t)


def test_op12(spark, library, tmp_path):
    rows = list(enumerate(texts()[:400]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = set()
    for d, t in rows:
        ids = library.encode(t or "", add_eos=True)
        want.add((d, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    assert {tuple(r) for r in queries.QUERIES["op12_sentencepiece_codec"](spark, f"file://{tmp_path}").collect()} == want
