import pytest
from pyspark.sql import functions as F

from pairlens.functions import score as sc
from pairlens.functions import text as tx
from pairlens.functions.dialect import ARABIC, HEBREW


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lit(x):
    return F.lit(x)


def test_hebrew_maqaf_fuses_words(spark):
    assert one(spark, tx.normalise(lit("אב־גד"), HEBREW)) == "אבגד"


def test_arabic_wider_mark_splits_the_word(spark):
    assert one(spark, tx.normalise(lit("بآب"), ARABIC)) == "با ب"


def test_stop_words_only_match_exactly_but_have_no_f1(spark):
    p, g = tx.tokens(lit("في"), ARABIC), F.array(tx.tokens(lit("في"), ARABIC))
    assert one(spark, sc.exact_match(p, g)) == 1
    assert one(spark, sc.token_f1(p, g)) == 0.0


def test_no_golds(spark):
    none = F.array().cast("array<array<string>>")
    assert one(spark, sc.exact_match(F.array(lit("a")), none)) == 0
    assert one(spark, sc.token_f1(F.array(lit("a")), none)) == 0.0


def test_half_even_f1(spark):
    g = F.array(*(lit(f"w{k}") for k in range(63)))
    assert one(spark, sc.token_f1(F.array(lit("w0")), F.array(g))) == 0.0312


@pytest.mark.parametrize("text, want", [("a a b c", 3), ("x", 0), ("", 0)])
def test_multiset_intersection(spark, text, want):
    words = lambda s: tx.split_words(lit(s))
    assert one(spark, sc.common_tokens(words(text), words("a b b a a"))) == want


def test_postfix_keeps_characters_and_is_idempotent(spark):
    t = lit("بَاپَبُ x")
    moved = tx.postfix_reorder(t)
    assert one(spark, tx.same_characters(t, moved))
    assert one(spark, tx.postfix_reorder(moved)) == one(spark, moved)
    assert one(spark, tx.postfix_reorder(lit("بَتُ"))) == "بتَُ"


def packed(text, most):
    """An independent model of the packing."""
    import re

    if len(text) <= most:
        return [text] if text else []
    chunks, open_, size = [], "", 0
    for s in re.split(r"(?<=[.!?])\s+", text):
        if size + len(s) >= most and open_:
            chunks.append(open_)
            open_, size = s, len(s)
        else:
            open_ = f"{open_} {s}" if open_ else s
            size += len(s) + 1
    if open_:
        chunks.append(open_)
    return [c[k : k + most] for c in chunks for k in range(0, len(c), most)]


@pytest.mark.parametrize("text", ["", "One. Two! Three? Four", "x" * 55, "aa. " + "b" * 30 + " cc. d.", "a. b. c. d. e. f. g. h. i."])
@pytest.mark.parametrize("most", [5, 12, 400])
def test_chunks(spark, text, most):
    assert one(spark, tx.chunk_pack(lit(text), most)) == packed(text, most)


def test_first_line_and_labels(spark):
    assert one(spark, tx.first_line(lit("  a b \n c"))) == "a b"
    assert one(spark, tx.parse_label(lit('{"label": " correct "}'))) == "CORRECT"
    assert one(spark, tx.parse_label(lit("nonsense"))) == "ERROR"


def test_buckets(spark):
    b = lambda *a: one(spark, sc.answer_length_bucket(F.array(*map(lit, a))))
    assert [b("a"), b("a b c", " "), b(" "), b("a " * 9), b("a " * 20)] == ["short", "medium", "short", "long", "very_long"]
    assert one(spark, sc.corrupted_answers(F.array(lit("<b>x</b>"))))
    assert not one(spark, sc.corrupted_answers(F.array(lit("x"))))
