"""Fill-in-the-middle against plain lists of units, and ropes against byte strings."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.llm import fill_in_middle, rope

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, n long, h1 string, output string"


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (doc_id, len(units), "plain", None, None, text)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "spm" if h4 % 100 < 80 else "psm"
    return (doc_id, len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}")


def texts():
    rng = random.Random(3)
    pieces = ["a", "bé", "中文字", " ", "\n", "\t ", "\x0b\x0c", "\x00", "\x85", " ", "<P", "P>", "<", "S>", "\U0001f600", "x" * 50]
    out = [None, "", " ", "\n\n", "one", " one", "one ", "a <P> b", "<M>", "a<S", "< P >"]
    out += ["".join(rng.choices(pieces, k=rng.randint(1, 80))) for _ in range(300)]
    out.append(" ".join(rng.choices(pieces, k=60_000)))
    out.append("y" * 100_000)
    return out


def test_texts_are_rearranged_and_rebuilt(spark):
    rows = [(d, t, 7, "h", "o") for k in range(3) for d, t in enumerate(texts(), 1000 * k)]
    rows += [(None, "null id a b c", 1, "", "")] * 2 + [rows[5]] * 3
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    made = fill_in_middle.fill_in_middle(frame)
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    key = lambda r: tuple(map(str, r))
    want = sorted((brute(d, t) for d, t, *_ in rows), key=key)
    assert sorted(map(tuple, made.collect()), key=key) == want and {r[2] for r in want} == {"plain", "psm", "spm"}
    back = fill_in_middle.restore(made.withColumn("other", F.lit(1)))
    assert back.columns == [*made.columns, "other", "restored"]
    assert sorted((str(r.doc_id), r.restored) for r in back.collect()) == sorted((str(d), t or "") for d, t, *_ in rows)
    assert fill_in_middle.restore(fill_in_middle.fill_in_middle(frame.limit(0))).count() == 0


def test_rates_are_kept(spark):
    rows = spark.range(2000).selectExpr("id as doc_id", "'a b c d e f' as text")
    count = lambda **x: {r.form: r["count"] for r in fill_in_middle.fill_in_middle(rows, **x).groupBy("form").count().collect()}
    assert count(rate=0) == {"plain": 2000} and count(rate=100, spm=0) == {"psm": 2000}
    assert abs(count()["plain"] - 1000) < 100 and count(seed=1) != count(seed=2)


@pytest.mark.parametrize("size", [1, 2, 7, 256])
def test_ropes_are_cut_and_joined(size):
    rng = random.Random(size)
    for text in texts()[1:120]:
        data = np.frombuffer(text.encode(), np.uint8)
        (tree,) = rope.ropes(data, np.array([0, len(data)]), size)
        units = UNIT.findall(text)
        if tree is None:
            assert not text
            continue
        assert (tree.units, tree.points, rope.text(tree).decode()) == (len(units), len(text), text)
        assert all(x.units <= size for x in rope.leaves(tree))
        k = rng.randint(0, len(units))
        left, right = rope.split(tree, k)
        assert (rope.text(left).decode(), rope.text(right).decode()) == ("".join(units[:k]), "".join(units[k:]))
        assert (left.units if left else 0, right.units if right else 0) == (k, len(units) - k)
        k = rng.randint(0, len(text))
        left, right = rope.split(tree, k, "points")
        assert (rope.text(left).decode(), rope.text(right).decode()) == (text[:k], text[k:])
        assert rope.text(rope.join(right, left)).decode() == text[k:] + text[:k] and rope.text(tree).decode() == text


def test_ropes_stay_balanced():
    rng, one = random.Random(0), [rope.leaf(f" w{k}".encode()) for k in range(3000)]
    tree = None
    for x in one:
        tree = rope.join(tree, x)
    for _ in range(300):
        k = rng.randint(0, 3000)
        left, right = rope.split(tree, k)
        tree = rope.join(right, left)
    assert tree.units == 3000 and tree.height <= 1.45 * np.log2(3000) + 2
    assert sorted(rope.text(tree).split()) == sorted(x.data.strip() for x in one)
    todo = [tree]
    while todo:
        node = todo.pop()
        if isinstance(node, rope.Fork):
            assert abs(node.left.height - node.right.height) <= 1
            todo += [node.left, node.right]
