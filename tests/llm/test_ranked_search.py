"""Ranked search against scoring every document, over shards and blocks of all sizes."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pairlens.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, item_id string, score double, n int, terms string"


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    df, n, total = Counter(t for _, c in held for t in c), len(held), sum(sum(c.values()) for _, c in held)
    out = []
    for item, text in items:
        scored = []
        for d, c in held:
            m = 50 + 50 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def tables(seed, n=300):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(200)] + ["É", "é", "Straße", "中文", "x9", "A", "a_b", "don't"]
    weight = [1 / (k + 1) for k in range(len(vocabulary))]
    some = lambda most: " ".join(rng.choices(vocabulary, weight, k=rng.randint(1, most)))
    docs = [(d, some(60)) for d in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, " .,!"), (n + 3, some(5000)), (None, docs[3][1]), (None, some(10)), (-5, docs[4][1])]
    docs += [(d, docs[7][1]) for d in range(n + 10, n + 90)] + [docs[9]] * 3  # ties, and rows that are repeated
    items = [(i, some(30)) for i in range(20)]
    items += [(100, None), (101, ""), (102, "?!"), (103, "nowhere else"), (104, "w0"), (105, docs[7][1]), (105, docs[7][1]), (None, "w1 W1 w150"), (106, some(400)), (107, "É é")]
    return docs, items


@pytest.mark.parametrize("seed, k, block, shard, lanes", [(1, 50, 1 << 22, 1 << 20, 1 << 15), (2, 5, 300, 400, 64), (3, 1, 1 << 22, 1, 1), (4, 1000, 900, 3000, 1 << 15)])
def test_the_best_documents_are_those_of_scoring_all(spark, monkeypatch, seed, k, block, shard, lanes):
    monkeypatch.setattr(ranked_search, "LANES", lanes)
    docs, items = tables(seed, 300 if shard > 1 else 60)
    frame = spark.createDataFrame([(d, t, "x", 0.5, 1, "y") for d, t in docs], DOCS).repartition(5)
    asked = spark.createDataFrame([(i, t, 1.0) for i, t in items], "item_id int, text string, doc_id double").repartition(2)
    got = ranked_search.best_documents(frame, asked, k, block, shard)
    assert got.dtypes == [("item_id", "int"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, k)


def test_empty_tables(spark):
    docs, items = (spark.createDataFrame([(1, "a b")], s) for s in ("doc_id long, text string", "item_id long, text string"))
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.selectExpr("doc_id", "cast(null as string) as text"), items)):
        assert ranked_search.best_documents(d, i).collect() == []


def test_documents_that_cannot_win_are_skipped(monkeypatch):
    """Of many documents with common terms only a part is scored once the rare terms have filled the heap."""
    rng = random.Random(0)
    common, rare = [f"c{k}" for k in range(20)], [f"r{k}" for k in range(3)]
    docs = [" ".join(rng.choices(common, k=30) + (rare if d % 10 == 0 else [])) for d in range(5000)]
    vocabulary = ranked_search.Vocabulary.of([" ".join([*common[:4], *rare])])
    index = list(ranked_search._indexed(vocabulary.spelled)(iter([pa.RecordBatch.from_arrays([pa.array(range(5000)), pa.array(docs)], ["doc_id", "text"])])))
    df = sum(np.bincount(b.column("terms").flatten().to_numpy(), minlength=len(vocabulary.spelled)) for b in index)
    weights = np.array([math.floor(1000 * math.log(10_002 / (2 * x + 1))) for x in df], np.int64)
    length = sum(b.column("n").to_numpy().sum() for b in index)
    query = ranked_search.Query(5000, int(length), weights, vocabulary.begin, vocabulary.terms, np.zeros(1, np.int64), 50)

    class Shared:
        value = query

    rounds, moved = [], ranked_search.Shard._moved
    monkeypatch.setattr(ranked_search.Shard, "_moved", lambda self, *a: rounds.append(1) or moved(self, *a))
    (out,) = ranked_search._searched(Shared, 1 << 20)(iter(index))
    assert out.num_rows == 50 and set(np.array(out.column("doc_id")) % 10) == {0}
    assert len(rounds) / 2 < 1200  # each pivot moves lists twice; the heap is full after 500 documents


def test_terms_that_share_a_hash_are_told_apart(monkeypatch):
    words = ranked_search._cut(pa.array(["alpha beta alphabet " + "y" * 20 + " " + "y" * 21]))
    finder = ranked_search._Finder(pa.array(["alpha", "y" * 21]))
    assert finder.find(words).tolist() == [0, -1, -1, -1, 1]
    monkeypatch.setattr(ranked_search.Words, "hashes", lambda self, which=None: np.full(len(self.starts), finder.hashes[0]))
    assert finder.find(words).tolist() == [finder.order[0] if k == (0, 4)[finder.order[0]] else -1 for k in range(5)]
    with pytest.raises(ValueError, match="hash"):
        ranked_search._Finder(pa.array(["alpha", "beta"]))
