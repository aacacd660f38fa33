"""Chunks of long texts over many tasks."""

import random

from pyspark.sql import functions as F

from pairlens import providers
from pairlens.functions import text as tx


def _texts():
    rng = random.Random(4)
    parts = ["ab. ", "c! ", "Hello there? ", "x" * 30, " ", "\n", ". ", ".", "\x85", " é.", "  ", "?!"]
    return [None, "", " ", ". ", ".  x", "a", " a. b"] + ["".join(rng.choices(parts, k=rng.randint(1, 60))) for _ in range(300)]


def test_long_texts_are_packed_as_short_ones(spark):
    rows = spark.createDataFrame([(t,) for t in _texts()], "t string")
    for most in (1, 7, 25, 100):
        for r in rows.select("t", tx.chunk_pack(F.col("t"), most).alias("a"), tx.chunk_pack_long(F.col("t"), most).alias("b")).collect():
            assert r.a == r.b, (r.t, most)


def test_chunks_are_dealt_and_put_together(spark):
    rows = [(k, t, "other", t[::-1] if t else "q") for k, t in enumerate(_texts())]
    frame = spark.createDataFrame(rows * 2, "id long, x string, n string, row string")
    make = lambda: providers.Marker("^")
    near = providers.apply_chunks(frame, make, ["x", "row"], 20, batch=3, spread=1 << 30)
    far = providers.apply_chunks(frame, make, ["x", "row"], 20, batch=3, spread=-1)
    assert near.columns == far.columns == frame.columns and near.dtypes == far.dtypes
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, near.collect()), key=key) == sorted(map(tuple, far.collect()), key=key)
    some = providers.apply_chunks(frame, make, ["x", "row"], 20, batch=3, spread=200)
    assert sorted(map(tuple, near.collect()), key=key) == sorted(map(tuple, some.collect()), key=key)


def test_one_long_text_uses_many_tasks(spark):
    text = "A sentence of some words. " * 400_000  # 10 MB
    frame = spark.createDataFrame([(1, text), (2, "short. one")], "id long, x string")

    class Where:
        def __call__(self, inputs):
            from pyspark import TaskContext

            return [f"{TaskContext.get().partitionId()}:{len(x)}" for x in inputs]

    got = {r.id: r.x.split(" ") for r in providers.apply_chunks(frame, Where, "x", 2000).collect()}
    assert len({x.partition(":")[0] for x in got[1]}) == 4 and len(got[2]) == 1
    assert sum(int(x.partition(":")[2]) for x in got[1]) + len(got[1]) - 1 == len(text)  # a blank between two chunks belongs to neither
