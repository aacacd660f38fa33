"""Saved Arrow directories, documents of many rows, the latest view of a ledger as a stream, and batches by length."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairlens import providers, report, storage
from pairlens.functions import text as tx
from pairlens.functions.dialect import ARABIC, HEBREW
from pairlens.operators import delta
from pairlens.sources import arrow_dir
from pairlens.streaming import ledger


def _saved(folder, batches, dictionary=False):
    """A directory as `datasets` lays it out, written by pyarrow: several files and batches of one split, one of the other."""
    table = pa.table({"id": range(100), "text": [f"t{k}" * 50 for k in range(100)], "answers": [{"text": [f"a{k}", None], "answer_start": [k]} for k in range(100)], "unused": [b"x" * 1000] * 100})
    if dictionary:
        table = table.set_column(1, "text", table["text"].dictionary_encode())
    for split, parts in (("train", [table.slice(0, 60), table.slice(60, 30)]), ("test", [table.slice(90)])):
        (folder / split).mkdir(parents=True)
        names = [f"data-{k:05d}-of-{len(parts):05d}.arrow" for k in range(len(parts))]
        for name, part in zip(names, parts, strict=True):
            with pa.OSFile(str(folder / split / name), "wb") as f, pa.ipc.new_stream(f, part.schema) as out:
                for b in part.to_batches(max_chunksize=batches):
                    out.write_batch(b)
        (folder / split / "state.json").write_text(json.dumps({"_data_files": [{"filename": n} for n in names], "_split": split}))
    (folder / "dataset_dict.json").write_text('{"splits": ["train", "test"]}')


@pytest.mark.parametrize("dictionary", [False, True])
def test_saved_directories(spark, tmp_path, dictionary):
    _saved(tmp_path / "d", 7, dictionary)
    schema = "answers struct<text:array<string>,answer_start:array<long>>, id long, text string"
    rows = arrow_dir.read_saved(spark, f"file://{tmp_path}/d", schema, run_bytes=20_000)
    got = rows.collect()
    assert rows.columns == ["answers", "id", "text", "split"] and sorted(r.id for r in got) == list(range(100))
    assert all((r.text, r.answers.text, r.answers.answer_start, r.split) == (f"t{r.id}" * 50, [f"a{r.id}", None], [r.id], "train" if r.id < 90 else "test") for r in got)
    assert rows.rdd.getNumPartitions() == (3 if dictionary else 6)  # of 9, 5 and 2 batches of 9 KB three make a run
    if not dictionary:
        whole = arrow_dir.read_saved(spark, str(tmp_path / "d"))
        assert whole.columns == ["id", "text", "answers", "unused", "split"] and whole.count() == 100
        runs = arrow_dir._runs(str(tmp_path / "d/train/data-00000-of-00002.arrow"), 20_000)
        assert sum(r.count for r in runs) == 9 and len(runs) > 2


def test_directories_are_written_and_read(spark, tmp_path):
    rows = spark.range(50).select("id", F.array(F.col("id").cast("string")).alias("a"), F.struct(F.lit(None).cast("int").alias("x")).alias("s")).repartition(3)
    arrow_dir.save({"one": rows, "none": rows.limit(0)}, f"file://{tmp_path}/w")
    assert json.loads((tmp_path / "w/dataset_dict.json").read_text()) == {"splits": ["one", "none"]}
    got = arrow_dir.read_saved(spark, f"file://{tmp_path}/w", "id long, a array<string>, s struct<x:int>").collect()
    assert sorted((r.id, r.a, r.s.x, r.split) for r in got) == [(k, [str(k)], None, "one") for k in range(50)]
    with pa.OSFile(str(next((tmp_path / "w/one").glob("*.arrow")))) as f:
        assert pa.ipc.open_stream(f).read_all().column_names == ["id", "a", "s"]


@pytest.mark.parametrize("n", [0, 1, 300])
def test_documents_of_many_rows(spark, tmp_path, n):
    rows = spark.range(n).select("id", F.lit('a "b"\n,').alias("t"), F.lit(None).cast("int").alias("x")).repartition(3)
    for head in ({}, {"model": "é", "aggregate": {"all": {"n": n}}}):
        report.write_document(spark, f"file://{tmp_path}/d.json", head, "per_example", rows)
        found = json.loads((tmp_path / "d.json").read_text())
        assert {k: v for k, v in found.items() if k != "per_example"} == head
        assert sorted(found["per_example"], key=lambda r: r["id"]) == [{"id": k, "t": 'a "b"\n,', "x": None} for k in range(n)]


def test_the_latest_view_after_every_trigger(spark, tmp_path):
    """Late and repeated lines, through two restarts from the checkpoint: always the view of all that has arrived."""
    schema = "row_id long, judge_label string, ts int"
    arrivals = [[(1, "ERROR", 1), (2, "CORRECT", 5)], [(1, "CORRECT", 2), (1, "ERROR", 3), (2, "CORRECT", 5)], [(2, "INCORRECT", 4), (3, "ERROR", 1), (1, "INCORRECT", 9)], [(None, "CORRECT", 1)]]
    (tmp_path / "in").mkdir()
    for k, rows in enumerate(arrivals):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("row_id", "judge_label", "ts"), r, strict=True))) for r in rows))
        ledger.run_latest(spark, f"file://{tmp_path}/in", schema, f"file://{tmp_path}/out", f"file://{tmp_path}/at", "row_id", "ts").awaitTermination()
        seen = spark.read.schema(schema).json(f"file://{tmp_path}/in").filter("row_id is not null")
        want = {(r.row_id, r.judge_label, r.ts) for r in ledger.latest(seen, "row_id", "ts").collect()}
        assert {(r.row_id, r.judge_label, r.ts) for r in ledger.read_latest(spark, f"file://{tmp_path}/out", "row_id").collect()} == want
    assert ledger.read_latest(spark, f"file://{tmp_path}/none", "row_id", schema).count() == 0


def test_batches_by_length():
    seen = []

    def model(batch):
        seen.append(batch)
        assert len({len(x) for x in batch}) == 1
        return ["".join(x).lstrip("_") for x in batch]

    texts = ["a" * n for n in (1, 50, 2, 49, 3, 0, 48, 200, 1)] + [None]
    by = providers.ByLength(model, list, most=100, budget=120, fill="_")
    assert by(texts) == [(x or "")[:100] for x in texts]
    assert all(len(b) == 1 or len(b) * len(b[0]) <= 120 for b in seen) and by.tokens == sum(min(100, len(x or "")) for x in texts)
    plain = 0  # filled up in the order of arrival, two at a time
    for k in range(0, len(texts), 2):
        sizes = [min(100, len(x or "")) for x in texts[k : k + 2]]
        plain += sum(max(sizes) - n for n in sizes)
    assert by.padded < plain / 4 and by([]) == []


def test_long_texts_are_scored_as_short_ones(spark):
    rows = [(1, "a b b c.", ["b b", "A, b b c"]), (2, None, ["x"]), (3, "x", []), (4, "", [""]), (5, "x y", [None, "y"]), (6, "x", None), (7, "שָׁלוֹם a", ["שלום A", "q"])]
    frame = spark.createDataFrame(rows, "id long, prediction string, answers array<string>")
    want = {r.id: (r.em, r.f1) for r in delta.scored(frame.filter("answers is not null"), HEBREW).collect()} | {6: (0, 0.0)}
    assert {r.id: (r.em, r.f1) for r in delta.scored_long(frame, "id", HEBREW).collect()} == want


def test_normalised_texts_are_the_tokens_joined(spark):
    texts = [None, "", " ", "A, b؛ في من  x", "في", "في في من", "xفي في_ في", "İstanbul, ÀÉ", "a_b-c 1٢", "من\nx\tفي"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for d in (HEBREW, ARABIC):
        for r in frame.select(tx.normalise(F.col("t"), d).alias("a"), F.array_join(tx.tokens(F.col("t"), d), " ").alias("b"), "t").collect():
            assert r.a == r.b, (d.name, r.t)


def test_reordering_is_cut_by_bytes(spark, monkeypatch):
    words = ["بَتُ", None, "", "x َ", "بَ تُ" * 50] * 30
    held = pa.array(words, pa.string())
    whole = tx._reordered(held)
    monkeypatch.setattr(tx, "PART_BYTES", 100)
    assert len(list(tx._parts(held))) > 20 and pa.chunked_array([tx._reordered(p) for p in tx._parts(held)]).combine_chunks().equals(whole)
    assert list(tx._parts(held.slice(0, 0))) == []


def test_a_setting_is_put_back_by_the_last_writer(spark):
    import threading

    before, inside, go = spark.conf.get(storage._CLEANUP, "false"), threading.Barrier(2), threading.Event()

    def write():
        with storage._without_leftovers(spark):
            inside.wait(10)
            go.wait(10)

    threads = [threading.Thread(target=write) for _ in range(2)]
    for t in threads:
        t.start()
    while len(storage._WRITING) == 0 or storage._WRITING[spark][0] < 2:
        pass
    assert spark.conf.get(storage._CLEANUP) == "true"
    go.set()
    for t in threads:
        t.join()
    assert spark.conf.get(storage._CLEANUP, "false") == before and not storage._WRITING
