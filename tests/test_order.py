"""The last line wins: order and numbers of lines in files that are read in many splits."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from pairlens import report, storage
from pairlens.functions import text as tx
from pairlens.functions.dialect import ARABIC, HEBREW
from pairlens.functions.score import last_of_each
from pairlens.operators import agreement, delta, fragmentation, judging
from pairlens.sources import ingest


@pytest.fixture
def small_splits(spark):
    for name, value in (("spark.sql.files.maxPartitionBytes", "700"), ("spark.sql.files.openCostInBytes", "1")):
        spark.conf.set(name, value)
    yield spark
    for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(name)


def test_lines_have_their_numbers(small_splits, tmp_path):
    rng, want = random.Random(1), set()
    for name, n in (("a.jsonl", 400), ("b.jsonl", 1), ("c.jsonl", 0), ("d.jsonl", 150)):
        lines = ["" if rng.random() < 0.1 else f"{name} {k} " + "x" * rng.randint(0, 60) for k in range(n)]
        (tmp_path / name).write_text("".join(f"{x}\n" for x in lines))
        want |= {(name, k, x) for k, x in enumerate(lines)}
    rows = ingest.read_lines(small_splits, f"file://{tmp_path}")
    assert {(r.file, r.line, r.value) for r in rows.collect()} == want
    assert small_splits.read.text(f"file://{tmp_path}").rdd.getNumPartitions() > 10


@pytest.mark.parametrize("n", [0, 1, 2000])
def test_documents_are_read_in_splits(small_splits, tmp_path, n):
    """No task reads a whole document; what isn't a row of its array is there once, as it was written."""
    rows = small_splits.range(n).select("id", F.concat(F.lit('{"a",\n  '), F.repeat(F.lit("é"), 40)).alias("t"), F.lit(None).cast("int").alias("x")).repartition(3)
    head = {"model": "m {", "aggregate": [{"source": "a", "n": n}, {"source": None, "n": None}]}
    for name in ("one", "two"):
        report.write_document(small_splits, f"file://{tmp_path}/{name}.json", head, "per_example", rows)
    heads, found = ingest.read_document(small_splits, f"file://{tmp_path}/*.json", "model string, aggregate array<struct<source:string,n:long>>", "per_example", "id long, t string, x int")
    paths = {f"file://{tmp_path}/{name}.json" for name in ("one", "two")}
    assert {r.path.replace("file:///", "file:/").replace("file:/", "file:///") for r in heads.collect()} == paths
    assert [(r.model, [tuple(a) for a in r.aggregate]) for r in heads.collect()] == [("m {", [("a", n), (None, None)])] * 2
    assert sorted((r.id, r.t, r.x) for r in found.collect()) == sorted([(k, '{"a",\n  ' + "é" * 40, None) for k in range(n)] * 2)
    assert n < 2000 or found.rdd.getNumPartitions() > 10
    (tmp_path / "torn.json").write_text('{\n  "per_example": [\n{"id": 1\n  ]\n}\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        ingest.read_document(small_splits, f"file://{tmp_path}/torn.json", "model string", "per_example", "id long")[1].collect()


def test_one_file_of_sorted_lines_from_many_tasks(small_splits, tmp_path):
    keys = list(range(1000))
    random.Random(3).shuffle(keys)
    lines = small_splits.createDataFrame([(k, f"é{k}\n") for k in keys], "k long, value string").repartition(5)
    since, before = storage.mark(), small_splits.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    small_splits.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        report.write_lines(lines, f"file://{tmp_path}/part", "k")
    finally:
        small_splits.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    parts = storage._MADE.paths[-1].removeprefix("file://")
    assert len(storage._MADE.paths) == since + 1 and len([x for x in os.listdir(parts) if x.startswith("part-")]) > 2
    assert (tmp_path / "part").read_text() == "".join(f"é{k}\n\n" for k in range(1000))
    rows = ingest.read_lines(small_splits, f"file://{tmp_path}/part").filter("value <> ''")
    assert sorted((r.file, r.line, r.value) for r in rows.collect()) == sorted(("part", 2 * k, f"é{k}") for k in range(1000))


def test_the_last_line_counts(small_splits, tmp_path):
    rng, last = random.Random(2), {}
    for name in ("a_eval.jsonl", "b_eval.jsonl", "c_eval.jsonl"):
        lines = []
        for k in range(300):
            one = rng.randrange(200)
            last[str(one)] = f"{name}{k}"
            lines.append(json.dumps({"id": str(one), "v": f"{name}{k}"}))
            if rng.random() < 0.1:
                lines.append("torn {")
        (tmp_path / name).write_text("\n".join(lines))
    rows = ingest.read_directory(small_splits, f"file://{tmp_path}", "id string, v string")
    assert {r.id: r.v for r in last_of_each(rows, ["id"], "ord").collect()} == last
    rows = ingest.read_jsonl(small_splits, f"file://{tmp_path}", "id string, v string")
    assert {r.id: r.v for r in last_of_each(rows, ["id"], "ord").collect()} == last


def test_the_later_quality_counts(spark):
    pairs = spark.createDataFrame([("1", "s", 1, 0, 1.0, 0.0), ("2", "s", 0, 0, 0.0, 0.0), ("3", "s", 1, 1, 1.0, 1.0)], "id string, source string, base_em int, treated_em int, base_f1 double, treated_f1 double")
    quality = spark.createDataFrame([("1", "good", 1), ("1", "good", 2), ("2", "good", 1), ("2", "bad", 2), ("3", "bad", 1), ("3", "gold", 2)], "id string, quality string, line int")
    got = delta.filtered_delta(pairs, quality, ["good", "gold"], "line").first()
    assert (got.n, got.base_em_hits, got.treated_em_hits, got.hurt) == (2, 2, 1, 1)


def test_raters(spark):
    human = spark.createDataFrame([("1", "INCORRECT", 1), (" 1 ", "correct\t", 2), ("1", " ", 3), ("2", "CORRECT", 1), ("2", "maybe", 2), ("3.0", "CORRECT", 1), ("4_dup", "CORRECT", 1), ("5", "\n", 1)], "pilot_id string, human_label string, line int")
    judge = spark.createDataFrame([("1", "CORRECT"), ("1", "INCORRECT"), ("2", "CORRECT"), ("3", "CORRECT"), ("4_dup", "CORRECT"), ("5", "CORRECT"), ("1", " correct")], "pilot_id string, judge_label string")
    assert sorted((r.pilot_id, r.human, r.judge) for r in agreement.paired_raters(human, judge, "line").collect()) == [(1, "CORRECT", "CORRECT"), (1, "CORRECT", "INCORRECT")]


def test_the_last_valid_judgment_counts(spark):
    rows = [("a", "plain", "CORRECT", 1), ("a", "plain", "INCORRECT", 2), ("a", "plain", "ERROR", 3), ("a", "marked", "CORRECT", 1)]
    df = spark.createDataFrame([("m", "s", i, "b", c, x, n) for i, c, x, n in rows], "model string, source string, example_id string, answer_length_bucket string, condition string, judge_label string, line int")
    assert [(r.plain, r.marked) for r in judging.paired_labels(df, "plain", "marked", "line").collect()] == [(0, 1)]


def test_labels_and_readings(spark):
    replies = ['{"label": "CORRECT\\n"}', '{"label": "\\u2003incorrect\\t"}', '{"label": "x"}', "torn", None]
    got = [r.x for r in spark.createDataFrame([(r,) for r in replies], "r string").select(tx.parse_label(F.col("r")).alias("x")).collect()]
    assert got == ["CORRECT", "INCORRECT", "ERROR", "ERROR", "ERROR"]
    ks = spark.createDataFrame([(0.8,), (0.6,), (0.4,), (0.39,), (-1.0,)], "k double")
    assert [r.x for r in ks.select(agreement.kappa_band(F.col("k")).alias("x")).collect()] == ["almost perfect", "substantial", "moderate", "poor", "poor"]
    rs = spark.createDataFrame([(-0.6,), (-0.5,), (-0.3,), (-0.2,), (0.1,), (0.2,), (None,)], "r double")
    assert [r.x for r in rs.select(fragmentation.interpretation(F.col("r")).alias("x")).collect()] == ["Strong negative", "Moderate negative", "Moderate negative", "Positive", "None", "Positive", "Undefined"]


def test_what_comes_first_of_case_and_punctuation(spark):
    df = spark.createDataFrame([("İstanbul في X",)], "t string")
    assert df.select(tx.tokens(F.col("t"), ARABIC).alias("t")).first().t == ["i̇stanbul", "x"]
    assert df.select(tx.tokens(F.col("t"), HEBREW).alias("t")).first().t == ["i", "stanbul", "في", "x"]
