"""Published figures, raw readers at their edges, numbering, stages that resume, and stored tables."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairlens import providers, report, storage
from pairlens.functions import text as tx
from pairlens.functions.dialect import HEBREW
from pairlens.operators import agreement, delta, judging, sampling
from pairlens.sources import ingest
from pairlens.streaming import ledger

# fixed values: published transition blocks (cc, ci, ic, ii) with plain and marked percentages, their difference and net churn
BLOCKS = {
    ("qwen", "heq"): (69, 49, 70, 412, 19.67, 23.17, 3.5, -21), ("qwen", "parashoot"): (290, 122, 33, 55, 82.4, 64.6, -17.8, 89), ("qwen", "mkqa"): (4, 22, 5, 369, 6.5, 2.25, -4.25, 17),
    ("dictalm", "heq"): (161, 72, 79, 288, 38.83, 40.0, 1.17, -7), ("dictalm", "parashoot"): (346, 98, 15, 41, 88.8, 72.2, -16.6, 83), ("dictalm", "mkqa"): (38, 64, 6, 292, 25.5, 11.0, -14.5, 58),
}
# fixed values: the published disagreements
DIFFER = [("parashoot", "with_niqud", "INCORRECT", "CORRECT"), ("mkqa", "with_niqud", "CORRECT", "INCORRECT"), ("heq", "no_niqud", "CORRECT", "INCORRECT"), ("mkqa", "with_niqud", "INCORRECT", "CORRECT"), ("heq", "with_niqud", "CORRECT", "INCORRECT")]


def test_published_blocks(spark):
    rows = []
    for (m, s), (cc, ci, ic, ii, *_) in BLOCKS.items():
        labels = [("CORRECT", "CORRECT")] * cc + [("CORRECT", "INCORRECT")] * ci + [("INCORRECT", "CORRECT")] * ic + [("INCORRECT", "INCORRECT")] * ii
        rows += [(m, s, str(k), "b", c, x) for k, pair in enumerate(labels) for c, x in zip(("plain", "marked"), pair, strict=True)]
    df = spark.createDataFrame(rows, "model string, source string, example_id string, answer_length_bucket string, condition string, judge_label string")
    got = {(r.model, r.source): report.judge_block(r.asDict()) for r in judging.transitions(judging.paired_labels(df.withColumn("ord", F.lit(0)), "plain", "marked", "ord"), [("model", "source"), ("model",)]).collect()}
    for key, (*_, plain, marked, d, churn) in BLOCKS.items():
        b = got[key]
        assert (b["plain"], b["marked"], b["delta"], b["net_churn"]) == (plain, marked, d, churn)
    assert (got["qwen", None]["plain"], got["qwen", None]["marked"], got["qwen", None]["delta"]) == (37.07, 31.4, -5.67)


def test_published_disagreements(spark):
    rows = spark.createDataFrame([(str(k), *x) for k, x in enumerate(DIFFER)] + [("9", "heq", "no_niqud", "CORRECT", "CORRECT")], "pilot_id string, source string, condition string, human string, judge string")
    got = {(r.dimension, r.value): r.n for r in agreement.disagreements(rows, ["source", "condition"]).collect()}
    assert got == {
        ("source", "parashoot"): 1, ("source", "mkqa"): 2, ("source", "heq"): 2, ("condition", "with_niqud"): 4, ("condition", "no_niqud"): 1,
        ("direction", "human=INCORRECT -> judge=CORRECT"): 2, ("direction", "human=CORRECT -> judge=INCORRECT"): 3, ("total", "all"): 5,
    }
    examples = agreement.disagreement_examples(rows)
    assert examples.count() == 5 and examples.columns == list(agreement.EXAMPLE) and examples.first().f1 is None


def test_published_consistency(spark):
    rows = sampling.with_duplicates(spark.range(40).select(F.col("id").alias("pilot_id")), 15).withColumn("judge_label", F.lit("CORRECT"))
    assert tuple(agreement.consistency(rows).first()) == (15, 15, 0)


def test_published_predictions(spark):
    rows = [("20,000 עותקים כדי לקבל מעמד של אלבום זהב.", ["20,000"]), ("20,000", ["20,000"]), ("Boston Consulting Group הציתה את מהפכת המחשוב הקוונטי.", ["Boston Consulting Group"])]
    got = delta.scored(spark.createDataFrame(rows, "prediction string, answers array<string>"), HEBREW).collect()
    assert [(r.em, round(r.f1, 2)) for r in got] == [(0, 0.36), (1, 1.0), (0, 0.55)]


def test_answers_in_python_literals(spark):
    texts = ["{'text': ['it\\'s', \"a 'b'\"], 'answer_start': [1, 2]}", "{'text': ['caf\\xe9', None], 'answer_start': []}", '{"text": ["x"], "answer_start": ["3"]}', "nonsense"]
    got = [r.a for r in spark.createDataFrame([(t,) for t in texts], "t string").select(ingest.parse_answers(F.col("t")).alias("a")).collect()]
    assert [x and list(x.text) for x in got[:3]] == [["it's", "a 'b'"], ["café", None], ["x"]]
    assert got[3] is None or got[3].text is None


def test_empty_directories_are_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        ingest.read_directory(spark, f"file://{tmp_path}", "id string")
    with pytest.raises(FileNotFoundError):
        ingest.read_splits(spark, {"train": f"file://{tmp_path}/none"})
    (tmp_path / "b_eval.jsonl").write_text('{"id": "1"}\ntorn {\n')
    (tmp_path / "a.jsonl").write_text('{"id": "2"}\n\n')
    got = ingest.read_directory(spark, f"file://{tmp_path}", "id string").collect()
    assert sorted((r.id, r.file, r.source) for r in got) == [("1", "b_eval.jsonl", "b"), ("2", "a.jsonl", "a")]


def test_human_sheet_with_lines_in_cells(spark, tmp_path):
    (tmp_path / "s.csv").write_text('pilot_id,question,context,gold_answers,prediction,human_label,human_notes\n1,"two\nlines, ""quoted""",,a | b,p, correct ,\nx,q,,g,p,CORRECT,\n2,q,,g,p,,n\n')
    got = ingest.read_human_labels(spark, f"file://{tmp_path}/s.csv").orderBy("pilot_id").collect()
    assert [(r.pilot_id, r.question, r.human_notes) for r in got] == [(1, 'two\nlines, "quoted"', None), (2, "q", "n")]


def test_numbers_follow_the_order_across_ranges(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("a"), F.xxhash64("id").alias("h")).repartition(6)
    got = sampling.numbered(rows, "n", "a", "h").collect()
    assert [r.n for r in sorted(got, key=lambda r: (r.a, r.h))] == list(range(1, 1001))
    assert sampling.numbered(rows.limit(0), "n", "a").count() == 0


def test_caps_and_samples_at_their_edges(spark):
    rows = spark.range(20).select("id", (F.col("id") % 3).cast("string").alias("source"), F.lit("x").alias("bucket"), F.col("id").alias("ord"))
    assert sampling.stratified_cap(rows, 20).count() == 20 and sampling.stratified_cap(rows, 7).count() == 6
    assert sampling.stratified_cap(rows.limit(0), 5).count() == 0
    assert sampling.proportional_sample(rows, 50).count() == 20 and sampling.proportional_sample(rows, 0).count() == 0


def test_a_stage_resumes(spark, tmp_path):
    out, rows, seen = f"file://{tmp_path}/ledger", spark.range(6), []

    def step(todo):
        seen.append(sorted(r.id for r in todo.collect()))
        return todo.select("id", F.when(F.col("id") == 3, "ERROR").otherwise("CORRECT").alias("judge_label"))

    ready = spark.createDataFrame([(100, "INCORRECT")], "id long, judge_label string")
    ledger.resume(rows.filter("id < 4"), out, step, done=ledger.valid_label(), ready=ready)
    assert ledger.resume(rows, out, step, done=ledger.valid_label(), ready=ready).count() == 8
    assert seen == [[0, 1, 2, 3], [3, 4, 5]]
    assert ledger.read_ledger(spark, f"{out}-none", "id long").count() == 0


def test_chunks_go_through_a_provider(spark):
    rows = spark.createDataFrame([(1, "aa. " * 30, "k"), (2, None, "k"), (3, "", "k")], "id long, text string, chunks string")
    got = {r.id: r for r in providers.apply_chunks(rows, lambda: providers.Marker("*"), "text", 20).collect()}
    assert got[1].text.replace(" ", "") == "a*a*." * 30 and got[2].text is None and got[3].text == "" and got[1].chunks == "k"


def test_a_reordering_is_checked(spark):
    words = ["بَتُ", "پَب", None, "", "x َ", "بَ تُ"]
    got = [r.m for r in spark.createDataFrame([(w,) for w in words], "t string").select(tx.checked_reorder(F.col("t")).alias("m")).collect()]
    assert got == ["بتَُ", "پبَ", None, "", "x َ", "بَ تُ"]


def test_a_wrong_reordering_is_an_error(monkeypatch):
    """Checked where characters are moved, within each text: none may change, go or come to another text."""
    words = pa.array(["بَتُ", None, "ab", "ba"])
    check = tx.checked_reorder.func
    assert check(words).to_pylist() == ["بتَُ", None, "ab", "ba"]
    for wrong in (["بتَُ", None, "ab", "bb"], ["بتَُ", None, "aba", "b"], ["بتَ", None, "ab", "ba"]):
        monkeypatch.setattr(tx, "_reordered", lambda part, wrong=wrong: pa.array(wrong))
        with pytest.raises(ValueError, match="not reordered"):
            check(words)


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("b", 2, 1, 1.5), ("overall", 3, 2, 2.5), ("z", 1, 1, 1.0)], "source string, n long, em_hits long, f1_sum double")
    assert [r.source for r in report.ordered(rows).collect()] == ["b", "z", "overall"]
    report.write_json(report.ordered(rows), f"file://{tmp_path}/r/report.json")
    assert (tmp_path / "r" / "report.json").read_text().startswith("[\n  {\n    \"source\": \"b\"")
    assert report.progress(500, 1000, 3, 3600.0) == {"done": 500, "total": 1000, "percent": 50.0, "errors": 3, "cost": 0.1, "eta_hours": 1.0}
    assert report.progress(0, 0, 0, 0.0)["eta_hours"] == 0.0
    block = report.delta_block({"n": 3, "base_em_hits": 1, "treated_em_hits": 2, "base_f1_sum": 1.5, "treated_f1_sum": 2.0, "delta_f1_sum": 0.5, "helped": 1, "hurt": 0})
    assert (block["base_em"], block["delta_em"], block["delta_f1"]) == (33.33, 33.33, 16.67)


def test_stored_tables_are_released(spark):
    at = storage.mark()
    a, b = storage.stored(spark.range(3), "a"), storage.stored(spark.range(4), "b")
    storage.release(spark, at, b)
    assert b.count() == 4 and storage.mark() == at + 1
    with pytest.raises(Exception):  # noqa: B017  the table is gone
        spark.read.parquet(a._stored_at).count()
    storage.release(spark, at)
    assert storage.mark() == at


def test_a_release_leaves_the_tables_of_other_threads(spark):
    import threading

    at, other = storage.mark(), []
    thread = threading.Thread(target=lambda: other.append(storage.stored(spark.range(5), "other")))
    thread.start()
    thread.join()
    storage.release(spark, at)
    assert other[0].count() == 5


def test_unused_names():
    assert storage.unused(["a"], "a") == "_a" and storage.unused(["_A", "_a_1"], "a") == "_a_2"


def test_the_oracles_of_a_few_queries_agree(spark, tmp_path):
    """Edge rows that the tables lack: null and empty texts."""
    duckdb = pytest.importorskip("duckdb")
    from pairlens import catalogue

    rows = [(1, None, "en", "src0", 0), (2, "", "fr", "src1", 0), (3, "é a. b! " * 90, "en", "src0", 720), (6, "dé bad. " * 3, "de", "src1", 24)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("delta_by_source", "per_example_delta", "chunk_pack", "ingest_heq", "ingest_mkqa", "resumable_marking", "reordered_overlay", "mirrored_directory"):
        df = catalogue.QUERIES[name](spark, f"file://{tmp_path}")
        cols = sorted(df.columns)
        want = con.execute(f"SELECT {', '.join(cols)} FROM ({catalogue.SQL[name]})").fetchall()
        assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in df.select(*cols).collect()), name
