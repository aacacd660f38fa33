import json

from pyspark.sql import functions as F

from pairlens import providers, report
from pairlens.functions.dialect import ARABIC, HEBREW
from pairlens.operators import agreement, delta, fragmentation, judging, sampling
from pairlens.sources import ingest
from pairlens.streaming import ledger

# fixed values: published transition blocks (cc, ci, ic, ii), plain and marked percentages and their difference
BLOCKS = {
    ("qwen", "arcd"): (411, 44, 14, 31, 91.0, 85.0, -6.0),
    ("qwen", "tydiqa"): (461, 66, 23, 50, 87.83, 80.67, -7.16),
    ("qwen", "mkqa"): (11, 28, 7, 354, 9.75, 4.5, -5.25),
}
# fixed values: published token ratios and F1 differences
POINTS = [(893675 / 318400, -5.76), (196699 / 73627, -0.87), (9132223 / 3368458, -6.16), (761936 / 291327, -6.51), (166276 / 65443, -4.29), (7847524 / 3088813, -6.37), (1152762 / 742369, -8.5), (257669 / 168534, -0.62), (11658785 / 7537422, -8.15)]


def test_transitions_reproduce_published_blocks(spark):
    rows = []
    for (m, s), (cc, ci, ic, ii, *_) in BLOCKS.items():
        for k, (a, b) in enumerate([("CORRECT", "CORRECT")] * cc + [("CORRECT", "INCORRECT")] * ci + [("INCORRECT", "CORRECT")] * ic + [("INCORRECT", "INCORRECT")] * ii):
            rows += [(m, s, str(k), "b", "plain", a), (m, s, str(k), "b", "marked", b)]
    df = spark.createDataFrame(rows, "model string, source string, example_id string, answer_length_bucket string, condition string, judge_label string")
    got = judging.transitions(judging.paired_labels(df.withColumn("ord", F.lit(0)), "plain", "marked", "ord"), [("model", "source"), ("model",), ()]).collect()
    by = {(r.level, r.source): report.judge_block(r.asDict()) for r in got}
    for (_, s), (_, ci, ic, _, plain, marked, d) in BLOCKS.items():
        b = by["model+source", s]
        assert (b["plain"], b["marked"], b["delta"], b["net_churn"]) == (plain, marked, d, ci - ic)
    assert by["model", None]["n"] == 1500 and by["model", None]["delta"] == -6.27


def raters(spark):
    rows = [("CORRECT", "CORRECT")] * 45 + [("CORRECT", "INCORRECT")] * 3 + [("INCORRECT", "CORRECT")] * 2 + [("INCORRECT", "INCORRECT")] * 34
    return spark.createDataFrame(rows, "human string, judge string")


def test_kappa_and_classes(spark):
    k = agreement.kappa(raters(spark)).first()
    assert round(k.kappa, 3) == 0.879 and round(k.agree / k.n * 100, 1) == 94.0
    c = {r.label: tuple(round(x, 3) for x in (r.precision, r.recall, r.f1)) for r in agreement.per_class(raters(spark)).collect()}
    assert c == {"CORRECT": (0.957, 0.938, 0.947), "INCORRECT": (0.919, 0.944, 0.932)}
    assert agreement.kappa(raters(spark).limit(0)).first().kappa == 0


def test_pearson(spark):
    df = spark.createDataFrame(POINTS, "x double, y double")
    assert round(fragmentation.pearson(df, "x", "y").first().r, 4) == 0.1263
    assert fragmentation.pearson(df.withColumn("y", F.lit(1.0)), "x", "y").first().r is None
    assert fragmentation.pearson(df.limit(1), "x", "y").first().r is None
    assert spark.range(1).select(fragmentation.interpretation(F.lit(-0.2))).first()[0] == "Positive"


def test_last_row_of_an_id_wins(spark):
    df = spark.createDataFrame([("a", "s", 1, 0, 0.0, "p"), ("a", "s", 2, 1, 1.0, "p"), ("b", "s", 3, 0, 0.5, "p")], "id string, source string, ord int, em int, f1 double, prediction string")
    pairs = delta.paired(df, df, "ord").collect()
    assert sorted((r.id, r.base_em) for r in pairs) == [("a", 1), ("b", 0)]


def test_samples_keep_their_quotas(spark):
    rows = spark.range(600).select(F.col("id"), F.col("id").alias("ord"), F.concat(F.lit("q"), (F.col("id") % 500).cast("string")).alias("question"), F.when(F.col("id") < 300, "a").otherwise("b").alias("source"), (F.col("id") % 3).cast("string").alias("bucket"))
    got = sampling.sample_sources(rows, {"a": 50, "b": 70}).collect()
    assert [sum(r.source == s for r in got) for s in "ab"] == [50, 70] and len({r.question for r in got}) == 120
    cells = rows.withColumn("f1_level", F.element_at(F.array(F.lit("high"), F.lit("mid"), F.lit("low")), (F.col("id") % 3 + 1).cast("int")))
    cell = sampling.cell_sample(cells, HEBREW.pilot_cell, HEBREW.pilot_levels, ["source"]).groupBy("source", "f1_level").count().collect()
    assert sorted((r.source, r.f1_level, r["count"]) for r in cell if r.source == "a") == [("a", "high", 3), ("a", "low", 3), ("a", "mid", 1)]


def test_ingest(spark, tmp_path):
    raw = [{"ID": "1", "Context": "c", "Question": "שָׁלוֹם", "Is_Impossible": None, "Question_Quality": "good", "Answers": "{'text': ['x'], 'answer_start': [3]}"}, {"ID": "2", "Question": "q", "Is_Impossible": True, "Answers": "{'text': ['x'], 'answer_start': [1]}"}, {"ID": "3", "Question": "q", "Answers": "{'text': [], 'answer_start': []}"}]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, raw)) + "\nnot json\n")
    got = ingest.heq(ingest.read_jsonl(spark, f"file://{tmp_path}/a.jsonl", ingest.HEQ), HEBREW).collect()
    assert [(r.id, r.question, r.answers, r.answer_start) for r in got] == [("heq_1", "שלום", ["x"], [3])]
    mk = [{"example_id": "7", "queries": {"he": "q"}, "answers": {"he": [{"type": "entity", "text": "", "aliases": ["z"]}, {"type": "number_with_unit", "text": "5 m", "aliases": []}]}}]
    (tmp_path / "m.jsonl").write_text("\n".join(map(json.dumps, mk)))
    rows = ingest.read_jsonl(spark, f"file://{tmp_path}/m.jsonl", ingest.MKQA)
    assert ingest.mkqa(rows, HEBREW, "he").first().answers == ["z"] and ingest.mkqa(rows, ARABIC, "he").first().answers == ["z", "5 m"]


def test_ledger_and_stream(spark, tmp_path):
    led = spark.createDataFrame([(1, 1, "ERROR"), (1, 2, "CORRECT"), (2, 1, "ERROR")], "row_id int, t int, judge_label string")
    rows = spark.createDataFrame([(1,), (2,), (3,)], "row_id int")
    assert sorted(r.row_id for r in ledger.pending(rows, led, done=ledger.valid_label()).collect()) == [2, 3]
    assert [r.row_id for r in ledger.pending(rows, led).collect()] == [3]
    assert {r.row_id: r.judge_label for r in ledger.latest(led, "row_id", "t").collect()} == {1: "CORRECT", 2: "ERROR"}
    src = tmp_path / "in"
    led.write.json(str(src))
    for _ in range(2):
        ledger.run_stream(spark, str(src), "row_id int, judge_label string", str(tmp_path / "out"), str(tmp_path / "at"), lambda b: b.filter(ledger.valid_label())).awaitTermination()
    assert [r.row_id for r in ledger.read_ledger(spark, str(tmp_path / "out")).collect()] == [1]


def test_providers_retry(spark):
    calls = []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert providers.Retrying(flaky, workers=1, wait=lambda k: 0)(["a"]) == ["ok"]
    assert providers.Retrying(lambda x: 1 / 0, wait=lambda k: 0)(["a"]) == ['{"label": "ERROR"}']
    out = providers.apply(spark.createDataFrame([("a b c",)], "t string"), lambda: providers.Echo(2), "t", "p").first()
    assert out.p == "a b"


def test_quotas_never_share_out_more_than_there_is(spark):
    """Against a plain loop over the buckets, with pools whose shares round up."""
    import random

    def loop(pools, size):
        if sum(pools) <= size:
            return pools
        left, out = size, []
        for k, pool in enumerate(pools):
            target = left if k == len(pools) - 1 else min(round(size * pool / sum(pools)), pool)
            out.append(min(target, left, pool))
            left -= out[-1]
        return out

    rng = random.Random(0)
    cases = [([3, 3, 3, 1], 5), ([1, 2], 3), ([5], 3), ([1] * 9, 4), ([7, 1, 1, 1, 1, 1], 6)] + [([rng.randint(1, 6) for _ in range(rng.randint(1, 8))], rng.randint(0, 25)) for _ in range(6)]
    for pools, size in cases:
        buckets = [f"b{(7 * k) % 10}" for k in range(len(pools))]
        rows, at = [], 0
        for b, n in zip(buckets, pools, strict=True):
            rows += [(at + k, at + k, b) for k in range(n)]
            at += n
        df = spark.createDataFrame(rows, "id long, ord long, bucket string")
        got = {r.bucket: r.quota for r in sampling.proportional_quotas(df, size).collect()}
        assert [got[b] for b in buckets] == loop(pools, size), (pools, size)
        held = {r.bucket: r["count"] for r in sampling.proportional_sample(df, size).groupBy("bucket").count().collect()}
        assert sum(held.values()) == min(size, sum(pools)) and all(held.get(b, 0) >= got[b] for b in buckets)
