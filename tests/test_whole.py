"""Queries over whole texts against brute force: what stands late in a long text counts."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pairlens import catalogue
from pairlens.functions import score
from pairlens.plans.fixtures import BARE, MARKED

LONG = ["w%d" % (k % 700) for k in range(3000)]
TEXTS = {
    1: "one two, Three", 2: " ".join([*LONG, "café", "él"]), 3: " ".join(["é é e"] + LONG[:50] + ["ñandú"]), 4: "", 5: None, 6: "a b c d e f g",
    7: "a b c d e f g h ñ ñ n", 8: "- !", 9: " ".join(LONG),
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("whole"))
    rows = [(d, t, "en" if d % 2 else "fr", "s", len(t or "")) for d, t in TEXTS.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(2, 1, 0), (3, 0, 0), (7, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def words(text):
    return "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()


def f1(p, g):
    c = sum((Counter(p) & Counter(g)).values())
    return round(2 * c / (len(p) + len(g)), 4) if c else 0.0


def brute():
    out = {}
    for d, t in TEXTS.items():
        w = words(t)
        plain = [x.translate(str.maketrans(MARKED, BARE)) for x in w]
        gold, other = (plain, w) if d % 2 == 0 else (w, plain)
        treated = [*w, "x"] if d % 3 == 0 else w
        out[d] = {
            "base_em": int(plain == gold), "treated_em": int(treated == gold), "base_f1": f1(plain, gold), "treated_f1": f1(treated, gold), "em2": int(treated in (gold, other)),
            "f12": max(f1(plain, gold), f1(plain, other)), "gold": gold, "base": plain, "treated": treated,
        }
    return out


def test_scores_of_whole_texts(spark, tables):
    want, run = brute(), lambda name: catalogue.QUERIES[name](spark, tables).collect()
    cols = ("base_em", "treated_em", "base_f1", "treated_f1")
    for name, of in (("per_example_delta", want), ("paired_join", [d for d in want if d % 7])):
        got = {r.id: r for r in run(name)}
        assert {d: tuple(r[c] for c in cols) for d, r in got.items()} == {d: tuple(want[d][c] for c in cols) for d in of}
    assert got[3].delta_em == 0 and got[2].delta_em == -1 and 0 > got[2].delta_f1 > -0.001
    assert {r.id: r.em for r in run("exact_match_multi_gold")} == {d: x["em2"] for d, x in want.items()}
    assert {r.id: r.f1 for r in run("token_f1_multi_gold")} == {d: x["f12"] for d, x in want.items()}
    assert {r.id: r.f1 for r in run("token_f1_exploded")} == {d: x["treated_f1"] for d, x in want.items()}
    assert {r.id: r.level for r in run("f1_bucket")} == {d: "high" if x["treated_f1"] >= 0.8 else "mid" if x["treated_f1"] >= 0.2 else "low" for d, x in want.items()}


def test_sums_of_whole_texts(spark, tables):
    want, run = brute(), lambda name: catalogue.QUERIES[name](spark, tables).collect()
    of = lambda source: [d for d in want if source == "overall" or (d % 2 == 1) == (source == "en")]
    total = lambda c, ds: pytest.approx(sum(want[d][c] for d in ds))
    for r in run("delta_by_source"):
        ds = of(r.source)
        helped = [want[d]["treated_em"] - want[d]["base_em"] for d in ds]
        assert (r.n, r.base_em_hits, r.treated_em_hits, r.helped, r.hurt) == (len(ds), sum(want[d]["base_em"] for d in ds), sum(want[d]["treated_em"] for d in ds), helped.count(1), helped.count(-1))
        assert r.treated_f1_sum == total("treated_f1", ds) and r.base_f1_sum == total("base_f1", ds)
    for name in ("score_by_source", "score_by_source_with_len"):
        r = next(r for r in run(name) if r.source == "overall")
        assert (r.n, r.em_hits) == (len(want), sum(x["base_em"] for x in want.values())) and r.f1_sum == total("base_f1", want)
    assert r.pred_len_sum == sum(len(x["base"]) for x in want.values())
    for r in run("churn_and_verbosity"):
        ds = of(r.source)
        assert (r.churn, r.delta_len) == (sum(want[d]["treated_em"] != want[d]["base_em"] for d in ds), sum(len(want[d]["treated"]) - len(want[d]["base"]) for d in ds))
        assert r.treated_len_mean == pytest.approx(sum(len(want[d]["treated"]) for d in ds) / len(ds))
    r = run("filtered_delta")[0]
    assert r.n == 2 and r.treated_f1_sum == total("treated_f1", (2, 7))


def test_answers_and_judge_inputs_of_whole_texts(spark, tables):
    want, run = brute(), lambda name: catalogue.QUERIES[name](spark, tables).collect()
    flat = {r.id: r.flat for r in run("answers_flatten")}
    assert flat[2] == hashlib.md5("|".join(["fr", *want[2]["gold"]]).encode()).hexdigest() and flat[3] == hashlib.md5(b"").hexdigest()
    rows = run("judge_input_expand")
    assert len(rows) == 4 * len(TEXTS) and sorted(r.row_id for r in rows) == list(range(1, len(rows) + 1))
    assert [r.row_id for r in sorted(rows, key=lambda r: (r.model, r.condition, r.example_id % 2 == 0, r.example_id))] == list(range(1, len(rows) + 1))


def test_f1_of_near_and_far_pairs(spark):
    """Edited copies, words in another order, pairs with many words in common beyond the places they share, and empty sides."""
    rng, rows = random.Random(5), [(0, [], []), (1, ["a"], []), (2, [], ["a"]), (3, None, ["a"]), (4, ["a"], None), (5, None, None)]
    for k in range(6, 120):
        p = [f"w{rng.randrange(rng.choice([3, 50, 2000]))}" for _ in range(rng.choice([1, 5, 300]))]
        g = [t if rng.random() < 0.9 else "x" for t in p] if k % 3 == 0 else rng.sample(p, len(p)) if k % 3 == 1 else p[rng.randrange(3) :] + ["y", "y"]
        rows.append((k, p, g))
    frame = spark.createDataFrame(rows, "id long, p array<string>, g array<string>").repartition(3)
    far = 0
    for r in score.bag_f1(frame, "id", {"a": ("p", "g"), "b": ("g", "p"), "c": ("p", "p")}, (F.size("p").alias("n"),)).collect():
        _, p, g = rows[r.id]
        same = (Counter(p or []) & Counter(g or [])).total()
        left = [(x, y) for x, y in zip(p or [], g or []) if x != y], (p or [])[len(g or []) :], (g or [])[len(p or []) :]
        far += len({x for x, _ in left[0]} & {y for _, y in left[0]}) > score.MANY
        want = round(2 * same / (len(p) + len(g)), 4) if same else 0.0
        assert (r.n, r.a, r.b, r.c) == (None if p is None else len(p), want, want, 1.0 if p else 0.0), r
    assert far > 5


@pytest.mark.parametrize("name", ["scored_texts", "filtered_against_original", "delta_by_source", "token_f1_exploded", "token_f1_multi_gold"])
def test_scores_of_near_texts_move_no_text(spark, name):
    """Texts are scored where they are read."""
    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in plan and plan.count("Relation") <= 5


def test_far_pairs_are_counted_where_they_stand(spark):
    """Words of pairs that share many beyond their places are sorted in their row: nothing is joined or shuffled, and the texts
    are read once."""
    rows = spark.createDataFrame([(1, [f"w{k % 900}" for k in range(4000)], [f"w{k % 700}" for k in range(3999, 0, -1)])], "id long, p array<string>, g array<string>")
    frame = score.bag_f1(rows, "id", {"a": ("p", "g")})
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and "Generate" not in plan
    _, p, g = rows.first()
    assert frame.first().a == round(2 * (Counter(p) & Counter(g)).total() / 7999, 4)
    for name, relations in {"scored_texts": 1, "delta_by_source": 1, "token_f1_exploded": 1}.items():
        plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation") == relations and "Join" not in plan, name


def test_f1_near_a_tie_is_rounded_as_sql_does(spark):
    """Sides of 1600 words with 946 in common: 0.59125, as a double a little more."""
    some = {17: 0.0106, 34: 0.0213, 81: 0.0506, 162: 0.1013, 274: 0.1713, 946: 0.5913, 800: 0.5, 1: 0.0006}
    rows = [(c, [f"w{k}" for k in range(1600)], [f"w{k}" if k < c else f"x{k}" for k in range(1600)]) for c in some]
    frame = spark.createDataFrame(rows, "id long, p array<string>, g array<string>")
    assert {r.id: r.a for r in score.bag_f1(frame, "id", {"a": ("p", "g")}).collect()} == some
    assert {r.id: r.a for r in frame.filter("id = 946").select("id", score.token_f1(F.col("p"), F.array("g")).alias("a")).collect()} == {946: 0.5913}


@pytest.mark.parametrize("name", ["normalize_he", "normalize_ar"])
def test_normalised_texts_without_words_agree_with_their_sql(spark, tables, name):
    """Texts that are null, empty or nothing but punctuation, too."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tables}/documents.parquet/*.parquet'")
    got = {r.doc_id: r.norm for r in catalogue.QUERIES[name](spark, tables).collect()}
    assert got == dict(con.sql(catalogue.SQL[name]).fetchall()) and len(got) == len(TEXTS) and got[5] is None
