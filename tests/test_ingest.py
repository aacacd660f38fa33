"""Readers of the corpora against what is written there."""

import ast
import json
import random

from pyspark.sql import functions as F

from pairlens.functions.dialect import ARABIC, HEBREW
from pairlens.sources import ingest


def test_literals_are_read_as_python_reads_them(spark):
    rng = random.Random(0)
    words = ["None", "True story", "it's", 'a "b"', "null", "\n", "\\", "é", "שלום", "\U0001f600", "", "{'x': 1}", "(1,)", "\x00", "#", "]"]
    literals = []
    for _ in range(1000):
        some = [rng.choice([None, " ".join(rng.choices(words, k=rng.randint(1, 3))), rng.choice(words)]) for _ in range(rng.randint(0, 4))]
        found = {"text": rng.choice([list, tuple])(some), "answer_start": [rng.choice([int, str])(rng.randint(0, 9**9)) for _ in some]}
        for name in rng.sample(["text", "answer_start"], k=rng.choice([0, 0, 0, 1])):
            del found[name]
        written = rng.choice([repr, ascii, repr])(found)
        literals.append(rng.choice([written, written, f" {written}".lstrip(), written.replace(", ", " ,\t"), written[:-1]]))
    want = []
    for x in literals:
        try:
            v = ast.literal_eval(x)
            want.append((list(v.get("text", [])), [int(n) for n in v.get("answer_start", [])]))
        except (ValueError, SyntaxError):
            want.append(None)
    rows = spark.createDataFrame(list(enumerate(literals)), "k int, t string").repartition(3)
    got = {r.k: r.a for r in rows.select("k", ingest.parse_answers(F.col("t")).alias("a")).collect()}
    assert [got[k] and (got[k].text, got[k].answer_start) for k in range(1000)] == want and sum(w is None for w in want) > 50


def test_answers_of_other_kinds(spark):
    cases = {
        '{"text": ["a", null], "answer_start": [1]}': (["a", None], [1]), "{'text': ['\\ud83d\\ude00', '\\ud83d'], 'answer_start': ['7', 8.9, True]}": (["\U0001f600", "�"], [7, 8, 1]),
        "{'text': [1, True]}": (["1", "True"], []), "{}": ([], []), "['a']": None, "'a'": None, "{'text': 3}": None, "{'text': ['a'], 'answer_start': ['x']}": None, "x": None, "": None, "(" * 5000: None,
        "{'text': __import__('os')}": None,
    }
    rows = spark.createDataFrame([*((t,) for t in cases), (None,)], "t string")
    for r in rows.select("t", ingest.parse_answers(F.col("t")).alias("a")).collect():
        assert (r.a and (r.a.text, r.a.answer_start)) == cases.get(r.t), r.t


def test_marks_stay_in_answers_and_blank_questions_stay(spark, tmp_path):
    mark = "ָ"
    lines = [
        {"ID": "1", "Context": f"a{mark}b", "Question": f"q{mark}", "Is_Impossible": False, "Answers": f"{{'text': ('x{mark}',), 'answer_start': ['3']}}"},
        {"ID": "2", "Context": None, "Question": "  ", "Answers": {"text": ["y"], "answer_start": [1]}},
        {"ID": "3", "Context": "c", "Question": None, "Answers": "{'text': ['z']}"},
        {"ID": "4", "Context": "c", "Question": "q", "Answers": "{'text': []}"},
        {"ID": "5", "Context": "c", "Question": "q", "Is_Impossible": True, "Answers": "{'text': ['z']}"},
        {"ID": "6", "Context": "c", "Question": "q", "Answers": "torn {"},
    ]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, lines)))
    got = ingest.heq(ingest.read_jsonl(spark, f"file://{tmp_path}/a.jsonl", ingest.HEQ), HEBREW).orderBy("id").collect()
    assert [tuple(r) for r in got] == [("heq_1", "heq", "ab", "q", [f"x{mark}"], [3]), ("heq_2", "heq", None, "  ", ["y"], [1]), ("heq_3", "heq", "c", None, ["z"], [])]


def test_parashoot_answers_are_objects_or_literals(spark, tmp_path):
    data = {"data": [{"id": 1, "context": "c", "question": "", "answers": {"text": ["a"], "answer_start": [2]}}, {"id": "2", "context": "c", "question": "q", "answers": "{'text': ['b'], 'answer_start': ['4']}"}, {"id": "3", "is_impossible": True, "answers": {"text": ["c"]}}, {"id": "4"}]}
    (tmp_path / "train.json").write_text(json.dumps(data, indent=1))
    got = ingest.parashoot(ingest.read_documents(spark, f"file://{tmp_path}/train.json", ingest.PARASHOOT), HEBREW).orderBy("id").collect()
    assert [(r.id, r.question, r.answers, r.answer_start) for r in got] == [("parashoot_1", "", ["a"], [2]), ("parashoot_2", "q", ["b"], [4])]


def test_pairs_stay_whole(spark):
    mark = "َ"
    answers = [{"type": "entity", "text": "a", "aliases": None}]
    schema = "example_id string, query_ar string, query_ar_tashkeel string, answers_ar array<struct<type:string,text:string,aliases:array<string>>>"
    rows = [("1", f" q{mark} ", None, answers), ("2", " ", "marked", answers), ("3", mark, "", answers), ("4", None, "marked", answers), ("5", "q", "m", [])]
    got = ingest.mkqa_conditions(spark.createDataFrame(rows, schema), ARABIC).orderBy("id", "condition").collect()
    assert [(r.id, r.condition, r.question) for r in got] == [("mkqa_1", "marked", None), ("mkqa_1", "plain", "q"), ("mkqa_3", "marked", ""), ("mkqa_3", "plain", "")]
    schema = "id string, split string, context string, question string, context_tashkeel string, question_tashkeel string, answers struct<text:array<string>,answer_start:array<long>>"
    rows = [("7", "train", f"c{mark}", f" q{mark}", f"c{mark}", None, (["a"], [1])), ("8", "train", "c", "q", "c", "q", ([], []))]
    got = ingest.arcd(spark.createDataFrame(rows, schema), ARABIC).orderBy("condition").collect()
    assert [(r.id, r.condition, r.context, r.question, r.answer_start) for r in got] == [("arcd_train_7", "marked", f"c{mark}", None, [1]), ("arcd_train_7", "plain", "c", " q", [1])]
