"""Queries over raw files: the tables are written in the shape of a corpus, a run or a ledger and read back through the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import providers, report
from .functions import text as tx
from .functions.dialect import ARABIC, HEBREW
from .operators import delta, fragmentation, judging
from .plans import fixtures as fx
from .registry import query
from .sources import arrow_dir, ingest
from .storage import scratch
from .streaming import ledger as lg

_POINT, _FATHA = "ָ", "َ"


def _docs(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), F.coalesce("text", F.lit("")).alias("text"), "lang", "source")


def _marked(text, mark):
    return F.regexp_replace(text, "([aeiou])", f"$1{mark}")


def _out(rows, *more):
    """What the queries return of unified examples: long texts as digests."""
    return rows.select(*more, "id", "source", F.md5("context").alias("context"), F.md5("question").alias("question"), F.array_join("answers", "|").alias("answers"), F.array_join(F.col("answer_start").cast("array<string>"), "|").alias("starts"))


_D = "WITH d AS (SELECT doc_id AS k, coalesce(text, '') AS text, lang, source FROM documents)"


_MARK = lambda c, mark: f"regexp_replace({c}, '([aeiou])', '\\1{mark}', 'g')"


@query(f"""{_D} SELECT 'heq_' || k AS id, 'heq' AS source, md5(text) AS context, md5(CASE WHEN k % 11 = 0 THEN '  ' ELSE source END) AS question,
 {_MARK("lang", _POINT)} || '|it''s' || CASE k % 4 WHEN 0 THEN '|None of "them"' WHEN 1 THEN '|True\\n' || chr(10) ELSE '' END AS answers, CASE WHEN k % 3 = 0 THEN '' ELSE k || '|7' END AS starts FROM d WHERE k % 5 <> 0 AND k % 7 <> 0""")
def ingest_heq(spark, sf_dir):
    """Gzipped JSON lines; answers written as Python literals, as lists and tuples, with quotes, escapes, words like None, and
    marks, which stay; impossible and unanswered questions go, blank ones don't."""
    d, path, k = _docs(spark, sf_dir), scratch(spark, "heq"), F.col("k")
    more = F.when(k % 4 == 0, """, 'None of "them"'""").when(k % 4 == 1, r""", 'True\\n\n'""").otherwise("")
    texts = F.concat(F.lit("'"), _marked("lang", _POINT), F.lit("', \"it's\""), more)
    texts = F.when(k % 2 == 0, F.concat(F.lit("["), texts, F.lit("]"))).otherwise(F.concat(F.lit("("), texts, F.lit(")")))
    starts = F.when(k % 3 == 0, "").otherwise(F.concat(F.lit(", 'answer_start': ['"), k.cast("string"), F.lit("', 7]")))
    answers = F.when(k % 7 == 0, "{'text': [], 'answer_start': []}").otherwise(F.concat(F.lit("{'text': "), texts, starts, F.lit("}")))
    question = F.when(k % 11 == 0, "  ").otherwise(_marked("source", _POINT))
    impossible = F.when(k % 5 == 0, True).when(k % 5 == 1, F.lit(None)).otherwise(False)
    raw = d.select(k.cast("string").alias("ID"), _marked("text", _POINT).alias("Context"), question.alias("Question"), impossible.alias("Is_Impossible"), F.lit("good").alias("Question_Quality"), answers.alias("Answers"))
    raw.write.option("compression", "gzip").json(path)
    return _out(ingest.heq(ingest.read_jsonl(spark, path, ingest.HEQ), HEBREW))


@query(f"""{_D} SELECT 'parashoot_' || k || s AS id, 'parashoot' AS source, md5(text) AS context, md5(CASE WHEN k % 11 = 0 THEN '' ELSE source || s END) AS question, {_MARK("lang", _POINT)} AS answers, k::VARCHAR AS starts
 FROM d, (SELECT unnest(['a', 'b']) AS s) WHERE s = 'a' OR k % 3 <> 0""")
def ingest_parashoot(spark, sf_dir):
    """Documents {data: [...]} of two examples each, of which some are impossible; answers are objects, or Python literals in a string."""
    d, path, k = _docs(spark, sf_dir), scratch(spark, "parashoot"), F.col("k")
    answers = F.struct(F.array(_marked("lang", _POINT)).alias("text"), F.array(k.cast("int")).alias("answer_start"))
    literal = F.concat(F.lit("{'text': ['"), _marked("lang", _POINT), F.lit("'], 'answer_start': ('"), k.cast("string"), F.lit("',)}"))
    question = lambda s: F.when(k % 11 == 0, "").otherwise(F.concat("source", F.lit(s)))
    one = lambda s, no, a: F.struct(F.concat(k.cast("string"), F.lit(s)).alias("id"), _marked("text", _POINT).alias("context"), question(s).alias("question"), no.alias("is_impossible"), a.alias("answers"))
    lines = F.concat(F.lit('{"data":['), F.to_json(one("a", F.lit(None).cast("boolean"), answers)), F.lit(","), F.to_json(one("b", k % 3 == 0, literal)), F.lit("]}"))
    d.select(lines.alias("value")).write.text(path)
    return _out(ingest.parashoot(spark.read.schema(ingest.PARASHOOT).json(path), HEBREW))


_MK = "lang || '|' || source || CASE WHEN k % 2 = 0 THEN '|' || k ELSE '' END"
_TRIM = r"regexp_replace(regexp_replace({}, '^\s+', ''), '\s+$', '')".format


@query(f"""{_D} SELECT 'mkqa_' || k AS id, 'mkqa' AS source, NULL::VARCHAR AS context, md5(CASE WHEN k % 13 = 0 THEN '' ELSE {_TRIM("text")} END) AS question, {_MK} AS answers, NULL::VARCHAR AS starts FROM d WHERE (k % 13 = 0 OR {_TRIM("text")} <> '') AND k % 5 <> 0""")
def ingest_mkqa(spark, sf_dir):
    """Questions and answers by language; answers of other types go, aliases of answers without a text stay. Questions are
    trimmed; a question of nothing but marks is none of nothing but white space."""
    d, path, k = _docs(spark, sf_dir), scratch(spark, "mkqa"), F.col("k")
    answer = lambda t, text, *aliases: F.struct(t.alias("type"), text.alias("text"), F.array(*aliases).cast("array<string>").alias("aliases"))
    some = F.array(answer(F.lit("entity"), F.lit(""), F.col("lang")), answer(F.lit("short_phrase"), F.col("source")), answer(F.when(k % 2 == 0, "value").otherwise("number_with_unit"), k.cast("string")))
    none = F.array(answer(F.lit("unanswerable"), F.lit("x")))
    question = F.when(k % 13 == 0, _POINT).otherwise(F.concat(F.lit(" \t"), _marked("text", _POINT), F.lit("\n ")))
    raw = d.select(k.cast("string").alias("example_id"), F.create_map(F.lit("en"), F.lit("?"), F.lit("he"), question).alias("queries"), F.create_map(F.lit("he"), F.when(k % 5 == 0, none).otherwise(some)).alias("answers"))
    raw.write.json(path)
    return _out(ingest.mkqa(ingest.read_jsonl(spark, path, ingest.MKQA), HEBREW, "he"))


_BOTH = "(SELECT unnest(['plain', 'marked']) AS condition)"
_SPLIT = "CASE WHEN k % 4 = 0 THEN 'test' ELSE 'train' END"


def _splits(rows, path):
    """Two splits on disk, and a third that isn't there."""
    rows.filter("k % 4 <> 0").drop("k").write.parquet(f"{path}/train")
    rows.filter("k % 4 = 0").drop("k").write.parquet(f"{path}/test")
    return ingest.read_splits(rows.sparkSession, {s: f"{path}/{s}" for s in ("train", "validation", "test")})


@query(f"""{_D} SELECT condition, 'arcd_' || {_SPLIT} || '_' || k AS id, 'arcd' AS source, md5(CASE condition WHEN 'plain' THEN text ELSE {_MARK("text", _FATHA)} END) AS context,
 md5(CASE condition WHEN 'plain' THEN CASE WHEN k % 9 = 0 THEN '' ELSE source END ELSE {_MARK("source", _FATHA)} END) AS question, {_MARK("lang", _FATHA)} AS answers, k::VARCHAR AS starts FROM d, {_BOTH} WHERE k % 6 <> 0""")
def ingest_arcd(spark, sf_dir):
    """A saved directory of Arrow splits, one scan to both conditions. The plain side has stray marks, which go; a plain question of nothing but
    marks stays, empty."""
    k = F.col("k")
    answers = F.struct(F.when(k % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(_marked("lang", _FATHA))).alias("text"), F.array(k.cast("int")).alias("answer_start"))
    plain = F.when(k % 9 == 0, _FATHA).otherwise(F.concat("source", F.lit(_FATHA)))
    raw = _docs(spark, sf_dir).select("k", k.cast("string").alias("id"), F.concat(F.lit(_FATHA), "text").alias("context"), plain.alias("question"), _marked("text", _FATHA).alias("context_tashkeel"), _marked("source", _FATHA).alias("question_tashkeel"), answers.alias("answers"))
    path = scratch(spark, "arcd")
    arrow_dir.save({"train": raw.filter("k % 4 <> 0").drop("k"), "test": raw.filter("k % 4 = 0").drop("k")}, path)
    return _out(ingest.arcd(arrow_dir.read_saved(spark, path), ARABIC), "condition")


@query(f"""{_D} SELECT condition, 'tydiqa_' || {_SPLIT} || '_' || k AS id, 'tydiqa' AS source, md5(CASE condition WHEN 'plain' THEN text ELSE {_MARK("text", _FATHA)} END) AS context,
 md5(source) AS question, lang AS answers, NULL::VARCHAR AS starts FROM d, {_BOTH}""")
def ingest_tydiqa(spark, sf_dir):
    k = F.col("k")
    answers = F.struct(F.array("lang").alias("text"), F.array(k.cast("int")).alias("start_byte"), F.array(k.cast("int")).alias("limit_byte"))
    raw = _docs(spark, sf_dir).select("k", k.cast("string").alias("id"), F.col("text").alias("passage_text_clean"), _marked("text", _FATHA).alias("passage_text_tashkeel"), F.col("source").alias("question_text_clean"), F.col("source").alias("question_text_tashkeel"), answers.alias("answers"))
    return _out(ingest.tydiqa(_splits(raw, scratch(spark, "tydiqa"))), "condition")


@query(f"""{_D} SELECT condition, 'mkqa_' || k AS id, 'mkqa' AS source, NULL::VARCHAR AS context, md5(CASE condition WHEN 'plain' THEN source ELSE CASE WHEN k % 5 = 0 THEN '' ELSE text END END) AS question, lang || '|5 m' AS answers, NULL::VARCHAR AS starts
 FROM d, {_BOTH} WHERE k % 8 <> 0""")
def ingest_mkqa_conditions(spark, sf_dir):
    """A blank plain question takes both conditions away, a blank marked one none. Plain questions are trimmed and stripped."""
    answers = F.array(F.struct(F.col("lang").alias("text"), F.array().cast("array<string>").alias("aliases"), F.lit("entity").alias("type")), F.struct(F.lit("5 m").alias("text"), F.lit(None).cast("array<string>").alias("aliases"), F.lit("number_with_unit").alias("type")))
    plain = F.when(F.col("k") % 8 == 0, " \u2003\n").otherwise(F.concat(F.lit("\t"), "source", F.lit(f"{_FATHA} ")))
    raw = _docs(spark, sf_dir).select("k", F.col("k").cast("string").alias("example_id"), plain.alias("query_ar"), F.when(F.col("k") % 5 == 0, "").otherwise(F.col("text")).alias("query_ar_tashkeel"), answers.alias("answers_ar"))
    return _out(ingest.mkqa_conditions(_splits(raw, scratch(spark, "mkqa_ar")), ARABIC), "condition")


@query("SELECT 'm' || item_id AS model, 0::INT AS ord, item_id::VARCHAR AS id, 'b' AS source, md5(text) AS question, length(text)::INT AS pred_len_words, 0.5::DOUBLE AS f1 FROM benchmark")
def scan_runs(spark, sf_dir):
    """Result documents of runs, pretty-printed, one file each for every benchmark item."""
    path = scratch(spark, "runs")
    example = F.struct(F.col("item_id").cast("string").alias("id"), F.lit("b").alias("source"), F.col("text").alias("question"), F.array("text").alias("answers"), F.lit("p").alias("prediction"), F.length("text").alias("pred_len_words"), F.lit(1).alias("em"), F.lit(0.5).alias("f1"))
    runs = fx.table(spark, sf_dir, "benchmark").select(F.to_json(F.struct(F.concat(F.lit("m"), F.col("item_id").cast("string")).alias("model"), F.lit("d").alias("data_dir"), F.lit(1.5).alias("elapsed_s"), F.array(example).alias("examples")), {"pretty": "true"}).alias("value"), "item_id")
    runs.write.partitionBy("item_id").text(path)
    return ingest.read_run(spark, f"{path}/item_id=*").select("model", "ord", "id", "source", F.md5("question").alias("question"), "pred_len_words", "f1")


_PILOT = "WITH d AS (SELECT doc_id AS k, coalesce(text, '') AS text, lang, source, n_chars FROM documents)"


def _pilot(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    level = F.when(F.col("n_chars") >= 2000, "high").when(F.col("n_chars") >= 500, "mid").otherwise("low")
    return d.select(
        F.col("doc_id").alias("pilot_id"), "source", F.col("lang").alias("model_key"), F.lit("plain").alias("condition"), level.alias("f1_level"), (F.col("n_chars") % 100 / 100).alias("f1"), (F.col("doc_id") % 2).cast("int").alias("em"),
        F.concat(F.col("source"), F.lit(', "quoted"')).alias("question"), F.lit(None).cast("string").alias("context"), F.array("lang", F.lit("a,b")).alias("answers"), F.coalesce("text", F.lit("")).alias("prediction"),
    )


@query(f"""{_PILOT} SELECT k::INT AS pilot_id, source || ', "quoted"' AS question, lang || ' | a,b' AS gold_answers, md5(text) AS prediction, CASE WHEN k % 3 = 0 THEN 'CORRECT' ELSE '' END AS human FROM d""")
def human_sheet(spark, sf_dir):
    """The blinded sheet is written, with texts of many lines, read again, and labelled in part."""
    path = scratch(spark, "sheet")
    report.write_blinded(judging.blinded(_pilot(spark, sf_dir)).withColumn("human_label", F.when(F.col("pilot_id") % 3 == 0, " correct ").otherwise("")), path)
    from .operators.agreement import clean_label

    rows = ingest.read_human_labels(spark, path)
    return rows.select("pilot_id", "question", "gold_answers", F.md5(F.coalesce("prediction", F.lit(""))).alias("prediction"), clean_label(F.col("human_label")).alias("human"))


@query("""SELECT doc_id AS pilot_id, source, lang AS model_key, 'plain' AS condition, CASE WHEN n_chars >= 2000 THEN 'high' WHEN n_chars >= 500 THEN 'mid' ELSE 'low' END AS f1_level, (n_chars % 100 / 100)::DOUBLE AS f1, (doc_id % 2)::INT AS em, true AS merged FROM documents""")
def pilot_metadata(spark, sf_dir):
    """The side file of what was hidden, joined to the sheet again."""
    pilot, path = _pilot(spark, sf_dir), scratch(spark, "metadata")
    report.write_metadata(judging.metadata(pilot), path)
    kinds = ", ".join(f"{c} {dict(pilot.dtypes)[c]}" for c in judging.METADATA)
    sheet = judging.blinded(pilot).select("pilot_id", F.col("question").isNotNull().alias("merged"))
    return spark.read.schema(kinds).option("header", True).csv(path).join(sheet, "pilot_id")


@query("SELECT event_id::INT AS row_id, event_type AS judge_label FROM events WHERE event_id % 10 <> 3")
def ledger_tolerant_scan(spark, sf_dir):
    """A ledger with torn and blank lines."""
    path, k = scratch(spark, "torn"), F.col("event_id")
    line = F.to_json(F.struct(k.alias("row_id"), F.col("event_type").alias("judge_label")))
    torn = F.when(k % 10 == 3, F.substring(line, 1, 12)).when(k % 10 == 4, F.concat(F.lit("\n"), line)).otherwise(line)
    fx.table(spark, sf_dir, "events").select(torn.alias("value")).write.text(path)
    return ingest.read_jsonl(spark, path, ingest.JUDGMENT).select("row_id", "judge_label")


@query("SELECT lang AS source, lang || '_eval.jsonl' AS file, count(*) AS n, sum(n_chars)::BIGINT AS n_chars FROM documents WHERE lang <> 'fr' GROUP BY lang")
def mirrored_directory(spark, sf_dir):
    """A directory by sources, read as its files' names say, without one source, and mirrored to another."""
    d = fx.table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.concat("lang", F.lit("_eval")).alias("source"))
    first, second = scratch(spark, "mirror"), scratch(spark, "mirror")
    report.mirror(d, first)
    rows = ingest.read_directory(spark, first, "doc_id long, n_chars long")
    report.mirror(ingest.select_sources(rows, None, ("fr",)).withColumn("source", F.concat("source", F.lit("_eval"))).drop("file"), second)
    return ingest.read_directory(spark, second, "doc_id long, n_chars long").groupBy("source", "file").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


@query("SELECT doc_id::VARCHAR AS id FROM labels WHERE quality = 1")
def selected_ids(spark, sf_dir):
    path = scratch(spark, "ids")
    report.write_ids(fx.table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("example_id")), path)
    return spark.read.text(path).select(F.col("value").alias("id"))


@query("""WITH s AS (SELECT lang AS source, (n_chars >= 500)::INT AS em FROM documents), r AS (SELECT CASE WHEN grouping(source) = 1 THEN 'overall' ELSE source END AS source, count(*) AS n, sum(em) AS hits FROM s GROUP BY ROLLUP (source))
SELECT (row_number() OVER (ORDER BY source = 'overall', source) - 1)::INT AS place, source, n::INT AS n, round(100 * hits / n, 2)::DOUBLE AS em FROM r""")
def report_document(spark, sf_dir):
    """Percentages by source, the total last, as a JSON document that is read again."""
    rows = fx.table(spark, sf_dir, "documents").select(F.col("lang").alias("source"), (F.col("n_chars") >= 500).cast("int").alias("em"), F.lit(0.0).alias("f1"))
    found = [r.asDict() for r in report.ordered(delta.score_by_source(rows)).collect()]
    table = [(k, r["source"], r["n"], report.percent(r["em_hits"], r["n"])) for k, r in enumerate(found)]
    path = f"{scratch(spark, 'report')}/report.json"
    report.write_json(spark.createDataFrame(table, "place int, source string, n int, em double").orderBy("place"), path)
    return spark.read.schema("place int, source string, n int, em double").option("multiLine", True).json(path)


# stages that can be stopped and run again


_CHUNKED = rf"""c AS (SELECT k, text, string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM d),
f AS (SELECT k, text, list_reduce(list_transform(ss, lambda s: {{'done': []::VARCHAR[], 'open': s, 'size': len(s) + 1}}), lambda a, x:
  CASE WHEN a.size + x.size > 400 AND a.open <> '' THEN {{'done': list_append(a.done, a.open), 'open': x.open, 'size': x.size - 1}}
  ELSE {{'done': a.done, 'open': CASE WHEN a.open = '' THEN x.open ELSE a.open || ' ' || x.open END, 'size': a.size + x.size}} END) AS r FROM c),
g AS (SELECT k, CASE WHEN text = '' THEN [] WHEN len(text) <= 400 THEN [text] ELSE flatten(list_transform(CASE WHEN r.open <> '' THEN list_append(r.done, r.open) ELSE r.done END, lambda c: list_transform(range(1, greatest(len(c), 1) + 1, 400), lambda k: substr(c, k, 400)))) END AS cs FROM f),
m AS (SELECT k, regexp_replace(array_to_string(cs, ' '), '([aeiou])', '\1{_POINT}', 'g') AS marked FROM g)"""


@query(f"{_D}, {_CHUNKED} SELECT d.k AS id, source, md5(regexp_replace(source, '([aeiou])', '\\1{_POINT}', 'g')) AS question, CASE WHEN d.k % 3 <> 0 THEN md5(marked) END AS context, 1::BIGINT AS times FROM d JOIN m ON d.k = m.k")
def resumable_marking(spark, sf_dir):
    """Whole texts go through a diacritizer in chunks; the first run is cut short, the second takes what is left, a third nothing.
    Chunks of texts beyond 10,000 characters are dealt over the tasks."""
    d, out, k = _docs(spark, sf_dir), scratch(spark, "marked"), F.col("k")
    rows = d.select(k.alias("id"), "source", F.col("source").alias("question"), F.when(k % 3 != 0, F.col("text")).alias("context"))
    step = lambda todo: providers.apply_chunks(todo, lambda: providers.Marker(_POINT), ["question", "context"], 400, spread=10_000)
    lg.resume(rows.filter("id % 2 = 0"), out, step, batch=4000)
    lg.resume(rows, out, step, batch=4000)
    done = lg.resume(rows, out, step, batch=4000)
    return done.groupBy("id", "source").agg(F.max(F.md5("question")).alias("question"), F.max(F.md5("context")).alias("context"), F.count("*").alias("times"))


_CONV = """WITH c AS (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
q AS (SELECT conv_id * 1000 + turn AS id, text AS question, answer FROM c WHERE role = 'user' AND nr = 'assistant')"""


def _last_words(inputs: list[str]) -> list[str]:
    """An offline model: what it is asked, from the end, on a second line."""
    return ["  " + " ".join(reversed(x.split(" "))) + "\nthat is all" for x in inputs]


@query(f"""{_CONV} SELECT id, md5(regexp_replace(regexp_replace(string_split(array_to_string(list_reverse(string_split(question, ' ')), ' '), chr(10))[1], '^\\s+', ''), '\\s+$', '')) AS prediction, 1::BIGINT AS times FROM q""")
def resumable_generation(spark, sf_dir):
    """Whole questions through a model's stand-in that dies at every seventh id in the first run: all other batches stay, and the
    second run takes the rest. The first line of the reply is the prediction."""
    q = fx.conversations(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "question")
    out = scratch(spark, "generated")

    def step(dies):
        def dying(inputs):
            if any(x.startswith("!") for x in inputs):
                raise OSError("gone")
            return _last_words(inputs)

        def run(todo):
            asked = todo.withColumn("x", F.when(F.lit(dies) & (F.col("id") % 7 == 0), "!").otherwise(F.col("question")))
            return providers.apply(asked, lambda: dying, "x", "reply", batch=4, skip=True).select("id", tx.first_line(F.col("reply")).alias("prediction"))

        return run

    lg.resume(q, out, step(True), batch=2000, strict=False)
    return lg.resume(q, out, step(False), batch=2000).groupBy("id", F.md5("prediction").alias("prediction")).agg(F.count("*").alias("times"))


@query(f"""{_CONV}, n AS (SELECT count(*) AS n FROM q) SELECT n AS rows, n // 2 AS first_run, n // 2 AS calls_of_first, n AS calls, n AS finished, n AS reported FROM n""")
def budget_of_calls(spark, sf_dir):
    """All tasks together may make as many calls as half the rows; the rest stays pending, and a second budget finishes it.
    What the stage reported while it ran agrees with the ledger."""
    q = fx.conversations(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("question").alias("message"))
    out, total, seen, made, sizes = scratch(spark, "budgeted"), q.count(), [], [], []
    for calls in (total // 2, total):
        budget = providers.Budget(calls, at_once=4)
        lease = budget.lease(spark)
        step = lambda todo: providers.judged(todo, lambda: providers.Retrying(lease.limited(_reply), wait=lambda k: 0), skip=True).select("id", "judge_label")  # noqa: B023, E731
        sizes.append(lg.resume(q, out, step, batch=5000, errors=F.col("judge_label") == "ERROR", watch=seen.append, strict=False).select("id").distinct().count())
        made.append(calls - budget.left)
        budget.close()
    last = {x["total"]: x["done"] for x in seen}
    row = (total, sizes[0], made[0], sum(made), sizes[1], sum(last.values()))
    return spark.createDataFrame([row], "rows long, first_run long, calls_of_first long, calls long, finished long, reported long")


def _reply(message: str) -> str:
    """An offline judge: by the length of the message; some replies have no valid label."""
    n = len(message)
    return '{"label": "%s", "reason": "n%d"}' % ("Correct" if n % 3 == 0 else "INCORRECT" if n % 3 == 1 else "unsure", n % 3)


@query(f"""{_CONV}, m AS (SELECT id, length('Question: ' || question || chr(10) || chr(10) || 'Gold answer(s): ' || answer || chr(10) || chr(10) || 'Candidate answer: x') AS n FROM q WHERE id % 5 <> 0)
SELECT id, CASE n % 3 WHEN 0 THEN 'CORRECT' WHEN 1 THEN 'INCORRECT' ELSE 'ERROR' END AS judge_label, 'n' || n % 3 AS judge_reason, CASE WHEN n % 3 = 2 THEN 2 ELSE 1 END::BIGINT AS times FROM m
UNION ALL SELECT id, 'INCORRECT', 'empty prediction', 1 FROM q WHERE id % 5 = 0""")
def resumable_judging(spark, sf_dir):
    """Labelled rows come into the ledger at the first run; those whose reply has no valid label are tried again at the next."""
    q = fx.conversations(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), tx.judge_message(F.col("question"), F.array("answer"), F.lit("x")).alias("message"))
    out, columns = scratch(spark, "judged"), ("id", "judge_label", "judge_reason")
    step = lambda todo: providers.judged(todo, lambda: providers.Retrying(_reply, wait=lambda k: 0)).select(*columns)
    ready = q.filter("id % 5 = 0").select("id", F.lit("INCORRECT").alias("judge_label"), F.lit("empty prediction").alias("judge_reason"))
    rows = q.filter("id % 5 <> 0")
    for _ in range(2):
        ledger = lg.resume(rows, out, step, done=lg.valid_label(), ready=ready)
    return ledger.groupBy(*columns).agg(F.count("*").alias("times"))


class _Flaky:
    """Fails at the first so many calls of an input as its length says, modulo 4."""

    def __init__(self):
        self.calls = {}

    def __call__(self, x: str) -> str:
        n = self.calls[x] = self.calls.get(x, 0) + 1
        if n <= len(x) % 4:
            raise OSError(x)
        return f"{n}"


@query("SELECT conv_id, turn, CASE WHEN length(text) % 4 < 3 THEN (length(text) % 4 + 1)::VARCHAR ELSE 'failed' END AS tries FROM conversations")
def retries(spark, sf_dir):
    """Calls that fail up to three times; the third failure is final."""
    unique = F.concat(F.col("text"), F.lpad(F.concat("conv_id", F.lit(":"), "turn"), 40, " "))  # 40 more, so the length stays the same modulo 4
    rows = fx.table(spark, sf_dir, "conversations").select("conv_id", "turn", unique.alias("x"))
    return providers.apply(rows, lambda: providers.Retrying(_Flaky(), workers=1, wait=lambda k: 0, failed="failed"), "x", "tries", batch=1).drop("x")


@query("""WITH c AS (SELECT count(*) AS total, count(*) FILTER (event_id % 2 = 0) AS done, count(*) FILTER (event_type = 'error' AND event_id % 2 = 0) AS errors FROM events)
SELECT done, total, round(100.0 * done / total, 1)::DOUBLE AS percent, errors, round(done * 0.02 / 105, 2)::DOUBLE AS cost, round((total - done) / (done / 7200.0) / 3600, 1)::DOUBLE AS eta_hours, total AS calls, round(total * 0.02 / 105, 2)::DOUBLE AS cost_low, round(total * 0.02 / 105 * 1.2, 2)::DOUBLE AS cost_high, round(total * 3.24 / 4 / 60, 6)::DOUBLE AS minutes FROM c""")
def progress(spark, sf_dir):
    """How far a ledger of half the events is after two hours, and what all of them will cost."""
    ledger = fx.ledger(spark, sf_dir)
    total = ledger.count()
    got = report.progress_of(ledger.filter("event_id % 2 = 0"), total, 7200.0) | report.estimate(total)
    got["minutes"] = round(got["minutes"], 6)
    kinds = "done long, total long, percent double, errors long, cost double, eta_hours double, calls long, cost_low double, cost_high double, minutes double"
    return spark.createDataFrame([tuple(got[c.split()[0]] for c in kinds.split(", "))], kinds)


@query(f"""SELECT source, sum(length(text))::BIGINT AS no_tok_count, sum(length(m))::BIGINT AS with_tok_count, sum(length(m))::DOUBLE / sum(length(text))::DOUBLE AS frag_ratio FROM (SELECT lang AS source, text, {_MARK("text", _FATHA)} AS m FROM documents) WHERE source <> 'de' GROUP BY source""")
def paired_directories(spark, sf_dir):
    """Two directories of files, plain and marked, paired by name; a file that only one of them has is left out."""
    d = fx.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("lang").alias("source"))
    plain, marked = scratch(spark, "plain"), scratch(spark, "with_marks")
    report.mirror(d, plain)
    report.mirror(d.filter("source <> 'de'").withColumn("text", _marked("text", _FATHA)), marked)
    total = lambda path: fragmentation.token_totals(ingest.read_directory(spark, path, "doc_id long, text string"), F.length("text"))
    return fragmentation.fragmentation(total(plain), total(marked))


@query("SELECT doc_id, md5(text) AS text, true AS there FROM documents WHERE doc_id % 2 = 0")
def optional_splits(spark, sf_dir):
    """Of the files asked for, those that are there."""
    path = scratch(spark, "optional")
    report.write_examples(fx.table(spark, sf_dir, "documents").filter("doc_id % 2 = 0").select("doc_id", "text"), f"{path}/train.jsonl")
    rows = ingest.read_jsonl(spark, ingest.existing(spark, [f"{path}/{s}.jsonl" for s in ("train", "validation")]), "doc_id long, text string")
    return rows.select("doc_id", F.md5("text").alias("text"), F.lit(True).alias("there"))


@query(f"""{_D} SELECT k AS id, md5(array_to_string(list_transform(regexp_extract_all(t, '[\\x{{0621}}-\\x{{063A}}\\x{{0640}}-\\x{{065F}}\\x{{0670}}]+|[^\\x{{0621}}-\\x{{063A}}\\x{{0640}}-\\x{{065F}}\\x{{0670}}]+'),
 lambda p: regexp_replace(p, '[\\x{{064B}}-\\x{{065F}}\\x{{0670}}]', '', 'g') || regexp_replace(p, '[^\\x{{064B}}-\\x{{065F}}\\x{{0670}}]', '', 'g')), '')) AS context, source FROM (SELECT k, source, regexp_replace(translate(text, 'bdfklmnrst', 'بدفكلمنرست'), '([aeiou])', chr(1614), 'g') AS t FROM d)""")
def reordered_overlay(spark, sf_dir):
    """The reordered text in the place of the old, checked to be a reordering; all other columns as they were."""
    t = F.regexp_replace(F.translate("text", "bdfklmnrst", "بدفكلمنرست"), "([aeiou])", _FATHA)
    rows = _docs(spark, sf_dir).select(F.col("k").alias("id"), t.alias("context"), "source")
    return rows.withColumns({"context": tx.checked_reorder(F.col("context"))}).withColumn("context", F.md5("context"))


_REPEATED = """, l AS (SELECT k AS id, source, length(text) AS n, k % 2 = 0 AS twice FROM d)"""


@query(f"""{_D}{_REPEATED} SELECT id::VARCHAR AS id, source, (n % 2)::INT AS base_em, (n % 3 = 0)::INT AS treated_em, (n % 10000 / 10000)::DOUBLE AS base_f1, (n % 1000 / 1000)::DOUBLE AS treated_f1,
 ((n % 3 = 0)::INT - n % 2)::INT AS delta_em, round(n % 1000 / 1000 - n % 10000 / 10000, 4)::DOUBLE AS delta_f1 FROM l WHERE id % 5 <> 0""")
def paired_last_lines(spark, sf_dir):
    """Two directories of JSON lines, in which every second id stands twice on both sides, in another file or another line: the
    last line counts. Every fifth id has no treated line."""
    d, base, treated, k = _docs(spark, sf_dir), scratch(spark, "base"), scratch(spark, "treated"), F.col("k")
    n = F.length("text")
    example = lambda em, f1: d.select(k.cast("string").alias("id"), "source", em.cast("int").alias("em"), f1.alias("f1"), F.lit("p").alias("prediction"), "k")
    sides = {base: example(n % 2, n % 10000 / 10000), treated: example(n % 3 == 0, n % 1000 / 1000).filter("k % 5 <> 0")}
    for path, rows in sides.items():
        wrong = rows.filter("k % 2 = 0").withColumns({"em": 1 - F.col("em"), "f1": F.lit(9.0)})
        # a file of wrong lines, then one in which wrong and right lines of the same ids follow each other
        report.write_examples(wrong.filter("k % 4 = 0").drop("k"), f"{path}/a_eval.jsonl")
        both = wrong.filter("k % 4 <> 0").withColumn("nth", F.lit(1)).unionByName(rows.withColumn("nth", F.lit(2)))
        report.write_examples(both.repartition(3, "k").sortWithinPartitions("k", "nth").drop("k", "nth"), f"{path}/b_eval.jsonl")
    read = lambda path: ingest.read_directory(spark, path, "id string, source string, em int, f1 double, prediction string").drop("file")
    source = lambda rows: rows.withColumn("source", F.lit("x"))  # noqa: E731  the readers name it by the file
    pairs = delta.paired(source(read(base)), source(read(treated)), "ord")
    return pairs.drop("base_pred", "treated_pred", "source").join(d.select(k.cast("string").alias("id"), "source"), "id")


@query(f"{_D} SELECT 'part' AS file, k AS id, (row_number() OVER (ORDER BY k) - 1) * 2 AS line, md5(text) AS text FROM d")
def numbered_lines(spark, sf_dir):
    """One file of a line for each document and a blank line after it, read in many splits: every line has its number."""
    path = f"{scratch(spark, 'lines')}/part"
    lines = _docs(spark, sf_dir).select("k", F.concat(F.to_json(F.struct("k", "text")), F.lit("\n")).alias("value"))
    report.write_lines(lines, path, "k")
    rows = ingest.read_lines(spark, path).filter("value <> ''")
    one = F.from_json("value", "k long, text string")
    return rows.select("file", one["k"].alias("id"), "line", F.md5(one["text"]).alias("text"))


@query(f"""{_D}, s AS (SELECT lang, k, (length(text) >= 500)::INT AS base_em, (length(text) >= 800)::INT AS treated_em FROM d), a AS (SELECT lang, count(*) AS n, round(100 * sum(base_em) / count(*), 2)::DOUBLE AS em FROM s GROUP BY lang)
SELECT 'm' AS model, k::VARCHAR AS id, lang AS source, base_em, treated_em, n, em, md5(text) AS text FROM s JOIN a USING (lang) JOIN d USING (k)""")
def delta_document(spark, sf_dir):
    """One document with the aggregate by source and all examples, read again."""
    d = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    rows = d.withColumns({"base_em": (F.length("text") >= 500).cast("int"), "treated_em": (F.length("text") >= 800).cast("int")})
    found = rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("base_em").alias("hits")).collect()
    head = {"model": "m", "aggregate": [{"source": r.source, "n": r.n, "em": report.percent(r.hits, r.n)} for r in found]}
    path = f"{scratch(spark, 'delta')}/delta.json"
    report.write_document(spark, path, head, "per_example", rows)
    kind = "model string, aggregate array<struct<source:string,n:long,em:double>>"
    heads, rows = ingest.read_document(spark, path, kind, "per_example", "id string, source string, text string, base_em int, treated_em int")
    aggregate = heads.select("path", "model", F.inline("aggregate")).withColumnRenamed("source", "s")
    rows = rows.join(F.broadcast(aggregate), (rows["path"] == aggregate["path"]) & (F.col("source") == F.col("s")))
    return rows.select("model", "id", "source", "base_em", "treated_em", "n", "em", F.md5("text").alias("text"))


@query("""WITH l AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_id % 2 = 0 THEN 'CORRECT' ELSE 'INCORRECT' END AS judge_label FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (judge_label <> 'ERROR')::INT DESC, ts DESC, event_id DESC) AS r FROM l) SELECT user_id, event_id, judge_label FROM r WHERE r = 1""")
def ledger_latest_stream(spark, sf_dir):
    """The latest valid line of each key, kept by a stream whose files come late, repeated and in two runs."""
    base, e = scratch(spark, "latest"), fx.ledger(spark, sf_dir).select("event_id", "user_id", F.col("ts").cast("string").alias("ts"), "judge_label")
    kind = "event_id long, user_id long, ts string, judge_label string"
    for part in (e.filter("event_id % 3 > 0"), e.filter("event_id % 3 < 2")):
        part.repartition(3, F.xxhash64("event_id")).write.mode("append").json(f"{base}/in")
        lg.run_latest(spark, f"{base}/in", kind, f"{base}/out", f"{base}/at", "user_id", "ts", "event_id", files=2).awaitTermination()
    return lg.read_latest(spark, f"{base}/out", "user_id").select("user_id", "event_id", "judge_label")


@query("SELECT conv_id, turn, least(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')), 40)::VARCHAR || ':' || list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')[1] AS reply FROM conversations")
def batches_by_length(spark, sf_dir):
    """A model that takes batches of one length: inputs are cut, dealt by length and come back in their order."""
    class Model:
        def __call__(self, batch):
            assert len({len(x) for x in batch}) == 1
            held = [[t for t in x if t] for x in batch]
            return [f"{len(x)}:{x[0]}" if x else "0:" for x in held]

    rows = fx.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return providers.apply(rows, lambda: providers.ByLength(Model(), str.split, most=40, budget=2000, fill=""), "text", "reply", batch=500).drop("text")
