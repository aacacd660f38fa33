"""Readers of the raw corpora into one schema: id, source, context, question, answers, answer_start."""

from __future__ import annotations

import ast
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from ..functions.dialect import Dialect
from ..functions.text import blank, flatten_answers, strip_marks, trim_white
from ..storage import stored

EXAMPLE = "id string, source string, context string, question string, answers array<string>, answer_start array<int>"
HEQ = "ID string, Context string, Question string, Is_Impossible boolean, Question_Quality string, Answers string"
PARASHOOT = "data array<struct<id:string,context:string,question:string,is_impossible:boolean,answers:string>>"
MKQA = "example_id string, queries map<string,string>, answers map<string,array<struct<type:string,text:string,aliases:array<string>>>>"
PREDICTION = "id string, source string, question string, answers array<string>, prediction string, pred_len_words int, em int, f1 double"
RUN = f"model string, data_dir string, elapsed_s double, examples array<struct<{', '.join(x.replace(' ', ':', 1) for x in PREDICTION.split(', '))}>>"
JUDGMENT = "row_id int, example_id string, source string, model string, condition string, answer_length_bucket string, f1 double, em int, pre_labeled boolean, judge_label string, judge_reason string"
HUMAN = "pilot_id string, question string, context string, gold_answers string, prediction string, human_label string, human_notes string"


def file_order() -> Column:
    """The place of a row of a text file: the file's path, where its split begins, and a number that grows within the split.
    Rows in this order are in the order of files by name and of lines within them; no task needs to see a whole file."""
    return F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Lines that aren't JSON are dropped; gzip is read as such. file: the file's name; ord: the row's place, by which the
    last of several rows is the last line."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    rows = rows.select("*", F.col("_metadata.file_name").alias("file"), file_order().alias("ord"))
    return rows.filter("_corrupt_record is null").drop("_corrupt_record")


#: Splits of files whose numbers are broadcast.
SPLITS = 100_000


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """value, file, line: the lines of text files with their numbers within the file, from 0. Two scans: the first counts the
    lines of each split, one row for each, and what lies before a split is added to the places within it."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), file_order().alias("ord")).select("value", "file", "ord.*")
    splits = raw.groupBy("path", "block").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = stored(splits.select("path", "block", (before - F.col("first")).alias("add")), "splits")
    splits = F.broadcast(splits) if splits.count() <= SPLITS else splits
    return raw.join(splits, ["path", "block"]).select("value", "file", (F.col("row") + F.col("add")).alias("line"))


def read_directory(spark: SparkSession, path: str, schema: str, pattern: str = "*.jsonl") -> DataFrame:
    """All files (or directories written as such) of a directory, by name: `file` has the name, `source` what it is of, `ord`
    the place of the row. An empty directory is an error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{pattern}")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []
    if not len(found):
        raise FileNotFoundError(f"{path}/{pattern}")
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json([f.getPath().toString() for f in found])
    ends = pattern.lstrip("*").replace(".", r"\.")
    name = F.regexp_extract(F.col("_metadata.file_path"), rf"([^/]+{ends})(?:/[^/]*)?$", 1)
    rows = rows.select("*", name.alias("file"), file_order().alias("ord")).filter("_corrupt_record is null").drop("_corrupt_record")
    return rows.withColumn("source", source_of_file(F.col("file")))


def read_documents(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Files of one JSON document each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_document(spark: SparkSession, path: str | list[str], head: str, name: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """Documents as report.write_document() lays them out: a frame (path, and the columns of `head`) with one row for each, and
    one (path, and the columns of `kind`) of the rows of their arrays `name`. A row has a line of its own, which begins with its
    brace or a comma; so a document is read in splits, and what is left without these lines is a small document. A row that
    isn't JSON is an error."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), file_order().alias("ord"))
    is_row = F.col("value").rlike(r'^,?\{"')
    strict = {"mode": "FAILFAST"}
    row = F.from_json(F.regexp_replace("value", "^,", ""), StructType.fromDDL(kind), strict)
    rest = lines.filter(~is_row).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ord", "value"))).alias("ls"))
    whole = F.from_json(F.array_join(F.transform("ls", lambda x: x["value"]), "\n"), StructType.fromDDL(f"{head}, `{name}` array<struct<>>"), strict)
    heads = rest.select("path", whole.alias("d")).select("path", "d.*").drop(name)
    return heads, lines.filter(is_row).select("path", row.alias("r")).select("path", "r.*")


def read_splits(spark: SparkSession, paths: dict[str, str], reader: str = "parquet") -> DataFrame:
    """The splits that are there, one below the other, with their names as `split`."""
    out = None
    for split, path in paths.items():
        if existing(spark, [path]):
            rows = spark.read.format(reader).load(path).withColumn("split", F.lit(split))
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(", ".join(paths.values()))
    return out


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Of optional files those that are there."""
    conf, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    return [p for p in paths if path(p).getFileSystem(conf).exists(path(p))]


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """The examples of a run's JSON document."""
    return read_documents(spark, path, RUN).select("model", F.posexplode("examples").alias("ord", "e")).select("model", "ord", "e.*")


def read_human_labels(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(HUMAN).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    rows = rows.select("*", file_order().alias("ord"))
    return rows.withColumn("pilot_id", whole_number(F.col("pilot_id")).cast("int")).filter("pilot_id is not null")


def whole_number(text: Column) -> Column:
    """The number that a text is, with white space around it and nothing else; else null."""
    return F.when(F.rlike(text, F.lit(r"^\s*[+-]?[0-9]+\s*$")), F.trim(trim_white(text)).try_cast("long"))


def _text(x) -> str | None:
    """A value as a string that can be stored: surrogates that make a character become it, others U+FFFD."""
    return None if x is None else str(x).encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def _answers(text: str | None) -> dict | None:
    try:
        found = ast.literal_eval(text)
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        try:
            found = json.loads(text)
        except (ValueError, TypeError, RecursionError):
            return None
    try:
        return {"text": [_text(t) for t in found.get("text", [])], "answer_start": [int(x) for x in found.get("answer_start", [])]}
    except (AttributeError, TypeError, ValueError, OverflowError):
        return None


@F.arrow_udf(StructType().add("text", ArrayType(StringType())).add("answer_start", ArrayType(LongType())))
def _parsed(text: pa.Array) -> pa.Array:
    return pa.array([_answers(x) for x in text.to_pylist()], pa.struct([("text", pa.list_(pa.string())), ("answer_start", pa.list_(pa.int64()))]))


def parse_answers(text: Column) -> Column:
    """text and answer_start of answers written as a Python literal, or else as JSON; lists that it lacks are empty, numbers
    may be strings. Null where it is neither, no mapping, or has starts that are no whole numbers."""
    return _parsed(text)


def _unified(rows: DataFrame, key: Column, source: str, context: Column, question: Column, answers: Column, starts: Column | None = None) -> DataFrame:
    """Examples that have an answer."""
    none = F.lit(None).cast("array<int>")
    rows = rows.select(key.alias("id"), F.lit(source).alias("source"), context.alias("context"), question.alias("question"), answers.alias("answers"), (none if starts is None else starts.cast("array<int>")).alias("answer_start"))
    return rows.filter(F.size("answers") > 0)


def _possible(rows: DataFrame, column: str) -> DataFrame:
    return rows.filter(~F.coalesce(column, F.lit(False)))


def heq(raw: DataFrame, dialect: Dialect) -> DataFrame:
    """Marks go from the passage and the question; the answers stay as they are."""
    rows = _possible(raw, "Is_Impossible").withColumn("_a", parse_answers(F.col("Answers")))
    bare = lambda c: strip_marks(F.col(c), dialect)
    return _unified(rows, F.concat(F.lit("heq_"), "ID"), "heq", bare("Context"), bare("Question"), F.col("_a.text"), F.col("_a.answer_start"))


def parashoot(raw: DataFrame, dialect: Dialect) -> DataFrame:
    rows = _possible(raw.select(F.inline("data")), "is_impossible").withColumn("_a", parse_answers(F.col("answers")))
    bare = lambda c: strip_marks(F.col(c), dialect)
    return _unified(rows, F.concat(F.lit("parashoot_"), "id"), "parashoot", bare("context"), bare("question"), F.col("_a.text"), F.col("_a.answer_start"))


def mkqa(raw: DataFrame, dialect: Dialect, language: str) -> DataFrame:
    """Questions of nothing but white space go; one of nothing but marks stays, empty."""
    rows = raw.withColumn("_q", trim_white(F.col("queries")[language])).filter(~blank(F.col("_q")))
    return _unified(rows, F.concat(F.lit("mkqa_"), "example_id"), "mkqa", F.lit(None).cast("string"), strip_marks(F.col("_q"), dialect), flatten_answers(F.col("answers")[language], dialect))


def two_conditions(raw: DataFrame, source: str, key: Column, plain: tuple[Column, Column], marked: tuple[Column, Column], answers: Column, starts: Column | None = None) -> DataFrame:
    """One scan to both conditions of examples that have an answer; each pair is (context, question). The column condition is
    plain or marked; an example has both or none."""
    both = F.array(*(F.struct(F.lit(n).alias("condition"), c.alias("context"), q.alias("question")) for n, (c, q) in (("plain", plain), ("marked", marked))))
    rows = raw.select(key.alias("id"), F.lit(source).alias("source"), answers.alias("answers"), (F.lit(None) if starts is None else starts).cast("array<int>").alias("answer_start"), F.inline(both))
    return rows.filter(F.size("answers") > 0)


def _split_id(source: str) -> Column:
    return F.concat(F.lit(f"{source}_"), F.col("split"), F.lit("_"), F.col("id"))


def arcd(raw: DataFrame, dialect: Dialect) -> DataFrame:
    """raw: as read_splits() gives it. The plain side is stripped, the marked side as it is."""
    c, bare = F.col, lambda x: strip_marks(F.col(x), dialect)
    return two_conditions(raw, "arcd", _split_id("arcd"), (bare("context"), bare("question")), (c("context_tashkeel"), c("question_tashkeel")), c("answers.text"), c("answers.answer_start"))


def tydiqa(raw: DataFrame) -> DataFrame:
    """The plain side comes without marks; offsets in bytes are no starts."""
    c = F.col
    return two_conditions(raw, "tydiqa", _split_id("tydiqa"), (c("passage_text_clean"), c("question_text_clean")), (c("passage_text_tashkeel"), c("question_text_tashkeel")), c("answers.text"))


def mkqa_conditions(raw: DataFrame, dialect: Dialect) -> DataFrame:
    """Whether a question is blank is asked of the plain one; both conditions go then."""
    none, rows = F.lit(None).cast("string"), raw.withColumn("_q", trim_white(F.col("query_ar"))).filter(~blank(F.col("_q")))
    return two_conditions(rows, "mkqa", F.concat(F.lit("mkqa_"), "example_id"), (none, strip_marks(F.col("_q"), dialect)), (none, F.col("query_ar_tashkeel")), flatten_answers(F.col("answers_ar"), dialect))


def source_of_file(name: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), "_eval", "")


def select_sources(rows: DataFrame, include: list[str] | None = None, exclude: tuple[str, ...] = ("mkqa",)) -> DataFrame:
    """Excluded sources stay out even if they are included by name."""
    rows = rows.filter(F.col("source").isin(*include)) if include else rows
    return rows.filter(~F.col("source").isin(*exclude)) if exclude else rows
