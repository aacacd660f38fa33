"""Blinded judge inputs, judge accuracy and transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.score import answer_length_bucket, corrupted_answers, last_of_each
from ..functions.text import blank
from .sampling import numbered

LABELS = ("CORRECT", "INCORRECT")


def reject_reason(rows: DataFrame) -> DataFrame:
    """rows: answers, prediction. reject: corrupted, empty or null."""
    return rows.withColumn("reject", F.when(corrupted_answers(F.col("answers")), "corrupted").when(blank(F.col("prediction")), "empty"))


def canonical(rows: DataFrame) -> DataFrame:
    return reject_reason(rows).filter("reject is null").drop("reject")


def judge_inputs(questions: DataFrame, results: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """questions: example_id, source, question, gold_answers (the plain question is shown for every condition); results:
    example_id, model, condition, prediction, em, f1. Empty predictions come labelled. keep: of the other columns those that are
    wanted, as all that is numbered is sorted."""
    plain = questions.withColumn("answer_length_bucket", answer_length_bucket(F.col("gold_answers")))
    # what is said of texts is found before the join, so that texts which aren't wanted stay where they are
    empty = blank(F.col("prediction"))
    labelled = results.withColumns({"pre_labeled": empty, "judge_label": F.when(empty, "INCORRECT"), "judge_reason": F.when(empty, "empty prediction")})
    rows = labelled.join(plain, "example_id")
    place = ["model", "condition", "source", "example_id"]
    return numbered(rows if keep is None else rows.select(*place, *keep), "row_id", *place)


def blinded(rows: DataFrame) -> DataFrame:
    return rows.select("pilot_id", "question", "context", F.array_join("answers", " | ").alias("gold_answers"), "prediction", F.lit("").alias("human_label"), F.lit("").alias("human_notes"))


METADATA = ("pilot_id", "source", "model_key", "condition", "f1_level", "f1", "em")


def metadata(rows: DataFrame) -> DataFrame:
    """What blinded() hides, to be joined again by pilot_id after labelling."""
    return rows.select(*METADATA)


def cells(rows: DataFrame, dimensions: dict[str, list], *measures) -> DataFrame:
    """A row for each combination of the listed values, with the measures of its rows (null, for a count 0, where there are none)."""
    grid = None
    for name, values in dimensions.items():
        own = F.explode(F.array(*map(F.lit, values))).alias(name)
        grid = rows.sparkSession.range(1).select(own) if grid is None else grid.select("*", own)
    found = rows.groupBy(*dimensions).agg(F.count("*").alias("n"), *measures)
    return F.broadcast(grid).join(found, list(dimensions), "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def pairing(rows: DataFrame, by: list[str]) -> DataFrame:
    """Whether all cells have as many rows, and whether they have the same examples."""
    cells = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.xxhash64("example_id").cast("decimal(38,0)")).alias("h"))
    return cells.agg(F.count("*").alias("cells"), (F.countDistinct("n") <= 1).alias("equal_counts"), (F.countDistinct("n", "h") <= 1).alias("equal_sets"))


def valid(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("judge_label").isin(*LABELS))


def paired_labels(rows: DataFrame, plain: str, marked: str, order: str) -> DataFrame:
    """model, source, example_id, plain, marked (1 for CORRECT): valid labels in both conditions, the last of each by the
    column `order`."""
    rows = last_of_each(valid(rows), ["model", "source", "example_id", "condition"], order)
    hit = F.when(F.col("judge_label") == "CORRECT", 1).otherwise(0)
    pick = lambda c: F.max(F.when(F.col("condition") == c, hit))
    both = rows.groupBy("model", "source", "example_id").agg(F.first("answer_length_bucket").alias("bucket"), pick(plain).alias("plain"), pick(marked).alias("marked"))
    return both.filter("plain is not null and marked is not null")


TRANSITIONS = (("cc", 1, 1), ("ci", 1, 0), ("ic", 0, 1), ("ii", 0, 0))


def transitions(pairs: DataFrame, sets: list[tuple[str, ...]]) -> DataFrame:
    """One pass over all grouping sets: n, cc, ci, ic, ii, plain and marked hits, net churn. `level` names the set."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    count = [F.count_if((F.col("plain") == a) & (F.col("marked") == b)).alias(name) for name, a, b in TRANSITIONS]
    aggs = [F.count("*").alias("n"), *count, F.sum("plain").alias("plain_hits"), F.sum("marked").alias("marked_hits")]
    held = [F.grouping(k).alias(f"_{k}") for k in keys]
    out = pairs.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]).agg(*aggs, *held)
    level = F.concat_ws("+", *(F.when(F.col(f"_{k}") == 0, F.lit(k)) for k in keys))
    out = out.withColumns({"level": F.when(level == "", "all").otherwise(level), "net_churn": F.col("ci") - F.col("ic")})
    return out.drop(*(f"_{k}" for k in keys))


def accuracy(rows: DataFrame, by: list[str]) -> DataFrame:
    return valid(rows).groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("judge_label") == "CORRECT").alias("hits"))
