"""Agreement of two raters: rows of human and judge labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.score import last_of_each
from ..functions.text import trim_white
from ..sources.ingest import whole_number
from .judging import LABELS


def clean_label(label: Column) -> Column:
    return F.upper(trim_white(F.coalesce(label, F.lit(""))))


def paired_raters(human: DataFrame, judge: DataFrame, order: str) -> DataFrame:
    """Joined on the whole-number pilot_id; others (duplicates) and invalid labels go. Of a person's labels of one id the last
    that isn't blank counts, by the column `order`; the judge's labels count as they are written."""
    number = lambda x: x.withColumn("pilot_id", whole_number(F.col("pilot_id").cast("string")).cast("int")).filter("pilot_id is not null")
    h = number(human).select("pilot_id", clean_label(F.col("human_label")).alias("human"), order).filter("human <> ''")
    h = last_of_each(h, ["pilot_id"], order).select("pilot_id", "human")
    j = number(judge).withColumn("judge", F.col("judge_label"))
    return h.filter(h.human.isin(*LABELS)).join(j.filter(j.judge.isin(*LABELS)), "pilot_id")


def confusion(rows: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """human, and a count for each label of the judge; a row for each label, with zeros where nothing occurs."""
    cell = lambda h, j: F.count_if((F.col("human") == h) & (F.col("judge") == j)).alias(j)
    return rows.agg(F.array(*(F.struct(F.lit(h).alias("human"), *(cell(h, j) for j in labels)) for h in labels)).alias("c")).select(F.inline("c"))


def kappa(rows: DataFrame, labels: tuple[str, ...] = LABELS, by: tuple[str, ...] = ()) -> DataFrame:
    """n, agree, expected and Cohen's kappa, for each group of `by`: 0 for no rows, 1 where agreement is certain."""
    is_ = lambda c, x: F.count_if(F.col(c) == x)
    counts = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("human") == F.col("judge")).alias("agree"), *(is_(c, x).alias(f"{c}_{k}") for c in ("human", "judge") for k, x in enumerate(labels)))
    products = sum((F.col(f"human_{k}") * F.col(f"judge_{k}") for k in range(1, len(labels))), F.col("human_0") * F.col("judge_0"))
    out = counts.select(*by, "n", "agree", F.try_divide(products.cast("double"), (F.col("n") * F.col("n")).cast("double")).alias("expected"))
    observed = F.try_divide(F.col("agree").cast("double"), F.col("n").cast("double"))
    k = F.when(F.col("n") == 0, 0.0).when(F.col("expected") >= 1, 1.0).otherwise(F.try_divide(observed - F.col("expected"), 1 - F.col("expected")))
    return out.withColumn("kappa", k)


def per_class(rows: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """label, tp, fp, fn; precision, recall and F1, 0 where undefined."""
    hit = lambda x, h, j: F.count_if((F.col("human") == x) == F.lit(h)) if j is None else F.count_if(((F.col("human") == x) == F.lit(h)) & ((F.col("judge") == x) == F.lit(j)))
    cells = [F.struct(F.lit(x).alias("label"), hit(x, True, True).alias("tp"), hit(x, False, True).alias("fp"), hit(x, True, False).alias("fn")) for x in labels]
    out = rows.agg(F.array(*cells).alias("c")).select(F.inline("c"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def disagreements(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts by each column alone, by direction and in total: dimension, value, n."""
    differ = rows.filter("human <> judge").withColumn("direction", F.concat(F.lit("human="), "human", F.lit(" -> judge="), "judge"))
    cells = F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in [*by, "direction"]), F.struct(F.lit("total").alias("dimension"), F.lit("all").alias("value")))
    return differ.select(F.inline(cells)).groupBy("dimension", "value").agg(F.count("*").alias("n"))


EXAMPLE = ("pilot_id", "source", "condition", "f1_level", "f1", "question", "gold_answers", "prediction", "human", "judge", "judge_reason")


def disagreement_examples(rows: DataFrame) -> DataFrame:
    """The rows on which the raters differ; what they don't hold of EXAMPLE is null."""
    return rows.filter("human <> judge").select(*(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in EXAMPLE))


def top_directions(rows: DataFrame, k: int = 5) -> DataFrame:
    return disagreements(rows, []).filter("dimension = 'direction'").select(F.col("value").alias("direction"), "n").orderBy(F.desc("n"), "direction").limit(k)


def _checked(judged: DataFrame) -> DataFrame:
    """Duplicates with the label of their originals, and whether both are valid."""
    first = judged.filter("not is_duplicate").select("pilot_id_original", F.col("judge_label").alias("first_label"))
    again = judged.filter("is_duplicate").withColumnRenamed("judge_label", "second_label").join(first, "pilot_id_original", "left")
    return again.withColumn("valid", F.coalesce(F.col("first_label").isin(*LABELS) & F.col("second_label").isin(*LABELS), F.lit(False)))


def consistency(judged: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Duplicates against their originals, for each group of `by`: n compared, agree, skipped (a label isn't valid)."""
    same = F.col("valid") & (F.col("first_label") == F.col("second_label"))
    return _checked(judged).groupBy(*by).agg(F.count_if("valid").alias("n"), F.count_if(same).alias("agree"), F.count_if(~F.col("valid")).alias("skipped"))


def consistency_cases(judged: DataFrame) -> DataFrame:
    """Each duplicate that was compared: pilot_id of the original, first_label, second_label, consistent."""
    same = F.col("first_label") == F.col("second_label")
    return _checked(judged).filter("valid").select(F.col("pilot_id_original").alias("pilot_id"), "first_label", "second_label", same.alias("consistent"))


def kappa_band(k: Column) -> Column:
    return F.when(k >= 0.8, "almost perfect").when(k >= 0.6, "substantial").when(k >= 0.4, "moderate").otherwise("poor")


def decision(k: Column, consistent: Column) -> Column:
    """From kappa and the percentage of duplicates that were judged alike."""
    return F.when((k >= 0.6) & (consistent >= 80), "PROCEED").when(k >= 0.4, "REFINE").otherwise("REDESIGN")
