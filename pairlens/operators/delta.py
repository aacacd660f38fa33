"""Deltas between two conditions of the same examples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import Dialect
from ..functions.score import bag_f1, exact_match, last_of_each, token_f1
from ..functions.text import tokens


def scored(rows: DataFrame, dialect: Dialect) -> DataFrame:
    """rows: prediction, answers. Adds em and f1; tokens are made once, as columns."""
    rows = rows.withColumns({"_p": tokens(F.col("prediction"), dialect), "_g": F.transform("answers", lambda a: tokens(a, dialect))})
    return rows.withColumns({"em": exact_match(F.col("_p"), F.col("_g")), "f1": token_f1(F.col("_p"), F.col("_g"))}).drop("_p", "_g")


def scored_long(rows: DataFrame, key: str, dialect: Dialect) -> DataFrame:
    """key (one row each), em and f1 of rows (key, prediction, answers), in time linear in the texts: a row for each answer,
    whose words are counted instead of compared."""
    held = rows.select(key, tokens(F.col("prediction"), dialect).alias("_p"), "answers")
    held = held.select(key, "_p", F.explode_outer(F.sequence(F.lit(0), F.greatest(F.size("answers"), F.lit(1)) - 1)).alias("_n"), "answers")
    held = held.withColumns({"_none": F.coalesce(F.size("answers"), F.lit(0)) < 1, "_g": tokens(F.get("answers", F.col("_n")), dialect)})
    held = held.withColumn("_one", F.struct(F.col(key), "_n"))
    em = (~F.col("_none") & (F.col("_p") == F.col("_g"))).cast("int").alias("em")
    ones = bag_f1(held, "_one", {"f1": ("_p", "_g")}, (F.col(key), F.col("_none"), em))
    return ones.groupBy(key).agg(F.max("em").alias("em"), F.max(F.when(F.col("_none"), 0.0).otherwise(F.col("f1"))).alias("f1"))


def paired(base: DataFrame, treated: DataFrame, order: str | None = None) -> DataFrame:
    """id, source, base_* and treated_* of ids in both; of an id's rows the last by `order` counts."""
    if order:
        base, treated = (last_of_each(x, ["id"], order) for x in (base, treated))
    t = treated.select("id", F.col("em").alias("treated_em"), F.col("f1").alias("treated_f1"), F.col("prediction").alias("treated_pred"))
    b = base.select("id", "source", F.col("em").alias("base_em"), F.col("f1").alias("base_f1"), F.col("prediction").alias("base_pred"))
    both = b.join(t, "id")
    return both.withColumns({"delta_em": F.col("treated_em") - F.col("base_em"), "delta_f1": F.bround(F.col("treated_f1") - F.col("base_f1"), 4)})


def unmatched(base: DataFrame, treated: DataFrame) -> DataFrame:
    return base.join(treated.select("id"), "id", "left_anti")


def _exact(c: str):
    """Sums of four-digit numbers that don't depend on their order."""
    return F.sum(F.col(c).cast("decimal(18,4)")).cast("double")


def delta_by_source(pairs: DataFrame) -> DataFrame:
    """One row for each source and one for all (`overall`): counts and exact sums; report.py makes percentages of them."""
    rolled = pairs.rollup("source").agg(
        F.count("*").alias("n"), F.sum("base_em").alias("base_em_hits"), F.sum("treated_em").alias("treated_em_hits"), _exact("base_f1").alias("base_f1_sum"), _exact("treated_f1").alias("treated_f1_sum"),
        _exact("delta_f1").alias("delta_f1_sum"), F.count_if(F.col("delta_em") > 0).alias("helped"), F.count_if(F.col("delta_em") < 0).alias("hurt"), F.grouping("source").alias("_all"),
    )
    return rolled.withColumn("source", F.when(F.col("_all") == 1, "overall").otherwise(F.col("source"))).drop("_all")


def verbosity(pairs: DataFrame) -> DataFrame:
    """Per source and for all: churn (helped and hurt), sums of the words of both predictions and of their difference, means
    of the words. pairs: base_len, treated_len, delta_em."""
    rolled = pairs.rollup("source").agg(
        F.count("*").alias("n"), F.count_if(F.col("delta_em") != 0).alias("churn"), F.sum("base_len").alias("base_len_sum"), F.sum("treated_len").alias("treated_len_sum"),
        F.sum(F.col("treated_len") - F.col("base_len")).alias("delta_len"), F.grouping("source").alias("_all"),
    )
    mean = lambda c: F.col(f"{c}_sum").cast("double") / F.col("n")
    rolled = rolled.withColumns({"base_len_mean": mean("base_len"), "treated_len_mean": mean("treated_len"), "source": F.when(F.col("_all") == 1, "overall").otherwise(F.col("source"))})
    return rolled.drop("_all")


def of_source(rows: DataFrame, prefix: str) -> DataFrame:
    """Rows whose id begins with the prefix, with raw_id for what follows it."""
    return rows.filter(F.startswith("id", F.lit(prefix))).withColumn("raw_id", F.substring("id", len(prefix) + 1, 1 << 30))


def compared(filtered: DataFrame, original: DataFrame, key: str = "model") -> DataFrame:
    """Filtered figures beside those of all rows, for models that have both."""
    side = lambda x, name: x.select(key, *(F.col(c).alias(f"{name}_{c}") for c in x.columns if c != key))
    return side(original, "original").join(side(filtered, "filtered"), key)


def score_by_source(rows: DataFrame, lengths: bool = False) -> DataFrame:
    more = [F.sum("pred_len_words").alias("pred_len_sum")] if lengths else []
    rolled = rows.rollup("source").agg(F.count("*").alias("n"), F.sum("em").alias("em_hits"), _exact("f1").alias("f1_sum"), *more, F.grouping("source").alias("_all"))
    return rolled.withColumn("source", F.when(F.col("_all") == 1, "overall").otherwise(F.col("source"))).drop("_all")


def filtered_delta(pairs: DataFrame, quality: DataFrame, keep: list, order: str, column: str = "quality") -> DataFrame:
    """Sums over the pairs whose quality is one of keep; rows without one go. quality (id, quality) is a lookup table, in which
    the last row of an id, by the column `order`, counts."""
    lookup = last_of_each(quality.select("id", column, order), ["id"], order).filter(F.col(column).isin(*keep))
    return sums(pairs.join(lookup.select("id"), "id", "left_semi"))


def sums(pairs: DataFrame, *by: str) -> DataFrame:
    return pairs.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum("base_em").alias("base_em_hits"), F.sum("treated_em").alias("treated_em_hits"), _exact("base_f1").alias("base_f1_sum"), _exact("treated_f1").alias("treated_f1_sum"),
        F.count_if((F.col("base_em") == 0) & (F.col("treated_em") == 1)).alias("helped"), F.count_if((F.col("base_em") == 1) & (F.col("treated_em") == 0)).alias("hurt"),
    )
