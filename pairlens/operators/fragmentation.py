"""Token counts of two conditions against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_count

#: Counters that need no model; others are columns made by providers.apply.
COUNTERS = {"bytes": F.octet_length, "chars": F.length, "words": word_count}


def token_totals(rows: DataFrame, count: Column) -> DataFrame:
    return rows.groupBy("source").agg(F.sum(count).cast("long").alias("tokens"))


def fragmentation(plain: DataFrame, marked: DataFrame, delta: DataFrame | None = None) -> DataFrame:
    """Per source in both: no_tok_count, with_tok_count, frag_ratio (null for no tokens), and n and delta_f1 where delta
    (source, n, delta_f1) has them."""
    out = plain.withColumnRenamed("tokens", "no_tok_count").join(marked.withColumnRenamed("tokens", "with_tok_count"), "source")
    out = out.withColumn("frag_ratio", F.try_divide(F.col("with_tok_count").cast("double"), F.col("no_tok_count").cast("double")))
    return out if delta is None else out.join(delta, "source", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def sampled_ids(plain: DataFrame, marked: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """Ids in both, at most `size` for each source, in order of a seeded hash."""
    from .sampling import seeded_rank

    both = plain.select("id", "source").join(marked.select("id"), "id", "left_semi")
    return both.withColumn("_r", seeded_rank(["source"], seed)).filter(F.col("_r") <= size).drop("_r")


def pearson(points: DataFrame, x: str, y: str) -> DataFrame:
    """r (population); null for fewer than two points or a constant side."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return points.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.when(F.count("*") >= 2, F.try_divide(F.covar_pop(x, y), spread)).alias("r"), F.count("*").alias("n"))


def interpretation(r: Column) -> Column:
    """The order of the branches decides at the borders."""
    return F.when(r.isNull(), "Undefined").when(r < -0.5, "Strong negative").when(r < -0.2, "Moderate negative").when(F.abs(r) < 0.2, "None").otherwise("Positive")
