"""Paired examples and ratings derived from the synthetic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import NOT_WORD

MARKED, BARE = "éèêóíñüöäçÉÈÊÓÍÑÜÖÄÇ", "eeeoinuoacEEEOINUOAC"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text):
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda t: t != "")


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, source and whole texts as token arrays: golds are the plain and the marked text, in turn by id; the base prediction
    is plain, the treated one marked, with a word more in every third row."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("id", "source", words(F.col("text")).alias("w"), words(F.translate("text", MARKED, BARE)).alias("pw"))
    even, third = F.col("id") % 2 == 0, F.col("id") % 3 == 0
    return d.select(
        "id", "source", F.when(even, F.col("pw")).otherwise(F.col("w")).alias("gold"), F.when(even, F.col("w")).otherwise(F.col("pw")).alias("gold2"), F.col("pw").alias("base"),
        F.when(third, F.concat("w", F.array(F.lit("x")))).otherwise(F.col("w")).alias("treated"),
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's turn and the assistant's next."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations")
    c = c.withColumns({"next_role": F.lead("role").over(w), "answer": F.lead("text").over(w)})
    return c.filter("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    rows = table(spark, sf_dir, "labels").join(d, "doc_id")
    label = lambda c: F.when(c, "CORRECT").otherwise("INCORRECT")
    return rows.select("doc_id", "lang", "source", label(F.col("quality") == 1).alias("human"), label(F.col("n_chars") >= 500).alias("judge"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    label = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_id") % 2 == 0, "CORRECT").otherwise("INCORRECT")
    return e.select("event_id", "user_id", "ts", "event_type", label.alias("judge_label"))
