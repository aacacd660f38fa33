"""Seeded samples with exact quotas. Draws follow md5 of the seed and the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.score import first_of_each
from ..storage import mark, release, stored


def seeded(seed: int, key: str = "id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def seeded_rank(by: list[str], seed: int = 42, key: str = "id") -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(seeded(seed, key), key))


def first_ranks(rows: DataFrame, by: list[str], most: int, seed: int = 42, key: str = "id", name: str = "_r") -> DataFrame:
    """The rows of rank 1 .. most in each stratum, with the rank. A literal bound, so that each task passes on `most` rows only."""
    return rows.withColumn(name, seeded_rank(by, seed, key)).filter(F.col(name) <= most)


def stratified_cap(rows: DataFrame, most: int, by: str = "source", seed: int = 42) -> DataFrame:
    """most // strata rows of each stratum, if there are more than `most` in all."""
    facts = rows.agg(F.count("*").alias("n"), F.countDistinct(by).alias("k")).first()
    if facts.n <= most:
        return rows
    return first_ranks(rows, [by], most // max(1, facts.k), seed).drop("_r")


def cell_sample(rows: DataFrame, size: int, levels: dict[str, int], by: list[str], level: str = "f1_level", seed: int = 42) -> DataFrame:
    """Of each cell: each level's quota, then others up to `size`."""
    quota = F.create_map(*(F.lit(x) for kv in levels.items() for x in kv))
    # no cell takes more than `size` rows of a level
    ranked = first_ranks(rows, [*by, level], size, seed, name="_in")
    ranked = ranked.withColumn("_first", (F.col("_in") <= F.coalesce(quota[F.col(level)], F.lit(0))).cast("int"))
    order = Window.partitionBy(*by).orderBy(F.desc("_first"), seeded(seed), "id")
    return ranked.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= size).drop("_in", "_first", "_r")


def numbered(rows: DataFrame, name: str, *order) -> DataFrame:
    """Sequential numbers (long, from 1) over a total order: rows are sorted by ranges into a table, and the sizes of the ranges,
    one row for each task, give what is added to the places within them. No task holds more than a range."""
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    spark, since = rows.sparkSession, mark()
    rows = stored(rows, "rows")  # a sort by ranges looks at its input twice
    placed = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    release(spark, since, placed)
    task = F.shiftright("_at", 33)
    offsets, before = [], 0
    for r in sorted(placed.groupBy(task.alias("t")).count().collect()):
        offsets.append((r.t, before))
        before += r["count"]
    found = spark.createDataFrame(offsets, "_t long, _before long")
    out = placed.withColumn("_t", task).join(F.broadcast(found), "_t")
    return out.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_t", "_before", "_at")


def proportional_quotas(rows: DataFrame, size: int, bucket: str = "bucket") -> DataFrame:
    """Quota of each bucket, in order of first appearance by ord: half-even shares of `size`, the last takes what is left, and
    none takes more than what is left. A fold over one row that has the sizes of all buckets."""
    sizes = rows.groupBy(bucket).agg(F.count("*").alias("pool"), F.min("ord").alias("_o"))
    kind = f"struct<{bucket}:{rows.schema[bucket].dataType.simpleString()},pool:bigint,quota:bigint>"
    held = sizes.agg(F.array_sort(F.collect_list(F.struct("_o", F.col(bucket).alias("bucket"), "pool"))).alias("b"), F.sum("pool").alias("total"))
    held = held.withColumn("b", F.transform("b", lambda x, i: F.struct(x["bucket"].alias("bucket"), x["pool"].alias("pool"), (i == F.size("b") - 1).alias("last"))))
    start = F.struct(F.lit(size).cast("long").alias("left"), F.array().cast(f"array<{kind}>").alias("done"))

    def taken(state, x):
        share = F.bround(size * x["pool"] / F.col("total")).cast("long")
        quota = F.when(F.col("total") <= size, x["pool"]).otherwise(F.least(F.when(x["last"], state["left"]).otherwise(share), state["left"], x["pool"]))
        one = F.struct(x["bucket"].alias(bucket), x["pool"].alias("pool"), quota.alias("quota")).cast(kind)
        return F.struct((state["left"] - quota).alias("left"), F.concat(state["done"], F.array(one)).alias("done"))

    return held.select(F.inline(F.aggregate("b", start, taken, lambda state: state["done"])))


def proportional_sample(rows: DataFrame, size: int, bucket: str = "bucket", seed: int = 42) -> DataFrame:
    """rows: id, ord, bucket. Quota of each bucket, then a top-up from the rest to `size`."""
    quotas = proportional_quotas(rows, size, bucket)
    # no bucket gives more than `size` rows
    ranked = first_ranks(rows, [bucket], size, seed).join(F.broadcast(quotas), bucket)
    ranked = ranked.withColumn("_in", (F.col("_r") <= F.col("quota")).cast("int"))
    return ranked.orderBy(F.desc("_in"), seeded(seed), "id").limit(size).select(*rows.columns)


def sample_sources(rows: DataFrame, targets: dict[str, int], seed: int = 42) -> DataFrame:
    """Source by source in the order of targets; questions taken for an earlier source are not taken again."""
    taken = None
    for source, size in targets.items():
        pool = first_of_each(rows.filter(F.col("source") == source), ["question"], "ord")
        if taken is not None:
            pool = pool.join(taken.select("question"), "question", "left_anti").select(*rows.columns)
        picked = proportional_sample(pool, size, seed=seed).select(*rows.columns)
        taken = picked if taken is None else taken.unionByName(picked)
    return taken


def with_duplicates(rows: DataFrame, size: int, seed: int = 99) -> DataFrame:
    """rows (pilot_id) and `size` of them again as consistency checks, under "{id}_dup"."""
    again = rows.orderBy(seeded(seed, "pilot_id"), "pilot_id").limit(size)
    marked = lambda x, dup: x.withColumns({"pilot_id_original": F.col("pilot_id"), "is_duplicate": F.lit(dup), "pilot_id": F.concat(F.col("pilot_id").cast("string"), F.lit("_dup" if dup else ""))})
    return marked(rows, False).unionByName(marked(again, True))
