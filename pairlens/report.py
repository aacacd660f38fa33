"""Percentages and rounding, and sinks for reports. Only here are rows brought to the driver: aggregates."""

from __future__ import annotations

import contextlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import scratch


def percent(hits: float, n: int, digits: int = 2) -> float | None:
    return round(hits / n * 100, digits) if n else None


def mean_of_deltas(delta_sum: float, n: int) -> float:
    """From the mean of deltas that were rounded one by one."""
    return round(delta_sum / n * 100, 2)


def delta_of_raw(treated: float, base: float) -> float:
    return round(treated - base, 2)


def delta_of_rounded(treated: float | None, base: float | None) -> float | None:
    return None if treated is None or base is None else round(treated - base, 2)


def judge_block(row: dict) -> dict:
    n = row["n"]
    plain, marked = percent(row["plain_hits"], n), percent(row["marked_hits"], n)
    return {"n": n, "plain": plain, "marked": marked, "delta": delta_of_rounded(marked, plain), "harmed": percent(row["ci"], n), "helped": percent(row["ic"], n), "net_churn": row["net_churn"]}


def ordered(rows: DataFrame, key: str = "source", last: str = "overall") -> DataFrame:
    """Report rows by key, the grand total last."""
    return rows.orderBy(F.col(key) == last, key)


def delta_block(row: dict) -> dict:
    """Percentages of a row of delta_by_source."""
    n = row["n"]
    return {
        "n": n, "base_em": percent(row["base_em_hits"], n), "treated_em": percent(row["treated_em_hits"], n), "delta_em": percent(row["treated_em_hits"] - row["base_em_hits"], n),
        "base_f1": percent(row["base_f1_sum"], n), "treated_f1": percent(row["treated_f1_sum"], n), "delta_f1": mean_of_deltas(row["delta_f1_sum"], n), "helped": percent(row["helped"], n), "hurt": percent(row["hurt"], n),
    }


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file written by the driver, in any store that Spark can write."""
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = to.getFileSystem(spark._jsc.hadoopConfiguration()).create(to, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_json(frame: DataFrame, path: str) -> None:
    """A report (aggregates, in the frame's order) as one pretty document."""
    write_text(frame.sparkSession, path, json.dumps([r.asDict(True) for r in frame.collect()], ensure_ascii=False, indent=2, default=str))


def write_document(spark: SparkSession, path: str, head: dict, name: str, rows: DataFrame) -> None:
    """One JSON document of `head` and, as its last entry `name`, an array of all rows, each on a line of its own, as
    ingest.read_document() reads it. Tasks write the rows; their files are strung together."""
    parts = scratch(spark, "fragments")
    one = F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns)), {"ignoreNullFields": "false"})
    rows.select(F.concat(F.lit(","), one).alias("value")).write.text(parts)
    opened = json.dumps(head, ensure_ascii=False, indent=2)[:-1].rstrip()
    # the first row has no comma before it
    _string(spark, parts, path, f"{opened}{',' if head else ''}\n  {json.dumps(name)}: [\n", "  ]\n}\n", skip=1)


def write_lines(lines: DataFrame, path: str, *order: str) -> None:
    """One text file of the lines `value`, in the order of the given columns, which tasks sort by ranges."""
    parts = scratch(lines.sparkSession, "fragments")
    lines.orderBy(*order).select("value").write.text(parts)
    _string(lines.sparkSession, parts, path)


def _string(spark: SparkSession, parts: str, path: str, head: str = "", tail: str = "", skip: int = 0) -> None:
    """The files that tasks have written to `parts`, in their order and without the first `skip` bytes, as one file between head
    and tail. The file system copies them, a block at a time; the file appears under its name when it is whole."""
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    at, to, draft = hadoop.fs.Path(parts), hadoop.fs.Path(path), hadoop.fs.Path(f"{path}.part")
    system = to.getFileSystem(conf)
    files = sorted((x for x in at.getFileSystem(conf).listStatus(at) if x.getLen() and x.getPath().getName().startswith("part-")), key=lambda x: x.getPath().getName())
    out = system.create(draft, True)
    out.write(bytearray(head.encode()))
    for k, x in enumerate(files):
        with contextlib.closing(x.getPath().getFileSystem(conf).open(x.getPath())) as part:
            part.seek(skip if k == 0 else 0)
            hadoop.io.IOUtils.copyBytes(part, out, 1 << 16, False)
    out.write(bytearray(tail.encode()))
    out.close()
    system.delete(to, False)
    system.rename(draft, to)


def write_examples(frame: DataFrame, path: str, mode: str = "errorifexists") -> None:
    frame.write.mode(mode).json(path)


def write_blinded(frame: DataFrame, path: str) -> None:
    frame.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def write_ids(frame: DataFrame, path: str, column: str = "example_id") -> None:
    frame.select(frame[column].cast("string")).write.text(path)


def write_metadata(frame: DataFrame, path: str) -> None:
    frame.write.mode("errorifexists").option("header", True).csv(path)


def mirror(frame: DataFrame, path: str) -> None:
    """A directory {source}.jsonl for each source, as read_directory() reads it."""
    spark = frame.sparkSession
    frame.write.partitionBy("source").json(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in fs.listStatus(at):
        name = found.getPath().getName()
        if name.startswith("source="):
            fs.rename(found.getPath(), spark._jvm.org.apache.hadoop.fs.Path(at, f"{name[7:]}.jsonl"))


def table(rows: list[dict]) -> str:
    if not rows:
        return ""
    cols = list(rows[0])
    wide = [max(len(str(r[c])) for r in [dict(zip(cols, cols, strict=True)), *rows]) for c in cols]
    return "\n".join("  ".join(str(r[c]).ljust(w) for c, w in zip(cols, wide, strict=True)).rstrip() for r in [dict(zip(cols, cols, strict=True)), *rows])


# fixed values: the price of a call, the margin of the upper estimate, seconds a call
CALL_COST, MARGIN, CALL_SECONDS = 0.02 / 105, 1.20, 3.24


def estimate(rows: int, seconds_a_call: float = CALL_SECONDS, workers: int = 4) -> dict:
    cost = rows * CALL_COST
    return {"calls": rows, "cost_low": round(cost, 2), "cost_high": round(cost * MARGIN, 2), "minutes": rows * seconds_a_call / workers / 60}


def progress(done: int, total: int, errors: int, elapsed: float) -> dict:
    """How far a stage is, and the hours it has to go at its rate so far."""
    rate = done / elapsed if elapsed > 0 else 0
    return {"done": done, "total": total, "percent": percent(done, total, 1), "errors": errors, "cost": round(done * CALL_COST, 2), "eta_hours": round((total - done) / rate / 3600, 1) if rate else 0.0}


def progress_of(ledger: DataFrame, total: int, elapsed: float) -> dict:
    found = ledger.agg(F.count("*").alias("n"), F.count_if(F.col("judge_label") == "ERROR").alias("errors")).first()
    return progress(found.n, total, found.errors, elapsed)
