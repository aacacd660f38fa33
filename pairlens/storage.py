"""Tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import functools
import re
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which a query's shuffle files go once it is done.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class _Made(threading.local):
    """Paths made by this thread and not yet deleted, oldest first."""

    def __init__(self):
        self.paths: list[str] = []


_MADE = _Made()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only a session on one machine may leave it unset; it then has a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return _own()


@functools.cache
def _own() -> str:
    path = tempfile.mkdtemp(prefix="pairlens-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, deleted by release()."""
    path = f"{shared_dir(spark)}/pairlens-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _MADE.paths.append(path)
    return path


_LOCK = threading.Lock()
#: Of each session: how many threads write a table now, and what the setting was before the first of them.
_WRITING: dict[SparkSession, tuple[int, str]] = {}


@contextlib.contextmanager
def _without_leftovers(spark: SparkSession):
    """The setting holds while any thread of the session writes a table; the last one puts back what was there before."""
    with _LOCK:
        n, before = _WRITING.get(spark, (0, spark.conf.get(_CLEANUP, "false")))
        _WRITING[spark] = (n + 1, before)
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _LOCK:
            n, before = _WRITING.pop(spark)
            if n > 1:
                _WRITING[spark] = (n - 1, before)
            else:
                spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage is cut, and lost executors cost no more than one stage.
    The shuffle files behind it go once it is written."""
    path = scratch(df.sparkSession, name)
    with _without_leftovers(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def mark() -> int:
    return len(_MADE.paths)


def release(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Deletes what this thread has stored since the mark, but for the tables of `keep`. No other frame that reads them may be
    used again; tables of other threads stay."""
    held = {getattr(x, "_stored_at", None) for x in keep}
    gone = [p for p in _MADE.paths[since:] if p not in held]
    _MADE.paths[since:] = [p for p in _MADE.paths[since:] if p in held]
    conf, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    for p in gone:
        path(p).getFileSystem(conf).delete(path(p), True)


def unused(names: list[str], wanted: str) -> str:
    """`wanted`, or the first of wanted_1, wanted_2, ... that isn't among the names (in any case of letters)."""
    held, found, k = {n.lower() for n in names}, f"_{wanted}", 0
    while found.lower() in held:
        found, k = f"_{wanted}_{k + 1}", k + 1
    return found
