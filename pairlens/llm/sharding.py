"""A table of small immutable shards, compacted by size tiers, with versioned manifests.

Arrivals are appended as shards: directories of Parquet files that never change. A compaction merges runs of at least
`fan_in` shards of one size tier (sizes within a power of fan_in) into files of about target_bytes. A shard of
target_bytes or more whose files are small, or far larger than target_bytes, is a run of its own; what is in files of about
target_bytes is settled and left alone. No row is shuffled: a merge reads its run's files and writes them in fewer, or cuts
them by numbers of records.

A manifest lists the live shards of one version: those that may still be merged by themselves, settled ones in parts of up to
PART entries that versions share. As nothing takes a settled shard out, a commit writes the open shards, the names of the parts
and at most one part again, whatever the store holds; a plan reads the open shards alone. Only read(), shards() and vacuum() read
all parts, in one job; the paths of all shards then pass through the driver, as those of any table of files do.

A compaction merges all runs of a round at the same time, AT_ONCE jobs side by side, and commits them together. If a job fails,
the others' merges are committed before its error is raised.

A manifest is written to a name of its own and then renamed to the version's name.
The rename must fail if that name is there, or else two writers can both believe that they were first: SAFE names the file
systems that keep this promise, and on any other a store must be opened with single_writer. A writer that wasn't first plans
its change again from the newer version; merges whose run is gone by then are dropped and planned again. A commit checks that
the files it adds are there. vacuum() removes what is older than its grace period and in no version that was the last one within
that time, so that readers keep their files and a writer can finish what it has begun.

All files are reached through Hadoop's file system.

Defined cases: an empty arrival adds a shard without rows only if nothing else is there to give the schema; null and
repeated rows are kept as they are; no name of a column is reserved; unused shards of a failed commit are removed by vacuum().
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor, wait
from dataclasses import asdict, dataclass, replace

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import scratch
from ._shared import unused

TARGET_BYTES, FAN_IN = 128 << 20, 4
#: File systems whose rename is atomic and refuses a name that is taken.
SAFE = ("file", "hdfs", "viewfs", "ofs", "o3fs", "abfs", "abfss")
#: Entries of settled shards in one part of a manifest, and merges that run at the same time.
PART, AT_ONCE = 1000, 8
ENTRY = "name string, bytes long, files int, settled boolean"
#: Seconds for which vacuum() leaves what no manifest lists.
GRACE = 24 * 3600


@dataclass(frozen=True)
class Shard:
    name: str
    bytes: int
    files: int
    settled: bool = False


class ManifestConflict(Exception):
    """Another writer has committed the version."""


def tiers(shards: list[Shard], fan_in: int, target: int) -> list[list[Shard]]:
    """Runs to merge: for each tier below the target, its shards if there are at least fan_in of them; and each larger
    shard whose files have less than half the target on average, or more than twice."""
    by: dict[int, list[Shard]] = {}
    alone = []
    for s in sorted((s for s in shards if not s.settled), key=lambda s: (s.bytes, s.name)):
        if s.bytes < target:
            tier, top = 0, 1 << 20
            while s.bytes > top:
                tier, top = tier + 1, top * fan_in
            by.setdefault(tier, []).append(s)
        elif s.bytes * 2 < s.files * target or s.bytes > 2 * s.files * target:
            alone.append([s])
    return [run for _, run in sorted(by.items()) if len(run) >= fan_in] + alone


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN, single_writer: bool = False):
        self.spark, self.root, self.target, self.fan_in = spark, root.rstrip("/"), target_bytes, fan_in
        self.jvm = spark._jvm
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        if not single_writer and self.fs.getUri().getScheme() not in SAFE:
            raise ValueError(f"{self.fs.getUri().getScheme()} doesn't promise a rename that only one writer can win; open the store with single_writer")

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def versions(self) -> list[int]:
        at = self._path(f"{self.root}/manifests")
        if not self.fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(at)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def _manifest(self, version: int | None = None) -> tuple[int, list[Shard], list[tuple[str, int]]]:
        """The version (the last one; 0 if there is none), its open shards, and its parts: name and number of entries."""
        if version is None:
            version = (self.versions() or [0])[-1]
        if not version:
            return 0, [], []
        stream = self.fs.open(self._path(f"{self.root}/manifests/v{version:012d}.json"))
        held = json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        stream.close()
        return version, [Shard(**s) for s in held["shards"]], [(n, k) for n, k in held.get("parts", [])]

    def _listed(self, parts: Iterable[tuple[str, int]]) -> list[Shard]:
        """The settled shards of parts, by name."""
        paths = [f"{self.root}/{n}" for n, _ in parts]
        rows = self.spark.read.schema(ENTRY).json(paths).collect() if paths else []
        return sorted((Shard(**r.asDict()) for r in rows), key=lambda s: s.name)

    def shards(self, version: int | None = None) -> list[Shard]:
        _, live, parts = self._manifest(version)
        return live + self._listed(parts)

    def _written(self, name: str, text: str):
        at = self._path(f"{self.root}/{name}")
        out = self.fs.create(at, False)
        out.write(bytearray(text.encode()))
        out.close()
        return at

    def _grown(self, parts: list[tuple[str, int]], settled: list[Shard]) -> list[tuple[str, int]]:
        """The parts with more settled shards: only a last part that isn't full is written again."""
        if settled and parts and parts[-1][1] < PART:
            parts, settled = parts[:-1], self._listed(parts[-1:]) + settled
        new = []
        for k in range(0, len(settled), PART):
            new.append((f"parts/{uuid.uuid4().hex}.json", len(settled[k : k + PART])))
            self._written(new[-1][0], "\n".join(json.dumps(asdict(s)) for s in settled[k : k + PART]))
        return parts + new

    def commit(self, version: int, shards: list[Shard], parts: Iterable[tuple[str, int]] = ()) -> None:
        own = self._written(f"manifests/.{uuid.uuid4().hex}", json.dumps({"version": version, "shards": [asdict(s) for s in shards], "parts": list(parts)}))
        to = self._path(f"{self.root}/manifests/v{version:012d}.json")
        if self.fs.exists(to) or not self.fs.rename(own, to):
            self.fs.delete(own, False)
            raise ManifestConflict(version)

    def _change(self, added: list[Shard], merged: Iterable[tuple[list[Shard], Shard]] = ()) -> tuple[int, list[Shard]]:
        """Commits arrivals and merges (a run and its new shard) as one version. Returns the version, and the new shards of merges
        that it has: a run of which another writer has taken a shard isn't replaced."""
        for s in [*added, *(new for _, new in merged)]:
            if s.files and not self._measured(s.name).files:
                raise FileNotFoundError(f"{self.root}/{s.name}")
        while True:
            version, live, parts = self._manifest()
            there = set(live)
            done = [(run, new) for run, new in merged if there.issuperset(run)]
            if not added and not done:
                return version, []
            gone = {s for run, _ in done for s in run}
            now = [s for s in live if s not in gone] + added + [new for _, new in done]
            try:
                self.commit(version + 1, [s for s in now if not s.settled], self._grown(parts, [s for s in now if s.settled]))
                return version + 1, [new for _, new in done]
            except ManifestConflict:
                continue

    def _measured(self, name: str) -> Shard:
        at = self._path(f"{self.root}/{name}")
        files = [s for s in (self.fs.listStatus(at) if self.fs.exists(at) else ()) if s.getPath().getName().startswith("part-")]
        return Shard(name, sum(s.getLen() for s in files), len(files))

    def append(self, rows: DataFrame, by: str | None = None) -> int:
        """One shard, or with `by` one for each of its values (an arrival each), in one job. `by` isn't stored."""
        run = f"shards/{uuid.uuid4().hex}"
        if by is None:
            rows.write.parquet(f"{self.root}/{run}")
            return self._change([self._measured(run)])[0]
        # directories are named after a column; a name that begins with _ would hide them
        key, held = "by", {c.lower() for c in rows.columns}
        while key in held:
            key += "_"
        rows.withColumnRenamed(by, key).write.partitionBy(key).parquet(f"{self.root}/{run}")
        parts = sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(f"{self.root}/{run}")) if s.isDirectory())
        added = [self._measured(f"{run}/{p}") for p in parts if "=" in p]
        if not added and not self.shards():
            return self.append(rows.limit(0).drop(by))
        return self._change(added)[0]

    def compact(self) -> int:
        """Merges until no tier has a run; returns the number of merges."""
        merges = 0
        while runs := tiers(self._manifest()[1], self.fan_in, self.target):
            with ThreadPoolExecutor(AT_ONCE) as pool:
                tasks = [pool.submit(inheritable_thread_target(self.spark)(self._merged), run) for run in runs]
                wait(tasks)
            made = [(run, t.result()) for run, t in zip(runs, tasks) if not t.exception()]
            done = set(self._change([], made)[1])
            for _, new in made:
                if new not in done:  # another writer has merged the run: what is live now is planned anew
                    self.fs.delete(self._path(f"{self.root}/{new.name}"), True)
            for t in tasks:
                t.result()  # the error of a merge that failed
            merges += len(done)
        return merges

    def _merged(self, run: list[Shard]) -> Shard:
        held, name = sum(s.bytes for s in run), f"shards/{uuid.uuid4().hex}"
        files, rows = max(1, round(held / self.target)), self._read(run)
        if files <= sum(s.files for s in run):
            rows.coalesce(files).write.parquet(f"{self.root}/{name}")
        else:  # files that are too large are cut
            rows.write.option("maxRecordsPerFile", max(1, -(-rows.count() // files))).parquet(f"{self.root}/{name}")
        new = self._measured(name)
        return replace(new, settled=new.files > 1 or new.bytes * 2 > self.target)

    def _read(self, shards: list[Shard]) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.root}/{s.name}" for s in shards))

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self.shards(version))

    def vacuum(self, grace: float = GRACE) -> int:
        """Removes shards, parts and manifests of versions that have been replaced for `grace` seconds or longer, and files of
        that age in no version; returns how many shards."""
        until = (time.time() - grace) * 1000
        old = lambda at: self.fs.getFileStatus(at).getModificationTime() <= until
        manifest = lambda v: self._path(f"{self.root}/manifests/v{v:012d}.json")
        versions = self.versions()
        kept = [v for v, after in zip(versions, versions[1:]) if not old(manifest(after))] + versions[-1:]
        held = [self._manifest(v) for v in kept]
        parts = {p for _, _, ps in held for p in ps}
        live, gone = {s.name for _, shards, _ in held for s in shards} | {s.name for s in self._listed(parts)}, 0
        top = self._path(f"{self.root}/shards")
        for run in self.fs.listStatus(top) if self.fs.exists(top) else ():
            name = f"shards/{run.getPath().getName()}"
            inside = [f"{name}/{p.getPath().getName()}" for p in self.fs.listStatus(run.getPath()) if p.isDirectory() and "=" in p.getPath().getName()]
            for x in inside or [name]:
                if x not in live and old(self._path(f"{self.root}/{x}")):
                    self.fs.delete(self._path(f"{self.root}/{x}"), True)
                    gone += 1
            if inside and not any(p in live for p in inside) and old(run.getPath()):
                self.fs.delete(run.getPath(), True)
        names, top = {n for n, _ in parts}, self._path(f"{self.root}/parts")
        for part in self.fs.listStatus(top) if self.fs.exists(top) else ():
            if f"parts/{part.getPath().getName()}" not in names and old(part.getPath()):
                self.fs.delete(part.getPath(), False)
        for v in set(versions) - set(kept):
            self.fs.delete(manifest(v), False)
        return gone


ARRIVALS = 16


def _compacted(spark, sf_dir: str) -> tuple[ShardStore, int]:
    """Documents that have arrived in ARRIVALS shards and were compacted; and how many shards there were before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = ShardStore(spark, scratch(spark, "shards"), single_writer=True)
    arrival = unused(docs.columns, "arrival")
    store.append(docs.withColumn(arrival, F.pmod(F.coalesce(F.col("doc_id"), F.lit(0)), F.lit(ARRIVALS))), by=arrival)
    before = len(store.shards())
    store.compact()
    store.vacuum(grace=0)  # nobody else knows this store
    return store, before


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    """What is read back from the compacted store: doc_id, n_bytes and text_sha256 (null for a null text)."""
    store, _ = _compacted(spark, sf_dir)
    return store.read().select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"))


def sharding_layout(spark, sf_dir: str) -> DataFrame:
    """The live shards of the compacted store, as its manifest has them: shard, bytes, files, settled, n_rows; and the number
    of shards before. SQL has no notion of it."""
    store, before = _compacted(spark, sf_dir)
    rows = store.read().select(F.col("_metadata.file_path").alias("f")).groupBy(F.regexp_extract("f", r"(shards/.*)/[^/]*$", 1).alias("shard")).count().withColumnRenamed("count", "n_rows")
    live = spark.createDataFrame([(s.name, s.bytes, s.files, s.settled, before) for s in store.shards()], "shard string, bytes long, files int, settled boolean, shards_before int")
    return live.join(rows, "shard", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0).cast("long")))


OP7_SQL = "SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, sha256(text) AS text_sha256 FROM documents"
