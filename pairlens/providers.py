"""Models behind one interface: generation, diacritization, token counts, judging. Rows go through Arrow batches; a
provider is made once for each task."""

from __future__ import annotations

import random
import secrets
import socket
import socketserver
import threading
import time
from collections import deque
from collections.abc import Callable, Iterator, Sized
from concurrent.futures import ThreadPoolExecutor, wait
from contextlib import contextmanager, nullcontext, suppress
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import chunk_pack, chunk_pack_long, parse_label, parse_reason
from .storage import unused


class Provider(Protocol):
    def __call__(self, inputs: list[str]) -> list[str]: ...


class Echo:
    """An offline stand-in: the first words of each input."""

    def __init__(self, words: int = 5):
        self.words = words

    def __call__(self, inputs: list[str]) -> list[str]:
        return [" ".join((x or "").split()[: self.words]) for x in inputs]


class Marker:
    """An offline stand-in of a diacritizer: a mark after each of the given letters."""

    def __init__(self, mark: str, after: str = "aeiou"):
        self.table = str.maketrans({c: c + mark for c in after})

    def __call__(self, inputs: list[str]) -> list[str]:
        return [x.translate(self.table) for x in inputs]


class TokenCounter:
    """Counts the pieces that `cut` makes of a text; an offline stand-in of a tokenizer without special tokens."""

    def __init__(self, cut: Callable[[str], list]):
        self.cut = cut

    def __call__(self, inputs: list[str]) -> list[int]:
        return [len(self.cut(x)) if x else 0 for x in inputs]


class ByLength:
    """A model that takes batches of token lists of one length, filled up on the left. Inputs are cut to `most` tokens and
    dealt by length to batches of at most `budget` tokens, filling included, so that little is filled up; replies come in
    the order of the inputs. padded, tokens: what was filled up, and what was not."""

    def __init__(self, model: Callable[[list[list]], list[str]], cut: Callable[[str], list], most: int = 3072, budget: int = 16_384, fill=0):
        self.model, self.cut, self.most, self.budget, self.fill, self.padded, self.tokens = model, cut, most, budget, fill, 0, 0

    def __call__(self, inputs: list[str]) -> list[str]:
        held = [self.cut(x or "")[: self.most] for x in inputs]
        order, out, lo = sorted(range(len(held)), key=lambda k: len(held[k])), [""] * len(held), 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and len(held[order[hi]]) * (hi + 1 - lo) <= self.budget:
                hi += 1
            wide = len(held[order[hi - 1]])
            batch = [[self.fill] * (wide - len(held[k])) + held[k] for k in order[lo:hi]]
            self.tokens += sum(len(held[k]) for k in order[lo:hi])
            self.padded += sum(wide - len(held[k]) for k in order[lo:hi])
            for k, reply in zip(order[lo:hi], self.model(batch), strict=True):
                out[k] = reply
            lo = hi
        return out


class Spent(Exception):
    """The budget of calls is used up."""


class Retrying:
    """One call a row, with bounded concurrency; the reply after the last failure is `failed`. A row for which the budget has
    no call left has None."""

    def __init__(self, call: Callable[[str], str], tries: int = 3, workers: int = 4, wait: Callable[[int], float] = lambda k: 10 * (k + 1) + random.uniform(0, 3), failed: str = '{"label": "ERROR"}'):
        self.call, self.tries, self.workers, self.wait, self.failed = call, tries, workers, wait, failed
        self.pool: ThreadPoolExecutor | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"pool": None}

    def one(self, x: str) -> str | None:
        for k in range(self.tries):
            try:
                return self.call(x)
            except Spent:
                return None
            except Exception:  # noqa: BLE001  any failure of a remote call is retried
                if k + 1 < self.tries:
                    time.sleep(self.wait(k))
        return self.failed

    def __call__(self, inputs: list[str]) -> list[str]:
        self.pool = self.pool or ThreadPoolExecutor(self.workers)  # its threads, and their connections, last as long as the provider
        out, todo = [None] * len(inputs), deque(enumerate(inputs))

        def work() -> None:
            with getattr(self.call, "several", nullcontext)(todo):
                while True:
                    try:
                        k, x = todo.popleft()
                    except IndexError:
                        return
                    out[k] = self.one(x)

        running = [self.pool.submit(work) for _ in range(min(self.workers, len(inputs)))]
        wait(running)
        for done in running:
            done.result()
        return out


class Budget:
    """Calls that all tasks of a cluster may make together: `calls` in all, retries included, and `at_once` at a time. The
    driver hands them out over a socket, with a connection for each thread that makes calls: it is lent a place and as many
    calls as it asks for, and tells in the end how many of them it didn't begin, which others may have. Nobody is refused
    while calls are lent that may come back. The connection of a lost executor closes, and its places are free again; the
    calls it was lent count. left: calls that nobody has been lent."""

    def __init__(self, calls: int, at_once: int):
        self.left, self.lent, self.changed, self.places, self.token = calls, 0, threading.Condition(), threading.Semaphore(at_once), secrets.token_hex(16)
        budget = self

        class Worker(socketserver.StreamRequestHandler):
            disable_nagle_algorithm = True

            def handle(self) -> None:
                with suppress(OSError, ValueError):
                    while (asked := self.rfile.readline().decode().split()) and asked[0] == budget.token:
                        with budget.places:
                            lent = self.lend(int(asked[1]))
                        if lent:
                            self.wfile.write(b"\n")

            def lend(self, n: int) -> int:
                lent, unused = budget.take(n), 0
                try:
                    self.wfile.write(b"%d\n" % lent)
                    if lent:
                        unused = int(self.rfile.readline())
                finally:
                    budget.settle(lent, unused)
                return lent

        self.server = _Server(("", 0), Worker)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def take(self, n: int) -> int:
        """Lends up to n calls; none only if all have been begun."""
        with self.changed:
            self.changed.wait_for(lambda: self.left or not self.lent)
            n = min(n, self.left)
            self.left, self.lent = self.left - n, self.lent + n
            return n

    def settle(self, lent: int, unused: int) -> None:
        with self.changed:
            self.left, self.lent = self.left + unused, self.lent - lent
            self.changed.notify_all()

    def lease(self, spark: SparkSession) -> Lease:
        """By what tasks reach the budget."""
        return Lease(spark.conf.get("spark.driver.host"), self.server.server_address[1], self.token)

    def close(self) -> None:
        self.server.shutdown()
        self.server.server_close()


class _Server(socketserver.ThreadingTCPServer):
    #: Connections that wait to be accepted: the threads of all tasks may come at once, and one that is turned away waits for seconds.
    request_queue_size = 1024
    daemon_threads = True


@dataclass(frozen=True)
class Lease:
    """A budget's place and password."""

    host: str
    port: int
    token: str

    def limited(self, call: Callable[[str], str]) -> Limited:
        """The call, made only when the budget allows it; Spent is raised when that is used up."""
        return Limited(self, call)


class _Held(threading.local):
    """What a thread has borrowed: how many calls, how many of them are left, and since when; size: how many it asks
    for at most, todo: what else it has to make calls for."""

    def __init__(self):
        self.file, self.lent, self.calls, self.since, self.size, self.todo = None, 0, 0, 0.0, 1, ()


class Limited:
    """A limited call; Spent is raised also while the driver can't be reached. It borrows one call at a time, and inside
    several() as many as its thread makes in SLICE seconds, so that fast calls don't wait for the driver one by one, and slow
    ones keep none from others."""

    SLICE, MOST = 0.02, 64

    def __init__(self, lease: Lease, call: Callable[[str], str]):
        self.lease, self.call, self.held, self.spent = lease, call, _Held(), False

    @contextmanager
    def several(self, todo: Sized) -> Iterator[None]:
        """For a thread that makes calls for what is in todo, one after another; what it has borrowed goes back at the end."""
        self.held.todo = todo
        try:
            yield
        finally:
            self.held.todo = ()
            self.rest()

    def __call__(self, x: str) -> str:
        held, on = self.held, False
        if not held.calls:
            self._borrow()
        held.calls -= 1
        try:
            reply = self.call(x)
            on = held.calls > 0 and len(held.todo) > 0 and time.monotonic() - held.since < self.SLICE
            return reply
        finally:
            if not on:
                self.rest()

    def _ask(self, line: str) -> bytes:
        """The driver's answer to a line; empty if it can't be reached, and then the next line makes a new connection."""
        held, answer = self.held, b""
        with suppress(OSError):
            if held.file is None:
                held.socket = socket.create_connection((self.lease.host, self.lease.port))
                held.socket.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
                held.file = held.socket.makefile("rwb", buffering=0)
            held.file.write(f"{line}\n".encode())
            answer = held.file.readline()
        if not answer:
            held.file = None
        return answer

    def _borrow(self) -> None:
        held = self.held
        if not self.spent:
            answer = self._ask(f"{self.lease.token} {min(held.size, len(held.todo) + 1)}")
            held.lent = held.calls = int(answer or 0)
            held.since = time.monotonic()
            self.spent = answer == b"0\n"  # for good: what could come back was waited for
        if not held.lent:
            raise Spent

    def rest(self) -> None:
        """Gives back the thread's place and the calls it hasn't begun, and waits until the driver has them."""
        held = self.held
        if held.lent:
            held.size = min(2 * held.size, self.MOST) if time.monotonic() - held.since < self.SLICE else max(1, held.lent - held.calls)
            unused, held.lent, held.calls = held.calls, 0, 0
            self._ask(f"{unused}")


def apply(frame: DataFrame, make: Callable[[], Provider], column: str, name: str, batch: int = 32, kind: str = "string", skip: bool = False) -> DataFrame:
    """frame with the provider's outputs for `column` as `name`. skip: rows of a batch in which the provider fails are left
    out instead of failing the task, and so are rows for which it returns None."""
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = make()
        for rows in batches:
            for lo in range(0, rows.num_rows, batch):
                part = rows.slice(lo, batch)
                try:
                    out = pa.array(provider(part.column(column).to_pylist()), kinds[kind])
                except Exception:  # noqa: BLE001  whatever a model fails with, its rows are asked for again
                    if not skip:
                        raise
                    continue
                made = pa.RecordBatch.from_arrays([*part.columns, out], [*part.schema.names, name])
                yield made.filter(pc.is_valid(out)) if skip else made

    return frame.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema), f"`{name}` {kind}"]))


#: Characters of a row's texts beyond which their chunks are dealt over tasks.
SPREAD = 1 << 20


def apply_chunks(frame: DataFrame, make: Callable[[], Provider], columns: str | list[str], most: int, batch: int = 32, spread: int = SPREAD) -> DataFrame:
    """frame with `columns` put through the provider in chunks of at most `most` characters, which are joined by blanks again;
    a null stays null. All other columns are carried along. Rows of more than `spread` characters are taken apart: their
    chunks are dealt over all tasks, and put together again in their order, in one shuffle each way."""
    columns = [columns] if isinstance(columns, str) else columns
    long = sum((F.coalesce(F.length(c), F.lit(0)) for c in columns[1:]), F.coalesce(F.length(columns[0]), F.lit(0))) > spread
    return _chunks_in_place(frame.filter(~long), make, columns, most, batch).unionByName(_chunks_dealt(frame.filter(long), make, columns, most, batch))


def _chunks_in_place(frame: DataFrame, make: Callable[[], Provider], columns: list[str], most: int, batch: int) -> DataFrame:
    names = frame.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = make()
        for rows in batches:
            made = {}
            for n, c in enumerate(columns):
                lists = rows.column(len(names) + n).to_pylist()
                flat = [x for chunks in lists for x in chunks]
                done = [y for lo in range(0, len(flat), batch) for y in provider(flat[lo : lo + batch])]
                out, at = [], 0
                for old, chunks in zip(rows.column(c).to_pylist(), lists, strict=True):
                    out.append(None if old is None else " ".join(done[at : at + len(chunks)]))
                    at += len(chunks)
                made[c] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([made.get(n, rows.column(n)) for n in names], names)

    return frame.select(*names, *(chunk_pack(F.col(c), most).alias(unused(names, f"chunks{n}")) for n, c in enumerate(columns))).mapInArrow(run, kinds)


def _chunks_dealt(frame: DataFrame, make: Callable[[], Provider], columns: list[str], most: int, batch: int) -> DataFrame:
    names = frame.columns
    # column -1 has what is carried along; its texts only tell whether they are null
    rest = F.struct(*(F.when(F.col(c).isNotNull(), F.lit("")).alias(c) if c in columns else F.col(c) for c in names))
    part = lambda n, k, x, row: F.struct(n.cast("int").alias("n"), k.cast("int").alias("k"), x.cast("string").alias("x"), row.alias("row"))
    kind = frame.select(rest).schema[0].dataType
    no_row, no_part = F.lit(None).cast(kind), f"array<struct<n:int,k:int,x:string,row:{kind.simpleString()}>>"
    chunks_of = lambda n, c: F.transform(chunk_pack_long(F.col(c), most), lambda x, k: part(F.lit(n), k, x, no_row))
    chunks = [F.coalesce(chunks_of(n, c), F.array().cast(no_part)) for n, c in enumerate(columns)]
    none = F.lit(None).cast("string")
    parts = frame.select(F.monotonically_increasing_id().alias("id"), F.concat(F.array(part(F.lit(-1), F.lit(0), none, rest)), *chunks).alias("ps"))
    # as many tasks as the session has shuffle partitions, however small these are: calls cost more than bytes
    tasks = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = parts.select("id", F.explode("ps").alias("p")).select("id", "p.*").repartition(tasks, "id", "n", "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = make()
        for rows in batches:
            for lo in range(0, rows.num_rows, batch):
                some = rows.slice(lo, batch)
                texts = some.column("x").to_pylist()
                done = iter(provider([x for x in texts if x is not None]) if any(x is not None for x in texts) else [])
                yield some.set_column(some.schema.names.index("x"), "x", pa.array([None if x is None else next(done) for x in texts], pa.string()))

    made = parts.mapInArrow(run, parts.schema)
    whole = made.groupBy("id").agg(F.any_value("row", F.lit(True)).alias("row"), F.array_sort(F.collect_list(F.when(F.col("n") >= 0, F.struct("n", "k", "x")))).alias("xs"))
    back = lambda n: F.array_join(F.transform(F.filter("xs", lambda x: x["n"] == n), lambda x: x["x"]), " ")
    return whole.select(*(F.when(F.col(f"row.`{c}`").isNotNull(), back(columns.index(c))).alias(c) if c in columns else F.col(f"row.`{c}`").alias(c) for c in names))


def judged(frame: DataFrame, make: Callable[[], Provider], message: str = "message", skip: bool = False) -> DataFrame:
    """frame with judge_label (ERROR if the reply has no valid one) and judge_reason of the provider's JSON replies."""
    reply = unused(frame.columns, "reply")
    out = apply(frame, make, message, reply, skip=skip)
    return out.withColumns({"judge_label": parse_label(F.col(reply)), "judge_reason": parse_reason(F.col(reply))}).drop(reply)
