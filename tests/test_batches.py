"""Stages that keep what they have finished, their progress, and limits of calls over all tasks."""

import json
import sys
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from pairlens import providers
from pairlens.streaming import ledger

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Dies:
    """A model that fails for good at one input, and leaves a line for each call in a file."""

    def __init__(self, at, log):
        self.at, self.log = at, log

    def __call__(self, inputs):
        if self.at in inputs:
            raise OSError("gone")
        with open(self.log, "a") as f:
            f.write("".join(f"{x}\n" for x in inputs))
        return [x * 2 for x in inputs]


def _step(at, log, skip=False, batch=5):
    return lambda todo: providers.apply(todo, lambda: Dies(at, log), "x", "reply", batch=batch, skip=skip).select("id", "reply")


def test_batches_before_a_crash_stay(spark, tmp_path):
    """The model dies in the fourth of five files of ten rows, which are taken as old as they are; what was finished before is not asked for again."""
    out, log = f"file://{tmp_path}/out", str(tmp_path / "calls")
    rows = spark.range(50, numPartitions=1).select("id", F.format_string("%02d", "id").alias("x"))
    with pytest.raises(Exception, match="gone"):
        ledger.resume(rows, out, _step("35", log), batch=10, files=1)
    kept = {r.id for r in ledger.read_batches(spark, out).collect()}
    assert len(kept) >= 10 and len(kept) % 10 == 0 and 35 not in kept
    calls = len(open(log).readlines())
    done = ledger.resume(rows, out, _step("none", log), batch=10, files=2)
    assert sorted(map(tuple, done.collect())) == [(k, f"{k:02d}" * 2) for k in range(50)]
    assert len(open(log).readlines()) - calls == 50 - len(kept)
    again = len(open(log).readlines())
    assert ledger.resume(rows, out, _step("none", log)).count() == 50 and len(open(log).readlines()) == again


def test_rows_that_fail_stay_pending(spark, tmp_path):
    out, log = f"file://{tmp_path}/out", str(tmp_path / "calls")
    rows = spark.range(40, numPartitions=4).select("id", F.format_string("%02d", "id").alias("x"))
    with pytest.raises(ledger.Unfinished, match="5 of 40"):
        ledger.resume(rows, out, _step("17", log, skip=True))
    assert {r.id for r in ledger.read_batches(spark, out).collect()} == set(range(40)) - set(range(15, 20))
    assert ledger.resume(rows, out, _step("17", log, skip=True), strict=False).count() == 35
    assert ledger.resume(rows, out, _step("none", log, skip=True)).groupBy("id").count().filter("count > 1").count() == 0
    assert ledger.read_batches(spark, out).count() == 40


def test_progress_is_reported_while_a_stage_runs(spark, tmp_path):
    out, seen = f"file://{tmp_path}/out", []
    step = lambda todo: todo.select("id", F.when(F.col("id") % 4 == 0, "ERROR").otherwise("CORRECT").alias("judge_label"))
    done = ledger.resume(spark.range(60, numPartitions=1), out, step, batch=10, files=2, errors=F.col("judge_label") == "ERROR", watch=seen.append)
    assert [x["done"] for x in seen] == [20, 40, 60] and {x["total"] for x in seen} == {60}
    assert seen[-1]["errors"] == done.filter("judge_label = 'ERROR'").count() == 15 and seen[-1]["percent"] == 100.0
    assert ledger.resume(spark.range(60).limit(0), f"{out}-none", step).columns == ["id", "judge_label"]


class Counting:
    """Writes when each call begins and ends, and fails the first time for every third input."""

    def __init__(self, folder):
        self.folder, self.seen = folder, set()

    def __call__(self, x):
        began = time.time()
        time.sleep(0.01)
        with open(f"{self.folder}/{x}-{began}", "w") as f:
            json.dump([began, time.time()], f)
        if int(x) % 3 == 0 and x not in self.seen:
            self.seen.add(x)
            raise OSError(x)
        return '{"label": "CORRECT"}'


@pytest.mark.parametrize("calls, at_once", [(30, 2), (1000, 3), (0, 1)])
def test_all_tasks_share_a_limit_of_calls(spark, tmp_path, calls, at_once):
    """Over eight tasks of four threads there are never more calls at a time, and none beyond the budget; the rest stays."""
    out, folder = f"file://{tmp_path}/out", tmp_path / "calls"
    folder.mkdir()
    rows, budget = spark.range(64, numPartitions=8).select("id", F.col("id").cast("string").alias("message")), providers.Budget(calls, at_once)
    lease = budget.lease(spark)
    step = lambda todo: providers.judged(todo, lambda: providers.Retrying(lease.limited(Counting(str(folder))), wait=lambda k: 0), skip=True).select("id", "judge_label")
    done = ledger.resume(rows, out, step, batch=8, strict=False)
    budget.close()
    spans = [json.loads(p.read_text()) for p in folder.iterdir()]
    needed = 64 + 22
    assert len(spans) == min(calls, needed) and budget.left == calls - len(spans)
    assert max((sum(a <= s < b for a, b in spans) for s, _ in spans), default=0) <= at_once
    assert done.count() == (64 if calls >= needed else done.select("id").distinct().count()) and (calls >= needed or done.count() < 64)
    more = providers.Budget(1000, 8)
    lease = more.lease(spark)
    assert ledger.resume(rows, out, step, batch=8).groupBy("id", "judge_label").count().filter("judge_label = 'CORRECT' and count = 1").count() == 64
    more.close()


def test_fast_calls_do_not_ask_one_by_one():
    """A provider's threads keep their connections over its batches and borrow calls in blocks; those that aren't begun come
    back before anyone is refused, so that all are made and none beyond them."""
    budget, asked, opened = providers.Budget(3000, 2), [], []
    take, accept = budget.take, budget.server.get_request
    budget.take = lambda *n: asked.append(n) or take(*n)
    budget.server.get_request = lambda: opened.append(1) or accept()
    lease, made = providers.Lease("127.0.0.1", budget.server.server_address[1], budget.token), []

    def task(k):
        provider = providers.Retrying(lease.limited(lambda x: made.append(x) or x), wait=lambda k: 0)
        return [x for lo in range(0, 1600, 32) for x in provider([f"{k}:{n}" for n in range(lo, lo + 32)]) if x is not None]

    with ThreadPoolExecutor(3) as pool:
        found = [x for part in pool.map(task, range(3)) for x in part]
    budget.close()
    assert len(made) == 3000 and sorted(found) == sorted(made) and len(set(made)) == 3000 and budget.left == 0
    assert len(opened) <= 12 and len(asked) < 2000


def test_slow_calls_keep_none_from_others():
    """After a fast start a thread has borrowed many calls when one takes long: the rest goes back, and a lost connection
    costs what it was lent."""
    budget = providers.Budget(40, 2)
    lease = providers.Lease("127.0.0.1", budget.server.server_address[1], budget.token)
    limited = lease.limited(lambda x: time.sleep(x) or f"{budget.left}")
    todo = list(range(100))
    with limited.several(todo):
        for _ in range(8):
            limited(0)
        limited(0.1)
        assert budget.left == 31 and budget.lent == 0
    assert limited(0) == "30" and budget.lent == 0
    lost = lease.limited(lambda x: None)
    with lost.several(todo):
        lost.held.size = 5
        lost(0)
        assert (budget.left, budget.lent) == (25, 5)
        lost.held.socket.shutdown(2)
        other = providers.Retrying(limited, wait=lambda k: 0)([0] * 30)
    with pytest.raises(providers.Spent):
        lost(0)
    assert lost.held.file is not None and lost.spent  # by a new connection
    budget.close()
    assert sum(x is not None for x in other) == 25 and (budget.left, budget.lent) == (0, 0)
