"""Fingerprints in state: unchanged files are told once, and state goes."""

import os
from datetime import datetime, timedelta

from foliant.streaming import watching

SCHEMA = "path string, n long, fingerprint string, observed_at timestamp"


def test_unchanged_files_are_told_once_and_state_goes(spark, tmp_path):
    base = datetime(2024, 1, 1)

    def write(name, *rows):
        frame = spark.createDataFrame([(p, n, f, base + timedelta(seconds=s)) for p, n, f, s in rows], SCHEMA)
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / name))

    def run():
        source = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        return sorted((r.n, r.path, r.fingerprint) for r in watching.watched_once(spark, source, str(tmp_path / "run"), quiet=10, keep=1000).collect())

    def held():
        frames = spark.read.format("statestore").option("stateVarName", "held").load(str(tmp_path / "run" / "checkpoint"))
        return frames.count()

    write("a", ("x", 1, "f1", 0), ("x", 2, "f2", 3), ("y", 3, "g1", 4), ("z", 4, "h", 100))
    assert run() == [(2, "x", "f2"), (3, "y", "g1")]  # the burst's last, and what is quiet by the watermark
    write("b", ("x", 5, "f2", 200), ("y", 6, "g2", 201), ("z", 7, None, 300))  # a restart; x is as it was
    assert run() == [(2, "x", "f2"), (3, "y", "g1"), (4, "z", "h"), (6, "y", "g2")]
    assert held() == 3
    write("c", ("w", 8, "k", 5000))
    assert (7, "z", "") in run()
    write("d", ("w", 9, "k", 9000))
    run()
    assert held() <= 1  # x and y were not asked for, z has gone
    assert os.path.isdir(tmp_path / "run")


class Counted:
    """A state's handle that counts what it is asked; a value is a variable of its own."""

    def __init__(self):
        self.calls, self.timers, self.value = 0, set(), None

    def getValueState(self, name, schema):
        state = Counted()
        state.calls_of = self
        return state

    def _call(self):
        getattr(self, "calls_of", self).calls += 1

    def get(self):
        self._call()
        return self.value

    def exists(self):
        self._call()
        return self.value is not None

    def update(self, value):
        self._call()
        self.value = value

    def clear(self):
        self.update(None)

    def registerTimer(self, at):
        self._call()
        self.timers.add(at)

    def deleteTimer(self, at):
        self._call()
        self.timers.discard(at)

    def listTimers(self):
        self._call()
        return iter(self.timers)


def test_a_key_reads_and_writes_its_state_once_a_batch(spark):
    handle, watching_one = Counted(), watching.Watching(10, 1000)
    watching_one.init(handle)
    rows = [{"n": n, "fingerprint": f"f{n % 7}", "at": n * 20_000} for n in range(50)]
    assert [r.n for r in watching_one.handleInputRows(("x",), iter(rows), None)] == list(range(49))
    assert handle.calls <= 6 and handle.timers == {49 * 20_000 + 10_000}
    assert [r.n for r in watching_one.handleInputRows(("x",), iter([{"n": 50, "fingerprint": "", "at": 2_000_000}]), None)] == [49]
    assert handle.calls <= 12 and handle.timers == {2_010_000}
    handle.timers.clear()
    assert [(r.n, r.fingerprint) for r in watching_one.handleExpiredTimer(("x",), None, None)] == [(50, "")]
    assert watching_one.held.value is None and watching_one.waiting.value is None and not handle.timers
