"""The change journal: an append-only log of events and of their status changes, a lease, claims, guarded finishes and replay.

Events are written once, in a folder for each micro-batch, and a batch that is there already is not written
again.  A status change is a row of its own, in a folder for each step; an event's state is that of its last
change.  Every COMPACT_EVERY folders the log is compacted: a snapshot holds the events that are still open and,
apart, those that closed since the one before, and a head names what it covers.  Appending, claiming and
finishing read the open events and the tail of the log only, whatever its age; the folders that an older head
covers are removed.  Only `read` looks at closed events.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds and statuses of events, and which statuses may be claimed, are open, or end a claim.
KINDS = ["created", "modified", "moved", "deleted", "reconcile-required"]
STATUSES = ["queued", "stabilizing", "ready", "processing", "applied", "review-required", "failed"]
CLAIMABLE = ["queued", "ready"]
OPEN = ["queued", "ready", "stabilizing", "processing", "failed"]
FINISHES = ["applied", "review-required", "failed"]

EVENT = "sequence long, event_kind string, current_path string, previous_path string, observed_at timestamp, source_id string, fingerprint string"
CHANGE = "sequence long, status string, retries int, error_summary string, step long"
STATE = EVENT + ", status string, retry_count int, error_summary string"
COLUMNS = ["sequence", "event_kind", "current_path", "previous_path", "observed_at", "source_id", "fingerprint", "status", "retry_count", "error_summary"]
#: Folders of the tail that make a compaction due.
COMPACT_EVERY = 32
ERROR_CHARS = 160
#: Claims of up to so many rows are sorted in one go, and rounds that grow begin with so many.
CLAIM = 10_000
#: A larger claim counts ranges of 2 ** RANGE_BITS sequences.
RANGE_BITS = 16


class JournalError(ValueError):
    """A step that the journal refuses."""


def numbered(rows: DataFrame, order: str, start: int, folder: str) -> DataFrame:
    """Rows with `sequence` from start + 1 in the order of a column, ties by all others.

    Rows are sorted by ranges and written with their range and place; ranges' counts alone are gathered.  A burst of
    equal times is split among ranges by the other columns, so no task sees all rows.
    """
    by = [order, *(c for c in rows.columns if c != order)]
    sorted_rows = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    placed = sorted_rows.withColumn("_b", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    placed.write.mode("overwrite").parquet(folder)
    held = rows.sparkSession.read.schema(placed.schema).parquet(folder)
    offsets, done = [], start
    for b, n in sorted((r["_b"], r["count"]) for r in held.groupBy("_b").count().collect()):  # a row for each range
        offsets.append((b, done))
        done += n
    before = rows.sparkSession.createDataFrame(offsets, "_b int, _before long")
    return held.join(F.broadcast(before), "_b").withColumn("sequence", F.col("_before") + F.col("_i") + 1).drop("_b", "_i", "_before")


def same_event(left: str, right: str) -> list:
    """Conditions that two events are one: kind and both paths, nulls alike."""
    return [F.col(f"{left}.event_kind") == F.col(f"{right}.event_kind"), *[F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in ("current_path", "previous_path")]]


def matching(journal: DataFrame, wanted: DataFrame, statuses: list[str]) -> DataFrame:
    """Sequences of the journal's rows in some statuses that are one of the wanted events."""
    return journal.where(F.col("status").isin(statuses)).alias("j").join(wanted.alias("w"), same_event("j", "w"), "left_semi").select("sequence")


def unqueued(journal: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes that no open row has already."""
    return changes.alias("c").join(journal.where(F.col("status").isin(OPEN)).alias("j"), same_event("c", "j"), "left_anti")


def claim(journal: DataFrame, count: int) -> DataFrame:
    """The claimable rows of lowest sequence, as processing."""
    free = journal.where(F.col("status").isin(CLAIMABLE))
    return (free.orderBy("sequence").limit(count) if count <= CLAIM else lowest(free, count)).withColumn("status", F.lit("processing"))


def lowest(rows: DataFrame, count: int) -> DataFrame:
    """Rows of lowest sequence that do not meet in one task: ranges of sequences are counted, and only the one at the cut is sorted.

    Numbers have no gaps, so a range has few rows and the ranges are few.
    """
    part, left = F.coalesce(F.shiftright("sequence", RANGE_BITS), F.lit(-(1 << 62))), count  # nulls first, as a sort has them
    for at, n in sorted((r["part"], r["count"]) for r in rows.groupBy(part.alias("part")).count().collect()):  # a row for each range
        if n > left:
            return rows.where(part < at).unionByName(rows.where(part == at).orderBy("sequence").limit(left))
        left -= n
    return rows


def accepted(journal: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Outcomes (sequence, status, error) that the journal takes: of rows that are processing, with a finishing status."""
    held = journal.where("status = 'processing'").select("sequence")
    return outcomes.where(F.col("status").isin(FINISHES)).join(held, "sequence", "left_semi")


def finish_counts(outcomes: DataFrame) -> DataFrame:
    """How many events ended in which way."""
    of = lambda s, name: F.count_if(F.col("status") == s).alias(name)
    return outcomes.agg(F.count(F.lit(1)).alias("processed"), of("applied", "applied"), of("review-required", "review_required"), of("failed", "failed"))


def high_water(journal: DataFrame) -> DataFrame:
    """The highest sequence, the highest applied one, and the one up to which all are applied."""
    least_open = F.min(F.when(F.col("status") != "applied", F.col("sequence")))
    return journal.agg(F.max("sequence").alias("last_observed"), F.max(F.when(F.col("status") == "applied", F.col("sequence"))).alias("last_applied"), F.coalesce(least_open - 1, F.max("sequence")).alias("applied_up_to"))


class Journal:
    """A journal in one folder of a store that Spark reads and writes."""

    def __init__(self, spark: SparkSession, folder: str, compact_every: int = COMPACT_EVERY) -> None:
        self.spark, self.folder, self.compact_every = spark, folder.rstrip("/"), compact_every

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, name: str) -> list[int]:
        fs, path = self._path(name)
        found = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n) for n in found if n.isdigit())

    def _numbers(self, name: str) -> list[int]:
        """The numbers of the folders that are there, those that were committed only."""
        fs, path = self._path(name)
        jvm = self.spark._jvm.org.apache.hadoop.fs.Path
        return [n for n in self._names(name) if fs.exists(jvm(path, f"{n}/_SUCCESS"))]

    def _told(self, name: str) -> str:
        """A small file as text."""
        fs, path = self._path(name)
        stream = fs.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _tell(self, name: str, text: str, again: bool = False) -> None:
        fs, path = self._path(name)
        out = fs.create(path, again)
        out.write(bytearray(text.encode()))
        out.close()

    def _remove(self, name: str) -> None:
        fs, path = self._path(name)
        fs.delete(path, True)

    def _rows(self, name: str, numbers: list[int], schema: str) -> DataFrame:
        if not numbers:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{name.format(n)}" for n in numbers])

    def head(self) -> dict:
        """What the last snapshot covers: batches and steps up to its numbers, the last sequence, and where closed events begin."""
        for number in reversed(self._names("heads")):
            text = self._told(f"heads/{number}")
            if text:  # else a writer has not finished it
                return json.loads(text)
        return {"number": 0, "batch": -1, "step": -1, "last": 0, "closed_from": 1}

    def tail(self, head: dict | None = None) -> tuple[list[int], list[int]]:
        """Batches and steps that the last snapshot does not cover."""
        head = head or self.head()
        return [n for n in self._numbers("events") if n > head["batch"]], [n for n in self._numbers("changes") if n > head["step"]]

    def _state(self, head: dict, batches: list[int], steps: list[int], whole: bool) -> DataFrame:
        """Events of the snapshot and the given tail with their state; closed ones of the snapshots too if `whole`."""
        names = [f"snapshots/{head['number']}/open"] if head["number"] else []
        names += [f"snapshots/{n}/closed" for n in range(head["closed_from"], head["number"] + 1)] if whole else []
        held = self.spark.read.schema(STATE).parquet(*[f"{self.folder}/{n}" for n in names]) if names else self.spark.createDataFrame([], STATE)
        fresh = self._rows("events/{}", batches, EVENT).select(*COLUMNS[:7], F.lit("queued").alias("status"), F.lit(0).alias("retry_count"), F.lit(None).cast("string").alias("error_summary"))
        events = held.unionByName(fresh) if batches else held
        if not steps:
            return events
        last = self._rows("changes/{}", steps, CHANGE).groupBy("sequence").agg(F.max_by(F.struct("status", "error_summary"), "step").alias("last"), F.sum("retries").alias("more"))
        changed = F.col("last").isNotNull()
        joined = events.join(last, "sequence", "left")
        return joined.select(*COLUMNS[:7], F.when(changed, F.col("last.status")).otherwise(F.col("status")).alias("status"), (F.col("retry_count") + F.coalesce("more", F.lit(0))).cast("int").alias("retry_count"), F.when(changed, F.col("last.error_summary")).otherwise(F.col("error_summary")).alias("error_summary"))

    def read(self) -> DataFrame:
        """All events with their state, closed ones included."""
        head = self.head()
        return self._state(head, *self.tail(head), whole=True)

    def opened(self, below: int | None = None) -> DataFrame:
        """The events of the snapshot that were open and those of the tail, with their state; of batches below a number only, if given."""
        head = self.head()
        batches, steps = self.tail(head)
        return self._state(head, [n for n in batches if below is None or n < below], steps, whole=False)

    def last_sequence(self) -> int:
        """The highest sequence so far."""
        head = self.head()
        batches, _ = self.tail(head)
        tail = self._rows("events/{}", batches, EVENT).agg(F.max("sequence")).first()[0] if batches else None
        return max(head["last"], tail or 0)

    def append(self, changes: DataFrame, batch_id: int, order: str = "n") -> None:
        """Queue a batch's changes that are not open yet; batches have growing numbers, and one that is there already stays as it is."""
        head = self.head()
        if batch_id <= head["batch"] or batch_id in self._numbers("events"):
            return
        fresh = unqueued(self.opened(), changes.where(F.col("event_kind").isin(KINDS)))
        staged = f"{self.folder}/staged/{batch_id}"
        rows = numbered(fresh, order, self.last_sequence(), staged)
        have = set(rows.columns)
        own = rows.select("sequence", "event_kind", "current_path", "previous_path", "observed_at", *[F.col(c) if c in have else F.lit("").alias(c) for c in ("source_id", "fingerprint")])
        own.write.mode("overwrite").parquet(f"{self.folder}/events/{batch_id}")
        self._remove(f"staged/{batch_id}")
        self.compact_if_due()

    def compact_if_due(self) -> None:
        if sum(map(len, self.tail())) >= self.compact_every:
            self.compact()

    def compact(self, whole: bool = False) -> None:
        """Write the next snapshot; `whole` sorts all events anew, closed ones too.

        The head is created last and by one writer only.  What the head before covered is removed, so a reader that has
        just looked at that one still finds its tail.
        """
        head = self.head()
        batches, steps = self.tail(head)
        number = head["number"] + 1
        state = self._state(head, batches, steps, whole)
        is_open = F.col("status").isin(OPEN)
        for name, rows in (("open", state.where(is_open)), ("closed", state.where(~is_open))):
            rows.write.mode("overwrite").parquet(f"{self.folder}/snapshots/{number}/{name}")
        found = {"number": number, "batch": max([head["batch"], *batches]), "step": max([head["step"], *steps]), "last": self.last_sequence(), "closed_from": number if whole else head["closed_from"]}
        try:
            self._tell(f"heads/{number}", json.dumps(found))
        except Exception:  # another writer was first; its snapshot holds
            return
        for name, covered in (("events", head["batch"]), ("changes", head["step"])):
            for old in self._names(name):
                if old <= covered:
                    self._remove(f"{name}/{old}")
        for old in self._names("heads"):
            if old < number - 1:
                self._remove(f"heads/{old}")
                self._remove(f"snapshots/{old}/open")
        for old in self._names("snapshots"):
            if old < min(found["closed_from"], head["closed_from"]):
                self._remove(f"snapshots/{old}")
        for old in self._names("lease")[:-2]:
            self._remove(f"lease/{old}")

    def change(self, rows: DataFrame, retries: int = 0) -> None:
        """Write status changes (sequence, status, error_summary) as the next step."""
        step = max([self.head()["step"], *self._names("changes")]) + 1
        own = rows.select("sequence", "status", F.lit(retries).alias("retries"), F.left("error_summary", F.lit(ERROR_CHARS)).alias("error_summary"), F.lit(step).cast("long").alias("step"))
        own.write.mode("overwrite").parquet(f"{self.folder}/changes/{step}")
        self.compact_if_due()

    def transition(self, sequences: list[int], status: str, error: str = "", retry: bool = False) -> None:
        """Set the status of some events, whatever it was."""
        if status not in STATUSES:
            raise JournalError(f"no such status: {status}")
        known = {r["sequence"] for r in self.read().where(F.col("sequence").isin(sequences)).select("sequence").collect()}
        if set(sequences) - known:
            raise JournalError(f"no such events: {sorted(set(sequences) - known)}")
        rows = self.spark.createDataFrame([(s, status, error) for s in sequences], "sequence long, status string, error_summary string")
        closed = {r["sequence"] for r in self.read().where(F.col("sequence").isin(sequences) & ~F.col("status").isin(OPEN)).select("sequence").collect()}
        self.change(rows, int(retry))
        if closed and status in OPEN:  # back among the open events of the snapshot
            self.compact(whole=True)

    def recover(self, retry_failed: bool = False) -> int:
        """Put interrupted events, and failed ones on demand, back into the queue with one more retry."""
        again = self.opened().where(F.col("status").isin(["processing", "failed"] if retry_failed else ["processing"])).select("sequence", F.lit("queued").alias("status"), F.lit(None).cast("string").alias("error_summary"))
        n = again.count()
        if n:
            self.change(again, retries=1)
        return n

    def acquire(self, holder: str, now: datetime | None = None, ttl: int = 300) -> None:
        """Take or renew the lease; another holder's that has not expired refuses it."""
        now = now or datetime.now(timezone.utc)
        if not holder.strip() or ttl <= 0:
            raise JournalError("a lease needs a holder and a positive time")
        numbers, held = self._leases()
        if held and held["holder"] not in ("", holder) and datetime.fromisoformat(held["expires_at"]) > now:
            raise JournalError(f"held by {held['holder']} until {held['expires_at']}")
        self._write_lease(numbers, {"holder": holder, "expires_at": (now + timedelta(seconds=ttl)).isoformat()})

    def release(self, holder: str) -> None:
        """Give the lease back; nothing happens if it is another's."""
        numbers, held = self._leases()
        if held and held["holder"] == holder:
            self._write_lease(numbers, {"holder": "", "expires_at": held["expires_at"]})

    def require(self, holder: str, now: datetime | None = None) -> None:
        """Refuse a step of who does not hold the lease."""
        _, held = self._leases()
        if not held or held["holder"] != holder or datetime.fromisoformat(held["expires_at"]) <= (now or datetime.now(timezone.utc)):
            raise JournalError(f"{holder} does not hold the lease")

    def _leases(self) -> tuple[list[int], dict | None]:
        numbers = self._names("lease")
        if not numbers:
            return [], None
        text = self._told(f"lease/{numbers[-1]}")
        return numbers, json.loads(text) if text else None

    def _write_lease(self, numbers: list[int], row: dict) -> None:
        """Write the next version of the lease; who finds it there has lost the race."""
        try:
            self._tell(f"lease/{(numbers or [-1])[-1] + 1}", json.dumps(row))
        except Exception as e:
            raise JournalError("the lease was taken at the same time") from e

    def note(self, key: str, value: str) -> None:
        """Keep a value, such as the time of the last reconciliation."""
        self._tell(f"meta/{key}", value, again=True)

    def noted(self, key: str) -> str:
        fs, path = self._path(f"meta/{key}")
        return self._told(f"meta/{key}") if fs.exists(path) else ""

    def status(self) -> DataFrame:
        """Events by status, all statuses present, and the highest sequence of each."""
        words = self.spark.createDataFrame([(s,) for s in STATUSES], "status string")
        counts = self.read().groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.max("sequence").alias("last_sequence"))
        return words.join(counts, "status", "left").na.fill(0)


Materializer = Callable[[DataFrame], DataFrame]


def finish_status(outcomes: DataFrame) -> DataFrame:
    """Outcomes (sequence, result) of a materialiser as (sequence, status, error_summary)."""
    from foliant.operators.classify import finish_status as by_result

    status = by_result(F.col("result"))
    return outcomes.select("sequence", status.alias("status"), F.when(status != "applied", F.col("result")).alias("error_summary"))


def paced(size: int, took: float, least: float, ttl: int) -> int:
    """Events of the next round, after one of `size` that took so many seconds; the shortest so far took `least`.

    What a round takes beyond the shortest is its claim's; the rest, a look at all open events, a smaller claim would
    take as well.  So the claim's part may take a quarter of the lease, and a round at most 16 times the events of the
    one before, fewer where it might outlast the lease if all its time was the claim's, but twice as many.
    """
    most = max(2, min(16, ttl / max(took, 1)))
    return max(CLAIM, int(size * min(ttl / 4 / max(took - least, 1), most)))


def drain(journal: Journal, holder: str, materialize: Materializer, at_once: int | None = CLAIM, most: int | None = None, clock: Callable[[], datetime] | None = None, ttl: int = 300) -> int:
    """Claim, materialise and finish events until none is left or `most` are done; an exception fails the claimed events.

    A round claims at most `at_once` events, and each looks at all that are open: None is for materialisers that pass
    nothing through the driver, and lets rounds grow by the pace of those before, so that there are few.  The lease is
    renewed before every round and again before its outcomes are written, so a drain may last longer than it; who has
    lost it meanwhile writes nothing more.
    """
    now = clock or (lambda: datetime.now(timezone.utc))
    done, size, began, least = 0, CLAIM if at_once is None else at_once, None, float("inf")
    journal.require(holder, now())
    while most is None or done < most:
        at = now()
        if at_once is None and began:
            took = (at - began).total_seconds()
            least = min(least, took)
            size = paced(size, took, least, ttl)
        began = at
        journal.acquire(holder, at, ttl)
        claimed = claim(journal.opened(), size if most is None else min(size, most - done))
        journal.change(claimed.select("sequence", "status", F.lit(None).cast("string").alias("error_summary")))
        held = journal.opened().where("status = 'processing'")
        n = held.count()
        if n == 0:
            break
        try:
            outcomes = finish_status(materialize(held))
            journal.acquire(holder, now(), ttl)
            journal.change(accepted(journal.opened(), outcomes.select("sequence", "status", "error_summary")))
            left = journal.opened().where("status = 'processing'").select("sequence", F.lit("failed").alias("status"), F.lit("no outcome").alias("error_summary"))
            if not left.isEmpty():
                journal.change(left)
        except JournalError:
            raise
        except Exception as e:
            left = journal.opened().where("status = 'processing'")
            journal.change(left.select("sequence", F.lit("failed").alias("status"), F.lit(str(e) or type(e).__name__).alias("error_summary")))
        done += n
    return done


def replay(journal: Journal, holder: str, materialize: Materializer, retry_failed: bool = False, at_once: int | None = CLAIM, most: int | None = None, **timing) -> dict[str, int]:
    """Under one lease: recover interrupted events, retry failed ones on demand, then drain."""
    now = timing["clock"]() if timing.get("clock") else None
    journal.acquire(holder, now, timing.get("ttl", 300))
    try:
        recovered = journal.recover(retry_failed)
        return {"recovered": recovered, "processed": drain(journal, holder, materialize, at_once, most, **timing)}
    finally:
        journal.release(holder)


def sync_changed(journal: Journal, holder: str, found: DataFrame | None, materialize: Materializer, batch_id: int, **options) -> dict[str, int]:
    """Queue what a reconciliation found (event_kind, current_path, previous_path, observed_at, n), note its time, and replay."""
    if found is not None:
        journal.append(found, batch_id)
        journal.note("last_reconciliation_at", datetime.now(timezone.utc).isoformat(timespec="seconds"))
    return replay(journal, holder, materialize, **options)


def watch_once(journal: Journal, holder: str, found: DataFrame | None, observed: DataFrame, materialize: Materializer, batch_id: int, **options) -> dict[str, int]:
    """One cycle: reconciliation if given, the observed changes, replay; takes the batch numbers batch_id and batch_id + 1."""
    if found is not None:
        journal.append(found, batch_id)
        journal.note("last_reconciliation_at", datetime.now(timezone.utc).isoformat(timespec="seconds"))
    journal.append(observed, batch_id + 1)
    return replay(journal, holder, materialize, **options)


def materialize_sources(manifest: DataFrame, files: DataFrame) -> Materializer:
    """A materialiser over records (source_id, path, sha, state) and files now (path, sha, stable): what each event does."""

    def run(events: DataFrame) -> DataFrame:
        place = F.coalesce("current_path", "previous_path").alias("path")
        own = events.select("sequence", "event_kind", "previous_path", place)
        now = files.select("path", F.col("sha").alias("_sha"), "stable")
        records = manifest.groupBy("path").agg(F.min(F.struct("sha", "source_id")).alias("_r"))
        joined = own.join(now, "path", "left").join(records, "path", "left")
        gone = F.col("event_kind") == "deleted"
        result = (
            F.when(gone & F.col("previous_path").isNull(), "skipped:unsupported-event")
            .when(gone & F.col("_r").isNull(), "skipped:no-record")
            .when(gone, "source-missing")
            .when(F.col("event_kind") == "reconcile-required", "skipped:conflict")
            .when(F.col("_sha").isNull(), "error: source missing")
            .when(~F.col("stable"), "unstable")
            .when(F.col("_r").isNull(), "created")
            .when(F.col("_r.sha") == F.col("_sha"), "unchanged")
            .otherwise("updated")
        )
        return joined.select("sequence", result.alias("result"))

    return run


def applied_manifest(manifest: DataFrame, applied: DataFrame, files: DataFrame) -> DataFrame:
    """Records (source_id, path, sha, state) after applied events (event_kind, current_path, previous_path): deletes leave a tombstone and keep the row, others take the file's hash."""
    gone = applied.where("event_kind = 'deleted'").select(F.col("previous_path").alias("path"), F.lit(True).alias("_gone")).distinct()
    changed = applied.where("event_kind <> 'deleted'").select(F.col("current_path").alias("path")).distinct().join(files.select("path", F.col("sha").alias("_sha")), "path")
    joined = manifest.join(gone, "path", "left").join(changed, "path", "left")
    known = joined.select("source_id", "path", F.coalesce("_sha", "sha").alias("sha"), F.when(F.col("_gone"), "source_missing").when(F.col("_sha").isNotNull(), "clean").otherwise(F.col("state")).alias("state"))
    new = changed.join(manifest.select("path"), "path", "left_anti").select(F.concat(F.lit("src_"), F.left(F.sha2(F.concat_ws("\u0000", "path", "_sha"), 256), F.lit(20))).alias("source_id"), "path", F.col("_sha").alias("sha"), F.lit("clean").alias("state"))
    return known.unionByName(new)
