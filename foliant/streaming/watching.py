"""What a watcher needs to remember of each file: the fingerprint it was last queued with, until the file goes or nobody asks for long.

Notices of a file whose fingerprint is the one held are dropped; any other is let through once it has been quiet for a
while, the last of a burst only.  Timers fire by the watermark, so a quiet file leaves its change without another notice,
and state that was not touched for `keep` seconds goes.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from foliant.registry import query, table
from foliant.shared import scratch

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HELD = StructType([StructField("fingerprint", StringType()), StructField("at", LongType())])
WAITING = StructType([StructField("n", LongType()), StructField("fingerprint", StringType()), StructField("at", LongType())])
GONE = ""


class Watching(StatefulProcessor):
    """By file: the fingerprint let through last, and the change that waits for quiet."""

    def __init__(self, quiet: int, keep: int) -> None:
        self.quiet, self.keep = quiet * 1000, keep * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", HELD)
        self.waiting = handle.getValueState("waiting", WAITING)

    def _let_through(self, held: tuple | None, change: tuple) -> tuple[tuple | None, list[tuple]]:
        """What is held after a change, nothing if the file is gone, and the change, unless the file is as it was."""
        n, fingerprint, at = change
        same = held is not None and held[0] == fingerprint
        return None if fingerprint == GONE else (fingerprint, at), [] if same else [(n, fingerprint)]

    def _hold(self, held: tuple | None, before: tuple | None) -> None:
        if held is None and before is not None:
            self.held.clear()
        elif held is not None and held is not before:
            self.held.update(held)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        """A key's state is read and written once a batch, however many bursts its notices make; its only timer follows from it."""
        before, wait = self.held.get(), self.waiting.get()
        if wait is not None:
            self.handle.deleteTimer(wait[2] + self.quiet)
        elif before is not None:
            self.handle.deleteTimer(before[1] + self.quiet + self.keep)
        held, out = before, []
        for at, n, fingerprint in sorted((r["at"], r["n"], r["fingerprint"]) for r in rows):
            if wait is not None and at - wait[2] >= self.quiet:
                held, told = self._let_through(held, wait)
                out += told
            wait = (n, fingerprint, at)
        self._hold(held, before)
        self.waiting.update(wait)
        self.handle.registerTimer(wait[2] + self.quiet)
        yield from (Row(path=key[0], n=n, fingerprint=fingerprint) for n, fingerprint in out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        wait, out = self.waiting.get(), []
        if wait is not None:
            before = self.held.get()
            held, out = self._let_through(before, wait)
            self.waiting.clear()
            self._hold(held, before)
            if held is not None:
                self.handle.registerTimer(held[1] + self.quiet + self.keep)
        else:
            self.held.clear()  # nobody asked for long
        yield from (Row(path=key[0], n=n, fingerprint=fingerprint) for n, fingerprint in out)

    def close(self) -> None:
        """Nothing is open."""


def watched(notices: DataFrame, quiet: int, keep: int) -> DataFrame:
    """Notices (path, n, fingerprint, observed_at; an empty fingerprint says that the file is gone) that tell something new: path, n, fingerprint."""
    spark = notices.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    own = notices.select("path", "n", F.coalesce("fingerprint", F.lit(GONE)).alias("fingerprint"), F.unix_millis("observed_at").alias("at"), "observed_at").withWatermark("observed_at", "0 seconds")
    return own.groupBy("path").transformWithState(Watching(quiet, keep), "path string, n long, fingerprint string", "append", "eventTime")


def watched_once(spark: SparkSession, notices: DataFrame, place: str, quiet: int, keep: int) -> DataFrame:
    """A stream of notices run to its end."""
    found = watched(notices, quiet, keep)
    found.writeStream.format("parquet").option("path", f"{place}/told").option("checkpointLocation", f"{place}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("path string, n long, fingerprint string").parquet(f"{place}/told")


@query("""WITH e AS (SELECT 'notes/' || user_id AS path, event_id AS n, CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS fp, epoch_ms(ts) AS ms, lead(epoch_ms(ts)) OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS next_ms, max(epoch_ms(ts)) OVER () AS high FROM events),
q AS (SELECT * FROM e WHERE next_ms - ms >= 3600000 OR (next_ms IS NULL AND ms + 3600000 < high)), t AS (SELECT *, lag(fp) OVER (PARTITION BY path ORDER BY ms, n) AS before FROM q) SELECT path, n, fp AS fingerprint FROM t WHERE before IS NULL OR before = '' OR before <> fp""")
def stream_watched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices of the events table as a stream: of each burst the last, and only if the file is not as it was told before."""
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    notices = source.select(F.concat(F.lit("notes/"), "user_id").alias("path"), F.col("event_id").alias("n"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("fingerprint"), F.col("ts").cast("timestamp").alias("observed_at"))
    return watched_once(spark, notices, scratch(spark, "watch"), 3600, 1 << 31)
