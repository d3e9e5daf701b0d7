"""The change feed as Structured Streaming: normalise, coalesce, queue once in the journal; settle detection with state and timers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import paths
from foliant.operators.diffs import SNAPSHOTS_SQL, snapshot_diff, snapshots
from foliant.registry import query, table
from foliant.shared import scratch
from foliant.streaming import feed
from foliant.streaming.journal import KINDS, Journal, accepted, applied_manifest, claim, finish_counts, finish_status, high_water, materialize_sources, replay, unqueued


def normalize(changes: DataFrame) -> DataFrame:
    """Changes with a known kind whose paths are both looked at."""
    ok = lambda c: F.col(c).isNull() | paths.ignored_reason(F.col(c)).isNull()
    return changes.where(F.col("event_kind").isin(KINDS) & ok("current_path") & ok("previous_path") & (F.col("current_path").isNotNull() | F.col("previous_path").isNotNull()))


def coalesce(changes: DataFrame) -> DataFrame:
    """One change for each key: the place of the first, the payload of the last.  Deletes are keyed by their previous path."""
    key = F.coalesce("current_path", F.concat(F.lit("-"), F.col("previous_path")))
    last = F.max_by(F.struct("event_kind", "current_path", "previous_path", "observed_at"), F.struct("observed_at", "n")).alias("c")
    return changes.groupBy(key.alias("key")).agg(F.min("n").alias("n"), last).select("n", "c.*")


def native_changes(events: DataFrame) -> DataFrame:
    """What a file watcher reports (event_type, is_directory, src_path, dest_path, observed_at, n) as changes; folders and other types are dropped."""
    kind = F.when(F.col("event_type").isin("created", "moved", "deleted"), F.col("event_type")).when(F.col("event_type").isin("modified", "closed", "opened"), "modified")
    rows = events.where(~F.col("is_directory")).withColumn("event_kind", kind).where("event_kind is not null")
    current = F.when(F.col("event_kind") == "moved", F.col("dest_path")).when(F.col("event_kind") != "deleted", F.col("src_path"))
    previous = F.when(F.col("event_kind").isin("moved", "deleted"), F.col("src_path"))
    return rows.select("event_kind", current.alias("current_path"), previous.alias("previous_path"), "observed_at", "n")


def static_feed(spark: SparkSession, changes: list[tuple]) -> DataFrame:
    """A list of changes (event_kind, current_path, previous_path, observed_at) as a feed."""
    return spark.createDataFrame([(*c, n) for n, c in enumerate(changes)], "event_kind string, current_path string, previous_path string, observed_at timestamp, n long")


def watched_files(spark: SparkSession, root: str) -> DataFrame:
    """New files below a folder as a stream of changes; contents are not read."""
    found = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(root)
    path = F.replace(F.col("path"), F.lit(f"{root.rstrip('/')}/"), F.lit(""))
    return found.select(F.lit("modified").alias("event_kind"), F.regexp_replace(path, "^[a-z]+:", "").alias("current_path"), F.lit(None).cast("string").alias("previous_path"), F.col("modificationTime").alias("observed_at"), F.unix_micros("modificationTime").alias("n"))


def queue_batches(journal: Journal):
    """A function for foreachBatch that normalises, coalesces and queues."""
    return lambda batch, batch_id: journal.append(coalesce(normalize(batch)), batch_id)


def observed(events: DataFrame) -> DataFrame:
    """Events of the test table as changes of note paths."""
    kind = F.when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "error", "deleted").when(F.col("event_type") == "purchase", "moved").otherwise("modified")
    path = F.concat(F.lit("notes/"), F.col("user_id"), F.lit(".md"))
    return events.select(F.col("event_id").alias("n"), kind.alias("event_kind"), F.when(kind != "deleted", path).alias("current_path"), F.when(kind.isin("deleted", "moved"), F.concat(F.lit("old/"), path)).alias("previous_path"), F.col("ts").alias("observed_at"))


def folder(spark: SparkSession) -> str:
    return scratch(spark, "stream")


CHANGES_SQL = """c AS (SELECT event_id AS n, ts, CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' WHEN 'purchase' THEN 'moved' ELSE 'modified' END AS kind, 'notes/' || user_id || '.md' AS p FROM events),
k AS (SELECT min(n) AS n, arg_max(kind, (ts, n)) AS kind, any_value(p) AS p FROM c GROUP BY CASE WHEN kind = 'deleted' THEN '-old/' || p ELSE p END),
j AS (SELECT row_number() OVER (ORDER BY n) AS sequence, kind, p FROM k)"""


def streamed_journal(spark: SparkSession, sf_dir: str) -> Journal:
    """The journal after the events table ran through the stream to its end."""
    place = folder(spark)
    journal = Journal(spark, f"{place}/journal")
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    running = observed(source).writeStream.foreachBatch(queue_batches(journal)).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
    running.awaitTermination()
    return journal


@query(f"""WITH {CHANGES_SQL} SELECT sequence, kind AS event_kind, CASE WHEN kind <> 'deleted' THEN p END AS current_path, CASE WHEN kind IN ('deleted', 'moved') THEN 'old/' || p END AS previous_path, 'queued' AS status FROM j""")
def stream_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change feed as a file stream, run to its end in one trigger; the journal's rows."""
    return streamed_journal(spark, sf_dir).read().select("sequence", "event_kind", "current_path", "previous_path", "status")


def settle(changes: DataFrame, seconds: int) -> DataFrame:
    """A key's change (key, n, observed_at) is out once none followed for so long: at the next change, or when the watermark passes."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterable[pd.DataFrame]:
        if state.hasTimedOut:
            n = state.get[0]
            state.remove()
            yield pd.DataFrame([(key[0], n)], columns=["key", "n"])
            return
        held = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["observed_at", "n"])
        at, n = rows["observed_at"].astype("int64").to_numpy() // 1000, rows["n"].to_numpy()
        if held is not None:
            at, n = [held[1], *at], [held[0], *n]
        out = [(key[0], int(n[k])) for k in range(len(n) - 1) if at[k + 1] - at[k] >= seconds * 1_000_000]
        state.update((int(n[-1]), int(at[-1])))
        state.setTimeoutTimestamp(max(int(at[-1]) // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "n"])

    return changes.withWatermark("observed_at", "0 seconds").groupBy("key").applyInPandasWithState(step, "key string, n long", "n long, at long", "append", "EventTimeTimeout")


@query("""WITH e AS (SELECT 'notes/' || user_id AS key, event_id AS n, epoch_us(ts) AS us, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_us, max(epoch_us(ts)) OVER () AS last_us FROM events) SELECT key, n FROM e WHERE next_us - us >= 7200000000 OR (next_us IS NULL AND us // 1000 + 7200000 < last_us // 1000)""")
def stream_settle(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = folder(spark)
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    keyed = source.select(F.concat(F.lit("notes/"), F.col("user_id")).alias("key"), F.col("event_id").alias("n"), F.col("ts").cast("timestamp").alias("observed_at"))
    running = settle(keyed, 7200).writeStream.format("parquet").option("path", f"{place}/settled").option("checkpointLocation", f"{place}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema("key string, n long").parquet(f"{place}/settled")


@query("""SELECT count(*) AS n_claimed, min(event_id) AS first, max(event_id) AS last FROM (SELECT event_id FROM events WHERE event_type IN ('view', 'click') ORDER BY event_id LIMIT 100)""")
def journal_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    journal = events.select(F.col("event_id").alias("sequence"), F.when(F.col("event_type").isin("view", "click"), "ready").otherwise("applied").alias("status"))
    return claim(journal, 100).agg(F.count(F.lit(1)).alias("n_claimed"), F.min("sequence").alias("first"), F.max("sequence").alias("last"))


REPLAY_SQL = f"""{CHANGES_SQL}, o AS (SELECT sequence, kind, CASE WHEN kind = 'deleted' THEN 'review-required' WHEN sequence % 4 = 0 THEN 'failed' ELSE 'applied' END AS status FROM j)"""


def _materialize(events: DataFrame) -> DataFrame:
    result = F.when(F.col("event_kind") == "deleted", "skipped:no-record").when(F.col("sequence") % 4 == 0, "unstable").otherwise("created(.mirror.md)")
    return events.select("sequence", result.alias("result"))


@query(f"""WITH {REPLAY_SQL} SELECT status, count(*) AS n, CASE WHEN status = 'failed' THEN 2 * count(*) ELSE count(*) FILTER (sequence <= 3) END AS retries FROM o GROUP BY status""")
def journal_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A journal whose first three events were interrupted, replayed three times, the later two with the failed ones again, after a restart each time; retries as the journal counts them."""
    journal = streamed_journal(spark, sf_dir)
    first = journal.read().orderBy("sequence").limit(3)
    journal.change(first.select("sequence", F.lit("processing").alias("status"), F.lit(None).cast("string").alias("error_summary")))
    replay(Journal(spark, journal.folder), "a", _materialize, at_once=None)
    for holder in ("b", "c"):
        replay(Journal(spark, journal.folder), holder, _materialize, retry_failed=True, at_once=None)
    done = Journal(spark, journal.folder).read()
    return done.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("retry_count").cast("long").alias("retries"))


@query(f"""WITH {REPLAY_SQL} SELECT count(*) AS processed, count(*) FILTER (status = 'applied') AS applied, count(*) FILTER (status = 'review-required') AS review_required, count(*) FILTER (status = 'failed') AS failed FROM o""")
def journal_finish_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a replay ended; outcomes of events that are not processing are refused."""
    journal = streamed_journal(spark, sf_dir)
    held = claim(journal.read(), 1 << 30)
    outcomes = finish_status(_materialize(held))
    strangers = outcomes.select((F.col("sequence") + 1_000_000_000).alias("sequence"), "status", "error_summary")
    return finish_counts(accepted(held, outcomes.unionByName(strangers)))


@query("""WITH j AS (SELECT event_id AS s, event_type = 'view' AS done FROM events) SELECT max(s) AS last_observed, max(CASE WHEN done THEN s END) AS last_applied, coalesce(min(CASE WHEN NOT done THEN s END) - 1, max(s)) AS applied_up_to FROM j""")
def journal_high_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    journal = table(spark, sf_dir, "events").select(F.col("event_id").alias("sequence"), F.when(F.col("event_type") == "view", "applied").otherwise("queued").alias("status"))
    return high_water(journal)


NATIVE = {"event_type": "CASE event_id % 8 WHEN 0 THEN 'created' WHEN 1 THEN 'moved' WHEN 2 THEN 'deleted' WHEN 3 THEN 'closed' WHEN 4 THEN 'opened' WHEN 5 THEN 'modified' WHEN 6 THEN 'accessed' ELSE 'modified' END", "is_directory": "event_id % 11 = 0", "src_path": "'a/' || user_id", "dest_path": "'b/' || user_id", "observed_at": "ts", "n": "event_id"}


NATIVE_SQL = "WITH e AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in NATIVE.items()) + """ FROM events) SELECT n, CASE WHEN event_type IN ('created', 'moved', 'deleted') THEN event_type ELSE 'modified' END AS event_kind, CASE event_type WHEN 'moved' THEN dest_path WHEN 'deleted' THEN NULL ELSE src_path END AS current_path,
CASE WHEN event_type IN ('moved', 'deleted') THEN src_path END AS previous_path FROM e WHERE NOT is_directory AND event_type <> 'accessed'"""


@query(NATIVE_SQL)
def watch_log_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A watcher's log read as a stream that is stopped and started again: moves and deletes arrive, and each event once."""
    place = folder(spark)
    events = table(spark, sf_dir, "events").selectExpr(*[f"{e} AS {c}" for c, e in NATIVE.items()])
    middle = events.agg(F.floor(F.avg("n"))).first()[0] or 0

    def run() -> None:
        found = native_changes(feed.watch_log(spark, f"{place}/log")).select("n", "event_kind", "current_path", "previous_path")
        found.writeStream.format("parquet").option("path", f"{place}/changes").option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    for part, rows in (("0", events.where(F.col("n") <= middle)), ("1", events.where(F.col("n") > middle))):
        feed.as_segments(rows, f"{place}/written{part}")
        feed.append_segments(spark, f"{place}/written{part}", f"{place}/log", part)
        run()
    return spark.read.schema("n long, event_kind string, current_path string, previous_path string").parquet(f"{place}/changes")


@query(NATIVE_SQL)
def native_event_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").selectExpr(*[f"{e} AS {c}" for c, e in NATIVE.items()])
    return native_changes(events).select("n", "event_kind", "current_path", "previous_path")


@query(f"""WITH {SNAPSHOTS_SQL}, found AS (SELECT n.path, NULL::VARCHAR AS previous_path, 'modified' AS kind FROM now n JOIN rec r USING (path) WHERE n.size <> r.size UNION ALL SELECT path, CASE WHEN turn = 1 THEN prev END, CASE WHEN turn = 1 THEN 'moved' ELSE 'created' END FROM turns UNION ALL SELECT path, NULL, CASE WHEN n = 0 THEN 'created' ELSE 'reconcile-required' END FROM cand WHERE n <> 1
UNION ALL SELECT NULL, path, 'deleted' FROM gone g WHERE path NOT IN (SELECT prev FROM turns) AND NOT EXISTS (SELECT 1 FROM cand c JOIN fresh f USING (path) WHERE c.n > 1 AND f.size = g.size AND f.sha = g.sha))
SELECT kind, count(*) AS found, count(*) FILTER (NOT (kind = 'modified' AND starts_with(path, 'en/'))) AS queued FROM found GROUP BY kind""")
def reconciled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reconciliation finds by kind, and what of it is queued as no open event says it already."""
    found = snapshot_diff(*snapshots(spark, sf_dir)).select(F.col("kind").alias("event_kind"), F.col("path").alias("current_path"), "previous_path")
    journal = found.where("event_kind = 'modified' and current_path like 'en/%'").withColumn("status", F.lit("failed"))
    queued = unqueued(journal, found).groupBy("event_kind").agg(F.count(F.lit(1)).alias("queued"))
    counts = found.groupBy("event_kind").agg(F.count(F.lit(1)).alias("found")).join(queued, "event_kind", "left")
    return counts.select(F.col("event_kind").alias("kind"), "found", F.coalesce("queued", F.lit(0)).alias("queued"))


MANIFEST_SQL = """files AS (SELECT 'notes/' || c_custkey || '.md' AS path, md5(c_name) AS sha, c_acctbal > 0 AS stable FROM customer), man AS (SELECT 'src_' || c_custkey AS source_id, CASE WHEN c_nationkey % 4 = 0 THEN 'old/notes/' || c_custkey || '.md' ELSE 'notes/' || c_custkey || '.md' END AS path, CASE WHEN c_nationkey % 3 = 0 THEN md5(c_name) ELSE 'x' END AS sha, 'stale' AS state FROM customer)"""


def materialized(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The manifest, the files and the results of the events on them."""
    customers = table(spark, sf_dir, "customer")
    path = F.concat(F.lit("notes/"), "c_custkey", F.lit(".md"))
    files = customers.select(path.alias("path"), F.md5("c_name").alias("sha"), (F.col("c_acctbal") > 0).alias("stable"))
    manifest = customers.select(F.concat(F.lit("src_"), "c_custkey").alias("source_id"), F.when(F.col("c_nationkey") % 4 == 0, F.concat(F.lit("old/"), path)).otherwise(path).alias("path"), F.when(F.col("c_nationkey") % 3 == 0, F.md5("c_name")).otherwise("x").alias("sha"), F.lit("stale").alias("state"))
    events = coalesce(observed(table(spark, sf_dir, "events"))).select(F.col("n").alias("sequence"), "event_kind", "current_path", "previous_path")
    return manifest, files, events.join(materialize_sources(manifest, files)(events), "sequence")


RESULT_SQL = f"""{CHANGES_SQL}, {MANIFEST_SQL}, x AS (SELECT n AS sequence, kind, CASE WHEN kind <> 'deleted' THEN p END AS cur, CASE WHEN kind IN ('deleted', 'moved') THEN 'old/' || p END AS prev FROM k),
m AS (SELECT path, arg_min(sha, (sha, source_id)) AS rsha FROM man GROUP BY path), res AS (SELECT x.*, CASE WHEN kind = 'deleted' THEN CASE WHEN rsha IS NULL THEN 'skipped:no-record' ELSE 'source-missing' END WHEN f.sha IS NULL THEN 'error: source missing' WHEN NOT f.stable THEN 'unstable' WHEN rsha IS NULL THEN 'created' WHEN rsha = f.sha THEN 'unchanged' ELSE 'updated' END AS result
FROM x LEFT JOIN files f ON f.path = coalesce(cur, prev) LEFT JOIN m ON m.path = coalesce(cur, prev))"""


@query(f"WITH {RESULT_SQL} SELECT sequence, kind AS event_kind, result FROM res")
def materialized_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What processing each coalesced event did."""
    return materialized(spark, sf_dir)[2].select("sequence", "event_kind", "result")


@query(f"""WITH {RESULT_SQL}, ap AS (SELECT * FROM res WHERE result IN ('created', 'updated', 'unchanged', 'source-missing')), g AS (SELECT DISTINCT prev AS path FROM ap WHERE kind = 'deleted'), ch AS (SELECT DISTINCT cur AS path, f.sha FROM ap JOIN files f ON f.path = cur WHERE kind <> 'deleted')
SELECT source_id, man.path, coalesce(ch.sha, man.sha) AS sha, CASE WHEN g.path IS NOT NULL THEN 'source_missing' WHEN ch.sha IS NOT NULL THEN 'clean' ELSE state END AS state FROM man LEFT JOIN g ON g.path = man.path LEFT JOIN ch ON ch.path = man.path
UNION ALL SELECT 'src_' || left(sha256(path || chr(0) || sha), 20), path, sha, 'clean' FROM ch WHERE path NOT IN (SELECT path FROM man)""")
def materialized_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest after all applied events; deletes leave tombstones."""
    manifest, files, results = materialized(spark, sf_dir)
    applied = finish_status(results).where("status = 'applied'").select("sequence")
    return applied_manifest(manifest, results.join(applied, "sequence", "left_semi"), files)


