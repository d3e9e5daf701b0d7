"""Rounds of a replay: few of them, each claiming exactly the lowest sequences."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from foliant.streaming import journal

CHANGE = "n long, event_kind string, current_path string, previous_path string, observed_at timestamp"


def queued(spark, n):
    path = F.concat(F.lit("notes/"), F.col("id"))
    return spark.range(n).select(F.col("id").alias("n"), F.lit("created").alias("event_kind"), path.alias("current_path"), F.lit(None).cast("string").alias("previous_path"), F.lit(None).cast("timestamp").alias("observed_at"))


def test_large_replay_has_few_rounds(spark, tmp_path):
    own = journal.Journal(spark, str(tmp_path / "journal"))
    own.append(queued(spark, 65_000), 0)
    rounds = []

    def work(events):
        rounds.append(events.agg(F.min("sequence"), F.max("sequence"), F.count(F.lit(1))).first()[:])
        return events.select("sequence", F.when(F.col("sequence") % 4 == 0, "unstable").otherwise("created").alias("result"))

    times = [datetime(2024, 1, 1, tzinfo=timezone.utc)]

    def clock():
        times.append(times[-1] + timedelta(seconds=5))  # 10 s a round, so that the next may claim 16 times as many
        return times[-1]

    assert journal.replay(own, "w", work, at_once=None, clock=clock) == {"recovered": 0, "processed": 65_000}
    assert rounds == [(1, 10_000, 10_000), (10_001, 65_000, 55_000)]
    ended = {r["status"]: r["count"] for r in own.read().groupBy("status").count().collect()}
    assert ended == {"applied": 48_750, "failed": 16_250}
    rounds.clear()
    assert journal.replay(own, "w", work, retry_failed=True, at_once=None, most=12_000, clock=clock)["processed"] == 12_000
    assert [n for _, _, n in rounds] == [10_000, 2_000]
    assert own.read().where("status = 'queued'").agg(F.min("sequence")).first()[0] == 48_004


def test_slow_rounds_do_not_outgrow_the_lease():
    assert journal.paced(10_000, 10, 10, 300) == 160_000
    assert journal.paced(160_000, 160, 10, 300) == 80_000  # half of a claim that took 150 s
    assert journal.paced(10_000, 500, 10, 300) == 10_000
    assert journal.paced(10_000, 60, 60, 300) == 50_000  # 300 s at most
    assert journal.paced(10_000, 0, 0, 300) == 160_000


def test_slow_looks_at_open_events_do_not_keep_rounds_small():
    size, rounds = journal.CLAIM, 1
    while size < 50_000_000:  # a look takes more than the lease, whatever the claim
        size, rounds = journal.paced(size, 400, 400, 300), rounds + 1
    assert rounds <= 14


def test_large_claims_are_exact_and_do_not_sort_all(spark):
    rows = spark.range(200_000).select((F.col("id") + 1).alias("sequence"), F.when(F.col("id") % 3 == 0, "applied").otherwise("queued").alias("status"))
    rows = rows.unionByName(spark.createDataFrame([(None, "ready")], "sequence long, status string"))
    for count in (10_001, 87_381, 87_382, 133_334):
        got = journal.claim(rows, count)
        want = rows.where("status in ('queued', 'ready')").orderBy("sequence").limit(count)
        assert got.select("sequence").exceptAll(want.select("sequence")).isEmpty() and got.count() == want.count() == count
    everything = journal.claim(rows, 1 << 30)
    assert everything.count() == 133_334 and "TakeOrdered" not in everything._jdf.queryExecution().toString()


def test_retries_of_the_query_were_made(spark, monkeypatch):
    from collections import Counter

    from foliant.streaming import changes

    tried, work = Counter(), changes._materialize

    def counted(events):
        tried.update(r["sequence"] for r in events.select("sequence").collect())
        return work(events)

    monkeypatch.setattr(changes, "_materialize", counted)
    ended = {r["status"]: (r["n"], r["retries"]) for r in changes.journal_replay(spark, "/root/testdata/sf0.001").collect()}
    failed = [s for s, n in tried.items() if n == 3]
    assert len(failed) == ended["failed"][0] > 0 and ended["failed"][1] == 2 * len(failed)
    assert set(tried.values()) == {1, 3} and all(s % 4 == 0 for s in failed)
