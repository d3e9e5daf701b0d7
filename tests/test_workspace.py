"""Journal, sinks, configuration, views and the command line."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from foliant import __main__ as command
from foliant import config
from foliant.operators import lint, overlap
from foliant.plans import views
from foliant.sources import corpus, repositories, sinks
from foliant.streaming import changes, journal

CHANGE = "n long, event_kind string, current_path string, previous_path string, observed_at timestamp"


def batch(spark, *rows):
    return spark.createDataFrame([(*r, None) for r in rows], CHANGE)


def states(own):
    return [(r.sequence, r.event_kind, r.current_path or r.previous_path, r.status, r.retry_count) for r in own.read().orderBy("sequence").collect()]


def test_journal_survives_repeats_and_restarts(spark, tmp_path):
    folder = str(tmp_path / "journal")
    first = batch(spark, (1, "modified", "a.md", None), (2, "modified", "a.md", None), (3, "modified", "_mirrors/a.md", None), (4, "deleted", None, "b.md"), (5, "deleted", None, "c.md"), (6, "odd", "d.md", None))
    queue = changes.queue_batches(journal.Journal(spark, folder))
    queue(first, 0)
    queue(first, 0)
    want = [(1, "modified", "a.md", "queued", 0), (2, "deleted", "b.md", "queued", 0), (3, "deleted", "c.md", "queued", 0)]
    assert states(journal.Journal(spark, folder)) == want
    changes.queue_batches(journal.Journal(spark, folder))(first, 1)  # all are open already
    changes.queue_batches(journal.Journal(spark, folder))(batch(spark, (9, "created", "e.md", None)), 2)
    assert states(journal.Journal(spark, folder)) == [*want, (4, "created", "e.md", "queued", 0)]
    empty = journal.Journal(spark, str(tmp_path / "none"))
    changes.queue_batches(empty)(first.limit(0), 0)
    assert states(empty) == [] and empty.status().where("n > 0").count() == 0


def test_lease_finish_and_replay(spark, tmp_path):
    own = journal.Journal(spark, str(tmp_path / "journal"))
    own.append(batch(spark, *[(i, "created", f"{i}.md", None) for i in range(1, 7)]), 0)
    now = datetime(2024, 1, 1, tzinfo=timezone.utc)
    own.acquire("a", now, 60)
    own.acquire("a", now + timedelta(seconds=30), 60)
    with pytest.raises(journal.JournalError):
        own.acquire("b", now + timedelta(seconds=80), 60)
    own.acquire("b", now + timedelta(seconds=100), 60)
    with pytest.raises(journal.JournalError):
        own.require("a", now + timedelta(seconds=101))
    own.release("b")
    own.transition([1], "processing")
    with pytest.raises(journal.JournalError):
        own.transition([99], "applied")
    outcomes = spark.createDataFrame([(1, "applied", None), (2, "applied", None), (1, "queued", None)], "sequence long, status string, error_summary string")
    assert [r.sequence for r in journal.accepted(own.read(), outcomes).collect()] == [1]

    def work(events):
        return events.select("sequence", F.when(F.col("sequence") == 2, "unstable").otherwise("created(.mirror.md)").alias("result"))

    assert journal.replay(own, "c", work, at_once=2, most=4) == {"recovered": 1, "processed": 4}
    assert [(s, r) for _, _, _, s, r in states(own)] == [("applied", 1), ("failed", 0), ("applied", 0), ("applied", 0), ("queued", 0), ("queued", 0)]

    def broken(events):
        raise RuntimeError("x" * 500)

    assert journal.replay(journal.Journal(spark, own.folder), "c", broken, retry_failed=True)["processed"] == 3
    rows = own.read().where("status = 'failed'").collect()
    assert [(r.sequence, len(r.error_summary)) for r in sorted(rows)] == [(2, 160), (5, 160), (6, 160)] and sorted(rows)[0].retry_count == 1
    done = journal.watch_once(own, "d", batch(spark, (1, "deleted", None, "x.md")), batch(spark, (2, "modified", "y.md", None)), work, 1)
    assert done["processed"] == 2 and own.noted("last_reconciliation_at")
    assert journal.high_water(own.read()).first().asDict() == {"last_observed": 8, "last_applied": 8, "applied_up_to": 1}


def test_numbers_follow_an_order_without_one_task(spark, tmp_path):
    rows = spark.createDataFrame([(i * i,) for i in range(500)], "n long").repartition(7)
    got = journal.numbered(rows, "n", 10, str(tmp_path / "a")).orderBy("sequence").collect()
    assert [(r.sequence, r.n) for r in got] == [(11 + i, i * i) for i in range(500)]
    burst = spark.createDataFrame([(7, f"p{i:03}") for i in range(400)], "n long, path string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    placed = journal.numbered(burst, "n", 0, str(tmp_path / "b")).orderBy("sequence").collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [(r.sequence, r.path) for r in placed] == [(1 + i, f"p{i:03}") for i in range(400)]
    assert spark.read.parquet(str(tmp_path / "b")).select("_b").distinct().count() > 1  # equal times in several tasks


def test_journal_compacts_and_reads_its_tail_only(spark, tmp_path):
    folder = str(tmp_path / "journal")
    plain, held = {}, 0

    def work(events):
        return events.select("sequence", F.when(F.col("sequence") % 5 == 0, "unstable").otherwise("created").alias("result"))

    for number in range(14):
        own = journal.Journal(spark, folder, compact_every=5)  # a restart each time
        own.append(batch(spark, (2 * number, "created", f"{number}.md", None), (2 * number + 1, "modified", "same.md", None)), number)
        if number % 3 == 2:
            journal.replay(own, "w", work)
        batches, steps = own.tail()
        assert len(batches) + len(steps) < 5
        held = max(held, len(own._names("events")) + len(own._names("changes")))
    assert held <= 12 and own.head()["number"] >= 4
    rows = own.read().orderBy("sequence").collect()
    assert [r.sequence for r in rows] == list(range(1, len(rows) + 1))
    paths = [r.current_path for r in rows]
    assert [p for p in paths if p != "same.md"] == [f"{n}.md" for n in range(14)] and paths.count("same.md") >= 2
    assert all(r.status == ("failed" if r.sequence % 5 == 0 else "applied") for r in rows if r.sequence <= 4 or r.status in ("failed", "applied"))
    own.append(batch(spark, (1, "created", "0.md", None)), 3)  # a batch that is covered is not written again
    assert own.last_sequence() == len(rows)
    opened = {r.sequence for r in own.opened().where(F.col("status").isin(journal.OPEN)).collect()}
    assert opened == {r.sequence for r in rows if r.status in journal.OPEN}
    own.transition([1], "queued", retry=True)  # a closed event is open again
    again = journal.Journal(spark, folder)
    assert {r.sequence: r.retry_count for r in again.opened().where("status = 'queued'").collect()}[1] == 1
    assert again.read().count() == len(rows) and again.read().select("sequence").distinct().count() == len(rows)


def test_long_drains_renew_their_lease(spark, tmp_path):
    own = journal.Journal(spark, str(tmp_path / "journal"))
    own.append(batch(spark, *[(i, "created", f"{i}.md", None) for i in range(4)]), 0)
    times = [datetime(2024, 1, 1, tzinfo=timezone.utc)]

    def clock():
        times.append(times[-1] + timedelta(seconds=40))  # a round lasts longer than half the lease
        return times[-1]

    done = journal.replay(own, "w", lambda e: e.select("sequence", F.lit("created").alias("result")), at_once=1, clock=clock, ttl=60)
    assert done["processed"] == 4 and times[-1] - times[0] > timedelta(seconds=300)

    def robbed(events):
        own.acquire("thief", clock() + timedelta(hours=1), 10_000)
        return events.select("sequence", F.lit("created").alias("result"))

    own.append(batch(spark, (9, "created", "z.md", None)), 1)
    with pytest.raises(journal.JournalError):
        journal.replay(own, "w", robbed, clock=clock, ttl=60)
    assert [r.status for r in own.read().where("sequence = 5").collect()] == ["processing"]


def test_sinks_refuse_and_replace(spark, tmp_path):
    root = str(tmp_path)
    sinks.write_text(spark, f"{root}/a/b.txt", "one\n")
    sinks.write_text(spark, f"{root}/a/b.txt", "two\n")
    assert sinks.read_text(spark, f"{root}/a/b.txt") == "two\n" and not [p for p in (tmp_path / "a").iterdir() if p.name.endswith(".tmp")]
    with pytest.raises(sinks.SinkError):
        sinks.write_text(spark, f"{root}/a/b.txt", "three", force=False)
    records = spark.createDataFrame([("a", ["x", "y"]), ("b", [])], "source_id string, warnings array<string>")
    turned = spark.createDataFrame([("b", []), ("a", ["y", "x"])], "source_id string, warnings array<string>")
    assert sinks.write_manifest(records, f"{root}/m") and not sinks.write_manifest(turned, f"{root}/m")
    assert sinks.write_manifest(records.limit(1), f"{root}/m") and sinks.read_written_manifest(spark, f"{root}/m", "source_id string").count() == 1
    artefacts = spark.createDataFrame([("c.md", "h", 3)], "path string, sha string, size long")
    reviews = spark.createDataFrame([("c.md", "ok", "me", " fine "), ("c.md", "ok", "me", "a\nb"), ("d.md", "ok", "me", ""), ("c.md", "ok", " ", "")], "artifact_path string, status string, reviewer string, note string")
    refused = sinks.append_reviews(reviews, artefacts, f"{root}/reviews")
    assert sorted(r.problem for r in refused.collect()) == ["no reviewer", "no such artefact", "several lines"]
    assert [(r.note, r.artifact_sha256) for r in spark.read.json(f"{root}/reviews").collect()] == [("fine", "h")]
    actions = spark.createDataFrame([("s/a.md", "x", None), ("s/b.md", "y", "conflict")], "path string, content string, blocker string")
    with pytest.raises(sinks.SinkError):
        sinks.write_sidecars(spark, root, actions)
    assert not (tmp_path / "s").exists() and sinks.write_sidecars(spark, root, actions.where("blocker is null")) == 1
    templates = {"t/a.md": "new", "t/b.md": "new", "t/c.md": "new"}
    sinks.write_text(spark, f"{root}/t/a.md", "old")
    sinks.write_text(spark, f"{root}/t/c.md", "mine")
    plan = sinks.migration_plan(spark, root, templates, ["docs"], {"t/a.md": "old"})
    assert [(p["path"], p["action"]) for p in plan] == [("docs", "create-folder"), ("t/a.md", "copy"), ("t/b.md", "copy"), ("t/c.md", "blocker")]
    with pytest.raises(sinks.SinkError):
        sinks.apply_migration(spark, root, templates, plan)
    assert sinks.apply_migration(spark, root, templates, plan[:3]) == 3 and sinks.read_text(spark, f"{root}/t/a.md") == "new"
    sinks.write_scaffold(records, f"{root}/pack.json", "rows")
    assert sinks.read_text(spark, f"{root}/pack.json").count("source_id") == 2


def test_configuration(spark, tmp_path):
    assert lint.config_problems(lint.SAMPLE) == lint.PROBLEM_ROWS
    assert config.read_mapping(spark, str(tmp_path / "no.json")) == ({}, [(str(tmp_path / "no.json"), "missing")])
    (tmp_path / "bad.json").write_text("{")
    assert config.read_mapping(spark, str(tmp_path / "bad.json"))[1][0][1].startswith("invalid")
    routes, warnings, problems = config.domain_map({"domains": {"en": {"folder": "01_en", "aliases": ["x"]}, "it": {"folder": "it"}}}, {"en": "en"})
    assert routes == [("en", "en", "en"), ("it", "it", "it"), ("x", "en", "en")] and len(warnings) == 1 and not problems
    assert config.safe_output("reports/a.md", ".md") == "reports/a.md"
    for bad in ("../a.md", "_meta/a.md", "a.txt", ".x/a.md"):
        with pytest.raises(ValueError):
            config.safe_output(bad, ".md")
    assert [config.source_boundary("/a/b", s) for s in (None, "/a/b/", "/a", "/a/b/c", "/x")] == ["not-provided", "same", "inside-source", "source-inside", "distinct"]
    rules = ["*.log", "!keep.log", "build/", "/top.txt", "docs/*.md"]
    names = ["a/x.log", "keep.log", "build/x", "build", "a/build/x", "top.txt", "docs/a.md", "b/docs/a.md"]
    frame = spark.createDataFrame([(n,) for n in names], "p string")
    got = {r.p: r.x for r in frame.select("p", config.ignored_by(F.col("p"), rules).alias("x")).collect()}
    assert got == {"a/x.log": True, "keep.log": False, "build/x": True, "build": True, "a/build/x": False, "top.txt": True, "docs/a.md": True, "b/docs/a.md": False}
    assert config.extensions({"include_pdf": True})[-1] == ".pdf" and ".pdf" not in config.extensions({})


def test_frontmatter_values():
    head = "---\na: 'it''s: x' # no\nb: \"q \\\"z\\\"\"\nc: [1, 'x, y']\nd:\n  - one\n  - two\ne:\n  f: deep\ng: |\n  l1\n  l2\nh: >\n  m1\n  m2\ni: http://x/y#z\n---\nbody"
    fields, body = corpus.parse_frontmatter(head, "mirror")
    assert fields == {"a": "it's: x", "b": 'q "z"', "c": "1, x, y", "d": "one, two", "e": "", "e.f": "deep", "g": "l1\nl2", "h": "m1 m2", "i": "http://x/y#z"} and body == "body"
    assert corpus.parse_frontmatter("---\na: [x\n---\nb", "line") == (None, "---\na: [x\n---\nb")


def test_trees_logs_and_provenance(spark):
    import hashlib

    tree = spark.createDataFrame([("r", "b", bytearray(b"2")), ("r", "a", bytearray(b"1")), ("r", ".git/x", bytearray(b"3"))], "repo string, path string, content binary")
    assert corpus.tree_sha(tree).first().sha == "local-" + hashlib.sha256(b"a\x001\x00b\x002\x00").hexdigest()[:40]
    log = spark.createDataFrame([("h1\t2024\tsub\tject",), ("odd",)], "value string")
    assert [tuple(r) for r in corpus.commit_log(log).collect()] == [("h1", "2024", "sub\tject")]
    assert [r.path for r in corpus.allowed_data(spark.createDataFrame([("see `a/b.csv` and `c`",)], "text string")).collect()] == ["a/b.csv"]
    heads = spark.createDataFrame([("a.md", bytearray(b"---\ntype: guide\n---\nx")), ("b.md", bytearray(b"none")), ("c.md", bytearray(b"---\ntype: x"))], "path string, content binary")
    assert {r.path: r.type for r in corpus.note_types(heads).collect()} == {"a.md": "guide", "b.md": "", "c.md": ""}


def test_manifest_errors(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"records": [{"repo_id": "a", "warnings": ["w"]}, 5, {"x": 1}]}')
    found = corpus.manifest_errors(spark, str(tmp_path / "m.json"), "repo_id").orderBy("pos").collect()
    assert [(r.pos, r.error) for r in found] == [(1, "not an object"), (2, "repo_id missing")]
    (tmp_path / "r.json").write_text('{"schema_version": 1, "records": [{"repo_id": "a", "warnings": ["w"]}]}')
    assert [(r.repo_id, r.warnings) for r in corpus.repo_manifest(spark, str(tmp_path / "r.json")).collect()] == [("a", ["w"])]


def test_views_state(spark, tmp_path):
    root = str(tmp_path)
    assert views.plan(spark, root, views.SAMPLE)["state"] == "missing" and views.write(spark, root, views.SAMPLE)
    assert views.plan(spark, root, views.SAMPLE)["state"] == "current" and not views.write(spark, root, views.SAMPLE)
    sinks.write_text(spark, f"{root}/documents.views.json", "old")
    assert views.plan(spark, root, views.SAMPLE)["state"] == "stale"


def test_overlap_finds_what_all_pairs_do(spark):
    import itertools
    import random

    rng = random.Random(4)
    words = [f"word{i}" for i in range(60)]
    sets = {i: frozenset(rng.sample(words, rng.randint(1, 25))) for i in range(120)}
    sets |= {200 + i: frozenset([*sets[i]][1:] + ["extra"]) for i in range(60)}
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in sets.items()], "doc_id long, text string")
    for threshold, least in ((0.55, 1), (0.72, 5)):
        got = {(r.left_id, r.right_id) for r in overlap.similar_pairs(overlap.term_classes(rows), threshold, least).collect()}
        heads = {}
        for i in sorted(sets):
            heads.setdefault(sets[i], i)
        want = {(a, b) for (x, a), (y, b) in itertools.combinations(sorted(heads.items(), key=lambda h: h[1]), 2) if len(x & y) >= least and len(x & y) >= threshold * len(x | y) - 1e-12}
        assert got == want


def test_watched_folder_and_static_feed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("x")
    own = journal.Journal(spark, str(tmp_path / "journal"))
    stream = changes.watched_files(spark, str(tmp_path / "in")).writeStream.foreachBatch(changes.queue_batches(own)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    stream.awaitTermination()
    assert [(k, p) for _, k, p, _, _ in states(own)] == [("modified", "a.md")]
    feed = changes.static_feed(spark, [("modified", "a.md", None, datetime(2024, 1, 1)), ("modified", "a.md", None, datetime(2024, 1, 2))])
    assert [(r.n, r.observed_at.day) for r in changes.coalesce(changes.normalize(feed)).collect()] == [(0, 2)]


def test_command_line_names_everything(capsys):
    assert command.main(["list"]) == 0
    shown = capsys.readouterr().out
    assert "lint_findings" in shown and "catalog" in shown
    with pytest.raises(SystemExit):
        command.main(["query", "no_such", "x"])


def test_repositories(spark, tmp_path):
    source = str(tmp_path / "source")
    repositories.git(["init", "--quiet", source])
    (tmp_path / "source" / "README.md").write_text("x")
    (tmp_path / "source" / ".gitignore").write_text("*.log\n")
    (tmp_path / "source" / "a.log").write_text("x")
    repositories.git(["add", "README.md", ".gitignore"], source)
    assert sorted(r.path for r in repositories.tracked_paths(spark, source, staged=True).collect()) == [".gitignore", "README.md"]
    repositories.git(["-c", "user.name=n", "-c", "user.email=e@x", "commit", "--quiet", "-m", "first\tone"], source)
    assert sorted(r.path for r in repositories.tracked_paths(spark, source).collect()) == [".gitignore", "README.md", "a.log"]
    repositories.clone(f"file://{source}", str(tmp_path / "copy"))
    (row,) = repositories.commits(spark, str(tmp_path / "copy"), 5).collect()
    assert row.hash == repositories.head_sha(source) and row.subject == "first\tone"
    assert repositories.head_sha(str(tmp_path / "none"), token="hide") is None

    def fetch(repo):
        if repo == "bad":
            raise OSError("no network")
        return {"stars": 3} if repo == "a" else None

    rows = repositories.metadata(spark.createDataFrame([("a",), ("b",), ("bad",)], "repo string"), fetch, ["stars"])
    assert {r.repo: r.stars for r in rows.collect()} == {"a": "3", "b": None, "bad": None}


def test_mirrors_are_written_once(spark, tmp_path):
    folder = str(tmp_path / "mirrors")
    records = spark.createDataFrame([("a.md", "---\nt: 1\n---\n", "one"), ("b.md", "---\nt: 2\n---\n", " ")], "path string, fm string, text string")
    made = repositories.mirrors(records, "fm", "text", "%% BELOW %%")
    assert repositories.write_mirrors(spark, made, folder, 0) == 2 and repositories.write_mirrors(spark, made, folder, 0) == 2
    again = repositories.mirrors(records.withColumn("text", F.when(F.col("path") == "a.md", "new").otherwise(F.col("text"))), "fm", "text", "%% BELOW %%")
    assert repositories.write_mirrors(spark, again, folder, 1) == 1
    now = {r.path: r.content for r in repositories.current_mirrors(spark, folder).collect()}
    assert now["a.md"] == "---\nt: 1\n---\n%% BELOW %%\n\n## Extracted content\n\nnew\n" and "_(no text)_" in now["b.md"]


def test_view_filters_refuse_what_they_cannot_compare(spark):
    notes = spark.createDataFrame([(1, "a", ["x"], None), (2, None, [], True)], "n int, t string, tags array<string>, f boolean")
    rows = lambda spec: [r.n for r in views.compile_view(notes, {"columns": ["n"], "sort": ["n"], "filters": spec}).collect()]
    assert rows({"not": {"column": "t", "value": "a"}}) == [2] and rows({"column": "t", "is": "!=", "value": "a"}) == [2]
    assert rows({"column": "t", "value": None}) == [2] and rows({"or": []}) == [] and rows({"and": []}) == [1, 2]
    assert rows({"column": "tags", "is": "empty"}) == [2] and rows({"column": "n", "is": "<", "value": 1.5}) == [1]
    for bad in ({"column": "no", "value": 1}, {"column": "n", "value": "1"}, {"column": "f", "value": 1}, {"column": "t", "is": "like", "value": "a"}, {"column": "tags", "value": "x"}, {"and": [], "or": []}, "t", {"column": "t", "is": "in", "values": ["a", 2]}):
        with pytest.raises(views.ViewError):
            rows({"and": [bad]})
