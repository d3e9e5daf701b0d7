"""Mirrors: merges, refused commits, files, and the published counts of a replay."""

import hashlib
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from foliant.operators import mirrors
from foliant.streaming import changes, journal
from foliant.workspace import SENTINEL

MADE = "path string, source_path string, source_sha string, human string, generated string"


def made(spark, text="new", human="## Notes\n"):
    return spark.createDataFrame([("a.md", "a", "h", human, f"{SENTINEL}\n{text}"), ("b.md", "b", "h", human, f"{SENTINEL}\n{text}")], MADE)


def sources(spark, **shas):
    return spark.createDataFrame([(k, v) for k, v in shas.items()], "source_path string, sha string")


def test_edits_survive_and_conflicts_are_told(spark, tmp_path):
    store = mirrors.MirrorStore(spark, str(tmp_path / "store"), full_every=3)

    def sync(rows, now, **shas):
        version = store.version()
        plan = mirrors.sync_plan(rows, store.read(version), now if now is not None else store.read(version), sources(spark, **shas))
        found = {r.path: r.outcome for r in plan.collect()}
        store.commit(plan, version)
        return found

    assert sync(made(spark), None, a="h", b="changed") == {"a.md": "created", "b.md": "source-changed"}
    assert sync(made(spark), None, a="h", b="h") == {"a.md": "unchanged", "b.md": "created"}
    edited = store.read().select("path", F.when(F.col("path") == "a.md", F.regexp_replace("content", "## Notes\n", "## Notes\nmine\n")).otherwise(F.concat("content", F.lit("!"))).alias("content"))
    assert sync(made(spark, "newer"), edited, a="h", b="h") == {"a.md": "updated", "b.md": "conflict:generated-edited"}
    kept = {r.path: r.content for r in store.read().collect()}
    assert kept["a.md"] == f"## Notes\nmine\n{SENTINEL}\nnewer" and kept["b.md"] == f"## Notes\n{SENTINEL}\nnew"
    other = store.read().select("path", F.regexp_replace("content", "mine", "mine too").alias("content"))
    assert sync(made(spark, "newest", "## Notes\nours\n"), other, a="h", b="h") == {"a.md": "conflict:both-changed", "b.md": "updated"}
    assert store.version() == 4 and store.read().count() == 2
    plan = mirrors.sync_plan(made(spark, "late"), store.read(3), store.read(3), sources(spark, a="h", b="h"))
    with pytest.raises(mirrors.Conflict):
        store.commit(plan, 3)  # planned before the last version
    spark.createDataFrame([("x",)], "path string").write.parquet(str(tmp_path / "store/runs/5-lost"))  # a run that never was published
    assert store.read().count() == 2


def test_files_are_replaced_whole_or_left(spark, tmp_path):
    root = tmp_path / "root"
    (root / "d").mkdir(parents=True)
    (root / "d/old.md").write_text("old")
    (root / "d/edited.md").write_text("by hand")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    plan = spark.createDataFrame([("d/old.md", "updated", "new", sha("old")), ("d/edited.md", "updated", "new", sha("old")), ("e/fresh.md", "created", "new", None), ("d/x.md", "unchanged", None, None)], "path string, outcome string, content string, base_sha string")
    for _ in range(2):  # a task that runs twice does no harm
        assert {r.path: r.written for r in mirrors.publish_files(plan, str(root)).collect()} == {"d/old.md": "done", "d/edited.md": "target-changed", "e/fresh.md": "done"}
    assert (root / "d/edited.md").read_text() == "by hand" and (root / "e/fresh.md").read_text() == (root / "d/old.md").read_text() == "new"
    assert not [f for _, _, names in os.walk(root) for f in names if f.endswith(".tmp")]


def test_replay_touches_no_more_than_its_events(spark, tmp_path):
    """Twelve notices over a thousand records: three events, three bodies hashed, one conversion, no discovery."""
    root = tmp_path / "in"
    root.mkdir()
    body = lambda k: f"source {k}".encode()
    records = spark.createDataFrame([(f"src_{k}", f"{k}.docx", hashlib.sha256(body(k)).hexdigest(), "clean") for k in range(1000)], "source_id string, path string, sha string, state string")
    (root / "1.docx").write_bytes(body(1) + b"\nchanged once\n")
    (root / "2_moved.docx").write_bytes(body(2))
    looked = []

    def look(paths):
        looked.append(paths)
        rows = [(p, os.path.getsize(root / p), 0, (root / p).read_bytes()) for p in paths if (root / p).exists()]
        return spark.createDataFrame(rows, "path string, size long, modified long, content binary")

    at = datetime(2024, 1, 1)
    notices = [(k, "modified", "1.docx", None, at) for k in range(10)] + [(10, "moved", "2_moved.docx", "2.docx", at), (11, "deleted", None, "3.docx", at)]
    own = journal.Journal(spark, str(tmp_path / "journal"))
    changes.queue_batches(own)(spark.createDataFrame(notices, "n long, event_kind string, current_path string, previous_path string, observed_at timestamp"), 0)
    work = mirrors.Materialiser(mirrors.MirrorStore(spark, str(tmp_path / "store")), records, look, lambda rows: rows.select("path", F.decode("content", "utf-8").alias("text")), str(tmp_path / "audit"))
    assert own.read().count() == 3
    assert journal.replay(own, "w", work)["processed"] == 3
    ended = {r.event_kind: r.status for r in own.read().collect()}
    assert ended == {"modified": "applied", "moved": "review-required", "deleted": "applied"}
    assert work.counts == {"hashed": 3, "bytes_hashed": 2 * len(body(1) + b"\nchanged once\n") + len(body(2)), "converted": 1, "discovered": 0}
    assert {p for paths in looked for p in paths} == {"1.docx", "2_moved.docx"}
    assert spark.read.json(str(tmp_path / "audit")).count() == 3
    assert [r.path for r in work.store.read().collect()] == ["_mirrors/1.md"]
