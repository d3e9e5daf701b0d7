"""Streaming sources: a watcher's log, scans of a tree, commits; each over a restart."""

import json
import os
import subprocess

from foliant.streaming import changes, feed, journal


def drained(stream, tmp_path, name):
    place = str(tmp_path / name)
    stream.writeStream.format("parquet").option("path", f"{place}/rows").option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{place}/rows")


def line(n, kind, src, dest=None):
    return json.dumps({"n": n, "event_type": kind, "is_directory": False, "src_path": src, "dest_path": dest, "observed_at": "2024-01-01T00:00:00"}) + "\n"


def test_watch_log_resumes_inside_a_growing_segment(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    first = "".join(line(n, "modified", f"{'x' * (n % 7)}{n}.md") for n in range(300))
    (log / "a.jsonl").write_text(first + '{"n": 999, "eve')
    read = lambda: sorted(r.n for r in drained(feed.watch_log(spark, str(log), splitbytes="1000"), tmp_path, "out").collect())
    assert read() == list(range(300))  # the unfinished line waits
    with open(log / "a.jsonl", "a") as file:
        file.write('nt_type": "deleted", "src_path": "gone.md"}\n' + line(1000, "moved", "a.md", "b.md"))
    (log / "b.jsonl").write_text(line(1001, "created", "c.md"))
    assert read() == [*range(300), 999, 1000, 1001]
    assert read() == [*range(300), 999, 1000, 1001]  # nothing new, nothing twice
    rows = changes.native_changes(spark.read.parquet(str(tmp_path / "out" / "rows"))).where("n >= 999").orderBy("n").collect()
    assert [(r.event_kind, r.current_path, r.previous_path) for r in rows] == [("deleted", None, "gone.md"), ("moved", "b.md", "a.md"), ("created", "c.md", None)]


def test_tree_scan_sees_moves_and_deletes(spark, tmp_path):
    root = tmp_path / "tree"
    for name in ("top.md", "a/one.md", "a/two.md", "b/c/three.md"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(name * len(name))
    own = journal.Journal(spark, str(tmp_path / "journal"))

    def scan():
        stream = feed.tree_scan(spark, str(root), str(tmp_path / "state"))
        stream.writeStream.foreachBatch(changes.queue_batches(own)).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.event_kind, r.current_path or "", r.previous_path or "") for r in own.read().collect())

    want = [("created", "a/one.md", ""), ("created", "a/two.md", ""), ("created", "b/c/three.md", ""), ("created", "top.md", "")]
    assert scan() == want
    os.rename(root / "a/one.md", root / "a/uno.md")
    (root / "b/c/three.md").unlink()
    (root / "top.md").write_text("other")
    want += [("moved", "a/uno.md", "a/one.md"), ("deleted", "", "b/c/three.md"), ("modified", "top.md", "")]
    assert scan() == sorted(want)
    assert scan() == sorted(want)
    assert len(os.listdir(tmp_path / "state")) <= 3


def test_commit_log_resumes_at_each_head(spark, tmp_path):
    def git(repo, *args):
        subprocess.run(["git", "-C", str(repo), "-c", "user.name=a", "-c", "user.email=a@b", *args], check=True, capture_output=True)

    def commit(repo, subject):
        git(repo, "commit", "--allow-empty", "-m", subject)

    repos = {name: str(tmp_path / name) for name in ("one", "two")}
    for path in repos.values():
        subprocess.run(["git", "init", "-q", path], check=True)
    commit(repos["one"], "first")
    commit(repos["one"], "second")
    read = lambda: sorted((r.repo, r.subject) for r in drained(feed.commit_log(spark, repos), tmp_path, "out").collect())
    assert read() == [("one", "first"), ("one", "second")]
    commit(repos["two"], "begun")
    commit(repos["one"], "third")
    assert read() == [("one", "first"), ("one", "second"), ("one", "third"), ("two", "begun")]
