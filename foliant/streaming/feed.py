"""Streaming sources of changes: the log of a file watcher, scans of a tree, commits of repositories.

Each is a Python data source whose offsets Spark keeps in the checkpoint, so a restart goes on where the last
batch ended and a repeated batch reads the same.  The driver sees names, sizes and heads; lines, listings and
commits are read by the tasks, a range, a folder or a repository each.
"""

from __future__ import annotations

import json
import posixpath
import re
import subprocess
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

EVENTS = "n long, event_type string, is_directory boolean, src_path string, dest_path string, observed_at timestamp"
CHANGES = "event_kind string, current_path string, previous_path string, observed_at timestamp, n long"
COMMITS = "repo string, sha string, author string, committed_at timestamp, subject string"
SPLIT_BYTES, TAIL_BYTES, ROWS = 8 << 20, 1 << 16, 10_000


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it."""
    named = re.sub(r"^file:/+", "/", path)
    return pafs.FileSystem.from_uri(named) if "://" in named else (pafs.LocalFileSystem(), named)


class Range(InputPartition):
    """Bytes of one segment."""

    def __init__(self, segment: str, start: int, end: int) -> None:
        self.segment, self.start, self.end = segment, start, end


class WatchLog(DataSource):
    """Lines of JSON that a watcher appends to segments (`path`), whose names sort as they were begun.

    A segment may grow while it is the last.  An offset is the last segment and the bytes of it up to its last whole line.
    """

    @classmethod
    def name(cls) -> str:
        return "watch_log"

    def schema(self) -> str:
        return EVENTS

    def streamReader(self, schema) -> DataSourceStreamReader:
        return WatchLogReader(self.options["path"], int(self.options.get("splitbytes", SPLIT_BYTES)))


class WatchLogReader(DataSourceStreamReader):
    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path.rstrip("/"), split

    def _segments(self) -> list[tuple[str, int]]:
        files, root = store(self.path)
        found = files.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        return sorted((x.base_name, x.size) for x in found if x.type == pafs.FileType.File and x.base_name[0] not in "._")

    def _whole_lines(self, segment: str, size: int) -> int:
        """Bytes up to the last line end, looked for from the end."""
        files, root = store(self.path)
        with files.open_input_file(f"{root}/{segment}") as file:
            end = size
            while end > 0:
                start = max(0, end - TAIL_BYTES)
                at = file.read_at(end - start, start).rfind(b"\n")
                if at >= 0:
                    return start + at + 1
                end = start
        return 0

    def initialOffset(self) -> dict:
        return {"segment": "", "byte": 0}

    def latestOffset(self) -> dict:
        segments = self._segments()
        if not segments:
            return self.initialOffset()
        name, size = segments[-1]
        return {"segment": name, "byte": self._whole_lines(name, size)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        parts = []
        for name, size in self._segments():
            if start["segment"] <= name <= end["segment"]:
                first = start["byte"] if name == start["segment"] else 0
                last = end["byte"] if name == end["segment"] else size
                parts += [Range(name, at, min(at + self.split, last)) for at in range(first, last, self.split)]
        return parts

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        """Rows of the lines that begin in a range; the byte before it tells whether its first line does."""
        files, root = store(self.path)
        first = max(0, partition.start - 1)
        rows = []
        with files.open_input_file(f"{root}/{partition.segment}") as file:
            block, size = file.read_at(partition.end - first, first), file.size()
            while not block.endswith(b"\n") and first + len(block) < size:  # the last line ends beyond the range
                more = file.read_at(TAIL_BYTES, first + len(block))
                at = more.find(b"\n")
                block += more if at < 0 else more[: at + 1]
        start = block.find(b"\n") + 1 if partition.start else 0
        for line in block[start:].splitlines() if start or not partition.start else []:
            if line.strip():
                rows.append(json.loads(line))
            if len(rows) == ROWS:
                yield _events(rows)
                rows = []
        if rows:
            yield _events(rows)

    def commit(self, end: dict) -> None:
        """Nothing to do: segments are the watcher's."""


def _events(rows: list[dict]) -> pa.RecordBatch:
    at = [datetime.fromisoformat(r["observed_at"]) if r.get("observed_at") else None for r in rows]
    at = [t.replace(tzinfo=timezone.utc) if t and t.tzinfo is None else t for t in at]
    columns = {
        "n": pa.array([r.get("n") for r in rows], pa.int64()), "event_type": pa.array([r.get("event_type") for r in rows], pa.string()), "is_directory": pa.array([bool(r.get("is_directory")) for r in rows]),
        "src_path": pa.array([r.get("src_path") for r in rows], pa.string()), "dest_path": pa.array([r.get("dest_path") for r in rows], pa.string()), "observed_at": pa.array(at, pa.timestamp("us", "UTC")),
    }
    return pa.RecordBatch.from_pydict(columns)


class Folder(InputPartition):
    """One folder at the top of a tree, between two scans; an empty name stands for the files at the top."""

    def __init__(self, name: str, before: int, after: int) -> None:
        self.name, self.before, self.after = name, before, after


class TreeScan(DataSource):
    """What changed below a folder (`path`) since the scan before, as changes; listings are kept in another (`state`).

    Every trigger is a scan.  Each task lists one folder of the top level and compares it with the listing kept of it;
    a listing that is there already is the scan's, so a repeated batch gives the same.  A file that went while one of
    its size and time came, each alone in that, has moved; moves between folders of the top level are a deletion and a
    creation.
    """

    @classmethod
    def name(cls) -> str:
        return "tree_scan"

    def schema(self) -> str:
        return CHANGES

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TreeScanReader(self.options["path"], self.options["state"])


class TreeScanReader(DataSourceStreamReader):
    def __init__(self, path: str, state: str) -> None:
        self.path, self.state = path.rstrip("/"), state.rstrip("/")

    def _scans(self) -> list[int]:
        files, root = store(self.state)
        found = files.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        return sorted(int(x.base_name) for x in found if x.base_name.isdigit())

    def initialOffset(self) -> dict:
        return {"scan": 0}

    def latestOffset(self) -> dict:
        return {"scan": max([0, *self._scans()]) + 1}

    def partitions(self, start: dict, end: dict) -> list[Folder]:
        files, root = store(self.path)
        names = {x.base_name for x in files.get_file_info(pafs.FileSelector(root)) if x.type == pafs.FileType.Directory}
        kept, folder = store(f"{self.state}/{start['scan']}")
        names |= {unquote(x.base_name)[1:] for x in kept.get_file_info(pafs.FileSelector(folder, allow_not_found=True)) if x.base_name.startswith("=")}
        return [Folder(name, start["scan"], end["scan"]) for name in sorted({"", *names})]

    def _listing(self, scan: int, name: str) -> dict[str, list[int]] | None:
        files, root = store(self.state)
        path = f"{root}/{scan}/{quote('=' + name, safe='=')}"
        if files.get_file_info(path).type != pafs.FileType.File:
            return None
        with files.open_input_stream(path) as file:
            return json.loads(file.read())

    def _list(self, scan: int, name: str) -> dict[str, list[int]]:
        """The folder's listing of a scan, made and kept if this is the first look."""
        held = self._listing(scan, name)
        if held is not None:
            return held
        files, root = store(self.path)
        found = files.get_file_info(pafs.FileSelector(posixpath.join(root, name), recursive=bool(name), allow_not_found=True))
        listing = {posixpath.relpath(x.path, root): [x.size, x.mtime_ns or 0] for x in found if x.type == pafs.FileType.File}
        kept, folder = store(f"{self.state}/{scan}")
        kept.create_dir(folder, recursive=True)
        path = f"{folder}/{quote('=' + name, safe='=')}"
        with kept.open_output_stream(f"{path}.tmp") as out:
            out.write(json.dumps(listing).encode())
        kept.move(f"{path}.tmp", path)
        return listing

    def read(self, partition: Folder) -> Iterator[tuple]:
        before, after = self._listing(partition.before, partition.name) or {}, self._list(partition.after, partition.name)
        gone, new = sorted(before.keys() - after.keys()), sorted(after.keys() - before.keys())
        traits = lambda names, of: {t: [p for p in names if tuple(of[p]) == t] for t in {tuple(of[p]) for p in names}}
        left, came = traits(gone, before), traits(new, after)
        moved = {came[t][0]: left[t][0] for t in came if len(came[t]) == 1 and len(left.get(t, [])) == 1}
        now = lambda path: datetime.fromtimestamp(after[path][1] / 1e9, timezone.utc)
        order = lambda at: partition.after << 32 | at
        rows = [("moved", p, moved[p]) if p in moved else ("created", p, None) for p in new]
        rows += [("modified", p, None) for p in sorted(before.keys() & after.keys()) if before[p] != after[p]]
        rows += [("deleted", None, p) for p in gone if p not in moved.values()]
        for at, (kind, current, previous) in enumerate(rows):
            yield kind, current, previous, now(current) if current else None, order(at)

    def commit(self, end: dict) -> None:
        """Listings before the last but one are of no more use."""
        files, root = store(self.state)
        for scan in self._scans():
            if scan < end["scan"] - 1:
                files.delete_dir(f"{root}/{scan}")


class Repository(InputPartition):
    """Commits of one repository after a head up to another."""

    def __init__(self, repo: str, path: str, before: str, after: str) -> None:
        self.repo, self.path, self.before, self.after = repo, path, before, after


class CommitLog(DataSource):
    """New commits of repositories (`repos`: a JSON object of paths by name) as a stream; a task reads a repository.

    An offset holds each repository's head.  History that was rewritten is told from the common ancestor on.
    """

    @classmethod
    def name(cls) -> str:
        return "commit_log"

    def schema(self) -> str:
        return COMMITS

    def streamReader(self, schema) -> DataSourceStreamReader:
        return CommitLogReader(json.loads(self.options["repos"]))


class CommitLogReader(DataSourceStreamReader):
    def __init__(self, repos: dict[str, str]) -> None:
        self.repos = repos

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        heads = {}
        for repo, path in self.repos.items():
            found = subprocess.run(["git", "-C", path, "rev-parse", "--verify", "-q", "HEAD"], capture_output=True, text=True, timeout=60)
            heads[repo] = found.stdout.strip()  # empty without a commit
        return heads

    def partitions(self, start: dict, end: dict) -> list[Repository]:
        return [Repository(repo, self.repos[repo], start.get(repo, ""), head) for repo, head in end.items() if head and head != start.get(repo, "") and repo in self.repos]

    def read(self, partition: Repository) -> Iterator[tuple]:
        span = f"{partition.before}..{partition.after}" if partition.before else partition.after
        command = ["git", "-C", partition.path, "log", "--reverse", "--format=%H%x1f%an%x1f%ct%x1f%s", span]
        with subprocess.Popen(command, stdout=subprocess.PIPE, text=True, errors="replace") as running:
            for line in running.stdout:
                sha, author, at, subject = line.rstrip("\n").split("\x1f", 3)
                yield partition.repo, sha, author, datetime.fromtimestamp(int(at), timezone.utc), subject
        if running.returncode:
            raise RuntimeError(f"the log of {partition.repo} cannot be read")

    def commit(self, end: dict) -> None:
        """Nothing to do: repositories keep their history."""


def register(spark: SparkSession) -> None:
    for source in (WatchLog, TreeScan, CommitLog):
        spark.dataSource.register(source)


def watch_log(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The stream of a watcher's events."""
    register(spark)
    return spark.readStream.format("watch_log").options(path=path, **options).load()


def tree_scan(spark: SparkSession, path: str, state: str) -> DataFrame:
    """The stream of changes below a folder."""
    register(spark)
    return spark.readStream.format("tree_scan").options(path=path, state=state).load()


def commit_log(spark: SparkSession, repos: dict[str, str]) -> DataFrame:
    """The stream of repositories' new commits."""
    register(spark)
    return spark.readStream.format("commit_log").option("repos", json.dumps(repos)).load()


def as_segments(events: DataFrame, folder: str) -> None:
    """Write events in order of `n` as segments of a watcher's log, which sort as they follow each other."""
    ordered = events.repartitionByRange("n").sortWithinPartitions("n")
    ordered.select(F.to_json(F.struct(*events.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).alias("value")).write.mode("append").text(folder)


def append_segments(spark: SparkSession, written: str, folder: str, prefix: str) -> None:
    """Move written segments into a log, named by a prefix that sorts after those before; only names change."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path(folder))
    for found in sorted(s.getPath().getName() for s in files.listStatus(path(written)) if s.getPath().getName().startswith("part-")):
        files.rename(path(f"{written}/{found}"), path(f"{folder}/{prefix}-{found.split('-')[1]}.jsonl"))
