"""Mirrors of sources: what a sync would write, three-way merges that keep what people wrote, and commits that check their grounds.

A mirror is a region of people and, from the sentinel line on, a generated one.  A sync plans from the source's hash and the
mirror as it stood; when it commits it looks again.  A source that changed meanwhile, a generated region that somebody edited
and a region of people that both sides changed are reported and nothing of them is written.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import before_sentinel
from foliant.registry import query, table
from foliant.sources.sinks import append_audit
from foliant.streaming.feed import store as file_store
from foliant.workspace import SENTINEL

#: Outcomes that write a mirror.
WRITES = ["created", "updated"]
MIRROR = "path string, content string, human string, generated_sha string, source_sha string"


def merged(base: Column, theirs: Column, ours: Column) -> Column:
    """The region of people after a sync: whoever changed it since `base` wins; null where both did, differently."""
    return F.when(theirs.eqNullSafe(ours) | ours.eqNullSafe(base), theirs).when(theirs.eqNullSafe(base), ours)


def generated_part(content: Column, sentinel: str = SENTINEL) -> Column:
    """What stands from the sentinel on; null without one."""
    human = before_sentinel(content, sentinel)
    return F.when(F.length(human) < F.length(content), F.substring(content, F.length(human) + 1, F.length(content)))


def sync_plan(made: DataFrame, held: DataFrame, now: DataFrame, sources: DataFrame, sentinel: str = SENTINEL) -> DataFrame:
    """What to do with every mirror made anew: path, outcome, content, human, generated_sha, source_sha, base_sha.

    `made` has path, source_path, source_sha (when it was made), human (what the sync would put there), generated;
    `held` what was written last (path, human, generated_sha, source_sha); `now` the mirrors as they are (path, content);
    `sources` the sources as they are (source_path, sha).
    """
    before = held.select("path", F.col("human").alias("_base"), F.col("generated_sha").alias("_generated"), F.col("source_sha").alias("_source"))
    joined = made.join(before, "path", "left").join(now.select("path", F.col("content").alias("_now")), "path", "left").join(sources.select("source_path", F.col("sha").alias("_sha")), "source_path", "left")
    theirs, part = before_sentinel(F.col("_now"), sentinel), generated_part(F.col("_now"), sentinel)
    human = F.when(F.col("_now").isNull(), F.col("human")).otherwise(merged(F.col("_base"), theirs, F.col("human")))
    content = F.concat(human, "generated")
    outcome = (
        F.when(F.col("_sha").isNull(), "source-missing")
        .when(F.col("_sha") != F.col("source_sha"), "source-changed")
        .when(F.col("_now").isNull(), "created")
        .when(F.col("_base").isNull(), "conflict:unmanaged")
        .when(part.isNull(), "conflict:no-sentinel")
        .when(F.sha2(part, 256) != F.col("_generated"), "conflict:generated-edited")
        .when(human.isNull(), "conflict:both-changed")
        .when(content == F.col("_now"), "unchanged")
        .otherwise("updated")
    )
    judged = joined.withColumns({"outcome": outcome, "_human": human, "_content": content})
    writes = F.col("outcome").isin(WRITES)
    return judged.select("path", "source_path", "outcome", *[F.when(writes, c).alias(n) for n, c in (("content", F.col("_content")), ("human", F.col("_human")), ("generated_sha", F.sha2("generated", 256)), ("source_sha", F.col("source_sha")))], F.sha2("_now", 256).alias("base_sha"))


class Conflict(RuntimeError):
    """A commit whose grounds have gone."""


class MirrorStore:
    """Versions of all mirrors in one folder: a run is a table of what it wrote, and exists once its version is published.

    A version names the one it was planned on, and only one run can follow a version; a run that failed halfway leaves a
    table that no version names.  Every `full_every` versions the whole state is written, so reading joins a bounded
    number of runs.
    """

    def __init__(self, spark: SparkSession, folder: str, full_every: int = 16) -> None:
        self.spark, self.folder, self.full_every = spark, folder.rstrip("/"), full_every

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        fs, path = self._fs("versions")
        found = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n) for n in found if n.isdigit())

    def version(self) -> int:
        """The last published version; 0 before the first."""
        return (self.versions() or [0])[-1]

    def _told(self, version: int) -> dict:
        fs, path = self._fs(f"versions/{version}")
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        """Every mirror as a version has it: the last row of each path."""
        at = self.version() if version is None else version
        runs = []
        while at:
            told = self._told(at)
            runs.append((at, told["run"]))
            if told["full"]:
                break
            at -= 1
        if not runs:
            return self.spark.createDataFrame([], MIRROR)
        parts = [self.spark.read.schema(MIRROR).parquet(f"{self.folder}/{run}").withColumn("_v", F.lit(v)) for v, run in runs]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        names = ["content", "human", "generated_sha", "source_sha"]
        return rows.groupBy("path").agg(F.max_by(F.struct(*names), "_v").alias("m")).select("path", *(f"m.{n}" for n in names))

    def commit(self, plan: DataFrame, planned_on: int) -> int:
        """Publish what a plan writes as the version after the one it was planned on; refused if another came first."""
        if self.version() != planned_on:
            raise Conflict(f"planned on version {planned_on}, now there is {self.version()}")
        writes = plan.where(F.col("outcome").isin(WRITES)).select("path", "content", "human", "generated_sha", "source_sha")
        full = (planned_on + 1) % self.full_every == 0
        if full:
            writes = writes.unionByName(self.read(planned_on).join(writes.select("path"), "path", "left_anti"))
        run = f"runs/{planned_on + 1}-{uuid.uuid4().hex[:12]}"
        writes.write.mode("overwrite").parquet(f"{self.folder}/{run}")
        fs, path = self._fs(f"versions/{planned_on + 1}")
        try:
            out = fs.create(path, False)
        except Exception as e:
            raise Conflict(f"version {planned_on + 1} was published at the same time") from e
        out.write(bytearray(json.dumps({"run": run, "full": full}).encode()))
        out.close()
        return planned_on + 1


def publish_files(plan: DataFrame, root: str) -> DataFrame:
    """Write planned mirrors as files below a root, each by a task and by renaming: path, written.

    A file that is no longer what the plan saw stays and is told; one that has the content already (a task ran twice) is
    done.  Readers see the old or the new text, never a part.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, top = file_store(root)
        for batch in batches:
            found = []
            for path, content, base in zip(batch["path"], batch["content"], batch["base_sha"]):
                place, body = posixpath.join(top, path), content.encode()
                there = files.get_file_info(place).type == pafs.FileType.File
                now = hashlib.sha256(files.open_input_stream(place).read()).hexdigest() if there else None
                new = hashlib.sha256(body).hexdigest()
                if now == new:
                    found.append((path, "done"))
                elif now != base:
                    found.append((path, "target-changed"))
                else:
                    files.create_dir(posixpath.dirname(place), recursive=True)
                    temporary = posixpath.join(posixpath.dirname(place), f".{posixpath.basename(place)}.{new[:12]}.tmp")
                    with files.open_output_stream(temporary) as out:
                        out.write(body)
                    files.move(temporary, place)
                    found.append((path, "done"))
            yield pd.DataFrame(found, columns=["path", "written"])

    rows = plan.where(F.col("outcome").isin(WRITES)).select("path", "content", "base_sha")
    return rows.mapInPandas(run, "path string, written string")


Look = Callable[[list[str]], DataFrame]


class Materialiser:
    """Processes claimed events: settle, plan, convert, look again, commit, record, audit.  `counts` tells the work of all calls.

    `look` reads the files at given paths and no others (path, size, modified, content); `convert` turns (path, content) rows
    into (path, text); `records` are the manifest's (source_id, path, sha, state).  At most a claim's paths are handled at
    once, whatever the workspace holds.
    """

    def __init__(self, store: MirrorStore, records: DataFrame, look: Look, convert: Callable[[DataFrame], DataFrame], audit: str | None = None, sentinel: str = SENTINEL) -> None:
        self.store, self.records, self.look, self.convert, self.audit, self.sentinel = store, records, look, convert, audit, sentinel
        self.counts = {"hashed": 0, "bytes_hashed": 0, "converted": 0, "discovered": 0}

    def _hashed(self, paths: list[str]) -> list:
        """Hashes of the bodies at paths, each counted."""
        if not paths:
            return []
        seen = Observation()
        rows = self.look(paths).observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("bytes"))
        found = rows.select("path", "size", "modified", F.sha2("content", 256).alias("sha")).collect()  # as many as were claimed
        self.counts["hashed"] += seen.get["n"]
        self.counts["bytes_hashed"] += seen.get["bytes"]
        return found

    def __call__(self, events: DataFrame) -> DataFrame:
        spark = events.sparkSession
        claimed = events.select("sequence", "event_kind", "current_path", "previous_path").collect()  # one claim
        wanted = sorted({e["current_path"] for e in claimed if e["event_kind"] in ("created", "modified", "moved") and e["current_path"]})
        first = {r["path"]: r for r in self._hashed(wanted)}
        paths = {p for e in claimed for p in (e["current_path"], e["previous_path"]) if p}
        keys = spark.createDataFrame([(p,) for p in sorted(paths)], "path string")
        known = {r["path"]: r for r in self.records.join(F.broadcast(keys), "path", "left_semi").collect()}
        results, syncs = {}, []
        for e in claimed:
            path, there, record = e["current_path"], first.get(e["current_path"]), known.get(e["current_path"])
            if e["event_kind"] == "deleted":
                results[e["sequence"]] = "source-missing" if e["previous_path"] in known else "skipped:no-record"
            elif e["event_kind"] == "reconcile-required":
                results[e["sequence"]] = "skipped:conflict"
            elif there is None:
                results[e["sequence"]] = "error: source missing"
            elif e["event_kind"] == "moved" and e["previous_path"] in known:
                results[e["sequence"]] = "skipped:old-mirror"  # the mirror of the old path is somebody's to settle
            elif record is not None and record["sha"] == there["sha"]:
                results[e["sequence"]] = "unchanged"
            else:
                syncs.append((e["sequence"], path, there["sha"]))
        for sequence, outcome in self._synced(spark, syncs):
            results[sequence] = outcome
        out = spark.createDataFrame(sorted(results.items()), "sequence long, result string")
        if self.audit:
            append_audit(events.select("sequence", "event_kind", "current_path", "previous_path").join(out, "sequence"), self.audit)
        return out

    def _synced(self, spark: SparkSession, syncs: list[tuple]) -> list[tuple]:
        """Mirrors of changed sources written in one version."""
        if not syncs:
            return []
        paths = sorted({path for _, path, _ in syncs})
        seen = Observation()
        texts = self.convert(self.look(paths).select("path", "content")).observe(seen, F.count(F.lit(1)).alias("n"))
        rows = {r["path"]: r["text"] for r in texts.collect()}  # a claim's texts
        self.counts["converted"] += seen.get["n"]
        again = {r["path"]: r["sha"] for r in self._hashed(paths)}
        sources = spark.createDataFrame(sorted(again.items()), "source_path string, sha string")
        shas = {path: sha for _, path, sha in syncs}
        made = spark.createDataFrame([(mirror_path(p), p, shas[p], "## Notes\n", f"{self.sentinel}\n\n{rows.get(p, '')}\n") for p in paths], "path string, source_path string, source_sha string, human string, generated string")
        version = self.store.version()
        held = self.store.read(version)
        plan = sync_plan(made, held, held.select("path", "content"), sources, self.sentinel)
        self.store.commit(plan, version)
        outcomes = {r["source_path"]: r["outcome"] for r in plan.select("source_path", "outcome").collect()}
        told = {"created": "created", "updated": "updated", "unchanged": "unchanged", "source-changed": "unstable", "source-missing": "error: source missing"}
        return [(sequence, told.get(outcomes[path], "skipped:conflict")) for sequence, path, _ in syncs]


def mirror_path(path: str) -> str:
    return f"_mirrors/{posixpath.splitext(path)[0]}.md"


BASE = "'## Notes' || chr(10)"
PLANNED = {
    "path": "'_mirrors/' || doc_id || '.md'",
    "source_path": "'s/' || doc_id",
    "source_sha": "md5(coalesce(text, ''))",
    "human": f"CASE WHEN doc_id % 7 = 0 THEN {BASE} || 'moved to a sidecar' || chr(10) ELSE {BASE} END",
    "generated": f"'{SENTINEL}' || chr(10) || CASE WHEN doc_id % 3 = 0 THEN 'old' ELSE coalesce(text, '') END",
    "base": f"CASE WHEN doc_id % 13 <> 1 THEN {BASE} END",
    "written": f"'{SENTINEL}' || chr(10) || 'old'",
    "now": f"CASE WHEN doc_id % 17 = 0 THEN NULL WHEN doc_id % 19 = 0 THEN 'free text' ELSE {BASE} || CASE doc_id % 5 WHEN 0 THEN 'mine' || chr(10) WHEN 1 THEN 'moved to a sidecar' || chr(10) ELSE '' END || '{SENTINEL}' || chr(10) || CASE WHEN doc_id % 23 = 0 THEN 'edited' ELSE 'old' END END",
    "source_now": "CASE WHEN doc_id % 29 = 0 THEN NULL WHEN doc_id % 31 = 0 THEN 'other' ELSE md5(coalesce(text, '')) END",
}
PLAN_SQL = "p AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in PLANNED.items()) + f""" FROM documents),
cut AS (SELECT *, CASE WHEN contains(now, '{SENTINEL}') THEN string_split(now, '{SENTINEL}')[1] ELSE now END AS theirs, CASE WHEN contains(now, '{SENTINEL}') THEN substr(now, strpos(now, '{SENTINEL}')) END AS part FROM p),
m AS (SELECT *, CASE WHEN now IS NULL THEN human WHEN theirs = human OR human IS NOT DISTINCT FROM base THEN theirs WHEN theirs IS NOT DISTINCT FROM base THEN human END AS new_human FROM cut),
o AS (SELECT *, CASE WHEN source_now IS NULL THEN 'source-missing' WHEN source_now <> source_sha THEN 'source-changed' WHEN now IS NULL THEN 'created' WHEN base IS NULL THEN 'conflict:unmanaged' WHEN part IS NULL THEN 'conflict:no-sentinel'
 WHEN part <> written THEN 'conflict:generated-edited' WHEN new_human IS NULL THEN 'conflict:both-changed' WHEN new_human || generated = now THEN 'unchanged' ELSE 'updated' END AS outcome FROM m)"""


@query(f"WITH {PLAN_SQL} SELECT path, outcome, CASE WHEN outcome IN ('created', 'updated') THEN sha256(new_human || generated) END AS content_sha FROM o")
def mirror_sync_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a sync of every mirror would do, conflicts told apart, and a digest of what it would write."""
    rows = table(spark, sf_dir, "documents").selectExpr(*[f"{e} AS {c}" for c, e in PLANNED.items()])
    held = rows.where("base is not null").select("path", F.col("base").alias("human"), F.sha2("written", 256).alias("generated_sha"), "source_sha")
    plan = sync_plan(rows.select("path", "source_path", "source_sha", "human", "generated"), held, rows.where("now is not null").select("path", F.col("now").alias("content")), rows.where("source_now is not null").select("source_path", F.col("source_now").alias("sha")))
    return plan.select("path", "outcome", F.sha2("content", 256).alias("content_sha"))
