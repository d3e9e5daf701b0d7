"""Sinks: texts replaced atomically, manifests written only on a change, appended ledgers, scaffolds, sidecars, planned file changes."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.config import safe_output, safe_path
from foliant.functions.text import note_problem, one_line
from foliant.operators.diffs import same_content


class SinkError(ValueError):
    """A write that is refused."""


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _place(spark, path)
    return fs.exists(place)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, names that Spark's readers take for hidden included; None if there is none."""
    fs, place = _place(spark, path)
    if not fs.exists(place):
        return None
    stream = fs.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str, force: bool = True) -> None:
    """Write a small text in any store: to a temporary file next to it, then renamed, so readers see the old or the new one."""
    fs, place = _place(spark, path)
    if not force and fs.exists(place):
        raise SinkError(f"{path} is there already")
    temporary = spark._jvm.org.apache.hadoop.fs.Path(place.getParent(), f".{place.getName()}.{uuid.uuid4().int % 10**9}.tmp")
    out = fs.create(temporary, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if fs.exists(place):
        fs.delete(place, False)
    if not fs.rename(temporary, place):
        fs.delete(temporary, False)
        raise SinkError(f"{path} could not be replaced")


def write_manifest(records: DataFrame, path: str, key: str = "source_id", now: str | None = None) -> bool:
    """Write a manifest's envelope unless its records are there already in any order; tells whether it wrote.

    Records go out as a table next to the envelope's one line of metadata, sorted by their key within
    each part, so a large manifest needs no single task.
    """
    spark = records.sparkSession
    if exists(spark, f"{path}/records/_SUCCESS"):
        old = spark.read.schema(records.schema).json(f"{path}/records")
        if same_content(old, records):
            return False
    staged = f"{path}/records-{uuid.uuid4().hex}"
    records.sortWithinPartitions(key).write.json(staged)
    fs, place = _place(spark, f"{path}/records")
    fs.delete(place, True)
    fs.rename(spark._jvm.org.apache.hadoop.fs.Path(staged), place)
    write_text(spark, f"{path}/envelope.json", json.dumps({"schema_version": 1, "updated": now or datetime.now(timezone.utc).isoformat(timespec="seconds")}, sort_keys=True) + "\n")
    return True


def write_repo_manifest(records: DataFrame, path: str, now: str | None = None) -> bool:
    """The same for repositories."""
    return write_manifest(records, path, "repo_id", now)


def read_written_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(f"{path}/records")


def append_audit(events: DataFrame, path: str) -> None:
    """Append audit events as JSON lines, their fields in the order of names."""
    events.select(*sorted(events.columns)).write.mode("append").json(path)


def append_reviews(reviews: DataFrame, artefacts: DataFrame, path: str) -> DataFrame:
    """Append reviews (artifact_path, status, reviewer, note) with the hash of their artefact (path, sha, size); refused ones (problem) come back and nothing of them is written."""
    joined = reviews.join(artefacts.select(F.col("path").alias("artifact_path"), F.col("sha").alias("artifact_sha256"), F.col("size").alias("artifact_size")), "artifact_path", "left")
    problem = F.when(F.col("artifact_sha256").isNull(), "no such artefact").when(F.trim("reviewer") == "", "no reviewer").otherwise(note_problem(F.col("note")))
    judged = joined.withColumns({"problem": problem, "note": F.coalesce(one_line(F.col("note")), F.lit(""))})
    judged.where("problem is null").drop("problem").write.mode("append").json(path)
    return judged.where("problem is not null").select("artifact_path", "problem")


def write_scaffold(rows: DataFrame, path: str, name: str, force: bool = False) -> None:
    """Write a small pack (task, result or quality rows) as one JSON mapping; an existing one stays unless forced."""
    safe_output(path.rsplit("/", 1)[-1], ".json")
    listed = [r.asDict(True) for r in rows.collect()]  # a pack that people fill in
    write_text(rows.sparkSession, path, json.dumps({"schema_version": 1, name: listed}, indent=1, sort_keys=True) + "\n", force)


def write_sidecars(spark: SparkSession, root: str, actions: DataFrame) -> int:
    """Write annotation sidecars (path, content, blocker), all or none: any blocker refuses the whole plan."""
    blocked = actions.where("blocker is not null").select("path", "blocker").limit(20).collect()
    if blocked:
        raise SinkError("; ".join(f"{r['path']}: {r['blocker']}" for r in blocked))
    done = 0
    for row in actions.select("path", "content").toLocalIterator():  # a migration's files, one at a time
        write_text(spark, f"{root.rstrip('/')}/{row['path']}", row["content"])
        done += 1
    return done


def migration_plan(spark: SparkSession, root: str, templates: dict[str, str], folders: list[str], known: dict[str, str]) -> list[dict[str, str]]:
    """What a profile change does to files: templates (path, text) to copy where none is or an unchanged one (text in `known`), folders to make, and blockers where people changed a file."""
    plan = []
    for folder in folders:
        there = exists(spark, f"{root}/{folder}")
        plan.append({"path": folder, "action": "skip" if there else "create-folder"} if safe_path(folder) else {"path": folder, "action": "blocker", "detail": "unsafe path"})
    for path, text in sorted(templates.items()):
        now = read_text(spark, f"{root}/{path}") if safe_path(path) else None
        action = "blocker" if not safe_path(path) else "copy" if now is None or now == known.get(path) else "skip" if now == text else "blocker"
        plan.append({"path": path, "action": action} | ({"detail": "changed by hand"} if action == "blocker" else {}) | ({"before": now} if now is not None else {}))
    return plan


def apply_migration(spark: SparkSession, root: str, templates: dict[str, str], plan: list[dict[str, str]]) -> int:
    """Do a plan without blockers; a file that changed since the plan is not written over."""
    if any(p["action"] == "blocker" for p in plan):
        raise SinkError("the plan has blockers")
    done = 0
    for p in plan:
        if p["action"] == "create-folder":
            fs, place = _place(spark, f"{root}/{p['path']}")
            fs.mkdirs(place)
        elif p["action"] == "copy":
            if read_text(spark, f"{root}/{p['path']}") != p.get("before"):
                raise SinkError(f"{p['path']} changed since the plan")
            write_text(spark, f"{root}/{p['path']}", templates[p["path"]])
        else:
            continue
        done += 1
    return done

