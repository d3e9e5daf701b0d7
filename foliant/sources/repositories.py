"""Repositories as sources: heads, shallow copies, commit logs and tracked files by the `git` command, metadata by a given fetch function."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.sources.corpus import commit_log

SECONDS = 120


class RepositoryError(RuntimeError):
    """A `git` command that failed; its output has no token."""


def git(arguments: list[str], folder: str | None = None, token: str = "") -> str:
    """The output of a `git` command.  A token goes by the environment, never by an argument, and out of error texts."""
    own = os.environ | {"GIT_TERMINAL_PROMPT": "0"}
    if token:
        own |= {"GIT_CONFIG_COUNT": "1", "GIT_CONFIG_KEY_0": "http.extraHeader", "GIT_CONFIG_VALUE_0": f"Authorization: Bearer {token}"}
    done = subprocess.run(["git", *arguments], cwd=folder, env=own, capture_output=True, text=True, timeout=SECONDS)
    if done.returncode:
        text = (done.stderr or done.stdout).strip()
        raise RepositoryError((text.replace(token, "***") if token else text)[:400])
    return done.stdout


def head_sha(url: str, token: str = "") -> str | None:
    """The commit that a remote's HEAD names; None if it cannot be reached."""
    try:
        found = git(["ls-remote", url, "HEAD"], token=token).split()
    except (RepositoryError, subprocess.TimeoutExpired):
        return None
    return found[0] if found else None


def clone(url: str, folder: str, depth: int = 1, token: str = "") -> None:
    """A copy of the last commits."""
    git(["clone", "--quiet", "--depth", str(depth), url, folder], token=token)


def commits(spark: SparkSession, folder: str, most: int) -> DataFrame:
    """The last commits of a copy: hash, at, subject."""
    lines = git(["log", f"-{most}", "--format=%H%x09%cI%x09%s"], folder).splitlines()
    return commit_log(spark.createDataFrame([(line,) for line in lines], "value string"))


def tracked_paths(spark: SparkSession, folder: str, staged: bool = False, paths: list[str] | None = None) -> DataFrame:
    """Paths to scan: those given, those staged, or all that are tracked and those that are there but ignored; each once."""
    if paths:
        found = paths
    elif staged:
        found = git(["diff", "--cached", "--name-only", "-z", "--diff-filter=ACMR"], folder).split("\0")
    else:
        found = git(["ls-files", "-z"], folder).split("\0") + git(["ls-files", "-z", "--others", "--ignored", "--exclude-standard"], folder).split("\0")
    return spark.createDataFrame([(p,) for p in dict.fromkeys(found) if p], "path string")


def metadata(repositories: DataFrame, fetch: Callable[[str], dict | None], fields: list[str]) -> DataFrame:
    """Repositories (repo) with fields of what `fetch` knows of them, as text; nulls where it fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for repo in batch["repo"]:
                try:
                    known = fetch(repo) or {}
                except Exception:  # any failure means that nothing is known
                    known = {}
                rows.append([repo, *(None if known.get(f) is None else str(known[f]) for f in fields)])
            yield pd.DataFrame(rows, columns=["repo", *fields])

    return repositories.select("repo").mapInPandas(run, ", ".join(["repo string", *(f"{f} string" for f in fields)]))


def mirrors(records: DataFrame, frontmatter: str, extracted: str, sentinel: str, cap: int = 400_000) -> DataFrame:
    """Mirrors (path, content, sha) composed of a record's frontmatter and extracted text below the sentinel; `sha` is that of the generated region."""
    from foliant.functions.text import capped

    region = F.concat(F.lit(f"{sentinel}\n\n## Extracted content\n\n"), capped(F.col(extracted), cap, "\n\n> cut"), F.lit("\n"))
    return records.select("path", F.concat(F.col(frontmatter), region).alias("content"), F.sha2(region, 256).alias("sha"))


def write_mirrors(spark: SparkSession, made: DataFrame, folder: str, run: int) -> int:
    """Append the mirrors that differ from the current ones as one run of a table, which replaces what a repeated run wrote; the number written."""
    changed = made.join(current_mirrors(spark, folder, run).select("path", F.col("content").alias("_now")), "path", "left").where("_now is null or _now <> content").drop("_now")
    changed.write.mode("overwrite").parquet(f"{folder}/run={run}")
    return spark.read.parquet(f"{folder}/run={run}").count()


def current_mirrors(spark: SparkSession, folder: str, below: int | None = None) -> DataFrame:
    """The last content of each mirror, of runs below a number if given."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
    runs = [n for n in found if n.startswith("run=") and (below is None or int(n[4:]) < below)]
    if not runs:
        return spark.createDataFrame([], "path string, content string, sha string")
    rows = spark.read.option("basePath", folder).parquet(*[f"{folder}/{n}" for n in runs])
    return rows.groupBy("path").agg(F.max_by(F.struct("content", "sha"), "run").alias("m")).select("path", "m.*")
