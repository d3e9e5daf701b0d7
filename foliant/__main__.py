"""The command line: `python -m foliant COMMAND`.

Over a folder of tables: `list` names all queries and reports, `query NAME` shows a query's rows, `explain NAME` its plan,
`report NAME` renders a report as Markdown or HTML.  Over a workspace of files: `inventory`, `digests`, `secrets`, `links`,
`orphans`, `overlap`, `ignored`, `manifest`, `profile`, `views`; `watch` queues what changed in a journal, `reconcile` what a
manifest and the files disagree on; `journal` shows, recovers or compacts one.  Exit code 1 means that there are findings
(of a lint: blocking ones).
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant import catalogue, config
from foliant.functions import paths
from foliant.operators import diffs, graph, integrity, overlap, screening
from foliant.plans import reports, views
from foliant.session import local_session, ship
from foliant.sources import corpus, ranged, sinks
from foliant.streaming import changes, feed
from foliant.streaming.journal import Journal


def _notes(spark: SparkSession, root: str) -> DataFrame:
    """The notes below a folder as the link graph and the overlap take them."""
    own = corpus.notes(spark, root)
    field = lambda name: F.coalesce(F.try_element_at("fm", F.lit(name)), F.lit(""))
    return own.select("path", "type", "title", "status", "body", field("domain").alias("domain"), F.col("body").alias("links"), field("related").alias("related"))


def _orphans(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    notes = _notes(spark, a.root)
    counts = graph.inbound(graph.note_links(notes), notes)
    return graph.orphans(notes.withColumn("managed", F.col("type").isin("source-mirror", "repo-mirror")), counts).select("path")


def _links(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    notes = _notes(spark, a.root)
    return graph.resolve_links(graph.note_links(notes), notes).where("resolved is null").select("src", "target")


def _overlap(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    notes = _notes(spark, a.root)
    counts = graph.inbound(graph.note_links(notes), notes)
    classes = overlap.note_classes(notes.join(counts, "path", "left").withColumn("inbound", F.coalesce("inbound", F.lit(0))))
    return overlap.note_pairs(classes).where("current").orderBy(*overlap.rank_order()).select("left_id", "right_id", "title_score", "content_score", "shared_terms", overlap.suggestion().alias("suggestion"))


def _inventory(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return corpus.files(spark, a.root).groupBy(paths.suffix(F.col("path")).alias("suffix")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes")).orderBy("suffix")


def _digests(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return ranged.digests(corpus.files(spark, a.root).select("path"), a.root)


def _secrets(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    texts = corpus.files(spark, a.root, content=True).select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("text"))
    return screening.text_findings(texts.where("text is not null"))


def _ignored(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    rules = (sinks.read_text(spark, f"{a.root}/{a.rules}") or "").splitlines()
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(a.root)
    relative = F.regexp_replace("path", "^[a-z]+:/+", "/").substr(F.lit(len(a.root.rstrip("/")) + 2), F.length("path"))
    return found.select(relative.alias("path")).where(config.ignored_by(F.col("path"), rules)).orderBy("path")


def _manifest(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return integrity.manifest_problems(spark.read.text(a.root, wholetext=True).select(F.lit(a.root).alias("path"), F.col("value").alias("text")), a.key)


def _profile(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    _, problems = config.profile(json.loads(sinks.read_text(spark, a.root) or "{}"))
    return config.dimension(spark, problems, "place string, problem string")


def _views(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    profile = json.loads(sinks.read_text(spark, a.profile) or "{}")
    if a.write:
        views.write(spark, a.root, profile)
    state = views.plan(spark, a.root, profile)
    return config.dimension(spark, [(state["path"], state["state"])] if state["state"] != "current" else [], "path string, state string")


def _watch(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """One scan, or scans every so many seconds until stopped."""
    own = Journal(spark, a.journal)
    running = feed.tree_scan(spark, a.root, f"{a.journal.rstrip('/')}-scans").writeStream.foreachBatch(changes.queue_batches(own)).option("checkpointLocation", f"{a.journal.rstrip('/')}-checkpoint")
    running = running.trigger(processingTime=f"{a.every} seconds") if a.every else running.trigger(availableNow=True)
    running.start().awaitTermination()
    return own.opened().orderBy("sequence").select("sequence", "event_kind", "current_path", "previous_path", "status")


def _reconcile(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Queue what the files and the last records (path, size, modified, sha as JSON lines) disagree on."""
    files = corpus.files(spark, a.root)
    now = files.join(ranged.digests(files.select("path"), a.root).select("path", "sha"), "path").select("path", "size", F.unix_seconds("modified").alias("modified"), "sha")
    then = spark.read.schema("path string, size long, modified long, sha string").json(a.records)
    found = diffs.snapshot_diff(now, then).select(F.col("kind").alias("event_kind"), F.col("path").alias("current_path"), "previous_path", F.current_timestamp().alias("observed_at"), F.monotonically_increasing_id().alias("n"))
    own = Journal(spark, a.journal)
    own.append(found, max([own.head()["batch"], *own.tail()[0]]) + 1)
    return own.opened().orderBy("sequence").select("sequence", "event_kind", "current_path", "previous_path", "status")


Command = Callable[[SparkSession, argparse.Namespace], DataFrame]
#: Commands over a workspace: what they show, their further arguments, whether rows are findings.
WORKSPACE: dict[str, tuple[Command, str, list[str], bool]] = {
    "inventory": (_inventory, "files and bytes by suffix", [], False),
    "digests": (_digests, "hashes of all files, read in chunks", [], False),
    "secrets": (_secrets, "secrets and payment cards in texts", [], True),
    "links": (_links, "links that name nothing", [], True),
    "orphans": (_orphans, "notes without a link to them", [], True),
    "overlap": (_overlap, "pairs of notes that say the same", [], True),
    "ignored": (_ignored, "files that an ignore file hits", ["--rules=.gitignore"], False),
    "manifest": (_manifest, "what is wrong with a manifest file", ["--key=source_id"], True),
    "profile": (_profile, "what is wrong with a profile file", [], True),
    "views": (_views, "the state of a profile's views unless current", ["profile", "--write"], True),
    "watch": (_watch, "queue what changed since the last scan", ["journal", "--every=0"], False),
    "reconcile": (_reconcile, "queue what files and records disagree on", ["records", "journal"], False),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="foliant", description="Questions about a governed corpus")
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of queries and reports")
    for name, text in (("query", "rows of a query"), ("explain", "plan of a query"), ("report", "a rendered report")):
        own = commands.add_parser(name, help=text)
        own.add_argument("name", choices=sorted(reports.REPORTS if name == "report" else catalogue.queries()), metavar="NAME")
        own.add_argument("folder", help="the folder of the tables")
        own.add_argument("--most", type=int, default=40, help="rows shown in each section")
        if name == "report":
            own.add_argument("--html", action="store_true")
        if name == "query":
            own.add_argument("--json", action="store_true")
    own = commands.add_parser("journal", help="a journal's status, recovery or compaction")
    own.add_argument("folder")
    own.add_argument("--do", choices=["status", "recover", "retry", "compact"], default="status")
    for name, (_, text, more, _) in WORKSPACE.items():
        own = commands.add_parser(name, help=text)
        own.add_argument("root")
        own.add_argument("--most", type=int, default=40, help="rows shown")
        for argument in more:
            flag, _, default = argument.partition("=")
            if flag.startswith("--") and not default:
                own.add_argument(flag, action="store_true")
            elif flag.startswith("--"):
                own.add_argument(flag, default=default, type=type(default) if not default.isdigit() else int)
            else:
                own.add_argument(flag)
    return top


def main(arguments: list[str] | None = None) -> int:
    chosen = parser().parse_args(arguments)
    if chosen.command == "list":
        print("\n".join(["queries:", *sorted(catalogue.queries()), "", "reports:", *sorted(reports.REPORTS)]))
        return 0
    spark = local_session()
    ship(spark)
    if chosen.command == "journal":
        own = Journal(spark, chosen.folder)
        if chosen.do == "compact":
            own.compact()
        elif chosen.do != "status":
            own.recover(retry_failed=chosen.do == "retry")
        own.status().show(truncate=False)
        return 0
    if chosen.command in WORKSPACE:
        run, _, _, findings = WORKSPACE[chosen.command]
        rows = run(spark, chosen)
        rows.show(chosen.most, truncate=120)
        return int(findings and not rows.isEmpty())
    if chosen.command == "report":
        print(reports.render_report(spark, chosen.folder, chosen.name, chosen.html, chosen.most))
        blocking = chosen.name == "lint" and not catalogue.queries()["lint_sections"](spark, chosen.folder).where("blocking").isEmpty()
        return int(blocking)
    found = catalogue.queries()[chosen.name](spark, chosen.folder)
    if chosen.command == "explain":
        found.explain("formatted")
    elif chosen.json:
        print("\n".join(found.limit(chosen.most).toJSON().collect()))
    else:
        found.show(chosen.most, truncate=80)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
