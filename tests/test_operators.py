"""Small hand-written cases for what the tables do not hold."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from foliant.functions import paths, rounding, text
from foliant.operators import classify, diffs, graph, windows
from foliant.plans import reports
from foliant.sources import corpus


def values(spark, expr, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_secrets_and_cards(spark):
    rows = [("AKIA" + "A" * 16,), ("x ghp_" + "a" * 24,), ("-----BEGIN RSA PRIVATE KEY-----",), ("123-45-6789",), ("sk-" + "b" * 22,), ("xoxb-" + "c" * 22,), ("plain",), (None,)]
    found = values(spark, text.secret_labels(F.col("t")), rows, "t string")
    assert [x[0] if x else None for x in found] == ["aws access key", "github token", "private key", "ssn", "openai api key", "slack token", None, None]
    cards = values(spark, text.card_numbers(F.col("t")), [("pay 4111 1111 1111 1111 now",), ("4111 1111 1111 1112",), (None,)], "t string")
    assert cards == [["4111111111111111"], [], []]


def test_text_functions(spark):
    notes = [("See [[Plan|the plan]] and `code` https://x.y/z about Budget-2024 [a](b)",)]
    assert values(spark, F.array_sort(text.terms(F.col("t"))), notes, "t string") == [["and", "budget-2024", "plan", "see"]]
    assert values(spark, text.wiki_targets(F.col("t")), [("[[a/b#h|x]] `[[no]]` [[c]]",)], "t string") == [["a/b", "c"]]
    assert values(spark, text.table_cells(F.col("t")), [(r"| a \| b | c |",)], "t string") == [["a | b", "c"]]
    assert values(spark, text.before_sentinel(F.col("t"), "%% AUTO %%"), [("mine\n%% AUTO %%\nrest",), ("x %% AUTO %%",)], "t string") == ["mine\n", "x %% AUTO %%"]
    assert values(spark, rounding.py_round(F.col("v"), 2), [(0.125,), (2.675,), (None,)], "v double") == [0.12, 2.67, None]
    assert values(spark, text.truth(F.col("t")), [("Yes",), ("0",), ("maybe",)], "t string") == [True, False, None]


def test_paths(spark):
    rows = [("a/b.docx",), ("../x",), ("/abs",), ("_mirrors/a.md",), ("a/~$b.docx",), ("tools/x",), ("repos/r.md",)]
    assert values(spark, paths.ignored_reason(F.col("p")), rows, "p string") == [None, "unsafe-path", "unsafe-path", "office-mirror", "temporary", "operational", "repo-mirror"]
    assert values(spark, paths.excluded(F.col("p")), [("a/.git/x",), ("_archive_2/x",), ("a/b",)], "p string") == [True, True, False]
    assert values(spark, paths.mirror_path(F.col("p"), F.col("p").startswith("b")), [("a/b.docx",), ("b/c.pdf",)], "p string") == ["_mirrors/a/b.md", "_mirrors/b/c.mirror.md"]
    assert values(spark, paths.ignored_reason(F.col("p")), [("a/_meta/x.md",), ("a/_archive2/x",), ("a/.x.swp",), ("a/.#x",), ("_fixtures/x",)], "p string") == ["operational", "operational", "temporary", "temporary", None]
    assert values(spark, paths.excluded(F.col("p"), "overlap"), [("a/_fixtures/x",), ("_meta/x",), (".git/x",)], "p string") == [True, True, False]


def test_links_fall_back_only_without_a_slash(spark):
    files = spark.createDataFrame([("a/x.md",), ("b/y.md",), ("b/x.md",), ("c.txt",)], "path string")
    links = spark.createDataFrame([("a/n.md", "x"), ("z/n.md", "a/x"), ("a/n.md", "q/y"), ("a/n.md", "b/y"), ("a/n.md", "c.txt"), ("a/n.md", "c"), ("a/n.md", "y.md"), ("a/n.md", "../a/x")], "src string, target string")
    got = sorted((r.src, r.target, r.resolved or "", r.strategy or "", r.files or 0) for r in graph.resolve_links(links, files).collect())
    assert got == [("a/n.md", "../a/x", "", "", 0), ("a/n.md", "b/y", "b/y.md", "path.md", 1), ("a/n.md", "c", "c.txt", "path.*", 1), ("a/n.md", "c.txt", "c.txt", "path", 1), ("a/n.md", "q/y", "", "", 0), ("a/n.md", "x", "a/x.md", "stem", 2), ("a/n.md", "y.md", "b/y.md", "name", 1), ("z/n.md", "a/x", "a/x.md", "path.md", 1)]
    more = links.unionByName(spark.createDataFrame([("a/x.md", "x"), ("a/x.md", "x"), ("b/x.md", "b/x"), ("b/x.md", "x.md")], "src string, target string"))
    # every link to the name x counts for both files of it, but for a file's links to itself
    assert sorted(map(tuple, graph.inbound(more, files).collect())) == [("a/x.md", 3), ("b/x.md", 3), ("b/y.md", 2)]


def test_hot_names_never_meet_their_files_one_by_one(spark):
    files = spark.range(300).select(F.concat(F.lit("d"), "id", F.lit("/index.md")).alias("path"))
    links = files.select(F.col("path").alias("src"), F.lit("index").alias("target")).repartition(4)
    counts = graph.inbound(links, files)
    assert {r.inbound for r in counts.collect()} == {299} and counts.count() == 300


def test_link_scan_reads_fields_and_skips_code(spark):
    rows = [("``[[no]]`` [[a\\|b]] ```[[no]]``` [[x#h\\|y]] `[[open]] [[z]]", ["[[f]] `[[g]]`", None, "plain"])]
    frame = spark.createDataFrame(rows, "t string, v array<string>").select(text.wiki_targets(F.col("t"), F.col("v")).alias("x"))
    assert frame.first().x == ["a", "x", "open", "z", "f", "g"]


def test_snapshot_diff_moves(spark):
    schema = "path string, size long, modified long, sha string"
    now = spark.createDataFrame([("same", 1, 0, "s"), ("edited", 2, 1, "e2"), ("new/m", 3, 0, "m"), ("new/z", 3, 0, "m"), ("two", 4, 0, "t"), ("fresh", 9, 0, "f")], schema)
    then = spark.createDataFrame([("same", 1, 0, "s"), ("edited", 2, 0, "e"), ("old/m", 3, 0, "m"), ("t1", 4, 0, "t"), ("t2", 4, 0, "t"), ("gone", 5, 0, "g")], schema)
    got = sorted((r.path or "", r.previous_path or "", r.kind) for r in diffs.snapshot_diff(now, then).collect())
    assert got == [("", "gone", "deleted"), ("edited", "", "modified"), ("fresh", "", "created"), ("new/m", "old/m", "moved"), ("new/z", "", "created"), ("two", "", "reconcile-required")]


def test_running_cap_marks_the_first_overflow(spark):
    rows = spark.createDataFrame([("g", i, 40) for i in range(5)], "g string, i int, n int")
    got = windows.running_cap(rows, ["g"], [F.col("i")], F.col("n"), 100).orderBy("i").collect()
    assert [(r.i, r.cut) for r in got] == [(0, False), (1, False), (2, True)]


def test_finish_and_repo_plan(spark):
    assert values(spark, classify.finish_status(F.col("s")), [("created(.mirror.md)",), ("error: x",), ("skipped: y",), ("source-missing",), ("unstable",)], "s string") == ["applied", "failed", "review-required", "applied", "failed"]
    schema = "has_errors boolean, note_conflict boolean, note_exists boolean, stored_hash string, has_sentinel boolean, region_hash string, has_annotations boolean, last_commit string, config_version string, record_config_version string, record_commit string, identity_drift boolean, note_commit string"
    rows = [(False, False, False, None, False, None, False, None, "1", "1", None, False, None), (False, False, True, "h", True, "h", False, "c", "1", "1", "c", False, "c"), (False, True, True, "h", True, "h", False, "c", "1", "1", "c", False, "c")]
    got = classify.planned(spark.createDataFrame(rows, schema), classify.REPO_PLAN).collect()
    assert [(r.action, r.lifecycle_state) for r in got] == [("create", "unreachable"), ("unchanged", "clean"), ("review", "conflict")]


def test_readers_and_sinks(spark, tmp_path):
    root = tmp_path / "vault"
    (root / "notes").mkdir(parents=True)
    (root / ".hidden").mkdir()
    (root / "notes" / "a.md").write_text("---\ntitle: T\ntags: [x, y]\ntype: note\n---\nbody --- more")
    (root / ".hidden" / "b.md").write_text("no")
    (root / "notes" / "bad.md").write_text("---\n  : :\n---\nx")
    got = {r.path: r for r in corpus.notes(spark, str(root)).collect()}
    assert set(got) == {"notes/a.md", "notes/bad.md"}
    assert (got["notes/a.md"].title, got["notes/a.md"].fm["tags"], got["notes/a.md"].body) == ("T", "x, y", "\nbody --- more")
    assert got["notes/bad.md"].fm is None
    assert corpus.parse_frontmatter("---\na: b---c\n---\nx", "split3")[0] == {"a": "b"}
    manifest = root / "m.json"
    manifest.write_text(json.dumps({"schema_version": 1, "records": [{"source_id": "a", "source_size": 1}, {"source_id": "a", "source_size": 2}, {}]}))
    records = corpus.manifest(spark, str(manifest))
    assert [(r.source_id, r.source_size) for r in corpus.keyed_records(records, "source_id").collect()] == [("a", 2)]
    log = root / "audit.jsonl"
    log.write_text('{"tool": "x"}\nnot json\n\n{"tool": "y"}\n')
    assert [(r.line_number, r.bad) for r in corpus.json_lines(spark, str(log), "tool string").orderBy("line_number").collect()] == [(1, False), (2, True), (4, False)]
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        archive.writestr("word/document.xml", "<w:t>hello &amp; you</w:t>")
        archive.writestr("image.png", "x")
    parts = corpus.ooxml_parts(spark.createDataFrame([("d.docx", bytearray(buffer.getvalue())), ("e.docx", bytearray(b"no zip"))], "path string, content binary")).collect()
    assert sorted((p.path, p.part, p.text.strip(), p.error) for p in parts) == [("d.docx", "word/document.xml", "hello & you", None), ("e.docx", "", "", "not a zip file")]
    frame = spark.createDataFrame([(1, ["b", "a"])], "id int, tags array<string>")
    assert corpus.write_if_changed(frame, str(tmp_path / "out")) and not corpus.write_if_changed(frame.select("id", F.array(F.lit("a"), F.lit("b")).alias("tags")), str(tmp_path / "out"))


def test_reports_render(spark):
    frame = spark.createDataFrame([("a|b", 1), ("<c>", 2), ("d", 3)], "name string, n int")
    assert "(1 more)" in reports.render_markdown("R", {"S": frame}, most=2)
    assert "&lt;c&gt;" in reports.render_html("R", {"S": frame})
