"""Questions about a workspace's files: exclusion by reader, source candidates, inventories, folders, file policy, snapshots of trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant import workspace
from foliant.functions import paths
from foliant.registry import query

READERS = ["office", "overlap", "lint", "catalog", "migration", "handoff", "sandbox", "pilot", "change", "recovery", "curated"]


def _listed(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


PARTS_SQL = "list_filter(string_split(path, '/'), lambda p: p <> '')"


def _excluded_sql(reader: str) -> str:
    tests = [f"list_has_any({PARTS_SQL}, {_listed(paths.EXCLUDED[reader])})"]
    if reader in paths.HIDDEN_EXCLUDES:
        tests.append(f"len(list_filter({PARTS_SQL}, lambda p: p[1] = '.')) > 0")
    if reader in paths.ARCHIVE_EXCLUDES:
        tests.append(f"len(list_filter({PARTS_SQL}, lambda p: regexp_matches(p, '^_(archive|backup|deprecated)'))) > 0")
    if reader in ("office", "catalog", "handoff", "pilot", "sandbox"):
        tests.append("path = '_mirrors' OR path LIKE '/_mirrors/%' ESCAPE '/'" if False else "path = '_mirrors' OR starts_with(path, '_mirrors/')")
    if reader == "catalog":
        tests.append("path IN ('CATALOG.md', 'CATALOG.html')")
    return "(" + " OR ".join(tests) + ")"


@query(f"WITH {workspace.sql('notes')} SELECT id, " + ", ".join(f"{_excluded_sql(r)} AS {r}" for r in READERS) + " FROM notes")
def excluded_by_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = workspace.frame(spark, sf_dir, "notes")
    return notes.select("id", *[paths.excluded(F.col("path"), r).alias(r) for r in READERS])


SUFFIX_SQL = r"lower(regexp_extract(path, '[^/](\.[^./]*)$', 1))"
TEMP_SQL = "(starts_with({0}, '~$') OR starts_with({0}, '.~') OR starts_with({0}, '.#') OR ends_with({0}, '.tmp') OR ends_with({0}, '.swp') OR ends_with({0}, '.swx'))"
UNSAFE_SQL = "(trim(path) = '' OR starts_with(trim(path), '/') OR list_has_any(string_split(trim(path), '/'), ['', '.', '..']) OR string_split(trim(path), '/')[1] = '.state')"
SAFE_SQL = "CASE WHEN trim(path) = '' OR starts_with(path, '/') OR list_contains(string_split(path, '/'), '..') THEN '' ELSE array_to_string(list_filter(string_split(path, '/'), lambda p: p <> '' AND p <> '.'), '/') END"
NAME_SQL = "string_split(path, '/')[-1]"


@query(f"""WITH {workspace.sql('notes')}, n AS (SELECT *, {NAME_SQL} AS name FROM notes)
SELECT id, CASE WHEN {UNSAFE_SQL} THEN NULL ELSE trim(path) END AS normal, {SAFE_SQL} AS safe, {SUFFIX_SQL} AS suffix,
CASE WHEN {UNSAFE_SQL} THEN 'unsafe-path' WHEN starts_with(path, '_mirrors/') THEN 'office-mirror' WHEN starts_with(path, 'repos/') THEN 'repo-mirror' WHEN {_excluded_sql('change')} THEN 'operational'
  WHEN {TEMP_SQL.format('name')} THEN 'temporary' END AS ignored,
starts_with(path, '_mirrors/') AS in_mirrors, starts_with(path, 'repos/') OR starts_with(path, 'docs/') AS in_repos,
CASE WHEN strpos(path, '/') = 0 THEN starts_with(lower(path), 'readme') OR ends_with(lower(path), '.md') ELSE (starts_with(lower(path), 'docs/') OR starts_with(lower(path), 'doc/') OR starts_with(lower(path), '.github/')) AND ends_with(lower(path), '.md') END AS is_doc,
{SUFFIX_SQL} IN ('.docx', '.pptx', '.xlsx', '.doc') AS is_source, {SUFFIX_SQL} IN ('.docx', '.pptx', '.xlsx', '.doc', '.pdf') AS is_source_or_pdf FROM n""")
def path_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return workspace.frame(spark, sf_dir, "notes").select(
        "id",
        paths.normalized(path).alias("normal"),
        paths.safe_relative(path).alias("safe"),
        paths.suffix(path).alias("suffix"),
        paths.ignored_reason(path).alias("ignored"),
        paths.under(path, F.lit("_mirrors")).alias("in_mirrors"),
        paths.under_any(path, ["repos", "docs"]).alias("in_repos"),
        paths.is_repository_doc(path).alias("is_doc"),
        paths.suffix(path).isin(paths.extensions()).alias("is_source"),
        paths.suffix(path).isin(paths.extensions(pdf=True)).alias("is_source_or_pdf"),
    )


#: A configuration's routing: alias or folder, its domain and its canonical folder.
ROUTING = [("01_en", "english", "en"), ("xen", "english", "en"), ("en", "english", "en"), ("de", "german", "de"), ("xde", "german", "de")]


def routed(files: DataFrame, routing: DataFrame, path: str = "path") -> DataFrame:
    """Adds what the routing (alias, domain, folder) says of each path's first part: _domain and _folder, null if nothing.  `routing` is a configuration of a few rows."""
    keyed = routing.select(F.col("alias").alias("_alias"), F.col("domain").alias("_domain"), F.col("folder").alias("_folder"))
    return files.join(F.broadcast(keyed), F.split(F.col(path), "/")[0] == F.col("_alias"), "left").drop("_alias")


ROUTING_SQL = "routing(alias, rd, rf) AS (VALUES " + ", ".join(f"('{a}', '{d}', '{f}')" for a, d, f in ROUTING) + ")"


@query(f"""WITH {workspace.sql('notes')}, {ROUTING_SQL}, r AS (SELECT n.*, rd, rf, string_split(path, '/')[1] AS first FROM notes n LEFT JOIN routing ON alias = string_split(path, '/')[1]), m AS (
SELECT *, CASE WHEN rf IS NOT NULL THEN rf || substr(path, length(first) + 1) ELSE path END AS canonical FROM r), p AS (
SELECT *, '_mirrors/' || regexp_replace(canonical, '([^/])\\.[^./]*$', '\\1') || '.md' AS preferred FROM m)
SELECT id, coalesce(CASE WHEN strpos(path, '/') > 0 THEN rd END, CASE WHEN strpos(path, '/') > 0 THEN regexp_replace(first, '^[0-9][0-9]_(.)', '\\1') ELSE '' END) AS domain, coalesce(rd, 'unclassified') AS path_domain, canonical, preferred,
CASE WHEN type = 'note' THEN regexp_replace(preferred, '\\.md$', '.mirror.md') ELSE preferred END AS mirror, regexp_replace(path, '([^/])\\.[^./]*$', '\\1') || '.md' AS sibling FROM p""")
def routed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain, canonical place and mirror of each path; a note that is no mirror occupies the preferred place."""
    routing = spark.createDataFrame(ROUTING, "alias string, domain string, folder string")
    notes = routed(workspace.frame(spark, sf_dir, "notes"), routing)
    path = F.col("path")
    canonical = paths.canonical_source(path, F.col("_folder"))
    own = F.when(paths.first_folder(path) != "", F.col("_domain"))
    return notes.select(
        "id",
        paths.domain_of(path, own).alias("domain"),
        F.coalesce("_domain", F.lit("unclassified")).alias("path_domain"),
        canonical.alias("canonical"),
        paths.mirror_record_path(canonical).alias("preferred"),
        paths.mirror_path(canonical, F.col("type") == "note").alias("mirror"),
        paths.mirror_record_path(path, dedicated=False).alias("sibling"),
    )


MACHINE_TYPES = ["source-mirror", "repo-mirror"]


def inventory(files: DataFrame, reader: str, mirror_root: str = "_mirrors", repo_root: str = "repos") -> DataFrame:
    """What a report counts of files (path, type, size): one row of conditional counts; each reader has its own exclusions."""
    path, kind = F.col("path"), F.col("type")
    suffix = paths.suffix(path)
    office = paths.under(path, F.lit(mirror_root))
    inside = ~paths.excluded(path, reader, mirror_root)
    markdown = inside & (suffix == ".md")
    return files.agg(
        F.count_if(inside).alias("content_files"),
        F.coalesce(F.sum(F.when(inside, F.col("size"))), F.lit(0)).alias("content_bytes"),
        F.count_if(inside & suffix.isin(paths.extensions(pdf=True))).alias("source_candidates"),
        F.count_if(office & (kind == "source-mirror")).alias("source_mirrors"),
        F.count_if(inside & ~office & (kind == "source-mirror")).alias("raw_folder_mirrors"),
        F.count_if(paths.under(path, F.lit(repo_root)) & (kind == "repo-mirror")).alias("repo_mirrors"),
        F.count_if(office & (suffix == ".md")).alias("generated_mirrors"),
        F.count_if(markdown & ~kind.isin(MACHINE_TYPES)).alias("curated_markdown"),
        F.count_if(markdown & kind.isin(MACHINE_TYPES)).alias("machine_owned_markdown"),
        F.count_if(inside & suffix.isin(".html", ".htm")).alias("html_files"),
    )


def counted(files: DataFrame, reader: str) -> DataFrame:
    """Files by extension and by top-level part in one pass: name, value, n."""
    path = F.col("path")
    inside = files.where(~paths.excluded(path, reader))
    kinds = F.array(
        F.struct(F.lit("extension").alias("name"), F.coalesce(F.nullif(paths.suffix(path), F.lit("")), F.lit("[no extension]")).alias("value")),
        F.struct(F.lit("top").alias("name"), F.split(path, "/")[0].alias("value")),
    )
    return inside.select(F.inline(kinds)).groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))


def _inventory_sql(reader: str) -> str:
    inside, suffix, office = f"(NOT {_excluded_sql(reader)})", SUFFIX_SQL, "starts_with(path, '_mirrors/')"
    return f"""SELECT '{reader}' AS reader, count(*) FILTER ({inside}) AS content_files, coalesce(sum(n_chars) FILTER ({inside}), 0)::BIGINT AS content_bytes, count(*) FILTER ({inside} AND {suffix} IN ('.docx', '.pptx', '.xlsx', '.doc', '.pdf')) AS source_candidates,
count(*) FILTER ({office} AND type = 'source-mirror') AS source_mirrors, count(*) FILTER ({inside} AND NOT {office} AND type = 'source-mirror') AS raw_folder_mirrors, count(*) FILTER (starts_with(path, 'repos/') AND type = 'repo-mirror') AS repo_mirrors,
count(*) FILTER ({office} AND {suffix} = '.md') AS generated_mirrors, count(*) FILTER ({inside} AND {suffix} = '.md' AND type NOT IN ('source-mirror', 'repo-mirror')) AS curated_markdown,
count(*) FILTER ({inside} AND {suffix} = '.md' AND type IN ('source-mirror', 'repo-mirror')) AS machine_owned_markdown, count(*) FILTER ({inside} AND {suffix} IN ('.html', '.htm')) AS html_files FROM notes"""


REPORTS = ["catalog", "pilot", "handoff", "sandbox"]


@query(f"WITH {workspace.sql('notes')} " + " UNION ALL ".join(_inventory_sql(r) for r in REPORTS))
def workspace_inventories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventories of the catalog, pilot, handoff and sandbox reports."""
    files = workspace.frame(spark, sf_dir, "notes").withColumn("size", F.col("n_chars"))
    rows = None
    for reader in REPORTS:
        own = inventory(files, reader).select(F.lit(reader).alias("reader"), "*")
        rows = own if rows is None else rows.unionByName(own)
    return rows


@query(f"""WITH {workspace.sql('notes')}, f AS (SELECT * FROM notes WHERE NOT {_excluded_sql('pilot')})
SELECT 'extension' AS name, CASE WHEN {SUFFIX_SQL} = '' THEN '[no extension]' ELSE {SUFFIX_SQL} END AS value, count(*) AS n FROM f GROUP BY 2 UNION ALL SELECT 'top', string_split(path, '/')[1], count(*) FROM f GROUP BY 2""")
def extension_and_top_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(workspace.frame(spark, sf_dir, "notes"), "pilot")


def folder_items(files: DataFrame, routing: DataFrame, canonical: list[str]) -> DataFrame:
    """Top-level folders that are neither reserved nor canonical, with their counts: an alias of a canonical folder, or unknown."""
    path = F.col("path")
    top = F.split(path, "/")[0]
    suffix = paths.suffix(path)
    own = files.where((F.size(F.split(path, "/")) > 1) & ~top.isin([*paths.RESERVED, *canonical]) & (top != ""))
    counts = own.groupBy(top.alias("folder")).agg(
        F.count(F.lit(1)).alias("files"), F.count_distinct(F.when(F.size(F.split(path, "/")) > 2, F.split(path, "/")[1])).alias("dirs"), F.count_if(suffix == ".md").alias("markdown"), F.count_if(suffix.isin(paths.extensions(pdf=True))).alias("office")
    )
    known = routed(counts, routing, "folder")
    alias = F.col("_folder").isNotNull() & (F.col("_folder") != F.col("folder"))
    return known.select("folder", F.when(alias, "alias_folder").otherwise("unknown_folder").alias("kind"), F.when(alias, F.col("_domain")).otherwise("").alias("domain"), F.when(alias, F.col("_folder")).otherwise("").alias("recommended"), "files", "dirs", "markdown", "office")


@query(f"""WITH {workspace.sql('notes')}, {ROUTING_SQL}, t AS (SELECT *, string_split(path, '/')[1] AS folder, len(string_split(path, '/')) AS depth FROM notes), c AS (
SELECT folder, count(*) AS files, count(DISTINCT CASE WHEN depth > 2 THEN string_split(path, '/')[2] END) AS dirs, count(*) FILTER ({SUFFIX_SQL} = '.md') AS markdown, count(*) FILTER ({SUFFIX_SQL} IN ('.docx', '.pptx', '.xlsx', '.doc', '.pdf')) AS office
FROM t WHERE depth > 1 AND folder <> '' AND folder NOT IN ({', '.join(f"'{r}'" for r in [*paths.RESERVED, 'en', 'de'])}) GROUP BY folder)
SELECT folder, CASE WHEN rf <> folder THEN 'alias_folder' ELSE 'unknown_folder' END AS kind, CASE WHEN rf <> folder THEN rd ELSE '' END AS domain, CASE WHEN rf <> folder THEN rf ELSE '' END AS recommended, files, dirs, markdown, office FROM c LEFT JOIN routing ON alias = folder""")
def migration_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    routing = spark.createDataFrame(ROUTING, "alias string, domain string, folder string")
    return folder_items(workspace.frame(spark, sf_dir, "notes"), routing, ["en", "de"])


#: What a public collection must not hold, by name, part and suffix.
SKIPPED_DIRS = [".git", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".venv", "__pycache__", "node_modules", "venv"]
BUILD_DIRS = ["build", "dist"]
RISKY_NAMES = [r"(^|[._-])\.?env($|[._-])", r"(^|[._-])id_(rsa|dsa|ecdsa|ed25519)$", r"(secret|credential|password|client_secret|api[_-]?key)", r"\.(pem|p12|pfx|key|token)$"]
RISKY_PARTS = ["credentials", "data", "private", "secret", "secrets"]
SYSTEM_NAMES = [".DS_Store", "Thumbs.db", "thumbs.db"]
DATA_SUFFIXES = [".7z", ".csv", ".db", ".doc", ".docx", ".gz", ".jsonl", ".parquet", ".pdf", ".ppt", ".pptx", ".sqlite", ".tar", ".tsv", ".xls", ".xlsx", ".zip"]


def policy_findings(path: Column, size: Column, allowed: Column, most_bytes: int) -> Column:
    """The findings of a file's name, parts, suffix and size, in order."""
    inner = F.transform(paths.folders(path), lambda p: F.lower(p))
    risky = F.array_sort(F.array_intersect(inner, F.array(*map(F.lit, RISKY_PARTS))))
    found = [
        F.when(F.exists(paths.parts(path), lambda p: p.isin(SKIPPED_DIRS)), "vendor-directory"),
        F.when(F.exists(paths.folders(path), lambda p: p.isin(BUILD_DIRS) | p.endswith(".egg-info")), "build-directory"),
        F.when(paths.name(path).isin(SYSTEM_NAMES) | (paths.suffix(path) == ".log") | F.exists(paths.parts(path), lambda p: p == "__MACOSX"), "generated-artifact"),
        F.when(F.lower(paths.name(path)).rlike("|".join(f"(?:{p})" for p in RISKY_NAMES)), "risky-name"),
        F.when(~path.startswith("/") & (F.size(risky) > 0), F.concat(F.lit("risky-folder:"), F.try_element_at(risky, F.lit(1)))),
        F.when(paths.suffix(path).isin(DATA_SUFFIXES) & ~allowed, "data-file"),
        F.when((size > most_bytes) & ~allowed, "large-file"),
    ]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


@query(f"""WITH {workspace.sql('notes')}, n AS (SELECT *, {PARTS_SQL} AS parts, string_split(path, '/')[:-2] AS folders, lower({NAME_SQL}) AS low, {NAME_SQL} AS name, doc_allowed.ok AS ok FROM notes, LATERAL (SELECT lang = 'de' AS ok) doc_allowed),
f AS (SELECT id, unnest(list_filter([
CASE WHEN list_has_any(parts, {_listed(SKIPPED_DIRS)}) THEN 'vendor-directory' END,
CASE WHEN list_has_any(folders, ['build', 'dist']) OR len(list_filter(folders, lambda p: ends_with(p, '.egg-info'))) > 0 THEN 'build-directory' END,
CASE WHEN name IN ('.DS_Store', 'Thumbs.db', 'thumbs.db') OR {SUFFIX_SQL} = '.log' OR list_contains(parts, '__MACOSX') THEN 'generated-artifact' END,
CASE WHEN {' OR '.join(f"regexp_matches(low, '{p}')" for p in RISKY_NAMES)} THEN 'risky-name' END,
CASE WHEN NOT starts_with(path, '/') AND list_has_any(list_transform(folders, lambda p: lower(p)), {_listed(RISKY_PARTS)}) THEN 'risky-folder:' || list_sort(list_intersect(list_transform(folders, lambda p: lower(p)), {_listed(RISKY_PARTS)}))[1] END,
CASE WHEN {SUFFIX_SQL} IN ({', '.join(f"'{s}'" for s in DATA_SUFFIXES)}) AND NOT ok THEN 'data-file' END, CASE WHEN n_chars > 5000 AND NOT ok THEN 'large-file' END], lambda x: x IS NOT NULL)) AS finding FROM n) SELECT id, finding FROM f""")
def file_policy_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = workspace.frame(spark, sf_dir, "notes")
    found = policy_findings(F.col("path"), F.col("n_chars"), F.col("lang") == "de", 5000)
    return notes.select("id", F.explode(found).alias("finding"))


#: Lines that all must occur for a YAML file to be a private result or task pack.
SHAPES = {
    "result-pack": [r"^\s*schema_version\s*:\s*1\s*$", r"^\s*results\s*:\s*$", r"^\s*-\s*task_id\s*:", r"^\s*mode\s*:", r"^\s*score\s*:"],
    "task-pack": [r"^\s*schema_version\s*:\s*1\s*$", r"^\s*tasks\s*:\s*$", r"^\s*-\s*id\s*:", r"^\s*family\s*:", r"^\s*prompt\s*:", r"^\s*success_criteria\s*:"],
    "quality-pack": [r"^\s*schema_version\s*:\s*1\s*$", r"^\s*reviews\s*:\s*$", r"^\s*-\s*source_id\s*:", r"^\s*status\s*:", r"^\s*score\s*:"],
}


def shapes(path: Column, text: Column) -> Column:
    """The kinds of private pack that a text looks like, whatever its name."""
    fits = paths.suffix(path).isin(".yaml", ".yml") & F.array_contains(F.split(path, "/"), "_meta")
    every = lambda lines: [text.rlike("(?m)" + p) for p in lines]

    def whole(lines: list[str]) -> Column:
        out = fits
        for test in every(lines):
            out &= test
        return out

    return F.filter(F.array(*[F.when(whole(lines), F.lit(kind)) for kind, lines in SHAPES.items()]), lambda x: x.isNotNull())


PACK_EXPR = """'_meta/pack' || conv_id || CASE WHEN turn % 5 = 0 THEN '.txt' ELSE '.yml' END"""
PACK_TEXT = """'schema_version: 1' || chr(10) || CASE turn % 3 WHEN 0 THEN 'results:' || chr(10) || ' - task_id: a' || chr(10) || '   mode: b' || chr(10) || CASE WHEN conv_id % 2 = 0 THEN '   score: 2' ELSE '   score 2' END WHEN 1 THEN 'reviews:' || chr(10) || '- source_id: a' || chr(10) || '  status: x' || chr(10) || '  score: 1'
ELSE 'tasks:' || chr(10) || '- id: a' || chr(10) || '  family: x' || chr(10) || '  prompt: p' || chr(10) || '  success_criteria: []' END || chr(10) || text"""


@query(f"""WITH p AS (SELECT conv_id, turn, {PACK_EXPR} AS path, {PACK_TEXT} AS text FROM conversations) SELECT conv_id, turn, kind FROM (SELECT conv_id, turn, unnest([""" + ", ".join("CASE WHEN " + " AND ".join(f"regexp_matches(text, '(?m){p}')" for p in lines) + f" THEN '{kind}' END" for kind, lines in SHAPES.items()) + """]) AS kind FROM p WHERE ends_with(path, '.yml')) WHERE kind IS NOT NULL""")
def pack_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.registry import table

    packs = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{PACK_EXPR} AS path", f"{PACK_TEXT} AS text")
    return packs.select("conv_id", "turn", F.explode(shapes(F.col("path"), F.col("text"))).alias("kind"))


def interrupted_writes(files: DataFrame) -> DataFrame:
    """Files of the form `.name.number.tmp`: their path, the file they were to become, and whether that is there."""
    own = files.where(paths.name(F.col("path")).rlike(r"^\..+\.\d+\.tmp$") & ~paths.excluded(F.col("path"), "recovery"))
    target = F.regexp_replace(F.regexp_replace("path", r"\.\d+\.tmp$", ""), r"(^|/)\.+([^/]*)$", "$1$2")
    known = files.select(F.col("path").alias("expected"), F.lit(True).alias("_there")).distinct()
    return own.select("path", target.alias("expected")).join(known, "expected", "left").select("path", "expected", F.coalesce("_there", F.lit(False)).alias("expected_exists"))


@query(f"""WITH {workspace.sql('notes')}, t AS (SELECT path, regexp_replace(regexp_replace(path, '\\.[0-9]+\\.tmp$', ''), '(^|/)\\.+([^/]*)$', '\\1\\2') AS expected FROM notes WHERE regexp_matches({NAME_SQL}, '^\\..+\\.[0-9]+\\.tmp$') AND NOT {_excluded_sql('recovery')})
SELECT path, expected, expected IN (SELECT path FROM notes) AS expected_exists FROM t""")
def interrupted_write_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interrupted_writes(workspace.frame(spark, sf_dir, "notes"))


def repository_docs(files: DataFrame, repo: str, most_each: int, most_total: int) -> DataFrame:
    """Documentation of each repository (columns `repo`, path, text): readme files first, each text cut at `most_each`, until the total passes `most_total`; the first that does not fit is marked, later ones go."""
    from foliant.operators.windows import running_cap

    own = files.where(paths.is_repository_doc(F.col("path"))).withColumn("text", F.when(F.length("text") > most_each, F.concat(F.left("text", F.lit(most_each)), F.lit("[cut]"))).otherwise(F.col("text")))
    order = [*paths.docs_order(F.col("path")), F.col("path")]
    return running_cap(own, [repo], order, F.length("text"), most_total).withColumnRenamed("cut", "omitted")


DOC_PATH = "CASE doc_id % 5 WHEN 0 THEN 'README.md' WHEN 1 THEN 'docs/' || lang || doc_id || '.md' WHEN 2 THEN 'src/' || doc_id || '.md' WHEN 3 THEN 'notes' || doc_id || '.MD' ELSE '.github/x' || doc_id || '.md' END"
IS_DOC_SQL = "(CASE WHEN strpos(path, '/') = 0 THEN starts_with(lower(path), 'readme') OR ends_with(lower(path), '.md') ELSE (starts_with(lower(path), 'docs/') OR starts_with(lower(path), '.github/')) AND ends_with(lower(path), '.md') END)"


@query(f"""WITH d AS (SELECT doc_id, 'r' || (doc_id % 97) AS repo, {DOC_PATH} || doc_id AS path0, CASE WHEN doc_id % 5 = 0 THEN 'README' || doc_id || '.md' ELSE {DOC_PATH} END AS path, text FROM documents), c AS (
SELECT doc_id, repo, path, CASE WHEN length(text) > 2000 THEN 2005 ELSE length(text) END AS size FROM d WHERE {IS_DOC_SQL}), s AS (
SELECT *, sum(size) OVER (PARTITION BY repo ORDER BY NOT starts_with(string_split(lower(path), '/')[-1], 'readme'), lower(path), path) AS running FROM c) SELECT doc_id, repo, path, running > 6000 AS omitted FROM s WHERE running - size <= 6000""")
def repository_doc_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.registry import table

    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", "'r' || (doc_id % 97) AS repo", f"CASE WHEN doc_id % 5 = 0 THEN 'README' || doc_id || '.md' ELSE {DOC_PATH} END AS path", "text")
    return repository_docs(docs, "repo", 2000, 6000).select("doc_id", "repo", "path", "omitted")


