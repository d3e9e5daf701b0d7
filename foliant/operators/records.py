"""Operators over manifest records: conversion and recovery items, force blockers, drift, resolution of moved sources, upserts, reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant import workspace
from foliant.functions import paths
from foliant.operators.inventory import group_counts, label, list_items
from foliant.registry import query, table

#: Lifecycle states and formats by the risk they stand for.
HIGH_STATES = ["conflict", "error", "manual_modification", "source_missing", "source_moved", "unsupported"]
DONE_STATES = ["clean", "reviewed"]
RISKY_FORMATS = ["pdf", "pptx", "xlsx", "xls", "doc"]
REVIEW_STATES = ["conflict", "error", "manual_modification", "missing_mirror", "repo_changed", "repo_unconfigured", "source_changed", "source_missing", "stale", "unreachable", "unsupported"]
RISK_PREFIXES = ["Conversion-quality risk:", "Large-file risk:", "Sensitive-name risk:", "Potential duplicate:"]
FORCE_BLOCKERS = {"source": ["Generated region sentinel is missing", "no manifest-generated baseline", "Unmigrated mirror annotations found"], "repo": ["generated sentinel", "no manifest-generated baseline", "unmigrated repo mirror annotations"]}


def texts(values: Column) -> Column:
    """Entries of a list without blank ones; a null list has none."""
    return F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.trim(x) != "")


def path_problem(kind: str, path: Column) -> Column:
    """What is wrong with a record's path; null if nothing."""
    blank = F.coalesce(F.trim(path) == "", F.lit(True))
    unsafe = path.startswith("/") | F.exists(F.split(path, "/"), lambda p: p == "..")
    return F.when(blank, f"{kind} path missing").when(unsafe, F.concat(F.lit(f"{kind} path unsafe: "), path))


def risk_texts(warnings: Column) -> Column:
    return F.filter(texts(warnings), lambda w: paths.starts_with_any(w, RISK_PREFIXES))


def conversion_items(records: DataFrame) -> DataFrame:
    """Each record (source_id, path, mirror, format, state, size, warnings, errors, source_exists, mirror_exists) with priority, reasons and action.

    Existence is three-valued: null where the path is missing or unsafe.
    """
    state, kind = label(F.col("state")), F.lower(F.coalesce("format", F.lit("")))
    problems = F.filter(F.array(path_problem("source", F.col("path")), path_problem("mirror", F.col("mirror"))), lambda x: x.isNotNull())
    known = lambda flag, path: F.when(path_problem("", F.col(path)).isNull(), F.col(flag))
    rows = records.select(
        "*",
        state.alias("_state"),
        kind.alias("_format"),
        problems.alias("_problems"),
        known("source_exists", "path").alias("_source"),
        known("mirror_exists", "mirror").alias("_mirror"),
        texts(F.col("warnings")).alias("_warnings"),
        texts(F.col("errors")).alias("_errors"),
    )
    gone, unmirrored = F.col("_source").eqNullSafe(F.lit(False)), F.col("_mirror").eqNullSafe(F.lit(False))
    s, f = F.col("_state"), F.col("_format")
    high = (F.size("_problems") > 0) | s.isin(HIGH_STATES) | (F.size("_errors") > 0) | gone | unmirrored
    medium = ~s.isin(DONE_STATES) | (F.size(risk_texts(F.col("_warnings"))) > 0) | f.isin(RISKY_FORMATS)
    priority = F.when(high, "high").when(medium, "medium").otherwise("low")
    named = F.when(f == "", "unknown").otherwise(f)
    first = F.array(F.when(~s.isin(DONE_STATES), F.concat(F.lit("state="), s)), F.when(f.isin(RISKY_FORMATS), F.concat(F.lit("format="), named)), F.when(gone, F.lit("source missing")), F.when(unmirrored, F.lit("mirror missing")))
    reasons = F.concat(F.filter(first, lambda x: x.isNotNull()), F.col("_problems"), risk_texts(F.col("_warnings")), F.col("_errors"))
    action = (
        F.when(s.isin("conflict", "error", "manual_modification", "source_missing", "source_moved"), "resolve-first")
        .when((s == "unsupported") | (f == "doc"), "keep-original")
        .when(s.isin("converter_changed", "source_changed", "stale"), "refresh")
        .when(priority == "high", "review-all")
        .when(priority == "medium", "spot-check")
        .otherwise("sample")
    )
    return rows.select("source_id", F.coalesce("path", F.lit("")).alias("source"), F.coalesce("mirror", F.lit("")).alias("mirror"), f.alias("format"), s.alias("state"), "size", F.col("_source").alias("source_exists"), F.col("_mirror").alias("mirror_exists"), priority.alias("priority"), reasons.alias("reasons"), action.alias("action"))


def low_sample(items: DataFrame, each: int, order: str) -> DataFrame:
    """The first `each` low-priority items of each format."""
    from foliant.operators.windows import heads

    return heads(items.where("priority = 'low'"), "format", order, each)


def conversion_report(items: DataFrame, each: int, order: str) -> DataFrame:
    """The items to look at: all of high and medium priority and a sample of the low, with their rank; sorted by priority, format and source."""
    chosen = items.where("priority <> 'low'").unionByName(low_sample(items, each, order))
    rank = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2)
    return chosen.withColumn("rank", rank).orderBy("rank", "format", "source")


def summary(items: DataFrame) -> DataFrame:
    """Counts by priority, state and format: name, value, n."""
    return group_counts(items, "priority", "state", "format")


def split_lists(records: DataFrame, *columns: str) -> DataFrame:
    """Lists that the workspace frame holds as text, as arrays."""
    return records.withColumns({c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, ";")) for c in columns})


def record_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_lists(workspace.frame(spark, sf_dir, "records"), "warnings", "errors", "candidates").withColumnRenamed("record_id", "source_id")


LIST_SQL = "CASE WHEN {0} = '' THEN [] ELSE string_split({0}, ';') END"
HIGH_SQL = ", ".join(f"'{s}'" for s in HIGH_STATES)
ITEMS_SQL = f"""{workspace.sql('records')}, w AS (SELECT *, CASE WHEN state = '' THEN 'unknown' ELSE state END AS st, lower(format) AS fm, list_filter({LIST_SQL.format('warnings')}, lambda x: trim(x) <> '') AS ws, list_filter({LIST_SQL.format('errors')}, lambda x: trim(x) <> '') AS es,
CASE WHEN trim(path) = '' THEN 'source path missing' WHEN starts_with(path, '/') OR list_contains(string_split(path, '/'), '..') THEN 'source path unsafe: ' || path END AS p1,
CASE WHEN trim(mirror) = '' THEN 'mirror path missing' WHEN starts_with(mirror, '/') OR list_contains(string_split(mirror, '/'), '..') THEN 'mirror path unsafe: ' || mirror END AS p2 FROM records),
v AS (SELECT *, CASE WHEN p1 IS NULL THEN source_exists END AS se, CASE WHEN p2 IS NULL THEN mirror_exists END AS me, list_filter(ws, lambda x: starts_with(x, 'Conversion-quality risk:') OR starts_with(x, 'Large-file risk:') OR starts_with(x, 'Sensitive-name risk:') OR starts_with(x, 'Potential duplicate:')) AS risks FROM w),
u AS (SELECT *, CASE WHEN p1 IS NOT NULL OR p2 IS NOT NULL OR st IN ({HIGH_SQL}) OR len(es) > 0 OR se = false OR me = false THEN 'high' WHEN st NOT IN ('clean', 'reviewed') OR len(risks) > 0 OR fm IN ('pdf', 'pptx', 'xlsx', 'xls', 'doc') THEN 'medium' ELSE 'low' END AS priority FROM v),
items AS (SELECT pos, record_id AS source_id, path AS source, mirror, fm AS format, st AS state, size, se AS source_exists, me AS mirror_exists, priority,
list_concat(list_filter([CASE WHEN st NOT IN ('clean', 'reviewed') THEN 'state=' || st END, CASE WHEN fm IN ('pdf', 'pptx', 'xlsx', 'xls', 'doc') THEN 'format=' || fm END, CASE WHEN se = false THEN 'source missing' END, CASE WHEN me = false THEN 'mirror missing' END, p1, p2], lambda x: x IS NOT NULL), list_concat(risks, es)) AS reasons,
CASE WHEN st IN ('conflict', 'error', 'manual_modification', 'source_missing', 'source_moved') THEN 'resolve-first' WHEN st = 'unsupported' OR fm = 'doc' THEN 'keep-original' WHEN st IN ('converter_changed', 'source_changed', 'stale') THEN 'refresh' WHEN priority = 'high' THEN 'review-all' WHEN priority = 'medium' THEN 'spot-check' ELSE 'sample' END AS action FROM u)"""


@query(f"WITH {ITEMS_SQL} SELECT * EXCLUDE (pos) REPLACE (array_to_string(reasons, '|') AS reasons) FROM items")
def conversion_item_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversion_items(record_frame(spark, sf_dir)).withColumn("reasons", F.array_join("reasons", "|"))


@query(f"""WITH {ITEMS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY format, priority ORDER BY source) AS k FROM items) SELECT CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS rank, source_id, source, format, priority, action FROM r WHERE priority <> 'low' OR k <= 2""")
def conversion_report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversion_report(conversion_items(record_frame(spark, sf_dir)), 2, "source").select("rank", "source_id", "source", "format", "priority", "action")


@query(f"""WITH {ITEMS_SQL} SELECT 'priority' AS name, priority AS value, count(*) AS n FROM items GROUP BY 2 UNION ALL SELECT 'state', state, count(*) FROM items GROUP BY 2 UNION ALL SELECT 'format', CASE WHEN format = '' THEN 'unknown' ELSE format END, count(*) FROM items GROUP BY 2""")
def conversion_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(conversion_items(record_frame(spark, sf_dir)))


#: A lifecycle contract of states: whether a manifest may hold them, and what may be done next.
CONTRACT = [("office", "conflict", True, "two identities meet", "resolve"), ("office", "stale", True, "configuration is newer", "sync"), ("office", "source_missing", True, "no source", "locate"), ("repo", "stale", True, "repo is newer", "sync"), ("repo", "repo_unconfigured", False, "no config entry", "restore")]
CONTRACT_SQL = "contract(ck, cs, manifest_state, explanation, next_action) AS (VALUES " + ", ".join(f"('{k}', '{s}', {str(m).lower()}, '{e}', '{a}')" for k, s, m, e, a in CONTRACT) + ")"


def effective_repos(repos: DataFrame) -> DataFrame:
    """Records of repositories (state, configured): the state in effect is `repo_unconfigured` where the configuration lacks them."""
    state = label(F.col("state"))
    return repos.withColumns({"manifest_state": state, "state": F.when(~F.col("configured"), "repo_unconfigured").otherwise(state)})


def office_recovery(records: DataFrame) -> DataFrame:
    """Items of source records with a reason to recover: kind, id, state, target, reasons."""
    state = label(F.col("state"))
    known = lambda flag, path: F.when(path_problem("", F.col(path)).isNull(), F.col(flag))
    reasons = F.array(F.when(~state.isin(DONE_STATES), F.concat(F.lit("state="), state)), F.when(known("source_exists", "path").eqNullSafe(F.lit(False)), F.lit("source path missing")), F.when(known("mirror_exists", "mirror").eqNullSafe(F.lit(False)) & (state != "planned"), F.lit("mirror path missing")))
    rows = records.select(F.lit("office").alias("kind"), F.col("source_id").alias("id"), state.alias("state"), F.coalesce("mirror", F.lit("")).alias("target"), F.filter(reasons, lambda x: x.isNotNull()).alias("reasons"))
    return rows.where(F.size("reasons") > 0)


def repo_recovery(repos: DataFrame) -> DataFrame:
    """The same of repositories."""
    rows = effective_repos(repos)
    s, m = F.col("state"), F.col("manifest_state")
    reasons = F.array(F.when(~s.isin(DONE_STATES), F.concat(F.lit("state="), s)), F.when(~F.col("configured"), F.lit("repo config entry missing")), F.when(~F.col("configured") & (m != s), F.concat(F.lit("manifest_state="), m)), F.when(~F.col("note_exists") & (s != "planned"), F.lit("repo mirror note missing")))
    return rows.select(F.lit("repo").alias("kind"), F.col("repo_id").alias("id"), "state", F.col("note").alias("target"), F.filter(reasons, lambda x: x.isNotNull()).alias("reasons")).where(F.size("reasons") > 0)


def recovery(records: DataFrame, repos: DataFrame, temporary: DataFrame, contract: DataFrame, audit: DataFrame) -> DataFrame:
    """All items to recover, with what the contract (kind, state; a few rows) says of their state and the latest audit event (kind, id, last_status) of their id."""
    temp = temporary.select(F.lit("temp").alias("kind"), F.lit("").alias("id"), F.lit("interrupted_write").alias("state"), F.col("path").alias("target"), F.array(F.lit("stale temporary file")).alias("reasons"))
    items = office_recovery(records).unionByName(repo_recovery(repos)).unionByName(temp)
    return items.join(F.broadcast(contract), ["kind", "state"], "left").join(audit, ["kind", "id"], "left")


RECOVERY_SQL = f"""{workspace.sql('records')}, {workspace.sql('repos')}, {workspace.sql('notes')}, {CONTRACT_SQL},
o AS (SELECT record_id AS id, CASE WHEN state = '' THEN 'unknown' ELSE state END AS state, mirror AS target, trim(path) = '' OR starts_with(path, '/') OR list_contains(string_split(path, '/'), '..') AS bad, trim(mirror) = '' AS badm, source_exists, mirror_exists FROM records),
r AS (SELECT repo_id AS id, CASE WHEN state = '' THEN 'unknown' ELSE state END AS ms, CASE WHEN NOT configured THEN 'repo_unconfigured' WHEN state = '' THEN 'unknown' ELSE state END AS state, note AS target, configured, note_exists FROM repos),
items AS (SELECT 'office' AS kind, id, state, target, list_filter([CASE WHEN state NOT IN ('clean', 'reviewed') THEN 'state=' || state END, CASE WHEN NOT bad AND NOT source_exists THEN 'source path missing' END, CASE WHEN NOT badm AND NOT mirror_exists AND state <> 'planned' THEN 'mirror path missing' END], lambda x: x IS NOT NULL) AS reasons FROM o
UNION ALL SELECT 'repo', id, state, target, list_filter([CASE WHEN state NOT IN ('clean', 'reviewed') THEN 'state=' || state END, CASE WHEN NOT configured THEN 'repo config entry missing' END, CASE WHEN NOT configured AND ms <> state THEN 'manifest_state=' || ms END, CASE WHEN NOT note_exists AND state <> 'planned' THEN 'repo mirror note missing' END], lambda x: x IS NOT NULL) FROM r
UNION ALL SELECT 'temp', '', 'interrupted_write', path, ['stale temporary file'] FROM notes WHERE regexp_matches(string_split(path, '/')[-1], '^\\..+\\.[0-9]+\\.tmp$')),
audit AS (SELECT 'office' AS ak, 'src_' || user_id AS ai, arg_max(event_type, (ts, event_id)) AS last_status FROM events GROUP BY user_id)"""


@query(f"""WITH {RECOVERY_SQL} SELECT kind, id, state, target, array_to_string(reasons, '|') AS reasons, explanation, next_action, last_status FROM items LEFT JOIN contract ON ck = kind AND cs = state LEFT JOIN audit ON ak = kind AND ai = id WHERE len(reasons) > 0""")
def recovery_item_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recovery report's items of both manifests and of interrupted writes, with contract and latest audit event."""
    from foliant.operators.files import interrupted_writes

    contract = spark.createDataFrame(CONTRACT, "kind string, state string, manifest_state boolean, explanation string, next_action string")
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_status"))
    audit = last.select(F.lit("office").alias("kind"), F.concat(F.lit("src_"), "user_id").alias("id"), "last_status")
    found = recovery(record_frame(spark, sf_dir), workspace.frame(spark, sf_dir, "repos"), interrupted_writes(workspace.frame(spark, sf_dir, "notes")), contract, audit)
    return found.select("kind", "id", "state", "target", F.array_join("reasons", "|").alias("reasons"), "explanation", "next_action", "last_status")


@query(f"""WITH {RECOVERY_SQL}, k AS (SELECT kind FROM items WHERE len(reasons) > 0) SELECT count(*) AS total, count(*) FILTER (kind = 'office') AS office, count(*) FILTER (kind = 'repo') AS repo, count(*) FILTER (kind = 'temp') AS temp FROM k""")
def recovery_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.operators.files import interrupted_writes

    kinds = office_recovery(record_frame(spark, sf_dir)).select("kind").union(repo_recovery(workspace.frame(spark, sf_dir, "repos")).select("kind"))
    kinds = kinds.union(interrupted_writes(workspace.frame(spark, sf_dir, "notes")).select(F.lit("temp")))
    of = lambda k: F.count_if(F.col("kind") == k).alias(k)
    return kinds.agg(F.count(F.lit(1)).alias("total"), of("office"), of("repo"), of("temp"))


def blocks_force(state: Column, warnings: Column, previous_mirror: Column | None = None, kind: str = "source") -> Column:
    """Whether a record's review state also holds against a forced run."""
    low = kind == "repo"
    told = F.exists(texts(warnings), lambda w: F.greatest(F.lit(False), *[(F.lower(w) if low else w).contains(b) for b in FORCE_BLOCKERS[kind]]))
    blocked = (state == "conflict") | ((state == "manual_modification") & told)
    return blocked if previous_mirror is None else blocked | ((state == "source_moved") & (F.coalesce(previous_mirror, F.lit("")) != ""))


@query(f"""WITH {workspace.sql('records')}, {workspace.sql('repos')} SELECT 'source' AS kind, pos::VARCHAR AS id, state = 'conflict' OR (state = 'source_moved' AND previous_mirror <> '') OR (state = 'manual_modification' AND contains(warnings, 'Generated region sentinel is missing')) AS blocked FROM records
UNION ALL SELECT 'repo', repo_id, state = 'conflict' OR (state = 'manual_modification' AND contains(lower(warnings), 'generated sentinel')) FROM repos""")
def force_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = record_frame(spark, sf_dir).select(F.lit("source").alias("kind"), F.col("pos").cast("string").alias("id"), blocks_force(F.col("state"), F.col("warnings"), F.col("previous_mirror")).alias("blocked"))
    repos = split_lists(workspace.frame(spark, sf_dir, "repos"), "warnings")
    return own.unionByName(repos.select(F.lit("repo").alias("kind"), F.col("repo_id").alias("id"), blocks_force(F.col("state"), F.col("warnings"), kind="repo").alias("blocked")))


def frontmatter_drift(pairs: list[tuple[str, Column]]) -> Column:
    """The first managed field that differs from what is expected, compared as trimmed text; null if all agree."""
    return F.coalesce(*[F.when(F.trim(F.coalesce(F.col(found).cast("string"), F.lit(""))) != F.coalesce(expected.cast("string"), F.lit("")), F.lit(found)) for found, expected in pairs])


def note_conflict(kind: Column, found_id: Column, expected_id: Column, has_sentinel: Column) -> Column:
    """Why a note cannot be taken over by a repository's mirror; null if it can."""
    return F.when(~kind.eqNullSafe(F.lit("repo-mirror")), "not-a-mirror").when((found_id != "") & (found_id != expected_id), "other-repo").when(~has_sentinel, "no-sentinel")


def identity_drift(found: Column, allowed: Column) -> Column:
    """Whether a note's repository is missing or not one of the allowed."""
    own = F.trim(F.coalesce(found, F.lit("")))
    return F.when(own == "", "missing").when((F.size(allowed) > 0) & ~F.array_contains(allowed, own), "differs")


@query(f"""WITH {workspace.sql('repos')} SELECT repo_id, CASE WHEN note_type <> 'repo-mirror' THEN 'not-a-mirror' WHEN note_repo_id <> '' AND note_repo_id <> repo_id THEN 'other-repo' WHEN NOT has_sentinel THEN 'no-sentinel' END AS conflict,
CASE WHEN note_repo = '' THEN 'missing' WHEN note_repo <> repo THEN 'differs' END AS identity, CASE WHEN note_repo_id <> repo_id THEN 'note_repo_id' WHEN note_commit <> last_commit THEN 'note_commit' END AS drift, NOT configured AS unconfigured,
CASE WHEN configured AND (NOT managed OR NOT note_exists) THEN 'missing' WHEN configured AND note_repo_id <> repo_id THEN 'id-mismatch' END AS gap FROM repos""")
def repo_note_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflict, identity and drift of repositories' notes, and what the configuration misses."""
    repos = workspace.frame(spark, sf_dir, "repos")
    gap = F.when(F.col("configured"), F.when(~F.col("managed") | ~F.col("note_exists"), "missing").when(F.col("note_repo_id") != F.col("repo_id"), "id-mismatch"))
    return repos.select(
        "repo_id",
        note_conflict(F.col("note_type"), F.col("note_repo_id"), F.col("repo_id"), F.col("has_sentinel")).alias("conflict"),
        identity_drift(F.col("note_repo"), F.array("repo")).alias("identity"),
        frontmatter_drift([("note_repo_id", F.col("repo_id")), ("note_commit", F.col("last_commit"))]).alias("drift"),
        (~F.col("configured")).alias("unconfigured"),
        gap.alias("gap"),
    )


def unconfigured(records: DataFrame, configured: DataFrame, key: str = "repo_id") -> DataFrame:
    """Records whose id no configuration has."""
    return records.join(configured, key, "left_anti")


@query(f"""WITH {workspace.sql('repos')} SELECT repo_id, CASE WHEN state = '' THEN 'unknown' ELSE state END AS manifest_state, CASE WHEN NOT configured THEN 'repo_unconfigured' WHEN state = '' THEN 'unknown' ELSE state END AS state, list_distinct(list_filter([warnings, CASE WHEN NOT configured THEN 'no config entry' ELSE '' END], lambda w: w <> '')) IS NOT NULL AS has_list,
len(list_filter([warnings, CASE WHEN NOT configured THEN 'no config entry' ELSE '' END], lambda w: w <> '')) AS n_warnings FROM repos""")
def effective_repo_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state in effect of each repository by anti-membership in the configuration, marked in the manifest with one more warning."""
    repos = workspace.frame(spark, sf_dir, "repos")
    missing = unconfigured(repos, repos.where("configured").select("repo_id")).select("repo_id", F.lit(True).alias("_missing"))
    rows = effective_repos(repos.drop("configured").join(missing, "repo_id", "left").withColumn("configured", F.col("_missing").isNull()))
    warnings = F.array_distinct(F.filter(F.array("warnings", F.when(~F.col("configured"), "no config entry").otherwise("")), lambda w: w != ""))
    return rows.select("repo_id", "manifest_state", "state", F.lit(True).alias("has_list"), F.size(warnings).cast("long").alias("n_warnings"))


def missing_by_hash(records: DataFrame, files: DataFrame, now: DataFrame) -> DataFrame:
    """For sources (path, size, sha): how many records of that content have a path that is gone, and the first by path."""
    gone = records.join(files.select("path"), "path", "left_anti").where("path <> ''")
    stock = gone.groupBy("size", "sha").agg(F.count(F.lit(1)).alias("n_candidates"), F.min(F.struct("path", "source_id")).alias("_first"))
    return now.join(stock, ["size", "sha"], "left").select(*[now[c] for c in now.columns], F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), F.col("_first.path").alias("candidate"), F.col("_first.source_id").alias("candidate_id"))


def resolved_records(records: DataFrame, files: DataFrame, now: DataFrame) -> DataFrame:
    """The record that stands for each source (path, size, sha): that of its path without open candidates, else its path's ambiguous one, else the single gone record of its content."""
    exact = records.groupBy("path").agg(F.min(F.when(F.size("candidates") == 0, F.struct("pos", "source_id"))).alias("_plain"), F.min(F.when(F.size("candidates") > 0, F.struct("pos", "source_id"))).alias("_ambiguous"))
    found = missing_by_hash(records, files, now).join(exact, "path", "left")
    how = F.when(F.col("_plain").isNotNull(), "path").when(F.col("_ambiguous").isNotNull(), "ambiguous").when(F.col("n_candidates") == 1, "moved")
    who = F.coalesce("_plain.source_id", "_ambiguous.source_id", F.when(F.col("n_candidates") == 1, F.col("candidate_id")))
    return found.select("path", "n_candidates", how.alias("how"), who.alias("source_id"))


NOW_PATH = "CASE doc_id % 21 WHEN 2 THEN 'new/' || doc_id || '.docx' WHEN 3 THEN lang || '/shared' || doc_id || '.docx' ELSE lang || '/' || doc_id || '.docx' END"


@query(f"""WITH {workspace.sql('records')}, now AS (SELECT {NOW_PATH} AS path, n_chars AS size, md5(coalesce(text, '')) AS sha FROM documents), r AS (SELECT *, {LIST_SQL.format('candidates')} AS cs FROM records),
stock AS (SELECT size, sha, count(*) AS n, arg_min(record_id, (path, record_id)) AS cid FROM r WHERE path <> '' AND path NOT IN (SELECT path FROM now) GROUP BY ALL), exact AS (SELECT path, arg_min(record_id, pos) FILTER (len(cs) = 0) AS plain, min(pos) FILTER (len(cs) = 0) AS pp, arg_min(record_id, pos) FILTER (len(cs) > 0) AS amb, min(pos) FILTER (len(cs) > 0) AS ap FROM r GROUP BY path)
SELECT now.path, coalesce(n, 0) AS n_candidates, CASE WHEN pp IS NOT NULL THEN 'path' WHEN ap IS NOT NULL THEN 'ambiguous' WHEN n = 1 THEN 'moved' END AS how, CASE WHEN pp IS NOT NULL THEN plain WHEN ap IS NOT NULL THEN amb WHEN n = 1 THEN cid END AS source_id
FROM now LEFT JOIN stock USING (size, sha) LEFT JOIN exact ON exact.path = now.path""")
def resolved_source_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = table(spark, sf_dir, "documents").selectExpr(f"{NOW_PATH} AS path", "n_chars AS size", "md5(coalesce(text, '')) AS sha")
    return resolved_records(record_frame(spark, sf_dir), now, now)


def active_candidates(records: DataFrame, files: DataFrame) -> DataFrame:
    """Of each record's candidates (paths) those that are records of the same content whose path is still gone: pos, active (sorted)."""
    gone = records.join(files.select("path"), "path", "left_anti").where("path <> ''").select(F.col("path").alias("_c"), F.col("size").alias("_s"), F.col("sha").alias("_h")).distinct()
    spread = records.select("pos", "size", "sha", F.explode("candidates").alias("_c")).where("_c <> ''")
    kept = spread.join(gone, (spread["_c"] == gone["_c"]) & (spread["size"] == gone["_s"]) & (spread["sha"] == gone["_h"])).select("pos", spread["_c"])
    return kept.groupBy("pos").agg(F.array_sort(F.collect_set("_c")).alias("active"))


@query(f"""WITH {workspace.sql('records')}, r AS (SELECT pos, path, size, sha, CASE WHEN pos % 2 = 0 THEN [path, 'nowhere', ''] ELSE [] END AS cs FROM records), g AS (SELECT DISTINCT path, size, sha FROM r WHERE path <> '' AND path NOT IN (SELECT {NOW_PATH} FROM documents)), s AS (SELECT pos, size, sha, unnest(cs) AS c FROM r)
SELECT pos, array_to_string(list_sort(list(DISTINCT c)), ',') AS active FROM s JOIN g ON g.path = c AND g.size = s.size AND g.sha = s.sha WHERE c <> '' GROUP BY pos""")
def active_move_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = record_frame(spark, sf_dir).withColumn("candidates", F.when(F.col("pos") % 2 == 0, F.array(F.col("path"), F.lit("nowhere"), F.lit(""))).otherwise(F.array().cast("array<string>")))
    now = table(spark, sf_dir, "documents").selectExpr(f"{NOW_PATH} AS path")
    return active_candidates(records, now).select("pos", F.array_join("active", ",").alias("active"))


def duplicate_ids(records: DataFrame, most: int = 20) -> DataFrame:
    """Paths that several records without open candidates claim: path, n, and the first ids in order."""
    own = records.where((F.size("candidates") == 0) & (F.col("path") != ""))
    heads = own.groupBy("path", F.pmod(F.xxhash64("pos"), F.lit(64)).alias("_salt")).agg(F.count(F.lit(1)).alias("n"), F.slice(F.array_sort(F.collect_list(F.struct("pos", "source_id"))), 1, most).alias("ids"))
    return heads.groupBy("path").agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, most).alias("ids")).where("n > 1").select("path", "n", F.transform("ids", lambda x: x["source_id"]).alias("ids"))


def shown(values: Column, noun: str, most: int = 5) -> Column:
    """`N noun(s): a, b (+k more)`."""
    rest = F.size(values) - most
    return F.concat(F.size(values).cast("string"), F.lit(f" {noun}(s): "), F.array_join(F.slice(values, 1, most), ", "), F.when(rest > 0, F.concat(F.lit(" (+"), rest.cast("string"), F.lit(" more)"))).otherwise(""))


@query(f"""WITH {workspace.sql('records')}, r AS (SELECT *, list_filter({LIST_SQL.format('candidates')}, lambda c: c <> '') AS cs FROM records) SELECT pos, len(cs) || ' candidate(s): ' || array_to_string(cs[1:5], ', ') || CASE WHEN len(cs) > 5 THEN ' (+' || (len(cs) - 5) || ' more)' ELSE '' END AS summary FROM r WHERE len(cs) > 0""")
def candidate_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = record_frame(spark, sf_dir).withColumn("candidates", texts(F.col("candidates"))).where(F.size("candidates") > 0)
    return rows.select("pos", shown(F.col("candidates"), "candidate").alias("summary"))


@query(f"""WITH {workspace.sql('records')}, g AS (SELECT path, count(*) AS n, list_sort(list((pos, record_id)))[1:20] AS ids FROM records WHERE candidates = '' AND path <> '' GROUP BY path HAVING count(*) > 1) SELECT path, n, array_to_string(list_transform(ids, lambda x: x[2]), ',') AS ids FROM g""")
def duplicate_source_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_ids(record_frame(spark, sf_dir)).select("path", "n", F.array_join("ids", ",").alias("ids"))


def upsert_record(manifest: DataFrame, updates: DataFrame) -> DataFrame:
    """The manifest with updates by source_id; an ambiguous record of an update's path with another id goes."""
    kept = manifest.join(updates.select("source_id"), "source_id", "left_anti")
    twin = updates.where("path <> ''").select("path").distinct()
    plain = kept.where(F.size("candidates") == 0)
    ambiguous = kept.where(F.size("candidates") > 0).join(twin, "path", "left_anti").select(*manifest.columns)
    return plain.unionByName(ambiguous).unionByName(updates.select(*manifest.columns))


@query(f"""WITH {workspace.sql('records')}, m AS (SELECT 'm' || pos AS source_id, path, candidates, 'old' AS state FROM records), u AS (SELECT CASE WHEN size % 3 = 0 THEN 'm' || pos ELSE 'u' || pos END AS source_id, CASE WHEN size % 2 = 0 THEN path ELSE 'other/' || pos END AS path, '' AS candidates, 'new' AS state FROM records)
SELECT source_id, path, state FROM m WHERE source_id NOT IN (SELECT source_id FROM u) AND NOT (candidates <> '' AND path <> '' AND path IN (SELECT path FROM u)) UNION ALL SELECT source_id, path, state FROM u""")
def manifest_upsert_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = record_frame(spark, sf_dir)
    manifest = records.select(F.concat(F.lit("m"), "pos").alias("source_id"), "path", "candidates", F.lit("old").alias("state"))
    ids = F.when(F.col("size") % 3 == 0, F.concat(F.lit("m"), "pos")).otherwise(F.concat(F.lit("u"), "pos"))
    where = F.when(F.col("size") % 2 == 0, F.col("path")).otherwise(F.concat(F.lit("other/"), "pos"))
    updates = records.select(ids.alias("source_id"), where.alias("path"), F.array().cast("array<string>").alias("candidates"), F.lit("new").alias("state"))
    return upsert_record(manifest, updates).select("source_id", "path", "state")


def manifest_totals(records: DataFrame, blanks: bool = False) -> DataFrame:
    """Records, missing ids, warnings, errors, bytes; readers differ in whether blank entries count."""
    missing = F.count_if(F.trim(F.coalesce("source_id", F.lit(""))) == "")
    of = lambda c: F.coalesce(F.sum(list_items(F.col(c), blanks)), F.lit(0)).alias(c)
    return records.agg(F.count(F.lit(1)).alias("records"), missing.alias("missing_ids"), of("warnings"), of("errors"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"))


@query(f"""WITH {workspace.sql('records')}, r AS (SELECT record_id, size, {LIST_SQL.format('warnings')} AS w, {LIST_SQL.format('errors')} AS e FROM records) SELECT b.blanks, count(*) AS records, count(*) FILTER (record_id = '') AS missing_ids, sum(CASE WHEN b.blanks THEN len(w) ELSE len(list_filter(w, lambda x: trim(x) <> '')) END)::BIGINT AS warnings,
sum(CASE WHEN b.blanks THEN len(e) ELSE len(list_filter(e, lambda x: trim(x) <> '')) END)::BIGINT AS errors, sum(size)::BIGINT AS total_bytes FROM r, (VALUES (true), (false)) b(blanks) GROUP BY 1""")
def manifest_totals_by_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = record_frame(spark, sf_dir)
    return manifest_totals(records, True).withColumn("blanks", F.lit(True)).unionByName(manifest_totals(records, False).withColumn("blanks", F.lit(False)))


def provenance(records: DataFrame) -> DataFrame:
    """Records by lifecycle contract and its version; unsafe or missing contracts are not recorded, blank versions unknown."""
    contract = paths.safe_relative(F.coalesce("contract", F.lit("")))
    version = F.trim(F.coalesce("contract_version", F.lit("")))
    return records.groupBy(F.when(contract == "", "(not recorded)").otherwise(contract).alias("contract"), F.when(version == "", "unknown").otherwise(version).alias("version")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {workspace.sql('records')} SELECT CASE WHEN contract = '' OR starts_with(contract, '/') THEN '(not recorded)' ELSE contract END AS contract, CASE WHEN trim(contract_version) = '' THEN 'unknown' ELSE trim(contract_version) END AS version, count(*) AS n FROM records GROUP BY ALL""")
def lifecycle_contract_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance(record_frame(spark, sf_dir))


def state_review_total(states: DataFrame) -> DataFrame:
    """How many records of a state count (value, n) need a review."""
    return states.agg(F.coalesce(F.sum(F.when(F.col("value").isin(REVIEW_STATES), F.col("n"))), F.lit(0)).alias("to_review"))


@query(f"""WITH {workspace.sql('records')} SELECT count(*) FILTER (state IN ({', '.join(f"'{s}'" for s in REVIEW_STATES)})) AS to_review FROM records""")
def records_to_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = group_counts(record_frame(spark, sf_dir), "state")
    return state_review_total(counts)


def catalog_items(records: DataFrame, routing: DataFrame) -> DataFrame:
    """Records as the catalog lists them, by domain, source and mirror."""
    from foliant.operators.files import routed

    own = routed(records.withColumn("source", paths.safe_relative(F.coalesce("path", F.lit("")))), routing, "source")
    kind = F.coalesce(F.nullif(F.col("format"), F.lit("")), F.substring(paths.suffix(F.col("source")), 2, 99))
    return own.select(
        F.coalesce("_domain", F.lit("unclassified")).alias("domain"), "source", paths.safe_relative(F.coalesce("mirror", F.lit(""))).alias("mirror"), kind.alias("format"), label(F.col("state")).alias("state"), F.size("warnings").cast("long").alias("warnings"), F.size("errors").cast("long").alias("errors"), "source_id"
    ).orderBy("domain", "source", "mirror")


@query(f"""WITH {workspace.sql('records')}, routing(alias, rd, rf) AS (VALUES ('en', 'english', 'en'), ('de', 'german', 'de')), r AS (SELECT *, CASE WHEN starts_with(path, '../') THEN '' ELSE path END AS source FROM records)
SELECT coalesce(rd, 'unclassified') AS domain, source, mirror, CASE WHEN format = '' THEN CASE WHEN source = '' THEN '' ELSE 'docx' END ELSE format END AS format, CASE WHEN state = '' THEN 'unknown' ELSE state END AS state, len({LIST_SQL.format('warnings')}) AS warnings, len({LIST_SQL.format('errors')}) AS errors, record_id AS source_id
FROM r LEFT JOIN routing ON alias = string_split(source, '/')[1]""")
def catalog_source_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    routing = spark.createDataFrame([("en", "english", "en"), ("de", "german", "de")], "alias string, domain string, folder string")
    return catalog_items(record_frame(spark, sf_dir), routing)


#: What a quality review may say.
REVIEW_STATUSES = ["not-reviewed", "passed", "failed", "needs-work"]


def review_errors(reviews: DataFrame, records: DataFrame) -> DataFrame:
    """Errors of quality reviews (n, source_id, status, score, corrections) against the manifest: n and error, one row for each."""
    firsts = reviews.where("source_id <> ''").groupBy("source_id").agg(F.min("n").alias("_first"))
    known = records.where("source_id <> ''").select("source_id", F.lit(True).alias("_known")).distinct()
    joined = reviews.join(firsts, "source_id", "left").join(known, "source_id", "left")
    idle = F.col("status") == "not-reviewed"
    found = F.array(
        F.when(F.col("source_id") == "", "source_id required").when(F.col("n") != F.col("_first"), "duplicate source_id").when(F.col("_known").isNull(), "source_id unknown"),
        F.when(~F.col("status").isin(REVIEW_STATUSES), "status invalid"),
        F.when(idle & F.col("score").isNotNull(), "score must be null").when(~idle & ~F.coalesce(F.col("score").isin(0, 1, 2), F.lit(False)), "score must be 0, 1 or 2"),
        F.when(idle & F.col("corrections").isNotNull(), "corrections must be null").when(~idle & ~F.coalesce(F.col("corrections") >= 0, F.lit(False)), "corrections must not be negative"),
    )
    return joined.select("n", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("error"))


REVIEW_COLUMNS = {"n": "doc_id", "source_id": "CASE doc_id % 37 WHEN 0 THEN '' WHEN 1 THEN 'src_' || (doc_id + 1) WHEN 2 THEN 'nobody' ELSE 'src_' || doc_id END", "status": "CASE WHEN toxic = 1 THEN 'failed' WHEN quality = 1 THEN 'passed' WHEN doc_id % 7 = 0 THEN 'odd' ELSE 'not-reviewed' END", "score": "CASE WHEN toxic = 1 THEN 0 WHEN quality = 1 THEN 2 WHEN doc_id % 5 = 0 THEN 9 END", "corrections": "CASE WHEN quality = 1 THEN doc_id % 4 - 1 WHEN toxic = 1 THEN 3 END"}
REVIEWS_SQL = "reviews AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in REVIEW_COLUMNS.items()) + " FROM labels)"


def review_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").selectExpr(*[f"{e} AS {c}" for c, e in REVIEW_COLUMNS.items()])


@query(f"""WITH {workspace.sql('records')}, {REVIEWS_SQL}, j AS (SELECT *, min(n) OVER (PARTITION BY source_id) AS first, source_id IN (SELECT record_id FROM records) AS known FROM reviews), e AS (SELECT n, unnest([
CASE WHEN source_id = '' THEN 'source_id required' WHEN n <> first THEN 'duplicate source_id' WHEN NOT known THEN 'source_id unknown' END, CASE WHEN status NOT IN ('not-reviewed', 'passed', 'failed', 'needs-work') THEN 'status invalid' END,
CASE WHEN status = 'not-reviewed' THEN CASE WHEN score IS NOT NULL THEN 'score must be null' END WHEN coalesce(score NOT IN (0, 1, 2), true) THEN 'score must be 0, 1 or 2' END,
CASE WHEN status = 'not-reviewed' THEN CASE WHEN corrections IS NOT NULL THEN 'corrections must be null' END WHEN coalesce(corrections < 0, true) THEN 'corrections must not be negative' END]) AS error FROM j) SELECT n, error FROM e WHERE error IS NOT NULL""")
def quality_review_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review_errors(review_frame(spark, sf_dir), record_frame(spark, sf_dir))


@query(f"""WITH {workspace.sql('records')}, {REVIEWS_SQL} SELECT count(*) AS records, count(*) FILTER (status <> 'not-reviewed' AND status <> '') AS reviewed, (SELECT count(DISTINCT record_id) FROM records WHERE record_id <> '' AND record_id NOT IN (SELECT source_id FROM reviews)) AS missing_reviews,
round(avg(score) FILTER (status <> 'not-reviewed' AND score IN (0, 1, 2)), 2) AS average_score, coalesce(sum(corrections) FILTER (status <> 'not-reviewed' AND corrections >= 0), 0)::BIGINT AS corrections FROM reviews""")
def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.operators.inventory import side_by_side

    reviews, records = review_frame(spark, sf_dir), record_frame(spark, sf_dir)
    missing = records.where("source_id <> ''").select("source_id").distinct().join(reviews, "source_id", "left_anti").agg(F.count(F.lit(1)).alias("missing_reviews"))
    active = F.col("status") != "not-reviewed"
    own = reviews.agg(F.count(F.lit(1)).alias("records"), F.count_if(active & (F.col("status") != "")).alias("reviewed"), F.round(F.avg(F.when(active & F.col("score").isin(0, 1, 2), F.col("score"))), 2).alias("average_score"), F.coalesce(F.sum(F.when(active & (F.col("corrections") >= 0), F.col("corrections"))), F.lit(0)).alias("corrections"))
    return side_by_side(own, missing)


@query(f"""WITH {workspace.sql('records')}, {REVIEWS_SQL} SELECT DISTINCT record_id AS source_id, 'not-reviewed' AS status FROM records WHERE record_id <> '' AND record_id NOT IN (SELECT source_id FROM reviews)""")
def missing_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids without a review, as rows of a new review pack."""
    ids = record_frame(spark, sf_dir).where("source_id <> ''").select("source_id")
    return ids.subtract(review_frame(spark, sf_dir).select("source_id")).withColumn("status", F.lit("not-reviewed"))
