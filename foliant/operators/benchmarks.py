"""Task and result packs of an agent benchmark: checks, citations, summaries by mode, completeness, scaffolds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import paths
from foliant.registry import query, table

#: The modes that are compared, and the families a pack must cover.
MODES = ["raw_source_folder", "document_chat_transcript", "workspace_markdown"]
FAMILIES = ["answer", "reconcile", "update", "audit", "consolidate"]

#: Tasks, a citation for each of their paths, and results, made of the test tables.
TASK_COLUMNS = {"task_id": "CASE WHEN item_id % 17 = 0 THEN '' ELSE 't' || item_id END", "n": "item_id", "family": "CASE item_id % 7 WHEN 0 THEN 'answer' WHEN 1 THEN 'reconcile' WHEN 2 THEN 'update' WHEN 3 THEN 'audit' WHEN 4 THEN 'odd' ELSE 'answer' END", "prompt": "CASE WHEN item_id % 11 = 0 THEN ' ' ELSE 'p' || length(text) END", "criteria": "item_id % 5", "source_path": "CASE item_id % 6 WHEN 0 THEN '../up' WHEN 1 THEN '_mirrors/a.md' ELSE 'src/' || item_id END", "curated_path": "CASE item_id % 4 WHEN 0 THEN 'notes/x.txt' ELSE 'notes/' || item_id || '.md' END", "generated_path": "CASE item_id % 3 WHEN 0 THEN 'notes/y.md' ELSE '_mirrors/' || item_id || '.md' END", "path_there": "item_id % 8 <> 0"}
RESULT_COLUMNS = {
    "n": "conv_id * 100 + turn",
    "task_id": "CASE WHEN turn % 13 = 12 THEN '' ELSE 't' || (conv_id % 45) END",
    "mode": "CASE turn % 4 WHEN 0 THEN 'raw_source_folder' WHEN 1 THEN 'document_chat_transcript' WHEN 2 THEN 'workspace_markdown' ELSE 'odd' END",
    "score": "CASE length(text) % 5 WHEN 4 THEN NULL ELSE length(text) % 5 END",
    "corrections": "length(text) % 4 - 1",
    "cited_source": "CASE WHEN length(text) % 3 = 0 THEN 'src/' || (conv_id % 45) ELSE '' END",
    "cited_generated": "CASE length(text) % 5 WHEN 0 THEN '_mirrors/' || (conv_id % 45) || '.md' WHEN 1 THEN 'notes/q.md' ELSE '' END",
    "violation": "length(text) % 19 = 0",
    "reviewed": "CASE length(text) % 6 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END",
    "unsafe": "CASE length(text) % 7 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END",
    "elapsed": "CASE WHEN length(text) % 2 = 0 THEN length(text) / 8.0 END",
}


def _frame(spark: SparkSession, sf_dir: str, name: str, columns: dict[str, str]) -> DataFrame:
    return table(spark, sf_dir, name).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def _sql(name: str, source: str, columns: dict[str, str]) -> str:
    return f"{name} AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + f" FROM {source})"


TASKS_SQL, RESULTS_SQL = _sql("tasks", "benchmark", TASK_COLUMNS), _sql("results", "conversations", RESULT_COLUMNS)


def path_error(path: Column, there: Column, kind: str, mirror_root: str = "_mirrors") -> Column:
    """The first thing wrong with a task's path of a kind (source, curated, generated); null if nothing."""
    unsafe = path.startswith("/") | F.exists(F.split(path, "/"), lambda p: p == "..") | (F.trim(path) == "")
    inside = paths.under(path, F.lit(mirror_root))
    place = {"source": F.when(inside, "inside the mirrors"), "generated": F.when(~inside, "outside the mirrors"), "curated": F.when(~path.endswith(".md"), "no markdown")}[kind]
    return F.coalesce(F.when(unsafe, "invalid"), place, F.when(~there, "missing"))


def task_errors(tasks: DataFrame) -> DataFrame:
    """Errors of tasks, a row for each: n, error."""
    firsts = tasks.where("task_id <> ''").groupBy("task_id").agg(F.min("n").alias("_first"))
    rows = tasks.join(firsts, "task_id", "left")
    found = [
        F.when(F.col("task_id") == "", "id required").when(F.col("n") != F.col("_first"), "duplicate id"),
        F.when(~F.col("family").isin(FAMILIES), "invalid family"),
        F.when(F.trim("prompt") == "", "prompt required"),
        F.when(F.col("criteria") == 0, "criteria required"),
        *[F.concat(F.lit(f"{kind}: "), path_error(F.col(f"{kind}_path"), F.col("path_there"), kind)) for kind in ("source", "curated", "generated")],
    ]
    return rows.select("n", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("error"))


def _path_error_sql(kind: str) -> str:
    p = f"{kind}_path"
    place = {"source": f"WHEN starts_with({p}, '_mirrors/') THEN 'inside the mirrors'", "generated": f"WHEN NOT starts_with({p}, '_mirrors/') THEN 'outside the mirrors'", "curated": f"WHEN NOT ends_with({p}, '.md') THEN 'no markdown'"}[kind]
    return f"'{kind}: ' || CASE WHEN list_contains(string_split({p}, '/'), '..') THEN 'invalid' {place} WHEN NOT path_there THEN 'missing' END"


@query(f"""WITH {TASKS_SQL}, t AS (SELECT *, min(n) OVER (PARTITION BY task_id) AS first FROM tasks), e AS (SELECT n, unnest([CASE WHEN task_id = '' THEN 'id required' WHEN n <> first THEN 'duplicate id' END, CASE WHEN family NOT IN ('answer', 'reconcile', 'update', 'audit', 'consolidate') THEN 'invalid family' END,
CASE WHEN trim(prompt) = '' THEN 'prompt required' END, CASE WHEN criteria = 0 THEN 'criteria required' END, {_path_error_sql('source')}, {_path_error_sql('curated')}, {_path_error_sql('generated')}]) AS error FROM t) SELECT n, error FROM e WHERE error IS NOT NULL""")
def task_pack_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return task_errors(_frame(spark, sf_dir, "benchmark", TASK_COLUMNS))


@query(f"""WITH {TASKS_SQL} SELECT count(*) AS tasks, array_to_string(list_sort(list(DISTINCT family) FILTER (family IN ('answer', 'reconcile', 'update', 'audit', 'consolidate'))), ',') AS families,
array_to_string(list_filter(['answer', 'reconcile', 'update', 'audit', 'consolidate'], lambda f: NOT list_contains(list(DISTINCT family), f)), ',') AS missing, count(*) FILTER (source_path NOT LIKE '../%') AS source_paths, count(curated_path) AS curated_paths, count(generated_path) AS generated_paths FROM tasks""")
def task_pack_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a pack, the families it has and those it lacks."""
    tasks = _frame(spark, sf_dir, "benchmark", TASK_COLUMNS)
    safe = lambda c: F.count_if(paths.safe_relative(F.col(c)) != "").alias(f"{c}s")
    seen = tasks.agg(F.count(F.lit(1)).alias("tasks"), F.collect_set(F.when(F.col("family").isin(FAMILIES), F.col("family"))).alias("seen"), safe("source_path"), safe("curated_path"), safe("generated_path"))
    return seen.select("tasks", F.array_join(F.array_sort("seen"), ",").alias("families"), F.array_join(F.array_except(F.array(*map(F.lit, FAMILIES)), "seen"), ",").alias("missing"), "source_paths", "curated_paths", "generated_paths")


def citations(results: DataFrame, tasks: DataFrame) -> DataFrame:
    """Each cited path of results (n, task_id, field, path) with its first error against where it lies and what its task declares; null if it is valid."""
    declared = tasks.where("task_id <> ''").select("task_id", F.explode(F.array(F.struct(F.lit("source").alias("field"), F.col("source_path").alias("path")), F.struct(F.lit("generated").alias("field"), F.col("generated_path").alias("path")))).alias("d")).select("task_id", "d.*", F.lit(True).alias("_declared")).distinct()
    cited = results.select("n", "task_id", F.explode(F.array(F.struct(F.lit("source").alias("field"), F.col("cited_source").alias("path")), F.struct(F.lit("generated").alias("field"), F.col("cited_generated").alias("path")))).alias("c")).select("n", "task_id", "c.*").where("path <> ''")
    inside = paths.under(F.col("path"), F.lit("_mirrors"))
    placed = F.when(paths.safe_relative(F.col("path")) == "", "invalid").when((F.col("field") == "source") & inside, "inside the mirrors").when((F.col("field") == "generated") & ~inside, "outside the mirrors")
    known = cited.join(declared, ["task_id", "field", "path"], "left")
    return known.select("n", "task_id", "field", "path", F.coalesce(placed, F.when(F.col("_declared").isNull(), "not declared")).alias("error"))


CITED_SQL = f"""{TASKS_SQL}, {RESULTS_SQL}, dec AS (SELECT task_id, 'source' AS field, source_path AS path FROM tasks WHERE task_id <> '' UNION SELECT task_id, 'generated', generated_path FROM tasks WHERE task_id <> ''),
cit AS (SELECT n, task_id, 'source' AS field, cited_source AS path FROM results WHERE cited_source <> '' UNION ALL SELECT n, task_id, 'generated', cited_generated FROM results WHERE cited_generated <> ''),
cited AS (SELECT c.*, CASE WHEN field = 'source' AND starts_with(path, '_mirrors/') THEN 'inside the mirrors' WHEN field = 'generated' AND NOT starts_with(path, '_mirrors/') THEN 'outside the mirrors' WHEN NOT EXISTS (SELECT 1 FROM dec d WHERE d.task_id = c.task_id AND d.field = c.field AND d.path = c.path) THEN 'not declared' END AS error FROM cit c)"""


@query(f"WITH {CITED_SQL} SELECT n, field, path, error FROM cited")
def citation_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations(_frame(spark, sf_dir, "conversations", RESULT_COLUMNS), _frame(spark, sf_dir, "benchmark", TASK_COLUMNS)).select("n", "field", "path", "error")


def mode_results(results: DataFrame, cited: DataFrame) -> DataFrame:
    """The measures of each mode, all modes present."""
    valid = cited.where("error is null").groupBy("n").agg(F.count_if(F.col("field") == "source").alias("_s"), F.count_if(F.col("field") == "generated").alias("_g"))
    rows = results.join(valid, "n", "left").na.fill(0, ["_s", "_g"])
    score = F.when(F.col("score").isin(0, 1, 2), F.col("score")).otherwise(0)
    missing = F.col("reviewed").isNull() | ~F.coalesce("reviewed", F.lit(False)) | F.col("unsafe").isNull()
    yes = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    measures = [
        F.count(F.lit(1)).alias("results"), F.sum(score).alias("score"), (2 * F.count(F.lit(1))).alias("max_score"), F.sum(F.greatest(F.col("corrections"), F.lit(0))).alias("corrections"), yes(F.col("violation")).alias("violations"),
        F.count("elapsed").alias("timed_results"), F.round(F.sum("elapsed"), 2).cast("double").alias("elapsed_seconds"), F.sum("_s").alias("source_citations"), F.sum("_g").alias("generated_citations"),
        yes((score > 0) & (F.col("_s") + F.col("_g") == 0)).alias("uncited_scored"), yes(F.col("reviewed")).alias("safety_reviewed"), yes(F.col("unsafe")).alias("safety_violations"), F.count_if(missing).alias("missing_safety_reviews"), F.round(F.avg(score), 2).alias("average_score"),
    ]
    modes = results.sparkSession.createDataFrame([(m,) for m in MODES], "mode string")
    return modes.join(rows.groupBy("mode").agg(*measures), "mode", "left").na.fill(0)


MODE_SQL = f"""WITH {CITED_SQL}, v AS (SELECT n, count(*) FILTER (field = 'source') AS s, count(*) FILTER (field = 'generated') AS g FROM cited WHERE error IS NULL GROUP BY n), r AS (SELECT results.*, coalesce(s, 0) AS s, coalesce(g, 0) AS g, CASE WHEN score IN (0, 1, 2) THEN score ELSE 0 END AS sc FROM results LEFT JOIN v USING (n)),
modes AS (SELECT m.mode AS mode, count(r.n) AS results, coalesce(sum(sc), 0)::BIGINT AS score, 2 * count(r.n) AS max_score, coalesce(sum(greatest(corrections, 0)), 0)::BIGINT AS corrections, count(*) FILTER (violation) AS violations, count(elapsed) AS timed_results, coalesce(round(sum(elapsed), 2), 0)::DOUBLE AS elapsed_seconds,
coalesce(sum(s), 0)::BIGINT AS source_citations, coalesce(sum(g), 0)::BIGINT AS generated_citations, count(*) FILTER (sc > 0 AND s + g = 0) AS uncited_scored, count(*) FILTER (reviewed) AS safety_reviewed, count(*) FILTER (unsafe) AS safety_violations,
count(*) FILTER (r.n IS NOT NULL AND (reviewed IS NULL OR NOT reviewed OR unsafe IS NULL)) AS missing_safety_reviews, coalesce(round(avg(sc), 2), 0) AS average_score FROM (VALUES ('raw_source_folder'), ('document_chat_transcript'), ('workspace_markdown')) m(mode) LEFT JOIN r ON r.mode = m.mode GROUP BY m.mode)"""


@query(MODE_SQL + " SELECT * FROM modes")
def mode_result_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = _frame(spark, sf_dir, "conversations", RESULT_COLUMNS)
    return mode_results(results, citations(results, _frame(spark, sf_dir, "benchmark", TASK_COLUMNS)))


@query(MODE_SQL + " SELECT sum(safety_reviewed)::BIGINT AS safety_reviewed, sum(safety_violations)::BIGINT AS safety_violations, sum(missing_safety_reviews)::BIGINT AS missing_safety_reviews FROM modes")
def prompt_safety_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = _frame(spark, sf_dir, "conversations", RESULT_COLUMNS)
    modes = mode_results(results, citations(results, _frame(spark, sf_dir, "benchmark", TASK_COLUMNS)))
    return modes.agg(*[F.sum(c).alias(c) for c in ("safety_reviewed", "safety_violations", "missing_safety_reviews")])


def missing_results(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """Pairs of task and mode without a result: the modes each task has, taken from the fixed list."""
    seen = results.where(F.col("mode").isin(MODES)).groupBy("task_id").agg(F.collect_set("mode").alias("seen"))
    own = tasks.where("task_id <> ''").select("task_id").distinct().join(seen, "task_id", "left")
    return own.select("task_id", F.explode(F.array_except(F.array(*map(F.lit, MODES)), F.coalesce("seen", F.array().cast("array<string>")))).alias("mode"))


def result_scaffold(tasks: DataFrame) -> DataFrame:
    """A row with null measures for each task and mode, in the tasks' order."""
    own = tasks.where("task_id <> ''").select("n", "task_id", F.posexplode(F.array(*map(F.lit, MODES))).alias("k", "mode"))
    return own.orderBy("n", "k").select("task_id", "mode", F.lit(None).cast("int").alias("score"), F.lit(None).cast("int").alias("corrections"))


@query(f"WITH {TASKS_SQL}, {RESULTS_SQL}, m(mode) AS (VALUES ('raw_source_folder'), ('document_chat_transcript'), ('workspace_markdown')) SELECT DISTINCT task_id, mode FROM tasks, m WHERE task_id <> '' AND (task_id, mode) NOT IN (SELECT (task_id, mode) FROM results)")
def missing_result_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing_results(_frame(spark, sf_dir, "benchmark", TASK_COLUMNS), _frame(spark, sf_dir, "conversations", RESULT_COLUMNS))


@query(f"WITH {TASKS_SQL} SELECT task_id, mode, NULL::INT AS score, NULL::INT AS corrections FROM tasks, (VALUES ('raw_source_folder'), ('document_chat_transcript'), ('workspace_markdown')) m(mode) WHERE task_id <> ''")
def result_scaffold_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result_scaffold(_frame(spark, sf_dir, "benchmark", TASK_COLUMNS))


def result_errors(results: DataFrame, tasks: DataFrame) -> DataFrame:
    """Errors of results, a row for each: n, error."""
    known = tasks.where("task_id <> ''").select("task_id", F.lit(True).alias("_known")).distinct()
    firsts = results.groupBy("task_id", "mode").agg(F.min("n").alias("_first"))
    rows = results.join(known, "task_id", "left").join(firsts, ["task_id", "mode"], "left")
    named = F.col("mode").isin(MODES)
    found = [
        F.when(F.col("task_id") == "", "task_id required").when(F.col("_known").isNull(), "unknown task_id"),
        F.when(~named, "invalid mode").when((F.col("task_id") != "") & (F.col("n") != F.col("_first")), "duplicate result"),
        F.when(~F.coalesce(F.col("score").isin(0, 1, 2), F.lit(False)), "score must be 0, 1 or 2"),
        F.when(F.col("corrections") < 0, "corrections must not be negative"),
        F.when(F.coalesce(F.col("elapsed") < 0, F.lit(False)), "elapsed must not be negative"),
    ]
    return rows.select("n", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("error"))


@query(f"""WITH {TASKS_SQL}, {RESULTS_SQL}, r AS (SELECT *, min(n) OVER (PARTITION BY task_id, mode) AS first FROM results), e AS (SELECT n, unnest([CASE WHEN task_id = '' THEN 'task_id required' WHEN task_id NOT IN (SELECT task_id FROM tasks) THEN 'unknown task_id' END,
CASE WHEN mode = 'odd' THEN 'invalid mode' WHEN task_id <> '' AND n <> first THEN 'duplicate result' END, CASE WHEN score IS NULL OR score NOT IN (0, 1, 2) THEN 'score must be 0, 1 or 2' END, CASE WHEN corrections < 0 THEN 'corrections must not be negative' END]) AS error FROM r) SELECT n, error FROM e WHERE error IS NOT NULL""")
def result_pack_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result_errors(_frame(spark, sf_dir, "conversations", RESULT_COLUMNS), _frame(spark, sf_dir, "benchmark", TASK_COLUMNS))


def task_scaffold(pairs: DataFrame, curated: DataFrame, most: int) -> DataFrame:
    """Rows of a new task pack from the first sources (path, clean) and curated notes (path): clean and then path decide, notes by depth."""
    order = [F.when(F.col("clean"), 0).otherwise(1), F.col("path")]
    sources = pairs.dropDuplicates(["path"]).orderBy(*order).limit(most).select(F.lit("source").alias("kind"), "path")
    notes = curated.where(~paths.excluded(F.col("path"), "curated") & F.col("path").endswith(".md")).select("path").distinct()
    notes = notes.orderBy(F.size(F.split("path", "/")), F.lower("path"), "path").limit(most)
    return sources.unionByName(notes.select(F.lit("curated").alias("kind"), "path"))


@query("""WITH s AS (SELECT DISTINCT lang || '/' || source AS path, lang = 'en' AS clean FROM documents), c AS (SELECT DISTINCT CASE doc_id % 3 WHEN 0 THEN '_meta/' ELSE '' END || lang || '/' || source || CASE doc_id % 4 WHEN 0 THEN '/deep' ELSE '' END || '.md' AS path FROM documents)
SELECT 'source' AS kind, path FROM (SELECT path FROM s ORDER BY NOT clean, path LIMIT 7) UNION ALL SELECT 'curated', path FROM (SELECT path FROM c WHERE NOT starts_with(path, '_meta/') ORDER BY len(string_split(path, '/')), lower(path), path LIMIT 7)""")
def task_scaffold_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    curated = docs.selectExpr("CASE doc_id % 3 WHEN 0 THEN '_meta/' ELSE '' END || lang || '/' || source || CASE doc_id % 4 WHEN 0 THEN '/deep' ELSE '' END || '.md' AS path")
    return task_scaffold(docs.selectExpr("lang || '/' || source AS path", "lang = 'en' AS clean"), curated, 7)
