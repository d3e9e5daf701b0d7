"""Report plans: several operators over one scan, rendered at the driver from small frames; declarative views."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant import registry, workspace
from foliant.operators.inventory import group_counts, side_by_side
from foliant.registry import query, table


PAGE_ROWS = 10_000


def shown(df: DataFrame, most: int) -> tuple[list, int]:
    """The first rows of a section and how many more there are."""
    rows = df.limit(most if 0 < most < PAGE_ROWS else PAGE_ROWS).collect()
    return rows, df.count() - len(rows)


def render_markdown(title: str, sections: dict[str, DataFrame], most: int = 40) -> str:
    """A report with the first rows of each section and the number of those not shown; `most` <= 0 shows as many as a page holds."""
    lines = [f"# {title}"]
    for name, df in sections.items():
        rows, hidden = shown(df, most)
        lines += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        lines += ["| " + " | ".join(str("" if v is None else v).replace("|", "\\|") for v in r) + " |" for r in rows]
        lines += [f"({hidden} more)"] if hidden else []
    return "\n".join(lines) + "\n"


def render_html(title: str, sections: dict[str, DataFrame], most: int = 40) -> str:
    """The same as one HTML page; a section of names and counts (`n` last) has bars."""
    out = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>"]
    for name, df in sections.items():
        rows, hidden = shown(df, most)
        if df.columns[-1] == "n" and rows:
            top = max(r["n"] for r in rows) or 1
            bars = "".join(f"<li><b style='display:inline-block;background:#48c;height:1em;width:{100 * r['n'] // top}px'></b> {escape(str(r[0]))} {r['n']}</li>" for r in rows)
            out.append(f"<h2>{escape(name)}</h2><ul>{bars}</ul>" + (f"<p>{hidden} more</p>" if hidden else ""))
            continue
        head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{escape(str('' if v is None else v))}</td>" for v in r) + "</tr>" for r in rows)
        out.append(f"<h2>{escape(name)}</h2><table><tr>{head}</tr>{body}</table>" + (f"<p>{hidden} more</p>" if hidden else ""))
    return "".join(out) + "</body></html>"


@query("""SELECT 'lang' AS name, lang AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'size', CASE WHEN n_chars > 5000 THEN 'large' ELSE 'small' END, count(*) FROM documents GROUP BY 2
UNION ALL SELECT 'label', CASE WHEN l.doc_id IS NULL THEN 'none' WHEN toxic = 1 THEN 'toxic' ELSE 'fine' END, count(*) FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 2""")
def catalog_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All counters of the catalog in one scan and one shuffle."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.when(F.col("n_chars") > 5000, "large").otherwise("small").alias("size"))
    joined = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return group_counts(joined.withColumn("label", F.when(F.col("toxic").isNull(), "none").when(F.col("toxic") == 1, "toxic").otherwise("fine")), "lang", "size", "label")


@query("""SELECT count(*) AS n_sources, count(*) FILTER (o_orderstatus = 'F') AS n_clean, count(*) FILTER (o_orderstatus <> 'F') AS n_open, count(DISTINCT o_custkey) AS n_owners, (SELECT count(*) FROM events WHERE event_type = 'error') AS n_errors FROM orders""")
def pilot_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = table(spark, sf_dir, "events").agg(F.count_if(F.col("event_type") == "error").alias("n_errors"))
    clean = F.col("o_orderstatus") == "F"
    own = table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("n_sources"), F.count_if(clean).alias("n_clean"), F.count_if(~clean).alias("n_open"), F.count_distinct("o_custkey").alias("n_owners"))
    return side_by_side(own, errors)


@query("""WITH items AS (SELECT 'office' AS kind, o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'clean' ELSE o_orderstatus END AS state FROM orders UNION ALL SELECT 'repo', s_suppkey, CASE WHEN s_acctbal < 0 THEN 'unconfigured' ELSE 'clean' END FROM supplier),
last AS (SELECT user_id AS id, arg_max(event_type, (ts, event_id)) AS last_event FROM events GROUP BY 1) SELECT kind, state, coalesce(last_event, 'none') AS last_event, count(*) AS n FROM items LEFT JOIN last USING (id) GROUP BY ALL""")
def recovery_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of two manifests by state, with the latest audit event of their id."""
    office = table(spark, sf_dir, "orders").select(F.lit("office").alias("kind"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "clean").otherwise(F.col("o_orderstatus")).alias("state"))
    repo = table(spark, sf_dir, "supplier").select(F.lit("repo").alias("kind"), F.col("s_suppkey").alias("id"), F.when(F.col("s_acctbal") < 0, "unconfigured").otherwise("clean").alias("state"))
    last = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_event"))
    joined = office.unionByName(repo).join(last, "id", "left")
    return joined.groupBy("kind", "state", F.coalesce("last_event", F.lit("none")).alias("last_event")).agg(F.count(F.lit(1)).alias("n"))


def review_rollup(events: DataFrame, artefacts: DataFrame) -> DataFrame:
    """Counts of the latest review (n, artifact_path, artifact_kind, status, reviewer, artifact_sha) of each artefact (path, sha) by status, kind, reviewer and current state."""
    whole = F.struct(*events.columns)
    latest = events.where("artifact_path <> ''").groupBy("artifact_path").agg(F.max_by(whole, "n").alias("e")).select("e.*")
    joined = latest.join(artefacts.select(F.col("path").alias("artifact_path"), F.col("sha").alias("_sha")), "artifact_path", "left")
    unsafe = F.col("artifact_path").startswith("/") | F.exists(F.split("artifact_path", "/"), lambda p: p == "..")
    state = F.when(unsafe, "invalid").when(F.col("_sha").isNull(), "missing").when(F.col("_sha") != F.col("artifact_sha"), "stale").otherwise("current")
    return group_counts(joined.withColumn("state", state), "status", "artifact_kind", "reviewer", "state")


REVIEW_EVENTS = {"n": "event_id", "artifact_path": "CASE event_id % 13 WHEN 0 THEN '' WHEN 1 THEN '../x' ELSE 'c/' || user_id END", "artifact_kind": "CASE user_id % 3 WHEN 0 THEN 'catalog' WHEN 1 THEN '' ELSE 'report' END", "status": "event_type", "reviewer": "'r' || (event_id % 4)", "artifact_sha": "CASE event_id % 2 WHEN 0 THEN md5('c' || user_id) ELSE 'old' END"}


@query("WITH e AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in REVIEW_EVENTS.items()) + """ FROM events), l AS (SELECT * FROM e WHERE artifact_path <> '' QUALIFY row_number() OVER (PARTITION BY artifact_path ORDER BY n DESC) = 1), a AS (SELECT 'c/' || c_custkey AS path, md5('c' || c_custkey) AS sha FROM customer),
s AS (SELECT l.*, CASE WHEN artifact_path LIKE '../%' THEN 'invalid' WHEN sha IS NULL THEN 'missing' WHEN sha <> artifact_sha THEN 'stale' ELSE 'current' END AS state FROM l LEFT JOIN a ON path = artifact_path)
SELECT 'status' AS name, status AS value, count(*) AS n FROM s GROUP BY 2 UNION ALL SELECT 'artifact_kind', CASE WHEN artifact_kind = '' THEN 'unknown' ELSE artifact_kind END, count(*) FROM s GROUP BY 2 UNION ALL SELECT 'reviewer', reviewer, count(*) FROM s GROUP BY 2 UNION ALL SELECT 'state', state, count(*) FROM s GROUP BY 2""")
def review_rollup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").selectExpr(*[f"{e} AS {c}" for c, e in REVIEW_EVENTS.items()])
    artefacts = table(spark, sf_dir, "customer").selectExpr("'c/' || c_custkey AS path", "md5('c' || c_custkey) AS sha")
    return review_rollup(events, artefacts)


def readiness(inventory: DataFrame, totals: DataFrame, to_review: DataFrame) -> DataFrame:
    """A handoff's rules over one row each of inventory, manifest totals and records to review: rule, value, ok."""
    one = side_by_side(inventory, totals, to_review)
    rules = [
        ("has-mirrors", F.col("source_mirrors"), F.col("source_mirrors") > 0),
        ("has-notes", F.col("curated_markdown"), F.col("curated_markdown") > 0),
        ("no-missing-ids", F.col("missing_ids"), F.col("missing_ids") == 0),
        ("no-errors", F.col("errors"), F.col("errors") == 0),
        ("nothing-to-review", F.col("to_review"), F.col("to_review") == 0),
        ("mirrors-out-of-content", F.col("raw_folder_mirrors"), F.col("raw_folder_mirrors") == 0),
    ]
    return one.select(F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), v.cast("long").alias("value"), ok.alias("ok")) for r, v, ok in rules])))


def _readiness_sql(reader: str) -> str:
    from foliant.operators.files import _inventory_sql
    from foliant.operators.records import LIST_SQL, REVIEW_STATES

    lists = lambda c: f"sum(len(list_filter({LIST_SQL.format(c)}, lambda x: trim(x) <> '')))"
    return f"""WITH {workspace.sql('notes')}, {workspace.sql('records')}, i AS ({_inventory_sql(reader)}), t AS (SELECT count(*) FILTER (record_id = '') AS missing_ids, {lists('errors')} AS errors, count(*) FILTER (state IN ({', '.join(f"'{s}'" for s in REVIEW_STATES)})) AS to_review FROM records)
SELECT rule, value::BIGINT AS value, CASE WHEN rule LIKE 'has-%' THEN value > 0 ELSE value = 0 END AS ok FROM (SELECT unnest(['has-mirrors', 'has-notes', 'no-missing-ids', 'no-errors', 'nothing-to-review', 'mirrors-out-of-content']) AS rule, unnest([source_mirrors, curated_markdown, missing_ids, errors, to_review, raw_folder_mirrors]) AS value FROM i, t)"""


def _report(spark: SparkSession, sf_dir: str, reader: str) -> DataFrame:
    from foliant.operators import files, records

    notes = workspace.frame(spark, sf_dir, "notes").withColumn("size", F.col("n_chars"))
    own = records.record_frame(spark, sf_dir)
    return readiness(files.inventory(notes, reader), records.manifest_totals(own), records.state_review_total(group_counts(own, "state")))


@query(_readiness_sql("handoff"))
def handoff_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readiness rules of a handoff."""
    return _report(spark, sf_dir, "handoff")


@query(_readiness_sql("sandbox"))
def sandbox_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readiness rules of a sandbox copy."""
    return _report(spark, sf_dir, "sandbox")


def render_report(spark: SparkSession, sf_dir: str, name: str, html: bool = False, most: int = 40) -> str:
    """A report of the workspace by name as Markdown or HTML, from its queries."""
    sections = {title: registry.QUERIES[q](spark, sf_dir) for title, q in REPORTS[name].items()}
    return (render_html if html else render_markdown)(f"{name} report", sections, most)


#: The reports, their sections and the queries that fill them.
REPORTS = {
    "catalog": {"Inventory": "workspace_inventories", "Extensions and folders": "extension_and_top_counts", "Items": "catalog_source_items", "Contracts": "lifecycle_contract_counts"},
    "conversion": {"Summary": "conversion_summary", "Items": "conversion_report_rows"},
    "recovery": {"Summary": "recovery_summary", "Items": "recovery_item_rows"},
    "migration": {"Folders": "migration_folders", "Domains": "migration_domains", "Annotations": "annotation_migration_plan"},
    "overlap": {"Pairs": "overlap_ranked", "Matrix": "overlap_matrix", "Titles": "overlap_title_counts"},
    "lint": {"Sections": "lint_sections", "Findings": "lint_findings"},
    "benchmark": {"Tasks": "task_pack_summary", "Modes": "mode_result_summary", "Missing": "missing_result_pairs"},
    "handoff": {"Rules": "handoff_report", "Inventory": "workspace_inventories"},
    "sandbox": {"Rules": "sandbox_report", "Inventory": "workspace_inventories"},
    "pilot": {"Totals": "pilot_report", "Manifest": "manifest_totals_by_reader", "Conversion": "conversion_summary", "Quality": "quality_summary", "Recovery": "recovery_summary", "Reviews": "review_rollup_counts", "Prompt safety": "prompt_safety_totals"},
    "review": {"Roll-up": "review_rollup_counts"},
}
