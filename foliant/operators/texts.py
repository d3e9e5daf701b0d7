"""Questions about a note's text and fields: regions, tables, identities, links, frontmatter, status labels, artefact kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant import workspace
from foliant.functions import paths, text
from foliant.functions.rounding import percent
from foliant.operators.classify import plan_status
from foliant.registry import query, table

SENTINEL = workspace.SENTINEL
NOTE_EXPR = f"CASE doc_id % 4 WHEN 0 THEN lang || chr(10) || '{SENTINEL}' || chr(10) || source || ' text' || chr(10) WHEN 1 THEN '{SENTINEL}' WHEN 2 THEN 'x {SENTINEL}' || chr(10) || lang ELSE lang || chr(10) || '{SENTINEL} ' || chr(10) || 'y' END"


@query(f"""WITH n AS (SELECT doc_id, {NOTE_EXPR} AS note FROM documents), r AS (SELECT doc_id, note, CASE WHEN starts_with(note, '{SENTINEL}' || chr(10)) OR note = '{SENTINEL}' THEN note WHEN strpos(note, chr(10) || '{SENTINEL}' || chr(10)) > 0 THEN substr(note, strpos(note, chr(10) || '{SENTINEL}' || chr(10)) + 1) END AS region FROM n)
SELECT doc_id, sha256(region) AS region_sha, region IS NOT NULL AS has_sentinel, CASE WHEN region IS NULL THEN note ELSE left(note, length(note) - length(region)) END AS before FROM r""")
def generated_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part below the sentinel line, hashed, and the part above."""
    note = F.col("note")
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{NOTE_EXPR} AS note")
    return rows.select("doc_id", text.region_hash(note, SENTINEL).alias("region_sha"), text.generated_region(note, SENTINEL).isNotNull().alias("has_sentinel"), text.before_sentinel(note, SENTINEL).alias("before"))


ROW_EXPR = "CASE doc_id % 5 WHEN 0 THEN '| ' || lang || ' | ' || source || ' |' WHEN 1 THEN '|---|:-:|' WHEN 2 THEN '| NaN | `` | nan |' WHEN 3 THEN lang || '|' || doc_id ELSE '|  |' END"


@query(f"""WITH r AS (SELECT doc_id, list_transform(string_split(regexp_replace(regexp_replace({ROW_EXPR}, '^\\|', ''), '\\|$', ''), '|'), lambda c: trim(c)) AS cells FROM documents)
SELECT doc_id, array_to_string(cells, ';') AS cells, len(cells) > 0 AND len(list_filter(cells, lambda c: NOT regexp_matches(c, '^[-: ]*-[-: ]*$'))) = 0 AS separator, len(list_filter(cells, lambda c: lower(trim(replace(c, '`', ''))) IN ('', 'nan'))) AS noise FROM r""")
def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{ROW_EXPR} AS line").select("doc_id", text.table_cells(F.col("line")).alias("c"))
    return rows.select("doc_id", F.array_join("c", ";").alias("cells"), text.separator_row(F.col("c")).alias("separator"), F.size(F.filter("c", text.noise_cell)).cast("long").alias("noise"))


@query("""SELECT page_id, 'repo_' || left(sha256(url || chr(0) || page_id), 20) AS repo_id, trim(translate('a_b-' || page_id, '_-', '  ')) AS human, replace(replace(replace(url || '[x]', '\\', '\\\\'), '[', '\\['), ']', '\\]') AS md,
replace(replace(replace(replace(replace(url || '<a b="c">&''', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS html,
trim(regexp_replace(lower(url), '[^a-z0-9_-]', '-', 'g'), '-') AS css, trim(regexp_replace('.' || url || '-', '[^A-Za-z0-9_.-]', '-', 'g'), '.-') AS identity, round_even(page_id / 800.0, 2)::DOUBLE IS NOT NULL AS has_share, round_even((page_id / 800.0::DOUBLE) * 100, 0)::BIGINT || '%' AS share,
'./notes/a%20' || page_id || '~b.md' AS href FROM pages""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    url, page = F.col("url"), F.col("page_id")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        text.identity("repo", url, page.cast("string")).alias("repo_id"),
        text.humanize(F.concat(F.lit("a_b-"), page)).alias("human"),
        text.markdown_escape(F.concat(url, F.lit("[x]"))).alias("md"),
        text.html_escape(F.concat(url, F.lit("<a b=\"c\">&'"))).alias("html"),
        text.css_fragment(url).alias("css"),
        text.safe_identity(F.concat(F.lit("."), url, F.lit("-"))).alias("identity"),
        F.lit(True).alias("has_share"),
        percent(page / 800.0).alias("share"),
        text.href(F.concat(F.lit("notes/a "), page, F.lit("~b.md"))).alias("href"),
    )


FLAG_EXPR = "CASE event_id % 7 WHEN 0 THEN 'Yes' WHEN 1 THEN ' off ' WHEN 2 THEN '1' WHEN 3 THEN 'maybe' WHEN 4 THEN 'TRUE' WHEN 5 THEN '0' ELSE '' END"


@query(f"""SELECT event_id, CASE WHEN lower(trim({FLAG_EXPR})) IN ('1', 'true', 'yes', 'on') THEN true WHEN lower(trim({FLAG_EXPR})) IN ('0', 'false', 'no', 'off') THEN false END AS flag, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at, epoch(date_trunc('second', ts))::BIGINT AS parsed FROM events""")
def flags_and_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").selectExpr("event_id", f"{FLAG_EXPR} AS flag", "ts")
    at = text.utc_text(F.col("ts"))
    return events.select("event_id", text.truth(F.col("flag")).alias("flag"), at.alias("at"), F.unix_timestamp(text.utc_parsed(at)).alias("parsed"))


REVIEW_NOTE = "CASE conv_id % 4 WHEN 0 THEN '  ok ' WHEN 1 THEN 'a' || chr(10) || 'b' WHEN 2 THEN text || text || text || text || text || text || text || text || text || text || text || text ELSE '' END"


@query(f"""WITH n AS (SELECT conv_id, turn, regexp_replace(regexp_replace({REVIEW_NOTE}, '^\\s+', ''), '\\s+$', '') AS c FROM conversations) SELECT conv_id, turn, CASE WHEN contains(c, chr(10)) OR contains(c, chr(13)) THEN 'several lines' WHEN length(c) > 400 THEN 'too long' END AS problem, CASE WHEN NOT contains(c, chr(10)) AND NOT contains(c, chr(13)) AND length(c) <= 400 THEN c END AS note FROM n""")
def review_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{REVIEW_NOTE} AS note")
    return notes.select("conv_id", "turn", text.note_problem(F.col("note")).alias("problem"), text.one_line(F.col("note")).alias("note"))


#: Scalar fields of a reviewed artefact that its review keeps.
REVIEWED_FIELDS = ["converter", "converter_version", "last_commit", "lifecycle_state", "repo", "source", "source_id", "source_sha256", "type"]


def kept_fields(fields: Column) -> Column:
    """The fields of a map that a review keeps; nulls go."""
    return F.map_filter(fields, lambda k, v: k.isin(REVIEWED_FIELDS) & v.isNotNull())


def filled_aliases(values: dict[str, Column], aliases: dict[str, str]) -> dict[str, Column]:
    """Fields by name with an alias and its target filled from one another; the target's value wins."""
    out = dict(values)
    for alias, target in aliases.items():
        both = F.coalesce(F.nullif(out[target], F.lit("")), F.nullif(out[alias], F.lit("")))
        out[target], out[alias] = F.coalesce(both, out[target]), F.coalesce(both, out[alias])
    return out


@query(f"""WITH {workspace.sql('notes')} SELECT id, CASE WHEN account <> '' THEN account ELSE client END AS account, CASE WHEN account <> '' THEN account ELSE client END AS client,
array_to_string(list_filter([CASE WHEN source_id <> '' THEN 'source_id=' || source_id END, CASE WHEN type <> '' THEN 'type=' || type END], lambda x: x IS NOT NULL), ',') AS kept FROM notes""")
def note_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = workspace.frame(spark, sf_dir, "notes")
    own = filled_aliases({"client": F.col("client"), "account": F.col("account")}, {"client": "account"})
    fields = F.create_map(*[x for k in ("title", "source_id", "status", "type") for x in (F.lit(k), F.nullif(F.col(k), F.lit("")))])
    kept = F.array_sort(F.transform(F.map_entries(kept_fields(fields)), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return notes.select("id", own["account"].alias("account"), own["client"].alias("client"), F.array_join(kept, ",").alias("kept"))


def managed_fields(source: Column, sha: Column, source_id: Column, existing: dict[str, Column], day: str) -> dict[str, Column]:
    """A mirror's fields: defaults where a note has none, and those that each run sets anew."""
    default = lambda k, v: F.coalesce(F.nullif(existing.get(k, F.lit("")), F.lit("")), v)
    return {
        "title": default("title", text.humanize(paths.without_suffix(paths.name(source)))),
        "status": default("status", F.lit("active")),
        "domain": default("domain", paths.domain_of(source)),
        "owner": default("owner", F.lit("you")),
        "created": default("created", F.lit(day)),
        "type": F.lit("source-mirror"),
        "source_id": source_id,
        "source": source,
        "source_format": F.substring(paths.suffix(source), 2, 99),
        "source_sha256": sha,
        "updated": F.lit(day),
    }


@query(f"""WITH {workspace.sql('records')}, r AS (SELECT pos, lang || '/my_doc-' || pos || '.DOCX' AS source, sha, 'src_' || pos AS sid, CASE pos % 3 WHEN 0 THEN 'Old: title' WHEN 1 THEN 'Plain' ELSE '' END AS title FROM records), f AS (SELECT *, CASE WHEN title = '' THEN 'my doc ' || pos ELSE title END AS t FROM r)
SELECT pos, '---' || chr(10) || 'title: ' || CASE WHEN t = 'Old: title' THEN '''Old: title''' ELSE t END || chr(10) || 'status: active' || chr(10) || 'domain: ' || string_split(source, '/')[1] || chr(10) || 'owner: you' || chr(10) || 'created: ''2024-01-31''' || chr(10) || 'type: source-mirror' || chr(10) || 'source_id: ' || sid || chr(10) || 'source: ' || source || chr(10) || 'source_format: docx' || chr(10)
|| 'source_sha256: ' || CASE WHEN regexp_matches(sha, '^[0-9.+-]+$') THEN '''' || sha || '''' ELSE sha END || chr(10) || 'updated: ''2024-01-31''' || chr(10) || '---' || chr(10) AS frontmatter FROM f""")
def managed_frontmatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frontmatter that a run writes for each record's mirror."""
    rows = workspace.frame(spark, sf_dir, "records")
    source = F.concat("lang", F.lit("/my_doc-"), F.col("pos").cast("string"), F.lit(".DOCX"))
    title = F.when(F.col("pos") % 3 == 0, "Old: title").when(F.col("pos") % 3 == 1, "Plain").otherwise("")
    fields = managed_fields(source, F.col("sha"), F.concat(F.lit("src_"), F.col("pos").cast("string")), {"title": title}, "2024-01-31")
    return rows.select("pos", text.dump_fields(fields).alias("frontmatter"))


@query(f"""WITH {workspace.sql('notes')} SELECT id, sha256('{{"body":' || to_json(body || chr(10)) || ',"frontmatter":{{"domain":' || to_json(domain) || ',"title":' || to_json(title) || '}},"identity":' || to_json(source_id) || ',"kind":' || to_json(type) || ',"mirror_path":' || to_json(path) || ',"source":' || to_json(lang) || '}}') AS preserved_sha FROM notes""")
def annotation_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of what people wrote in a mirror, over its canonical JSON."""
    own = F.struct(F.col("domain").alias("domain"), F.col("title").alias("title"))
    payload = text.canonical_json(body=F.concat("body", F.lit("\n")), frontmatter=own, identity=F.col("source_id"), kind=F.col("type"), mirror_path=F.col("path"), source=F.col("lang"))
    return workspace.frame(spark, sf_dir, "notes").select("id", F.sha2(payload, 256).alias("preserved_sha"))


def artefact_kind(path: Column, kind: Column, machine_types: list[str], mirror_root: str = "_mirrors", repo_root: str = "repos") -> Column:
    """What a reviewed file is: the first rule that holds; null if it cannot be reviewed."""
    markdown = paths.suffix(path) == ".md"
    meta = (F.split(path, "/")[0] == "_meta") & paths.name(path).contains("report")
    return (
        F.when(kind.isin("source-mirror", "repo-mirror"), kind)
        .when(markdown & kind.isin(machine_types), kind)
        .when(path == "CATALOG.md", "catalog-markdown")
        .when(path == "CATALOG.html", "catalog-html")
        .when(paths.under(path, F.lit(mirror_root)), "generated-source-mirror")
        .when(paths.under(path, F.lit(repo_root)) & markdown, "repo-mirror")
        .when(meta, "meta-report")
    )


@query(f"""WITH {workspace.sql('notes')} SELECT id, CASE WHEN type IN ('source-mirror', 'repo-mirror') THEN type WHEN ends_with(lower(path), '.md') AND type = 'bogus' THEN type WHEN starts_with(path, '_mirrors/') THEN 'generated-source-mirror' WHEN starts_with(path, 'repos/') AND ends_with(lower(path), '.md') THEN 'repo-mirror' WHEN starts_with(path, '_meta/') AND contains(path, 'report') THEN 'meta-report' END AS kind FROM notes""")
def artefact_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.frame(spark, sf_dir, "notes").select("id", artefact_kind(F.col("path"), F.col("type"), ["bogus"]).alias("kind"))


#: Reasons that make a skipped run one to review.
REVIEW_REASONS = ["conflict", "manual_modification", "source_moved", "source_missing"]


def status_bucket(status: Column) -> Column:
    """The counter of a run's status."""
    reason = F.regexp_extract(status, r"^skipped:\s*([^ ]*)", 1)
    return (
        F.when(status.startswith("created"), "created").when(status.startswith("updated"), "updated").when(status.startswith("unchanged"), "unchanged")
        .when(status.startswith("skipped:") & reason.isin(REVIEW_REASONS), "review").when(status.startswith("error"), "error").otherwise("skipped")
    )


ACTION_EXPR = "CASE event_id % 6 WHEN 0 THEN 'create' WHEN 1 THEN 'update' WHEN 2 THEN 'review' WHEN 3 THEN 'skip' WHEN 4 THEN 'error' ELSE 'unchanged' END"
RUN_EXPR = "CASE event_id % 7 WHEN 0 THEN 'created(.mirror.md)' WHEN 1 THEN 'updated' WHEN 2 THEN 'unchanged' WHEN 3 THEN 'skipped:conflict x' WHEN 4 THEN 'skipped:unsupported' WHEN 5 THEN 'error: y' ELSE 'odd' END"


@query(f"""WITH e AS (SELECT event_id, event_type AS state, {ACTION_EXPR} AS action, {RUN_EXPR} AS run FROM events) SELECT event_id, CASE action WHEN 'create' THEN 'planned:create' WHEN 'update' THEN 'planned:update (' || state || ')' WHEN 'review' THEN 'review:' || state WHEN 'skip' THEN 'skipped:' || state WHEN 'error' THEN 'error:plan' ELSE state END AS status,
CASE WHEN starts_with(run, 'created') THEN 'created' WHEN run = 'updated' THEN 'updated' WHEN run = 'unchanged' THEN 'unchanged' WHEN run = 'skipped:conflict x' THEN 'review' WHEN starts_with(run, 'error') THEN 'error' ELSE 'skipped' END AS bucket FROM e""")
def plan_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").selectExpr("event_id", "event_type AS state", f"{ACTION_EXPR} AS action", f"{RUN_EXPR} AS run")
    return events.select("event_id", plan_status(F.col("action"), F.col("state")).alias("status"), status_bucket(F.col("run")).alias("bucket"))


def guidance(states: DataFrame, contract: DataFrame, fallback: str = "") -> DataFrame:
    """What a contract (state, explanation, actions) says about each state: its explanation and first action.  The contract is a few rows."""
    first = F.coalesce(F.try_element_at(F.filter("actions", lambda a: F.trim(a) != ""), F.lit(1)), F.lit(""))
    told = F.when((F.col("explanation") != "") & (first != ""), F.concat("explanation", F.lit(" Next: "), first)).when(F.col("explanation") != "", F.col("explanation")).when(first != "", first)
    return states.join(F.broadcast(contract), "state", "left").select(*states.columns, F.coalesce(told, F.lit(fallback)).alias("guidance"))


@query("""WITH c(state, ex, act) AS (VALUES ('click', 'seen', 'wait'), ('view', 'shown', ''), ('error', '', 'repair')), s AS (SELECT event_type AS state, count(*) AS n FROM events GROUP BY 1)
SELECT s.state, n, coalesce(CASE WHEN ex <> '' AND act <> '' THEN ex || ' Next: ' || act WHEN ex <> '' THEN ex WHEN act <> '' THEN act END, 'review') AS guidance FROM s LEFT JOIN c USING (state)""")
def lifecycle_guidance(spark: SparkSession, sf_dir: str) -> DataFrame:
    contract = spark.createDataFrame([("click", "seen", ["", "wait", "x"]), ("view", "shown", [" "]), ("error", "", ["repair"])], "state string, explanation string, actions array<string>")
    states = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("state")).agg(F.count(F.lit(1)).alias("n"))
    return guidance(states, contract, "review")


def fingerprint(path: Column, exists: Column, size: Column, modified: Column, hint: Column) -> Column:
    """A token of a file's metadata; of a missing file only the path counts."""
    there = lambda c, none: F.when(exists, c).otherwise(none)
    return F.to_json(F.struct(exists.alias("exists"), there(hint, F.lit("")).alias("identity_hint"), there(modified, F.lit(0)).alias("mtime"), path.alias("path"), there(size, F.lit(0)).alias("size")))


def changed(previous: Column, token: Column) -> Column:
    """Whether a file must be looked at: no token before, or another."""
    return F.coalesce(previous, F.lit("")).eqNullSafe(F.lit("")) | ~previous.eqNullSafe(token)


def hashed_if_changed(files: DataFrame, content: Column) -> DataFrame:
    """Files (exists, previous, token) with the hash of those that changed; others' contents are not hashed."""
    return files.withColumn("sha", F.when(F.col("exists") & changed(F.col("previous"), F.col("token")), F.sha2(content, 256)))


@query("""WITH f AS (SELECT doc_id, lang || '/' || doc_id AS path, doc_id % 10 <> 9 AS there, n_chars, text, source FROM documents), t AS (SELECT *, '{"exists":' || there || ',"identity_hint":"' || CASE WHEN there THEN source ELSE '' END || '","mtime":' || CASE WHEN there THEN 7 ELSE 0 END || ',"path":"' || path || '","size":' || CASE WHEN there THEN n_chars ELSE 0 END || '}' AS token FROM f)
SELECT doc_id, sha256(token) AS token_sha, CASE WHEN there AND doc_id % 3 <> 0 THEN sha256(text) END AS sha FROM t""")
def conditional_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata tokens, and content hashes only of files whose token is new or differs."""
    docs = table(spark, sf_dir, "documents")
    path, there = F.concat_ws("/", "lang", F.col("doc_id").cast("string")), F.col("doc_id") % 10 != 9
    token = fingerprint(path, there, F.col("n_chars"), F.lit(7), F.col("source"))
    rows = docs.select("doc_id", "text", there.alias("exists"), token.alias("token"))
    known = rows.withColumn("previous", F.when(F.col("doc_id") % 3 == 0, F.col("token")).when(F.col("doc_id") % 3 == 1, "{}"))
    return hashed_if_changed(known, F.col("text")).select("doc_id", F.sha2("token", 256).alias("token_sha"), "sha")
