"""Declared views of a profile: which columns, filters and order, their text, their state, and their plan over notes."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DateType, NumericType, StringType, TimestampType

from foliant import workspace
from foliant.config import flagged, ignored_by
from foliant.registry import query, table
from foliant.sources import sinks


def unique(values: list[str]) -> list[str]:
    """Values in order, each once, empty ones left out."""
    return list(dict.fromkeys(v for v in values if v))


def columns(profile: dict[str, Any], preferred: list[str]) -> list[str]:
    """The file's name and those of the preferred columns that the profile declares."""
    declared = {*profile["required_properties"], *profile.get("optional_properties", [])}
    return unique(["file.name", *[c for c in preferred if c in declared]])


def document_views(profile: dict[str, Any]) -> list[dict[str, Any]]:
    """The views of a profile: three always, and those whose note types or statuses it has."""
    own = [p for p in profile["required_properties"] if p != "title"]
    views: list[dict[str, Any]] = [
        {"name": "All documents", "columns": unique(["file.name", *own, "owner" if "owner" in columns(profile, ["owner"]) else ""]), "sort": [("modified", False)]},
        {"name": "By status", "columns": columns(profile, ["status", "type", "domain", "owner", "updated"]), "sort": [("status", True)]},
        {"name": "By domain", "columns": columns(profile, ["domain", "type", "status", "owner", "updated"]), "sort": [("domain", True)]},
    ]
    for kind, name in (("source-mirror", "Source mirrors"), ("repo-mirror", "Repository mirrors")):
        if kind in profile["note_types"]:
            views.append({"name": name, "columns": columns(profile, ["source", "repo", "status", "updated"]), "mode": "and", "filters": [("type", kind)], "sort": [("file.name", True)]})
    attention = flagged(profile["statuses"], "attention")
    if attention:
        views.append({"name": "Needs attention", "columns": columns(profile, ["status", "owner", "updated"]), "mode": "or", "filters": [("status", s) for s in attention], "sort": [("updated", False)]})
    return views


def render(views: list[dict[str, Any]]) -> str:
    """The views as text; equal views give equal texts."""
    return json.dumps({"views": views}, indent=1) + "\n"


def plan(spark: SparkSession, root: str, profile: dict[str, Any], path: str = "documents.views.json") -> dict[str, str]:
    """The state of the views' file: missing, current, stale, or blocked by a folder."""
    fs, place = sinks._place(spark, f"{root}/{path}")
    if fs.exists(place) and fs.getFileStatus(place).isDirectory():
        return {"path": path, "state": "blocker"}
    now = sinks.read_text(spark, f"{root}/{path}")
    return {"path": path, "state": "missing" if now is None else "current" if now == render(document_views(profile)) else "stale"}


def write(spark: SparkSession, root: str, profile: dict[str, Any], path: str = "documents.views.json") -> bool:
    """Write the views' file unless it is current; tells whether it wrote."""
    state = plan(spark, root, profile, path)["state"]
    if state == "blocker":
        raise sinks.SinkError(f"{path} is a folder")
    if state != "current":
        sinks.write_text(spark, f"{root}/{path}", render(document_views(profile)))
    return state != "current"


class ViewError(ValueError):
    """A view that cannot be compiled."""


#: Comparisons of a filter by their sign.
COMPARED = {"==": lambda c, v: c.eqNullSafe(v), "!=": lambda c, v: ~c.eqNullSafe(v), "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v}


def comparable(value: Any, kind: DataType) -> bool:
    """Whether a value may be compared with a column of a type as it is, without a cast that could fail or change it."""
    if value is None:
        return True
    if isinstance(value, bool):
        return isinstance(kind, BooleanType)
    if isinstance(value, (int, float)):
        return isinstance(kind, NumericType)
    return isinstance(kind, (StringType, DateType, TimestampType)) and isinstance(value, str)


def compile_filter(df: DataFrame, spec: Any, place: str = "filters") -> Column:
    """A filter as one column: {"and": [..]}, {"or": [..]}, {"not": ..}, (column, value), or {"column", "is", "value" or "values"}.

    Signs are those of COMPARED, `in`, `contains` (a part of a text, or an item of a list), `empty` and `under` (a folder).
    An unknown column, sign or shape, or a value that its column's type cannot be compared with, is refused with its place.
    An absent value fails every test but `!=`, `empty` and a comparison with null.
    """
    if isinstance(spec, (list, tuple)) and len(spec) == 2 and isinstance(spec[0], str):
        spec = {"column": spec[0], "is": "==", "value": spec[1]}
    if not isinstance(spec, dict):
        raise ViewError(f"{place}: neither a test nor a group")
    for word, whole in (("and", True), ("or", False)):
        if word in spec:
            if len(spec) != 1 or not isinstance(spec[word], list):
                raise ViewError(f"{place}.{word}: must be a list and stand alone")
            tests = [compile_filter(df, s, f"{place}.{word}[{k}]") for k, s in enumerate(spec[word])]
            out = F.lit(whole)
            for test in tests:
                out = out & test if whole else out | test
            return out
    if "not" in spec:
        if len(spec) != 1:
            raise ViewError(f"{place}.not: must stand alone")
        return ~compile_filter(df, spec["not"], f"{place}.not")
    name, sign = spec.get("column"), spec.get("is", "==")
    if name not in df.columns:
        raise ViewError(f"{place}: no column {name}")
    column, kind = F.col(f"`{name}`"), df.schema[name].dataType
    item = kind.elementType if isinstance(kind, ArrayType) else kind
    values = spec.get("values", [spec.get("value")])
    if sign != "empty" and not all(comparable(v, item) for v in values):
        raise ViewError(f"{place}: {name} is {kind.simpleString()}, which {values} are not")
    if sign == "empty":
        if isinstance(kind, ArrayType):
            return F.coalesce(F.size(column) == 0, F.lit(True))
        return F.coalesce(F.trim(column) == "", F.lit(True)) if isinstance(kind, StringType) else column.isNull()
    if sign == "in":
        return F.coalesce(column.isin(values), F.lit(False))
    if sign == "contains" and isinstance(kind, ArrayType):
        return F.coalesce(F.array_contains(column, values[0]), F.lit(False))
    if sign in ("contains", "under") and isinstance(kind, StringType):
        return F.coalesce(column.contains(values[0]) if sign == "contains" else column.startswith(values[0].rstrip("/") + "/"), F.lit(False))
    if sign not in COMPARED or isinstance(kind, ArrayType):
        raise ViewError(f"{place}: {kind.simpleString()} has no test {sign}")
    return F.coalesce(COMPARED[sign](column, F.lit(values[0])), F.lit(False))


def compile_view(df: DataFrame, spec: dict[str, Any]) -> DataFrame:
    """A declared view as a plan: its filters (nested, or a list joined by `mode`), sort, and those of its columns that there are."""
    filters = spec.get("filters", [])
    if isinstance(filters, list):
        filters = {spec.get("mode", "and"): filters} if filters else {"and": []}
    df = df.where(compile_filter(df, filters))
    order = [(c, True) if isinstance(c, str) else c for c in spec.get("sort", [])]
    sorted_by = [F.col(f"`{c}`").asc() if up else F.col(f"`{c}`").desc() for c, up in order if c in df.columns]
    return (df.orderBy(*sorted_by) if sorted_by else df).select(*[f"`{c}`" for c in spec["columns"] if c in df.columns])


def register(df: DataFrame, profile: dict[str, Any]) -> list[str]:
    """Each view as a temporary view of the session, by its name in lower case with `_`."""
    names = []
    for spec in document_views(profile):
        names.append(spec["name"].lower().replace(" ", "_"))
        compile_view(df, spec).createOrReplaceTempView(names[-1])
    return names


SAMPLE = {"required_properties": ["title", "status", "type", "domain"], "optional_properties": ["owner"], "note_types": {"source-mirror": {}}, "statuses": {"fr": {"attention": True}, "de": {"attention": True}, "en": {}}}


@query("SELECT doc_id, lang FROM documents WHERE lang = 'fr' OR lang = 'de' ORDER BY lang, doc_id")
def declared_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = {"columns": ["doc_id", "lang", "absent"], "filters": [("lang", "fr"), ("lang", "de")], "mode": "or", "sort": ["lang", "doc_id"]}
    return compile_view(table(spark, sf_dir, "documents"), spec)


@query("""WITH n AS (SELECT doc_id::VARCHAR AS f, lang AS status, CASE WHEN doc_id % 4 = 0 THEN 'source-mirror' ELSE 'note' END AS type FROM documents) SELECT 'all_documents' AS view, count(*) AS n, count(DISTINCT f) AS names FROM n UNION ALL SELECT 'by_status', count(*), count(DISTINCT f) FROM n UNION ALL SELECT 'by_domain', count(*), count(DISTINCT f) FROM n
UNION ALL SELECT 'source_mirrors', count(*), count(DISTINCT f) FROM n WHERE type = 'source-mirror' UNION ALL SELECT 'needs_attention', count(*), count(DISTINCT f) FROM n WHERE status IN ('fr', 'de')""")
def profile_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each view that a profile declares."""
    notes = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file.name"), F.col("lang").alias("status"), F.when(F.col("doc_id") % 4 == 0, "source-mirror").otherwise("note").alias("type"), F.col("source").alias("domain"))
    out = None
    for name in register(notes, SAMPLE):
        own = spark.table(name).agg(F.lit(name).alias("view"), F.count(F.lit(1)).alias("n"), F.count_distinct("`file.name`").alias("names"))
        out = own if out is None else out.unionByName(own)
    return out


NESTED = {"columns": ["path", "status", "n_chars"], "sort": ["path"], "filters": {"or": [
    {"and": [{"column": "path", "is": "under", "value": "en"}, {"not": {"column": "status", "is": "in", "values": ["archived", "weird"]}}, {"column": "n_chars", "is": ">=", "value": 200}]},
    {"and": [{"column": "tags", "is": "contains", "value": "fr"}, {"or": [{"column": "annotated", "value": True}, {"column": "sidecar", "is": "empty"}]}]},
    {"not": {"or": [{"column": "sidecar", "is": "!=", "value": "other"}, {"column": "title", "is": "contains", "value": "part1"}]}},
]}}


@query(f"""WITH {workspace.sql('notes')} SELECT path, status, n_chars FROM notes WHERE (starts_with(path, 'en/') AND status NOT IN ('archived', 'weird') AND n_chars >= 200) OR (lang = 'fr' AND (annotated OR coalesce(trim(sidecar), '') = ''))
OR (sidecar IS NOT DISTINCT FROM 'other' AND NOT contains(title, 'part1'))""")
def nested_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view with nested and, or and not over texts, numbers, flags and lists."""
    notes = workspace.frame(spark, sf_dir, "notes").withColumn("tags", F.array("lang", "domain"))
    return compile_view(notes, NESTED | {"sort": []})


IGNORE_RULES = ["# data", "*.log", "data/", "id_*", "[xX]?/*.pptx", "docs", "!docs/README1*", "_*", "!_meta/report*", "/tools/", "*/*/*5.md", "a/_fixtures/?.md"]


@query(f"""WITH {workspace.sql('notes')}, p AS (SELECT DISTINCT path, string_split(path, '/') AS parts FROM notes), r AS (SELECT path, [CASE WHEN len(list_filter(parts, lambda x: ends_with(x, '.log'))) > 0 THEN 1 END, CASE WHEN path = 'data' OR starts_with(path, 'data/') THEN 1 END, CASE WHEN len(list_filter(parts, lambda x: starts_with(x, 'id_'))) > 0 THEN 1 END,
CASE WHEN regexp_full_match(path, '[xX]./.*\\.pptx', 's') OR starts_with(path, '[xX]?/*.pptx/') THEN 1 END, CASE WHEN list_contains(parts, 'docs') THEN 1 END, CASE WHEN starts_with(path, 'docs/README1') THEN 0 END, CASE WHEN len(list_filter(parts, lambda x: starts_with(x, '_'))) > 0 THEN 1 END, CASE WHEN starts_with(path, '_meta/report') THEN 0 END,
CASE WHEN path = 'tools' OR starts_with(path, 'tools/') THEN 1 END, CASE WHEN regexp_full_match(path, '.*/.*/.*5\\.md', 's') THEN 1 END, CASE WHEN regexp_full_match(path, 'a/_fixtures/.\\.md', 's') THEN 1 END] AS hits FROM p) SELECT path, coalesce(list_filter(hits, lambda h: h IS NOT NULL)[-1], 0) = 1 AS ignored FROM r""")
def ignored_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every path of the workspace by ordered ignore rules."""
    return workspace.frame(spark, sf_dir, "notes").select("path").distinct().select("path", ignored_by(F.col("path"), IGNORE_RULES).alias("ignored"))
