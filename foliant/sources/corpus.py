"""Readers and sinks of a governed corpus: files, notes with frontmatter, manifests, JSON Lines, OOXML parts; compare-then-write."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions import paths
from foliant.functions.text import noise_cell, separator_row, table_cells, trimmed
from foliant.operators.diffs import same_content
from foliant.registry import query, table

RECORD = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("source_id", "current_source_path", "mirror_path", "source_format", "source_sha256", "normalized_content_sha256", "generated_region_sha256", "converter", "converter_version", "config_version", "lifecycle_state", "last_successful_sync", "source_modified")]
    + [T.StructField("source_size", T.LongType())]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("previous_source_paths", "ambiguous_move_candidates", "warnings", "errors")]
)
ENVELOPE = T.StructType([T.StructField("schema_version", T.IntegerType()), T.StructField("updated", T.StringType()), T.StructField("records", T.ArrayType(RECORD))])


def files(spark: SparkSession, root: str, suffixes: list[str] | None = None, content: bool = False, reader: str = "office") -> DataFrame:
    """Files below a folder: path (relative), size, modified, and content only on demand; what the reader excludes is left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    relative = F.regexp_replace(F.col("path"), F.lit("^.*?" + re.escape(root.rstrip("/").split("/")[-1]) + "/"), F.lit(""))
    rows = found.select(relative.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *([F.col("content")] if content else []))
    keep = ~paths.excluded(F.col("path"), reader) & ~paths.name(F.col("path")).startswith("~$")
    if suffixes:
        keep &= paths.suffix(F.col("path")).isin(suffixes)
    return rows.where(keep)


def tree_sha(tree: DataFrame) -> DataFrame:
    """One hash of a small tree's files (path, content): over path, NUL, content, NUL in the order of paths; `local-` and 40 digits."""

    def digest(group: pd.DataFrame) -> pd.DataFrame:
        import hashlib

        own = hashlib.sha256()
        for path, content in sorted(zip(group["path"], group["content"])):
            own.update(path.encode() + b"\0" + bytes(content) + b"\0")
        return pd.DataFrame({"repo": [group["repo"].iloc[0]], "sha": ["local-" + own.hexdigest()[:40]]})

    return tree.where(~F.col("path").contains(".git/")).groupBy("repo").applyInPandas(digest, "repo string, sha string")


def commit_log(lines: DataFrame) -> DataFrame:
    """Commits (hash, at, subject) from the tab-separated lines (value) of a log; a subject may have tabs."""
    part = F.split("value", "\t", 3)
    return lines.where(F.size(part) >= 3).select(part[0].alias("hash"), part[1].alias("at"), part[2].alias("subject"))


def allowed_data(texts: DataFrame) -> DataFrame:
    """Names of data files that provenance texts (text) list between backticks."""
    found = F.regexp_extract_all("text", F.lit("`([^`\\s]+\\.[A-Za-z0-9]+)`"), F.lit(1))
    return texts.select(F.explode(found).alias("path")).distinct()


def scalar(value: str) -> str:
    """A scalar's text without its quotes and without a comment."""
    value = value.strip()
    if value[:1] in "'\"" and value:
        quote = value[0]
        end = re.match(r"'((?:[^']|'')*)'|\"((?:[^\"\\]|\\.)*)\"", value)
        if end:
            return end[1].replace("''", "'") if quote == "'" else re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), end[2])
        raise ValueError("open quote")
    return re.split(r"(?:^|\s)#", value, maxsplit=1)[0].strip()


def flow_items(value: str) -> list[str]:
    """The items of a list in brackets; commas in quotes are no separators."""
    if not value.endswith("]"):
        raise ValueError("open list")
    return [scalar(x) for x in re.findall(r"\s*('(?:[^']|'')*'|\"(?:[^\"\\]|\\.)*\"|[^,]+)", value[1:-1]) if x.strip()]


def parse_fields(head: str) -> dict[str, str]:
    """Fields of frontmatter as text: scalars, quotes, comments, lists in lines or brackets (joined by `, `), block texts, nested keys with a dot."""
    fields: dict[str, str] = {}
    above: list[tuple[int, str]] = []
    lines = head.strip("\n").split("\n")
    k = 0
    while k < len(lines):
        line = lines[k]
        k += 1
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        depth = len(line) - len(line.lstrip(" "))
        body = line.strip()
        if "\t" in line[:depth + 1]:
            raise ValueError("tab")
        if body.startswith("- ") or body == "-":
            if not above:
                raise ValueError("item without a key")
            key = above[-1][1]
            fields[key] = ", ".join(x for x in (fields[key], scalar(body[1:])) if x)
            continue
        found = re.match(r"('[^']*'|\"[^\"]*\"|[^:#\s][^:]*?)\s*:(?:\s+(.*))?$", body)
        if not found:
            raise ValueError("no key")
        while above and above[-1][0] >= depth:
            above.pop()
        if depth and not above:
            raise ValueError("indented key")
        key = ".".join([*(x[1] for x in above[-1:]), scalar(found[1])])
        value = (found[2] or "").strip()
        above.append((depth, key))
        if re.fullmatch(r"[|>][+-]?", value):
            own = []
            while k < len(lines) and (not lines[k].strip() or len(lines[k]) - len(lines[k].lstrip(" ")) > depth):
                own.append(lines[k].strip())
                k += 1
            fields[key] = ("\n" if value[0] == "|" else " ").join(own).strip()
        else:
            fields[key] = ", ".join(flow_items(value)) if value.startswith("[") else scalar(value)
    return fields


def parse_frontmatter(text: str, mode: str) -> tuple[dict[str, str] | None, str]:
    """Frontmatter fields (null if invalid) and body.  Modes differ as the corpus tools do: `line` ends at the next line that starts with ---, `split3` at any ---, `mirror` as `line` without the newline after it."""
    if not text.startswith("---"):
        return {}, text
    if mode == "split3":
        found = text.split("---", 2)
        if len(found) < 3:
            return {}, text
        head, body = found[1], found[2]
    else:
        end = text.find("\n---", 3)
        if end < 0:
            return {}, text
        head, body = text[3:end], text[end + 4 :]
        if mode == "mirror":
            body = body.removeprefix("\n")
    try:
        return parse_fields(head), body
    except ValueError:
        return ({}, body) if mode == "split3" else (None, text)


def frontmatter(text: Column, mode: str = "line") -> Column:
    """A struct of fields (map; null if invalid) and body."""

    @F.pandas_udf("struct<fields:map<string,string>,body:string>")
    def apply(values: pd.Series) -> pd.DataFrame:
        rows = [parse_frontmatter(v or "", mode) for v in values]
        return pd.DataFrame({"fields": [r[0] for r in rows], "body": [r[1] for r in rows]})

    return apply(text)


def notes(spark: SparkSession, root: str, mode: str = "line", reader: str = "overlap") -> DataFrame:
    """Markdown notes of a reader: path, fm (map), type, title, status, body."""
    text = F.decode("content", "UTF-8")
    parsed = files(spark, root, [".md"], content=True, reader=reader).select("path", frontmatter(text, mode).alias("f"))
    field = lambda name: F.coalesce(F.try_element_at("f.fields", F.lit(name)), F.lit("")).alias(name)
    return parsed.select("path", F.col("f.fields").alias("fm"), field("type"), field("title"), field("status"), F.col("f.body").alias("body"))


def note_types(files_with_heads: DataFrame) -> DataFrame:
    """The type field of notes (path, content) from their first 4,096 bytes; empty on any failure."""
    head = F.decode(F.substring("content", 1, 4096), "UTF-8")
    closed = F.when(head.startswith("---") & (F.locate("\n---", head) > 0), head).otherwise("")
    return files_with_heads.select("path", F.coalesce(F.try_element_at(frontmatter(closed)["fields"], F.lit("type")), F.lit("")).alias("type"))


def manifest(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Records of a manifest; strict readers fail on bad JSON, tolerant ones drop what is no record."""
    rows = spark.read.schema(ENVELOPE).option("multiLine", True).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)
    return rows.select(F.posexplode("records")).where("col is not null").select("pos", "col.*")


REPO_RECORD = "repo_id string, configured_repo string, resolved_repo string, note_path string, source_type string, source_ref string, last_commit string, generated_region_sha256 string, config_version string, lifecycle_state string, last_successful_sync string, warnings array<string>, errors array<string>"


def repo_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Records of a repositories' manifest."""
    rows = spark.read.schema(f"schema_version int, updated string, records array<struct<{REPO_RECORD.replace(' ', ':').replace(',:', ',')}>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    return rows.select(F.posexplode("records")).where("col is not null").select("pos", "col.*")


def manifest_errors(spark: SparkSession, path: str, key: str) -> DataFrame:
    """What is wrong with a manifest's records: entries that are no objects, and records without an id; `pos` and `error`."""
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json(F.get_json_object("value", "$.records"), "array<string>")).alias("pos", "record"))
    bad = ~F.coalesce(F.col("record").startswith("{"), F.lit(False))
    missing = F.trim(F.coalesce(F.get_json_object("record", f"$.{key}"), F.lit(""))) == ""
    return raw.select("pos", F.when(bad, "not an object").when(missing, f"{key} missing").alias("error")).where("error is not null")


def keyed_records(records: DataFrame, key: str) -> DataFrame:
    """The last record of each key; records without one are left out."""
    whole = F.struct(*records.columns)
    return records.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(F.max_by(whole, "pos").alias("r")).select("r.*")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines with their numbers; `bad` marks lines that are no JSON, which are warnings, not failures.

    Large files are read in splits: a line's number is its place in its split and the lines of the
    splits before, of which only the counts are gathered.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    offsets, before = [], {}
    for r in sorted(lines.groupBy("_file", "_start").count().collect(), key=lambda r: (r["_file"], r["_start"])):  # a row for each split
        offsets.append((r["_file"], r["_start"], before.get(r["_file"], 0)))
        before[r["_file"]] = before.get(r["_file"], 0) + r["count"]
    known = spark.createDataFrame(offsets, "_file string, _start long, _before long")
    place = F.row_number().over(Window.partitionBy("_file", "_start").orderBy("_id"))
    numbered = lines.withColumn("_place", place).join(F.broadcast(known), ["_file", "_start"])
    rows = numbered.where(F.trim("value") != "").select((F.col("_before") + F.col("_place")).alias("line_number"), "value")
    return rows.select("line_number", F.from_json("value", schema).alias("event"), F.try_parse_json("value").isNull().alias("bad"))


def ooxml_parts(documents: DataFrame) -> DataFrame:
    """Text parts of zipped office files (path, content): path, part, text; what is no zip gives one row with an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        for name in archive.namelist():
                            if name.endswith((".xml", ".rels", ".txt", ".csv")):
                                rows.append((path, name, unescape(re.sub(r"<[^>]*>", " ", archive.read(name).decode("utf-8", "replace"))), None))
                except zipfile.BadZipFile:
                    rows.append((path, "", "", "not a zip file"))
            yield pd.DataFrame(rows, columns=["path", "part", "text", "error"])

    return documents.select("path", "content").mapInPandas(run, "path string, part string, text string, error string")


def write_if_changed(df: DataFrame, path: str) -> bool:
    """Write Parquet unless the same rows are there already; tells whether it wrote."""
    spark = df.sparkSession
    try:
        if same_content(spark.read.parquet(path).select(*df.columns), df):
            return False
    except Exception as e:  # nothing there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    df.write.mode("overwrite").parquet(path)
    return True


def append_events(df: DataFrame, path: str) -> None:
    """Append events as JSON lines."""
    df.write.mode("append").json(path)


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, however often `body` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def clean_table(text: Column) -> Column:
    """Markdown tables of a spreadsheet without columns that are noise (empty or unnamed head, no data); never all columns.

    Built-in functions only: lines are grouped into runs of table rows, a run's columns are judged by
    all its rows, and the rest of the text stays.  Each step is worked out once for a run, so the work follows its cells.
    """

    def runs(lines: Column, table: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda k: (k == 1) | (F.element_at(table, k) != F.try_element_at(table, F.greatest(k - 1, F.lit(1)))))
        run = lambda starts, a, i: _with(F.slice(lines, a, F.coalesce(F.try_element_at(starts, i + 2), F.size(lines) + 1) - a), lambda own: F.when(F.element_at(table, a), _clean_rows(own)).otherwise(F.array_join(own, "\n")))
        return _with(starts, lambda s: F.array_join(F.transform(s, lambda a, i: run(s, a, i)), "\n"))

    is_row = lambda lines: F.transform(lines, lambda x: trimmed(x).startswith("|"))
    return F.when(text.isNotNull(), _with(F.split(text, "\n"), lambda lines: _with(is_row(lines), lambda table: runs(lines, table))))


def _clean_rows(lines: Column) -> Column:
    """One run of table rows without its noise columns."""

    def shown(rows: Column, data: Column, head: Column, columns: Column) -> Column:
        noisy = lambda k: (noise_cell(F.element_at(head, k)) | F.element_at(head, k).startswith("Unnamed")) & F.forall(data, lambda r: noise_cell(F.element_at(r, k)))
        line = lambda show: lambda r: F.concat(F.lit("| "), F.array_join(F.transform(show, lambda k: _with(F.element_at(r, k), lambda c: F.when(noise_cell(c), "").otherwise(c))), " | "), F.lit(" |"))
        some = lambda kept: F.when(F.size(kept) > 0, kept).otherwise(columns)
        return _with(F.filter(columns, lambda k: ~noisy(k)), lambda kept: _with(some(kept), lambda show: F.array_join(F.transform(rows, line(show)), "\n")))

    def judged(rows: Column) -> Column:
        data = F.filter(rows, lambda r, i: (i > 0) & ~separator_row(r))
        columns = lambda head: F.sequence(F.lit(1), F.size(head))
        return _with(data, lambda d: _with(F.element_at(rows, 1), lambda head: _with(columns(head), lambda c: shown(rows, d, head, c))))

    filled = lambda cells, width: F.transform(cells, lambda c: F.concat(c, F.array_repeat(F.lit(""), width - F.size(c))))
    widths = lambda cells: F.array_max(F.transform(cells, F.size))
    return _with(F.transform(lines, table_cells), lambda cells: _with(widths(cells), lambda width: _with(filled(cells, width), judged)))


def clean_extracted(kind: Column, text: Column) -> Column:
    """Extracted text by source format: only spreadsheets are cleaned."""
    return F.when(kind == "xlsx", clean_table(text)).otherwise(text)


NOTE_SQL = "'---' || chr(10) || 'title: ' || chr(39) || 'Note: ' || doc_id || chr(39) || ' # mine' || chr(10) || 'type: note' || chr(10) || 'tags: [' || lang || ', ' || source || ']' || chr(10) || 'list:' || chr(10) || '  - a' || chr(10) || '  - b c' || chr(10) || 'deep:' || chr(10) || '  key: v' || (doc_id % 7) || chr(10) || CASE WHEN doc_id % 9 = 0 THEN 'broken' || chr(10) ELSE '' END || '---' || chr(10) || text"


@query("""SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN 'Note: ' || doc_id END AS title, CASE WHEN doc_id % 9 <> 0 THEN lang || ', ' || source END AS tags, CASE WHEN doc_id % 9 <> 0 THEN 'a, b c' END AS list, CASE WHEN doc_id % 9 <> 0 THEN 'v' || doc_id % 7 END AS deep, doc_id % 9 <> 0 AS same_body FROM documents""")
def frontmatter_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes made of documents, parsed back: quoted, listed and nested fields; a broken head is no frontmatter."""
    parsed = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{NOTE_SQL} AS note", "text").select("doc_id", frontmatter(F.col("note"), "mirror").alias("f"), "text")
    field = lambda k: F.try_element_at("f.fields", F.lit(k))
    return parsed.select("doc_id", field("title").alias("title"), field("tags").alias("tags"), field("list").alias("list"), field("deep.key").alias("deep"), (F.col("f.body") == F.col("text")).alias("same_body"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'before' || chr(10) || '| a | c |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || lang || ' | ' || n_chars || ' |' || chr(10) || 'after' WHEN 1 THEN '| Unnamed: 0 |  |' || chr(10) || '|  |  |' ELSE '| a | Unnamed: 1 |' || chr(10) || '| ' || lang || ' | x |' END AS cleaned,
CASE doc_id % 3 WHEN 0 THEN 'kept' ELSE 'kept' END AS other FROM documents""")
def spreadsheet_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of a spreadsheet without their noise columns; a table of noise alone keeps its columns, other formats stay."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    full = F.concat(F.lit("before\n| a | Unnamed: 1 | c |\n|---|---|---|\n| "), F.col("lang"), F.lit(" | NaN | "), F.col("n_chars"), F.lit(" |\nafter"))
    sheet = F.when(F.col("doc_id") % 3 == 0, full).when(F.col("doc_id") % 3 == 1, "| Unnamed: 0 | `` |\n| nan |  |").otherwise(F.concat(F.lit("| a | Unnamed: 1 |\n| "), F.col("lang"), F.lit(" | x |")))
    return docs.select("doc_id", clean_extracted(F.lit("xlsx"), sheet).alias("cleaned"), clean_extracted(F.lit("docx"), F.lit("kept")).alias("other"))
