"""A workspace of notes, sources and records made of the test tables, for the queries that need one.

Each column is an expression that Spark and DuckDB read alike, so a query and its SQL start from the
same rows; what they do with them is written twice.  No row is left out: a file that is gone or moved
has a column that says so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.registry import table

SENTINEL = "%% GENERATED BELOW %%"

#: A path for each document, of every kind that some reader treats in its own way.
PATH = """CASE doc_id % 26 WHEN 1 THEN '_mirrors/' || lang || '/' || doc_id || '.md' WHEN 2 THEN 'repos/' || doc_id || '.md' WHEN 3 THEN '_archive_old/' || doc_id || '.md'
WHEN 4 THEN '.hidden/' || doc_id || '.md' WHEN 5 THEN '_meta/report' || doc_id || '.md' WHEN 6 THEN lang || '/~$' || doc_id || '.docx' WHEN 7 THEN lang || '/' || doc_id || '.docx'
WHEN 8 THEN lang || '/' || source || '/' || doc_id || '.PDF' WHEN 9 THEN 'a/_fixtures/' || doc_id || '.md' WHEN 10 THEN lang || '/.' || doc_id || '.md.77.tmp'
WHEN 11 THEN '01_' || lang || '/secret' || doc_id || '.xlsx' WHEN 12 THEN lang || '/' || doc_id || '.MD' WHEN 13 THEN '../' || doc_id || '.md' WHEN 14 THEN '/abs/' || doc_id || '.md'
WHEN 15 THEN 'tools/' || doc_id || '.md' WHEN 16 THEN 'docs/README' || doc_id || '.md' WHEN 17 THEN 'readme' || doc_id || '.txt' WHEN 18 THEN ' ' WHEN 19 THEN 'a/_meta/' || doc_id || '.swp'
WHEN 20 THEN 'data/' || doc_id || '.csv' WHEN 21 THEN lang || '/' || doc_id || '/id_rsa' WHEN 22 THEN 'x' || lang || '/' || doc_id || '.pptx' WHEN 23 THEN 'dist/' || doc_id || '.log' WHEN 24 THEN lang || '/' || source || '/' || doc_id || '/index.md'
ELSE lang || '/' || source || '/' || doc_id || '.md' END"""

NOTES = {
    "id": "doc_id",
    "path": PATH,
    "has_fm": "doc_id % 23 <> 0",
    "type": "CASE doc_id % 11 WHEN 0 THEN 'source-mirror' WHEN 1 THEN 'repo-mirror' WHEN 2 THEN 'bogus' WHEN 3 THEN '' ELSE 'note' END",
    "status": "CASE doc_id % 13 WHEN 0 THEN 'archived' WHEN 1 THEN 'weird' WHEN 2 THEN '' ELSE 'active' END",
    "domain": "CASE doc_id % 17 WHEN 0 THEN 'other' WHEN 1 THEN 'x' || lang WHEN 2 THEN '' ELSE lang END",
    "title": "CASE WHEN doc_id % 19 = 0 THEN '' ELSE 'report ' || source || ' part' || (doc_id % 997) END",
    "client": "CASE doc_id % 7 WHEN 0 THEN 'acme' WHEN 1 THEN 'beta' ELSE '' END",
    "account": "CASE doc_id % 9 WHEN 0 THEN 'acme' ELSE '' END",
    "has_sentinel": "doc_id % 5 <> 0",
    "source_id": "CASE WHEN doc_id % 29 = 0 THEN '' ELSE 'src_' || doc_id END",
    "source_sha": "md5(coalesce(text, ''))",
    "source": "CASE doc_id % 33 WHEN 0 THEN '' WHEN 11 THEN '../up.docx' WHEN 22 THEN 'x/' || doc_id || '.docx' ELSE lang || '/' || doc_id || '.docx' END",
    "source_manifest": "CASE WHEN doc_id % 37 = 0 THEN 'other.json' ELSE '_meta/source-manifest.json' END",
    "annotated": "doc_id % 3 = 0",
    "sidecar": "CASE doc_id % 4 WHEN 0 THEN 'same' WHEN 1 THEN 'other' END",
    "body": "text",
    "n_chars": "n_chars",
    "lang": "lang",
    "links": "'[[docs/README' || (doc_id - doc_id % 26 + 16) || ']] [[repos/' || (doc_id - doc_id % 26 + 2) || '.md|x]] [[data/' || (doc_id - doc_id % 26 + 20) || ']] [[' || (doc_id + 1) || '#part|next]] `[[code]]` [[nowhere/' || doc_id || ']] [[ ' || (doc_id + 26) || '.md#top]] [[README' || (doc_id % 40) || ']] [[../up]] [[#here]] ``[[twice]]`` [[repos/' || (doc_id - doc_id % 26 + 2) || chr(92) || '|see]] [[index]] [[id_rsa]] [[' || doc_id || ']]'",
    "related": "CASE doc_id % 9 WHEN 0 THEN '' WHEN 1 THEN '[[index.md]] and [[tools/' || (doc_id - doc_id % 26 + 15) || ']];plain' ELSE '[[README' || (doc_id % 50) || chr(92) || '|x]];`[[docs/README' || (doc_id - doc_id % 26 + 16) || ']]`' END",
}

RECORDS = {
    "pos": "doc_id",
    "record_id": "CASE WHEN doc_id % 31 = 0 THEN '' ELSE 'src_' || doc_id END",
    "path": "CASE doc_id % 21 WHEN 0 THEN '' WHEN 1 THEN '../up' WHEN 2 THEN 'old/' || lang || '/' || doc_id || '.docx' WHEN 3 THEN lang || '/shared.docx' ELSE lang || '/' || doc_id || '.docx' END",
    "mirror": "CASE doc_id % 27 WHEN 0 THEN '' ELSE '_mirrors/' || lang || '/' || doc_id || '.md' END",
    "format": "CASE doc_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'XLSX' WHEN 2 THEN '' WHEN 3 THEN 'doc' ELSE 'docx' END",
    "state": "CASE doc_id % 15 WHEN 0 THEN 'conflict' WHEN 1 THEN 'error' WHEN 2 THEN 'manual_modification' WHEN 3 THEN 'source_missing' WHEN 4 THEN 'source_moved' WHEN 5 THEN 'unsupported' WHEN 6 THEN 'planned' WHEN 7 THEN 'stale' WHEN 8 THEN 'reviewed' WHEN 9 THEN '' WHEN 10 THEN 'converter_changed' ELSE 'clean' END",
    "warnings": "CASE doc_id % 8 WHEN 0 THEN 'Large-file risk: x;other' WHEN 1 THEN ' ' WHEN 2 THEN 'Generated region sentinel is missing' WHEN 3 THEN 'Potential duplicate: y' ELSE '' END",
    "errors": "CASE doc_id % 14 WHEN 0 THEN 'broken' WHEN 1 THEN ' ;second' ELSE '' END",
    "size": "n_chars",
    "sha": "md5(coalesce(text, ''))",
    "source_exists": "doc_id % 10 <> 9",
    "kind": "CASE WHEN doc_id % 10 = 9 THEN NULL WHEN doc_id % 14 = 1 THEN 'folder' WHEN doc_id % 15 = 2 THEN 'unreadable' ELSE 'file' END",
    "sha_now": "CASE WHEN doc_id % 4 = 0 THEN 'changed' ELSE md5(coalesce(text, '')) END",
    "mirror_exists": "doc_id % 16 <> 15",
    "previous_mirror": "CASE doc_id % 6 WHEN 0 THEN 'gone/' || doc_id || '.md' ELSE '' END",
    "candidates": "CASE doc_id % 18 WHEN 0 THEN 'a' || doc_id || ';b;c;d;e;f;g' WHEN 1 THEN 'a;' ELSE '' END",
    "contract": "CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN '/abs' ELSE '_meta/lifecycle-states.yml' END",
    "contract_version": "CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN ' 2 ' ELSE '1' END",
    "lang": "lang",
}

REPOS = {
    "repo_id": "'repo_' || s_suppkey",
    "repo": "'org/' || s_name",
    "note": "'repos/' || s_suppkey || '.md'",
    "state": "CASE s_suppkey % 6 WHEN 0 THEN 'planned' WHEN 1 THEN 'stale' WHEN 2 THEN '' WHEN 3 THEN 'manual_modification' WHEN 4 THEN 'conflict' ELSE 'clean' END",
    "configured": "s_suppkey % 4 <> 0",
    "note_exists": "s_suppkey % 9 <> 0",
    "managed": "s_suppkey % 7 <> 0",
    "note_repo_id": "CASE WHEN s_suppkey % 5 = 0 THEN 'repo_x' ELSE 'repo_' || s_suppkey END",
    "note_type": "CASE WHEN s_suppkey % 8 = 0 THEN 'note' ELSE 'repo-mirror' END",
    "note_repo": "CASE s_suppkey % 11 WHEN 0 THEN '' WHEN 1 THEN 'org/else' ELSE 'org/' || s_name END",
    "has_sentinel": "s_suppkey % 10 <> 0",
    "warnings": "CASE s_suppkey % 3 WHEN 0 THEN 'Missing generated sentinel' ELSE '' END",
    "last_commit": "'c' || (s_suppkey % 13)",
    "note_commit": "'c' || (s_suppkey % 12)",
    "note_manifest": "CASE WHEN s_suppkey % 17 = 0 THEN 'other.json' ELSE '_meta/repo-manifest.json' END",
    "record_note": "CASE WHEN s_suppkey % 18 = 0 THEN 'repos/else.md' ELSE 'repos/' || s_suppkey || '.md' END",
    "resolved_repo": "CASE s_suppkey % 11 WHEN 1 THEN 'org/else' ELSE '' END",
    "source_type": "CASE WHEN s_suppkey % 3 = 1 THEN 'remote' ELSE 'local' END",
    "source_ref": "CASE WHEN s_suppkey % 14 = 3 THEN '../up' ELSE 'trees/' || s_suppkey END",
    "tree": "CASE s_suppkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'file' WHEN 2 THEN 'unreadable' ELSE 'folder' END",
    "tree_sha": "'c' || (s_suppkey % 13 + CASE WHEN s_suppkey % 5 = 0 THEN 1 ELSE 0 END)",
}

SOURCES = {"notes": ("documents", NOTES), "records": ("documents", RECORDS), "repos": ("supplier", REPOS)}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the workspace's frames."""
    source, columns = SOURCES[name]
    return table(spark, sf_dir, source).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def sql(name: str) -> str:
    """The same as a common table expression for DuckDB."""
    source, columns = SOURCES[name]
    return f"{name} AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + f" FROM {source})"
