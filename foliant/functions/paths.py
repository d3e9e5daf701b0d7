"""Column functions over paths that are relative to a workspace: parts, exclusion rules by reader, roots, names, mirrors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names and prefixes of places that hold no content, by the reader that leaves them out.
ARCHIVED = ["_archive", "_backup", "_deprecated"]
RESERVED = [".git", ".githooks", ".github", ".obsidian", "_archive", "_fixtures", "_meta", "_mirrors", "_templates", "_tmp", "node_modules", "tools"]
EXCLUDED = {
    "office": ["_mirrors", "_templates", "_tmp", "tools", "node_modules"],
    "overlap": ["_fixtures", "_meta", "_templates", "_tmp", "tools", "node_modules"],
    "lint": ["_fixtures", "_meta", "_templates", "_tmp", "tools", "node_modules"],
    "catalog": [*RESERVED, "__pycache__"],
    "migration": RESERVED,
    "handoff": [".git", ".github", ".githooks", ".obsidian", "_archive", "_fixtures", "_meta", "_templates", "_tmp", "node_modules", "tools"],
    "sandbox": [".git", ".github", ".githooks", ".obsidian", "_archive", "_fixtures", "_meta", "_mirrors", "_templates", "_tmp", "node_modules", "tools"],
    "pilot": [".git", ".github", ".githooks", ".obsidian", "_fixtures", "_meta", "_mirrors", "_templates", "_tmp", "node_modules", "tools"],
    "change": [".git", ".githooks", ".github", ".obsidian", "_meta", "_templates", "_tmp", "node_modules", "template", "templates", "tools"],
    "recovery": ["_templates", "_tmp", "tools", "node_modules", ".git"],
    "curated": [".git", ".github", ".githooks", "_fixtures", "_meta", "_mirrors", "_templates", "_tmp", "node_modules", "tools"],
}
#: Readers for which a hidden part, and an archive prefix, excludes too.
HIDDEN_EXCLUDES = ["office", "lint", "catalog", "migration"]
ARCHIVE_EXCLUDES = ["office", "overlap", "lint", "change"]
GENERATED_CATALOGS = ["CATALOG.md", "CATALOG.html"]
STRUCTURAL_NOTES = ["AGENTS.md", "CLAUDE.md", "INDEX.md", "RETENTION.md", "CATALOG.md", "log.md"]
#: Suffixes of sources, of which pdf only on demand; names that may be sensitive; formats that convert badly.
OFFICE_SUFFIXES = [".docx", ".pptx", ".xlsx", ".doc"]
PDF_SUFFIXES = [".pdf"]
SENSITIVE_PARTS = ["secret", "credential", "password", "token", "private", "confidential", "payroll", "passport", "sin", "ssn", "tax-return", "bank-statement"]
RISKY_SUFFIXES = [".xlsx", ".pptx", ".pdf", ".doc"]
LARGE_BYTES = 25_000_000
#: Names of files that are being written.
TEMP_PREFIXES = ["~$", ".~", ".#"]
TEMP_SUFFIXES = [".tmp", ".swp", ".swx"]
STATE_FOLDER = ".state"


def parts(path: Column) -> Column:
    """The parts between slashes, empty ones left out."""
    return F.filter(F.split(path, "/"), lambda p: p != "")


def name(path: Column) -> Column:
    """The last part."""
    return F.element_at(F.split(path, "/"), -1)


def folders(path: Column) -> Column:
    """All parts but the last."""
    return F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))


def suffix(path: Column) -> Column:
    """Lower-case suffix of the last part, with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def without_suffix(path: Column) -> Column:
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", "")


def extensions(pdf: bool = False) -> list[str]:
    """Suffixes of sources by configuration."""
    return OFFICE_SUFFIXES + (PDF_SUFFIXES if pdf else [])


def under(path: Column, folder: Column) -> Column:
    """Whether a path is a folder or below it, by whole parts."""
    return (path == folder) | path.startswith(F.concat(folder, F.lit("/")))


def under_any(path: Column, roots: list[str]) -> Column:
    """Whether a path is below one of a configuration's folders."""
    found = F.lit(False)
    for root in roots:
        found |= under(path, F.lit(root))
    return found


def starts_with_any(value: Column, prefixes: list[str]) -> Column:
    found = F.lit(False)
    for prefix in prefixes:
        found |= value.startswith(prefix)
    return found


def excluded(path: Column, reader: str = "office", mirror_root: str = "_mirrors") -> Column:
    """Whether a reader leaves a place out; each has its own names and rules."""
    bad = F.exists(parts(path), lambda p: p.isin(EXCLUDED[reader]))
    if reader in HIDDEN_EXCLUDES:
        bad |= F.exists(parts(path), lambda p: p.startswith("."))
    if reader in ARCHIVE_EXCLUDES:
        bad |= F.exists(parts(path), lambda p: starts_with_any(p, ARCHIVED))
    if reader in ("office", "catalog", "handoff", "pilot", "sandbox"):
        bad |= under(path, F.lit(mirror_root))
    if reader == "catalog":
        bad |= path.isin(GENERATED_CATALOGS)
    return bad


def safe_relative(path: Column) -> Column:
    """The path without blanks-only, absolute or upward ones, which give the empty text."""
    bad = (F.trim(path) == "") | path.startswith("/") | F.exists(F.split(path, "/"), lambda p: p == "..")
    return F.when(~F.coalesce(bad, F.lit(True)), F.array_join(F.filter(F.split(path, "/"), lambda p: ~p.isin("", ".")), "/")).otherwise("")


def normalized(path: Column) -> Column:
    """Forward slashes, no blanks at the ends; null if empty, absolute, with `.` or `..` parts, or in the state folder."""
    clean = F.trim(F.translate(path, "\\", "/"))
    bad = (clean == "") | clean.startswith("/") | F.exists(F.split(clean, "/"), lambda p: p.isin("", ".", "..")) | (F.split(clean, "/")[0] == STATE_FOLDER)
    return F.when(~bad, clean)


def ignored_reason(path: Column, mirror_root: str = "_mirrors", repo_roots: tuple[str, ...] = ("repos",)) -> Column:
    """The first reason for which a change is not looked at; null if there is none."""
    last = name(path)
    temporary = starts_with_any(last, TEMP_PREFIXES) | F.exists(F.array(*map(F.lit, TEMP_SUFFIXES)), lambda s: F.endswith(last, s))
    return (
        F.when(normalized(path).isNull(), "unsafe-path")
        .when(under(path, F.lit(mirror_root)), "office-mirror")
        .when(under_any(path, list(repo_roots)), "repo-mirror")
        .when(excluded(path, "change"), "operational")
        .when(temporary, "temporary")
    )


def risk_warnings(path: Column, size: Column) -> Column:
    """Warnings for a sensitive name (the first only), a format that converts badly, and a large file."""
    low = F.lower(path)
    named = F.coalesce(*[F.when(low.contains(p), F.lit(f"sensitive-name:{p}")) for p in SENSITIVE_PARTS])
    kind = F.when(suffix(path).isin(RISKY_SUFFIXES), F.concat(F.lit("format:"), suffix(path)))
    return F.filter(F.array(named, kind, F.when(size > LARGE_BYTES, F.lit("large-file"))), lambda w: w.isNotNull())


def first_folder(path: Column) -> Column:
    """The first part of a path that has a folder, else empty."""
    return F.when(F.size(F.split(path, "/")) > 1, F.split(path, "/")[0]).otherwise("")


def domain_of(path: Column, routed: Column | None = None) -> Column:
    """The domain that a routing has for the first folder, else that folder without a number prefix."""
    own = F.regexp_replace(first_folder(path), r"^\d{2}_(?=.)", "")
    return own if routed is None else F.coalesce(routed, own)


def canonical_source(path: Column, folder: Column) -> Column:
    """The path with its first part replaced by the canonical folder, if there is one."""
    return F.when(folder.isNotNull(), F.concat(folder, F.regexp_replace(path, "^[^/]*", ""))).otherwise(path)


def mirror_record_path(path: Column, root: str = "_mirrors", dedicated: bool = True) -> Column:
    """Where the mirror of a source lies: under the root, or next to it."""
    note = F.concat(without_suffix(path), F.lit(".md"))
    return F.concat(F.lit(root + "/"), note) if dedicated else note


def fallback_mirror(mirror: Column) -> Column:
    """The mirror's place if a hand-written note has the preferred one."""
    return F.regexp_replace(mirror, r"\.md$", ".mirror.md")


def mirror_path(path: Column, taken: Column, root: str = "_mirrors", dedicated: bool = True) -> Column:
    """The mirror's place; `taken` tells that a note which is no mirror is there."""
    preferred = mirror_record_path(path, root, dedicated)
    return F.when(taken, fallback_mirror(preferred)).otherwise(preferred)


def is_repository_doc(path: Column) -> Column:
    """Readme files and Markdown at the top, and Markdown below the folders for documentation."""
    low = F.lower(path)
    top = ~path.contains("/")
    return F.when(top, low.startswith("readme") | low.endswith(".md")).otherwise(starts_with_any(low, ["docs/", "doc/", ".github/"]) & low.endswith(".md"))


def docs_order(path: Column) -> list[Column]:
    """Readme files first, then by lower-case path."""
    return [(~name(F.lower(path)).startswith("readme")).cast("int"), F.lower(path)]
