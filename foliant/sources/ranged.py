"""Files read by ranges: digests by chunks, heads, single parts of archives after their directory, trees file by file.

Tasks get names and read what they need from the store themselves, so a file of any size costs a task one chunk, and an
archive its directory and the parts asked for.  A file that cannot be read is a row with an error, never a failed job.
"""

from __future__ import annotations

import hashlib
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from html import unescape
from typing import BinaryIO

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame

from foliant.streaming.feed import store

CHUNK, HEAD = 4 << 20, 4096
#: Bytes of a part at most; a larger one is told, not cut.
PART_BYTES = 64 << 20


def chunks(file: BinaryIO, size: int = CHUNK) -> Iterator[bytes]:
    while block := file.read(size):
        yield block


def _each(paths: DataFrame, root: str, fn: Callable[[pafs.FileSystem, str, str], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows that a function (file system, place, path) gives for each file; a failure is one row of nulls with its error."""
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, top = store(root)
        for batch in batches:
            for path in batch["path"]:
                rows = []
                try:
                    for row in fn(files, posixpath.join(top, path), path):
                        rows.append(row)
                        if sum(len(x) for x in row if isinstance(x, (str, bytes))) > CHUNK or len(rows) >= 1_000:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
                except (OSError, zipfile.BadZipFile, EOFError, RuntimeError, ValueError, NotImplementedError) as e:
                    rows.append((path, *[None] * (len(names) - 2), "not a zip file" if isinstance(e, zipfile.BadZipFile) else type(e).__name__))
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return paths.select("path").mapInPandas(run, schema)


def digests(paths: DataFrame, root: str) -> DataFrame:
    """path, size and sha of every file (path) below a root, read in chunks; error if it cannot be read."""

    def one(files: pafs.FileSystem, place: str, path: str) -> Iterator[tuple]:
        own, size = hashlib.sha256(), 0
        with files.open_input_stream(place) as file:
            for block in chunks(file):
                own.update(block)
                size += len(block)
        yield path, size, own.hexdigest(), None

    return _each(paths, root, one, "path string, size long, sha string, error string")


def heads(paths: DataFrame, root: str, size: int = HEAD) -> DataFrame:
    """path and the first bytes of every file, and no more of it."""

    def one(files: pafs.FileSystem, place: str, path: str) -> Iterator[tuple]:
        with files.open_input_file(place) as file:
            yield path, file.read_at(min(size, file.size()), 0), None

    return _each(paths, root, one, "path string, content binary, error string")


def archive_rows(file: BinaryIO, path: str, suffixes: tuple[str, ...], most: int) -> Iterator[tuple]:
    """(path, part, size, text, error) of an archive's parts by suffix: the directory at its end first, then those parts alone."""
    with zipfile.ZipFile(file) as archive:
        for part in archive.infolist():
            if part.is_dir() or not part.filename.endswith(suffixes):
                continue
            if part.file_size > most:
                yield path, part.filename, part.file_size, None, "part too large"
                continue
            with archive.open(part) as inner:
                body = inner.read(most + 1)  # what the directory says of a part's size may be wrong
            if len(body) > most:
                yield path, part.filename, part.file_size, None, "part too large"
            else:
                yield path, part.filename, len(body), unescape(re.sub(r"<[^>]*>", " ", body.decode("utf-8", "replace"))), None


def archive_parts(paths: DataFrame, root: str, suffixes: tuple[str, ...] = (".xml", ".rels", ".txt", ".csv"), most: int = PART_BYTES) -> DataFrame:
    """Text parts of zipped office files: path, part, size, text, error."""

    def one(files: pafs.FileSystem, place: str, path: str) -> Iterator[tuple]:
        with files.open_input_file(place) as file:
            if file.size() < 22:  # the shortest directory
                raise zipfile.BadZipFile
            yield from archive_rows(file, path, suffixes, most)

    return _each(paths, root, one, "path string, part string, size long, text string, error string")


def tree_digests(tree: DataFrame, root: str) -> DataFrame:
    """One hash of each repository's files (repo, path), as `corpus.tree_sha`: a task gets the names and reads the files one after another, in chunks."""

    def digest(group: pd.DataFrame) -> pd.DataFrame:
        files, top = store(root)
        own = hashlib.sha256()
        for path in sorted(group["path"]):
            own.update(path.encode() + b"\0")
            with files.open_input_stream(posixpath.join(top, group["repo"].iloc[0], path)) as file:
                for block in chunks(file):
                    own.update(block)
            own.update(b"\0")
        return pd.DataFrame({"repo": [group["repo"].iloc[0]], "sha": ["local-" + own.hexdigest()[:40]]})

    return tree.where("path not like '%.git/%'").select("repo", "path").groupBy("repo").applyInPandas(digest, "repo string, sha string")
