"""Files by ranges: bytes read are bounded by what is asked for."""

import hashlib
import io
import zipfile

from foliant.sources import corpus, ranged


class Counted(io.FileIO):
    taken = 0

    def read(self, size=-1):
        block = super().read(size)
        Counted.taken += len(block)
        return block

    def readinto(self, buffer):
        n = super().readinto(buffer)
        Counted.taken += n
        return n


def test_an_archive_costs_its_directory_and_the_parts_asked_for(spark, tmp_path):
    big = tmp_path / "big.docx"
    with zipfile.ZipFile(big, "w", zipfile.ZIP_STORED) as archive:
        archive.writestr("word/media/film.bin", b"\0" * 150_000_000)
        archive.writestr("word/document.xml", "<w>One &amp; <b>two</b></w>")
        archive.writestr("word/huge.xml", b"x" * 5_000_000)
    with Counted(big) as file:
        rows = list(ranged.archive_rows(file, "big.docx", (".xml",), 1_000_000))
    assert [(r[1], " ".join((r[3] or "").split()), r[4]) for r in rows] == [("word/document.xml", "One & two", None), ("word/huge.xml", "", "part too large")]
    assert Counted.taken < 200_000
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    names = spark.createDataFrame([("big.docx",), ("bad.docx",), ("gone.docx",)], "path string")
    found = {(r.path, r.part, r.error) for r in ranged.archive_parts(names, str(tmp_path), (".xml",), 1_000_000).collect()}
    assert found == {("big.docx", "word/document.xml", None), ("big.docx", "word/huge.xml", "part too large"), ("bad.docx", None, "not a zip file"), ("gone.docx", None, "FileNotFoundError")}
    got = {r.path: (r.size, r.sha, r.error) for r in ranged.digests(names, str(tmp_path)).collect()}
    assert got["bad.docx"] == (6, hashlib.sha256(b"no zip").hexdigest(), None) and got["gone.docx"] == (None, None, "FileNotFoundError")
    assert got["big.docx"][:2] == (big.stat().st_size, hashlib.sha256(big.read_bytes()).hexdigest())
    assert {r.path: bytes(r.content or b"")[:2] for r in ranged.heads(names, str(tmp_path), 16).collect()} == {"big.docx": b"PK", "bad.docx": b"no", "gone.docx": b""}


def test_tree_digests_equal_the_hash_of_whole_contents(spark, tmp_path):
    rows = [("r1", "a", b"1"), ("r1", "d/b", b"22" * 5000), ("r2", "c", b""), ("r2", ".git/x", b"no")]
    for repo, path, body in rows:
        (tmp_path / repo / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / repo / path).write_bytes(body)
    tree = spark.createDataFrame(rows, "repo string, path string, content binary")
    assert sorted(ranged.tree_digests(tree, str(tmp_path)).collect()) == sorted(corpus.tree_sha(tree).collect())
