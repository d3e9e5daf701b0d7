"""The command line over a workspace of files."""

import json

import pytest

from foliant import __main__ as command


@pytest.fixture
def root(tmp_path):
    top = tmp_path / "space"
    body = " ".join(f"term{k}" for k in range(40))
    texts = {
        "a/one.md": f"---\ntitle: Same plan\ntype: note\n---\n[[two]] [[nowhere]] {body}\n", "a/two.md": f"---\ntitle: Same plan\ntype: note\n---\n``[[lost]]`` {body}\n", "b/x.log": "log", "b/key.txt": "AKIA" + "A" * 16,
        ".gitignore": "*.log\n", "m.json": '{"records": [1]}',
    }
    for name, text in texts.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text(text)
    return top


def run(capsys, *arguments):
    code = command.main([str(a) for a in arguments])
    return code, capsys.readouterr().out


def test_workspace_commands(spark, root, tmp_path, capsys):
    assert (lambda r: r[0] == 1 and "nowhere" in r[1] and "lost" not in r[1])(run(capsys, "links", root))
    assert (lambda r: r[0] == 1 and "a/one.md" in r[1] and "a/two.md" not in r[1])(run(capsys, "orphans", root))
    assert (lambda r: r[0] == 1 and "a/two.md" in r[1])(run(capsys, "overlap", root))
    assert (lambda r: r[0] == 1 and "aws access key" in r[1])(run(capsys, "secrets", root))
    assert (lambda r: r[0] == 0 and "b/x.log" in r[1] and "key.txt" not in r[1])(run(capsys, "ignored", root))
    assert (lambda r: r[0] == 1 and "must be a mapping" in r[1])(run(capsys, "manifest", root / "m.json"))
    assert ".md" in run(capsys, "inventory", root)[1] and "b/key.txt" in run(capsys, "digests", root)[1]


def test_watch_reconcile_and_journal_commands(spark, root, tmp_path, capsys):
    own = tmp_path / "journal"
    assert "created" in run(capsys, "watch", root, own)[1]
    (root / "a/two.md").unlink()
    assert "deleted" in run(capsys, "watch", root, own)[1]
    records = tmp_path / "records.json"
    records.write_text(json.dumps({"path": "gone.md", "size": 1, "modified": 1, "sha": "x"}) + "\n")
    assert "gone.md" in run(capsys, "reconcile", root, records, own)[1]
    assert "queued" in run(capsys, "journal", own, "--do", "compact")[1]
