import os
import subprocess

from skarn.sources import worktree


def fill(root):
    os.makedirs(root / "src dir")
    for name, data in {".env": b"export KEY=abc\nnote", "src dir/a.py": "é = 1\n".encode(), "_b.txt": b"", "c.pem": b"x", "d.bin": b"0\na\0b", "e.bin": b"\xff", "zero.txt": b"0\n0", "big.txt": b"x" * 50, "skip.log": b"log", ".gitignore": b"*.log\n"}.items():
        (root / name).write_bytes(data)
    os.symlink(root / "_b.txt", root / "link.txt")


def test_worktree_reads_hidden_names_and_says_why_files_are_skipped(spark, tmp_path):
    fill(tmp_path)
    got = {r["path"]: r for r in worktree.read_worktree(spark, str(tmp_path), ["*.gitignore"], most=40).collect()}
    assert set(got) == {".env", "src dir/a.py", "_b.txt", "c.pem", "d.bin", "e.bin", "zero.txt", "big.txt", "skip.log"}
    assert got[".env"]["content"] == "export KEY=<redacted>\n" and got["src dir/a.py"]["content"] == "é = 1\n" and got["_b.txt"]["content"] == ""
    assert {p for p, r in got.items() if r["reason"]} == {"c.pem", "d.bin", "e.bin", "big.txt"}
    assert all((r["content"] is None) == bool(r["reason"]) for r in got.values())


def test_listing_follows_git(tmp_path):
    fill(tmp_path)
    assert "skip.log" in [p for p, *_ in worktree.listing(str(tmp_path))]
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    assert [p for p, *_ in worktree.listing(str(tmp_path))] == [".env", ".gitignore", "_b.txt", "big.txt", "c.pem", "d.bin", "e.bin", "src dir/a.py", "zero.txt"]


def test_empty_worktree(spark, tmp_path):
    assert worktree.read_worktree(spark, str(tmp_path)).count() == 0
