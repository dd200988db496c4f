"""The Git source against the git binary, where there is one."""

import os
import shutil
import subprocess

import pytest

from vhist.sources import gitrepo

pytestmark = pytest.mark.skipif(shutil.which("git") is None, reason="no git binary")


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    path = tmp_path_factory.mktemp("repo")
    env = os.environ | {f"GIT_{w}_{k}": v for w in ("AUTHOR", "COMMITTER") for k, v in (("NAME", "A B"), ("EMAIL", "a@x"))} | {"GIT_CONFIG_GLOBAL": "/dev/null", "HOME": str(path)}

    def git(*args, when=0):
        stamp = {"GIT_AUTHOR_DATE": f"{1700000000 + when} +0130", "GIT_COMMITTER_DATE": f"{1700000000 + when} -0700"}
        return subprocess.run(["git", *args], cwd=path, env=env | stamp, check=True, capture_output=True, text=True).stdout

    git("init", "-q", "-b", "main")
    (path / "d").mkdir()
    for n in range(6):
        (path / "d" / "file.txt").write_text("".join(f"line {k} {n if k == n else ''}\n" for k in range(400)))
        (path / f"f{n}").write_text(f"{n}")
        git("add", "-A")
        git("commit", "-q", "-m", f"commit {n}\n\nbody", when=n)
    git("checkout", "-q", "-b", "side", "HEAD~2")
    (path / "s").write_text("s")
    git("add", "-A")
    git("commit", "-q", "-m", "side", when=10)
    git("checkout", "-q", "main")
    git("merge", "-q", "--no-ff", "-m", "merge", "side", when=11)
    git("tag", "-a", "v1", "-m", "tag", when=12)
    git("repack", "-q", "-a", "-d", "-f", "--depth=20")
    git("pack-refs", "--all")
    (path / "late").write_text("late")
    git("add", "-A")
    git("commit", "-q", "-m", "late", when=13)
    return str(path), git


def test_objects(spark, repo):
    path, git = repo
    want = {tuple(x.split()) for x in git("cat-file", "--batch-check", "--batch-all-objects").splitlines()}
    found = gitrepo.objects(spark, path)
    assert {(x.oid, x.kind, str(x.size)) for x in found.drop("content").collect()} == want


def test_history(spark, repo):
    path, git = repo
    commits = gitrepo.commits(gitrepo.objects(spark, path)).collect()
    want = dict(x.split("|", 1) for x in git("log", "--all", "--format=%H|%T|%P|%an <%ae>|%at|%ct|%s").splitlines())
    assert {x.oid: f"{x.tree}|{' '.join(x.parents)}|{x.author}|{x.author_time}|{x.commit_time}|{x.message.splitlines()[0]}" for x in commits} == want
    assert {(x.author_offset_min, x.commit_offset_min) for x in commits} == {(90, -420)}
    assert not any(x.message_truncated for x in commits)


def test_files_and_references(spark, repo):
    path, git = repo
    found = gitrepo.objects(spark, path)
    tree = git("rev-parse", "HEAD^{tree}").strip()
    files = gitrepo.snapshot_files(gitrepo.tree_entries(found), spark.createDataFrame([("r", tree)], "root string, tree string"))
    want = {(x.split()[3], x.split()[2], x.split()[0]) for x in git("ls-tree", "-r", "HEAD").splitlines()}
    assert {(x.path, x.oid, f"{x.mode:06o}") for x in files.collect()} == want
    refs = {x.name: x.oid for x in gitrepo.references(spark, path).collect()}
    assert {tuple(x.split()) for x in git("show-ref", "--head").splitlines()} == {(v, k) for k, v in refs.items()}


def test_broken_deltas():
    with pytest.raises(gitrepo.GitError):
        gitrepo.patched(b"abc", b"\x04\x01\x01x")
    with pytest.raises(gitrepo.GitError):
        gitrepo.patched(b"abc", b"\x03\x05\x91\x02\x05")
    assert gitrepo.patched(b"abc", b"\x03\x05\x91\x01\x02\x03xyz") == b"bcxyz"


@pytest.fixture(scope="module")
def opened(spark, repo):
    from vhist.api import Repo

    return Repo.from_git(spark, repo[0])


def ordered(df, *cols):
    return [tuple(x[c] for c in cols) if len(cols) > 1 else x[cols[0]] for x in df.orderBy("pos").collect()]


def test_names_and_walks(opened, repo):
    _, git = repo
    for name in ("HEAD", "main", "v1", "side", "main~2", "main~1^2", "HEAD^{}", "@"):
        assert opened.resolve(name) == git("rev-parse", name + "^{commit}").strip()
    assert ordered(opened.rev_list("HEAD"), "oid") == git("rev-list", "HEAD").split()
    assert ordered(opened.rev_list("HEAD", first_parent=True, limit=3), "oid") == git("rev-list", "--first-parent", "-n", "3", "HEAD").split()
    assert ordered(opened.rev_list("side..main", reverse=True), "oid") == git("rev-list", "--reverse", "side..main").split()
    assert ordered(opened.merge_base("main~1", "side"), "oid") == git("merge-base", "--all", "main~1", "side").split()
    assert opened.is_ancestor("side", "main") and not opened.is_ancestor("main", "side")


def test_log_and_diff(opened, repo):
    _, git = repo
    assert "\n".join(ordered(opened.log("HEAD"), "text")) == git("log", "HEAD")
    assert ordered(opened.log("HEAD", ["f2", "s"]), "oneline") == git("log", "--oneline", "--abbrev=7", "HEAD", "--", "f2", "s").splitlines()
    assert ordered(opened.log("HEAD", limit=2), "oid") == git("log", "-n2", "--format=%H").split()
    assert {(x.status, x.path) for x in opened.diff("HEAD~4", "HEAD").collect()} == {tuple(x.split("\t")) for x in git("diff", "--no-renames", "--name-status", "HEAD~4", "HEAD").splitlines()}
    hunks = "@@ " + git("diff", "HEAD~5", "HEAD~3", "--", "d").split("\n@@ ", 1)[1]
    mine = opened.patch("HEAD~5", "HEAD~3", ["d"]).first().patch
    assert [x for x in mine.splitlines() if x[0] in "+-"] == [x for x in hunks.splitlines() if x[0] in "+-"]


def test_files_and_blame(opened, repo):
    _, git = repo
    assert opened.cat("HEAD", "d/file.txt").decode() == git("show", "HEAD:d/file.txt")
    want = {tuple(x.split(":", 2)) for x in git("grep", "-n", "line 3", "HEAD~1", "--", "d").replace("HEAD~1:", "").splitlines()}
    assert {(x.path, str(x.line_no), x.line) for x in opened.grep(["line 3"], "HEAD~1", ["d"]).collect()} == want
    blamed = {x.final_line: (x.oid, x.original_line) for x in opened.blame("HEAD", "d/file.txt").collect()}
    lines = [x.split() for x in git("blame", "--porcelain", "HEAD", "--", "d/file.txt").splitlines() if len(x.split()[0]) == 40 and x[0] != "\t"]
    assert blamed == {int(x[2]): (x[0], int(x[1])) for x in lines}
    assert {(x.author, x.n) for x in opened.shortlog("HEAD").collect()} == {("A B", 9)}
    assert {x.name for x in opened.branches().collect()} == {"main", "side"}
    assert {(x.oid, x.name) for x in opened.show_ref().collect()} == {tuple(x.split()) for x in git("show-ref").splitlines()}
    assert opened.switch("side") == git("rev-parse", "side").strip() and opened.switch("-") == git("rev-parse", "main").strip()
