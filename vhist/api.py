"""A repository of history tables: names are resolved on the driver, everything else is a DataFrame."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vhist.functions import format as fmt
from vhist.functions import pathspec, textdiff
from vhist.operators import blame, graph, history, refs, search, shortlog, trees
from vhist.plans.materialize import materialized
from vhist.sources import gitrepo


class NotFound(LookupError):
    """A name that nothing fits."""


class Invalid(ValueError):
    """A question that can't be answered; nothing is returned in its place."""


@dataclass
class Repo:
    """Tables: commits (id, oid, tree, parents, author, email, time, offset, message), parents (child, ord, parent),
    entries (tree, name, oid, mode), blobs (oid, size, content), refs (name, id). Ids are object ids."""

    spark: SparkSession
    commits: DataFrame
    parents: DataFrame
    entries: DataFrame
    blobs: DataFrame
    refs: DataFrame
    head: str = "HEAD"
    before: str | None = field(default=None)

    @classmethod
    def from_git(cls, spark: SparkSession, path: str) -> Repo:
        """Import: objects are decoded once and stored."""
        found = materialized(gitrepo.objects(spark, path))
        raw = gitrepo.commits(found)
        who = F.regexp_extract("author", "^(.*) <([^<]*)>$", 1)
        commits = raw.select(
            F.col("oid").alias("id"), "oid", "tree", "parents", F.when(who == "", F.col("author")).otherwise(who).alias("author"),
            F.regexp_extract("author", "^(.*) <([^<]*)>$", 2).alias("email"), F.col("author").alias("identity"), F.col("commit_time").alias("time"),
            "author_time", F.col("author_offset_min").alias("offset"), "message",
        )
        commits = materialized(commits)
        tags = found.where("kind = 'tag'").select(F.col("oid").alias("tag"), F.regexp_extract(F.decode("content", "UTF-8"), "^object ([0-9a-f]{40})\n", 1).alias("to"))
        names = gitrepo.references(spark, path).join(tags, F.col("oid") == F.col("tag"), "left").select("name", F.coalesce("to", "oid").alias("id"), F.col("oid").alias("object_id"))
        blobs = found.where("kind = 'blob'").select("oid", "size", "content")
        return cls(spark, commits, commits.select(F.col("id").alias("child"), F.posexplode("parents").alias("ord", "parent")), materialized(gitrepo.tree_entries(found)), blobs, materialized(names))

    # Names

    def resolve(self, revision: str) -> str:
        """A commit id: a name, then any of ~n, ^n, ^{}, ^{commit}."""
        if not revision or re.search(r":|\s|\.\.|@\{", revision):
            raise Invalid(f"bad revision {revision!r}")
        m = re.fullmatch(r"(.+?)((?:~\d*|\^\d*|\^\{(?:commit)?\})*)", revision)
        name = self.head if m[1] in ("@", "HEAD") else m[1]
        name = name.rsplit("-g", 1)[1] if re.search(r"-g[0-9a-f]{4,40}$", name) else name
        asked = self.spark.createDataFrame([(name,)], "name string")
        got = refs.resolve(asked, self.refs, self.commits).collect()
        if not got:
            raise NotFound(revision)
        at = got[0].id
        for op, n in re.findall(r"(~|\^)(\{\w*\}|\d*)", m[2]):
            if n.startswith("{") or n == "0":
                continue
            start = self.spark.createDataFrame([(0, at)], "root long, node string")
            far = graph.nth_ancestor(start, self.parents, int(n or 1)) if op == "~" else graph.nth_parent(start, self.parents, int(n or 1))
            row = far.first()
            if row is None:
                raise NotFound(revision)
            at = row.node
        return at

    def tips(self, *revisions: str) -> DataFrame:
        return self.spark.createDataFrame([(0, self.resolve(r)) for r in revisions], "root int, node string")

    def switch(self, revision: str) -> str:
        """Make another commit current; `-` goes back."""
        to = self.before if revision == "-" else self.resolve(revision)
        if to is None:
            raise NotFound(revision)
        self.before, self.head = self.resolve("HEAD"), to
        return to

    def status(self) -> DataFrame:
        return self.commits.where(F.col("id") == self.resolve("HEAD")).select("oid", "tree", F.lit(True).alias("clean"))

    # Graph

    def reached(self, revisions: list[str], first_parent: bool = False) -> DataFrame:
        """What positive revisions reach and `^x` ones don't; `a..b` is `^a b`, an empty side is HEAD."""
        plus, minus = [], []
        for r in revisions:
            if "..." in r:
                raise Invalid("three dots aren't supported")
            if ".." in r:
                a, b = r.split("..", 1)
                minus.append(a or "HEAD")
                plus.append(b or "HEAD")
            else:
                (minus if r.startswith("^") else plus).append(r.lstrip("^"))
        found = graph.closure(self.tips(*plus), self.parents, first_parent)
        return found if not minus else found.join(graph.closure(self.tips(*minus), self.parents), ["root", "node"], "left_anti")

    def rev_list(self, *revisions: str, first_parent: bool = False, limit: int | None = None, reverse: bool = False) -> DataFrame:
        """(oid, pos) in the exact order of the walk."""
        found = materialized(self.reached(list(revisions), first_parent))
        given = [self.resolve(r.split("..")[-1] or "HEAD") for r in revisions if not r.startswith("^")]
        starts = self.spark.createDataFrame([(0, n, k) for k, n in enumerate(given)], "root int, node string, k int")
        edges = self.parents.where("ord = 0") if first_parent else self.parents
        rows = graph.walk(found, starts, edges, self.commits, limit).select(F.col("node").alias("oid"), "pos")
        if reverse:
            last = rows.agg(F.max("pos").alias("last"))
            rows = rows.crossJoin(F.broadcast(last)).select("oid", (F.col("last") + 1 - F.col("pos")).alias("pos"))  # one row on the right
        return rows

    def merge_base(self, a: str, b: str) -> DataFrame:
        pair = self.spark.createDataFrame([(0, self.resolve(a), self.resolve(b))], "pair int, a string, b string")
        return graph.merge_bases(pair, self.parents, self.commits).select(F.col("node").alias("oid"), "pos")

    def is_ancestor(self, a: str, b: str) -> bool:
        pair = self.spark.createDataFrame([(0, self.resolve(a), self.resolve(b))], "pair int, a string, b string")
        return graph.is_ancestor(pair, self.parents).first().yes

    # Trees and files

    def tree(self, revision: str) -> DataFrame:
        return self.commits.where(F.col("id") == self.resolve(revision)).select(F.lit(0).alias("root"), "tree")

    def ls_files(self, revision: str = "HEAD", specs: list[str] | None = None) -> DataFrame:
        files = gitrepo.snapshot_files(self.entries, self.tree(revision)).drop("root")
        return files.where(pathspec.compile_specs(specs or [], F.col("path")))

    def ls_tree(self, revision: str = "HEAD") -> DataFrame:
        own = self.entries.join(self.tree(revision), "tree")
        kind = F.when(F.col("mode") == trees.DIRECTORY, "tree").when(F.col("mode") == 0o160000, "commit").otherwise("blob")
        return own.select(fmt.octal_mode(F.col("mode")).alias("mode"), kind.alias("kind"), "oid", "name")

    def cat(self, revision: str, path: str) -> bytes:
        """One file's bytes."""
        found = trees.entry_at(self.entries, self.tree(revision), path)
        row = found.where(F.col("mode") != trees.DIRECTORY).join(self.blobs, "oid").first()
        if row is None:
            raise NotFound(path)
        return bytes(row.content)

    def read(self, revision: str, path: str, offset: int, length: int) -> bytes:
        """Some bytes of a file; only these leave Spark."""
        found = trees.entry_at(self.entries, self.tree(revision), path).where(F.col("mode") != trees.DIRECTORY)
        row = found.join(self.blobs, "oid").select(trees.blob_range(F.col("content"), offset, length).alias("part")).first()
        if row is None:
            raise NotFound(path)
        return bytes(row.part)

    def object(self, selector: str) -> tuple[str, str]:
        """(oid, kind) of `REV`, `REV:path` (`REV:` is the tree), `REV^{tree}` or `REV^{blob}` (refused for what isn't a blob)."""
        revision, colon, path = selector.partition(":")
        want = re.search(r"\^\{(tree|blob)\}$", selector)
        if want and not colon:
            revision = selector[: want.start()]
            path, colon = "", ":"
        if not colon:
            return self.resolve(revision), "commit"
        row = trees.entry_at(self.entries, self.tree(revision or "HEAD"), path).first()
        if row is None:
            raise NotFound(selector)
        kind = "tree" if row["mode"] == trees.DIRECTORY else "commit" if row["mode"] == 0o160000 else "blob"
        if want and want[1] != kind:
            raise Invalid(f"{selector!r} is a {kind}")
        return row.oid, kind

    def arguments(self, given: list[str]) -> tuple[list[str], list[str]]:
        """Revisions and pathspecs of a command line: `--` parts them; without it names are revisions until one isn't, and the rest have to
        look like pathspecs or be there."""
        if "--" in given:
            at = given.index("--")
            return given[:at], given[at + 1 :]
        revisions: list[str] = []
        for k, name in enumerate(given):
            try:
                for end in name.lstrip("^").split(".."):
                    self.resolve(end or "HEAD")
                revisions.append(name)
            except (NotFound, Invalid):
                for spec in given[k:]:
                    if not pathspec.looks_like_pathspec(spec) and not self.exists(spec):
                        raise Invalid(f"{spec!r} is neither a revision nor a path") from None
                return revisions, given[k:]
        return revisions, []

    def exists(self, spec: str, revision: str = "HEAD") -> bool:
        """Whether a specification matches anything in a snapshot."""
        return not self.ls_files(revision, [spec]).isEmpty()

    def files_text(self, revision: str, specs: list[str] | None = None) -> DataFrame:
        files = self.ls_files(revision, specs).where(F.floor(F.col("mode") / 0o10000) == 8)
        return files.join(self.blobs, "oid").where(~search.is_binary_bytes(F.col("content"))).select("path", search.as_text(F.col("content")).alias("content"))

    def grep(self, patterns: list[str], revision: str = "HEAD", specs: list[str] | None = None, **options: bool) -> DataFrame:
        return search.grep(self.files_text(revision, specs), patterns, **options)

    # Differences and history

    def changes(self, old: str | None, new: str, specs: list[str] | None = None) -> DataFrame:
        trees_ = self.tree(new).withColumnRenamed("tree", "new_tree")
        if old is None:
            trees_ = trees_.withColumn("old_tree", F.lit(None).cast("string"))
        else:
            trees_ = trees_.join(self.tree(old).withColumnRenamed("tree", "old_tree"), "root")
        found = trees.changed_paths(self.entries, trees_, ["root"]).drop("root")
        return found.where(pathspec.compile_specs(specs or [], F.col("path")))

    def diff(self, old: str | None, new: str, specs: list[str] | None = None) -> DataFrame:
        """(path, status)."""
        return self.changes(old, new, specs).select("path", trees.status_of().alias("status"))

    def patch(self, old: str | None, new: str, specs: list[str] | None = None) -> DataFrame:
        """(path, status, patch): hunks with three lines around them; null for binary files."""
        rows = self.changes(old, new, specs).withColumn("status", trees.status_of())
        text = self.blobs.select("oid", F.when(search.is_binary_bytes(F.col("content")), F.lit("\0")).otherwise(search.as_text(F.col("content"))).alias("text"))
        rows = rows.join(text.withColumnsRenamed({"oid": "old_oid", "text": "a"}), "old_oid", "left").join(text.withColumnsRenamed({"oid": "new_oid", "text": "b"}), "new_oid", "left")
        empty = lambda c: F.coalesce(F.col(c), F.lit(""))
        binary = search.is_binary(empty("a")) | search.is_binary(empty("b"))
        return rows.select("path", "status", F.when(~binary, textdiff.unified_diff(empty("a"), empty("b"))).alias("patch"))

    def renames(self, old: str, new: str) -> DataFrame:
        """(old, new) of exact renames."""
        rows = self.changes(old, new)
        gone = rows.where("new_oid IS NULL").select("path", F.col("old_oid").alias("oid"))
        come = rows.where("old_oid IS NULL").select("path", F.col("new_oid").alias("oid"))
        return search.exact_renames(gone, come)

    def path_changes(self, specs: list[str], reached: DataFrame | None = None) -> DataFrame:
        """(child, ord) where matching paths differ; ord -1 for roots that hold one. Only of the commits reached, if these are given."""
        t = self.commits.select("id", "tree")
        if reached is not None:
            t = t.join(reached.select(F.col("node").alias("id")).distinct(), "id", "left_semi")
        pairs = self.parents.join(t.withColumnsRenamed({"id": "child", "tree": "new_tree"}), "child").join(t.withColumnsRenamed({"id": "parent", "tree": "old_tree"}), "parent", "left")
        roots = t.join(self.parents.select(F.col("child").alias("id")), "id", "left_anti").select(F.col("id").alias("child"), F.lit(-1).alias("ord"), F.lit(None).cast("string").alias("old_tree"), F.col("tree").alias("new_tree"))
        pairs = pairs.select("child", "ord", "old_tree", "new_tree").unionByName(roots)
        found = trees.changed_paths(self.entries, pairs, ["child", "ord"])
        return found.where(pathspec.compile_specs(specs, F.col("path"))).select("child", "ord").distinct()

    def log(self, revision: str = "HEAD", specs: list[str] | None = None, limit: int | None = None, first_parent: bool = False) -> DataFrame:
        """(pos, oid, text, oneline): newest first; display columns are joined after the limit."""
        start = self.tips(revision)
        edges = self.parents.where("ord = 0") if first_parent else self.parents
        found = materialized(graph.closure(start, edges))
        walked = graph.walk(found, start, edges, self.commits, None if specs else limit)
        if specs:
            shown = history.predicate_log(start, self.parents, materialized(self.path_changes(specs, found)), first_parent)
            walked = walked.join(shown, ["root", "node"], "left_semi")
        rows = walked.orderBy("pos").limit(limit) if limit is not None else walked
        c = self.commits.withColumnRenamed("id", "node")
        text = fmt.medium_log(F.col("oid"), F.col("parents"), F.col("identity"), F.col("author_time"), F.col("offset"), F.col("message"))
        one = F.concat(F.substring("oid", 1, 7), F.lit(" "), fmt.oneline_subject(F.col("message")))
        return rows.join(c, "node").select("pos", "oid", text.alias("text"), one.alias("oneline"))

    def show(self, revision: str) -> tuple[DataFrame, DataFrame]:
        """The commit as a log shows it, and its patch against the first parent."""
        at = self.resolve(revision)
        first = self.parents.where((F.col("child") == at) & (F.col("ord") == 0)).first()
        return self.log(at, limit=1), self.patch(first.parent if first else None, at)

    def blame(self, revision: str, path: str, first: int = 1, last: int | None = None) -> DataFrame:
        """(final_line, oid, original_line, boundary, content, group_lines, previous) of a range of lines."""
        start = self.tips(revision)
        found = graph.closure(start, self.parents).select("node").join(self.commits.select(F.col("id").alias("node"), "tree"), "node")
        at = found
        parts = path.split("/")
        for k, part in enumerate(parts):  # one equal-key join a directory, not a whole snapshot of every commit
            step = self.entries.where(F.col("name") == part).select("tree", F.col("oid").alias("to"), "mode")
            at = at.join(step, "tree").where(F.col("mode") == trees.DIRECTORY if k < len(parts) - 1 else F.floor(F.col("mode") / 0o10000) == 8).select("node", F.col("to").alias("tree"))
        files = at.join(self.blobs, F.col("tree") == F.col("oid")).select("node", search.as_text(F.col("content")).alias("content"))
        files = materialized(files)
        rows = blame.previous(blame.with_groups(blame.blame(start, files, self.parents)), files, self.parents)
        rows = blame.in_range(rows, first, last)
        return rows.select("final_line", F.col("node").alias("oid"), "original_line", "boundary", "content", "group_lines", "previous")

    def shortlog(self, *revisions: str, with_email: bool = False, no_merges: bool = False, by_count: bool = False) -> DataFrame:
        rows = self.reached(list(revisions) or ["HEAD"]).select(F.col("node").alias("id")).distinct().join(self.commits, "id")
        merges = self.parents.where("ord = 1").select(F.col("child").alias("id")) if no_merges else None
        return shortlog.ordered(shortlog.counts(rows, with_email, merges), by_count)

    def branches(self, pattern: str | None = None) -> DataFrame:
        return refs.listing(self.refs, self.commits.withColumn("subject", fmt.oneline_subject(F.col("message"))), "refs/heads/", pattern)

    def show_ref(self, patterns: list[str] | None = None) -> DataFrame:
        found = self.refs.where("name <> 'HEAD'")
        return (refs.with_suffix(found, patterns) if patterns else found).select(F.col("object_id").alias("oid"), "name")

    def rev_parse(self, *names: str) -> DataFrame:
        """(name, id, state); `ambiguous` names give no id."""
        return refs.rev_parse(self.spark.createDataFrame([(n,) for n in names], "name string"), self.refs, self.commits)
