"""Snapshots, listings and two-snapshot differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vhist.plans.materialize import materialized

DIRECTORY = 0o040000


def snapshot(reached: DataFrame, commits: DataFrame, touches: DataFrame) -> DataFrame:
    """(root, path, value): the latest value of each path among the commits that a root reaches along first parents."""
    timed = reached.join(commits.select(F.col("id").alias("node"), "seq"), "node")
    written = timed.join(touches.withColumnRenamed("id", "node"), "node")
    return written.groupBy("root", "path").agg(F.max_by("value", "seq").alias("value"))


def two_snapshots(reached: DataFrame, commits: DataFrame, touches: DataFrame) -> DataFrame:
    """(root, path, old, new): the snapshots of `old` and `new` commits of each root side by side, from one pass over the writes. ``reached``
    has (root, node, old, new), the last two true where that side reaches the commit."""
    timed = reached.join(commits.select(F.col("id").alias("node"), "seq"), "node")
    written = timed.join(touches.withColumnRenamed("id", "node"), "node").select("root", "path", "value", "seq", "old", "new")
    # Dealt before it is grouped, so that rows are sorted once.
    dealt = written.repartition("root", "path").groupBy("root", "path")
    side = lambda c: F.max_by("value", F.when(F.col(c), F.col("seq"))).alias(c)
    return dealt.agg(side("old"), side("new"))


def name_status(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, status): A, D or M for every path whose value differs. Equal values never leave the join."""
    a = before.withColumnRenamed("value", "old")
    b = after.withColumnRenamed("value", "new")
    return statuses(a.join(b, keys, "full_outer"), keys)


def statuses(both: DataFrame, keys: list[str]) -> DataFrame:
    """The same of rows that have both values, `old` and `new`."""
    both = both.where(~F.col("old").eqNullSafe(F.col("new")))
    status = F.when(F.col("old").isNull(), "A").when(F.col("new").isNull(), "D").otherwise("M")
    return both.select(*keys, status.alias("status"))


def below(path: Column, only: list[str]) -> Column:
    """A literal path filter: the file itself, or the directory's files."""
    hit = F.lit(False)
    for p in only:
        hit = hit | (path == p) | path.startswith(p.rstrip("/") + "/")
    return hit


def ls_tree(files: DataFrame, directory: str = "") -> DataFrame:
    """(name, kind, pos): the entries of one directory, in tree order (directories compare with a slash at their end)."""
    prefix = directory.rstrip("/") + "/" if directory else ""
    own = files.where(F.col("path").startswith(prefix)).select(F.expr(f"substring(path, {len(prefix) + 1})").alias("rest"))
    entry = own.select(F.substring_index("rest", "/", 1).alias("name"), F.when(F.contains("rest", F.lit("/")), "tree").otherwise("blob").alias("kind")).distinct()
    key = F.when(F.col("kind") == "tree", F.concat("name", F.lit("/"))).otherwise(F.col("name"))
    # One directory's entries, however many files lie below them.
    return entry.withColumn("pos", F.row_number().over(Window.orderBy(key)).cast("long"))


def page(files: DataFrame, after: str, limit: int) -> DataFrame:
    """Keyset paging: the next paths after a cursor."""
    return files.where(F.col("path") > after).orderBy("path").limit(limit)


def changed_paths(entries: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, old_oid, old_mode, new_oid, new_mode) of the files that differ between `old_tree` and `new_tree` of each
    pair (either may be null). One join a level of directories; equal subtrees are never opened. A file that a directory
    replaces is a deletion and additions."""
    level = materialized(pairs.where("NOT old_tree <=> new_tree").select(*keys, "old_tree", "new_tree", F.lit("").alias("prefix")))
    found = []
    side = lambda of, a: level.join(
        entries.select(F.col("tree").alias(f"{of}_tree"), "name", F.col("oid").alias(f"{a}o"), F.col("mode").alias(f"{a}m")), f"{of}_tree"
    ).select(*keys, "prefix", "name", f"{a}o", f"{a}m")
    while not level.isEmpty():
        both = side("old", "o").join(side("new", "n"), [*keys, "prefix", "name"], "full_outer")
        both = materialized(both.where("NOT (oo <=> no AND om <=> nm)").withColumn("path", F.concat("prefix", "name")))
        file = lambda a, c: F.when(F.col(f"{a}m") != DIRECTORY, F.col(f"{a}{c}"))
        files = both.select(*keys, "path", file("o", "o").alias("old_oid"), file("o", "m").alias("old_mode"), file("n", "o").alias("new_oid"), file("n", "m").alias("new_mode"))
        found.append(files.where("old_oid IS NOT NULL OR new_oid IS NOT NULL"))
        tree = lambda a: F.when(F.col(f"{a}m") == DIRECTORY, F.col(f"{a}o"))
        below_ = both.select(*keys, tree("o").alias("old_tree"), tree("n").alias("new_tree"), F.concat("path", F.lit("/")).alias("prefix"))
        level = materialized(below_.where("old_tree IS NOT NULL OR new_tree IS NOT NULL"))
    if not found:
        return level.select(*keys, F.col("prefix").alias("path"), F.col("old_tree").alias("old_oid"), F.lit(0).alias("old_mode"), F.col("new_tree").alias("new_oid"), F.lit(0).alias("new_mode")).limit(0)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def status_of(old: str = "old", new: str = "new") -> Column:
    """A, D, T (another kind of file) or M."""
    kind = lambda c: F.floor(F.col(c) / 0o10000)
    return (
        F.when(F.col(f"{old}_oid").isNull(), "A").when(F.col(f"{new}_oid").isNull(), "D").when(kind(f"{old}_mode") != kind(f"{new}_mode"), "T").otherwise("M")
    )


def blob_range(content: Column, offset: int, length: int) -> Column:
    """Bytes of a file from ``offset`` (from 0), as many as there are up to ``length``."""
    if offset < 0 or length < 0:
        raise ValueError("bad range")
    return F.substring(content, offset + 1, length)


def entry_at(entries: DataFrame, roots: DataFrame, path: str) -> DataFrame:
    """(root, oid, mode) of one path below each (root, tree): a join by equal keys for each directory of the path, whatever the size
    of the snapshot. The empty path is the tree itself."""
    at = roots.select("root", F.col("tree").alias("oid"), F.lit(DIRECTORY).alias("mode"))
    for part in [p for p in path.split("/") if p]:
        step = entries.where(F.col("name") == part).select("tree", F.col("oid").alias("to"), F.col("mode").alias("m"))
        at = at.where(F.col("mode") == DIRECTORY).withColumnRenamed("oid", "tree").join(step, "tree").select("root", F.col("to").alias("oid"), F.col("m").alias("mode"))
    return at
