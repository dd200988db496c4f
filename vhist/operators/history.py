"""Path history: inherited values, merge simplification, logs.

A commit's value for a path is what it writes there, else what its first parent has. A commit that has the same value
as some parent is hidden and leads to the first such parent only; any other is shown and leads to all. The history of a path is
what a tip reaches over these edges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vhist.operators.graph import closure, doubled
from vhist.plans.materialize import materialized


def inherited(commits: DataFrame, edges: DataFrame, writes: DataFrame) -> DataFrame:
    """(id, value): each commit's value (null where nothing was written yet), found by pointer doubling along first parents.
    ``writes`` has (id, value), one row for a commit that writes."""
    first = edges.where("ord = 0").select(F.col("child").alias("id"), "parent")
    at = commits.select("id").join(writes.select("id", F.lit(True).alias("own")), "id", "left").join(first, "id", "left")
    # `to`: where to look next, and whether that is final: a commit that writes, or a root.
    final = F.coalesce("own", F.lit(False)) | F.col("parent").isNull()
    now = materialized(at.select(F.col("id").alias("node"), F.when(final, F.col("id")).otherwise(F.col("parent")).alias("to"), F.lit(0).alias("n"), final.alias("done")))
    while not now.where("NOT done").isEmpty():
        now = materialized(doubled(doubled(now)))
    return now.join(writes.select(F.col("id").alias("to"), "value"), "to", "left").select(F.col("node").alias("id"), "value")


def effective_edges(values: DataFrame, edges: DataFrame, first_parent: bool = False) -> tuple[DataFrame, DataFrame]:
    """The simplified edges (child, ord, parent) and the shown commits (id)."""
    used = edges.where("ord = 0") if first_parent else edges
    pairs = used.join(values.select(F.col("id").alias("child"), F.col("value").alias("cv")), "child")
    pairs = pairs.join(values.select(F.col("id").alias("parent"), F.col("value").alias("pv")), "parent")
    pairs = pairs.withColumn("same", F.col("cv").eqNullSafe(F.col("pv")))
    fate = pairs.groupBy("child").agg(F.min(F.when(F.col("same"), F.col("ord"))).alias("only"))
    kept = pairs.join(fate, "child").where("only IS NULL OR ord = only").select("child", "ord", "parent")
    state = values.join(fate.withColumnRenamed("child", "id").withColumn("has_parent", F.lit(True)), "id", "left")
    shown = state.where((F.col("has_parent").isNull() & F.col("value").isNotNull()) | (F.col("has_parent").isNotNull() & F.col("only").isNull()))
    return kept, shown.select("id")


def path_log(tips: DataFrame, commits: DataFrame, edges: DataFrame, writes: DataFrame, first_parent: bool = False) -> DataFrame:
    """(root, node): the shown commits of each tip's simplified history."""
    values = materialized(inherited(commits, edges, writes))
    kept, shown = effective_edges(values, edges, first_parent)
    reached = closure(tips, kept)
    return reached.join(shown.select(F.col("id").alias("node")), "node", "left_semi").select("root", "node")


def below_any(paths: list[str]) -> Column:
    """Whether `path` is one of the paths or lies below one. A path that ends with a slash is a directory: a file of that name isn't meant."""
    below = [F.col("path").startswith(p) if p.endswith("/") else (F.col("path") == p) | F.col("path").startswith(p + "/") for p in paths]
    return reduce(Column.__or__, below)


def path_writes(touches: DataFrame, paths: list[str]) -> DataFrame:
    """(id, value) of a set of literal paths and what lies below them: one value that changes if any file's does."""
    each = touches.where(below_any(paths)).select("id", F.concat_ws("=", "path", "value").alias("v"))
    return each.groupBy("id").agg(F.sha1(F.array_join(F.array_sort(F.collect_list("v")), ",").cast("binary")).alias("value"))


def predicate_log(tips: DataFrame, edges: DataFrame, changed: DataFrame, first_parent: bool = False) -> DataFrame:
    """History by a matcher: ``changed`` has (child, ord) where some matching path differs from that parent, ord -1 for roots
    that have a match. A commit without a difference to some parent is hidden and follows the first such."""
    used = edges.where("ord = 0") if first_parent else edges
    marked = used.join(changed.withColumn("differs", F.lit(True)), ["child", "ord"], "left")
    fate = marked.groupBy("child").agg(F.min(F.when(F.col("differs").isNull(), F.col("ord"))).alias("only"))
    kept = used.join(fate, "child").where("only IS NULL OR ord = only").select("child", "ord", "parent")
    shown = fate.where("only IS NULL").select("child").unionByName(changed.where("ord = -1").select("child"))
    reached = closure(tips, kept)
    return reached.join(shown.select(F.col("child").alias("node")), "node", "left_semi").select("root", "node")


def parent_masks(changed: DataFrame) -> DataFrame:
    """(child, path, mask): by path, the parents it differs from as bits; for up to 63 parents."""
    return changed.groupBy("child", "path").agg(F.bit_or(F.expr("shiftleft(1L, ord)")).alias("mask"))


def path_changes(touches: DataFrame, edges: DataFrame) -> DataFrame:
    """(child, ord, path): commits' own writes against each parent's own write there (ord 0 for roots)."""
    own = touches.select(F.col("id").alias("child"), "path", F.col("value").alias("cv"))
    theirs = touches.select(F.col("id").alias("parent"), "path", F.col("value").alias("pv"))
    # A root's writes have no parent, so they meet nothing in the second join and stay, whatever their value.
    against = own.join(edges.select("child", "ord", "parent"), "child", "left").join(theirs, ["parent", "path"], "left")
    return against.where("parent IS NULL OR NOT cv <=> pv").select("child", F.coalesce("ord", F.lit(0)).alias("ord"), "path")
