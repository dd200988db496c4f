"""Line attribution.

Every line of a tip's file stands at one (commit, line) at a time and moves to the first parent, in order, whose version keeps
it; a line that no parent keeps stays. The kept lines of all edges are computed once, as rows; moving is a join, in rounds as
many as the longest way of a line.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vhist.functions.textdiff import diff_rows
from vhist.operators.search import line_rows
from vhist.plans.materialize import materialized


def kept_lines(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, line, ord, parent, parent_line) of the lines that an edge keeps. ``files`` has (node, content); parents without the
    file keep nothing."""
    child = files.withColumnsRenamed({"node": "child", "content": "new"})
    parent = files.withColumnsRenamed({"node": "parent", "content": "old"})
    pairs = edges.join(child, "child").join(parent, "parent")
    rows = diff_rows(pairs, F.col("old"), F.col("new"), "child", "ord", "parent", kept=True)
    return rows.select(F.col("child").alias("node"), F.col("b").alias("line"), "ord", "parent", F.col("a").alias("parent_line"))


def blame(tips: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, final_line, node, original_line, boundary, content), lines from 1."""
    kept = materialized(kept_lines(files, edges))
    first = kept.groupBy("node", "line").agg(F.min_by(F.struct("parent", "parent_line"), "ord").alias("to"))
    first = materialized(first.select("node", "line", "to.parent", "to.parent_line"))
    texts = tips.join(files, "node").withColumn("path", F.struct("root", "node"))
    start = line_rows(texts, F.col("content")).select("path.root", "path.node", (F.col("line_no") - 1).cast("int").alias("line"), "line_no", F.col("line").alias("content"))
    live = materialized(start.select("root", F.col("line_no").alias("final_line"), "node", "line", "content"))
    done = []
    while not live.isEmpty():
        moved = live.join(first, ["node", "line"], "left")
        moved = materialized(moved)
        done.append(moved.where("parent IS NULL").select("root", "final_line", "node", "line", "content"))
        live = moved.where("parent IS NOT NULL").select("root", "final_line", F.col("parent").alias("node"), F.col("parent_line").alias("line"), "content")
    rows = reduce(DataFrame.unionByName, done) if done else live
    has_parent = edges.select(F.col("child").alias("node"), F.lit(False).alias("boundary")).distinct()
    rows = rows.join(has_parent, "node", "left")
    return rows.select("root", "final_line", "node", (F.col("line") + 1).cast("long").alias("original_line"), F.coalesce("boundary", F.lit(True)).alias("boundary"), "content")


def previous(rows: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds `previous` to attributed rows: the first parent, in order, of the line's commit that has the file; null at boundaries."""
    held = edges.join(files.select(F.col("node").alias("parent")).distinct(), "parent", "left_semi")
    before = held.groupBy(F.col("child").alias("node")).agg(F.min_by("parent", "ord").alias("previous"))
    return rows.join(before, "node", "left")


def in_range(rows: DataFrame, first: int, last: int | None = None) -> DataFrame:
    """The attributed rows of lines ``first`` to ``last`` (from 1; None: the last line)."""
    if first < 1 or last is not None and last < first:
        raise ValueError("bad line range")
    found = rows.where(F.col("final_line") >= first)
    return found if last is None else found.where(F.col("final_line") <= last)


def with_groups(rows: DataFrame) -> DataFrame:
    """Adds `group_lines`: at the first line of each run, how many lines it has; else 0."""
    runs = groups(rows).select("root", F.col("first_line").alias("final_line"), F.col("lines").alias("group_lines"))
    return rows.join(runs, ["root", "final_line"], "left").withColumn("group_lines", F.coalesce("group_lines", F.lit(0)))


def groups(rows: DataFrame) -> DataFrame:
    """(root, node, first_line, lines): runs of neighbouring lines from one commit with neighbouring origins."""
    order = Window.partitionBy("root").orderBy("final_line")
    fits = (F.lag("node").over(order) == F.col("node")) & (F.lag("original_line").over(order) + 1 == F.col("original_line"))
    marked = rows.withColumn("new", F.when(F.coalesce(fits, F.lit(False)), 0).otherwise(1))
    run = marked.withColumn("run", F.sum("new").over(order))
    return run.groupBy("root", "node", "run").agg(F.min("final_line").alias("first_line"), F.count("*").alias("lines")).drop("run")
