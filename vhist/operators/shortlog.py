"""Author summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def subject(message: Column) -> Column:
    """A message's first paragraph as one line, without a leading [PATCH ...]; `<none>` if empty."""
    first = F.trim(F.regexp_replace(F.element_at(F.split(F.trim(message), "\n[ \t]*\n"), 1), "\\s+", " "))
    bare = F.regexp_replace(first, "^\\[PATCH[^\\]]*\\] *", "")
    return F.when(F.coalesce(bare, F.lit("")) == "", "<none>").otherwise(bare)


def mapped(commits: DataFrame, rules: DataFrame) -> DataFrame:
    """Commits with author and email replaced by a mail map of (line_no, name, email, old_name, old_email). Emails compare
    without case; a rule that names the author beats one that doesn't, and later rules beat earlier ones."""
    r = rules.select("line_no", F.col("name").alias("new_name"), F.col("email").alias("new_email"), "old_name", F.lower("old_email").alias("k"))
    hit = commits.withColumn("k", F.lower("email")).join(r, "k").where(F.col("old_name").isNull() | (F.lower("old_name") == F.lower("author")))
    best = hit.groupBy("id").agg(F.max_by(F.struct("new_name", "new_email"), F.struct(F.col("old_name").isNotNull(), "line_no")).alias("best"))
    out = commits.join(best, "id", "left")
    return out.withColumns({"author": F.coalesce("best.new_name", "author"), "email": F.coalesce("best.new_email", "email")}).drop("best")


def counts(commits: DataFrame, with_email: bool = False, merges: DataFrame | None = None) -> DataFrame:
    """(author, n): commits by author; ``merges`` has the ids of commits to leave out."""
    rows = commits if merges is None else commits.join(merges, "id", "left_anti")
    who = F.concat(F.col("author"), F.lit(" <"), F.col("email"), F.lit(">")) if with_email else F.col("author")
    return rows.groupBy(who.alias("author")).agg(F.count("*").alias("n"))


def subjects(commits: DataFrame) -> DataFrame:
    """(author, n, pos, subject): each author's subjects, oldest first. Rows, not arrays, so no author is too large."""
    own = Window.partitionBy("author")
    return commits.select("author", F.count("*").over(own).alias("n"), F.row_number().over(own.orderBy("time", "id")).cast("long").alias("pos"), subject(F.col("subject")).alias("subject"))


def ordered(rows: DataFrame, by_count: bool = False) -> DataFrame:
    """(author, n) with `pos`: by name, or by falling count and then by name."""
    order = [F.desc("n"), "author"] if by_count else ["author"]
    return rows.withColumn("pos", F.row_number().over(Window.orderBy(*order)).cast("long"))


def wrapped(subject: Column, indent: int = 6, width: int = 76) -> Column:
    """A subject's words in lines of at most ``width`` characters (a longer word has a line of its own), each indented."""
    words = F.filter(F.split(subject, "\\s+"), lambda w: w != "")
    pad = " " * indent
    start = F.struct(F.lit("").alias("done"), F.lit(pad).alias("line"))

    def add(acc: Column, word: Column) -> Column:
        full = (F.length(acc["line"]) > indent) & (F.length(acc["line"]) + 1 + F.length(word) > width)
        glue = F.when(F.length(acc["line"]) > indent, F.lit(" ")).otherwise(F.lit(""))
        return F.struct(
            F.when(full, F.concat(acc["done"], acc["line"], F.lit("\n"))).otherwise(acc["done"]).alias("done"),
            F.when(full, F.concat(F.lit(pad), word)).otherwise(F.concat(acc["line"], glue, word)).alias("line"),
        )

    return F.aggregate(words, start, add, lambda acc: F.concat(acc["done"], acc["line"]))
