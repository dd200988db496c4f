"""Text search over lines, and similarity of contents."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vhist.functions import textdiff
from vhist.plans.materialize import materialized

SNIFF = 8000
#: Rows of one hot span that meet in a task at once.
BLOCK = 1024


def is_binary_bytes(content: Column) -> Column:
    """A NUL among the first 8000 bytes of a binary column."""
    return F.locate("00", F.regexp_replace(F.hex(F.substring(content, 1, SNIFF)), "(..)", "$1 ")) > 0


def as_text(content: Column) -> Column:
    """Bytes as text where they are UTF-8, else each byte as a character, so that no file ends a job."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def is_binary(content: Column) -> Column:
    """A NUL among the first 8000 bytes."""
    return F.locate("\0", F.decode(F.substring(F.encode(content, "UTF-8"), 1, SNIFF), "ISO-8859-1")) > 0


def basic_regex(pattern: str) -> str:
    """A basic regular expression in the extended form: ( ) { } + ? | are plain unless escaped. Back-references are refused."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            if pattern[i].isdigit():
                raise ValueError("back-references are not supported")
            out.append(pattern[i] if pattern[i] in "(){}+?|" else "\\" + pattern[i])
        elif c == "[":
            end = pattern.find("]", i + 2)
            end = len(pattern) if end < 0 else end
            out.append(pattern[i : end + 1])
            i = end
        else:
            out.append("\\" + c if c in "(){}+?|" else c)
        i += 1
    return "".join(out)


def line_rows(files: DataFrame, content: Column) -> DataFrame:
    """(path, line_no from 1, line): carriage returns stay, and a final line feed starts no line."""
    parts = F.split(content, "\n", -1)
    whole = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return files.select("path", F.posexplode(whole).alias("n", "line")).select("path", (F.col("n") + 1).cast("long").alias("line_no"), "line")


def line_match(line: Column, patterns: list[str], fixed: bool = False, basic: bool = False, icase: bool = False, invert: bool = False) -> Column:
    """Whether a line holds any of the patterns (extended regular expressions unless fixed or basic)."""
    hit = F.lit(False)
    for p in patterns:
        if fixed and not icase:
            hit = hit | F.contains(line, F.lit(p))
        else:
            body = re.escape(p) if fixed else basic_regex(p) if basic else p
            hit = hit | line.rlike(("(?i)" if icase else "") + body)
    return ~hit if invert else hit


def grep(files: DataFrame, patterns: list[str], **options: bool) -> DataFrame:
    """(path, line_no, line) of the text files' matching lines. Files that can't match are dropped before lines are made."""
    text = files.where(F.col("content").isNotNull() & ~is_binary(F.col("content")))
    if options.get("fixed") and not options.get("icase") and not options.get("invert"):
        text = text.where(line_match(F.col("content"), patterns, fixed=True))
    return line_rows(text, F.col("content")).where(line_match(F.col("line"), patterns, **options))


def grep_counts(files: DataFrame, patterns: list[str], **options: bool) -> DataFrame:
    """(path, n): matching lines of each file that has some."""
    return grep(files, patterns, **options).groupBy("path").agg(F.count("*").alias("n"))


def grep_files(files: DataFrame, patterns: list[str], **options: bool) -> DataFrame:
    """(path) of the files with a matching line; one file's lines end the search in it at the first hit."""
    text = files.where(F.col("content").isNotNull() & ~is_binary(F.col("content")))
    parts = F.split(F.col("content"), "\n", -1)
    whole = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return text.where(F.exists(whole, lambda line: line_match(line, patterns, **options))).select("path")


def blob_id(content: Column) -> Column:
    """Git's object id of a file's bytes."""
    raw = F.encode(content, "UTF-8")
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(raw).cast("string")), "UTF-8"), F.lit(b"\0"), raw))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def exact_renames(deleted: DataFrame, added: DataFrame) -> DataFrame:
    """(old, new): one-to-one pairs of deleted and added paths with the same object, from (path, oid). In each object the paths
    are paired by base name first, then in path order; pairs use each path once."""
    d = deleted.select("oid", F.col("path").alias("old"), base_name(F.col("path")).alias("base"))
    a = added.select("oid", F.col("path").alias("new"), base_name(F.col("path")).alias("base"))
    nth = lambda c: F.row_number().over(Window.partitionBy("oid", "base").orderBy(c))
    same = d.withColumn("k", nth("old")).join(a.withColumn("k", nth("new")), ["oid", "base", "k"]).select("oid", "old", "new")
    rest = lambda c: F.row_number().over(Window.partitionBy("oid").orderBy(c))
    left_d = d.join(same.select("oid", "old"), ["oid", "old"], "left_anti").withColumn("k", rest("old"))
    left_a = a.join(same.select("oid", "new"), ["oid", "new"], "left_anti").withColumn("k", rest("new"))
    return same.unionByName(left_d.drop("base").join(left_a.drop("base"), ["oid", "k"]).select("oid", "old", "new")).select("old", "new")


def similarity(spans: DataFrame, sizes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(old, new, score of 60000) of candidate pairs whose smaller size is at least half the larger: shared span bytes over
    the larger size. ``spans`` has (path, span, bytes), ``sizes`` (path, size)."""
    sized = pairs.join(sizes.withColumnsRenamed({"path": "old", "size": "so"}), "old").join(sizes.withColumnsRenamed({"path": "new", "size": "sn"}), "new")
    sized = sized.where(F.least("so", "sn") * 2 >= F.greatest("so", "sn"))
    o = sized.join(spans.withColumnsRenamed({"path": "old", "bytes": "bo"}), "old")
    both = o.join(spans.withColumnsRenamed({"path": "new", "bytes": "bn"}), ["new", "span"])
    shared = both.groupBy("old", "new").agg(F.sum(F.least("bo", "bn")).alias("shared"))
    scored = sized.join(shared, ["old", "new"], "left")
    return scored.select("old", "new", F.floor(F.coalesce("shared", F.lit(0)) * 60000 / F.greatest("so", "sn")).cast("long").alias("score"))


def similar_pairs(files: DataFrame, least: int = 30000) -> DataFrame:
    """(old, new, score, copy) of (path, content): every two different contents with at least this score, which is 30000 or more, as
    the pair of their smallest paths (copy: false); and for each further path of a content a row from its smallest one (copy:
    true), with the score of the content with itself. All pairs of paths follow from these; a group of copies has as many rows
    as members. Files without spans (empty or null) have no score.

    Equal contents are one file. Spans go by the number of files that have them, rare ones first; a file's
    prefix are its spans up to where the rest is too small for the score. The first span that a pair shares is in both prefixes,
    and both rests from there hold all that they share, so a join of prefixes finds every pair. A hot span is dealt in blocks."""
    named = files.where("content IS NOT NULL").select("path", F.sha2("content", 256).alias("k"), F.octet_length("content").cast("long").alias("size"))
    groups = named.groupBy("k").agg(F.min("path").alias("head"))
    copies = materialized(named.join(groups, "k").select("head", "path", "size"))
    heads = copies.where("path = head").select("path", "size")
    spans = materialized(textdiff.span_rows(files, F.col("content"), "path").join(heads.select("path", "size"), "path"))

    held = spans.groupBy("span").agg(F.count("*").alias("n")).where("n > 1")
    common = materialized(spans.join(held, "span"))
    rest = F.sum("bytes").over(Window.partitionBy("path").orderBy("n", "span").rowsBetween(Window.currentRow, Window.unboundedFollowing))
    prefix = materialized(common.withColumn("rest", rest).where(F.col("rest") * 60000 >= F.col("size") * least).select("path", "size", "span", "rest"))
    met = prefix.groupBy("span").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"), F.count("*").alias("n")).where("n > 1").drop("n")
    dealt = prefix.join(met, "span")
    a = dealt.select("span", F.col("path").alias("old"), F.col("size").alias("so"), F.col("rest").alias("ro"), F.pmod(F.xxhash64("path"), "blocks").alias("block"))
    b = dealt.select("span", F.col("path").alias("new"), F.col("size").alias("sn"), F.col("rest").alias("rn"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    able = (F.col("old") < F.col("new")) & (F.least("ro", "rn") * 60000 >= F.greatest("so", "sn") * least)
    cand = materialized(a.join(b, ["span", "block"]).where(able).select("old", "new").distinct())
    scored = similarity(common.select("path", "span", "bytes"), heads.select("path", "size"), cand)

    own = spans.groupBy("path", "size").agg(F.sum("bytes").alias("shared"))
    further = copies.where("path <> head").select(F.col("head").alias("old"), F.col("path").alias("new"))
    alike = further.join(own.withColumnRenamed("path", "old"), "old").select("old", "new", F.floor(F.col("shared") * 60000 / F.col("size")).cast("long").alias("score"))
    return scored.withColumn("copy", F.lit(False)).unionByName(alike.withColumn("copy", F.lit(True))).where(F.col("score") >= least)
