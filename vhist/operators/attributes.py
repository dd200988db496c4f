"""Attribute states of paths from ordered rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vhist.functions.pathspec import glob_regex

#: The built-in macro.
MACROS = {"binary": {"diff": "-", "merge": "-", "text": "-"}}


def expanded(rules: DataFrame, macros: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """Rules (depth, line, base, pattern, attribute, state) with set macros' attributes added after the macro itself."""
    known = MACROS | (macros or {})
    out = rules.withColumn("step", F.lit(0))
    for name, parts in known.items():
        for k, (attribute, state) in enumerate(parts.items(), 1):
            out = out.unionByName(rules.where((F.col("attribute") == name) & (F.col("state") == "+")).withColumns({"attribute": F.lit(attribute), "state": F.lit(state), "step": F.lit(k)}))
    return out


@F.udf(T.StringType())
def matcher(pattern: str) -> str:
    """A rule's pattern as a regular expression, by Git's rules: a leading slash only anchors, and what starts with ! or ends
    with a slash fits no file."""
    return "(?!)" if pattern.startswith("!") or pattern.endswith("/") else glob_regex(pattern.removeprefix("/"), pathname=True)


def states(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, attribute, state): the last matching rule wins, deeper directories last. A pattern is matched below its rule's
    directory, one without a slash by the base name. `*.ext` and `name/**` are joined by equal keys; other rules are few, and
    meet the paths below their directory."""
    all_rules = expanded(rules)
    keyed = all_rules.withColumn("suffix", F.regexp_extract("pattern", "^\\*(\\.[A-Za-z0-9]+)\\z", 1)).withColumn("whole", F.regexp_extract("pattern", "^([A-Za-z0-9._-]+)/\\*\\*\\z", 1))
    paths = files.select("path", F.regexp_extract("path", "(\\.[A-Za-z0-9]+)\\z", 1).alias("suffix"))
    parts = F.split("path", "/")
    above = files.select("path", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("dir"))
    own = ["path", *all_rules.columns]

    below = (F.col("base") == "") | F.startswith("path", F.concat("base", F.lit("/")))
    by_suffix = paths.join(keyed.where("suffix <> ''").drop("whole"), "suffix").where(below).select(*own)
    by_dir = above.join(keyed.where("whole <> ''").withColumn("dir", F.when(F.col("base") == "", F.col("whole")).otherwise(F.concat_ws("/", "base", "whole"))), "dir").select(*own)
    other = keyed.where("suffix = '' AND whole = ''").withColumns({"dir": F.col("base"), "regex": matcher("pattern")})
    relative = F.when(F.col("base") == "", F.col("path")).otherwise(F.expr("substring(path, length(base) + 2)"))
    subject = F.when(F.contains("pattern", F.lit("/")), relative).otherwise(F.substring_index("path", "/", -1))
    by_glob = above.join(F.broadcast(other), "dir").where(F.rlike(subject, F.col("regex"))).select(*own)
    hit = by_suffix.unionByName(by_dir).unionByName(by_glob)
    best = hit.groupBy("path", "attribute").agg(F.max_by("state", F.struct("depth", "line", "step")).alias("state"))
    return best.where("state <> '!'")
