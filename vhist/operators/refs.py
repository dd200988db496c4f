"""References, names and abbreviations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The places a name is looked up in, in this order.
PLACES = ("refs/heads/{}", "{}", "refs/{}", "refs/tags/{}", "refs/remotes/{}", "refs/remotes/{}/HEAD")


def resolve(names: DataFrame, refs: DataFrame, commits: DataFrame, least: int = 4) -> DataFrame:
    """(name, id, how): each name by the first place that has it, then as a full object id, then as a unique prefix of at least
    ``least`` hex digits. Names that nothing fits, or that several objects do, give no row."""
    places = F.array(*[F.struct(F.lit(k).alias("rank"), F.format_string(p.replace("{}", "%s"), "name").alias("full")) for k, p in enumerate(PLACES)])
    tried = names.distinct().select("name", F.explode(places).alias("p")).select("name", "p.rank", "p.full")
    by_ref = tried.join(refs.select(F.col("name").alias("full"), "id"), "full").select("name", "id", "rank", F.lit("ref").alias("how"))
    hexes = names.distinct().where(F.col("name").rlike(f"^[0-9a-f]{{{least},40}}$"))
    # Prefixes join on their first digits, so that this is an equal-key join.
    keyed = hexes.withColumn("k", F.substring("name", 1, least)).join(commits.select("id", "oid", F.substring("oid", 1, least).alias("k")), "k")
    by_hex = keyed.where(F.col("oid").startswith(F.col("name"))).groupBy("name").agg(F.min("id").alias("id"), F.count_distinct("oid").alias("n")).where("n = 1")
    by_hex = by_hex.select("name", "id", F.lit(len(PLACES)).alias("rank"), F.lit("object").alias("how"))
    best = by_ref.unionByName(by_hex).groupBy("name").agg(F.min_by(F.struct("id", "how"), "rank").alias("b"))
    return best.select("name", "b.id", "b.how")


def abbreviations(commits: DataFrame, least: int = 7) -> DataFrame:
    """(id, oid, short): the shortest prefix of at least ``least`` digits that no other object shares. Only objects that share
    ``least`` digits meet in a window, so it splits over the whole id space."""
    own = commits.select("id", "oid", F.substring("oid", 1, least).alias("k"))
    order = Window.partitionBy("k").orderBy("oid")
    near = own.withColumn("before", F.lag("oid").over(order)).withColumn("after", F.lead("oid").over(order))

    def shared(other: str) -> F.Column:
        same = F.expr(f"filter(sequence(1, 40), i -> substring(oid, 1, i) = substring({other}, 1, i))")
        return F.when(F.col(other).isNull(), F.lit(0)).otherwise(F.size(same))

    length = F.least(F.lit(40), F.greatest(F.lit(least), shared("before") + 1, shared("after") + 1))
    return near.withColumn("n", length).select("id", "oid", F.expr("substring(oid, 1, n)").alias("short"))


def listing(refs: DataFrame, commits: DataFrame, prefix: str, pattern: str | None = None) -> DataFrame:
    """(name, oid, subject) of the references below a prefix; the pattern is a glob whose * crosses slashes."""
    from vhist.functions.pathspec import glob_regex

    own = refs.where(F.col("name").startswith(prefix)).withColumn("short", F.expr(f"substring(name, {len(prefix) + 1})"))
    if pattern is not None:
        own = own.where(F.col("short").rlike(glob_regex(pattern, pathname=False)))
    return own.join(commits.select("id", "oid", "subject"), "id").select(F.col("short").alias("name"), "oid", "subject")


def with_suffix(refs: DataFrame, patterns: list[str]) -> DataFrame:
    """The references whose name is one of the patterns or ends with it after a slash."""
    hit = F.col("name").isin(patterns)
    for p in patterns:
        hit = hit | F.endswith("name", F.lit("/" + p))
    return refs.where(hit)


def rev_parse(names: DataFrame, refs: DataFrame, commits: DataFrame, least: int = 4) -> DataFrame:
    """(name, id, state): `ok` where one object is meant, `ambiguous` where references or prefixes mean several, else `missing`. Unlike
    `resolve`, no place goes before another."""
    asked = names.distinct()
    places = F.array(*[F.format_string(p.replace("{}", "%s"), "name") for p in PLACES])
    by_ref = asked.select("name", F.explode(F.array_distinct(places)).alias("full")).join(refs.select(F.col("name").alias("full"), "id"), "full").select("name", "id")
    keyed = asked.where(F.col("name").rlike(f"^[0-9a-f]{{{least},40}}$")).withColumn("k", F.substring("name", 1, least))
    by_hex = keyed.join(commits.select("id", "oid", F.substring("oid", 1, least).alias("k")), "k").where(F.col("oid").startswith(F.col("name"))).select("name", "id")
    # A reference hides objects that its name is a prefix of.
    hits = by_ref.unionByName(by_hex.join(by_ref.select("name").distinct(), "name", "left_anti"))
    met = hits.groupBy("name").agg(F.min("id").alias("id"), F.count_distinct("id").alias("n"))
    state = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").otherwise("ok")
    return asked.join(met, "name", "left").select("name", F.when(F.col("n") == 1, F.col("id")).alias("id"), state.alias("state"))


def widths(refs: DataFrame) -> DataFrame:
    """(kind, width): the longest short name below each of refs/heads, refs/tags and so on, as listings are aligned to."""
    parts = F.split("name", "/", 3)
    return refs.where(F.size(parts) == 3).groupBy(F.get(parts, F.lit(1)).alias("kind")).agg(F.max(F.length(F.get(parts, F.lit(2)))).cast("long").alias("width"))
