"""Line deduplication over a suffix array of line sequences, with DataFrame functions only.

A document is the sequence of its lines (parts between line feeds), a line is known by a 128-bit hash. The suffix
array over all sequences is built by prefix doubling: positions get order-preserving ranks by their first line; in
each round the rank of a position's first 2n lines follows from the ranks at it and n lines on. Positions
whose rank no other has are final and leave; those that reach their document's end meet an end mark. Ranks are
numbered by a range sort of the distinct pairs, so a hot line is never gathered in one task. The positions that share a rank
after a round are an interval of the suffix array whose longest common prefix is n lines or more. In each such interval
the smallest position, by (doc_id, line), is the first copy and the others are later copies.

A run of lines is a repeat if it has `RUN` (4) lines or more, or fewer that together have `chars` characters or more, as every
passage of over 50 words in ordinary prose has, however it is laid out. A longer run is made of overlapping runs of 4
lines, so the intervals of depth 1, 2, 3 (two overlapping ones of depth 2) and 4 give all lines of maximal repeats.
Lines in a later copy of a repeat are deleted; the first copy of every repeat stays. `longest_run` is
the largest power of two so that so many lines in a row have an earlier copy (0: not even one).

Null text has no lines and stays null. Empty text is one empty line. A null doc_id sorts before all others. Rows with
equal doc_id and text are one document and get the same result; other rows that share a doc_id are
ordered by a hash of their text. `dedup_lines` keeps extra columns, whatever their names; only columns called like its
results (`n_lines`, `n_deleted`, `longest_run`) give way to these. The query leaves extra columns out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

RUN = 4
CHARS = 160
_AT = ["d", "h", "i"]


def keys() -> list:
    """What names a sequence: d and h."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("d"), F.xxhash64("text").alias("h")]


def line_count(text: F.Column) -> F.Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def line_table(docs: DataFrame) -> DataFrame:
    """(d, h, i, n, a, b, size): a row for each line, with its document's number of lines and the line's hash and size."""
    # What is computed of the whole text comes first: beside an explode it would be computed again for each line.
    whole = docs.where("text IS NOT NULL").select(*keys(), line_count(F.col("text")).alias("n"), "text")
    each = whole.select("d", "h", "n", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    return each.select("d", "h", "i", "n", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"), F.length("line").alias("size"))


def ranks(rows: DataFrame, by: list[str]) -> DataFrame:
    """Keeps the rows whose value of ``by`` others share; adds r, a rank in the order of these values, and whether an
    earlier position shares it (`later`)."""
    groups = rows.groupBy(*by).agg(F.count("*").alias("held"), F.min(F.struct(*_AT)).alias("first")).where("held > 1")
    # The partitions of a range sort are in order, and so are these ids.
    numbered = groups.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("r", F.monotonically_increasing_id())
    out = rows.join(numbered.drop("held"), by)
    return out.withColumn("later", F.struct(*_AT) > F.col("first")).drop("first", *by)


def ahead(level: DataFrame, length: int, *names: str) -> DataFrame:
    """The named columns of each position, `_next` added to the names, at the position so many lines before it."""
    return level.select("d", "h", (F.col("i") - length).alias("i"), *[F.col(n).alias(n + "_next") for n in names])


def suffix_intervals(lines: DataFrame, longest: int | None = None) -> list[tuple[int, DataFrame]]:
    """For prefixes of 1, 2, 4, ... lines: the positions that share one, as (d, h, i, n, own, size, r, later); `own` and `size` count the
    first line's and the prefix's characters. Ends when no two suffixes are tied that have further lines, or with prefixes of ``longest`` lines."""
    level = stored(ranks(lines.withColumn("own", F.col("size")), ["a", "b"]).dropDuplicates(_AT))
    out, length = [(1, level)], 1
    while longest is None or length < longest:
        if level.where(F.col("i") + length < F.col("n")).isEmpty():
            break
        # At the end of a document there is nothing ahead; elsewhere a missing neighbour is unique, and so is the pair.
        pairs = level.drop("later").withColumnRenamed("r", "q").join(ahead(level, length, "r", "size"), _AT, "left")
        s = F.when(F.col("i") + length >= F.col("n"), F.lit(-1)).otherwise(F.col("r_next"))
        size = F.col("size") + F.coalesce("size_next", F.lit(0))
        pairs = pairs.select(*_AT, "n", "own", size.alias("size"), "q", s.alias("s")).where("s IS NOT NULL")
        length *= 2
        level = stored(ranks(pairs, ["q", "s"]), level.count())
        out.append((length, level))
    return out


def threes(two: DataFrame, chars: int) -> DataFrame:
    """(d, h, i, n, size, later) of depth 3, for the positions whose three lines have so many characters."""
    whole = two.where(F.col("i") + 2 <= F.col("n"))
    pairs = whole.select(*_AT, "n", "own", F.col("r").alias("q")).join(ahead(whole, 1, "r", "size"), _AT)
    pairs = pairs.select(*_AT, "n", (F.col("own") + F.col("size_next")).alias("size"), "q", F.col("r_next").alias("s")).where(F.col("size") >= chars)
    first = pairs.groupBy("q", "s").agg(F.count("*").alias("held"), F.min(F.struct(*_AT)).alias("first")).where("held > 1")
    return pairs.join(first, ["q", "s"]).select(*_AT, "n", "size", (F.struct(*_AT) > F.col("first")).alias("later"))


def repeats(docs: DataFrame, chars: int = CHARS) -> DataFrame:
    """(d, h, deleted, longest_run): for each document with a later copy of anything, the lines to delete, in order."""
    levels = dict(suffix_intervals(stored(line_table(docs))))
    marks = None

    def add(length: int, level: DataFrame, gone: F.Column) -> None:
        nonlocal marks
        whole = level.where(F.col("later") & (F.col("i") + length <= F.col("n")))
        power = F.lit(length if length != 3 else 2)
        part = whole.select("d", "h", power.alias("length"), F.explode_outer(gone.cast("array<int>")).alias("i"))
        marks = part if marks is None else marks.unionByName(part)

    for length, level in levels.items():
        run = F.sequence("i", F.col("i") + (length - 1))
        add(length, level, run if length == RUN else F.when(F.col("size") >= chars, run) if length < RUN else F.lit(None))
    if 2 in levels:
        add(3, threes(levels[2], chars), F.sequence("i", F.col("i") + 2))
    # First to a row for each line, then to a row for each document: a task holds no more than one document's lines.
    by_line = marks.groupBy("d", "h", "i").agg(F.max("length").alias("length"))
    return by_line.groupBy("d", "h").agg(F.array_sort(F.collect_list("i")).alias("deleted"), F.max("length").cast("long").alias("longest_run"))


def dedup_lines(docs: DataFrame, chars: int = CHARS) -> DataFrame:
    """The documents with `text` less its later copies, and n_lines, n_deleted and longest_run."""
    rows = docs.select(F.struct("*").alias("row"), *keys()).join(repeats(docs, chars), ["d", "h"], "left")
    text = F.col("row")["text"]
    lines = F.split(text, "\n", -1)
    n = F.coalesce(line_count(text), F.lit(0))
    gone = F.coalesce(F.size("deleted"), F.lit(0))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), n - 1), F.col("deleted")), lambda i: F.get(lines, i))
    left = F.when(gone == 0, text).when(gone == n, F.lit("")).otherwise(F.array_join(kept, "\n")).alias("text")
    made = {"n_lines": n.cast("long"), "n_deleted": gone.cast("long"), "longest_run": F.coalesce("longest_run", F.lit(0)).cast("long")}
    own = [left if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c not in made]
    return rows.select(*own, *[c.alias(name) for name, c in made.items()])


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_deleted", "longest_run", "text")


ORACLE_OP6 = f"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
p AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d WHERE text IS NOT NULL),
w AS (SELECT doc_id, i, n, CASE WHEN n < {RUN} THEN list_sum(list_transform(ls[i:i + n - 1], lambda x: length(x))) END AS size, md5(array_to_string(ls[i:i + n - 1], chr(10))) AS g
  FROM p, (SELECT unnest([1, 2, 3, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096, 8192]) AS n) WHERE i + n - 1 <= len(ls)),
l AS (SELECT * FROM (SELECT *, min((doc_id, i)) OVER (PARTITION BY n, g) AS f FROM w) WHERE (doc_id, i) > f),
x AS (SELECT doc_id, unnest(range(i, i + n)) AS i FROM l WHERE n <= {RUN} AND (n = {RUN} OR size >= {CHARS})),
y AS (SELECT DISTINCT doc_id, i FROM x),
m AS (SELECT doc_id, max(n) FILTER (n <> 3) AS longest_run FROM l GROUP BY 1),
t AS (SELECT p.doc_id, count(*) AS n_lines, count(y.i) AS n_deleted, string_agg(ls[p.i], chr(10) ORDER BY p.i) FILTER (y.i IS NULL) AS text
  FROM p LEFT JOIN y ON p.doc_id = y.doc_id AND p.i = y.i GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_deleted, 0) AS BIGINT) AS n_deleted,
  CAST(coalesce(longest_run, 0) AS BIGINT) AS longest_run, CASE WHEN d.text IS NOT NULL THEN coalesce(t.text, '') END AS text
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN m USING (doc_id)
"""
