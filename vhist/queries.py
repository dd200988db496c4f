"""The registry: a query for each operator over the driver's tables, and DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vhist.functions import pathspec, textdiff
from vhist.operators import attributes, blame, graph, history, refs, search, shortlog, trees
from vhist.plans.materialize import materialized, spread
from vhist.sources.projection import History, duckdb_with
from vhist.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of a History under its name, with DuckDB SQL for the same rows if given."""

    def add(f: Callable[[History], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(History(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def oracle(names: str, select: str, /, **more: str) -> str:
    """SQL over projected tables and further common table expressions."""
    head = duckdb_with(*names.split())
    return head + "".join(f",\n{n} AS ({t})" for n, t in more.items()) + "\n" + select


def tips(h: History) -> DataFrame:
    return h.heads.select(F.col("branch").alias("root"), F.col("id").alias("node"))


# Projection ---------------------------------------------------------------------------------------------------------


@query(oracle("commits", "SELECT id, oid, branch, seq, author, subject FROM commits"))
def commit_projection(h: History) -> DataFrame:
    return h.commits.select("id", "oid", "branch", "seq", "author", "subject")


@query(oracle("parents", "SELECT child, ord, parent FROM parents"))
def parent_edges(h: History) -> DataFrame:
    return h.edges.select("child", "ord", "parent")


@query(oracle("refs", "SELECT name, id FROM refs"))
def ref_list(h: History) -> DataFrame:
    return h.refs.select("name", "id")


# Graph --------------------------------------------------------------------------------------------------------------

REACH = "SELECT branch AS root, id AS node FROM heads UNION SELECT reach.root, parents.parent FROM reach JOIN parents ON parents.child = reach.node"
FIRST = REACH.replace("ON parents.child = reach.node", "ON parents.child = reach.node AND parents.ord = 0")


@query(oracle("parents heads", "SELECT root, node FROM reach", reach=REACH))
def closure_all_tips(h: History) -> DataFrame:
    return graph.closure(tips(h), h.edges)


@query(oracle("parents heads", "SELECT root, node FROM reach", reach=FIRST))
def closure_first_parent(h: History) -> DataFrame:
    return graph.closure(tips(h), h.edges, first_parent=True)


#: The fourth last commit of a branch, as the start of ranges.
OLD = "SELECT branch AS root, id AS node FROM (SELECT branch, id, row_number() OVER (PARTITION BY branch ORDER BY seq DESC) AS k FROM commits) t WHERE k = 4"
OLD_REACH = "SELECT root, node FROM old UNION SELECT old_reach.root, parents.parent FROM old_reach JOIN parents ON parents.child = old_reach.node"


def old(h: History) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("branch").orderBy(F.desc("seq")))
    return h.commits.withColumn("k", k).where("k = 4").select(F.col("branch").alias("root"), F.col("id").alias("node"))


RANGE = "SELECT root, node FROM reach WHERE NOT EXISTS (SELECT 1 FROM old_reach o WHERE o.root = reach.root AND o.node = reach.node)"


@query(oracle("commits parents heads", "SELECT root, node FROM ranged", reach=REACH, old=OLD, old_reach=OLD_REACH, ranged=RANGE))
def range_list(h: History) -> DataFrame:
    return graph.ranges(tips(h), old(h), h.edges)


@query(oracle("commits parents heads", "SELECT root, count(*) AS n FROM ranged GROUP BY root", reach=REACH, old=OLD, old_reach=OLD_REACH, ranged=RANGE))
def range_count(h: History) -> DataFrame:
    return graph.ranges(tips(h), old(h), h.edges).groupBy("root").agg(F.count("*").alias("n"))


PAIRS = """SELECT a.branch AS pair, a.id AS a, b.id AS b FROM
  (SELECT branch, id, row_number() OVER (PARTITION BY branch ORDER BY seq DESC) AS k FROM commits) a JOIN
  (SELECT branch, id, row_number() OVER (PARTITION BY branch ORDER BY seq DESC) AS k FROM commits) b
  ON a.branch = b.branch AND a.k = 1 AND b.k = 2"""


def pairs(h: History) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("branch").orderBy(F.desc("seq")))
    rows = h.commits.withColumn("k", k).where("k <= 2").groupBy("branch").agg(F.max(F.when(F.col("k") == 1, F.col("id"))).alias("a"), F.max(F.when(F.col("k") == 2, F.col("id"))).alias("b"))
    return rows.where("b IS NOT NULL").select(F.col("branch").alias("pair"), "a", "b")


@query(
    oracle(
        "commits parents",
        "SELECT pair, node, row_number() OVER (PARTITION BY pair ORDER BY time DESC, oid) AS pos FROM common JOIN commits ON commits.id = node "
        "WHERE NOT EXISTS (SELECT 1 FROM common c JOIN parents p ON p.child = c.node WHERE c.pair = common.pair AND p.parent = common.node)",
        pairs=PAIRS,
        ra="SELECT pair, a AS node FROM pairs UNION SELECT ra.pair, p.parent FROM ra JOIN parents p ON p.child = ra.node",
        rb="SELECT pair, b AS node FROM pairs UNION SELECT rb.pair, p.parent FROM rb JOIN parents p ON p.child = rb.node",
        common="SELECT ra.pair, ra.node FROM ra JOIN rb ON ra.pair = rb.pair AND ra.node = rb.node",
    )
)
def merge_base_all(h: History) -> DataFrame:
    return graph.merge_bases(pairs(h), h.edges, h.commits)


@query(
    oracle(
        "commits parents",
        "SELECT pair, EXISTS (SELECT 1 FROM ra WHERE ra.pair = pairs.pair AND ra.node = pairs.b) AS yes FROM pairs",
        pairs=PAIRS,
        ra="SELECT pair, a AS node FROM pairs UNION SELECT ra.pair, p.parent FROM ra JOIN parents p ON p.child = ra.node",
    )
)
def is_ancestor(h: History) -> DataFrame:
    return graph.is_ancestor(pairs(h).select("pair", F.col("b").alias("a"), F.col("a").alias("b")), h.edges)


@query(
    oracle(
        "commits parents heads",
        "SELECT root, node FROM chain WHERE n = 5",
        chain="SELECT branch AS root, id AS node, 0 AS n FROM heads UNION ALL SELECT chain.root, p.parent, n + 1 FROM chain JOIN parents p ON p.child = chain.node AND p.ord = 0 WHERE n < 5",
    )
)
def nth_first_parent(h: History) -> DataFrame:
    return graph.nth_ancestor(tips(h), h.edges, 5)


@query(oracle("parents commits", "SELECT child AS root, parent AS node FROM parents WHERE ord = 1"))
def nth_parent(h: History) -> DataFrame:
    return graph.nth_parent(h.commits.select(F.col("id").alias("root"), F.col("id").alias("node")), h.edges, 2)


POS = "row_number() OVER (PARTITION BY root ORDER BY time DESC, node DESC) AS pos"


@query(
    oracle(
        "commits parents heads",
        f"SELECT root, node, {POS}, coalesce(ps, '') AS parents FROM reach JOIN commits ON commits.id = node LEFT JOIN "
        "(SELECT child, string_agg(CAST(parent AS VARCHAR), ' ' ORDER BY ord) AS ps FROM parents GROUP BY child) ON child = node",
        reach=REACH,
    )
)
def rev_list_parents(h: History) -> DataFrame:
    rows = graph.by_time(graph.closure(tips(h), h.edges), h.commits)
    ps = h.edges.groupBy("child").agg(F.array_sort(F.collect_list(F.struct("ord", "parent"))).alias("ps"))
    named = rows.join(ps, F.col("node") == F.col("child"), "left")
    return named.select("root", "node", "pos", F.coalesce(F.array_join(F.col("ps.parent").cast("array<string>"), " "), F.lit("")).alias("parents"))


@query(
    oracle(
        "commits parents heads",
        "SELECT root, node, row_number() OVER (PARTITION BY root ORDER BY pos DESC) AS pos FROM (SELECT root, node, "
        f"{POS} FROM reach JOIN commits ON commits.id = node) WHERE pos <= 5",
        reach=REACH,
    )
)
def rev_list_reverse(h: History) -> DataFrame:
    rows = graph.by_time(graph.closure(tips(h), h.edges), h.commits).where("pos <= 5")
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("root").orderBy(F.desc("pos"))).cast("long"))


@query()
def rev_list_walk(h: History) -> DataFrame:
    """The exact heap walk; not SQL-expressible under skew and ties, tested against a plain walker."""
    reached = materialized(graph.closure(tips(h), h.edges))
    return graph.walk(reached, tips(h), h.edges, h.commits)


@query(
    oracle(
        "commits parents heads",
        "SELECT root, node, row_number() OVER (PARTITION BY root ORDER BY epoch_us(time) // 1000000 * 10000000 + node DESC) AS pos FROM reach JOIN commits ON commits.id = node",
        reach=REACH,
    )
)
def rev_list_exact(h: History) -> DataFrame:
    """The exact walk where times differ (made so by the ids), which is the order of times."""
    unique = h.commits.select("id", (F.unix_seconds(F.col("time").cast("timestamp")) * 10_000_000 + F.col("id")).alias("time"))
    return graph.walk(graph.closure(tips(h), h.edges), tips(h), h.edges, unique)


# Logs ---------------------------------------------------------------------------------------------------------------

LOG = f"SELECT root, pos, oid, author, subject FROM (SELECT root, node, {POS}, oid, author, subject FROM reach JOIN commits ON commits.id = node) WHERE pos <= 10"


@query(oracle("commits parents heads", LOG, reach=REACH))
def log_all_limit(h: History) -> DataFrame:
    """Display columns are joined after the limit."""
    rows = graph.by_time(graph.closure(tips(h), h.edges), h.commits).where("pos <= 10")
    return rows.join(h.commits.select(F.col("id").alias("node"), "oid", "author", "subject"), "node").select("root", "pos", "oid", "author", "subject")


@query(
    oracle(
        "commits parents heads",
        "SELECT root, pos, concat(substr(oid, 1, 7), ' ', subject) AS line FROM (" + LOG + ")",
        reach=REACH,
    )
)
def log_oneline(h: History) -> DataFrame:
    return log_all_limit(h).select("root", "pos", F.concat(F.substring("oid", 1, 7), F.lit(" "), "subject").alias("line"))


def path_log_sql(writes: str, first_parent: bool = False) -> str:
    use = "(SELECT * FROM parents WHERE ord = 0)" if first_parent else "parents"
    return oracle(
        "commits parents heads touches",
        "SELECT root, node FROM walked WHERE node IN (SELECT id FROM shown)",
        writes=writes,
        own="SELECT commits.id AS id, commits.id AS at FROM commits UNION ALL SELECT own.id, p.parent FROM own JOIN parents p ON p.child = own.at AND p.ord = 0 WHERE own.at NOT IN (SELECT id FROM writes)",
        val="SELECT commits.id, w.value FROM commits LEFT JOIN (SELECT own.id, writes.value FROM own JOIN writes ON writes.id = own.at) w ON w.id = commits.id",
        cmp=f"SELECT p.child, p.ord, p.parent, a.value IS NOT DISTINCT FROM b.value AS same FROM {use} p JOIN val a ON a.id = p.child JOIN val b ON b.id = p.parent",
        fs="SELECT child, min(ord) FILTER (same) AS first_same FROM cmp GROUP BY child",
        eff="SELECT cmp.child, cmp.parent FROM cmp JOIN fs ON cmp.child = fs.child WHERE fs.first_same IS NULL OR cmp.ord = fs.first_same",
        shown="SELECT val.id FROM val LEFT JOIN fs ON fs.child = val.id WHERE (fs.child IS NULL AND val.value IS NOT NULL) OR (fs.child IS NOT NULL AND fs.first_same IS NULL)",
        walked="SELECT branch AS root, id AS node FROM heads UNION SELECT walked.root, eff.parent FROM walked JOIN eff ON eff.child = walked.node",
    )


def writes_sql(*paths: str) -> str:
    test = " OR ".join(f"path = '{p}' OR substr(path, 1, {len(p) + 1}) = '{p}/'" for p in paths)
    return f"SELECT id, sha1(string_agg(concat(path, '=', value), ',' ORDER BY concat(path, '=', value))) AS value FROM touches WHERE {test} GROUP BY id"


def writes(h: History, paths: list[str]) -> DataFrame:
    return history.path_writes(h.touches_where(history.below_any(paths)), paths)


@query(path_log_sql(writes_sql("Brand#2")))
def log_path(h: History) -> DataFrame:
    return history.path_log(tips(h), h.commits, h.edges, writes(h, ["Brand#2"]))


@query(path_log_sql(writes_sql("Brand#2"), first_parent=True))
def log_path_first_parent(h: History) -> DataFrame:
    return history.path_log(tips(h), h.commits, h.edges, writes(h, ["Brand#2"]), first_parent=True)


@query(path_log_sql(writes_sql("Brand#1/ECONOMY", "Brand#3/SMALL", "Brand#7")))
def log_multi_path(h: History) -> DataFrame:
    return history.path_log(tips(h), h.commits, h.edges, writes(h, ["Brand#1/ECONOMY", "Brand#3/SMALL", "Brand#7"]))


CHANGED = """SELECT t.id AS child, p.ord, t.path FROM touches t JOIN parents p ON p.child = t.id LEFT JOIN touches u ON u.id = p.parent AND u.path = t.path
  WHERE u.value IS DISTINCT FROM t.value"""


@query(
    oracle(
        "commits parents heads touches",
        "SELECT root, node FROM walked WHERE node IN (SELECT id FROM shown)",
        hit=f"SELECT DISTINCT child, ord FROM ({CHANGED}) WHERE path LIKE 'Brand#1%/ECONOMY/%'",
        cmp="SELECT p.child, p.ord, p.parent, NOT EXISTS (SELECT 1 FROM hit WHERE hit.child = p.child AND hit.ord = p.ord) AS same FROM parents p",
        fs="SELECT child, min(ord) FILTER (same) AS first_same FROM cmp GROUP BY child",
        eff="SELECT cmp.child, cmp.parent FROM cmp JOIN fs ON cmp.child = fs.child WHERE fs.first_same IS NULL OR cmp.ord = fs.first_same",
        shown="SELECT child AS id FROM fs WHERE first_same IS NULL UNION SELECT id FROM touches WHERE path LIKE 'Brand#1%/ECONOMY/%' AND id NOT IN (SELECT child FROM parents)",
        walked="SELECT branch AS root, id AS node FROM heads UNION SELECT walked.root, eff.parent FROM walked JOIN eff ON eff.child = walked.node",
    )
)
def log_predicate(h: History) -> DataFrame:
    hit = pathspec.compile_specs(["Brand#1*/ECONOMY/*"], F.col("path"))
    changes = history.path_changes(materialized(h.touches_where(hit)), h.edges)
    has_parent = h.edges.select("child").distinct().withColumn("p", F.lit(True))
    marked = changes.join(has_parent, "child", "left").select("child", F.when(F.col("p").isNull(), -1).otherwise(F.col("ord")).alias("ord")).distinct()
    return history.predicate_log(tips(h), h.edges, marked)


@query(
    oracle(
        "commits parents touches",
        f"SELECT child, path, CAST(bit_or(1 << ord) AS BIGINT) AS mask FROM (SELECT * FROM ({CHANGED}) UNION ALL SELECT id, 0, path FROM touches WHERE id NOT IN (SELECT child FROM parents)) GROUP BY 1, 2",
    )
)
def changed_paths_mask(h: History) -> DataFrame:
    return history.parent_masks(history.path_changes(h.touches, h.edges))


# Trees --------------------------------------------------------------------------------------------------------------

SNAP = "SELECT root, path, arg_max(value, seq) AS value FROM {r} JOIN commits ON commits.id = node JOIN touches ON touches.id = node GROUP BY 1, 2"


def two_snapshots(h: History, match: Column | None = None) -> DataFrame:
    """Both snapshots of each branch, from one closure. Paths that don't fit ``match`` are left out."""
    side = lambda rows, new: rows.select(F.struct("root", F.lit(new).alias("new")).alias("root"), "node")
    reached = graph.closure(side(old(h), False).unionByName(side(tips(h), True)), h.edges, True)
    on = lambda c: F.max(F.col("root.new") == c)
    sides = reached.groupBy(F.col("root.root").alias("at"), "node").agg(on(False).alias("old"), on(True).alias("new")).withColumnRenamed("at", "root")
    return trees.two_snapshots(sides, h.commits, h.touches_where(match))


STATUS = "SELECT root, path, CASE WHEN a.value IS NULL THEN 'A' WHEN b.value IS NULL THEN 'D' ELSE 'M' END AS status FROM sa a FULL JOIN sb b USING (root, path) WHERE a.value IS DISTINCT FROM b.value"
TREES = dict(
    old=OLD,
    ra=OLD_REACH.replace("old_reach", "ra").replace("ON parents.child = ra.node", "ON parents.child = ra.node AND parents.ord = 0"),
    rb=FIRST.replace("reach", "rb"),
    sa=SNAP.format(r="ra"),
    sb=SNAP.format(r="rb"),
)


@query(oracle("commits parents heads touches", STATUS, **TREES))
def tree_diff_name_status(h: History) -> DataFrame:
    return trees.statuses(two_snapshots(h), ["root", "path"])


@query(oracle("commits parents heads touches", STATUS + " AND (path = 'Brand#2' OR substr(path, 1, 8) = 'Brand#2/')", **TREES))
def tree_diff_filtered(h: History) -> DataFrame:
    return trees.statuses(two_snapshots(h, trees.below(F.col("path"), ["Brand#2"])), ["root", "path"])


@query(oracle("commits parents heads touches", "SELECT path, value FROM sb WHERE root = (SELECT min(root) FROM sb)", **TREES))
def ls_tree_recursive(h: History) -> DataFrame:
    reached = materialized(graph.closure(tips(h), h.edges, True))
    parts = h.part.select(F.col("p_partkey").alias("l_partkey"))
    written = h.lineitem.join(parts, "l_partkey", "left_semi").select(F.col("l_orderkey").alias("node"))
    first = reached.join(written, "node", "left_semi").agg(F.min("root").alias("root"))
    # One branch's commits: only what they write is looked at.
    mine = materialized(reached.join(F.broadcast(first), "root", "left_semi"))
    return trees.snapshot(mine, h.commits, h.touches_where(ids=mine.select(F.col("node").alias("id")).distinct())).select("path", "value")


@query(oracle("files", "SELECT name, 'tree' AS kind, row_number() OVER (ORDER BY name || '/') AS pos FROM (SELECT DISTINCT split_part(path, '/', 1) AS name FROM files)"))
def ls_tree_root(h: History) -> DataFrame:
    return trees.ls_tree(h.files)


@query(oracle("files", "SELECT path FROM files WHERE path LIKE 'src1%/en/%' AND NOT path LIKE '%7.txt'"))
def ls_files(h: History) -> DataFrame:
    return h.files.where(pathspec.compile_specs(["src1*/en/*", ":!*7.txt"], F.col("path"))).select("path")


@query(oracle("files", "SELECT path, CAST(strlen(content) AS BIGINT) AS size, sha1(concat('blob ', strlen(content), chr(0), content)) AS oid FROM files"))
def cat_file_size(h: History) -> DataFrame:
    return h.files.select("path", F.octet_length("content").cast("long").alias("size"), search.blob_id(F.col("content")).alias("oid"))


@query(oracle("files", "SELECT path, row_number() OVER (ORDER BY path) AS pos FROM (SELECT path FROM files WHERE path > 'src12' ORDER BY path LIMIT 50)"))
def keyset_page(h: History) -> DataFrame:
    return trees.page(h.files.select("path"), "src12", 50).withColumn("pos", F.row_number().over(Window.orderBy("path")).cast("long"))


@query(oracle("commits", "SELECT oid, row_number() OVER (ORDER BY time DESC, id DESC) AS pos FROM (SELECT * FROM commits ORDER BY time DESC, id DESC LIMIT 20)"))
def top_k(h: History) -> DataFrame:
    top = h.commits.orderBy(F.desc("time"), F.desc("id")).limit(20)
    return top.select("oid", F.row_number().over(Window.orderBy(F.desc("time"), F.desc("id"))).cast("long").alias("pos"))


@query(oracle("files", "SELECT oid, count(*) AS n, min(path) AS first_path FROM (SELECT path, sha1(concat('blob ', strlen(content), chr(0), content)) AS oid FROM files) GROUP BY oid HAVING count(*) > 1"))
def duplicate_blobs(h: History) -> DataFrame:
    return h.files.groupBy(search.blob_id(F.col("content")).alias("oid")).agg(F.count("*").alias("n"), F.min("path").alias("first_path")).where("n > 1")


# Pathspecs and attributes ---------------------------------------------------------------------------------------------


def spec_query(name: str, specs: list[str], test: str) -> None:
    def run(h: History) -> DataFrame:
        return h.touches.where(pathspec.compile_specs(specs, F.col("path"))).select("id", "path")

    run.__name__ = name
    query(oracle("touches", f"SELECT id, path FROM touches WHERE {test}"))(run)


spec_query("path_filter_literal", ["Brand#2/ECONOMY"], "substr(path, 1, 16) = 'Brand#2/ECONOMY/'")
spec_query("path_filter_glob", [":(glob)Brand#?/*/1?"], "regexp_full_match(path, 'Brand#[^/]/[^/]*/1[^/]')")
spec_query("path_filter_double_star", [":(glob)Brand#1[0-3]/**/*7"], "regexp_full_match(path, 'Brand#1[0-3]/([^/]*/)*[^/]*7')")
spec_query("path_filter_icase", [":(icase)BRAND#3/small"], "substr(lower(path), 1, 14) = 'brand#3/small/'")
spec_query("path_filter_exclude", ["Brand#2", ":!*ECONOMY*"], "substr(path, 1, 8) = 'Brand#2/' AND path NOT LIKE '%ECONOMY%'")

LEVELS = """SELECT DISTINCT unnest([p1, p1 || '/' || p2, path, path || '/x']) AS path FROM (SELECT path, split_part(path, '/', 1) AS p1, split_part(path, '/', 2) AS p2 FROM touches)"""


def level_query(name: str, specs: list[str], test: str) -> None:
    """A specification over paths of one to four parts."""

    def run(h: History) -> DataFrame:
        parts = F.split("path", "/")
        each = F.array(F.get(parts, F.lit(0)), F.array_join(F.slice(parts, 1, 2), "/"), F.col("path"), F.concat("path", F.lit("/x")))
        paths = h.touches.select(F.explode(each).alias("path")).distinct()
        return paths.where(pathspec.compile_specs(specs, F.col("path")))

    run.__name__ = name
    query(oracle("touches", f"SELECT path FROM levels WHERE {test}", levels=LEVELS))(run)


level_query("path_levels_glob", [":(glob)Brand#1?/*"], "regexp_full_match(path, 'Brand#1[^/]/[^/]*')")
level_query("path_levels_plain", ["Brand#1?/*7"], "regexp_full_match(path, 'Brand#1[^/]/.*7')")
level_query("path_levels_folder", [":(glob)*/*/"], "regexp_full_match(path, '[^/]*/[^/]*/.*')")
level_query("path_levels_unclosed", ["Brand#2[", "Brand#2"], "path = 'Brand#2' OR substr(path, 1, 8) = 'Brand#2/'")


@query(
    oracle(
        "touches",
        "SELECT path, CASE WHEN path LIKE 'Brand#2/%/%' AND split_part(path, '/', 2) = 'ECONOMY' THEN substr(path, 17) WHEN path LIKE 'Brand#2/%' THEN '../' || substr(path, 9) ELSE '../../' || path END AS relative FROM (SELECT DISTINCT path FROM touches)",
    )
)
def relative_paths(h: History) -> DataFrame:
    return h.touches.select("path").distinct().select("path", pathspec.relative_to(F.col("path"), "Brand#2/ECONOMY").alias("relative"))


RULES = [
    (0, 1, "", "*.txt", "text", "+"), (0, 2, "", "src1/**", "generated", "+"), (0, 3, "", "src2/**", "binary", "+"),
    (1, 1, "src1", "*.txt", "text", "-"), (1, 2, "src3", "*.txt", "lang", "prose"), (1, 3, "src3", "*.txt", "text", "!"),
]


@query(
    oracle(
        "files",
        "SELECT path, attribute, state FROM (SELECT path, attribute, arg_max(state, depth * 100 + line * 10 + step) AS state FROM files JOIN r ON "
        "(base = '' OR substr(path, 1, length(base) + 1) = base || '/') AND (pattern = '*.txt' OR split_part(path, '/', 1) || '/**' = pattern) GROUP BY 1, 2) WHERE state <> '!'",
        r="SELECT * FROM (VALUES " + ", ".join(str((*x, 0)) for x in RULES) + ", (0, 3, '', 'src2/**', 'diff', '-', 1), (0, 3, '', 'src2/**', 'merge', '-', 2), (0, 3, '', 'src2/**', 'text', '-', 3)) AS t(depth, line, base, pattern, attribute, state, step)",
    )
)
def attr_filter(h: History) -> DataFrame:
    rules = h.spark.createDataFrame(RULES, "depth int, line int, base string, pattern string, attribute string, state string")
    return attributes.states(h.files, rules)


# References -----------------------------------------------------------------------------------------------------------


@query(
    oracle(
        "commits",
        "SELECT id, oid, substr(oid, 1, least(40, greatest(7, 1 + coalesce(lcp(before), 0), 1 + coalesce(lcp(after), 0)))) AS short FROM near".replace("lcp(before)", "len(list_filter(range(1, 41), lambda i: substr(oid, 1, i) = substr(before, 1, i)))").replace(
            "lcp(after)", "len(list_filter(range(1, 41), lambda i: substr(oid, 1, i) = substr(after, 1, i)))"
        ),
        near="SELECT id, oid, lag(oid) OVER (ORDER BY oid) AS before, lead(oid) OVER (ORDER BY oid) AS after FROM commits",
    )
)
def abbrev_unique(h: History) -> DataFrame:
    return refs.abbreviations(h.commits)


@query(
    oracle(
        "commits refs",
        "SELECT name, arg_min(id, rank) AS id, arg_min(how, rank) AS how FROM (SELECT a.name, refs.id, a.rank, 'ref' AS how FROM asked a JOIN refs ON refs.name = a.place "
        "UNION ALL SELECT asked.name, min(c.id), 6, 'object' FROM (SELECT DISTINCT name FROM asked) asked JOIN commits c ON substr(asked.name, 1, 8) = substr(c.oid, 1, 8) AND length(asked.name) >= 8 AND starts_with(c.oid, asked.name) "
        "GROUP BY asked.name HAVING count(DISTINCT c.oid) = 1) GROUP BY name",
        names="SELECT name FROM refs UNION SELECT split_part(name, '/', 3) FROM refs UNION SELECT substr(oid, 1, 8) FROM commits",
        asked="SELECT name, unnest(['refs/heads/' || name, name, 'refs/' || name, 'refs/tags/' || name]) AS place, unnest([0, 1, 2, 3]) AS rank FROM names",
    )
)
def resolve_name_cascade(h: History) -> DataFrame:
    names = h.refs.select("name").union(h.refs.select(F.element_at(F.split("name", "/"), 3))).union(h.commits.select(F.substring("oid", 1, 8))).distinct()
    return refs.resolve(names, h.refs, h.commits)


@query(oracle("commits refs", "SELECT substr(refs.name, 12) AS name, oid, subject FROM refs JOIN commits USING (id) WHERE refs.name LIKE 'refs/heads/%' AND regexp_full_match(substr(refs.name, 12), 'c1.*')"))
def branch_verbose(h: History) -> DataFrame:
    return refs.listing(h.refs, h.commits, "refs/heads/", "c1*")


@query(oracle("commits refs", "SELECT oid, refs.name AS name FROM refs JOIN commits USING (id) WHERE refs.name LIKE 'refs/tags/%'"))
def show_ref_tags(h: History) -> DataFrame:
    return h.refs.where(F.startswith("name", F.lit("refs/tags/"))).join(h.commits.select("id", "oid"), "id").select("oid", "name")


@query(oracle("commits refs", "SELECT oid, refs.name AS name FROM refs JOIN commits USING (id) UNION ALL SELECT oid, refs.name || '^{}' AS name FROM refs JOIN commits USING (id) WHERE refs.name LIKE 'refs/tags/%'"))
def show_ref_deref(h: History) -> DataFrame:
    own = h.refs.join(h.commits.select("id", "oid"), "id").select("oid", "name")
    return own.unionByName(own.where(F.startswith("name", F.lit("refs/tags/"))).withColumn("name", F.concat("name", F.lit("^{}"))))


@query(oracle("commits refs", "SELECT oid, refs.name AS name FROM refs JOIN commits USING (id) WHERE regexp_full_match(refs.name, '(.*/)?(c10|heads/c2|v30)')"))
def show_ref_suffix(h: History) -> DataFrame:
    return refs.with_suffix(h.refs, ["c10", "heads/c2", "v30"]).join(h.commits.select("id", "oid"), "id").select("oid", "name")


@query(
    oracle(
        "commits refs",
        "SELECT name, CASE WHEN count(DISTINCT id) = 1 THEN min(id) END AS id, CASE count(DISTINCT id) WHEN 0 THEN 'missing' WHEN 1 THEN 'ok' ELSE 'ambiguous' END AS state FROM ("
        "SELECT a.name, r.id FROM (SELECT name, unnest(['refs/heads/' || name, name, 'refs/' || name, 'refs/tags/' || name]) AS full FROM names) a JOIN refs r ON r.name = a.full "
        "UNION ALL SELECT n.name, c.id FROM names n JOIN commits c ON substr(n.name, 1, 4) = substr(c.oid, 1, 4) AND length(n.name) = 4 AND regexp_full_match(n.name, '[0-9a-f]*') AND n.name NOT IN (SELECT split_part(name, '/', 3) FROM refs) "
        "UNION ALL SELECT name, NULL FROM names) GROUP BY name",
        names="SELECT name FROM refs UNION SELECT split_part(name, '/', 3) FROM refs UNION SELECT substr(oid, 1, 4) FROM commits UNION SELECT 'none' || id FROM commits",
    )
)
def rev_parse_names(h: History) -> DataFrame:
    """References by full and short names, four-digit prefixes (some of them ambiguous), and names that nothing has."""
    names = h.refs.select("name").union(h.refs.select(F.element_at(F.split("name", "/"), 3))).union(h.commits.select(F.substring("oid", 1, 4))).union(h.commits.select(F.concat(F.lit("none"), F.col("id").cast("string"))))
    return refs.rev_parse(names, h.refs, h.commits)


@query(oracle("refs", "SELECT split_part(name, '/', 2) AS kind, CAST(max(length(name) - length(split_part(name, '/', 2)) - 6) AS BIGINT) AS width FROM refs GROUP BY 1"))
def ref_widths(h: History) -> DataFrame:
    return refs.widths(h.refs)


@query(oracle("files", "SELECT path, hex(encode(content)[11:40]) AS part FROM files WHERE content IS NOT NULL"))
def blob_part(h: History) -> DataFrame:
    return h.files.where("content IS NOT NULL").select("path", F.hex(trees.blob_range(F.encode("content", "UTF-8"), 10, 30)).alias("part"))


# Search ---------------------------------------------------------------------------------------------------------------

LINES = """SELECT path, line_no, line FROM (SELECT path, unnest(ls) AS line, CAST(generate_subscripts(ls, 1) AS BIGINT) AS line_no FROM (
  SELECT path, CASE WHEN content LIKE '%' || chr(10) THEN string_split(substr(content, 1, length(content) - 1), chr(10)) ELSE string_split(content, chr(10)) END AS ls FROM files WHERE content <> ''))"""


def grep_query(name: str, sql: str, run: Callable[[DataFrame], DataFrame]) -> None:
    def f(h: History) -> DataFrame:
        return run(h.files)

    f.__name__ = name
    query(oracle("files", sql, lines=LINES))(f)


grep_query("grep_lines", "SELECT path, line_no, line FROM lines WHERE regexp_matches(line, 'th(e|at) [a-z]+ion')", lambda f: search.grep(f, ["th(e|at) [a-z]+ion"]))
grep_query("grep_count", "SELECT path, count(*) AS n FROM lines WHERE regexp_matches(line, 'tion') GROUP BY path", lambda f: search.grep_counts(f, ["tion"]))
grep_query("grep_files", "SELECT DISTINCT path FROM lines WHERE regexp_matches(line, '^The ')", lambda f: search.grep_files(f, ["^The "]))
grep_query("grep_invert", "SELECT path, count(*) AS n FROM lines WHERE NOT regexp_matches(line, '[.!?]$') GROUP BY path", lambda f: search.grep_counts(f, ["[.!?]$"], invert=True))
grep_query("grep_fixed", "SELECT path, line_no, line FROM lines WHERE contains(line, 'token = \"')", lambda f: search.grep(f, ['token = "'], fixed=True))
grep_query("grep_icase", "SELECT path, count(*) AS n FROM lines WHERE regexp_matches(line, '(?i)and the') GROUP BY path", lambda f: search.grep_counts(f, ["and the"], icase=True))
grep_query("grep_multi", "SELECT path, line_no, line FROM lines WHERE regexp_matches(line, 'ingsh') OR regexp_matches(line, 'bleen[ .]')", lambda f: search.grep(f, ["ingsh", "bleen[ .]"]))
grep_query("grep_basic", "SELECT path, count(*) AS n FROM lines WHERE regexp_matches(line, '(th|an)er\\+?') GROUP BY path", lambda f: search.grep_counts(f, ["\\(th\\|an\\)er+\\?"], basic=True))


@query(
    oracle(
        "files",
        "SELECT old, new FROM (SELECT d.path AS old, a.path AS new FROM (SELECT path, oid, row_number() OVER (PARTITION BY oid ORDER BY path) AS k FROM b WHERE path < 'src5') d JOIN "
        "(SELECT path, oid, row_number() OVER (PARTITION BY oid ORDER BY path) AS k FROM b WHERE path >= 'src5') a USING (oid, k))",
        b="SELECT path, sha1(concat('blob ', strlen(content), chr(0), content)) AS oid FROM files",
    )
)
def rename_exact_pairs(h: History) -> DataFrame:
    """Base names (document ids) never agree between two files here, so pairs go by path order alone."""
    b = h.files.select("path", search.blob_id(F.col("content")).alias("oid"))
    return search.exact_renames(b.where("path < 'src5'"), b.where("path >= 'src5'"))


@query()
def rename_similarity(h: History) -> DataFrame:
    """Pairs of contents that share half of the larger one or more, and the copies of each; not SQL-expressible, since spans are cut by byte."""
    return search.similar_pairs(h.files)


# Line differences and blame ---------------------------------------------------------------------------------------------


def versions(h: History) -> DataFrame:
    """Conversations as files: a version for each turn that holds this turn and up to three before it."""
    own = Window.partitionBy("conv_id").orderBy("turn")
    text = F.array_join(F.collect_list(F.coalesce("text", F.lit(""))).over(own.rowsBetween(-3, 0)), "\n")
    rows = h.conversations.select("conv_id", "turn", text.alias("content"), F.lag("turn").over(own).alias("before"))
    node = lambda c: F.col("conv_id") * 1_000_000 + F.col(c)
    return rows.select("conv_id", "turn", node("turn").alias("node"), node("before").alias("parent"), "content")


def version_edges(v: DataFrame) -> DataFrame:
    return v.where("parent IS NOT NULL").select(F.col("node").alias("child"), F.lit(0).alias("ord"), "parent")


def version_pairs(v: DataFrame) -> DataFrame:
    return v.where("parent IS NOT NULL").join(v.select(F.col("node").alias("parent"), F.col("content").alias("old")), "parent")


VERSIONS = """SELECT conv_id, turn, string_agg(coalesce(text, ''), chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS content FROM conversations"""


@query(
    "WITH v AS (" + VERSIONS + "), l AS (SELECT conv_id, turn, unnest(string_split(content, chr(10))) AS line FROM v), "
    "c AS (SELECT conv_id, turn, line, count(*) AS n FROM l WHERE line <> '' GROUP BY ALL), k AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM v) "
    "SELECT k.conv_id, k.turn, coalesce((SELECT sum(greatest(0, a.n - coalesce(b.n, 0))) FROM c a LEFT JOIN c b ON b.conv_id = a.conv_id AND b.turn = k.before AND b.line = a.line "
    "WHERE a.conv_id = k.conv_id AND a.turn = k.turn), 0)::BIGINT AS added FROM k WHERE before IS NOT NULL"
)
def line_multiset_added(h: History) -> DataFrame:
    """Lines that a version has more often than the one before: a lower bound of the insertions of any line difference."""
    v = versions(h)
    part = lambda d, c: d.select("node", F.explode(F.split(c, "\n", -1)).alias("line")).where("line <> ''").groupBy("node", "line").agg(F.count("*").alias("n"))
    pairs_ = version_pairs(v)
    new, was = part(pairs_, "content"), part(pairs_, "old").withColumnRenamed("n", "m")
    more = new.join(was, ["node", "line"], "left").groupBy("node").agg(F.sum(F.greatest(F.lit(0), F.col("n") - F.coalesce("m", F.lit(0)))).alias("added"))
    return pairs_.select("conv_id", "turn", "node").join(more, "node", "left").select("conv_id", "turn", F.coalesce("added", F.lit(0)).cast("long").alias("added"))


@query()
def line_diff(h: History) -> DataFrame:
    """Minimal edit scripts; minimality is tested against dynamic programming."""
    pairs_ = version_pairs(versions(h))
    rows = textdiff.diff_rows(pairs_, F.col("old"), F.col("content"), "conv_id", "turn")
    return rows.groupBy("conv_id", "turn").agg(F.count_if(F.col("kind") == "-").alias("deleted"), F.count_if(F.col("kind") == "+").alias("inserted"), F.count_if(F.col("kind") == " ").alias("kept"))


@query()
def unified_patch(h: History) -> DataFrame:
    return version_pairs(versions(h)).select("conv_id", "turn", textdiff.unified_diff("old", "content").alias("patch"))


@query()
def blame_lines(h: History) -> DataFrame:
    """Attribution of every conversation's last version; tested against a plain walker."""
    v = materialized(versions(h))
    last = v.groupBy(F.col("conv_id").alias("root")).agg(F.max_by("node", "turn").alias("node"))
    return blame.blame(last, v.select("node", "content"), version_edges(v))


@query()
def blame_records(h: History) -> DataFrame:
    """Attribution with the previous version and the lengths of groups, lines 2 to 40; tested against a plain walker."""
    v = materialized(versions(h))
    last = v.groupBy(F.col("conv_id").alias("root")).agg(F.max_by("node", "turn").alias("node"))
    files, edges = v.select("node", "content"), version_edges(v)
    rows = materialized(blame.blame(last, files, edges))
    return blame.in_range(blame.previous(blame.with_groups(rows), files, edges), 2, 40).select("root", "final_line", "node", "original_line", "previous", "group_lines")


@query(
    "WITH m AS (SELECT l_orderkey AS root, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS final_line, l_suppkey % 3 AS node FROM lineitem), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY root, node ORDER BY final_line) AS original_line FROM m), "
    "g AS (SELECT *, final_line - original_line AS island FROM o) SELECT root, node, min(final_line) AS first_line, count(*) AS lines FROM g GROUP BY root, node, island"
)
def blame_groups(h: History) -> DataFrame:
    """Runs in rows whose origin is given by a fixed rule on line items."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    m = spread(h.lineitem, "l_orderkey").select(F.col("l_orderkey").alias("root"), F.row_number().over(order).cast("long").alias("final_line"), (F.col("l_suppkey") % 3).alias("node"))
    rows = m.withColumn("original_line", F.row_number().over(Window.partitionBy("root", "node").orderBy("final_line")).cast("long"))
    return blame.groups(rows)


# Summaries --------------------------------------------------------------------------------------------------------------


@query(oracle("commits", "SELECT author, count(*) AS n FROM commits GROUP BY author"))
def shortlog_count(h: History) -> DataFrame:
    return shortlog.counts(h.commits)


@query(oracle("commits", "SELECT concat(author, ' <', email, '>') AS author, count(*) AS n FROM commits GROUP BY 1"))
def shortlog_email(h: History) -> DataFrame:
    return shortlog.counts(h.commits, with_email=True)


@query(oracle("commits parents", "SELECT author, count(*) AS n FROM commits WHERE id NOT IN (SELECT child FROM parents WHERE ord = 1) GROUP BY author"))
def shortlog_no_merges(h: History) -> DataFrame:
    return shortlog.counts(h.commits, merges=h.edges.where("ord = 1").select(F.col("child").alias("id")).distinct())


@query(
    oracle(
        "commits",
        "SELECT CASE WHEN c_custkey % 10 = 0 THEN 'Decade Buyer' WHEN c_custkey % 2 = 0 THEN concat('Even ', c_mktsegment) ELSE author END AS author, count(*) AS n FROM commits JOIN customer ON c_custkey = branch GROUP BY 1",
    )
)
def shortlog_mailmap(h: History) -> DataFrame:
    """A rule by email for even customers, and a later one by name and email for every tenth."""
    email = F.concat(F.upper("c_name"), F.lit("@"), F.lower("c_mktsegment"), F.lit(".example"))
    none = F.lit(None).cast("string")
    rule = lambda line, cond, name, old_name: h.customer.where(cond).select(F.lit(line).alias("line_no"), name.alias("name"), none.alias("email"), old_name.alias("old_name"), email.alias("old_email"))
    rules = rule(2, "c_custkey % 2 = 0", F.concat(F.lit("Even "), F.col("c_mktsegment")), none).unionByName(rule(1, "c_custkey % 10 = 0", F.lit("Decade Buyer"), F.col("c_name")))
    return shortlog.counts(shortlog.mapped(h.commits, rules))


@query(oracle("commits", "SELECT author, count(*) OVER (PARTITION BY author) AS n, row_number() OVER (PARTITION BY author ORDER BY time, id) AS pos, subject FROM commits"))
def shortlog_subjects(h: History) -> DataFrame:
    return shortlog.subjects(h.commits)


@query(oracle("commits", "SELECT author, n, row_number() OVER (ORDER BY n DESC, author) AS pos FROM (SELECT author, count(*) AS n FROM commits GROUP BY author)"))
def shortlog_by_count(h: History) -> DataFrame:
    return shortlog.ordered(shortlog.counts(h.commits), by_count=True)


@query(
    oracle(
        "commits",
        "SELECT id, list_reduce(list_prepend('      ', list_filter(string_split(repeat(subject || ' ', id % 12), ' '), lambda w: w <> '')), lambda acc, w: "
        "CASE WHEN length(regexp_extract(acc, '[^\n]*$')) = 6 THEN acc || w WHEN length(regexp_extract(acc, '[^\n]*$')) + 1 + length(w) > 76 THEN acc || chr(10) || '      ' || w ELSE acc || ' ' || w END) AS text FROM commits",
    )
)
def shortlog_wrapped(h: History) -> DataFrame:
    return h.commits.select("id", shortlog.wrapped(F.expr("repeat(concat(subject, ' '), int(id % 12))")).alias("text"))


@query(oracle("commits touches", "SELECT path, arg_max(value, touches.id) AS value, max(touches.id) AS id FROM touches GROUP BY path"))
def latest_per_key(h: History) -> DataFrame:
    return h.touches.groupBy("path").agg(F.max_by("value", "id").alias("value"), F.max("id").alias("id"))


# Incremental --------------------------------------------------------------------------------------------------------------

COVERED = "SELECT id FROM commits WHERE id % 3 <> 0"


@query(oracle("commits parents", f"SELECT DISTINCT parent FROM parents WHERE child IN ({COVERED}) AND parent NOT IN ({COVERED})"))
def coverage_frontier(h: History) -> DataFrame:
    return ingest.frontier(h.commits.where("id % 3 <> 0"), h.edges)


@query(
    oracle(
        "commits parents",
        f"SELECT branch, count(*) AS covered, NOT coalesce(bool_or(id IN (SELECT child FROM parents WHERE parent NOT IN ({COVERED}))), FALSE) AS complete FROM commits WHERE id % 3 <> 0 GROUP BY branch",
    )
)
def coverage_progress(h: History) -> DataFrame:
    return ingest.progress(h.commits.where("id % 3 <> 0"), h.edges, "branch").drop("error")


@query("SELECT o_custkey AS branch, count(*) AS covered, max(o_orderkey) AS latest FROM orders GROUP BY o_custkey")
def stream_ingest(h: History) -> DataFrame:
    """Orders arrive as a stream of commits; the covered table after it ends equals the batch table."""
    rows = ingest.ingest_table(h.spark, h.sf_dir, "orders.parquet", ["o_orderkey AS id", "o_custkey AS branch"])
    return rows.groupBy("branch").agg(F.count("*").alias("covered"), F.max("id").alias("latest"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history of one path, newest first, with display columns joined after the limit."""
    h = History(spark, sf_dir)
    shown = history.path_log(tips(h), h.commits, h.edges, writes(h, ["Brand#2"]))
    rows = graph.by_time(shown, h.commits).where("pos <= 10")
    return rows.join(h.commits.select(F.col("id").alias("node"), "oid", "author", "subject"), "node").select("root", "pos", "oid", "author", "subject")
