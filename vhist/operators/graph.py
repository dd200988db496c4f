"""Reachability over parent edges: closures, ranges, merge bases, chains, walk order.

Edges are (child, ord, parent); a question is a set of (root, node) rows, so that one plan answers it for any number of
roots at once. Nodes are laid on chains: each parent goes on with one of the children whose first parent it is. What a root reaches
of a chain is all up to some height, so reachability is a few (root, chain, height) rows: chains are labelled by pointer doubling in
rounds logarithmic in the depth, and the closure takes a round for each change of chains on the way, not for each
commit. Ranges and common ancestors are compared as heights; only the answer becomes (root, node) rows. Nothing is collected,
and every round is cut by a stored table.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vhist.plans.materialize import materialized, stored_once

#: Rows of one root that a task puts in order by itself.
ROWS_A_ROOT = 1_000_000


def doubled(jump: DataFrame) -> DataFrame:
    """(node, to, n, done) moved on to where `to` points, unless done."""
    far = jump.select(F.col("node").alias("to"), F.col("to").alias("far"), F.col("n").alias("m"), F.col("done").alias("far_done"))
    moved = jump.where("NOT done").join(far, "to").select("node", F.col("far").alias("to"), (F.col("n") + F.col("m")).alias("n"), F.col("far_done").alias("done"))
    return jump.where("done").unionByName(moved)


class Reach:
    """The chains of a graph. ``edges`` may be any selection of parent edges; nodes that no edge names are chains of their own."""

    def __init__(self, edges: DataFrame, first_parent: bool = False):
        kept = stored_once(edges)
        self.edges = (kept.where("ord = 0") if first_parent else kept).select("child", "ord", "parent")

    @cached_property
    def chains(self) -> DataFrame:
        """(node, chain, h): the chain, named by its oldest node, and the height on it from 0, of all nodes that edges name."""
        down = self.edges.groupBy("child").agg(F.min_by("parent", "ord").alias("parent"))
        up = down.groupBy("parent").agg(F.min("child").alias("node"))
        nodes = self.edges.select(F.explode(F.array("child", "parent")).alias("node")).distinct()
        now = nodes.join(up, "node", "left").select("node", F.coalesce("parent", "node").alias("to"), F.col("parent").isNotNull().cast("long").alias("n"), F.col("parent").isNull().alias("done"))
        now = materialized(now)
        while not now.where("NOT done").isEmpty():
            now = materialized(doubled(doubled(now)))
        return now.select("node", F.col("to").alias("chain"), F.col("n").alias("h"))

    @cached_property
    def crossings(self) -> DataFrame:
        """(chain, h, to, to_h): the edges that leave a chain."""
        at = self.chains
        both = self.edges.join(at.withColumnsRenamed({"node": "child"}), "child").join(at.select(F.col("node").alias("parent"), F.col("chain").alias("to"), F.col("h").alias("to_h")), "parent")
        return materialized(both.where("chain <> to").select("chain", "h", "to", "to_h", "parent"))

    def place(self, rows: DataFrame, node: str = "node") -> DataFrame:
        """Adds chain and h to rows; nodes without edges are chains of their own."""
        at = self.chains.select(F.col("node").alias(node), F.col("chain").alias("c"), F.col("h").alias("k"))
        return rows.join(at, node, "left").withColumns({"chain": F.coalesce("c", node), "h": F.coalesce("k", F.lit(0).cast("long"))}).drop("c", "k")

    def heights(self, starts: DataFrame) -> DataFrame:
        """(root, chain, h): up to which height each root reaches each chain."""
        top = lambda rows: rows.groupBy("root", "chain").agg(F.max("h").alias("h"))

        def over(rows: DataFrame) -> DataFrame:
            met = rows.withColumnRenamed("h", "top").join(self.crossings, "chain").where("h <= top")
            return met.select("root", F.col("to").alias("chain"), F.col("to_h").alias("h"))

        new = known = materialized(top(self.place(starts.select("root", "node").distinct())))
        pieces = 1
        while True:
            # Two changes of chains in one round.
            once = top(over(new))
            far = top(once.unionByName(over(once)))
            new = materialized(far.join(top(known).withColumnRenamed("h", "known"), ["root", "chain"], "left").where("known IS NULL OR h > known").select("root", "chain", "h"))
            if new.isEmpty():
                return top(known)
            known, pieces = known.unionByName(new), pieces + 1
            if pieces % 8 == 0:
                known = materialized(top(known))

    def nodes(self, heights: DataFrame) -> DataFrame:
        """(root, node) of rows (root, chain, h) and, if there is a column `over`, above that height only."""
        lone = heights.join(self.chains.select("chain").distinct(), "chain", "left_anti").select("root", F.col("chain").alias("node"))
        above = F.col("k") > F.col("over") if "over" in heights.columns else F.lit(True)
        met = heights.join(self.chains.select("chain", "node", F.col("h").alias("k")), "chain").where((F.col("k") <= F.col("h")) & above)
        return met.select("root", "node").unionByName(lone)


def closure(roots: DataFrame, edges: DataFrame, first_parent: bool = False, reach: Reach | None = None) -> DataFrame:
    """(root, node): each root's start nodes and all their ancestors."""
    reach = reach or Reach(edges, first_parent)
    return reach.nodes(reach.heights(roots))


def ranges(include: DataFrame, exclude: DataFrame, edges: DataFrame, first_parent: bool = False) -> DataFrame:
    """`^exclude include`: what include reaches and exclude doesn't. Exclusions always use all parents."""
    reach = Reach(edges)
    out = reach.heights(exclude)
    if first_parent:
        found = closure(include, edges, True)
        gone = reach.place(found).join(out.withColumnRenamed("h", "over"), ["root", "chain"], "left")
        return gone.where("over IS NULL OR h > over").select("root", "node")
    left = reach.heights(include).join(out.withColumnRenamed("h", "over"), ["root", "chain"], "left").where("over IS NULL OR h > over")
    return reach.nodes(left.withColumn("over", F.coalesce("over", F.lit(-1).cast("long"))))


def merge_bases(pairs: DataFrame, edges: DataFrame, commits: DataFrame) -> DataFrame:
    """(pair, node, pos) for rows of (pair, a, b): the common ancestors that no other common ancestor descends to, latest
    first, ties by oid. Pairs without one give no row."""
    reach = Reach(edges)
    ends = pairs.select(F.explode(F.array(F.struct("pair", F.lit(0).alias("side"), F.col("a").alias("node")), F.struct("pair", F.lit(1).alias("side"), F.col("b").alias("node")))).alias("e"))
    found = reach.heights(ends.select(F.struct("e.pair", "e.side").alias("root"), F.col("e.node").alias("node")))
    common = found.groupBy(F.col("root.pair").alias("root"), "chain").agg(F.count("*").alias("sides"), F.min("h").alias("h")).where("sides = 2").drop("sides")
    common = materialized(common)
    # Of each chain only the highest common node can be a base; it isn't where a common node of another chain has it as parent.
    tops = common.withColumn("over", F.col("h") - 1)
    below = common.withColumnRenamed("h", "top").join(reach.crossings, "chain").where("h <= top").select("root", F.col("parent").alias("node"))
    best = reach.nodes(tops).join(below, ["root", "node"], "left_anti")
    order = Window.partitionBy("root").orderBy(F.desc("time"), "oid")
    named = best.join(commits.select(F.col("id").alias("node"), "time", "oid"), "node")
    return named.select(F.col("root").alias("pair"), "node", F.row_number().over(order).cast("long").alias("pos"))


def is_ancestor(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(pair, yes): whether a is b or an ancestor of b, by a's height on its chain."""
    reach = Reach(edges)
    found = reach.heights(pairs.select(F.col("pair").alias("root"), F.col("b").alias("node")))
    asked = reach.place(pairs, "a").join(found.select(F.col("root").alias("pair"), "chain", F.col("h").alias("top")), ["pair", "chain"], "left")
    return asked.select("pair", F.coalesce(F.col("h") <= F.col("top"), F.lit(False)).alias("yes"))


def nth_ancestor(starts: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """`root~n` by doubling: the n-th first parent of each start; roots without one give no row."""
    jump = edges.where("ord = 0").select(F.col("child").alias("node"), F.col("parent").alias("to"))
    at = starts.select("root", "node")
    while n:
        if n & 1:
            at = at.join(jump, "node").select("root", F.col("to").alias("node"))
        n >>= 1
        if n:
            jump = materialized(jump.join(jump.select(F.col("node").alias("to"), F.col("to").alias("far")), "to").select("node", F.col("far").alias("to")))
    return at


def nth_parent(starts: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """`root^n` (1: the first parent)."""
    own = edges.where(F.col("ord") == n - 1).select(F.col("child").alias("node"), "parent")
    return starts.join(own, "node").select("root", F.col("parent").alias("node"))


def time_key(rows: DataFrame) -> Column:
    """`time` as a number, be it epoch seconds or a timestamp."""
    kind = rows.schema["time"].dataType.simpleString()
    return F.col("time").cast("long") if kind in ("bigint", "int") else F.unix_micros(F.col("time").cast("timestamp"))


def timed(reached: DataFrame, commits: DataFrame) -> DataFrame:
    """(root, node, t, pos, tie): `pos` from 1, latest commit first, ties by the larger id; `tie` marks rows whose time another row of the
    root has. The rows of a root are put in order by one task, unless there are more than ROWS_A_ROOT: those are dealt by a range sort over as
    many tasks as they fill; a row's place is its place in the task's rows after the rows of the tasks before."""
    reached = stored_once(reached)
    # Few: at most one root for each ROWS_A_ROOT rows.
    large = materialized(reached.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > ROWS_A_ROOT).select("root"))
    order = [F.desc("t"), F.desc("node")]

    def keyed(found: DataFrame) -> DataFrame:
        rows = found.join(commits.select(F.col("id").alias("node"), "time"), "node")
        return rows.select("root", "node", time_key(rows).alias("t"))

    def placed(rows: DataFrame) -> DataFrame:
        one = Window.partitionBy("root").orderBy(*order)
        same = lambda other: F.coalesce(other(F.struct("t")).over(one) == F.struct("t"), F.lit(False))
        tie = same(F.lag) | same(F.lead)
        return rows.select("root", "node", "t", F.row_number().over(one).cast("long").alias("pos"), tie.alias("tie"))

    if large.isEmpty():
        return placed(keyed(reached))
    sorted_ = keyed(reached.join(F.broadcast(large), "root", "left_semi")).repartitionByRange("root", *order)
    sorted_ = materialized(sorted_.withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("root").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = sorted_.groupBy("root", "part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    ties = sorted_.groupBy("root", "t").agg((F.count("*") > 1).alias("tie"))
    nth = F.row_number().over(Window.partitionBy("root", "part").orderBy(*order)).cast("long")
    dealt = sorted_.join(counts, ["root", "part"]).select("root", "node", "t", (F.col("before") + nth).alias("pos"))
    return placed(keyed(reached.join(F.broadcast(large), "root", "left_anti"))).unionByName(dealt.join(ties.withColumnsRenamed({"root": "r", "t": "s"}), F.expr("root = r AND t <=> s")).select("root", "node", "t", "pos", "tie"))


def by_time(reached: DataFrame, commits: DataFrame) -> DataFrame:
    """Adds `pos`, from 1, latest commit first: the walk's order wherever no commit is earlier than its parents and times
    differ (see `walk` for the rest). Ties go to the larger id."""
    return timed(reached, commits).drop("t", "tie")


def late_edges(edges: DataFrame, commits: DataFrame) -> DataFrame:
    """(child, parent): the edges whose parent stands before its child when times put them in order, in whatever root."""
    times = commits.select("id", time_key(commits).alias("t"))
    both = edges.select("child", "parent").join(times.select(F.col("id").alias("child"), F.col("t").alias("ct")), "child").join(times.select(F.col("id").alias("parent"), F.col("t").alias("pt")), "parent")
    return materialized(both.where("pt > ct OR (pt <=> ct AND parent > child) OR (ct IS NULL AND pt IS NOT NULL)").select("child", "parent"))


def stretches(rows: DataFrame, late: DataFrame) -> DataFrame:
    """(root, lo, hi): the places of `timed` rows that times alone don't settle: times that tie, and whatever lies between a commit and a
    parent that is later than it. Before lo and after hi the walk is as times say, as all that is later is popped first."""
    ties = rows.where("tie").groupBy("root", "t").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi")).select("root", "lo", "hi")
    child = rows.select("root", F.col("node").alias("child"), F.col("pos").alias("hi"))
    parent = rows.select("root", F.col("node").alias("parent"), F.col("pos").alias("lo"))
    back = late.join(child, "child").join(parent, ["root", "parent"]).where("lo < hi").select("root", "lo", "hi")
    found = ties.unionByName(back)
    # These are few where clocks are mostly right, so a root's can be put in order.
    order = Window.partitionBy("root").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    begun = found.withColumn("new", (F.col("lo") > F.coalesce(F.max("hi").over(order), F.lit(0))).cast("int"))
    run = begun.withColumn("run", F.sum("new").over(Window.partitionBy("root").orderBy("lo", "hi")))
    return run.groupBy("root", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("run")


def walk(reached: DataFrame, starts: DataFrame, edges: DataFrame, commits: DataFrame, limit: int | None = None) -> DataFrame:
    """(root, node, pos): the exact walk also under clock skew and equal times: the latest commit is next, of equal ones the first
    pushed; unseen parents are pushed in order; starts are pushed in the order of their column `k`, if there is one, else of their ids.

    Places that times settle are found by a range sort. Only the stretches that they don't settle go through a heap, each in a task of its
    own. What is pushed from outside a stretch is pushed by earlier commits, whose places may lie in other stretches; so the heaps run again
    until no place changes, each time with the places found."""
    rows = materialized(timed(reached, commits))
    late = late_edges(edges, commits)
    open_ = stretches(rows, late)
    if limit is not None:
        open_ = open_.where(F.col("lo") <= limit)
    open_ = materialized(open_)
    if open_.isEmpty():
        out = rows.select("root", "node", "pos")
        return out if limit is None else out.where(F.col("pos") <= limit)
    inside = materialized(open_.select("root", "lo", F.explode(F.sequence("lo", "hi")).alias("pos")))
    # Without late edges, stretches hold nothing but ties, and other rows needn't be looked at. Only rows of stretches can move.
    only_ties = late.isEmpty()
    odd = now = materialized((rows.where("tie") if only_ties else rows).select("root", "node", "t", "pos").join(inside, ["root", "pos"]))
    even = rows.where("NOT tie") if only_ties else rows.join(inside, ["root", "pos"], "left_anti")
    order = F.col("k") if "k" in starts.columns else F.col("node")
    given = starts.groupBy("root", "node").agg(F.min(order).alias("key")).withColumn("given", F.row_number().over(Window.partitionBy("root").orderBy("key")).cast("long")).drop("key")
    mine = odd.select("root", F.col("node").alias("parent"), F.col("lo").alias("own"))
    # All edges into nodes of stretches, with the stretch of the child, if it is in one; those from the same stretch are what the heap pushes.
    into = edges.join(mine, "parent").select("root", "own", "parent", "ord", "child")
    into = into.join(rows.select("root", F.col("node").alias("child"), F.col("pos").alias("at")), ["root", "child"])
    into = materialized(into.join(odd.select("root", F.col("node").alias("child"), F.col("lo").alias("from")), ["root", "child"], "left"))
    inner = into.where("from = own").groupBy("root", F.col("child").alias("node")).agg(F.collect_list(F.struct("ord", "parent")).alias("inner"))
    outer = into.where("from IS NULL AND at < own")
    # What stands in another stretch may move in there, but not out of it.
    other = materialized(into.where("from <> own AND at < own"))
    settled = other.isEmpty()
    schema = reached.select("root", "node").schema.add("pos", "long")
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def one(rows: list[dict]) -> list:
        time = {r["node"]: float("inf") if r["t"] is None else -r["t"] for r in rows}
        pushes = {r["node"]: [x["parent"] for x in sorted(r["inner"] or [], key=lambda x: x["ord"])] for r in rows}
        heap: list[tuple] = []
        seen: set = set()
        out: list = []

        def push(nodes) -> None:
            for n in nodes:
                if n not in seen:
                    seen.add(n)
                    heapq.heappush(heap, (time[n], len(seen), n))

        push([n for _, n in sorted((tuple(r["enter"].values()), r["node"]) for r in rows if r["enter"])])
        while heap:
            _, _, n = heapq.heappop(heap)
            out.append(n)
            push(pushes[n])
        return out

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The stretches of a task one after the other: their rows come together. (A group of its own for each costs more than its heap.)"""
        made: list[list] = [[], [], []]
        same = lambda r: (r["root"], r["lo"])
        for (root_, lo), rows in itertools.groupby((r for b in batches for r in b.to_pylist()), same):
            found = one(list(rows))
            for to, values in zip(made, ([root_] * len(found), found, range(lo, lo + len(found)))):
                to.extend(values)
            if len(made[0]) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(made, kinds)], ["root", "node", "pos"])
                made = [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(made, kinds)], ["root", "node", "pos"])

    zero = F.lit(0).cast("long")
    while True:
        at = now.select("root", F.col("node").alias("child"), F.col("pos").alias("at"))
        placed = outer if settled else outer.unionByName(other.drop("at").join(at, ["root", "child"]), allowMissingColumns=True)
        earlier = placed.select("root", F.col("parent").alias("node"), F.struct(F.lit(1).cast("long").alias("a"), F.col("at").alias("b"), F.col("ord").cast("long").alias("c")).alias("e"))
        begun = given.select("root", "node", F.struct(zero.alias("a"), F.col("given").alias("b"), zero.alias("c")).alias("e"))
        enter = earlier.unionByName(begun).groupBy("root", "node").agg(F.min("e").alias("enter"))
        asked = now.drop("pos").join(inner, ["root", "node"], "left").join(enter, ["root", "node"], "left")
        walked = asked.repartition("root", "lo").sortWithinPartitions("root", "lo").mapInArrow(each, schema).withColumnRenamed("pos", "new")
        new = now.join(walked, ["root", "node"], "left").withColumn("moved", F.coalesce(F.col("new") != F.col("pos"), F.lit(False))).withColumn("pos", F.coalesce("new", "pos")).drop("new")
        new = materialized(new)
        done = settled or new.where("moved").isEmpty()
        now = new.drop("moved")
        if done:
            out = even.select("root", "node", "pos").unionByName(now.select("root", "node", "pos"))
            return out if limit is None else out.where(F.col("pos") <= limit)


def heap_needed(reached: DataFrame, edges: DataFrame, commits: DataFrame) -> DataFrame:
    """(root, exact): whether `by_time` isn't the walk for sure: a parent is later than its child, or times are equal."""
    rows = materialized(timed(reached, commits))
    odd = stretches(rows, late_edges(edges, commits)).select("root").distinct().withColumn("odd", F.lit(True))
    return rows.select("root").distinct().join(odd, "root", "left").select("root", F.coalesce("odd", F.lit(False)).alias("exact"))
