"""Approximate nearest neighbours: a forest of random-projection trees, exact reranking.

Fitting. Vectors that are equal are gathered into one point that keeps its smallest ids, as many as a result can
hold, so a vector that a third of all rows share is one point. The forest is fitted on a sample of at most
`sample` points (those of smallest hash): each node splits its points at the median of their projection on the
difference of two random ones, down to leaves of about `BLOCK` points of the whole table (but a 50th of the sample at most, and 20 points of it
at least). The search effort is measured on the sample too: for `MEASURED` of its points, how large a share of all points the leaves
hold that have to be visited until their true neighbours are found. The effort is what finds `RECALL` of these.

Indexing. Every point is routed to its leaf in every tree. Searching. A query's trees share one priority
queue, ordered by the largest distance to a crossed split on the way; leaves are taken from it until they
hold `effort` times as many points as there are (points found by several trees count each time). A leaf's points and its queries
are dealt into blocks of at most about `BLOCK`, and each two blocks meet in one task, which gives the best of each query by
cosine; these are reranked in double precision on the original vectors. Ties go to the smaller id.

The dimension is the most frequent length of the usable vectors (of equally frequent ones the largest), counted over all rows. Vectors that
are null, zero, of another length, or that hold null or non-finite numbers take no part. An id that several
usable rows have stands for the smallest of their vectors. An empty table gives no rows; fewer candidates than k give fewer rows. A
query's own row never counts, but other rows with its vector do. Rows with a null id take no part. Extra columns are left out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

TREES = 16
#: Of the smallest number of leaves of a tree, and the fewest points of the sample in a leaf.
LEAVES = 50
LEAST = 20
SAMPLE = 20_000
#: Points of the sample whose neighbours are looked up to set the effort, and the share of these that it has to find.
MEASURED = 200
RECALL = 0.97
BLOCK = 4_096


class Forest:
    """Trees as flat arrays: for inner nodes a normal, a threshold and two children, for leaves their share of the sample."""

    def __init__(self, points: np.ndarray, trees: int = TREES, leaves: int = LEAVES, seed: int = 7):
        self.leaf = max(2, len(points) // leaves)
        self.trees = [self.grow(points, np.random.default_rng([seed, t])) for t in range(trees if len(points) else 0)]

    def grow(self, points: np.ndarray, rng: np.random.Generator) -> tuple:
        normals, cuts, left, right, share = [], [], [], [], []

        def node(rows: np.ndarray) -> int:
            at = len(cuts)
            for x in (normals, cuts, left, right, share):
                x.append(None)
            normals[at], cuts[at], left[at], right[at], share[at] = np.zeros(points.shape[1]), 0.0, -1, -1, len(rows) / len(points)
            if len(rows) > self.leaf:
                a, b = points[rng.choice(rows, 2, replace=False)]
                normal = a - b
                size = np.linalg.norm(normal)
                if size > 0:
                    normal = normal / size
                    p = points[rows] @ normal
                    cut = float(np.median(p))
                    low = p < cut
                    if 0 < low.sum() < len(rows):
                        normals[at], cuts[at] = normal, cut
                        left[at], right[at] = node(rows[low]), node(rows[~low])
            return at

        node(np.arange(len(points)))
        return np.array(normals), np.array(cuts), np.array(left), np.array(right), np.array(share)

    def route(self, points: np.ndarray) -> np.ndarray:
        """The leaf of every point in every tree: (points, trees)."""
        out = np.zeros((len(points), len(self.trees)), np.int64)
        for t, (normals, cuts, left, right, _) in enumerate(self.trees):
            at = np.zeros(len(points), np.int64)
            while True:
                inner = np.flatnonzero(left[at] >= 0)
                if not len(inner):
                    break
                n = at[inner]
                side = np.einsum("ij,ij->i", points[inner], normals[n]) < cuts[n]
                at[inner] = np.where(side, left[n], right[n])
            out[:, t] = at
        return out

    def effort(self, points: np.ndarray, k: int) -> float:
        """The share of all points that has to be looked at for `RECALL` of the k nearest, measured on the points given."""
        asked = np.linspace(0, len(points) - 1, min(MEASURED, len(points))).astype(int)
        leaf = self.route(points)
        needed = []
        for q in asked:
            cos = points @ points[q]
            cos[q] = -2
            near = np.argsort(-cos, kind="stable")[: min(k, len(points) - 1)]
            left = set(near.tolist())
            held = 0.0
            for t, n in self.probes(points[q], np.inf):
                held += float(self.trees[t][4][n])
                met = [i for i in left if leaf[i, t] == n]
                needed += [held] * len(met)
                left.difference_update(met)
                if not left:
                    break
        return float(np.quantile(needed, RECALL)) if needed else 1.0

    def probes(self, point: np.ndarray, share: float) -> Iterator[tuple[int, int]]:
        """(tree, leaf) in the order of the shared queue, until they hold this share of all points."""
        queue = [(-np.inf, t, 0) for t in range(len(self.trees))]
        held = 0.0
        while queue and held < share:
            margin, t, n = heapq.heappop(queue)
            normals, cuts, left, right, shares = self.trees[t]
            while left[n] >= 0:
                d = float(point @ normals[n] - cuts[n])
                near, far = (left[n], right[n]) if d < 0 else (right[n], left[n])
                heapq.heappush(queue, (max(margin, abs(d)), t, int(far)))
                n = int(near)
            yield t, n
            held += float(shares[n])


def valid(rows: DataFrame) -> DataFrame:
    """(vec_id, v, k): usable vectors as doubles, with a 128-bit key of their values."""
    v = F.col("embedding").cast("array<double>")
    fine = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        "vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
        " AND exists(v, x -> x <> 0)"
    )
    once = fine.groupBy("vec_id").agg(F.min("v").alias("v"))
    return once.withColumn("k", F.struct(F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b")))


def points_of(fine: DataFrame, keep: int) -> DataFrame:
    """One row for each distinct vector: k, pid (its smallest id), v, ids (its `keep` smallest)."""
    # At most `keep` rows of a vector leave each task: Spark puts a group limit before the shuffle.
    nth = F.row_number().over(Window.partitionBy("k").orderBy("vec_id"))
    first = fine.withColumn("nth", nth).where(F.col("nth") <= keep)
    return first.groupBy("k").agg(F.min("vec_id").alias("pid"), F.any_value("v").alias("v"), F.array_sort(F.collect_list("vec_id")).alias("ids"))


def nearest(rows: DataFrame, is_query: F.Column, k: int = 5, trees: int = TREES, leaves: int = LEAVES, sample: int = SAMPLE, effort: float | None = None) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of (vec_id, embedding) that ``is_query`` (of vec_id) marks."""
    fine = stored(valid(rows))
    lengths = fine.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    dim, total = (lengths[0]["dim"], lengths[0]["n"]) if lengths else (0, 0)
    fine = fine.where(F.size("v") == dim)
    points = stored(points_of(fine, k + 1))
    # The sample is bounded, so it may come to the driver; so may the forest, of at most 2 * sample / LEAST nodes a tree.
    drawn = points.orderBy(F.xxhash64("pid"), "pid").limit(sample).select("v").toPandas()["v"]
    fit = np.array([np.asarray(x) / np.linalg.norm(x) for x in drawn]).reshape(len(drawn), dim)
    forest = Forest(fit, trees, max(leaves, min(total // BLOCK, len(fit) // LEAST)))
    if effort is None:
        effort = forest.effort(fit, k)
    # In small tables so much that no query runs short of points.
    effort = max(effort, trees * min(1.0, 8 * (k + 1) / max(1, len(fit))))

    def unit(column: pa.Array) -> np.ndarray:
        m = np.asarray(column.flatten()).reshape(len(column), dim)
        return m / np.linalg.norm(m, axis=1, keepdims=True)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            at = forest.route(unit(b.column(1)))
            n, t = at.shape
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(t), n)), pa.array(at.T.reshape(-1)), *(pa.concat_arrays([c] * t) for c in b.columns[:2])],
                ["tree", "leaf", "pid", "v"],
            )

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            found = [list(forest.probes(q, effort)) for q in unit(b.column(1))]
            at = np.repeat(np.arange(len(b)), [len(f) for f in found])
            flat = np.array([x for f in found for x in f], np.int64).reshape(-1, 2)
            taken = [b.column(c).take(pa.array(at)) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1]), *taken], ["tree", "leaf", "qid", "q"])

    index = points.select("pid", "v").mapInArrow(place, "tree long, leaf long, pid long, v array<double>")
    # Leaves and their queries are cut into blocks by a hash, so that no group grows with the data.
    sizes = index.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    index = stored(index.join(sizes, ["tree", "leaf"]).withColumn("block", F.pmod(F.xxhash64("pid"), F.col("blocks"))))
    asking = fine.where(is_query).select(F.col("vec_id").alias("query_id"), "k").join(points.select("k", F.col("pid").alias("qid")), "k").drop("k")
    asked = points.select(F.col("pid").alias("qid"), F.col("v").alias("q")).join(asking.select("qid").distinct(), "qid", "left_semi")
    probes = stored(asked.mapInArrow(probe, "tree long, leaf long, qid long, q array<double>"))
    parts_of = probes.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / BLOCK).alias("parts")).join(sizes, ["tree", "leaf"])
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    index = index.join(parts_of.drop("blocks"), ["tree", "leaf"]).withColumn("part", every("parts"))
    probes = probes.join(parts_of, ["tree", "leaf"]).withColumn("part", F.pmod(F.xxhash64("qid"), F.col("parts"))).withColumn("block", every("blocks"))
    probes = probes.select("qid", "q", *[F.col(c).alias(f"at_{c}") for c in ("tree", "leaf", "block", "part")])

    def best(key: tuple, own: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(asks):
            return pd.DataFrame({"qid": [], "pid": [], "score": []})
        m, q = np.stack(own["v"].to_numpy()), np.stack(asks["q"].to_numpy())
        mn = m / np.linalg.norm(m, axis=1, keepdims=True)
        qn = q / np.linalg.norm(q, axis=1, keepdims=True)
        pids, qids = own["pid"].to_numpy(), asks["qid"].to_numpy()
        last = max(0, len(m) - k - 1)
        found: list[list[np.ndarray]] = [[], [], []]
        for at in range(0, len(q), 256):
            cos = qn[at : at + 256] @ mn.T
            least = np.partition(cos, last, axis=1)[:, last] - 1e-9
            for row in range(len(cos)):
                t = np.flatnonzero(cos[row] >= least[row])
                a, b = q[at + row], m[t]
                exact = (b * a).sum(axis=1) / (np.sqrt((b * b).sum(axis=1)) * np.sqrt((a * a).sum()))
                order = np.lexsort((pids[t], -exact))[: k + 1]
                for to, x in zip(found, (np.full(len(order), qids[at + row]), pids[t][order], exact[order])):
                    to.append(x)
        return pd.DataFrame({n: np.concatenate(x) for n, x in zip(("qid", "pid", "score"), found)})

    keys = ["tree", "leaf", "block", "part"]
    index = index.select("pid", "v", *keys)
    parts = index.groupBy(*keys).cogroup(probes.groupBy(*[f"at_{c}" for c in keys])).applyInPandas(best, "qid long, pid long, score double")
    distinct = parts.groupBy("qid", "pid").agg(F.max("score").alias("score"))
    nth = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "pid"))
    top = distinct.withColumn("nth", nth).where(F.col("nth") <= k + 1).drop("nth")
    named = top.join(points.select("pid", "ids"), "pid").select("qid", "score", F.explode("ids").alias("vec_id"))
    # Back from distinct vectors to the ids that asked: each has its k + 1 best, from which its own id goes.
    nth = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))
    lists = named.withColumn("nth", nth).where(F.col("nth") <= k + 1)
    lists = lists.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("found"))
    each = asking.join(lists, "qid").select("query_id", F.expr(f"slice(filter(found, x -> x.vec_id <> query_id), 1, {k})").alias("found"))
    flat = each.select("query_id", F.posexplode("found").alias("rank", "x"))
    return flat.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
