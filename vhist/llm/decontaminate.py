"""Benchmark decontamination over a distributed positional inverted index.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z is lower-cased. A benchmark item gives its windows
of `size` consecutive words; a shorter item that has words is one window. One pass counts how often the
windows' terms stand in the corpus. Each window's `rarest` least frequent terms are its anchors, and a
window with a term that the corpus lacks is dropped. A second pass stores the index: for each text, the
positions of the test terms in reach of a window's rarest term whose second rarest stands at its
distance (elsewhere no window can match). The anchors' lists, shifted by their offsets in the window, are intersected; the
starts that remain are then intersected with the lists of the window's other terms, which makes matches
exact. `proximity` finds windows whose anchors stand within `slop` words of their places instead; it
wants an index that is built with this slop.

Postings are kept under a 128-bit digest of the text, so copies of a text share them and a text
that a third of all rows hold is matched once. Null text has no words; texts and items without words match
nothing. Null or repeated ids are kept: there is one output row for each input row. An item given twice
counts once, items with one id and different texts are one item with the windows of all, and items with a null id are one item
that counts in `n_hit` and `n_items` but has no name in `items`. Windows are known by a 128-bit digest of their words. Extra columns are left out. The test terms go to all tasks as a set while they are at
most `MAX_TERMS`; beyond that all terms are counted and stored, and Spark joins them. The windows' terms are a stored table, which Spark sends to all
tasks by its size in bytes or joins by shuffles.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table, texts

SIZE = 10
RAREST = 3
MAX_TERMS = 500_000
MAX_PROBES = 1_000_000
_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz"
FOLD = bytes(c if c >= 128 or c in _KEEP else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words(raw: bytes) -> list[bytes]:
    return raw.translate(FOLD).split()


def windows(items: DataFrame, size: int = SIZE) -> DataFrame:
    """(item_id, w, len, off, term): each window's words with their offsets; `w` is a digest of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(5)]
            for item, raw in zip(batch.column(0).to_pylist(), texts(batch)):
                ws = words(raw)
                for at in range(max(1, len(ws) - size + 1) if ws else 0):
                    own = ws[at : at + size]
                    w = hashlib.blake2b(b" ".join(own), digest_size=16).digest()
                    for off, term in enumerate(own):
                        for to, x in zip(rows, (item, w, len(own), off, term)):
                            to.append(x)
            kinds = [pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(r, k) if k != pa.string() or n == 0 else pa.array(r, pa.binary()).cast(pa.string()) for n, (r, k) in enumerate(zip(rows, kinds))],
                ["item_id", "w", "len", "off", "term"],
            )

    rows = items.select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    return rows.mapInArrow(run, "item_id string, w binary, len int, off int, term string")


def term_counts(docs: DataFrame, terms: frozenset[bytes] | None) -> DataFrame:
    """(term, n): how often each test term stands in the corpus; every task adds up its own rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "n"]
            )

        for batch in batches:
            for raw in texts(batch):
                ws = words(raw)
                seen.update(ws if terms is None else filter(terms.__contains__, ws))
            if len(seen) > MAX_TERMS:
                yield out()
                seen.clear()
        yield out()

    return docs.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def ranked(probes: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds `rank` (0: rarest) to each window's terms; windows with an absent term go."""
    w = Window.partitionBy("w")
    met = probes.join(counts, "term", "left").withColumn("least", F.min(F.coalesce("n", F.lit(0))).over(w))
    rank = F.row_number().over(w.orderBy("n", "off")) - 1
    return met.where("least > 0").withColumn("rank", rank).select("w", "len", "off", "term", "rank")


def build_index(docs: DataFrame, starts: dict[bytes, list[tuple[int, bytes]]] | None, terms: frozenset[bytes] | None, size: int, slop: int = 0) -> DataFrame:
    """For each row (doc_id, key, n_words), and for each of its terms that is kept (key, term, positions). ``starts``: for each
    window's rarest term the second rarest and its distance; None keeps all positions."""
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int32())]
    names = ["doc_id", "key", "n_words", "term", "positions"]
    reach = size + slop

    def near(ws: list[bytes]) -> Iterator[int]:
        """Positions within a window's reach of a rarest term whose second stands at its distance, give or take ``slop``."""
        if starts is None:
            yield from range(len(ws))
            return
        done = 0
        for i in [i for i, w in enumerate(ws) if w in starts]:
            if any(second in ws[max(0, i + d - slop) : max(0, i + d + slop + 1)] for d, second in starts[ws[i]]):
                yield from range(max(done, i - reach + 1, 0), min(len(ws), i + reach))
                done = max(done, min(len(ws), i + reach))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            made: set[bytes] = set()
            for doc, raw in zip(batch.column(0).to_pylist(), texts(batch)):
                ws, key = words(raw), hashlib.blake2b(raw, digest_size=16).digest()
                for to, x in zip(rows, (doc, key, len(ws), None, None)):
                    to.append(x)
                if key in made:
                    continue
                made.add(key)
                held: dict[bytes, list[int]] = {}
                for i in near(ws):
                    if terms is None or ws[i] in terms:
                        held.setdefault(ws[i], []).append(i)
                for term, positions in held.items():
                    for to, x in zip(rows, (None, key, None, term, positions)):
                        to.append(x)
            own = [pa.array(r, k) for r, k in zip(rows, kinds)]
            own[3] = own[3].cast(pa.string())
            yield pa.RecordBatch.from_arrays(own, names)

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return stored(rows.mapInArrow(run, "doc_id long, key binary, n_words long, term string, positions array<int>"))


class Index:
    """The stored index of a corpus for the windows of a benchmark."""

    def __init__(self, docs: DataFrame, items: DataFrame, size: int = SIZE, rarest: int = RAREST, slop: int = 0):
        given = stored(windows(items, size))
        self.named = given.select("w", "item_id").distinct()
        probes = stored(given.drop("item_id").dropDuplicates(["w", "off"]))
        vocabulary = probes.select("term").distinct()
        known = None
        if vocabulary.limit(MAX_TERMS + 1).count() <= MAX_TERMS:  # so many words at most come to the driver
            known = frozenset(r[0].encode() for r in vocabulary.collect())
        self.probes = stored(ranked(probes, term_counts(docs, known)))
        self.rarest, self.slop = rarest, slop
        first = self.probes.where("rank = 0").select("w", "off", "term")
        second = self.probes.where(F.col("rank") == F.least(F.lit(1), F.col("len") - 1))
        second = second.select("w", F.col("off").alias("to"), F.col("term").alias("second"))
        both = first.join(second, "w").select("term", (F.col("to") - F.col("off")).alias("distance"), "second").distinct()
        starts = None
        if known is not None and both.limit(MAX_PROBES + 1).count() <= MAX_PROBES:  # so many rows at most come to the driver
            starts = {}
            for term, distance, other in both.collect():
                starts.setdefault(term.encode(), []).append((distance, other.encode()))
        index = build_index(docs, starts, known, size, slop)
        self.docs = index.where("term IS NULL").select("doc_id", "key", "n_words")
        posts = index.where("term IS NOT NULL").select("key", "term", "positions")
        if known is None:
            posts = posts.join(vocabulary, "term", "left_semi")
        self.postings = posts.dropDuplicates(["key", "term"])

    def started(self) -> DataFrame:
        """(key, w, len, start): where all of a window's anchors stand at their offsets."""
        anchors = self.probes.where(F.col("rank") < self.rarest)
        at = self.postings.join(anchors, "term").select("key", "w", "len", "off", F.explode("positions").alias("p"))
        at = at.withColumn("start", F.col("p") - F.col("off")).where("start >= 0")
        agreed = at.groupBy("key", "w", "len", "start").agg(F.count("*").alias("n"))
        return agreed.where(F.col("n") == F.least(F.lit(self.rarest), F.col("len"))).drop("n")

    def matches(self) -> DataFrame:
        """(key, w, len, start) of exact matches."""
        begun = stored(self.started())
        others = self.probes.where(F.col("rank") >= self.rarest).drop("rank", "len")
        left = begun.join(others, "w")
        held = left.join(self.postings, ["key", "term"]).where(F.expr("array_contains(positions, start + off)"))
        full = held.groupBy("key", "w", "len", "start").agg(F.count("*").alias("n"))
        exact = full.where(F.col("n") == F.col("len") - self.rarest).drop("n")
        return exact.unionByName(begun.where(F.col("len") <= self.rarest))

    def proximity(self) -> DataFrame:
        """(key, item_id, w, start, shift): the rarest anchor's start where every other anchor stands within
        `slop` words of its place, and the largest such shift."""
        anchors = self.probes.where(F.col("rank") < self.rarest)
        first = self.postings.join(anchors.where("rank = 0"), "term")
        starts = first.select("key", "w", "len", "off", F.explode("positions").alias("p"))
        starts = starts.select("key", "w", "len", (F.col("p") - F.col("off")).alias("start"))
        rest = starts.join(anchors.where("rank > 0").drop("len", "rank"), "w")
        near = rest.join(self.postings, ["key", "term"]).withColumn(
            "shift", F.array_min(F.expr("transform(positions, p -> abs(p - off - start))"))
        )
        found = near.where(F.col("shift") <= self.slop).groupBy("key", "w", "len", "start")
        found = found.agg(F.count("*").alias("n"), F.max("shift").alias("shift"))
        alone = starts.where("len = 1").withColumn("shift", F.lit(0))
        return found.where(F.col("n") == F.least(F.lit(self.rarest), F.col("len")) - 1).drop("n").unionByName(alone).join(self.named, "w")


def contamination(docs: DataFrame, items: DataFrame, size: int = SIZE, rarest: int = RAREST) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit, n_items, items (sorted array), contaminated."""
    index = Index(docs, items, size, rarest)
    found = stored(index.matches())
    end = F.col("start") + F.col("len")
    before = F.max(end).over(Window.partitionBy("key").orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1))
    spans = found.select("key", "start", "len").distinct().withColumn("before", F.coalesce(before, F.lit(0)))
    hit = spans.groupBy("key").agg(F.sum(F.greatest(F.lit(0), end - F.greatest("start", "before"))).alias("n_hit"))
    met = found.select("key", "w").distinct().join(index.named, "w")
    named = met.groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.max(F.col("item_id").isNull().cast("int")).alias("unnamed"))
    # Stored, so that Spark knows its size: while that is small it is sent to all tasks, and copies of a text never meet.
    out = index.docs.join(stored(hit.join(named, "key")), "key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), (F.size(items_of) + F.coalesce("unnamed", F.lit(0))).cast("long").alias("n_items"), items_of.alias("items"), (n_hit > 0).alias("contaminated")
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_OP4 = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS ws FROM documents),
b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT item, unnest(range(1, greatest(1, len(ws) - {SIZE - 1}) + 1)) AS w, ws FROM b WHERE len(ws) > 0),
win AS (SELECT DISTINCT item, least({SIZE}, len(ws)) AS n, array_to_string(ws[w:w + {SIZE - 1}], ' ') AS g FROM bw),
dw AS (SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS p, ws FROM d, (SELECT DISTINCT n FROM win) WHERE len(ws) >= n),
dg AS (SELECT doc_id, n, p, array_to_string(ws[p:p + n - 1], ' ') AS g FROM dw),
hits AS (SELECT doc_id, item, p, n FROM dg JOIN win USING (n, g)),
cov AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
