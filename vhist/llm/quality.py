"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

A text is cut into words, lower-cased, and runs of other marks; each run of marks is one token by its kind,
and a word in capitals adds a token of its own. Tokens and pairs of neighbours are hashed to `2**bits`
weights. A text's features are its counts divided by their sum, times SCALE, so its score is the mean of
its weights times SCALE, plus the bias, through the logistic function. Training: `shards` learners each go through their share of the
labelled sample (dealt by a hash of the id) with per-coordinate FTRL-proximal updates; their weights
are averaged. The sample is bounded by `max_rows` (the rows of smallest hash); everything is scored.

Null and empty texts have no features and get the score of the bias. Without labelled rows every score is
0.5. Rows are independent; repeated rows repeat their results; `score` keeps extra columns, the query leaves them out. Labels other
than 0 and 1, and null ones, are not learned from; an id with several labels is learned with each. Bytes that aren't UTF-8 are read
as U+FFFD. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget_codecs, held_out, strings, table

BITS = 18
MAX_ROWS = 20_000
SHARDS = 8
SCALE = 30.0
TOKEN = regex.compile(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+|\n+")
MAX_KNOWN = 400_000


class Features:
    """Hashed features of a text: indexes, one for every token and every pair of neighbours."""

    def __init__(self, bits: int = BITS):
        self.mask = (1 << bits) - 1
        self.known: dict[str, int] = {}

    def hash(self, token: str) -> int:
        h = 0xCBF29CE484222325
        for byte in token.encode("utf-8", "replace"):
            h = ((h ^ byte) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
        return (h ^ (h >> 29)) & 0x7FFFFFFFFFFFFFFF

    def remember(self, token: str) -> int:
        if len(self.known) >= MAX_KNOWN:
            self.known.clear()
        # A capitalised word of three letters or more is its own feature, whatever the word.
        loud = len(token) > 2 and token.isupper()
        got = self.known[token] = self.hash("\0LOUD" if loud else token.lower())
        return got

    def of(self, text: str) -> np.ndarray:
        known, new = self.known, self.remember
        h = np.array([known.get(t) or new(t) for t in TOKEN.findall(text)], np.int64)
        if not len(h):
            return h
        # A token that stands twice in a row is one feature, whatever the token.
        mixed = np.where(h[:-1] == h[1:], np.int64(7_777_777_777), (h[:-1] * np.int64(1000003)) ^ h[1:])
        return np.concatenate([h & self.mask, (mixed ^ (mixed >> 23)) & self.mask])


def learn(rows: Iterator[tuple[str, int]], bits: int = BITS, passes: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.001, l2: float = 0.01) -> tuple[np.ndarray, float]:
    """FTRL-proximal over the rows in order, several passes: weights and bias."""
    kit = Features(bits)
    data = []
    for text, label in rows:
        i, n = np.unique(kit.of(text), return_counts=True)
        data.append((i, SCALE * n / max(1, n.sum()), label))
    size = (1 << bits) + 1
    z, n2, w = np.zeros(size), np.zeros(size), np.zeros(size)
    for _ in range(passes):
        for i, x, label in data:
            i, x = np.append(i, size - 1), np.append(x, 1.0)
            w[i] = np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n2[i])) / alpha + l2))
            p = 1 / (1 + np.exp(-np.clip(w[i] @ x, -35, 35)))
            g = (p - label) * x
            z[i] += g - (np.sqrt(n2[i] + g * g) - np.sqrt(n2[i])) / alpha * w[i]
            n2[i] += g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n2)) / alpha + l2))
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, bits: int = BITS, max_rows: int = MAX_ROWS, shards: int = SHARDS) -> tuple[np.ndarray, float]:
    """Weights and bias from (doc_id, text) and (doc_id, label)."""
    marked = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).select(
        "doc_id", F.col("label").cast("int").alias("label"), F.xxhash64("doc_id").alias("order")
    )
    # At most max_rows ids and labels: small enough to send to every task.
    sample = F.broadcast(marked.orderBy("order", "label").limit(max_rows))
    rows = docs.select("doc_id", "text").join(sample, "doc_id").withColumn("shard", F.pmod("order", F.lit(shards)))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        forget_codecs()
        # Ids in the order of their hash; the text settles rows that share an id.
        pdf = pdf.assign(text=pdf["text"].fillna("")).sort_values(["order", "label", "text"])
        w, b = learn(zip(pdf["text"], pdf["label"]), bits)
        at = np.flatnonzero(w)
        return pd.DataFrame({"i": np.append(at, -1), "w": np.append(w[at], b)})

    each = rows.groupBy("shard").applyInPandas(one, "i long, w double")
    total = each.groupBy("i").agg(F.sum("w").alias("w"), F.count("*").alias("n")).toPandas()
    weights, bias = np.zeros(1 << bits), 0.0
    if len(total):
        used = float(total.loc[total["i"] == -1, "n"].iloc[0])
        bias = float(total.loc[total["i"] == -1, "w"].iloc[0]) / used
        own = total[total["i"] >= 0]
        weights[own["i"].to_numpy()] = own["w"].to_numpy() / used
    return weights, bias


def score(docs: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """Adds `score` to every row of docs; all columns stay, but for one of that name."""
    bits = int(np.log2(len(weights)))
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2 ** bits numbers, whatever the input
    own = [c for c in docs.columns if c != "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_codecs()
        kit, w = Features(bits), shared.value
        for batch in batches:
            out = []
            for text in strings(batch):
                f = kit.of(text)
                out.append(1 / (1 + np.exp(-np.clip(bias + (SCALE * w[f].mean() if len(f) else 0.0), -35, 35))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["row", "score"])

    rows = docs.select(F.struct(*own).alias("row"), "text")
    scored = rows.mapInArrow(run, type(docs.schema)([rows.schema["row"]]).add("score", "double"))
    return scored.select(*[F.col("row")[c].alias(c) for c in own], "score")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id")).select("doc_id", F.col("quality").alias("label"))
    weights, bias = train(docs, labels)
    out = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), weights, bias)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
