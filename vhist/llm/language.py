"""Language identification with hyperdimensional profiles.

Every letter (code point) has a fixed random vector of +1 and -1. A trigram's vector binds its letters'
vectors: element-wise product, each permuted by its place (a rotation). A text's vector bundles (adds) its
trigrams' vectors. A language's prototype bundles those of its learned texts, each text scaled to length
one so that a few long ones don't rule. A text gets the language of largest cosine; the score is that
cosine, not below 0. Ties go to the language that sorts first.

Letters are those of str.isalpha(), lower-cased; anything else ends a word, and words are padded with one
boundary on either side. Null texts and texts without a letter get `und` and score 0; so does everything
where nothing could be learned. Rows are independent and repeated rows give repeated results; extra
columns are left out; an empty table gives no rows. Bytes that aren't UTF-8 are read as U+FFFD. Up to `max_langs` prototypes go to all tasks; where there are
more they stay a table, and profiles meet them in blocks of so many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, stored, strings, table

DIM = 1024
MAX_KNOWN = 60_000
MAX_LANGS = 1000
#: Rows whose profiles meet a block of languages in one task.
SLICE = 10_000


class Trigrams:
    """Counts a text's trigrams and keeps the vectors of those met."""

    def __init__(self, dim: int = DIM, seed: int = 11):
        self.dim, self.seed = dim, seed
        self.letters: dict[int, np.ndarray] = {}
        self.lower = np.array([0], np.uint32)
        self.reset()

    def reset(self) -> None:
        self.ids: dict[int, int] = {}
        self.vectors = np.empty((1024, self.dim), np.float32)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) > MAX_KNOWN:
                self.letters.clear()
            bits = np.random.Generator(np.random.PCG64([self.seed, code])).integers(0, 2, self.dim)
            self.letters[code] = (2 * bits - 1).astype(np.float32)
        return self.letters[code]

    def vector_of(self, gram: int) -> np.ndarray:
        a, b, c = gram >> 42, (gram >> 21) & 0x1FFFFF, gram & 0x1FFFFF
        return np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)

    def codes(self, text: str) -> np.ndarray:
        """Lower-case letters as code points, 0 between words and at both ends."""
        x = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        top = int(x.max()) + 1
        while top > len(self.lower):
            more = range(len(self.lower), min(0x110000, 2 * top))
            self.lower = np.concatenate([self.lower, np.array([c if chr(c).isalpha() else 0 for c in more], np.uint32)])
        x = self.lower[x].astype(np.int64)
        return x[np.concatenate([[True], (x[1:] != 0) | (x[:-1] != 0)])]

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct trigrams and how often each occurs."""
        x = self.codes(text)
        if len(x) < 3:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        grams = (x[:-2] << 42) | (x[1:-1] << 21) | x[2:]
        return np.unique(grams[x[1:-1] != 0], return_counts=True)

    def profile(self, text: str) -> np.ndarray | None:
        """The text's bundled vector, None without a letter."""
        grams, n = self.counts(text)
        if not len(grams):
            return None
        if len(self.ids) + len(grams) > MAX_KNOWN:
            self.reset()
        at = np.empty(len(grams), np.int64)
        for k, g in enumerate(grams.tolist()):
            i = self.ids.get(g)
            if i is None:
                i = self.ids[g] = len(self.ids)
                if i >= len(self.vectors):
                    self.vectors = np.resize(self.vectors, (2 * len(self.vectors), self.dim))
                self.vectors[i] = self.vector_of(g)
            at[k] = i
        total = np.zeros(self.dim, np.float32)
        for k in range(0, len(at), 4096):
            total += n[k : k + 4096].astype(np.float32) @ self.vectors[at[k : k + 4096]]
        return total


def prototypes(docs: DataFrame, lang: Column | str = "lang", dim: int = DIM, max_langs: int = MAX_LANGS) -> dict[str, np.ndarray] | DataFrame:
    """Learn one vector a language from (text, lang): every task adds up its own rows, Spark adds these. A stored table (lang, v) where
    there are more than ``max_langs``."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, sums = Trigrams(dim), {}
        for batch in batches:
            for name, text in zip(batch.column(1).to_pylist(), strings(batch)):
                if (v := grams.profile(text)) is not None and (norm := np.linalg.norm(v)) > 0:
                    sums[name] = sums.get(name, 0) + v.astype(np.float64) / norm
        names = sorted(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([sums[n] for n in names], pa.list_(pa.float64()))], ["lang", "v"]
        )

    parts = docs.select("text", F.col(lang) if isinstance(lang, str) else lang).mapInArrow(add_up, "lang string, v array<double>")
    each = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    whole = each.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    found = stored(whole.select("lang", F.col("v.x").alias("v")))
    if found.count() > max_langs:
        return found
    return {name: np.array(x) for name, x in sorted(found.collect())}


def unit_rows(vectors: list) -> np.ndarray:
    return np.array([v / max(np.linalg.norm(v), 1e-12) for v in map(np.asarray, vectors)]).astype(np.float32)


def identify(docs: DataFrame, learned: dict[str, np.ndarray] | DataFrame, dim: int = DIM) -> DataFrame:
    """doc_id, lang_pred, score for every row of (doc_id, text)."""
    if isinstance(learned, DataFrame):
        return identify_in_blocks(docs, learned, dim)
    names = sorted(learned)
    matrix = unit_rows([learned[n] for n in names])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Trigrams(dim)
        for batch in batches:
            pred, score = [], []
            for text in strings(batch):
                v = grams.profile(text) if names else None
                norm = float(np.linalg.norm(v)) if v is not None else 0.0
                if not norm:
                    pred.append("und")
                    score.append(0.0)
                    continue
                cos = matrix @ v / norm
                best = int(np.argmax(cos))
                pred.append(names[best])
                score.append(min(1.0, max(0.0, float(cos[best]))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(predict, "doc_id long, lang_pred string, score double")


def identify_in_blocks(docs: DataFrame, learned: DataFrame, dim: int = DIM, block: int = MAX_LANGS) -> DataFrame:
    """The same where prototypes are a table: each profile meets each block of languages in a task of that block and a slice of
    the profiles, and Spark keeps the best."""
    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", F.monotonically_increasing_id()))
    blocks = -(-learned.count() // block)

    def profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Trigrams(dim)
        for batch in batches:
            found = [grams.profile(text) for text in strings(batch)]
            found = [None if v is None or not np.linalg.norm(v) else v / np.linalg.norm(v) for v in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float32()))], ["row", "p"])

    def best(key: tuple, langs: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(langs) and len(own):
            langs = langs.sort_values("lang")
            matrix = unit_rows(list(langs["v"]))
            for at in range(0, len(own), 1024):
                cos = np.stack(list(own["p"][at : at + 1024])) @ matrix.T
                top = cos.argmax(axis=1)
                out += zip(own["row"][at : at + 1024], langs["lang"].to_numpy()[top], cos.max(axis=1).astype(float))
        return pd.DataFrame(out, columns=["row", "lang", "cos"])

    given = rows.select("row", "text").mapInArrow(profiles, "row long, p array<float>").where("p IS NOT NULL")
    spread = given.withColumn("slice", F.floor(F.col("row") / SLICE)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    placed = learned.withColumn("block", F.pmod(F.xxhash64("lang"), F.lit(blocks)).cast("int"))
    asked = spread.select(F.col("block").alias("b"), F.col("slice").alias("s")).distinct()
    langs = placed.join(asked, F.col("block") == F.col("b")).select("b", "s", "lang", "v")
    met = langs.groupBy("b", "s").cogroup(spread.groupBy("block", "slice")).applyInPandas(best, "row long, lang string, cos double")
    met = stored(met)
    top = met.groupBy("row").agg(F.max("cos").alias("cos"))
    names = met.join(top, ["row", "cos"]).groupBy("row", "cos").agg(F.min("lang").alias("lang"))
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("cos", F.lit(0.0))))
    return rows.join(names, "row", "left").select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang_pred"), score.alias("score"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = prototypes(docs.where(~held_out("doc_id") & F.col("lang").isNotNull()))
    out = identify(docs, learned)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
