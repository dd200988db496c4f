"""The corpus pipeline: quality filter, line dedup, near duplicates, benchmark decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of documents; the last returns the
tokens' counts and digests. `run` writes each stage's result as Parquet before the next one reads it.

Ids are compared null-safely: rows without an id are one document to the stages that drop by id. Empty tables give empty
results. Rows that repeat an id and text are one document from the near-duplicate stage on. Extra columns of the documents go through
all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vhist.llm import bpe, decontaminate, line_dedup, near_dup, quality
from vhist.llm.common import held_out, stored, table


def by_id(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """The documents whose ids are (left_semi) or aren't (left_anti) in ``ids``. Their columns travel as one, so that none clashes."""
    rows = docs.select(F.col("doc_id").alias("left_id"), F.struct(*docs.columns).alias("row"))
    named = ids.select(F.col("doc_id").alias("right_id")).distinct()
    return rows.join(named, F.col("left_id").eqNullSafe(F.col("right_id")), how).select("row.*")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. Labels of the held-out fold aren't used."""
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id")).select("doc_id", F.col("quality").alias("label"))
    weights, bias = quality.train(docs, labels)
    # All columns travel as one, so that none clashes with a result's.
    scored = quality.score(docs.select("text", F.struct(*docs.columns).alias("row")), weights, bias)
    return scored.where("score >= 0.5").select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of line runs. A document that was nothing but later copies goes."""
    out = line_dedup.dedup_lines(docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c != "text"]).alias("row"))).where("n_deleted < n_lines OR n_lines = 0")
    made = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)}
    return out.select(*[made.get(c, F.col("row")[c]).alias(c) if c != "text" else made[c] for c in docs.columns])


def id_key(c: Column, name: str) -> list[Column]:
    """Two columns without nulls that are equal where ids are, nulls included."""
    return [F.coalesce(c, F.lit(0)).alias(f"{name}_id"), c.isNull().alias(f"{name}_null")]


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group that near-duplicate links join: five words, similarity 0.8."""
    found = near_dup.near_duplicates(docs, k=5, similar=80)
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(*id_key(F.col("doc_id"), "right"))
    # The join and the removal of repeated rows go by the same columns, so that texts are shuffled once.
    rest = F.struct(*[c for c in docs.columns if c != "text"])
    rows = docs.select(*id_key(F.col("doc_id").cast("long"), "left"), F.col("text").alias("left_text"), rest.alias("row"))
    kept = rows.join(stay, (F.col("left_id") == F.col("right_id")) & (F.col("left_null") == F.col("right_null")), "left_semi")
    kept = kept.dropDuplicates(["left_id", "left_null", "left_text"])
    return kept.select(*[F.col("left_text").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of a benchmark item."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return by_id(docs, found.where("contaminated"), "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    import public_tokenizers

    return bpe.bpe_round_trip(docs, public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: Near duplicates, decontamination and BPE in one SQL text aren't practical, and the classifier is trained: see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = stored(docs)
    return docs
