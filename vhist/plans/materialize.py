"""Cutting lineage with tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a temporary one only where that setting is absent in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def spread(df: DataFrame, *keys: str, rows: int = 500_000) -> DataFrame:
    """``df`` dealt by keys over as many tasks as leave each about ``rows`` rows: what a task sorts doesn't grow with the table."""
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))
    return df.repartition(tasks, *keys)


def materialized(df: DataFrame) -> DataFrame:
    """Write and reread: an iteration's plan stays short, and a lost executor costs no earlier round."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.is_stored = True
    return out


def stored_once(df: DataFrame) -> DataFrame:
    """``df`` itself if it is a stored table as it was written, else stored."""
    return df if getattr(df, "is_stored", None) is True else materialized(df)
