"""Small helpers that the operators share."""

from __future__ import annotations

import ctypes
import gc
import re
import sys
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one label fold in three are held out: crc32 of the id as text, modulo 3, equal to this.
HELD_OUT_FOLD = 1

#: Rows of a few numbers that one task writes, where a table's size is known.
ROWS_A_TASK = 50_000


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; a temporary one only where that setting is absent in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is run meanwhile leaves no shuffle files behind; else they stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def stored(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: later steps survive lost executors
    and recompute nothing that stands before this point. Its shuffles are removed then. ``rows`` is a bound of its rows, if one is known: a table of few
    narrow rows is written by as many tasks as there are cores, not by one task a shuffle partition."""
    spark = df.sparkSession
    path = shared_folder(spark)
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK)))
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column | str) -> Column:
    """True for the rows whose labels are never learned from. A null id counts as held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3 == HELD_OUT_FOLD, F.lit(True))


def is_held_out(doc_id: object) -> bool:
    """The same fold, for one id outside Spark."""
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 3 == HELD_OUT_FOLD


def forget_codecs() -> None:
    """Empty the codec caches that earlier BPE tasks left in this Python worker, and give their memory back to the system."""
    bpe = sys.modules.get("vhist.llm.bpe")
    if bpe is None or not bpe.codec_for.cache_info().currsize:
        return
    bpe.codec_for.cache_clear()
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    """The UTF-8 bytes of each value of a string column; null gives b''."""
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary())
    for value in column:
        yield value.as_py() or b""


def strings(batch: pa.RecordBatch, name: str = "text") -> Iterator[str]:
    """The values of a string column; null gives ''. Bytes that aren't UTF-8 become U+FFFD."""
    for raw in texts(batch, name):
        yield raw.decode("utf-8", "replace")
