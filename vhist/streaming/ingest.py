"""Incremental coverage: commits arrive in batches, coverage and frontier follow.

A batch's new commits are written to a folder of their own, which counts once a manifest names it; a batch that is run again after
its manifest was published adds nothing. A manifest's next version is made by exclusive creation, so of two writers one gets a
conflict and has changed nothing. The frontier is what covered commits name as parents and nobody has
delivered: nothing is dropped for being late.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vhist.plans.materialize import shared_folder


class Conflict(RuntimeError):
    """Another writer has published this version."""


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def publish(spark: SparkSession, base: str, version: int, content: dict) -> None:
    """Create manifest ``version``; fails if it is there. The file system must create exclusively."""
    fs, p = _fs(spark, f"{base}/_manifest/{version:012d}.json")
    fs.mkdirs(p.getParent())
    try:
        out = fs.create(p, False)
    except Exception as e:  # the JVM's FileAlreadyExistsException
        raise Conflict(f"version {version} of {base}") from e
    try:
        out.write(bytearray(json.dumps(content).encode()))
    finally:
        out.close()


def latest(spark: SparkSession, base: str) -> tuple[int, dict]:
    fs, p = _fs(spark, f"{base}/_manifest")
    if not fs.exists(p):
        return 0, {"batches": []}
    names = sorted(s.getPath().toString() for s in fs.listStatus(p))
    text = "".join(r[0] for r in spark.read.text(names[-1]).collect())
    return int(names[-1].rsplit("/", 1)[1].split(".")[0]), json.loads(text)


def covered(spark: SparkSession, base: str, schema) -> DataFrame:
    """The commits of the batches that the manifest names."""
    batches = latest(spark, base)[1]["batches"]
    paths = [f"{base}/covered/{b}" for b in batches]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def ingest(arrivals: DataFrame, base: str, key: str = "id"):
    """Start a stream that covers arriving commits, each once; runs over all that is there, then ends."""
    spark, schema = arrivals.sparkSession, arrivals.schema

    def add(batch: DataFrame, number: int) -> None:
        version, manifest = latest(spark, base)
        known = covered(spark, base, schema)
        new = batch.dropDuplicates([key]).join(known.select(key), key, "left_anti").select(*schema.names)
        if number in manifest.get("numbers", []):
            return
        # A name of its own: a writer that loses the race for the manifest touches nothing that counts.
        name = f"{number}-{uuid.uuid4().hex}"
        new.write.parquet(f"{base}/covered/{name}")
        publish(spark, base, version + 1, {"batches": [*manifest["batches"], name], "numbers": [*manifest.get("numbers", []), number]})

    return arrivals.writeStream.foreachBatch(add).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()


def frontier(commits: DataFrame, edges: DataFrame) -> DataFrame:
    """(parent): parents of covered commits that aren't covered."""
    named = edges.join(commits.select(F.col("id").alias("child")), "child", "left_semi").select("parent").distinct()
    return named.join(commits.select(F.col("id").alias("parent")), "parent", "left_anti")


def progress(commits: DataFrame, edges: DataFrame, by: str, errors: DataFrame | None = None) -> DataFrame:
    """(by, covered, complete, error): how much of each line of history is covered, whether nothing is missing below it, and the first
    error (by, at, error) that its import met and no later success took back. A line with an error isn't complete."""
    missing = edges.join(commits.select(F.col("id").alias("parent")), "parent", "left_anti").select(F.col("child").alias("id"), F.lit(True).alias("gap")).distinct()
    out = commits.join(missing, "id", "left").groupBy(by).agg(F.count("*").alias("covered"), (~F.coalesce(F.bool_or("gap"), F.lit(False))).alias("complete"))
    if errors is None:
        return out.withColumn("error", F.lit(None).cast("string"))
    met = errors.groupBy(by).agg(F.max_by("error", "at").alias("error"))
    return out.join(met, by, "left").withColumn("complete", F.col("complete") & F.col("error").isNull())


def arrivals(spark: SparkSession, folder: str, name: str, per_batch: int = 1) -> DataFrame:
    """A stream of a Parquet table's files, whether the table is one file in the folder or a folder of its own."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch)
    fs, p = _fs(spark, f"{folder}/{name}")
    if fs.getFileStatus(p).isDirectory():
        return stream.parquet(f"{folder}/{name}")
    return stream.option("pathGlobFilter", name).parquet(folder)


def ingest_table(spark: SparkSession, folder: str, name: str, select: list[str]) -> DataFrame:
    """Stream a Parquet table as arrivals into a new covered table and return that table."""
    stream = arrivals(spark, folder, name).selectExpr(*select)
    base = shared_folder(spark)
    ingest(stream, base).awaitTermination()
    return covered(spark, base, stream.schema)


def compact(spark: SparkSession, base: str, schema, key: str = "id", files: int = 8) -> None:
    """Rewrite all covered batches as one, in key order, under a new manifest version."""
    version, manifest = latest(spark, base)
    name = f"compact-{version + 1}-{uuid.uuid4().hex}"
    covered(spark, base, schema).repartitionByRange(files, key).sortWithinPartitions(key).write.parquet(f"{base}/covered/{name}")
    publish(spark, base, version + 1, manifest | {"batches": [name]})
