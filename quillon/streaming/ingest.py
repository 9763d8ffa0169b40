"""Ingests new files as micro-batches, each artifact and account once for all time."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def admitted(batch: DataFrame, ledger: DataFrame | None) -> DataFrame:
    """Artifacts of a batch (digest, account_id, path) that the ledger doesn't have yet."""
    fresh = batch.groupBy("digest", "account_id").agg(F.min("path").alias("path"), F.count("*").alias("copies"))
    return fresh if ledger is None else fresh.join(ledger.select("digest", "account_id"), ["digest", "account_id"], "left_anti")


def files(spark: SparkSession, folder: str, account_id: str, limit: int = 100) -> DataFrame:
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("maxFilesPerTrigger", limit).load(folder)
    return stream.select(F.sha2("content", 256).alias("digest"), F.lit(account_id).alias("account_id"), "path")


_LEDGER = "digest string, account_id string, path string, copies bigint, batch int"


def ingest(stream: DataFrame, ledger_path: str, checkpoint: str) -> StreamingQuery:
    """Appends to the ledger what is new.  The batch's number is a folder of the ledger, so
    a batch that is run again after a failure replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger_path)
        there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        ledger = spark.read.schema(_LEDGER).option("basePath", ledger_path).parquet(ledger_path).filter(F.col("batch") != number) if there else None
        admitted(batch, ledger).write.mode("overwrite").parquet(os.path.join(ledger_path, f"batch={number}"))

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
