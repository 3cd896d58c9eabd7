"""Incremental ingestion with Structured Streaming: each micro-batch is deduplicated, appended and registered once.

A batch writes to a folder named by its batch id and is overwritten if it runs again, so a crash
between output and checkpoint neither loses nor doubles rows. The registry is read without this batch's own
entries, so a batch that runs again does not see its own rows as duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.corpus import keep_first, text_key


def source(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, some at a time; the stream's checkpoint is the ledger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_dedup(stream: DataFrame, folder: str, text_col: str = "text", order: str = "doc_id") -> None:
    """Write new rows to folder/out/batch=N and their keys to folder/registry/batch=N until the input is used up."""

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        keyed = keep_first(batch.withColumn("hash", text_key(F.col(text_col))), F.col("hash"), order)
        if number:
            # Only the parts of the registry that the batch can meet are read.
            prefixes = [r[0] for r in batch.select(F.substring(text_key(F.col(text_col)), 1, 1)).distinct().collect()]  # 16 at most
            seen = spark.read.schema("hash string, batch long, prefix string").parquet(f"{folder}/registry").where((F.col("batch") < number) & F.col("prefix").isin(prefixes))
            keyed = keyed.join(seen.select("hash"), "hash", "left_anti")
        keyed.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        written = spark.read.parquet(f"{folder}/out/batch={number}")
        written.select("hash", F.substring("hash", 1, 1).alias("prefix")).repartition("prefix").write.mode("overwrite").partitionBy("prefix").parquet(f"{folder}/registry/batch={number}")

    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def run_append(stream: DataFrame, folder: str) -> None:
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def run_counts(stream: DataFrame, keys: list[str], folder: str) -> None:
    """Counts by key, kept as restartable state; every batch leaves the full table in folder/out."""

    def one(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out")

    counts = stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"), F.sum(F.length("text")).alias("chars"))
    counts.writeStream.outputMode("complete").foreachBatch(one).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def run_ledger(stream: DataFrame, folder: str) -> None:
    """Append a stream of (file, ...) a batch at a time, and after each batch the files it held to the ledger; notes that it was started.

    Started again on the same folder it goes on with the files that the ledger lacks."""
    spark = stream.sparkSession
    spark.range(1).select(F.current_timestamp().alias("started")).write.mode("append").parquet(f"{folder}/starts")

    def one(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        done = spark.read.parquet(f"{folder}/out/batch={number}").groupBy("file").agg(F.count(F.lit(1)).alias("rows"))
        done.coalesce(1).write.mode("overwrite").parquet(f"{folder}/ledger/batch={number}")

    stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def restarts(spark: SparkSession, folder: str) -> int:
    """How often ``run_ledger`` was started on the folder after the first time."""
    return max(0, spark.read.parquet(f"{folder}/starts").count() - 1)
