"""Readers and writers of the other file kinds: JSON lines, text corpora, ledgers and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusmill.functions.text import strip_spaces, title


def json_lines(spark: SparkSession, paths: list[str], schema: StructType | str) -> DataFrame:
    """JSON lines with an explicit schema; blank lines are skipped, a bad line raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(paths)


def task_files(listing: DataFrame, task: str) -> DataFrame:
    """Rows (path) of a task's files with their place: the file named after the task, then its parts in order of their names."""
    name = F.element_at(F.split("path", "/"), -1)
    own = listing.withColumn("name", name).where(F.col("name").rlike(rf"^{task}(__part[^.]*)?\.[^.]+$"))
    return own.orderBy(F.col("name").contains("__part"), "name").select("path", "name")


def text_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(path, doc_id, title, text) of every .txt and .md file that isn't empty (Spark's readers pass those over); the id is the file's stem."""
    raw = spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    return raw.where(F.lower("path").rlike(r"\.(txt|md)$")).select("path", stem.alias("doc_id"), title(strip_spaces(F.col("text")), stem).alias("title"), "text")


def pending_files(listing: DataFrame, ledger: DataFrame) -> DataFrame:
    """Parquet files of a listing (dataset, file) that the ledger lacks."""
    return listing.where(F.col("file").endswith(".parquet")).join(ledger, ["dataset", "file"], "left_anti")


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_ledger(spark: SparkSession, path: str, rows: list[tuple[str, str]]) -> None:
    spark.createDataFrame(rows, "dataset string, file string").write.mode("append").parquet(path)
