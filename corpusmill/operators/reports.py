"""Small results and states outside tables: reports, metrics, manifests, configurations, and tables that must be unique."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def unique_by(df: DataFrame, key: str) -> DataFrame:
    """``df``; a key that occurs twice raises when its rows are read. Only keys are counted."""
    twice = df.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    joined = df.join(twice, F.col(key).eqNullSafe(F.col("__key")), "left")
    wrong = F.raise_error(F.concat(F.lit(f"{key} occurs twice: "), F.coalesce(F.col("__key").cast("string"), F.lit("null"))))
    return joined.withColumn(key, F.when(F.col("__n").isNotNull(), wrong.cast(df.schema[key].dataType)).otherwise(F.col(key))).select(*df.columns)


def registry(parts: list[DataFrame], key: str = "doc_id") -> DataFrame:
    """The parts as one table, in which no key may occur twice."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return unique_by(whole, key)


def without_text(df: DataFrame, mode: str) -> DataFrame:
    """``df`` without what its tokens were made of: data, messages and text for fine-tuning, else text."""
    return df.drop(*(("data", "messages", "text") if mode == "sft" else ("text",)))


def zipped(left: DataFrame, right: DataFrame, order: str) -> DataFrame:
    """Rows of two tables that share a row id, side by side; a row that only one has raises."""
    names = [c for c in right.columns if c != order]
    joined = left.withColumn("__l", F.lit(True)).join(right.withColumn("__r", F.lit(True)), order, "full")
    whole = F.when(F.col("__l") & F.col("__r"), F.col(order)).otherwise(F.raise_error(F.lit("the tables differ in length")).cast(left.schema[order].dataType))
    return joined.select(whole.alias(order), *[c for c in left.columns if c != order], *names)


def before_marker(text: Column, marker: str = "|end_of_text|") -> Column:
    return F.element_at(F.split(text, re.escape(marker), 2), 1)


def report(cells: DataFrame, warnings: DataFrame) -> dict:
    """The totals, the cells in order (one for each task and language) and the warnings, for a JSON file."""
    rows = [r.asDict() for r in cells.orderBy("task", "language").collect()]
    told = [r[0] for r in warnings.collect()]
    names = [c for c in cells.columns if c not in ("task", "language")]
    return {"totals": {n: sum(r[n] for r in rows) for n in names} | {"warnings": len(told)}, "cells": rows, "warnings": told}


def write_text(spark: SparkSession, path: str, text: str, append: bool = False) -> None:
    """One small file through Hadoop's file systems; appending writes the whole file anew."""
    context = spark.sparkContext
    jvm, conf = context._jvm, context._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(conf)
    old = read_text(spark, path) if append and files.exists(at) else ""
    out = files.create(at, True)
    try:
        out.write((old + text).encode())
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def write_report(spark: SparkSession, path: str, found: dict) -> None:
    write_text(spark, path, json.dumps(found, ensure_ascii=False, indent=2))


def write_metrics(spark: SparkSession, path: str, metrics: dict[str, float]) -> None:
    write_text(spark, path, "".join(f"{k}: {v}\n" for k, v in metrics.items()))


def append_manifest(spark: SparkSession, path: str, entry: dict) -> None:
    """One JSON line for each submitted job."""
    write_text(spark, path, json.dumps(entry, ensure_ascii=False) + "\n", append=True)


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(key, bytes) of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.col("path").alias("key"), F.col("length").alias("bytes"))


def delete_below(spark: SparkSession, folder: str) -> list[str]:
    """Deletes a folder and returns the keys that were in it."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(context._jsc.hadoopConfiguration())
    if not files.exists(at):
        return []
    keys = sorted(r.key for r in listing(spark, folder).select("key").collect())
    files.delete(at, True)
    return keys


def batches(df: DataFrame, column: str, size: int = 5000) -> Iterator[pd.Series]:
    """Batches of a column on the driver, a partition at a time: for a consumer outside Spark, like a tokenizer's trainer."""
    held: list = []
    for row in df.select(column).toLocalIterator(prefetchPartitions=True):
        held.append(row[0])
        if len(held) == size:
            yield pd.Series(held)
            held = []
    if held:
        yield pd.Series(held)


def whole_number(value: object) -> int:
    """An integer that may be written as a product, like '5 * 8'."""
    if isinstance(value, bool) or value is None:
        raise ValueError(f"no whole number: {value!r}")
    if isinstance(value, int | float):
        return int(value)
    made = 1
    for factor in str(value).replace("_", "").split("*"):
        made *= int(float(factor))
    return made


def settings(found: object, whole: tuple[str, ...] = ()) -> dict:
    """A configuration as one mapping: a list of mappings is merged in order; ``whole`` names integers."""
    merged: dict = {}
    for part in found if isinstance(found, list) else [found]:
        if part is None:
            continue
        if not isinstance(part, dict):
            raise ValueError(f"mappings expected, not {part!r}")
        merged |= {k: settings(v, whole) if isinstance(v, list) and any(isinstance(x, dict) for x in v) and all(x is None or isinstance(x, dict) for x in v) else v for k, v in part.items()}
    return {k: whole_number(v) if k in whole and v is not None else v for k, v in merged.items()}
