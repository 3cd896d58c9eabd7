"""Corpus preparation: dedup against a registry, splits, samples, shards and distribution reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import hash01, strip_spaces


def keep_first(df: DataFrame, key: Column, order: str) -> DataFrame:
    """First row of each key by ``order``: the map-side half of the aggregate folds copies before the shuffle."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(key.alias("__key")).agg(F.min_by(row, F.struct(order)).alias("__row")).select("__row.*")


def text_key(text: Column) -> Column:
    return F.md5(strip_spaces(text))


def not_registered(df: DataFrame, registry: DataFrame, key: Column) -> DataFrame:
    """Rows whose key the registry (column ``hash``) lacks."""
    return df.withColumn("__key", key).join(registry.select(F.col("hash").alias("__key")), "__key", "left_anti").drop("__key")


def test_size(n: Column) -> Column:
    """Rows of the validation split for a data set of n rows."""
    share = F.when(n <= 80_000, 0.10).when(n <= 800_000, 0.01).when(n <= 3_500_000, 0.0025).otherwise(0.0005)
    return F.when(n <= 50, F.lit(0)).otherwise((n * share).cast("long")).cast("long")


def split(df: DataFrame, group: str, row_id: str, seed: int = 2357, tiny: str = "none") -> DataFrame:
    """Adds ``split``: the rows of each group with the smallest seeded hashes are 'val', as many as test_size says.

    A tiny group has no validation rows; with ``tiny`` "copy" its rows are in both splits.

    Counts of hashes in 1,024 buckets say on which side of the boundary a bucket lies; only rows of the bucket
    that holds it are shuffled and ranked.
    """
    buckets = 1024
    rows = df.withColumn("__u", hash01(F.lit(str(seed)), F.col(row_id).cast("string"))).withColumn("__b", F.floor(F.col("__u") * buckets))
    sizes = rows.groupBy(F.col(group).alias("__g"), F.col("__b").alias("__c")).agg(F.count(F.lit(1)).alias("__n"))
    whole, before = Window.partitionBy("__g"), Window.partitionBy("__g").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    cuts = sizes.select("__g", "__c", "__n", test_size(F.sum("__n").over(whole)).alias("__want"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    cuts = cuts.select("__g", "__c", "__want", "__before", F.when(F.col("__before") + F.col("__n") <= F.col("__want"), "val").when(F.col("__before") >= F.col("__want"), "train").alias("__side"))
    joined = rows.join(cuts, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__b") == F.col("__c")))
    rank = F.row_number().over(Window.partitionBy("__g", "__c").orderBy("__u", row_id))
    ranked = joined.where("__side is null").withColumn("split", F.when(F.col("__before") + rank <= F.col("__want"), "val").otherwise("train"))
    whole_buckets = joined.where("__side is not null").withColumn("split", F.col("__side"))
    found = whole_buckets.unionByName(ranked)
    if tiny == "copy":
        found = found.unionByName(joined.where("__want = 0").withColumn("split", F.lit("val")))
    return found.drop("__u", "__b", "__g", "__c", "__want", "__before", "__side")


def sample(df: DataFrame, row_id: str, n: int, seed: int = 42) -> DataFrame:
    """First n rows of a seeded shuffle; -1 takes all."""
    mixed = df.withColumn("__h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(row_id).cast("string"))))
    return (mixed.orderBy("__h", row_id).limit(n) if n >= 0 else mixed).drop("__h")


def distribution(df: DataFrame, lang: str, task: str, tokens: Column) -> DataFrame:
    """Samples and tokens by language, by task and by both, in one pass (grouping sets)."""
    facts = df.select(F.col(lang).alias("lang"), F.col(task).alias("task"), tokens.cast("long").alias("tokens"))
    return facts.groupingSets([["lang"], ["task"], ["lang", "task"]], "lang", "task").agg(
        F.grouping_id("lang", "task").cast("int").alias("level"), F.count(F.lit(1)).alias("samples"), F.sum("tokens").alias("tokens")
    )


def cell_report(df: DataFrame, task: str, lang: str, status: str) -> DataFrame:
    """Counters of each (task, language) cell from one status column; U1's union of keys is the group-by itself."""
    n = lambda *names: F.sum(F.col(status).isin(*names).cast("long"))
    return df.groupBy(F.col(task).alias("task"), F.col(lang).alias("language")).agg(
        F.count(F.lit(1)).alias("generated"), n("parse_failed").alias("parse_failed"), n("validation_failed").alias("validation_failed"), n("dup_exact", "dup_near").alias("dedup_dropped"), n("ok").alias("kept")
    )


def cell_totals(report: DataFrame, warnings: DataFrame) -> DataFrame:
    """Sums over all cells and the number of warnings."""
    sums = report.agg(*[F.sum(c).alias(c) for c in ("generated", "parse_failed", "validation_failed", "dedup_dropped", "kept")])
    return sums.crossJoin(warnings.agg(F.count(F.lit(1)).alias("warnings")))  # one row each


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
