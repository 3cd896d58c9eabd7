"""Mixing sources to target weights by Poisson replication.

A source of weight w gets the mean repetition rate  epochs * total size * (w / sum of weights) / its size.
Each document draws its number of copies from a Poisson distribution with that mean, by inverting
the distribution at a uniform that is a hash of seed and id: the same row always gets the same
count, on any cluster and after any retry. Copies are then shuffled globally: a hash of (seed, id,
copy) deals them to partitions and orders each partition.

The size table has one row per source. It is read to the driver and broadcast only if it has at
most ``broadcast_sources`` rows; beyond that, counts are drawn on ids alone, joined to sources by an
ordinary join whose hot keys AQE splits, and only then meet the documents on their id.

Defined results: null text has size 0; a null source is a source of its own (weight ``default``); a
source whose texts are all empty has size 0 and rate 0; rows that repeat an id get equal counts and
equal shuffle keys; a null id hashes as the empty string; an empty table gives an empty result.
Extra columns ride along, whatever their names; the added columns ``repetitions``, ``copy`` and ``shuffle_key``
stand in place of extra columns of these names, unless ``added`` is false: then only the columns of ``docs`` return.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import quoted


RUN = 4096  # copies exploded at once


def uniform(seed: int, *parts: Column) -> Column:
    """52 bits of a hash as a number in [0, 1)."""
    return F.conv(F.substring(hashed(seed, *parts), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def hashed(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def distribution(rate: float) -> tuple[int, list[float]]:
    """Poisson's distribution function at ``first``, ``first`` + 1, ... up to a tail below double precision, and ``first``.

    A high rate starts 12 standard deviations below it, where less than double precision lies, so the list grows with the square root of the rate."""
    if rate <= 0:
        return 0, [1.0]
    first = int(rate - 12 * math.sqrt(rate)) if rate >= 400 else 0
    log_p = -rate
    if first:  # Stirling's series for the factorial
        log_p += first * (math.log(rate) - math.log(first) + 1) - math.log(2 * math.pi * first) / 2 - 1 / (12 * first) + 1 / (360 * first**3)
    total = math.exp(log_p)
    found = [total]
    for k in range(first + 1, int(rate + 12 * math.sqrt(rate)) + 30):
        log_p += math.log(rate) - math.log(k)
        total += math.exp(log_p)
        found.append(total)
    return first, found


def distribution_column(rate: Column) -> Column:
    """The same as ``distribution``, as a struct column."""
    first = F.when(rate >= 400, (rate - 12 * F.sqrt(rate)).cast("long")).otherwise(0)
    last = (rate + 12 * F.sqrt(rate)).cast("long") + 29
    n = first.cast("double")
    stirling = n * (F.log(rate) - F.log(n) + 1) - F.log(2 * math.pi * n) / 2 - 1 / (12 * n) + 1 / (360 * n * n * n)
    begin = -rate + F.when(first > 0, stirling).otherwise(0.0)
    start = F.struct(begin.alias("log_p"), F.exp(begin).alias("total"), F.array(F.exp(begin)).alias("found"))

    def step(acc: Column, k: Column) -> Column:
        log_p = acc["log_p"] + (F.log(rate) - F.log(k.cast("double")))
        total = acc["total"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), total.alias("total"), F.concat(acc["found"], F.array(total)).alias("found"))

    some = F.struct(first.cast("long").alias("first"), F.aggregate(F.sequence(first + 1, last), start, step, lambda acc: acc["found"]).alias("cdf"))
    return F.when(rate > 0, some).otherwise(F.struct(F.lit(0).cast("long").alias("first"), F.array(F.lit(1.0)).alias("cdf")))


def drawn(poisson: Column, u: Column) -> Column:
    """The number whose step of the distribution function ``u`` falls in, found by halving."""
    cdf = poisson["cdf"]
    start = F.struct(F.lit(0).alias("low"), F.size(cdf).alias("high"))  # entries before ``low`` are at most u, those from ``high`` on above it

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        below = F.get(cdf, mid) <= u
        return F.when(acc["low"] >= acc["high"], acc).otherwise(F.struct(F.when(below, mid + 1).otherwise(acc["low"]).alias("low"), F.when(below, acc["high"]).otherwise(mid).alias("high")))

    rounds = F.sequence(F.lit(1), F.ceil(F.log2(F.size(cdf).cast("double"))).cast("int") + 1)
    return (poisson["first"] + F.aggregate(rounds, start, halve, lambda acc: acc["low"])).cast("int")


def weight_column(source: Column, weights: dict[str, float], default: float) -> Column:
    found = F.lit(float(default))
    for name, w in weights.items():
        found = F.when(source == name, float(w)).otherwise(found)
    return found


def counts(docs: DataFrame, weights: dict[str, float], default: float, epochs: float, seed: int, broadcast_sources: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``docs`` with the column ``__repetitions``."""
    source = F.col(source_col).cast("string")
    sizes = docs.groupBy(source.alias("__source")).agg(F.sum(F.coalesce(F.length(text_col), F.lit(0))).cast("double").alias("__size"))
    known = sizes.limit(broadcast_sources + 1).collect()
    if len(known) <= broadcast_sources:
        weight = {r["__source"]: float(weights.get(r["__source"], default)) for r in known if r["__size"]}
        total, shares = sum(r["__size"] for r in known), sum(weight.values())
        rates = [(r["__source"], distribution(epochs * total * weight[r["__source"]] / shares / r["__size"] if r["__size"] else 0.0)) for r in known]
        table = docs.sparkSession.createDataFrame(rates, "__source string, __poisson struct<first: long, cdf: array<double>>")
        with_u = docs.withColumn("__u", uniform(seed, F.col(id_col)))
        joined = with_u.join(F.broadcast(table), source.eqNullSafe(F.col("__source")))
        return joined.withColumn("__repetitions", drawn(F.col("__poisson"), F.col("__u"))).drop("__source", "__poisson", "__u")
    weighed = sizes.where("__size > 0").withColumn("__weight", weight_column(F.col("__source"), weights, default))
    totals = sizes.agg(F.sum("__size").alias("__total")).crossJoin(weighed.agg(F.sum("__weight").alias("__shares")))  # one row by one row
    rate = F.lit(float(epochs)) * F.col("__total") * F.col("__weight") / F.col("__shares") / F.col("__size")
    table = weighed.crossJoin(F.broadcast(totals)).select("__source", distribution_column(rate).alias("__poisson"))
    ids = docs.select(F.col(id_col).alias("__id"), source.alias("__of")).distinct().withColumn("__u", uniform(seed, F.col("__id")))
    draws = ids.join(table, F.col("__of").eqNullSafe(F.col("__source"))).select("__id", "__of", drawn(F.col("__poisson"), F.col("__u")).alias("__repetitions"))
    return docs.join(draws, F.col(id_col).eqNullSafe(F.col("__id")) & source.eqNullSafe(F.col("__of"))).drop("__id", "__of")


def mix(
    docs: DataFrame,
    weights: dict[str, float],
    default: float = 1.0,
    epochs: float = 1.0,
    seed: int = 42,
    broadcast_sources: int = 100_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    added: bool = True,
) -> DataFrame:
    """Every copy of every document, shuffled; all columns of ``docs`` and repetitions, copy, shuffle_key."""
    met = counts(docs, weights, default, epochs, seed, broadcast_sources, id_col, text_col, source_col).where("__repetitions > 0")
    runs = met.withColumn("__run", F.explode(F.sequence(F.lit(0), F.floor((F.col("__repetitions") - 1) / RUN).cast("int"))))
    of_run = F.sequence(F.col("__run") * RUN + 1, F.least((F.col("__run") + 1) * RUN, F.col("__repetitions")))
    copies = runs.withColumn("__copy", F.explode(of_run)).drop("__run")
    keyed = copies.withColumn("__key", F.substring(hashed(seed, F.col(id_col), F.col("__copy")), 1, 16))
    mixed = keyed.repartition("__key").sortWithinPartitions("__key", "__copy", id_col)
    if not added:
        return mixed.select(*map(quoted, docs.columns))
    names = {"repetitions": "__repetitions", "copy": "__copy", "shuffle_key": "__key"}
    return mixed.select(*[quoted(c) for c in docs.columns if c not in names], *[F.col(own).alias(name) for name, own in names.items()])
