"""Copies between a local and a remote store, the run to resume, and what may be published: plans as tables of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def joined_key(prefix: Column, key: Column) -> Column:
    """prefix/key with one slash between them and none in front; an empty prefix leaves the key."""
    bare = F.regexp_replace(key, "^/+", "")
    return F.when(F.coalesce(prefix, F.lit("")) == "", bare).otherwise(F.concat(F.regexp_replace(prefix, "/+$", ""), F.lit("/"), bare))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def rewritten(path: Column) -> Column:
    """Whether a path inside a run is written anew in place, so that a copy that is there may be old."""
    return (path == "trainer_state.json") | path.rlike("^(resume_state|resume_state_best|ckpt_best)/")


def upload_plan(local: DataFrame, remote: DataFrame, prefix: str, folder: str, override: bool = False, forced: Column | None = None) -> DataFrame:
    """local (path), remote (key) -> (path, key, action): what is there is skipped, unless forced or overridden."""
    key = joined_key(F.lit(prefix), F.concat(F.lit(folder.rstrip("/") + "/"), F.col("path")))
    there = remote.select("key").distinct().withColumn("there", F.lit(True))
    forced = rewritten(F.col("path")) if forced is None else forced
    copy = F.col("there").isNull() | forced | F.lit(override)
    return local.select("path", key.alias("key")).join(there, "key", "left").select("path", "key", F.when(copy, "copy").otherwise("skip").alias("action"))


def download_plan(remote: DataFrame, local: DataFrame, prefix: str, folder: str, forced: Column | None = None) -> DataFrame:
    """remote (key), local (path, bytes) -> (path, key, action) of all keys below the folder; a local file counts if it isn't empty."""
    whole = (f"{prefix.rstrip('/')}/" if prefix else "") + folder.strip("/") + "/"
    below = remote.where(F.col("key").startswith(whole)).select("key", F.substr("key", F.lit(len(whole) + 1)).alias("path")).where("path <> ''")
    there = local.where("bytes > 0").select("path").distinct().withColumn("there", F.lit(True))
    forced = rewritten(F.col("path")) if forced is None else forced
    return below.join(there, "path", "left").select("path", "key", F.when(F.col("there").isNull() | forced, "copy").otherwise("skip").alias("action"))


def below(listing: DataFrame, prefix: str) -> DataFrame:
    """Rows whose key lies below the prefix: what a delete by prefix removes."""
    return listing.where(F.col("key").startswith(prefix.rstrip("/") + "/"))


def timestamp_of(run: Column, mode: Column) -> Column:
    """A run's name without its mode."""
    return F.when(run.endswith(F.concat(F.lit("_"), mode)), F.substr(run, F.lit(1), F.length(run) - F.length(mode) - 1)).otherwise(run)


def latest_runs(runs: DataFrame, *by: str) -> DataFrame:
    """runs (by..., side, name, mode, iter, has_state) -> of each mode and side the run of the last name that has its state, then of both sides
    the one of the larger (iter, timestamp); the remote one must be strictly larger."""
    last = runs.where(F.col("has_state") & F.col("name").endswith(F.concat(F.lit("_"), F.col("mode")))).groupBy(*by, "mode", "side").agg(F.max(F.struct("name", "iter")).alias("r"))
    recency = F.struct(F.col("r.iter").alias("iter"), timestamp_of(F.col("r.name"), F.col("mode")).alias("at"), (F.col("side") == "local").alias("is_local"))
    found = last.groupBy(*by, "mode").agg(F.max_by(F.struct("side", "r.name", "r.iter"), recency).alias("x"))
    return found.select(*by, "mode", "x.side", "x.name", "x.iter")


def published(losses: DataFrame, run: str, order: str, loss: str, band: float = 0.4) -> DataFrame:
    """Adds ``push`` to each evaluation of a run: the first is published, a later one if its loss is within ``band`` of the last published one.

    The fold runs over one run's evaluations in order, which are as many as the run has checkpoints."""
    rows = losses.groupBy(run).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(loss).cast("double").alias("l")))).alias("e"))
    out = F.array().cast("array<struct<o:long,l:double,push:boolean>>")
    start = F.struct(F.lit(None).cast("double").alias("last"), out.alias("out"))

    def step(acc: Column, e: Column) -> Column:
        push = acc["last"].isNull() | (F.abs(e["l"] - acc["last"]) <= band)
        return F.struct(F.when(push, e["l"]).otherwise(acc["last"]).alias("last"), F.concat(acc["out"], F.array(F.struct(e["o"].cast("long").alias("o"), e["l"].alias("l"), push.alias("push")))).alias("out"))

    done = rows.select(run, F.explode(F.aggregate("e", start, step)["out"]).alias("x"))
    return done.select(run, F.col("x.o").alias(order), F.col("x.l").alias(loss), "x.push")


def resumed_well(saved: Column, now: Column, same_batch: Column, weights_saved: Column, weights_now: Column) -> Column:
    """'ok', 'other batch' (the losses cannot be compared), or what moved: 'loss' by more than 0.1, 'weights' by more than 0.01."""
    return F.when(~same_batch, "other batch").when(F.abs(now - saved) > 0.1, "loss").when(F.abs(weights_now - weights_saved) > 0.01, "weights").otherwise("ok")


def bytes_hash(ids: Column) -> Column:
    """First 16 hex digits of SHA-256 over 16-bit little-endian ids."""
    swapped = F.transform(ids, lambda t: F.concat(F.lpad(F.hex(t % 256), 2, "0"), F.lpad(F.hex(F.floor(t / 256).cast("long")), 2, "0")))
    return F.substring(F.sha2(F.unhex(F.array_join(swapped, "")), 256), 1, 16)
