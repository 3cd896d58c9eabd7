"""Metrics of classifiers, routers and losses over long or array tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import let


def confusion(df: DataFrame, true: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(true).alias("true"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def per_class(counts: DataFrame) -> DataFrame:
    """(cls, tp, fp, fn) of each label that is true or predicted anywhere."""
    sides = counts.select(F.explode(F.array(F.struct(F.col("true").alias("cls"), F.lit(1).alias("t")), F.struct(F.col("pred").alias("cls"), F.lit(0).alias("t")))).alias("x"), "n", (F.col("true") == F.col("pred")).alias("hit"))
    one = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return sides.groupBy("x.cls").agg(one((F.col("x.t") == 1) & F.col("hit")).alias("tp"), one((F.col("x.t") == 0) & ~F.col("hit")).alias("fp"), one((F.col("x.t") == 1) & ~F.col("hit")).alias("fn"))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def classification(df: DataFrame, true: str, pred: str) -> DataFrame:
    """One row: accuracy, macro and micro precision, recall and F1. Micro equals accuracy for single labels."""
    c = per_class(confusion(df, true, pred)).withColumns({"p": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "r": ratio(F.col("tp"), F.col("tp") + F.col("fn")), "f": ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))})
    micro = ratio(F.sum("tp"), F.sum("tp") + F.sum("fp"))
    return c.agg(micro.alias("accuracy"), F.avg("p").alias("macro_precision"), F.avg("r").alias("macro_recall"), F.avg("f").alias("macro_f1"), micro.alias("micro_precision"), ratio(F.sum("tp"), F.sum("tp") + F.sum("fn")).alias("micro_recall"), ratio(2 * F.sum("tp"), 2 * F.sum("tp") + F.sum("fp") + F.sum("fn")).alias("micro_f1"))


def multilabel(df: DataFrame, row_id: str, true: str, pred: str) -> DataFrame:
    """Support-weighted precision, recall and F1 over the classes that are true somewhere; arrays count as sets."""
    t = df.select(F.col(row_id).alias("id"), F.explode(F.array_distinct(true)).alias("cls")).withColumn("t", F.lit(1))
    p = df.select(F.col(row_id).alias("id"), F.explode(F.array_distinct(pred)).alias("cls")).withColumn("p", F.lit(1))
    both = t.join(p, ["id", "cls"], "full")
    n = lambda a, b: F.sum((a & b).cast("long"))
    has_t, has_p = F.col("t").isNotNull(), F.col("p").isNotNull()
    c = both.groupBy("cls").agg(n(has_t, has_p).alias("tp"), n(~has_t, has_p).alias("fp"), n(has_t, ~has_p).alias("fn")).withColumn("support", F.col("tp") + F.col("fn")).where("support > 0")
    w = lambda x: F.sum(x * F.col("support")) / F.sum("support")
    return c.agg(w(ratio(F.col("tp"), F.col("tp") + F.col("fp"))).alias("precision"), w(ratio(F.col("tp"), F.col("tp") + F.col("fn"))).alias("recall"), w(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f1"))


def log_sum_exp(x: Column) -> Column:
    """Of an array, shifted by its maximum, which is looked for once."""
    return let(F.array_max(x), lambda top: top + F.log(F.aggregate(x, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))))


def softmax(x: Column) -> Column:
    return let(log_sum_exp(x), lambda total: F.transform(x, lambda v: F.exp(v - total)))


def cross_entropy(df: DataFrame, logits: str, target: str, ignore: int = -100) -> DataFrame:
    """Adds ``nll`` (null where the target is ignored)."""
    lse = df.withColumn("__lse", log_sum_exp(F.col(logits)))
    return lse.withColumn("nll", F.when(F.col(target) != ignore, F.col("__lse") - F.element_at(logits, F.col(target) + 1))).drop("__lse")


def top_k(df: DataFrame, row_id: str, logits: str, k: int) -> DataFrame:
    """(row, expert, value, rank) of the k largest entries; ties go to the lower index. Each row sorts its own array."""
    keyed = F.transform(logits, lambda v, i: F.struct((-v).alias("neg"), i.alias("expert")))
    best = F.slice(F.array_sort(keyed), 1, k)
    return df.select(row_id, F.posexplode(best).alias("rank", "e")).select(row_id, F.col("e.expert").alias("expert"), (-F.col("e.neg")).alias("value"), (F.col("rank") + 1).alias("rank"))


def routed(logits: Column, k: int) -> Column:
    """For each expert of a row its softmax probability and whether the row routes to it, in one array."""
    best = F.slice(F.array_sort(F.transform(logits, lambda v, i: F.struct((-v).alias("neg"), i.alias("expert")))), 1, k)["expert"]
    return let(best, lambda chosen: F.transform(softmax(logits), lambda p, i: F.struct(p.alias("p"), F.array_contains(chosen, i).cast("double").alias("hit"))))


def expert_load(df: DataFrame, row_id: str, logits: str, k: int, *by: str) -> DataFrame:
    """(by..., expert, load, prob): share of rows that route to each expert, and its mean softmax probability."""
    each = df.select(*by, F.posexplode(routed(F.col(logits), k)).alias("expert", "e"))
    return each.groupBy(*by, "expert").agg((F.sum("e.hit") / F.count(F.lit(1)) / k).alias("load"), F.avg("e.p").alias("prob"))


def nucleus(df: DataFrame, row_id: str, logits: str, top_p: float) -> DataFrame:
    """(row, token, p): the most probable entries until their mass passes top_p, renormalised. Each row sorts its own array."""
    order = F.array_sort(F.transform(softmax(F.col(logits)), lambda p, i: F.struct((-p).alias("neg"), i.alias("token"))))
    start = F.struct(F.lit(0.0).alias("mass"), F.lit(0).alias("n"))
    step = lambda acc, e: F.when(acc["mass"] <= top_p, F.struct((acc["mass"] - e["neg"]).alias("mass"), (acc["n"] + 1).alias("n"))).otherwise(acc)
    kept = df.select(row_id, order.alias("o")).select(row_id, "o", F.aggregate("o", start, step).alias("k"))
    return kept.select(row_id, F.explode(F.slice("o", F.lit(1), F.col("k.n"))).alias("e"), "k.mass").select(row_id, "e.token", (-F.col("e.neg") / F.col("mass")).alias("p"))


def relative_l2(df: DataFrame, layer: str, value: Column, reference: Column) -> DataFrame:
    """By layer and for all (layer null): |v - r| / |r|, infinite for a zero reference; flagged above 0.5."""
    sums = df.select(F.col(layer).alias("layer"), ((value - reference) ** 2).alias("d"), (reference**2).alias("r"))
    both = sums.groupingSets([["layer"], []], "layer").agg(F.sum("d").alias("d"), F.sum("r").alias("r"))
    rel = F.when(F.col("r") > 0, F.sqrt("d") / F.sqrt("r")).otherwise(F.lit(float("inf")))
    return both.select("layer", rel.alias("rel")).withColumn("flagged", F.col("rel") > 0.5)


def worst_layers(relative: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` layers that deviate most, and the figure over all."""
    return relative.where("layer is not null").orderBy(F.desc("rel"), "layer").limit(n).unionByName(relative.where("layer is null"))
