"""Exact and near dedup inside cells by Jaccard similarity of word shingles, with the greedy keep rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import fingerprint, shingles
from corpusmill.operators.checkpoints import cut


def prepared(df: DataFrame, cell: Column, row_id: str, text: Column, k: int = 5) -> DataFrame:
    """(cell, id, fp, sh): fingerprint and 64-bit hashes of distinct shingles. Null text counts as empty; rows with a null cell form one cell."""
    said, place = F.coalesce(text, F.lit("")), F.to_json(F.struct(cell.alias("c")))  # {} for a null cell
    return df.select(place.alias("cell"), F.col(row_id).alias("id"), fingerprint(said).alias("fp"), F.transform(shingles(said, k), lambda s: F.xxhash64(s)).alias("sh"))


def cell_value(name: str = "cell", kind: str = "string") -> Column:
    """The cell's own value again."""
    return F.from_json(F.col(name), f"c {kind}")["c"]


def unique(rows: DataFrame) -> DataFrame:
    """First row of each (cell, fingerprint)."""
    return rows.groupBy("cell", "fp").agg(F.min_by(F.struct("id", "sh"), "id").alias("r")).select("cell", "r.id", "r.sh")


def pairs(first: DataFrame, threshold: float) -> DataFrame:
    """(cell, a, b, jaccard) with a < b and Jaccard at least ``threshold``, exactly up to collisions of 64-bit shingle hashes.

    Prefix filter: two sets that similar share one of the rarest |A| - ceil(t |A|) + 1 shingles of each,
    so only those meet in the join; lengths that differ too much drop out there. Rows with equal sets meet
    through one of them, so a cluster of texts that differ in punctuation only costs one row in the join and one
    comparison; its members come back at the end, where the result names them. Rare-first order keeps boilerplate out of
    the join keys. The sets themselves are compared once for each surviving pair.
    """
    keyed = first.select("cell", "id", "sh", F.sha2(F.array_join(F.array_sort("sh").cast("array<string>"), ","), 256).alias("set"))
    sets = cut(keyed.groupBy("cell", "set").agg(F.min_by(F.struct("id", "sh"), "id").alias("r")).select("cell", "set", "r.id", "r.sh"))
    items = sets.select("cell", "id", F.explode("sh").alias("s"))
    rarity = items.groupBy("cell", "s").agg(F.count(F.lit(1)).alias("n"))
    ordered = items.join(rarity.where("n > 1"), ["cell", "s"]).groupBy("cell", "id").agg(F.array_sort(F.collect_list(F.struct("n", "s"))).alias("common"))
    sized = sets.select("cell", "id", F.size("sh").alias("size")).join(ordered, ["cell", "id"])
    # Shingles that no other row has come first in the order and match nothing.
    own = F.col("size") - F.size("common")
    take = F.greatest(F.col("size") - F.ceil(F.lit(threshold) * F.col("size") - 1e-9).cast("int") + 1 - own, F.lit(0))
    prefix = sized.select("cell", "id", "size", F.explode(F.slice("common", F.lit(1), take)).alias("c")).select("cell", "id", "size", "c.s")
    left = prefix.select("cell", "s", F.col("id").alias("a"), F.col("size").alias("size_a"))
    right = prefix.select("cell", "s", F.col("id").alias("b"), F.col("size").alias("size_b"))
    near = (F.col("size_a") >= F.lit(threshold) * F.col("size_b") - 1e-9) & (F.col("size_b") >= F.lit(threshold) * F.col("size_a") - 1e-9)
    met = left.join(right, ["cell", "s"]).where((F.col("a") < F.col("b")) & near).select("cell", "a", "b").distinct()
    both = met.join(sets.select("cell", F.col("id").alias("a"), F.col("sh").alias("sa")), ["cell", "a"]).join(sets.select("cell", F.col("id").alias("b"), F.col("sh").alias("sb")), ["cell", "b"])
    common = F.size(F.array_intersect("sa", "sb"))
    scored = both.select("cell", "a", "b", (common / (F.size("sa") + F.size("sb") - common)).alias("jaccard")).where(F.col("jaccard") >= threshold)
    members = keyed.select("cell", "set", "id").join(sets.select("cell", "set", F.col("id").alias("rep"), (F.size("sh") > 0).alias("some")), ["cell", "set"])
    left, right = members.select("cell", F.col("rep").alias("a"), F.col("id").alias("x")), members.select("cell", F.col("rep").alias("b"), F.col("id").alias("y"))
    across = scored.join(left, ["cell", "a"]).join(right, ["cell", "b"]).select("cell", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "jaccard")
    inside = members.where("some").select("cell", "rep", F.col("id").alias("a")).join(members.select("cell", "rep", F.col("id").alias("b")), ["cell", "rep"]).where("a < b")
    return across.unionByName(inside.select("cell", "a", "b", F.lit(1.0).alias("jaccard")))


def resolve(links: DataFrame) -> DataFrame:
    """(id, kept) of linked rows: kept unless an earlier kept row is linked, decided in rounds.

    A row without an earlier link that is undecided or kept is kept; a row with an earlier kept one is dropped.
    Each round is checkpointed; rounds are bounded by the longest chain of links. Only a count reaches the driver.
    """
    edges = cut(links.select("a", "b"))
    state = cut(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().withColumn("kept", F.lit(None).cast("boolean")))
    while True:
        seen = edges.join(state.select(F.col("id").alias("a"), F.col("kept").alias("ka")), "a").groupBy(F.col("b").alias("id")).agg(
            F.max(F.coalesce(F.col("ka"), F.lit(False))).alias("blocked"), F.max(F.col("ka").isNull()).alias("waiting")
        )
        told = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("blocked"), False).when(F.coalesce(F.col("waiting"), F.lit(False)), None).otherwise(True)
        state = cut(state.join(seen, "id", "left").select("id", told.alias("kept")))
        if state.where("kept is null").isEmpty():
            return state


def status(rows: DataFrame, links: DataFrame) -> DataFrame:
    """(id, status) of every prepared row: kept, dup_exact or dup_near."""
    first = rows.groupBy("cell", "fp").agg(F.min("id").alias("first"))
    told = rows.select("cell", "fp", "id").join(first, ["cell", "fp"]).join(resolve(links), "id", "left")
    return told.select("id", F.when(F.col("id") != F.col("first"), "dup_exact").when(~F.coalesce("kept", F.lit(True)), "dup_near").otherwise("kept").alias("status"))

