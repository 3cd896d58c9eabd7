"""Exact dedup: group by a 128-bit content hash, compare bytes inside each group, keep one stable id.

DataFrame functions only. The grouping key is (digest, bytes): the hash aggregate places a row by
its digest and then compares the text's bytes, so texts that collide end in different groups. Copies
merge in the map-side half of the aggregate, so a group that holds a third of all rows reaches the
shuffle as one row per task. Members learn their group by a join on (digest, second digest) that
carries no text; AQE splits a hot group there.

Defined results: a null text counts as empty; all empty texts form one group; a null id is smaller
than any other and a group of null ids has keep_id null; of rows that repeat (equal id and text)
exactly one is kept; an empty table gives an empty result; extra columns never take part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import ascii_lower, quoted


def content_hash(text: Column) -> Column:
    """128 bits of the normalised text."""
    return F.unhex(F.md5(text))


def duplicate_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    normalise: Callable[[Column], Column] = ascii_lower,
    digest: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    best = F.max if keep == "largest" else F.min
    norm = normalise(F.coalesce(F.col(text_col), F.lit("")))
    texts = docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm"))
    groups = (
        texts.select("doc_id", digest(F.col("norm")).alias("digest"), "norm")
        .groupBy("digest", "norm")
        .agg(F.count(F.lit(1)).alias("group_size"), best("doc_id").alias("keep_id"))
        .select("digest", F.sha2("norm", 256).alias("text_sha256"), "group_size", "keep_id")
    )
    members = texts.select("doc_id", digest(F.col("norm")).alias("digest"), F.sha2("norm", 256).alias("text_sha256"))
    joined = members.join(groups, ["digest", "text_sha256"])
    # Rows that repeat whole share id and text; the first of each such run is the one that stays.
    runs = joined.groupBy("doc_id", "text_sha256").agg(
        F.first("keep_id").alias("keep_id"), F.first("group_size").alias("group_size"), F.count(F.lit(1)).alias("n")
    )
    return runs.select(
        "doc_id", "keep_id", "group_size", "text_sha256", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("nth")
    ).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
        "text_sha256",
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """``docs`` without the copies: one whole row of each group of equal texts, all columns kept.

    The whole row rides in the aggregate as one struct, so each row crosses the shuffle once and
    copies merge before it. Ties on the id are broken by the text itself.
    """
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    order = F.struct(F.col(id_col), F.col(text_col))
    pick = F.max_by if keep == "largest" else F.min_by
    row = F.struct(*[F.col(quoted(c)) for c in docs.columns])
    return (
        docs.select(content_hash(norm).alias("digest"), norm.alias("norm"), row.alias("row"), order.alias("order"))
        .groupBy("digest", "norm")
        .agg(pick("row", "order").alias("row"))
        .select("row.*")
    )
