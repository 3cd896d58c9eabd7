"""Windows over long ordered rows in levels, so that no partition has to hold one key's whole sequence.

Rows are cut in blocks of their integer position. A small table has one row per block; its own
window runs over blocks, and the wide rows only ever see windows inside their block. Where positions are so
far apart that there are about as many blocks as rows, the table of blocks is cut in blocks again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 18


def scan(df: DataFrame, key: str, order: str, totals: dict[str, Column] | None = None, following: dict[str, Column] | None = None, block: int = BLOCK, levels: int = 1) -> DataFrame:
    """Adds, in one pass over blocks, a column for each name.

    totals: the sum of a value over earlier rows of the same key (this row not included).
    following: the least value (null where not wanted) over later rows of the same key.
    levels: tables of blocks; one holds positions up to block ** 2 in windows of at most ``block`` rows, three any 64-bit number.
    """
    totals, following = totals or {}, following or {}
    b, at, of = f"__b{levels}", f"__c{levels}", f"__k{levels}"
    names = [f"__v{levels}_{k}" for k in range(len(totals) + len(following))]
    rows = df.withColumns(dict(zip(names, [*totals.values(), *following.values()], strict=True))).withColumn(b, F.floor(F.col(order) / block))
    n = len(totals)
    sums = rows.groupBy(F.col(key).alias(of), F.col(b).alias(at)).agg(*[F.sum(v).alias(v) for v in names[:n]], *[F.min(v).alias(v) for v in names[n:]])
    if levels > 1:
        starts = scan(sums, of, at, {f"{v}s": F.col(v) for v in names[:n]}, {f"{v}s": F.col(v) for v in names[n:]}, block, levels - 1).drop(*names)
    else:
        # Later rows are looked at backwards: a frame that grows costs a step a row, one that shrinks is computed anew for each.
        across, back = (Window.partitionBy(of).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (at, F.desc(at)))
        before = [F.coalesce(F.sum(v).over(across), F.lit(0)).alias(f"{v}s") for v in names[:n]]
        starts = sums.select(of, at, *before, *[F.min(v).over(back).alias(f"{v}s") for v in names[n:]])
    joined = rows.join(starts, F.col(key).eqNullSafe(F.col(of)) & F.col(b).eqNullSafe(F.col(at)))
    early, late = (Window.partitionBy(key, b).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (order, F.desc(order)))
    found = {name: (F.col(f"{v}s") + F.coalesce(F.sum(v).over(early), F.lit(0))).cast("long") for name, v in zip(totals, names, strict=False)}
    found |= {name: F.coalesce(F.min(v).over(late), F.col(f"{v}s")) for name, v in zip(following, names[n:], strict=True)}
    return joined.select("*", *[c.alias(name) for name, c in found.items()]).drop(b, of, at, *names, *[f"{v}s" for v in names])


def running_total(df: DataFrame, key: str, order: str, value: Column, name: str, block: int = BLOCK, levels: int = 1) -> DataFrame:
    return scan(df, key, order, totals={name: value}, block=block, levels=levels)
