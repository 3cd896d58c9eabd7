"""SimHash near-dedup by tiled exact comparison.

Fingerprint: each bit is set where over half of the text's three-word shingles (repeats included)
have that bit set in their XXH64. Two fingerprints link at ``radius`` or fewer differing bits.

Finding the links: fingerprints are first made distinct, so exact and same-fingerprint copies never
meet. 64 bits are cut in radius+1 blocks; two fingerprints within the radius agree on one block at
least, so only rows that share a block's value need comparing, and no link is lost. Inside such a
group, rows are tiled by population count (and, where one count has more rows than a tile holds, by
a hash), and a pair of tiles is compared only if their counts differ by at most the radius: that
many set bits must differ at least. Each pair of tiles is its own task key, so one hot group spreads
over the cluster and no task holds more than two tiles. A tile pair is compared with numpy
exclusive-or and bit counts and emits a spanning forest of its links rather than all of them, which
keeps the components and bounds the output by the rows read.

Defined results: null and word-free texts have fingerprint zero and link like any other; fewer
words than a shingle give one shingle of them all; repeated rows share fingerprint and component
and each stays in the result; null ids are ignored as representatives, and a component whose ids are all null
has component_id null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import materialise, quoted
from corpusmill.llm.components import components

BITS = 64


def fingerprint(text: str | None, words_per_shingle: int = 3) -> int:
    """The fingerprint of one text, as an unsigned 64-bit integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and \x20\x09-\x0D only
    if not words:
        return 0
    k = min(words_per_shingle, len(words))
    hashes = np.fromiter(
        (xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)), np.uint64, len(words) - k + 1
    )
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i : i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = np.flatnonzero(2 * ones > len(hashes))
    return int(np.bitwise_or.reduce(np.left_shift(np.uint64(1), set_bits.astype(np.uint64)), initial=np.uint64(0)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: Column | None = None) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's bits as a signed long. With ``mark``, a long of each row, that too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py()) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fps.view(np.int64)), *batch.columns[2:]], names=["doc_id", "fp", "mark"][: batch.num_columns])

    marks = [] if mark is None else [mark.alias("mark")]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *marks).mapInArrow(run, "doc_id long, fp long" + ", mark long" * len(marks))


def forest(left: np.ndarray, right: np.ndarray, radius: int, step: int = 256) -> list[tuple[int, int]]:
    """Links within ``radius`` between two tiles (or inside one, if they are the same), thinned to a spanning forest."""
    names = np.unique(np.concatenate([left, right]))
    parent = np.arange(len(names))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    at_right = np.searchsorted(names, right)
    kept = []
    for i in range(0, len(left), step):
        rows = left[i : i + step]
        near = np.bitwise_count(rows[:, None] ^ right[None, :]) <= radius
        at_left = np.searchsorted(names, rows)
        a, b = np.nonzero(near)
        for x, y in zip(at_left[a].tolist(), at_right[b].tolist(), strict=True):
            if x != y and (p := root(x)) != (q := root(y)):
                parent[max(p, q)] = min(p, q)
                kept.append((int(names[x]), int(names[y])))
    return kept


def compare_tiles(radius: int):
    """mapInArrow over rows (key, side, fp) sorted by key: the links inside each tile pair."""

    def done(key: str | None, sides: list[list[np.ndarray]]) -> list[tuple[int, int]]:
        if key is None:
            return []
        own, other = (np.concatenate(s) if s else np.empty(0, np.uint64) for s in sides)
        return forest(own, other if sides[1] else own, radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides, links = None, [[], []], []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            side = batch.column(1).to_numpy(zero_copy_only=False)
            fps = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if keys[a] != key:
                    links += done(key, sides)
                    key, sides = keys[a], [[], []]
                for k in (0, 1):
                    sides[k].append(fps[a:b][side[a:b] == k])
                    if not len(sides[k][-1]):
                        sides[k].pop()
            if len(links) > 50_000:
                yield _pairs(links)
                links = []
        yield _pairs(links + done(key, sides))

    return run


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def block(fp: Column, k: int, blocks: int) -> Column:
    """Bits of block ``k`` of ``blocks``, as a long."""
    start, end = BITS * k // blocks, BITS * (k + 1) // blocks
    return F.shiftrightunsigned(F.shiftleft(fp, BITS - end), BITS - end + start)


def near_links(fps: DataFrame, radius: int = 2, tile_rows: int = 1024) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) between fingerprints that span every component."""
    blocks = radius + 1
    cut = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), block(F.col("fp"), k, blocks).alias("v")) for k in range(blocks)]))
    rows = fps.select("fp", F.bit_count("fp").cast("int").alias("ones"), cut.alias("g")).select("fp", "ones", "g.k", "g.v")
    # Tiles of each group, from counts alone: one row for each group and population count.
    sizes = rows.groupBy("k", "v", "ones").agg(F.count(F.lit(1)).alias("n"))
    groups = (
        sizes.groupBy("k", "v")
        .agg(F.sum("n").alias("n"), F.collect_list(F.struct("ones", F.ceil(F.col("n") / tile_rows).cast("int").alias("tiles"))).alias("tiles"))
        .where("n > 1")
    )
    placed = rows.join(groups, ["k", "v"])
    # A group that fits in a tile is one pair (itself with itself). Else a row meets each tile near enough in count:
    # of the two sides the smaller (ones, salt) is side 0.
    salt_of = lambda tiles: F.pmod(F.xxhash64("fp"), tiles)
    mine = F.element_at(F.filter("tiles", lambda t: t["ones"] == F.col("ones")), 1)["tiles"]
    own = F.col("ones") * 1_000_000 + salt_of(mine)
    others = F.flatten(
        F.transform(
            F.filter("tiles", lambda t: F.abs(t["ones"] - F.col("ones")) <= radius),
            lambda t: F.transform(F.sequence(F.lit(0), t["tiles"] - 1), lambda s: (t["ones"] * 1_000_000 + s).cast("long")),
        )
    )
    meets = F.when(F.col("n") <= tile_rows, F.array(F.lit(-1).cast("long"))).otherwise(others)
    met = placed.select("fp", "k", "v", own.cast("long").alias("own"), F.explode(meets).alias("other"))
    small = F.col("other") == -1
    whole = F.concat_ws(":", "k", "v")
    tasks = met.select(
        F.when(small, whole).otherwise(F.concat_ws(":", whole, F.least("own", "other"), F.greatest("own", "other"))).alias("key"),
        F.when(small, 0).otherwise((F.col("own") > F.col("other")).cast("int")).alias("side"),
        "fp",
    )
    return tasks.repartition("key").sortWithinPartitions("key").mapInArrow(compare_tiles(radius), "a long, b long")


def by_fingerprint(rows: DataFrame, radius: int) -> DataFrame:
    """(doc_id, fp) -> (fp, component, component_id): the component of each fingerprint, by its name and its smallest document id."""
    reps = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "representatives")
    linked = near_links(reps.select("fp"), radius)
    found = components(linked)
    # Components are named by fingerprint; their id is the smallest document id of any member.
    named = reps.join(found, reps.fp == found.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    ids = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    return named.join(ids, "component").select("fp", "component", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    rows = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    by_fp = by_fingerprint(rows, radius).select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2) -> DataFrame:
    """``docs`` with one row of each component, the first by (id, fingerprint, text); all columns kept.

    Rows that repeat an id are told apart by their components. Rows without an id stay.
    """
    rest = docs.where(F.col(id_col).isNull())
    mark = F.xxhash64(text_col)  # tells the texts of one id apart
    fps = materialise(fingerprints(docs, id_col, text_col, mark), "fingerprints")
    found = by_fingerprint(fps.select("doc_id", "fp"), radius).select("fp", "component")
    named = fps.where("doc_id is not null")
    first = named.join(found, "fp").groupBy("component").agg(F.min(F.struct("doc_id", "fp")).alias("x")).select("x.*")
    stay = named.join(first, ["doc_id", "fp"], "left_semi").select(F.col("doc_id").alias("id"), "mark", "fp").distinct()
    row = F.struct(*[F.col(quoted(c)) for c in docs.columns])
    rows = docs.select(F.col(id_col).cast("long").alias("id"), mark.alias("mark"), F.col(text_col).alias("text"), row.alias("row"))
    kept = rows.join(stay, ["id", "mark"]).groupBy("id", "fp").agg(F.min_by("row", F.coalesce("text", F.lit(""))).alias("row"))
    return kept.select("row.*").unionByName(rest)
