"""Token streams as long tables (file, pos, token): packing, documents, windows, segments and rewriting."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from corpusmill.functions.text import words
from corpusmill.operators.checkpoints import cut, written
from corpusmill.operators.sequence import running_total, scan

EOS = 0


def hashed_id(word: Column) -> Column:
    """Id of a word without a vocabulary: 10 and up, below 2^16."""
    return (F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long") % 65_000 + 10).cast("int")


def token_ids(text: Column, closing: int = 2) -> Column:
    """Ids of a text with ``closing`` end ids."""
    ids = F.transform(words(text), hashed_id)
    return F.concat(ids, F.array(*[F.lit(EOS)] * closing)) if closing else ids


def encoded(df: DataFrame, text: str, tokenizer: Callable[[], Callable[[list[str]], list[list[int]]]], closing: int = 2) -> DataFrame:
    """``df`` with ``ids`` of a tokenizer of the caller's, and ``closing`` end ids.

    ``tokenizer`` is called once in each task and returns what encodes a batch of texts; a null text counts as empty."""
    own = [f"c{k}" for k in range(len(df.columns))]
    at = df.columns.index(text)
    named = df.toDF(*own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer()
        for batch in batches:
            found = [[*ids, *[EOS] * closing] for ids in encode([t or "" for t in batch.column(at).to_pylist()])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32()))], names=[*own, "ids"])

    return named.mapInArrow(run, StructType([*named.schema.fields, StructField("ids", ArrayType(IntegerType()))])).toDF(*df.columns, "ids")


def check_ids(ids: Column) -> Column:
    """The ids, or an error if one does not fit in 16 bits."""
    return F.when(F.exists(ids, lambda t: (t < 0) | (t > 65_535)), F.raise_error(F.lit("token id outside 0..65535"))).otherwise(ids)


def offsets(packed: DataFrame, file: str = "file", order: str = "doc_id", existing: int = 0) -> DataFrame:
    """Adds ``start``: where each row's ids begin in its file. Only (file, order, length) enter the window; the ids meet their start in a join. The order may be any 64-bit number."""
    sizes = packed.select(F.col(file).alias("__file"), F.col(order).alias("__order"), F.size("ids").cast("long").alias("__n"))
    starts = running_total(sizes, "__file", "__order", F.col("__n"), "start", levels=3).select("__file", "__order", (F.col("start") + existing).alias("start"))
    return packed.join(starts, F.col(file).eqNullSafe(F.col("__file")) & F.col(order).eqNullSafe(F.col("__order"))).drop("__file", "__order")


def placed(packed: DataFrame, file: str = "file", order: str = "doc_id") -> DataFrame:
    """(file, doc_id, start, ids), written once: a text is tokenised a single time however often its ids are read."""
    table = written(packed.select(F.col(file).alias("file"), F.col(order).alias("doc_id"), "ids"), "ids")
    return offsets(table)


def stream(rows: DataFrame) -> DataFrame:
    """(file, doc_id, pos, token) of placed rows."""
    return rows.select("file", "doc_id", "start", F.posexplode("ids").alias("i", "token")).select("file", "doc_id", (F.col("start") + F.col("i")).alias("pos"), "token")


def blocks(tokens: DataFrame, size: int = 4096) -> DataFrame:
    """(file, start, ids) of a stream without documents: pieces of ``size`` positions."""
    pieces = tokens.groupBy("file", F.floor(F.col("pos") / size).alias("b")).agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("x"))
    return pieces.select("file", F.col("x")[0]["pos"].alias("start"), F.col("x.token").alias("ids"))


def document_number(tokens: DataFrame, eos: int = EOS) -> DataFrame:
    """Adds ``doc_seq``: number of ends before a position; an end belongs to the document it ends."""
    return running_total(tokens, "file", "pos", (F.col("token") == eos).cast("long"), "doc_seq")


def causal_pairs(tokens: DataFrame) -> DataFrame:
    """(file, i, j): positions i that may look at j, of the same document and not later."""
    a = tokens.select("file", "doc_seq", F.col("pos").alias("i"))
    b = tokens.select("file", "doc_seq", F.col("pos").alias("j"))
    return a.join(b, ["file", "doc_seq"]).where("j <= i").select("file", "i", "j")


def causal_ranges(placed: DataFrame) -> DataFrame:
    """(file, i, first) of documents with ``start`` and ``ids``, the end last: the same mask without its pairs: position i may look at first to i."""
    end = F.col("start") + F.size("ids") - 1
    return placed.select("file", F.explode(F.sequence(F.col("start"), end)).alias("i"), F.col("start").alias("first"))


def windows(tokens: DataFrame, starts: DataFrame, length: int) -> DataFrame:
    """(start, pos, x, y) of each window [start, start+length) of its file; y is the next token.

    A window meets positions by an equi-join on blocks of its own length, at most two for each window.
    """
    follow = tokens.select("file", (F.col("pos") - 1).alias("pos"), F.col("token").alias("y"))
    pairs = tokens.select("file", "pos", F.col("token").alias("x")).join(follow, ["file", "pos"]).withColumn("__b", F.floor(F.col("pos") / length))
    wanted = starts.withColumn("__b", F.explode(F.sequence(F.floor(F.col("start") / length), F.floor((F.col("start") + length - 1) / length))))
    return pairs.join(wanted, ["file", "__b"]).where((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("start") + length)).select("file", "start", "pos", "x", "y")


def tag_positions(tokens: DataFrame, ids: Iterable[int]) -> DataFrame:
    return tokens.where(F.col("token").isin(*ids)).select("file", "pos", "token")


def count_sequence(tokens: DataFrame, pattern: list[int]) -> DataFrame:
    """(file, n): left-to-right matches of a tag of several ids that do not overlap.

    A match is found by joining shifted positions; hits are few. Hits nearer than the pattern's length to the hit before
    form a run, numbered in blocks. Where the pattern cannot overlap itself every hit counts. Else the hits of a run are
    equally far apart if the pattern has one period, and arithmetic counts them; runs of mixed distances are folded.
    """
    m = len(pattern)
    hits = tokens.where(F.col("token") == pattern[0]).select("file", "pos")
    for k, t in enumerate(pattern[1:], 1):
        hits = hits.join(tokens.where(F.col("token") == t).select("file", (F.col("pos") - k).alias("pos")), ["file", "pos"])
    periods = [p for p in range(1, m) if pattern[p:] == pattern[: m - p]]
    if not periods:
        return hits.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    hits = cut(hits)
    # A hit continues a run if there is one fewer than m places before it.
    near = hits.select("file", F.explode(F.array(*[(F.col("pos") + p).alias("p") for p in periods])).alias("pos")).distinct().withColumn("near", F.lit(True))
    marked = hits.join(near, ["file", "pos"], "left")
    runs = running_total(marked, "file", "pos", F.col("near").isNull().cast("long"), "before").withColumn("run", F.col("before") + F.col("near").isNull().cast("long"))
    ends = runs.groupBy("file", "run").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count(F.lit(1)).alias("hits"))
    step = periods[0]
    even = (F.col("last") - F.col("first")) == (F.col("hits") - 1) * step if all(p % step == 0 for p in periods) else F.col("hits") == 1
    stride = -(-m // step)  # hits from one counted to the next
    counted = ends.where(even).select("file", F.ceil(F.col("hits") / stride).cast("long").alias("n"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-(1 << 60)).cast("long").alias("last"))
    taken = F.aggregate("at", start, lambda acc, p: F.when(p - acc["last"] >= m, F.struct((acc["n"] + 1).alias("n"), p.alias("last"))).otherwise(acc), lambda acc: acc["n"])
    odd = runs.join(ends.where(~even).select("file", "run"), ["file", "run"]).groupBy("file", "run").agg(F.array_sort(F.collect_list("pos")).alias("at")).select("file", taken.alias("n"))
    return counted.unionByName(odd).groupBy("file").agg(F.sum("n").alias("n"))


# ---- segments -------------------------------------------------------------------------------------


def segments(tokens: DataFrame, translate: Iterable[int], markers: Iterable[int], eos: int = EOS, tags: Iterable[int] | None = None) -> DataFrame:
    """One row per opening tag: file, t, e (first end after it, null if none), markers inside, other openings inside, first tag inside.

    Only tag and end rows enter the windows; those run in blocks (see ``sequence``).
    """
    translate, markers, tags = list(translate), list(markers), list(tags or [])
    few = tokens.where(F.col("token").isin(eos, *translate, *markers, *tags)).select("file", "pos", "token")
    is_in = lambda ids: F.col("token").isin(*ids) if ids else F.lit(False)
    openings = {"m0": is_in(markers).cast("long"), "t0": is_in(translate).cast("long")}
    next_ones = {"e": F.when(F.col("token") == eos, F.col("pos")), "tag": F.when(is_in(tags), F.col("pos"))}
    rows = cut(scan(few, "file", "pos", openings, next_ones))  # tag rows only; read twice below
    ends = rows.where(F.col("token") == eos).select("file", F.col("pos").alias("e"), F.col("m0").alias("m1"), F.col("t0").alias("t1"))
    opens = rows.where(is_in(translate)).withColumn("own", is_in(markers).cast("long"))
    joined = opens.join(ends, ["file", "e"], "left")
    return joined.select(
        "file", F.col("pos").alias("t"), "e",
        (F.col("m1") - F.col("m0") - F.col("own")).alias("markers"), (F.col("t1") - F.col("t0") - 1).alias("nested"),
        F.when(F.col("tag") < F.col("e"), F.col("tag")).alias("tag"),
    )


def judged_segments(found: DataFrame, keep: int, full: bool = True) -> DataFrame:
    """Adds ``verdict``: unterminated, empty_source, empty_target, untouched, kept or deleted, and ``rank`` of the qualifying ones.

    Qualifying segments are numbered over all files by (file, t), in blocks.
    """
    empty_source, empty_target = F.lit(full) & (F.col("tag") == F.col("t") + 1), F.lit(full) & (F.col("e") == F.col("tag") + 1)
    kind = (
        F.when(F.col("e").isNull(), "unterminated").when(empty_source, "empty_source").when(empty_target, "empty_target").when(F.col("markers") > 0, "qualifying").otherwise("untouched")
    )
    rows = running_total(found.withColumn("kind", kind), "file", "t", (F.col("kind") == "qualifying").cast("long"), "__in_file")
    per_file = rows.groupBy("file").agg(F.sum((F.col("kind") == "qualifying").cast("long")).alias("__q"))
    before = per_file.select(F.col("file"), F.coalesce(F.sum("__q").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # a row per file
    rows = rows.join(before, "file").withColumn("rank", F.when(F.col("kind") == "qualifying", F.col("__before") + F.col("__in_file") + 1))
    verdict = F.when(F.col("kind") == "qualifying", F.when(F.col("rank") <= keep, "kept").otherwise("deleted")).otherwise(F.col("kind"))
    return cut(rows.withColumn("verdict", verdict).drop("kind", "__in_file", "__before"))


def delete_ranges(judged: DataFrame) -> DataFrame:
    """(file, start, end, merged): inclusive ranges to delete, touching ones merged; ``merged`` counts what was folded in."""
    doomed = judged.where(F.col("verdict").isin("empty_source", "empty_target", "deleted")).select("file", F.col("t").alias("start"), F.col("e").alias("end"))
    order = Window.partitionBy("file").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = doomed.withColumn("new", F.coalesce((F.col("start") > reach + 1).cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(order))
    return islands.groupBy("file", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.count(F.lit(1)) - 1).alias("merged")).drop("island")


def keep_spans(ranges: DataFrame, lengths: DataFrame) -> DataFrame:
    """(file, start, stop, new_start): half-open spans that the inclusive delete ranges leave, none of them empty, and where they go.

    lengths: (file, length)."""
    order = Window.partitionBy("file").orderBy("start")
    ends = ranges.select("file", "start", "end").unionByName(lengths.select("file", F.col("length").alias("start"), F.col("length").alias("end")))
    spans = ends.select("file", F.coalesce(F.lag("end").over(order) + 1, F.lit(0)).alias("from"), F.col("start").alias("stop")).where("from < stop")
    gone = F.sum(F.col("stop") - F.col("from")).over(Window.partitionBy("file").orderBy("from").rowsBetween(Window.unboundedPreceding, -1))
    return spans.select("file", F.col("from").alias("start"), "stop", F.coalesce(gone, F.lit(0)).alias("new_start"))


def rewrite(rows: DataFrame, spans: DataFrame, block: int = 4096) -> DataFrame:
    """(file, new_pos, token) of placed rows cut to their spans.

    A row meets spans by blocks of positions, in the first block that both touch; the tokens themselves
    are sliced out of their row and never shuffled on their own, and no window runs over them.
    """
    at = lambda x: F.floor(x / block)
    last = F.col("start") + F.size("ids") - 1
    pieces = rows.where(F.size("ids") > 0).select("file", F.col("start").alias("a"), (last + 1).alias("z"), "ids", F.explode(F.sequence(at(F.col("start")), at(last))).alias("b"))
    wanted = spans.select(F.col("file").alias("f"), "start", "stop", "new_start", F.explode(F.sequence(at(F.col("start")), at(F.col("stop") - 1))).alias("c"))
    once = F.col("b") == at(F.greatest("a", "start"))
    met = pieces.join(wanted, (F.col("file") == F.col("f")) & (F.col("b") == F.col("c"))).where((F.col("start") < F.col("z")) & (F.col("stop") > F.col("a")) & once)
    low, high = F.greatest("a", "start"), F.least("z", "stop")
    kept = met.select("file", (F.col("new_start") + low - F.col("start")).alias("to"), F.slice("ids", (low - F.col("a") + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int")).alias("ids"))
    return kept.select("file", "to", F.posexplode("ids").alias("i", "token")).select("file", (F.col("to") + F.col("i")).alias("new_pos"), "token")


def segment_stats(judged: DataFrame, ranges: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row of counts; lengths: (file, length)."""
    n = lambda *v: F.sum(F.col("verdict").isin(*v).cast("long"))
    counts = judged.agg(
        F.count(F.lit(1)).alias("segments"), n("kept", "deleted").alias("qualifying"), n("kept").alias("kept"), n("deleted").alias("deleted"), n("empty_source").alias("empty_source"),
        n("empty_target").alias("empty_target"), n("unterminated").alias("trailing_unterminated"), n("untouched").alias("untouched"),
    )
    totals = ranges.agg(F.count(F.lit(1)).alias("ranges"), F.coalesce(F.sum("merged"), F.lit(0)).alias("merged"), F.coalesce(F.sum(F.col("end") - F.col("start") + 1), F.lit(0)).alias("deleted_tokens"))
    whole = lengths.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("input_tokens"))
    return counts.crossJoin(totals).crossJoin(whole).withColumn("output_tokens", F.col("input_tokens") - F.col("deleted_tokens"))  # one row each
