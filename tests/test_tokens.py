"""Token streams against plain loops over random streams: segments, masks, windows, counts, rewriting and the token files."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import masks as M
from corpusmill.operators import sequence
from corpusmill.operators import tokens as K
from corpusmill.sources.token_bin import TokenBin

OPEN, MARK, OTHER, END = 11, 12, 13, 0


def table(spark, files):
    return spark.createDataFrame([(f, i, t) for f, ids in files.items() for i, t in enumerate(ids)], "file string, pos long, token int").repartition(3)


def random_files(seed, n=4, size=150):
    r = random.Random(seed)
    return {f"f{k}": [r.choice([OPEN, MARK, OTHER, END, END, 1, 2, 3, 4, 5]) for _ in range(r.randrange(1, size))] for k in range(n)}


def plain_cleaning(files, keep, full):
    """Verdicts, merged ranges and what is left, position by position."""
    verdicts, ranges, left, kept = {}, {}, {}, 0
    for f, ids in sorted(files.items()):
        doomed = []
        for t, token in enumerate(ids):
            if token != OPEN:
                continue
            e = next((k for k in range(t + 1, len(ids)) if ids[k] == END), None)
            tag = next((k for k in range(t + 1, e or 0) if ids[k] in (MARK, OTHER)), None)
            if e is None:
                verdict = "unterminated"
            elif full and tag == t + 1:
                verdict = "empty_source"
            elif full and tag is not None and e == tag + 1:
                verdict = "empty_target"
            elif MARK in ids[t + 1 : e]:
                kept += 1
                verdict = "kept" if kept <= keep else "deleted"
            else:
                verdict = "untouched"
            verdicts[f, t] = verdict
            if verdict in ("empty_source", "empty_target", "deleted"):
                doomed.append((t, e))
        gone = {k for t, e in doomed for k in range(t, e + 1)}
        ranges[f] = []
        for t, e in doomed:
            if ranges[f] and t <= ranges[f][-1][1] + 1:
                ranges[f][-1] = (ranges[f][-1][0], max(e, ranges[f][-1][1]), ranges[f][-1][2] + 1)
            else:
                ranges[f].append((t, e, 0))
        left[f] = [x for k, x in enumerate(ids) if k not in gone]
    return verdicts, ranges, left


@pytest.mark.parametrize("keep", [0, 3, 1000])
@pytest.mark.parametrize("full", [True, False])
def test_cleaning_equals_plain_loops(spark, keep, full):
    files = random_files(keep + full) | {"z": [OPEN, MARK, END, OPEN, 1, OTHER, END, OPEN, OPEN, MARK, 1, END, OPEN, 7]}
    tokens = table(spark, files)
    judged = K.judged_segments(K.segments(tokens, [OPEN], [MARK], END, [MARK, OTHER]), keep, full)
    ranges = K.delete_ranges(judged)
    verdicts, merged, left = plain_cleaning(files, keep, full)
    assert {(r.file, r.t): r.verdict for r in judged.collect()} == verdicts
    assert Counter((r.file, r.start, r.end, r.merged) for r in ranges.collect()) == Counter((f, *x) for f, xs in merged.items() for x in xs)
    lengths = tokens.groupBy("file").agg((F.max("pos") + 1).alias("length"))
    spans = K.keep_spans(ranges, lengths)
    for block in (7, 4096):
        out = defaultdict(dict)
        for r in K.rewrite(K.blocks(tokens, 16), spans, block).collect():
            out[r.file][r.new_pos] = r.token
        assert {f: [out[f][k] for k in range(len(out[f]))] for f in files} == left
    stats = K.segment_stats(judged, ranges, lengths).first().asDict()
    assert (stats["input_tokens"], stats["output_tokens"]) == (sum(map(len, files.values())), sum(map(len, left.values())))
    assert stats["segments"] == len(verdicts) and all(stats[v] == list(verdicts.values()).count(v) for v in ("kept", "deleted", "empty_source", "empty_target", "untouched"))
    assert stats["deleted_tokens"] == sum(len(files[f]) - len(left[f]) for f in files)


def test_segments_do_not_depend_on_blocks(spark, monkeypatch):
    tokens = table(spark, random_files(9))
    run = lambda: Counter(map(tuple, K.segments(tokens, [OPEN], [MARK], END, [MARK, OTHER]).collect()))
    first = run()
    monkeypatch.setattr(sequence.scan, "__defaults__", (None, None, 16, 1))
    monkeypatch.setattr(sequence.running_total, "__defaults__", (16, 1))
    assert run() == first


@pytest.mark.parametrize(("reach", "block", "levels"), [(10_000, 64, 1), (1 << 62, 64, 3), (300, 8, 2)])
def test_totals_and_next_values_equal_plain_loops(spark, reach, block, levels):
    r = random.Random(3)
    rows = [(k, p, r.randrange(5)) for k in "ab" for p in {r.randrange(reach) for _ in range(200)}]
    df = spark.createDataFrame(rows, "k string, p long, v int")
    got = sequence.scan(df, "k", "p", {"before": F.col("v")}, {"next": F.when(F.col("v") == 4, F.col("p"))}, block, levels).collect()
    for x in got:
        mine = [(p, v) for k, p, v in rows if k == x.k]
        assert x.before == sum(v for p, v in mine if p < x.p) and x.next == min((p for p, v in mine if p > x.p and v == 4), default=None)


def test_chat_mask_equals_plain_loops(spark):
    r, files = random.Random(5), {}
    for k in range(40):
        head = [r.choice([7, 8, 9]) for _ in range(r.randrange(3))]
        marks = [[1] * (r.random() < 0.5), [2] * (r.random() < 0.8), [3] * (r.random() < 0.7)]
        files[f"f{k}"] = [*head, *[x for m in marks for x in [*m, *[r.choice([7, 8, 9]) for _ in range(r.randrange(4))]]]] or [7]
    for system in (1, None):
        got = defaultdict(dict)
        for x in M.mask_chat(table(spark, files), "file", system, 2, 3).collect():
            got[x.file][x.pos] = x.label
        for f, ids in files.items():
            start = ids.index(system) if system in ids else ids.index(2) if 2 in ids else 0
            stop = ids.index(3) + 1 if 3 in ids else len(ids) if start else 0
            assert [got[f][k] for k in range(len(ids))] == [M.MASK if start <= k < stop else t for k, t in enumerate(ids)], (system, ids)


def test_pair_mask_equals_plain_loops(spark):
    files = {f: [{OPEN: 21, MARK: 22}.get(t, t) for t in ids] for f, ids in random_files(12, 6, 60).items()}
    tokens = K.document_number(table(spark, files))
    masked = M.mask_pretrain(tokens, F.col("token").isin(21, 22), F.col("token") == 21)
    got = {(x.file, x.pos): x.label for x in masked.collect()}
    for f, ids in files.items():
        expected, at = [], 0
        while at < len(ids):
            stop = ids.index(END, at) + 1 if END in ids[at:] else len(ids)
            doc = ids[at:stop]
            tags = [k for k, t in enumerate(doc) if t in (21, 22)]
            hidden = set()
            if tags and doc[tags[0]] == 21:
                hidden |= set(range(tags.pop(0) + 1))
            while tags:
                first = tags.pop(0)
                hidden |= set(range(first, (tags.pop(0) if tags else len(doc) - 1) + 1))
            expected += [M.MASK if k in hidden else t for k, t in enumerate(doc)]
            at = stop
        assert [got[f, k] for k in range(len(ids))] == expected
    runs = Counter((x.file, x.start, x.end) for x in M.runs(masked).collect())
    plain = Counter()
    for f, ids in files.items():
        hit = [k for k in range(len(ids)) if got[f, k] == M.MASK]
        for k in hit:
            if k - 1 not in hit:
                plain[f, k, next(e for e in range(k, len(ids) + 1) if e + 1 not in hit)] += 1
    assert runs == plain


def test_documents_and_their_masks(spark):
    files = random_files(31, 3, 40)
    tokens = K.document_number(table(spark, files))
    assert all(x.doc_seq == files[x.file][: x.pos].count(END) for x in tokens.collect())
    pairs = {(x.file, x.i, x.j) for x in K.causal_pairs(tokens).collect()}
    assert pairs == {(f, i, j) for f, ids in files.items() for i in range(len(ids)) for j in range(i + 1) if END not in ids[j:i]}


@pytest.mark.parametrize("pattern", [[1, 1], [1, 1, 1], [1, 2], [1, 2, 1], [1, 1, 2, 1, 1], [2]])
def test_tag_sequences_count_without_overlap(spark, pattern):
    r = random.Random(len(pattern))
    files = {f"f{k}": [r.choice([1, 1, 1, 2]) for _ in range(120)] for k in range(3)} | {"g": [1] * 50 + [2, 1, 1] * 9, "h": [3]}
    expected = {}
    for f, ids in files.items():
        at = n = 0
        while at < len(ids):
            if ids[at : at + len(pattern)] == pattern:
                n, at = n + 1, at + len(pattern)
            else:
                at += 1
        if n:
            expected[f] = n
    assert {x.file: x.n for x in K.count_sequence(table(spark, files), pattern).collect()} == expected


def test_windows_pair_each_token_with_the_next(spark):
    files = {"a": list(range(100, 160)), "b": list(range(30))}
    starts = spark.createDataFrame([("a", 3), ("a", 40), ("b", 0)], "file string, start long")
    got = {(x.file, x.start, x.pos): (x.x, x.y) for x in K.windows(table(spark, files), starts, 16).collect()}
    assert got == {(f, s, p): (files[f][p], files[f][p + 1]) for f, s in [("a", 3), ("a", 40), ("b", 0)] for p in range(s, s + 16)}


def test_offsets_take_sparse_orders_and_null_files(spark):
    rows = [("a", 10**12, [1, 2]), ("a", 5, [3]), ("a", 10**15, []), ("a", 7 * 10**15, [4, 5, 6]), (None, 1, [7]), (None, 9, [8])]
    got = {(x.file, x.doc_id): x.start for x in K.placed(spark.createDataFrame(rows, "file string, doc_id long, ids array<int>")).collect()}
    assert got == {("a", 5): 0, ("a", 10**12): 1, ("a", 10**15): 3, ("a", 7 * 10**15): 3, (None, 1): 0, (None, 9): 1}


@pytest.mark.parametrize("flat", ["false", "true"])
def test_token_file_round_trip(spark, tmp_path, flat):
    spark.dataSource.register(TokenBin)
    path = str(tmp_path / "x.bin")
    ids = [i * 37 % 65536 for i in range(5000)]
    for k in range(2):
        rows = spark.createDataFrame([(path, i, t) for i, t in enumerate(ids)], "file string, pos long, token int")
        rows.repartitionByRange(3, "pos").sortWithinPartitions("pos").write.format("token_bin").option("path", path).option("flat", flat).mode("append").save()
    load = lambda: spark.read.format("token_bin").option("path", path).option("range_tokens", "700").load().orderBy("pos").collect()
    got = load()
    assert [r.token for r in got] == ids * 2 and [r.pos for r in got] == list(range(10_000)) and {r.file for r in got} == {path}
    for bad in ([(path, 0, 70_000)], [(path, 5, 1), (path, 4, 1)]):
        with pytest.raises(Exception, match="65535|sorted"):
            spark.createDataFrame(bad, "file string, pos long, token int").coalesce(1).write.format("token_bin").option("path", path).option("flat", flat).mode("append").save()
    assert len(load()) == 10_000


def test_cleaning_a_token_file_into_another(spark, tmp_path):
    """From a file through segments and spans to the sink, and read back."""
    spark.dataSource.register(TokenBin)
    ids = random_files(77, 1, 4000)["f0"]
    old, new = str(tmp_path / "old.bin"), str(tmp_path / "new.bin")
    rows = spark.createDataFrame([(old, i, t) for i, t in enumerate(ids)], "file string, pos long, token int")
    rows.repartitionByRange(2, "pos").sortWithinPartitions("pos").write.format("token_bin").option("path", old).mode("append").save()
    tokens = spark.read.format("token_bin").option("path", old).option("range_tokens", "100").load()
    ranges = K.delete_ranges(K.judged_segments(K.segments(tokens, [OPEN], [MARK], END, [MARK, OTHER]), 2))
    spans = K.keep_spans(ranges, tokens.groupBy("file").agg((F.max("pos") + 1).alias("length")))
    out = K.rewrite(K.blocks(tokens, 64), spans).select("file", F.col("new_pos").alias("pos"), "token")
    out.repartitionByRange(3, "pos").sortWithinPartitions("pos").write.format("token_bin").option("path", new).mode("append").save()
    got = [r.token for r in spark.read.format("token_bin").option("path", new).load().orderBy("pos").collect()]
    assert got == plain_cleaning({"f": ids}, 2, True)[2]["f"]
