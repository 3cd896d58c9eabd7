"""Corpus functions on rows that the tables lack, near dedup against brute force, chat rules, and every query against SQL."""

from __future__ import annotations

import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusmill import plans
from corpusmill.functions import schedules, text
from corpusmill.operators import chat, corpus, neardup
from corpusmill.operators.chunks import chunk_text
from corpusmill.streaming import ingest

SMALL = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_text_functions(spark):
    lit = F.lit
    assert one(spark, text.strip_spaces(lit("   a b  \n"))) == "a b"
    assert one(spark, text.shingles(lit("A b c"))) == ["a b c"]
    assert one(spark, text.shingles(lit("!!"))) == []
    assert one(spark, text.extract_answer(lit("abcDef"))) == "abc"
    assert one(spark, text.assign_topic(lit("health and football"))) == "sports"
    assert one(spark, text.last_word(lit("  "))) is None
    assert one(spark, text.tag_name(lit("<zzz>"))) is None


def test_splits_and_registry(spark):
    df = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("a").alias("g"))
    assert corpus.split(df, "g", "doc_id").where("split = 'val'").count() == 20
    sizes = [one(spark, corpus.test_size(F.lit(n))) for n in (50, 51, 80_000, 800_000, 3_500_000, 4_000_000)]
    assert sizes == [0, 5, 8000, 8000, 8750, 2000]


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.8])
def test_near_dedup_is_greedy(spark, threshold):
    random.seed(4)
    texts = []
    for _ in range(12):
        words = [random.choice("abcdefgh") for _ in range(14)]
        for _ in range(5):
            words = list(words)
            words[random.randrange(14)] = random.choice("abcdefgh")
            texts.append(" ".join(words))
    texts += [texts[3].upper(), "", "!"]
    rows = [(i, f"c{i % 2}", t) for i, t in enumerate(texts)]
    prepared = neardup.prepared(spark.createDataFrame(rows, "id long, cell string, text string"), F.col("cell"), "id", F.col("text"))
    got = {r.id: r.status for r in neardup.status(prepared, neardup.pairs(neardup.unique(prepared), threshold)).collect()}
    expected, seen, kept = {}, {}, {}
    for i, cell, t in rows:
        w = re.findall(r"\w+", t.lower())
        sh = {" ".join(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)} - {""}
        if (cell, t.lower()) in seen:
            expected[i] = "dup_exact"
            continue
        seen[cell, t.lower()] = i
        near = any(sh and o and len(sh & o) / len(sh | o) >= threshold for o in kept.get(cell, []))
        expected[i] = "dup_near" if near else "kept"
        if not near:
            kept.setdefault(cell, []).append(sh)
    assert got == expected


def test_greedy_chain(spark):
    links = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    assert {r.id: r.kept for r in neardup.resolve(links).collect()} == {1: True, 2: False, 3: True}


def test_chunks(spark):
    assert one(spark, chunk_text(F.lit(" a b\n\nc d e\n\n\nf "), 3)) == ["a b", "c d e", "f"]
    assert one(spark, chunk_text(F.lit("one two. three four. five"), 4)) == ["one two. three four.", "five"]
    assert one(spark, chunk_text(F.lit("a b c d e"), 2)) == ["a b", "c d", "e"]
    assert one(spark, chunk_text(F.lit("  "), 2)) == []


def test_chat_rendering_and_tool_messages(spark):
    messages = F.array(chat.message("system", F.lit("s")), chat.message("assistant", calls=[(F.lit("f"), F.lit("{}"))]), chat.message("tool", F.lit("r"), "f"), chat.message("assistant", F.lit("done")))
    expected = "<s>\n<|system|>s</s>\n\n\n<|assistant|>\n\n<tool_call>f\n{}</tool_call></s>\n<tool_result>f r</tool_result></s>\n\n\n<|assistant|>\n\ndone</s>\n\n"
    assert one(spark, chat.render(messages)) == expected
    assert one(spark, F.forall(messages, chat.message_ok)) is True
    assert one(spark, chat.message_ok(chat.message("assistant"))) is False


def test_sampling_weights(spark):
    at = lambda step, scheduled=True: one(spark, schedules.sampling_weight(0.8, 0.2, F.lit(step), 1000, scheduled))
    assert [round(at(s), 6) for s in (0, 1000, 5000)] == [0.8, 0.2, 0.2] and at(500, False) == 0.8
    assert one(spark, schedules.sampling_weight(0.0, 0.0, F.lit(3), 10, True)) == 0.5


def test_stream_dedup_restarts(spark, tmp_path):
    schema = "doc_id long, text string"
    for k, rows in enumerate([[(1, "a"), (2, "b ")], [(3, " b"), (4, "c")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in{k}")
    both = spark.read.parquet(f"{tmp_path}/in0", f"{tmp_path}/in1")
    for k in range(2):
        spark.read.parquet(f"{tmp_path}/in{k}").write.mode("append").parquet(f"{tmp_path}/in")
        ingest.run_dedup(ingest.source(spark, f"{tmp_path}/in", both.schema), f"{tmp_path}/to")
    assert {r.text.strip() for r in spark.read.parquet(f"{tmp_path}/to/out").collect()} == {"a", "b", "c"}
    assert spark.read.parquet(f"{tmp_path}/to/out").count() == 3


QUICK = ["dedup_exact", "lang_prompt", "dist_sets", "split_assign", "pack_offsets", "seg_pair", "mask_sft", "near_dup_pairs", "chat_render", "response_triage", "chunk_counts", "moe_aux", "rel_l2", "cls_metrics"]


def plain(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.skipif(not Path(SMALL).exists(), reason="needs the generated tables")
@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    import duckdb

    queries, sql = {}, {}
    for r in plans.registries():
        queries |= r.queries
        sql |= r.sql
    connection = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        connection.execute(f"create view {p.stem} as select * from '{p}'")
    result = connection.execute(sql[name])
    names = [d[0] for d in result.description]
    df = queries[name](spark, SMALL)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(map(plain, r)) for r in df.select(*names).collect()) == sorted(tuple(map(plain, r)) for r in result.fetchall())
