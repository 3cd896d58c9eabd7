"""Queries on small tables of which a prefix, an id subset or the most frequent words would not do."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import bpe
from corpusmill.functions.text import words
from corpusmill.plans import corpus, streams

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def tables(spark, tmp_path):
    def write(rows):
        spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return write


def test_causal_mask_of_whole_documents(spark, tables):
    sizes = {1: 40, 2: 3, 20: 60, 21: 0}
    got = {(r.file, r.i): r.first for r in streams.R.queries["doc_causal_pairs"](spark, tables([(i, "w " * n, "ab"[i % 2]) for i, n in sizes.items()])).collect()}
    expected = {}
    for file in "ab":
        start = 0
        for i, n in sizes.items():
            if "ab"[i % 2] == file:
                expected |= {(file, start + k): start for k in range(n + 1)}
                start += n + 1
    assert got == expected


def test_tiny_sets_are_counted_over_the_whole_table(spark, tables):
    rows = [(i, "t", "large" if i % 30 else "grows") for i in range(1800)] + [(5000 + i, "t", "late") for i in range(50)]
    got = {(r.doc_id, r.source, r.split) for r in corpus.R.queries["split_tiny"](spark, tables(rows)).collect()}
    assert got == {(5000 + i, "late", k) for i in range(50) for k in ("train", "val")}


def test_merges_count_rare_words_too(spark):
    """3,000 rare words share a pair that the 2,500 more frequent ones lack."""
    r = random.Random(4)
    found = Counter({"".join(r.choice("abcdefgh") for _ in range(7)): 2 for _ in range(2500)} | {"zq" + "".join(r.choice("abcdefgh") for _ in range(6)): 1 for _ in range(3000)} | {"aaaaa": 3})
    df = spark.createDataFrame([(" ".join(found.elements()),)], "text string")
    got = bpe.merges(bpe.word_counts(df, words(F.col("text"))), 12)
    spelled, expected = [(list(w), n) for w, n in found.items()], []
    for _ in range(12):
        pairs = Counter()
        for s, n in spelled:
            for p in zip(s, s[1:], strict=False):
                pairs[p] += n
        (a, b), n = min(pairs.items(), key=lambda x: (-x[1], x[0]))
        expected.append((a, b, n))
        for s, _ in spelled:
            i = 0
            while i < len(s) - 1:
                if (s[i], s[i + 1]) == (a, b):
                    s[i : i + 2] = [a + b]
                i += 1
    assert got == expected and ("z", "q") == got[0][:2]


def test_texts_are_read_to_their_end(spark, tables):
    at = tables([(0, "   a normal text", "s"), (1, " \n ", "s"), (5, "word " * 20 + "about football", "s"), (11, "l0\nl1\nl2\nl3\nl4", "s"), (17, "a b c d e f g h i j k a", "s"), (23, "", "s")])
    got = lambda name, column: {r.doc_id: r[column] for r in corpus.R.queries[name](spark, at).collect()}
    assert got("min_length", "too_short") == {0: False, 1: True, 5: False, 11: False, 17: False, 23: True}
    topics = got("assign_topic", "topic")
    assert topics[5] == "sports" and topics[11] == "unknown"
    assert got("numbered_block", "block")[11].endswith("\n\n[chunk 4]\nl4")
    sets = {r.doc_id: tuple(r)[1:] for r in corpus.R.queries["array_sets"](spark, at).collect()}
    assert sets[17] == ("a,b,c,d,e,f,g,h,i,j,k", "a,b,c,d,e,f,g,h", 5, False) and sets[23] == ("", "", 0, True)
