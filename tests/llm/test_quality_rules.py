"""Compression bands: the limits' fit, and verdicts against plain loops."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
import zstandard

from corpusmill.llm import quality_rules
from corpusmill.llm.quality_rules import Rules

SCHEMA = "doc_id long, text string, kept boolean, packed int, `a.b` string"
_r = random.Random(7)
VOCAB = ["".join(_r.choice("etaoinshrdlucmfw") for _ in range(_r.randint(2, 9))) for _ in range(3000)]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(VOCAB[int(len(VOCAB) * r.random() ** 2)] + r.choice(["", "", "", ".", ","]) for _ in range(n))


def encoded(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(20)) for _ in range(n // 21))


def listing(seed, n):
    return " | ".join(random.Random(seed).choice(VOCAB[:40]) for _ in range(n))


CLEAN = {i: prose(i, 60 + 7 * (i % 300)) for i in range(900)}
LENGTHS = (400, 900, 2500, 7000, 20_000)
ODD = {2000 + 10 * k + s: t for k, n in enumerate(LENGTHS) for s, t in enumerate((encoded(k, max(1100, n)), listing(k, n // 7)))}


def frame(spark, texts):
    return spark.createDataFrame([(i, t, True, 1, "x") for i, t in texts], SCHEMA).repartition(3)


def test_bands_reject_on_both_sides_at_every_length(spark):
    got = {r.doc_id: r for r in quality_rules.measure(frame(spark, [*CLEAN.items(), *ODD.items()])).collect()}
    assert not any(got[i].base_failed for i in [*CLEAN, *ODD] if i < 2000 or i % 10 == 0)
    assert [i for i in ODD if got[i].kept] == []
    assert np.mean([got[i].kept for i in CLEAN]) > 0.99


def test_verdicts_equal_plain_loops(spark):
    rules = Rules(chunk_bytes=700, max_bad=0.2)
    half = {3000: prose(5000, 400) + " " + encoded(1, 3000), 3001: prose(5001, 300) + " " + listing(3, 150) + " " + prose(5002, 300), 3002: encoded(9, 900) + prose(5003, 700)}
    texts = [*CLEAN.items(), *ODD.items(), *half.items(), (5, CLEAN[5]), (None, CLEAN[6]), (4000, None), (4001, ""), (4002, "w " * 49), (4003, prose(3, 60_000))]
    df = frame(spark, texts)
    pack = lambda raw: len(zstandard.ZstdCompressor(level=3).compress(raw))
    seen, base = Counter(), {}
    for i, t in texts:
        raw, w = (t or "").encode(), (t or "").split()
        windows = Counter(zip(w, w[1:], w[2:], strict=False))
        repeated = {k for j, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if windows[x] > 1 for k in (j, j + 1, j + 2)}
        base[i] = len(w) >= 50 and 2 * len(repeated) <= len(w)
        if base[i]:
            seen[int(np.floor(np.log2(len(raw)) * 4)), round(1000 * pack(raw) / len(raw))] += 1
    limits = quality_rules.fit_limits([(*k, n) for k, n in seen.items()], rules)
    expected = Counter()
    for i, t in texts:
        raw, starts = (t or "").encode(), []
        while starts[-1:] != [len(raw)] and sum(starts[-1:]) < len(raw):
            at = starts[-1] if starts else 0
            end = at + 700 if len(raw) - at - 700 >= 175 else len(raw)
            starts.append(end)
        cuts = [raw[a:b] for a, b in zip([0, *starts], starts, strict=False)]
        out = lambda x: bool(abs(limits.score(np.array([len(x)]), np.array([pack(x)]))[0] - 0.75) > 4.25)  # noqa: E731  -3.5 to 5
        bad = [c for c in cuts if out(c)]
        expected[i, bool(base[i] and not out(raw) and sum(map(len, bad)) <= 0.2 * len(raw)), len(cuts), len(bad)] += 1
    assert Counter((r.doc_id, r.kept, r.n_chunks, r.n_bad_chunks) for r in quality_rules.measure(df, rules=rules).collect()) == expected
    good = quality_rules.keep_good(df, rules=rules)
    assert good.columns == df.columns
    assert Counter(r.doc_id for r in good.collect()) == Counter(i for (i, kept, *_), n in expected.items() for _ in range(n) if kept)
    assert {i for i, kept, *_ in expected if not kept and i} >= {*ODD, *half} - {3001} and 4003 in {i for i, kept, *_ in expected if kept}


def test_a_third_of_copies_leaves_the_limits_in_place(spark):
    copies = [(10_000 + i, listing(77, 300)) for i in range(450)]
    got = {r.doc_id: r.kept for r in quality_rules.measure(frame(spark, [*CLEAN.items(), *copies])).collect()}
    assert np.mean([got[i] for i in CLEAN]) > 0.99 and not any(got[i] for i, _ in copies)


def test_limits_without_texts_are_those_of_prose(spark):
    rules = Rules()
    limits = quality_rules.fit_limits([], rules)
    assert limits.normal == pytest.approx(rules.prose) and limits.spread == pytest.approx(rules.spread)
    assert quality_rules.measure(frame(spark, [(1, None)]).limit(0)).count() == 0
    assert quality_rules.keep_good(frame(spark, [(1, None)]).limit(0)).count() == 0
    assert [(r.n_words, r.base_failed, r.kept, r.zstd_ratio > 0) for r in quality_rules.measure(frame(spark, [(1, None)])).collect()] == [(0, True, False, True)]


def test_chunks_cover_the_text():
    for n in range(0, 3000, 7):
        sizes = quality_rules.chunk_sizes(n, 100)
        assert sum(sizes) == n and all(s >= 25 for s in sizes[1:]) and all(s < 125 for s in sizes)
