"""The ten operators and the pipeline on small awkward tables, against brute force or an exact round trip."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import groupby

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from corpusmill.llm import exact_dedup, language_id, mixing, packing, quality_classifier, quality_rules, simhash, substring_dedup, warc
from corpusmill.llm.components import components
from corpusmill.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, norm string, digest string, fp long, kept boolean"
random.seed(7)
VOCAB = ["".join(random.choice("etaoinshrdlu") for _ in range(random.randint(2, 8))) for _ in range(400)]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) + r.choice(["", "", "", ".", ","]) for _ in range(n))


LONG = prose(99, 6000)
TEXTS = [
    prose(1, 80), prose(1, 80).upper(), prose(2, 120), prose(2, 120) + " more", None, "", " \n\t", "A", "a", "É", "é", "word " * 200, prose(3, 60), prose(3, 60), LONG,
    "line\n" * 30 + prose(4, 60), "x9Q" * 5000, prose(5, 49), prose(5, 50), "один два три " * 20, "a b", "a b c", "#$% & <|> **",
]


def rows():
    found = [(i, t, ["en", "de", None][i % 3], ["hot", "hot", "b", None][i % 4], None, "clash", "clash", 1, False) for i, t in enumerate(TEXTS)]
    return [*found, found[2], found[4], (None, "no id " * 30, "en", "b", 1, "", "", 0, True)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return lowered(t).encode().split()


# ---- 1 ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(docs, keep, weak):
    digest = (lambda t: F.lit(b"same")) if weak else exact_dedup.content_hash  # every text collides
    got = exact_dedup.duplicate_groups(docs, keep=keep, digest=digest).collect()
    groups = defaultdict(list)
    for r in rows():
        groups[lowered(r[1])].append(r[0])
    assert len(got) == len(rows())
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = Counter()
    for r in got:
        ids = [i for i in by_sha[r.text_sha256] if i is not None]
        assert r.keep_id == ((max if keep == "largest" else min)(ids) if ids else None) and r.group_size == len(by_sha[r.text_sha256])
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}


def test_exact_dedup_keeps_whole_rows(docs, empty):
    got = exact_dedup.drop_duplicates(docs)
    assert got.columns == docs.columns and Counter(lowered(r.text) for r in got.collect()) == Counter({lowered(t[1]) for t in rows()})
    assert exact_dedup.drop_duplicates(empty).count() == 0 and exact_dedup.duplicate_groups(empty).count() == 0


# ---- 2 ------------------------------------------------------------------------------------------


def test_bundling_is_the_sum_of_bound_trigrams():
    s = language_id.Space(64, 3)
    trigrams, counts = s.trigrams("Ab, ba")
    expected = np.zeros(64)
    for a, b, c in [(0, 1, 2), (1, 2, 0), (0, 2, 1), (2, 1, 0)]:
        expected += np.roll(s.letters[a], 2) * np.roll(s.letters[b], 1) * s.letters[c]
    assert counts.sum() == 4 and np.allclose(s.bundle(trigrams, counts), expected)


def test_language_id(spark, empty):
    r = random.Random(1)
    syllables = {"aa": ["tion", "the", "ing"], "bb": ["que", "eau", "oix"], "cc": ["ung", "sch", "keit"]}
    data = [(i, " ".join("".join(r.choice(syllables[k]) for _ in range(2)) for _ in range(30)), k) for i, k in enumerate(r.choice(list(syllables)) for _ in range(200))]
    data += [(900, None, "aa"), (901, "123 !", "bb"), (902, "tionthe", None)]
    got = {x.doc_id: x for x in language_id.identify(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert all(got[i].lang_pred == k for i, _, k in data[:200] if got[i].held_out)
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[902].lang_pred == "aa" and all(0 <= x.score <= 1 for x in got.values())
    assert language_id.identify(empty).count() == 0


# ---- 3 ------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    big = "<p>é</p>" * 300
    pages = [(1, "http://a\r\nX: y", big), (2, None, big), (5, "u", big), (3, "u", "small"), (4, "u", "small"), (6, "u", None), (5, "u", big), (None, "u", "z" * 2000)]
    df = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, digest string").repartition(2)
    index = warc.write_archives(df, f"file://{tmp_path}/w", file_bytes=300)
    got = warc.read_records(index, f"file://{tmp_path}/w", gap=10, run=400).collect()
    assert Counter(r.page_id for r in got) == Counter(p[0] for p in pages)
    for r in got:
        raw = next((p[2] or "") for p in pages if p[0] == r.page_id).encode()
        revisit = r.page_id in (1, 2)
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", 5 if revisit else None)
        assert r.payload == (None if revisit else raw)
    some = warc.read_records(index.where("page_id = 3"), f"file://{tmp_path}/w").collect()
    assert [r.payload for r in some] == [b"small"]
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_null_ids_revisit_the_largest(spark):
    big, other = "b" * 1500, "o" * 1500
    pages = [(None, "u", big), (7, "u", big), (3, "u", big), (None, "u", other), (None, "v", other), (9, "u", "small"), (None, "u", "small")]
    got = warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got) == Counter(
        [(None, 1500, "revisit", 7), (7, 1500, "response", None), (3, 1500, "revisit", 7), *[(None, 1500, "response", None)] * 2, (9, 5, "response", None), (None, 5, "response", None)]
    )


def test_byte_runs_merge_neighbours():
    assert [(f, s, e, len(r)) for f, s, e, r in warc.byte_runs(iter([("a", 0, 5), ("a", 5, 5), ("a", 30, 5), ("b", 0, 5)]), 10, 100)] == [("a", 0, 10, 2), ("a", 30, 35, 1), ("b", 0, 5, 1)]


# ---- 4 ------------------------------------------------------------------------------------------


def test_mixing_paths_agree_and_reach_their_weights(spark, docs, empty):
    data = [(i, "x" * 10, "hot" if i % 3 else "cold") for i in range(6000)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mixing.mix(df, {"hot": 1.0, "cold": 3.0}).groupBy("source").count().collect()
    share = {r["source"]: r["count"] / 6000 for r in got}
    assert share["hot"] == pytest.approx(0.25, abs=0.03) and share["cold"] == pytest.approx(0.75, abs=0.05)
    for table in (df, docs):
        a = mixing.mix(table, {"hot": 2.0}).select("doc_id", "source", "copy", "shuffle_key").collect()
        b = mixing.mix(table, {"hot": 2.0}, broadcast_sources=0).select("doc_id", "source", "copy", "shuffle_key").collect()
        assert Counter(map(tuple, a)) == Counter(map(tuple, b))
    assert mixing.mix(empty, {}).count() == 0
    clash = df.withColumn("copy", F.lit("mine")).withColumn("repetitions", F.lit(-1))
    assert {(r["copy"], r["repetitions"]) for r in mixing.mix(clash, {}, added=False).select(F.col("copy"), "repetitions").collect()} == {("mine", -1)}
    assert mixing.mix(clash, {}).columns == ["doc_id", "text", "source", "repetitions", "copy", "shuffle_key"]


def test_poisson_distribution():
    for rate in (0.01, 1.0, 7.5, 390.0, 900.0, 1e6):
        first, d = mixing.distribution(rate)
        mean = first + sum(1 - p for p in d)
        assert mean == pytest.approx(rate, rel=1e-6) and d[-1] == pytest.approx(1.0) and len(d) < 40 * rate**0.5 + 60
    assert mixing.distribution(0.0) == (0, [1.0])


def test_mixing_repeats_a_tiny_source_often(spark):
    """One letter against 20,000 texts: a rate of about a million, on both paths."""
    df = spark.createDataFrame([(i, "x" * 50, "hot") for i in range(20_000)] + [(-1, "y", "tiny")], "doc_id long, text string, source string")
    for most in (100_000, 0):
        got = mixing.mix(df, {}, epochs=0.2, broadcast_sources=most).where("source = 'tiny'").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("copy").alias("copies"), F.max("copy").alias("last"), F.first("repetitions").alias("r")).first()
        assert got.n == got.copies == got.last == got.r == pytest.approx(100_000, rel=0.02)


def test_mixing_counts_invert_the_distribution(spark):
    u = [k / 997 for k in range(997)]
    for rate in (0.3, 4.0, 700.0):
        first, d = mixing.distribution(rate)
        table = spark.createDataFrame([(x, (first, d)) for x in u], "u double, p struct<first: long, cdf: array<double>>")
        assert [r.n for r in table.select(mixing.drawn(F.col("p"), F.col("u")).alias("n")).collect()] == [first + sum(c <= x for c in d) for x in u]


# ---- 5 ------------------------------------------------------------------------------------------


def test_substring_dedup_finds_passages_and_leaves_the_rest(spark, docs, empty):
    passage, short = prose(50, 60), prose(51, 18)
    texts = [prose(100 + i, 150 + i) for i in range(60)]
    for i in (3, 17, 40):
        texts[i] = texts[i][:300].rsplit(" ", 1)[0] + " " + passage + "\n" + prose(500 + i, 30)
    for i in (5, 8, 9):
        texts[i] += " " + short
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = substring_dedup.repeated_spans(df)
    got = {(r.doc_id, r.kept_doc_id) for r in spans.collect()}
    assert got == {(17, 3), (40, 3)}
    left = {r.doc_id: r.text for r in substring_dedup.remove_spans(df, spans).collect()}
    assert left[3] == texts[3] and all(len(words(left[i])) < len(words(texts[i])) - 20 for i in (17, 40))
    assert {r.doc_id for r in substring_dedup.repeated_spans(docs).collect()} == {1, 3, 13, 18}
    assert substring_dedup.repeated_spans(empty).count() == 0


def test_spans_leave_rows_they_cannot_name(spark):
    """Nulls, repeated ids, and columns named like the operator's own."""
    passage = prose(60, 80)
    data = [(1, prose(61, 50) + " " + passage), (2, prose(62, 50) + " " + passage), (None, passage), (3, None), (4, passage), (4, prose(63, 90) + " " + passage)]
    df = spark.createDataFrame([(i, t, "mine", [1], "x") for i, t in data], "doc_id long, text string, __id string, cuts array<int>, `a.b` string")
    spans = substring_dedup.repeated_spans(df)
    assert {r.doc_id for r in spans.collect()} == {2, 4}
    got = substring_dedup.remove_spans(df, spans)
    assert got.columns == df.columns
    left = Counter((r.doc_id, r.text) for r in got.collect() if r.doc_id != 2)
    assert left == Counter(x for x in data if x[0] != 2)
    cut = next(r.text for r in got.collect() if r.doc_id == 2)
    assert data[1][1].startswith(cut[:200]) and len(words(cut)) < 50 + 30


def test_chunks_cover_texts_and_resist_shifts():
    a = words(prose(1, 500))
    owner, start, n, digest = substring_dedup.chunk([a, [], [b"new", *a], [b"w"] * 1000])
    for k, size in enumerate((500, 0, 501, 1000)):
        assert n[owner == k].sum() == size and (start[owner == k] == np.concatenate([[0], np.cumsum(n[owner == k])[:-1]])[: (owner == k).sum()]).all()
    assert len(set(digest[owner == 0]) & set(digest[owner == 2])) >= (owner == 0).sum() - 2 and n.max() <= substring_dedup.MOST


# ---- 6, 7 ---------------------------------------------------------------------------------------


def test_quality_counts(docs, empty):
    import re

    got = quality_rules.measure(docs).collect()
    assert len(got) == len(rows())
    by_id = {r[0]: r[1] or "" for r in rows()}
    for r in got:
        t = by_id[r.doc_id]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        times = Counter(windows)
        repeated = {j for i, x in enumerate(windows) if times[x] > 1 for j in range(i, i + 3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated))
        assert r.base_failed == (len(w) < 50 or 100 * len(repeated) > 50 * len(w)) and not (r.base_failed and r.kept)
    kept = {r.doc_id for r in got if r.kept}
    assert not {11, 16, 17} & kept
    good = quality_rules.keep_good(docs)
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == kept and quality_rules.keep_good(empty).count() == 0


def test_quality_classifier(spark, docs, empty):
    good = [(i, prose(i, 60 + i % 50)) for i in range(300)]
    bad = [(1000 + i, (prose(i, 60).upper().replace(" ", "!! ") if i % 2 else prose(i, 60).replace(" ", "### "))) for i in range(60)]
    got = quality_classifier.classify(spark.createDataFrame(good + bad, "doc_id long, text string")).collect()
    right = [r.kept == (r.doc_id < 1000) for r in got]
    assert np.mean(right) > 0.97 and all(r.kept for r in got if r.doc_id < 1000)
    assert quality_classifier.classify(docs).count() == len(rows()) and quality_classifier.classify(empty).count() == 0


# ---- 9 ------------------------------------------------------------------------------------------


def brute_fingerprint(t):
    w = words(t)
    k = min(3, len(w))
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(len(w) - k + 1)] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((r[0], f"{brute_fingerprint(r[1]):016x}") for r in rows())
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and simhash.near_duplicates(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0
    ids = Counter(r.doc_id for r in kept.collect())
    assert set(ids.values()) == {1} and ids.keys() - {None} == {r.component_id for r in got} - {None}


def test_near_dedup_tells_rows_of_one_id_apart(spark):
    a, b, c = prose(31, 90), prose(32, 90), prose(33, 90)
    data = [(1, a), (5, b), (5, a), (5, c), (5, c.upper()), (7, b), (None, a)]
    got = [(r.doc_id, r.text.lower()) for r in simhash.drop_near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()]
    assert Counter(got) == Counter([(1, a.lower()), (5, b.lower()), (5, c.lower()), (None, a.lower())])


@pytest.mark.parametrize("tile", [3, 1024])
def test_links_against_all_pairs(spark, tile):
    r = random.Random(5)
    fps = {r.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1}
    for f in list(fps)[:25]:
        for _ in range(8):
            f ^= 1 << r.randrange(64)
            fps.add(f)
    fps = np.array(sorted(fps), np.uint64)
    links = simhash.near_links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"), 2, tile)
    got = {x.node: x.component for x in components(links).collect()}
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    reach = near.copy()
    for _ in range(8):
        reach = (reach.astype(np.int32) @ reach.astype(np.int32)) > 0
    signed = fps.view(np.int64)
    for i in range(len(fps)):
        smallest = int(signed[reach[i]].min())
        assert got.get(int(signed[i]), int(signed[i])) == smallest


# ---- 10 -----------------------------------------------------------------------------------------


def test_best_fit_equals_a_plain_search():
    for seed in range(20):
        r = random.Random(seed)
        lengths = [r.randint(1, 50) for _ in range(200)]
        at, offset, made = packing.best_fit(lengths, 50)
        rooms = []
        for n in sorted(lengths, reverse=True):
            fits = [(room, i) for i, room in enumerate(rooms) if room >= n]
            if fits:
                rooms[min(fits)[1]] -= n
            else:
                rooms.append(50 - n)
        used = Counter()
        for n, w in zip(lengths, at, strict=True):
            used[w] += n
        assert made == len(rooms) and sorted(50 - u for u in used.values()) == sorted(rooms)


def test_packing_round_trip(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    got = packing.pack(docs, tokenizer_path(), block_tokens=3000).collect()
    pieces, windows = defaultdict(list), defaultdict(list)
    for p in got:
        assert len(p.ids) == 4 * p.length <= 4 * 2048
        windows[p.sequence_id].append((p.offset, p.length))
        pieces[p.doc_id, p.doc_tokens].append((p.start, p.ids))
    for spans in windows.values():
        ends = 0
        for start, length in sorted(spans):
            assert start == ends
            ends += length
        assert ends <= 2048
    expected = Counter()
    for r in rows():
        ids = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        for s in range(0, len(ids), 8192):
            expected[r[0], s // 4, ids[s : s + 8192]] += 1
    assert Counter((d, s, bytes(b)) for (d, _), ps in pieces.items() for s, b in ps) == expected
    digest = packing.with_digest(packing.pack(docs, tokenizer_path())).first()
    assert digest.ids_crc32 >= 0 and packing.pack(empty, tokenizer_path()).count() == 0


def test_word_tokenizer_equals_the_whole_tokenizer():
    from tokenizers import Tokenizer

    t, mine, r = Tokenizer.from_file(tokenizer_path()), packing.WordTokenizer(tokenizer_path()), random.Random(2)
    letters = [chr(c) for c in [*range(0x20, 0x180), 0x300, 0x301, 0x30C, 0x3A3, 0x130, 0x2019, 0x4E2D, 0x2028]]
    for text in ["don't 'S<|endoftext|>", "", *("".join(r.choice(letters) for _ in range(50)) for _ in range(300))]:
        assert mine.encode(text) == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_any_other_tokenizer_encodes_whole_texts(docs, tmp_path):
    import json

    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    assert packing.word_by_word(tokenizer_path()) and not packing.word_by_word(path)
    expected = Counter((r[0], len(t.encode(r[1] or "", add_special_tokens=False).ids) + 1, zlib.crc32(np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4").tobytes())) for r in rows())
    got = packing.with_digest(packing.pack(docs, path, size=1 << 20)).collect()
    assert Counter((p.doc_id, p.doc_tokens, p.ids_crc32) for p in got) == expected
    changed = json.load(open(tokenizer_path()))
    changed["normalizer"]["normalizers"].pop()  # no longer lower-cases
    own = tmp_path / "cased.json"
    own.write_text(json.dumps(changed))
    cased = Tokenizer.from_file(str(own))
    text = "Don't SHOUT, Anna"
    assert packing.WordTokenizer(str(own)).encode(text) == np.array(cased.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


# ---- pipeline -----------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    data = [(i, prose(i // 2, 90 + i // 2 % 40) if i % 10 == 0 else prose(i, 90 + i % 40), "en", f"src{i % 4}", 1) for i in range(80)] + [(90, None, None, None, None), (91, "word " * 300, "en", "src0", 2)]
    documents = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    docs, before = documents, {r.doc_id for r in documents.collect()}
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        ids = [r.doc_id for r in docs.collect()]
        assert docs.columns == documents.columns and len(ids) == len(set(ids)) and set(ids) <= before, name
        before = set(ids)
    texts = {r.text for r in docs.collect()}
    assert texts == {t for _, t, *_ in data[:80]}  # clean documents stay, one of each text
    mixed = corpus_pipeline.mixed(spark, docs, str(tmp_path))
    assert mixed.columns == documents.columns and {r.doc_id for r in mixed.collect()} <= before
    total = sum(len(packing.WordTokenizer(tokenizer_path()).encode(r.text)) // 4 + 1 for r in mixed.collect())
    assert corpus_pipeline.run(spark, str(tmp_path)).agg(F.sum("length")).first()[0] == total


def test_pipeline_stages_take_awkward_tables(spark):
    """Nulls in every column, empty and very long texts, repeated rows, clashing names; and an empty table."""
    data = [(i, t, None if i % 3 else "en", None if i % 4 else "src0", None) for i, t in enumerate(TEXTS)]
    data += [(i, prose(200 + i, 400), "en", "src1", 1) for i in range(100, 140)] + [data[0], (None, prose(300, 200), None, None, None), (200, prose(301, 120_000), "en", "src2", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    wide = schema + ", kept boolean, `a.b` string, fp long, digest string, copy int, repetitions int, __id long, id long, mark long, row string"
    full = spark.createDataFrame([(*r, None, "x", 1, None, 5, 6, 7, 8, 9, "row") for r in data], wide).repartition(3)
    for docs in (full, full.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "/nowhere")
            if name == "packing":
                assert out.count() >= docs.count()
            else:
                assert out.columns == docs.columns, name
                n, ids = docs.count(), {r.doc_id for r in docs.select("doc_id").collect()}
                kept = out.collect()
                assert {r.doc_id for r in kept} <= ids and (name == "mixing" or len(kept) <= n), name
                assert all(r["a.b"] == "x" and r["copy"] == 5 for r in kept)
                if n and name == "quality_rules":
                    assert {200, *range(100, 140)} <= {r.doc_id for r in kept}
                docs = spark.createDataFrame(kept, docs.schema) if kept else docs.limit(0)


def test_pipeline_equals_brute_force(spark, tmp_path):
    """The rows of run() from plain loops over the operators' own decisions, stage by stage."""
    from corpusmill.llm.queries import MIX_WEIGHTS

    clean = [(i, prose(400 + i // 3 if i % 9 == 0 else 900 + i, 150 + i % 60), "en", f"src{i % 4}", 1) for i in range(90)]
    near = [(200 + i, clean[i][1].replace(" ", "  ", 1) + (" tail" if i % 2 else ""), "en", "src1", 1) for i in range(0, 20, 2)]
    bad = [(300 + i, "same words again " * 40, "en", "src2", 1) for i in range(5)] + [(400, None, None, None, None)]
    data = clean + near + bad
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(data, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    judged = {r.doc_id: r.kept for r in quality_rules.measure(spark.createDataFrame(data, schema)).collect()}
    rows_ = [r for r in data if judged[r[0]]]
    seen, exact = set(), []
    for r in sorted(rows_):
        if lowered(r[1]) not in seen:
            seen.add(lowered(r[1]))
            exact.append(r)
    fps = [brute_fingerprint(r[1]) for r in exact]
    group = list(range(len(exact)))
    for _ in exact:
        group = [min(group[b] for b in range(len(exact)) if bin(fps[a] ^ fps[b]).count("1") <= 2) for a in range(len(exact))]
    alone = [r for a, r in enumerate(exact) if group[a] == a]
    size = Counter()
    for r in alone:
        size[r[3]] += len(r[1])
    weight = {s: MIX_WEIGHTS.get(s, 1.0) for s in size}
    expected = Counter()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    for i, text, _, s, _ in alone:
        first, d = mixing.distribution(sum(size.values()) * weight[s] / sum(weight.values()) / size[s])
        u = int(hashlib.md5(f"42:{i}".encode()).hexdigest()[:13], 16) / (1 << 52)
        ids = [*t.encode(text, add_special_tokens=False).ids, 1]
        for a in range(0, len(ids), 2048):
            piece = ids[a : a + 2048]
            expected[i, a, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()), len(ids)] += first + sum(c <= u for c in d)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == +expected
    for _, pieces in groupby(sorted((r.sequence_id, r.offset, r.length) for r in got), key=lambda x: x[0]):
        end = 0
        for _, offset, length in pieces:
            assert offset == end
            end += length
        assert end <= 2048


def test_language_id_takes_awkward_tables(spark):
    """Repeated rows, null ids, very long texts, extra columns."""
    r = random.Random(2)
    syllables = {"aa": ["tion", "the", "ing"], "bb": ["que", "eau", "oix"]}
    data = [(i, " ".join("".join(r.choice(syllables[k]) for _ in range(2)) for _ in range(12)), k) for i, k in enumerate(r.choice(list(syllables)) for _ in range(40))]
    data += [(900, None, "aa"), (901, "", "bb"), (902, "tionthe " * 20_000, None), data[0], (None, "queeau oix", "bb"), (903, "12 34", "aa"), (904, "ÉÀ the", None)]
    df = spark.createDataFrame([(i, t, k, 1.0, "x") for i, t, k in data], "doc_id long, text string, lang string, score double, `a.b` string").repartition(3)
    got = Counter((x.doc_id, x.held_out, x.lang_pred, round(x.score, 5)) for x in language_id.identify(df).collect())
    assert sum(got.values()) == len(data)
    out = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 0
    assert Counter(x[:2] for x in got.elements()) == Counter((i, out(i)) for i, *_ in data)
    for i, t, k in data:
        pred = {p for d, _, p, _ in got if d == i}
        assert pred == ({"und"} if not any(c.isalpha() for c in t or "") else {k} if k and out(i) else pred) and pred <= {"und", "aa", "bb"}
    assert {p for d, _, p, _ in got if d == 902} == {"aa"}


def test_classifier_takes_awkward_tables(spark, docs):
    """A third of all rows are copies with one id; the sample counts them once, and every row has its verdict."""
    data = [(i, prose(i, 60)) for i in range(200)] + [(1000 + i, prose(i, 60).upper().replace(" ", "!! ")) for i in range(60)] + [(5000, prose(7, 80))] * 130 + [(6000, prose(8, 20_000)), (None, None)]
    df = spark.createDataFrame([(i, t, False, "x") for i, t in data], "doc_id long, text string, kept boolean, `a.b` string").repartition(3)
    for features in (20_000_000, 20_000, 0):
        got = quality_classifier.classify(df, sample_features=features).collect()
        assert Counter(r.doc_id for r in got) == Counter(i for i, _ in data) and len({r.score for r in got if r.doc_id == 5000}) == 1
        if features:
            assert np.mean([r.kept == (r.doc_id < 1000 or r.doc_id > 2000) for r in got if r.doc_id is not None]) > 0.95
    assert Counter(r.doc_id for r in quality_classifier.classify(docs).collect()) == Counter(r[0] for r in rows())
