"""Operators without SQL, and edges that the tables do not have: brute force and round trips."""

from __future__ import annotations

import html
import json
import random
import re
import unicodedata
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import json_schema as J
from corpusmill.operators import chunks, metrics, neardup, reports, runs
from corpusmill.operators import corpus as C
from corpusmill.operators import tokens as K
from corpusmill.plans import chat as chat_plans
from corpusmill.sources import files
from corpusmill.streaming import ingest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


# ---- near dedup -----------------------------------------------------------------------------------


def test_near_dedup_keeps_null_rows_and_equals_all_pairs(spark):
    r = random.Random(1)
    base = [" ".join(r.choice(WORDS) for _ in range(30)) for _ in range(12)]
    rows = [(None, None, "x"), (None, None, "x"), ("", "a", "x"), (None, "a", "x"), (base[0], None, "x"), (base[0] + " end", None, "x"), ("!", "a", "x"), ("?", "a", "x")]
    for b in base:
        rows += [(b, "a", "x"), (b.upper(), "a", "x"), (b + ".", "a", "x"), (b.replace(" ", ", ", 2), "b", "x"), (b + " mu", "a", "x"), (" ".join(b.split()[2:]), "a", "x")]
    rows = [(i, *x) for i, x in enumerate(rows)]
    df = spark.createDataFrame(rows, "id long, text string, cell string, `a.b` string").repartition(3)
    prepared = neardup.prepared(df, F.col("cell"), "id", F.col("text"))
    links = neardup.pairs(neardup.unique(prepared), 0.6)
    got = {x.id: x.status for x in neardup.status(prepared, links).collect()}

    def shingles(t):
        w = re.findall(r"\w+", (t or "").lower())
        return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    seen, kept, expected, first = {}, [], {}, []
    for i, t, c, _ in rows:
        if (c, (t or "").lower()) in seen:
            expected[i] = "dup_exact"
            continue
        seen[c, (t or "").lower()] = i
        first.append((i, c, shingles(t)))
    near = {(a[0], b[0]) for a, b in combinations(first, 2) if a[1] == b[1] and a[2] and b[2] and len(a[2] & b[2]) / len(a[2] | b[2]) >= 0.6}
    for i, _, _ in first:
        dropped = any((k, i) in near for k in kept)
        expected[i] = "dup_near" if dropped else "kept"
        kept += [] if dropped else [i]
    assert got == expected
    assert {(x.a, x.b) for x in links.collect()} == near


# ---- text -----------------------------------------------------------------------------------------


def plain_chunks(text, most):
    def greedy(parts, joiner):
        done, held, n = [], None, 0
        for p in parts:
            if held is not None and n + len(p.split()) <= most:
                held, n = held + joiner + p, n + len(p.split())
            else:
                done += [] if held is None else [held]
                held, n = p, len(p.split())
        return done + ([] if held is None else [held])

    pieces = []
    for p in filter(None, (p.strip() for p in re.split(r"\n\s*\n+", text.strip()))):
        w = p.split()
        if len(w) <= most:
            pieces.append(p)
        elif len(sentences := re.split(r"(?<=[.!?])\s+", p)) <= 1:
            pieces += [" ".join(w[k : k + most]) for k in range(0, len(w), most)]
        else:
            pieces += greedy(sentences, " ")
    return greedy(pieces, "\n")


def test_chunks_equal_plain_loops(spark):
    r = random.Random(2)
    texts = ["", "  ", "one", " ".join(["w"] * 50)]
    for _ in range(60):
        texts.append("".join(r.choice(WORDS) + r.choice([" ", " ", " ", ". ", "! ", "\n", "\n\n", "\n \n\n"]) for _ in range(r.randrange(90))))
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", chunks.chunk_text(F.col("t"), 12).alias("c")).collect()
    assert {x.i: x.c for x in rows} == {i: plain_chunks(t, 12) for i, t in enumerate(texts)}


def test_clean_text_equals_plain_python(spark, tmp_path):
    pages = [(1, "<p>ﬁne №5 &amp; more</p>"), (2, "a​b <br/>x=1; y: «z»"), (3, None), (4, "Ａ　Ｂ ① é à ọ́ ｅ́"), (5, "")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {x.page_id: x.text for x in chat_plans.R.queries["clean_text"](spark, str(tmp_path)).collect()}
    for i, t in pages:
        bare = html.unescape(re.sub("<[^>]*>", " ", unicodedata.normalize("NFKC", t or ""))).replace("​", "")
        assert got[i] == "".join(c for c in bare if c.isalnum() or c in "_ \t\n\r\f\v,.!?;:-" or "À" <= c <= "ɏ" or "Ḁ" <= c <= "ỿ")


def test_split_ranks_the_boundary_only(spark):
    rows = [(i, "big" if i % 4 else "mid") for i in range(4000)] + [(9000 + i, "tiny") for i in range(50)] + [(9900, None)]
    got = C.split(spark.createDataFrame(rows, "doc_id long, lang string"), "lang", "doc_id").collect()
    copied = C.split(spark.createDataFrame(rows, "doc_id long, lang string"), "lang", "doc_id", tiny="copy")
    assert Counter((x.lang, x.split) for x in copied.where("lang = 'tiny' or lang is null").collect()) == {("tiny", "train"): 50, ("tiny", "val"): 50, (None, "train"): 1, (None, "val"): 1}
    assert Counter((x.lang, x.split) for x in got) == {("big", "val"): 300, ("big", "train"): 2700, ("mid", "val"): 100, ("mid", "train"): 900, ("tiny", "train"): 50, (None, "train"): 1}


# ---- schemas --------------------------------------------------------------------------------------


def plain_problems(v, schema, at="$"):
    kinds = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list}
    k = schema.get("type")
    if k and (not isinstance(v, kinds[k]) or (isinstance(v, bool) and k in ("integer", "number"))):
        return [f"{at}: type {k} expected"]
    found = [f"{at}: not in enum"] * ("enum" in schema and v not in schema["enum"])
    if k == "object":
        found += [f"{at}: {x} missing" for x in schema.get("required", []) if x not in v]
        for x, s in schema.get("properties", {}).items():
            found += plain_problems(v[x], s, f"{at}.{x}") if x in v else []
    if k == "array":
        found += [p for i, x in enumerate(v) for p in plain_problems(x, schema.get("items", {}), f"{at}[{i}]")]
    return found


def test_schema_checks_equal_plain_loops(spark):
    schema = {
        "type": "object", "required": ["a", "it's"],
        "properties": {"a": {"type": "integer"}, "b": {"type": "array", "items": {"type": "object", "required": ["x"], "properties": {"x": {"type": "number"}, "y": {"type": "string", "enum": ["u", "v"]}}}}, "it's": {"type": "boolean"}, "free": {}},
    }
    r = random.Random(4)
    scalars = [1, -5, 2.5, "u", "q", True, None, 10**22, [], {}, [1], {"x": 1}]

    def member():
        return {k: r.choice([*scalars, "v"]) for k in ("x", "y", "z") if r.random() < 0.8}

    values = [{k: v for k, v in {"a": r.choice(scalars), "b": r.choice([[member() for _ in range(3)], [], [1], "no"]), "it's": r.choice(scalars), "free": r.choice(scalars)}.items() if r.random() < 0.85} for _ in range(200)]
    values += scalars
    rows = [(i, json.dumps(v)) for i, v in enumerate(values)] + [(1000, "{"), (1001, None), (1002, "")]
    got = {x.i: x.p for x in spark.createDataFrame(rows, "i int, t string").select("i", J.json_problems(F.col("t"), schema).alias("p")).collect()}
    assert got == {i: "; ".join(plain_problems(v, schema)) for i, v in enumerate(values)} | {k: "invalid JSON" for k in (1000, 1001, 1002)}


def test_strict_schemas_and_samples():
    raw = {"type": "object", "$defs": {"T": {"type": "object", "properties": {"n": {"type": "integer", "default": 2}}}}, "properties": {"t": {"$ref": "#/$defs/T"}, "l": {"type": "array", "minItems": 3, "items": {"$ref": "#/$defs/T"}}, "o": {"anyOf": [{"type": "null"}, {"type": "string"}]}}, "required": ["t"]}
    made = J.strict(raw)
    inner = {"type": "object", "properties": {"n": {"type": "integer"}}, "required": ["n"], "additionalProperties": False}
    assert made == {"type": "object", "properties": {"t": inner, "l": {"type": "array", "minItems": 3, "items": inner}, "o": {"anyOf": [{"type": "null"}, {"type": "string"}]}}, "required": ["t", "l", "o"], "additionalProperties": False}
    assert raw["required"] == ["t"] and "default" in raw["$defs"]["T"]["properties"]["n"]
    assert J.sample_value(made) == {"t": {"n": 3}, "l": [{"n": 3}] * 3, "o": "mock o sample"}
    assert J.sample_value({"enum": ["x", "y"]}) == "x" and J.sample_value({"type": ["null", "number"]}) == 3.5
    for short in [*J.FORMS.values(), *J.TOOLS.values()]:
        assert plain_problems(J.sample_value(J.schema_of(short)), J.strict(J.schema_of(short))) == []


# ---- metrics, runs --------------------------------------------------------------------------------


def test_worst_layers_keep_the_whole(spark):
    rows = spark.createDataFrame([(k, 1.0 + k / 50, 1.0) for k in range(30)], "layer int, v double, r double")
    got = metrics.worst_layers(metrics.relative_l2(rows, "layer", F.col("v"), F.col("r"))).collect()
    assert [x.layer for x in got] == [*range(29, 19, -1), None] and got[0].flagged and not got[-1].flagged


def test_published_and_resumed(spark):
    losses = [3.6, 3.5, 7.5, 3.7, 3.2, 2.7, 2.9, 2.9]
    got = runs.published(spark.createDataFrame([("r", i, x) for i, x in enumerate(losses)], "run string, step long, loss double"), "run", "step", "loss")
    assert [x.push for x in got.orderBy("step").collect()] == [True, True, False, True, False, False, False, False]
    assert runs.published(got.select("run", "step", "loss").limit(0), "run", "step", "loss").count() == 0


def test_hash_of_window_bytes(spark):
    import hashlib
    import struct

    ids = [0, 1, 255, 256, 65535, 4660]
    got = spark.createDataFrame([(ids,)], "ids array<int>").select(runs.bytes_hash(F.col("ids"))).first()[0]
    assert got == hashlib.sha256(struct.pack("<6H", *ids)).hexdigest()[:16]


# ---- files, reports, configurations ---------------------------------------------------------------


def test_text_corpus_and_registry(spark, tmp_path):
    for name, text in {"a.txt": "# Title one\nbody", "sub/b.MD": "\n\n  \nfirst\nx", "c.csv": "no", "d.txt": "\n", "e.txt": ""}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    corpus = files.text_corpus(spark, str(tmp_path))
    assert {(r.doc_id, r.title) for r in corpus.collect()} == {("a", "Title one"), ("b", "first"), ("d", "d")}
    samples = spark.createDataFrame([("p", "s", "t", "x")], "path string, doc_id string, title string, text string")
    assert reports.registry([samples, corpus]).count() == 4
    with pytest.raises(Exception, match="doc_id occurs twice: a"):
        reports.registry([samples.withColumn("doc_id", F.lit("a")), corpus]).collect()


def test_json_lines_ledgers_and_listing(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n{oops\n')
    assert sorted(r.a for r in files.json_lines(spark, [str(tmp_path / "x.jsonl")], "a int").collect()) == [1, 2]
    with pytest.raises(Exception, match="(?i)malformed|failfast"):
        files.json_lines(spark, [str(tmp_path / "bad.jsonl")], "a int").collect()
    files.append_ledger(spark, str(tmp_path / "ledger"), [("d", "1.parquet")])
    files.append_ledger(spark, str(tmp_path / "ledger"), [("d", "2.parquet")])
    listing = spark.createDataFrame([("d", f"{k}.parquet") for k in range(4)] + [("d", "x.txt"), ("e", "1.parquet")], "dataset string, file string")
    assert sorted(map(tuple, files.pending_files(listing, spark.read.parquet(str(tmp_path / "ledger"))).collect())) == [("d", "0.parquet"), ("d", "3.parquet"), ("e", "1.parquet")]
    names = spark.createDataFrame([(f"in/{n}",) for n in ("rag__part2.jsonl", "rag.jsonl", "ragged.jsonl", "rag__part10.jsonl", "qa.jsonl")], "path string")
    assert [r.name for r in files.task_files(names, "rag").collect()] == ["rag.jsonl", "rag__part10.jsonl", "rag__part2.jsonl"]
    files.write_csv(listing, str(tmp_path / "csv"))
    files.write_json_lines(listing, str(tmp_path / "json"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == spark.read.json(str(tmp_path / "json")).count() == 6


def test_reports_metrics_and_manifests(spark, tmp_path):
    cells = spark.createDataFrame([("qa", "yor", 3, 2), ("qa", "eng", 4, 4), ("ner", "eng", 1, 0)], "task string, language string, generated long, kept long")
    found = reports.report(cells, spark.createDataFrame([("w1",), ("w2",)], "w string"))
    assert found["totals"] == {"generated": 8, "kept": 6, "warnings": 2} and [(c["task"], c["language"]) for c in found["cells"]] == [("ner", "eng"), ("qa", "eng"), ("qa", "yor")]
    reports.write_report(spark, f"{tmp_path}/r.json", found)
    assert json.loads(reports.read_text(spark, f"{tmp_path}/r.json")) == found
    reports.write_metrics(spark, f"{tmp_path}/m.txt", {"f1": 0.5, "n": 3})
    assert (tmp_path / "m.txt").read_text() == "f1: 0.5\nn: 3\n"
    for k in range(2):
        reports.append_manifest(spark, f"{tmp_path}/jobs.jsonl", {"job": k})
    assert [json.loads(x) for x in (tmp_path / "jobs.jsonl").read_text().splitlines()] == [{"job": 0}, {"job": 1}]
    (tmp_path / "gone").mkdir()
    (tmp_path / "gone/a.bin").write_bytes(b"123")
    assert {r.bytes for r in reports.listing(spark, f"{tmp_path}/gone").collect()} == {3}
    assert [k.rsplit("/", 1)[1] for k in reports.delete_below(spark, f"{tmp_path}/gone")] == ["a.bin"] and reports.delete_below(spark, f"{tmp_path}/gone") == []


def test_tables_side_by_side_and_batches(spark):
    a = spark.createDataFrame([(i, i * i) for i in range(20)], "i long, x long")
    b = spark.createDataFrame([(i, str(i)) for i in range(20)], "i long, y string")
    assert {tuple(r) for r in reports.zipped(a, b, "i").collect()} == {(i, i * i, str(i)) for i in range(20)}
    with pytest.raises(Exception, match="differ in length"):
        reports.zipped(a, b.where("i < 19"), "i").collect()
    assert [len(x) for x in reports.batches(b, "y", 8)] == [8, 8, 4]
    assert reports.without_text(a.withColumns({"text": F.lit(""), "data": F.lit("")}), "sft").columns == ["i", "x"] and "data" in reports.without_text(a.withColumn("data", F.lit("")), "pretrain").columns
    cut = spark.createDataFrame([("a|end_of_text|b|end_of_text|",), ("none",), ("|end_of_text|x",)], "t string").select(reports.before_marker(F.col("t")))
    assert [r[0] for r in cut.collect()] == ["a", "none", ""]


def test_settings_are_merged(spark):
    found = reports.settings([{"train": [{"batch": "5 * 8", "lr": 0.1}, None, {"steps": "1_000"}]}, {"seed": 3}], whole=("batch", "steps"))
    assert found == {"train": {"batch": 40, "lr": 0.1, "steps": 1000}, "seed": 3}
    assert reports.whole_number(2.0) == 2 and reports.whole_number("2*3*4") == 24
    for bad in (None, True):
        with pytest.raises(ValueError, match="whole number"):
            reports.whole_number(bad)


def test_a_tokenizer_can_be_passed(spark):
    rows = spark.createDataFrame([(1, "a bb"), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r.ids for r in K.encoded(rows, "text", lambda: lambda texts: [[len(w) + 10 for w in t.split()] for t in texts], closing=2).collect()}
    assert got == {1: [11, 12, 0, 0], 2: [0, 0], 3: [0, 0]}


def test_a_stream_goes_on_where_it_ended(spark, tmp_path):
    write = lambda ids: spark.createDataFrame([(i, f"t{i % 7}") for i in ids], "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    schema = "doc_id long, text string"
    for k, ids in enumerate([range(10), range(10, 30), []]):
        if ids:
            write(ids)
        stream = ingest.source(spark, f"{tmp_path}/in", schema)
        ingest.run_ledger(stream.withColumn("file", F.col("_metadata.file_name")), f"{tmp_path}/log")
        ingest.run_dedup(ingest.source(spark, f"{tmp_path}/in", schema), f"{tmp_path}/dedup")
        ingest.run_append(ingest.source(spark, f"{tmp_path}/in", schema), f"{tmp_path}/append")
        ingest.run_counts(ingest.source(spark, f"{tmp_path}/in", schema), ["text"], f"{tmp_path}/counts")
        assert ingest.restarts(spark, f"{tmp_path}/log") == k
    assert spark.read.parquet(f"{tmp_path}/log/out").count() == spark.read.parquet(f"{tmp_path}/append/out").count() == 30
    assert sorted(r.rows for r in spark.read.parquet(f"{tmp_path}/log/ledger").collect()) == [10, 20]
    assert sorted(r.text for r in spark.read.parquet(f"{tmp_path}/dedup/out").collect()) == [f"t{k}" for k in range(7)]
    assert sum(r.samples for r in spark.read.parquet(f"{tmp_path}/counts/out").collect()) == 30
