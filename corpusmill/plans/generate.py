"""Queries for deterministic draws, request building, runs and copies. Draws are hashes of their key, so a row's draw never depends on its place."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from corpusmill.functions import json_schema as J
from corpusmill.functions.text import numbered_block
from corpusmill.operators import languages
from corpusmill.operators import requests as Q
from corpusmill.operators import runs as U
from corpusmill.operators import tokens as K
from corpusmill.plans import streams
from corpusmill.plans.base import Registry, read, sql_case, sql_hash01

R = Registry()
LANG_ROWS = "(values " + ", ".join(f"('{c}', '{n}', '{e}', '{t}')" for c, n, e, t in languages.LANGUAGES) + ") l(code, english_name, endonym, resource_tier), range(0, 40) r(i)"


def grid(spark):
    return languages.grid(spark, 40)


def us(tag):
    return sql_hash01(f"'{tag}|' || code || '|' || i")


def sql_list(options):
    return "[" + ", ".join(f"'{o}'" for o in options) + "]"


def sql_pick(tag, options, n=None):
    return f"({options})[floor({us(tag)} * {n or f'len({options})'})::int + 1]"


def sql_fill(template):
    return " || ".join(f"{p}" if named else "'" + p.replace("'", "''") + "'" for p, named in Q.pieces(template))


@R.query(f"select code, count(*) filter ({us('hard')} < 0.2) as hard, count(*) as requests from {LANG_ROWS} group by code")
def hard_fraction(spark, sf_dir):
    return grid(spark).groupBy("code").agg(F.count(F.when(languages.hard_case(F.lit("hard"), F.col("code"), F.col("i")), 1)).alias("hard"), F.count(F.lit(1)).alias("requests"))


CODES = sql_list(Q.CODES)
PAIR = f"""o as (select *, list_filter({CODES}, lambda c: c <> code) as others from (select * from {LANG_ROWS})),
    x as (select *, {sql_pick('other', 'others')} as other, {sql_pick('first', 'others')} as first, {sql_pick('other', "list_filter(others, lambda c: c <> 'eng')")} as third from o),
    y as (select *, {sql_pick('second', 'list_filter(others, lambda c: c <> first)')} as second, case when code = 'eng' then case when {us('way')} < 0.5 then 'from_english' else 'to_english' end
        when {us('pair')} < 0.45 then 'from_english' when {us('pair')} < 0.75 then 'to_english' when {us('pair')} < 0.9 then 'from_other' else 'unrelated' end as kind from x),
    pairs as (select *, case kind when 'from_english' then 'eng' when 'to_english' then case when code = 'eng' then other else code end when 'from_other' then third else first end as source_lang,
        case kind when 'from_english' then case when code = 'eng' then other else code end when 'to_english' then 'eng' when 'from_other' then code else second end as target_lang from y)"""


@R.query(f"with {PAIR} select code, i::bigint as i, kind, source_lang, target_lang from pairs")
def lang_pair(spark, sf_dir):
    return grid(spark).select("code", "i", Q.language_pair().alias("p")).select("code", "i", "p.*")


TOOLS = sql_list(Q.DEVICE_TOOLS)
CHOICE = f"""t as (select *, {us('hard')} < 0.2 as hard, {sql_pick('target', TOOLS)} as target from {{0}}),
    d as (select *, 2 + floor({us('n')} * case when hard then 3 else 4 end)::int as n, list_transform(list_sort(list_transform(list_filter({TOOLS}, lambda t: t <> target), lambda t: md5(t || '|' || code || '|' || i) || t)), lambda s: substr(s, 33)) as rest from t),
    tools as (select *, array_to_string(case when hard then rest[1:n] else list_concat([target], rest[1:n]) end, ',') as tools from d)"""


@R.query(f"with {CHOICE.replace('{0}', LANG_ROWS)} select code, i::bigint as i, hard, target, tools from tools")
def tool_subset(spark, sf_dir):
    return grid(spark).select("code", "i", Q.tool_choice(Q.DEVICE_TOOLS).alias("t")).select("code", "i", "t.*")


PREPARED = f"""with {PAIR}, {CHOICE.replace('{0}', 'pairs')},
    b as (select *, case when resource_tier = 'low' then '{Q.CARE}' else '' end as care, {sql_pick('who', sql_list(Q.WHO))} as who, {sql_pick('mood', sql_list(Q.MOOD))} as mood, {sql_pick('habit', sql_list(Q.HABIT))} as habit,
        {sql_pick('topic', sql_list(Q.TOPICS))} as topic, case when i % 2 = 0 then 'doc' else 'chat' end as variant, {sql_pick('form', sql_list(J.FORMS))} as form, floor({us('level')} * 5)::int + 1 as level, floor({us('turns')} * 3)::int + 2 as turns,
        hard::varchar as hard_json, case when hard then 'One of them has no answer in it.' else 'All of them have their answer in it.' end as answers from tools),
    p as (select *, {sql_fill(Q.STYLE)} as style, {sql_fill(Q.PERSONA)} as persona from b)"""


@R.query(PREPARED + " select code, i::bigint as i, style, persona from p")
def persona_pick(spark, sf_dir):
    return Q.prepared(grid(spark)).select("code", "i", "style", "persona")


def sources(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("title"), numbered_block(F.split("text", "\n")).alias("document"))


def requests_sql():
    made = []
    for task in Q.TEMPLATES:
        user, context = Q.TEMPLATES[task]
        after = '}],"response_format":' + json.dumps(Q.formats(task), separators=(",", ":")) + ',"temperature":1.0,"max_tokens":2048}}'
        before = '","method":"POST","url":"/v1/chat/completions","body":{"model":"generator","messages":[{"role":"system","content":' + json.dumps(Q.RULES) + '},{"role":"user","content":'
        custom = f"format('{task}__{{}}__{{:05d}}', code, i)"
        made.append(f"select {custom} as custom_id, '{task}' as task, code as language, '{{\"custom_id\":\"' || {custom} || '{before}' || to_json({sql_fill(user)})::varchar || '{after}' as line, {sql_fill(context)} as context from {'rag' if task == 'rag' else 'p'}")
    rag = f""", rag as (select p.*, d.doc_id, 'document ' || d.doc_id as title, array_to_string(list_transform(string_split(d.text, chr(10)), lambda x, k: '[chunk ' || (k - 1) || ']' || chr(10) || x), chr(10) || chr(10)) as document
        from p join documents d on d.doc_id = floor({us('document')} * (select max(doc_id) + 1 from documents))::bigint) """
    return PREPARED + rag + " union all ".join(made)


@R.query(requests_sql())
def gen_requests(spark, sf_dir):
    """Request lines of all six tasks in every language, with what their answers are matched with."""
    docs, whole = sources(spark, sf_dir), None
    for build in Q.BUILDERS.values():
        rows = build(spark, docs)
        whole = rows if whole is None else whole.unionByName(rows)
    return whole


RUNS = """select lang, case when doc_id % 3 = 0 then 'remote' else 'local' end as side, ['pretrain', 'sft'][doc_id % 2 + 1] as mode, doc_id % 5 <> 0 as has_state, (doc_id * 37 % 100)::bigint as iter,
    format('2026{:02d}{:02d}_{:06d}_{}', doc_id % 12 + 1, doc_id % 28 + 1, doc_id, case when doc_id % 11 = 0 then 'other' else ['pretrain', 'sft'][doc_id % 2 + 1] end) as name from documents"""


@R.query(f"""with r as ({RUNS}), l as (select * from r where has_state and ends_with(name, '_' || mode) qualify row_number() over (partition by lang, mode, side order by name desc) = 1)
    select lang, mode, side, name, iter from l qualify row_number() over (partition by lang, mode order by iter desc, replace(name, '_' || mode, '') desc, side = 'local' desc) = 1""")
def latest_run(spark, sf_dir):
    """Of each mode the last run with a state file, local or remote: the remote one wins only if its (iteration, timestamp) is larger."""
    i = F.col("doc_id")
    mode = F.when(i % 2 == 0, "pretrain").otherwise("sft")
    name = F.format_string("2026%02d%02d_%06d_%s", i % 12 + 1, i % 28 + 1, i, F.when(i % 11 == 0, "other").otherwise(mode))
    runs = read(spark, sf_dir, "documents").select("lang", F.when(i % 3 == 0, "remote").otherwise("local").alias("side"), mode.alias("mode"), (i % 5 != 0).alias("has_state"), (i * 37 % 100).alias("iter"), name.alias("name"))
    return U.latest_runs(runs, "lang")


PATHS = "select ['trainer_state.json', 'resume_state/' || doc_id, 'ckpt_best/' || doc_id, 'ckpt_' || doc_id || '/model.pt', 'resume_state_best/' || doc_id, 'resume_state_old/' || doc_id][case when doc_id = 0 then 1 else doc_id % 5 + 2 end] as path, doc_id, case when doc_id % 4 = 0 then 0 else n_chars end as bytes from documents"


def paths(spark, sf_dir):
    i = F.col("doc_id")
    name = lambda before, after="": F.concat(F.lit(before), i.cast("string"), F.lit(after))
    made = F.array(F.lit("trainer_state.json"), name("resume_state/"), name("ckpt_best/"), name("ckpt_", "/model.pt"), name("resume_state_best/"), name("resume_state_old/"))
    path = F.get(made, F.when(i == 0, 0).otherwise(i % 5 + 1).cast("int"))
    return read(spark, sf_dir, "documents").select(path.alias("path"), "doc_id", F.when(i % 4 == 0, 0).otherwise(F.col("n_chars")).alias("bytes"))


FORCED = "(path = 'trainer_state.json' or path like 'resume\\_state/%' escape '\\' or path like 'resume\\_state\\_best/%' escape '\\' or path like 'ckpt\\_best/%' escape '\\')"


@R.query(f"""with p as ({PATHS}) select 'up' as way, path, 'base/runs/a/' || path as key, case when doc_id % 3 = 0 and not {FORCED} then 'skip' else 'copy' end as action from p
    union all select 'down', path, 'base/runs/a/' || path, case when bytes > 0 and doc_id % 2 = 0 and not {FORCED} then 'skip' else 'copy' end from p where doc_id % 7 <> 0""")
def copy_plan(spark, sf_dir):
    """Files of a run to copy up, against keys that are there, and down, against local files that aren't empty."""
    files = paths(spark, sf_dir)
    key = U.joined_key(F.lit("base/"), F.concat(F.lit("/runs/a/"), F.col("path")))
    up = U.upload_plan(files, files.where("doc_id % 3 = 0").select(key.alias("key")), "base/", "runs/a")
    other = files.where("doc_id % 7 = 0").select(F.concat(F.lit("base/runs/ab/"), "path").alias("key"))  # beside the folder, not below it
    remote = files.where("doc_id % 7 <> 0").select(key.alias("key")).unionByName(other)
    down = U.download_plan(remote, files.where("doc_id % 2 = 0"), "base", "/runs/a/")
    return up.select(F.lit("up").alias("way"), "path", "key", "action").unionByName(down.select(F.lit("down").alias("way"), "path", "key", "action"))


@R.query("select 'gone/' || source || '/' || doc_id as key from documents where lang = 'en' and source = 'src1'")
def delete_plan(spark, sf_dir):
    keys = read(spark, sf_dir, "documents").select(F.concat(F.when(F.col("lang") == "en", "gone/").otherwise("kept/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("key"))
    return U.below(keys, "gone/src1")


@R.query("""select doc_id, case when doc_id % 3 = 0 then source when doc_id % 3 = 1 then 'a/' || source else 'a/b/' || source end as key, source as base
            from documents""")
def key_join(spark, sf_dir):
    i = F.col("doc_id")
    prefix = F.element_at(F.array(F.lit(""), F.lit("a/"), F.lit("a/b//")), (i % 3 + 1).cast("int"))
    key = U.joined_key(prefix, F.concat(F.when(i % 2 == 0, "/").otherwise(""), "source"))
    return read(spark, sf_dir, "documents").select("doc_id", key.alias("key")).withColumn("base", U.base_name(F.col("key")))


@R.query("""with recursive e as (select label, vec_id, abs(embedding[1]::double) * 2 as loss, row_number() over (partition by label order by vec_id) as k from embeddings),
    w as (select label, vec_id, k, true as push, loss as last from e where k = 1 union all
          select e.label, e.vec_id, e.k, abs(e.loss - w.last) <= 0.4, case when abs(e.loss - w.last) <= 0.4 then e.loss else w.last end from w join e on e.label = w.label and e.k = w.k + 1)
    select label, vec_id, push from w""")
def push_gate(spark, sf_dir):
    """Evaluations of each run in order: one is published if its loss is near that of the last published one."""
    losses = read(spark, sf_dir, "embeddings").select("label", "vec_id", (F.abs(F.get("embedding", F.lit(0)).cast("double")) * 2).alias("loss"))
    return U.published(losses, "label", "vec_id", "loss").select("label", "vec_id", "push")


@R.query("""select vec_id, case when vec_id % 7 = 0 then 'other batch' when abs(embedding[2]::double - embedding[1]::double) > 0.1 then 'loss' when abs(embedding[4]::double - embedding[3]::double) > 0.01 then 'weights' else 'ok' end as state from embeddings""")
def resume_check(spark, sf_dir):
    x = lambda k: F.get("embedding", F.lit(k)).cast("double")
    return read(spark, sf_dir, "embeddings").select("vec_id", U.resumed_well(x(0), x(1), F.col("vec_id") % 7 != 0, x(2), x(3)).alias("state"))


BYTES = "lpad(hex(token % 256), 2, '0') || lpad(hex(token // 256), 2, '0')"


@R.query(streams.TOK + streams.WINDOW_STARTS + f""", s as (select distinct file, start from starts), x as (select s.file, s.start, t.pos, {BYTES} as b from s join tok t on t.file = s.file and t.pos >= s.start and t.pos <= s.start + 64),
    h as (select file, string_agg(b, '' order by start, pos) as b from x group by file) select file, substr(sha256(unhex(b)), 1, 16) as hash from h""")
def window_hash(spark, sf_dir):
    """Of each file, the hash of the bytes of its sampled windows of 65 tokens, in order."""
    tokens = streams.stream(spark, sf_dir)
    starts = streams.sampled(tokens).select("file", "start").distinct()
    pieces = K.windows(tokens, starts, 65).groupBy("file", "start").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("w"))
    whole = pieces.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("start", F.col("w.x").alias("ids")))).alias("w"))
    return whole.select("file", U.bytes_hash(F.flatten(F.col("w.ids"))).alias("hash"))


CALLS = ["set_alarm", "set_volume", "make_call", "own_tool", "fly", "lock_device"]
ARGS = {"fine": ['{"time": "06:30", "label": "up"}', '{"level": 5, "stream": "call"}', '{"contact": "Ada"}', '{"x": 1}', "{}", ""], "bad": ['{"time": 6}', '{"level": 5.5, "stream": "radio"}', "[1]", "{", "{}", " "]}
SAID = {
    "fine": [None, None, None, None, "unknown tool", None],
    "bad": ["$: label missing; $.time: type string expected", "$.level: type integer expected; $.stream: not in enum", "$: type object expected", "invalid JSON", "unknown tool", None],
}


@R.query("select doc_id, [" + ", ".join(f"'{c}'" for c in CALLS) + "][doc_id % 6 + 1] as tool, case when doc_id % 6 = 3 and doc_id % 5 = 0 then 'unknown tool' else case when doc_id % 7 = 0 then " + sql_case([(f"doc_id % 6 = {k}", f"'{v}'" if v else "null") for k, v in enumerate(SAID["bad"])], "null") + " else " + sql_case([(f"doc_id % 6 = {k}", f"'{v}'" if v else "null") for k, v in enumerate(SAID["fine"])], "null") + " end end as problems from documents")
def tool_arguments(spark, sf_dir):
    """Calls checked against the tool's parameters: the row's own tools first, then the known ones; a tool that neither has is an error."""
    at = lambda options: F.element_at(F.array(*map(F.lit, options)), (F.col("doc_id") % 6 + 1).cast("int"))
    own = F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("zoom"))).otherwise(F.array(F.lit("own_tool")))
    arguments = F.when(F.col("doc_id") % 7 == 0, at(ARGS["bad"])).otherwise(at(ARGS["fine"]))
    return read(spark, sf_dir, "documents").select("doc_id", at(CALLS).alias("tool"), J.argument_problems(at(CALLS), arguments, own).alias("problems"))


@R.query("select * from (values " + ", ".join(f"('{n}', '{json.dumps(J.schema_of(s)['properties'], separators=(',', ':'))}')" for n, s in [*J.TOOLS.items(), *J.FORMS.items()]) + ") t(name, properties)")
def schema_dim(spark, sf_dir):
    """The tools and forms with their fields."""
    rows = [(n, json.dumps(J.schema_of(s)["properties"], separators=(",", ":"))) for n, s in [*J.TOOLS.items(), *J.FORMS.items()]]
    return spark.createDataFrame(rows, "name string, properties string")


@R.query("select 'r' || doc_id as custom_id, ['" + "', '".join(J.FORMS) + "'][doc_id % 10 + 1] as form, '' as problems from documents")
def mock_answers(spark, sf_dir):
    """Sample answers of every form, checked against the form's own strict schema."""
    form = F.element_at(F.array(*map(F.lit, J.FORMS)), (F.col("doc_id") % 10 + 1).cast("int"))
    rows = read(spark, sf_dir, "documents").select(F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("custom_id"), form.alias("form"))
    told = F.lit("unknown form")
    for name, short in J.FORMS.items():
        schema = J.strict(J.schema_of(short))
        told = F.when(F.col("form") == name, J.json_problems(F.lit(json.dumps(J.sample_value(schema))), schema)).otherwise(told)
    return rows.withColumn("problems", told)
