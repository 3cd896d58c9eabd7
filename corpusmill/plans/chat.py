"""Queries for conversations, chunks, JSON checks and triage."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions.cleaning import clean, flat_list, flat_map
from corpusmill.functions.json_schema import json_problems
from corpusmill.operators import chat as H
from corpusmill.operators.chunks import chunk_text
from corpusmill.plans.base import SPACE, Registry, read, sql_strip

R = Registry()


def conversations(spark, sf_dir):
    """(conv_id, messages) in turn order; a conversation is one row."""
    rows = read(spark, sf_dir, "conversations")
    m = F.struct("turn", F.struct("role", F.col("text").alias("content"), F.lit(None).cast("string").alias("name"), F.lit(None).alias("calls")).cast(H.MESSAGE).alias("m"))
    return rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(m)), lambda x: x["m"]).alias("messages"))


@R.query("""select conv_id, '<s>' || string_agg(chr(10) || case when role = 'assistant' then '<|assistant|>' || chr(10) || chr(10) || text else '<|' || role || '|>' || text end || '</s>' || chr(10) || chr(10), '' order by turn) as text
            from conversations group by conv_id""")
def chat_render(spark, sf_dir):
    return conversations(spark, sf_dir).select("conv_id", H.render(F.col("messages")).alias("text"))


@R.query("""select conv_id, '{"id":"' || conv_id || '","task":"chat","language":"eng","messages":[' || string_agg('{"role":"' || role || '","content":' || to_json(text)::varchar || '}', ',' order by turn) || '],"text":' || to_json('<s>' ||
            string_agg(chr(10) || case when role = 'assistant' then '<|assistant|>' || chr(10) || chr(10) || text else '<|' || role || '|>' || text end || '</s>' || chr(10) || chr(10), '' order by turn))::varchar || '}' as record from conversations group by conv_id""")
def chat_record(spark, sf_dir):
    record = H.record(F.col("conv_id").cast("string"), F.lit("chat"), F.lit("eng"), F.col("messages"))
    return conversations(spark, sf_dir).select("conv_id", record.alias("record"))


@R.query("""select conv_id, turn, case when role in ('system', 'user') then coalesce(c <> '', false) and not has_calls and name is null when role = 'tool' then coalesce(c <> '', false) and not has_calls
            else (coalesce(c <> '', false) <> has_calls) and name is null end as ok
            from (select conv_id, turn, case turn % 5 when 3 then 'tool' else role end as role, case when (conv_id + turn) % 4 = 0 then '' else text end as c, case when conv_id % 7 = 0 then 'n' end as name, conv_id % 3 = 0 as has_calls from conversations)""")
def message_shape(spark, sf_dir):
    calls = F.when(F.col("conv_id") % 3 == 0, F.array(F.struct(F.lit("f").alias("name"), F.lit("{}").alias("arguments"))))
    content = F.when((F.col("conv_id") + F.col("turn")) % 4 == 0, "").otherwise(F.col("text"))
    m = F.struct(F.when(F.col("turn") % 5 == 3, "tool").otherwise(F.col("role")).alias("role"), content.alias("content"), F.when(F.col("conv_id") % 7 == 0, "n").alias("name"), calls.alias("calls"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", H.message_ok(m).alias("ok"))


TRIAGE_SQL = """select event_id as custom_id, event_type as task, case when event_id % 11 = 0 then 'timeout' end as error, case when event_id % 13 = 0 then 500 else 200 end as status_code,
    case when event_id % 17 <> 0 then case when event_id % 19 = 0 then '{bad' else props end end as content, case when event_id % 23 = 0 then 'no' end as refusal, event_id from events"""
STATUS_SQL = """case when error is not null then 'error' when status_code <> 200 then 'bad_status' when content is null and refusal is null then 'malformed' when refusal is not null then 'refusal' when content = '{bad' then 'bad_json' else 'ok' end"""


def outputs(spark, sf_dir):
    """Batch outputs as JSON lines, made of events and parsed again with an explicit schema."""
    k = lambda n: F.col("event_id") % n == 0
    inner = F.struct(F.when(~k(17), F.when(k(19), "{bad").otherwise(F.col("props"))).alias("content"), F.when(k(23), "no").alias("refusal"))
    body = F.struct(F.when(k(13), 500).otherwise(200).alias("status_code"), F.struct(F.array(F.struct(inner.alias("message"))).alias("choices")).alias("body"))
    line = F.to_json(F.struct(F.col("event_id").alias("custom_id"), F.when(k(11), "timeout").alias("error"), body.alias("response")))
    schema = "custom_id long, error string, response struct<status_code:int, body:struct<choices:array<struct<message:struct<content:string,refusal:string>>>>>"
    parsed = read(spark, sf_dir, "events").select(F.from_json(line, schema).alias("o"))
    said = F.get("o.response.body.choices", F.lit(0))["message"]
    return parsed.select("o.custom_id", "o.error", "o.response.status_code", said["content"].alias("content"), said["refusal"].alias("refusal")).withColumn("is_json", F.try_parse_json("content").isNotNull())


@R.query(f"select custom_id, {STATUS_SQL} as status from ({TRIAGE_SQL})")
def response_triage(spark, sf_dir):
    return H.triage(outputs(spark, sf_dir)).select("custom_id", "status")


@R.query(f"""with m as (select event_id % 4000 as custom_id, event_type as task from events qualify row_number() over (partition by event_id % 4000 order by event_id desc) = 1)
             select m.task, {STATUS_SQL} as status, count(*) as n from ({TRIAGE_SQL}) o join m using (custom_id) group by all""".replace("o join m using (custom_id)", "o join m on m.custom_id = o.custom_id"))
def triage_join(spark, sf_dir):
    """Outputs meet the last manifest row of their id; outputs without one drop out before they are counted."""
    manifest = read(spark, sf_dir, "events").select((F.col("event_id") % 4000).alias("custom_id"), F.col("event_type").alias("task"), "event_id")
    last = H.last_manifest(manifest, "custom_id", "event_id").select("custom_id", "task")
    return H.triage(outputs(spark, sf_dir)).join(last, "custom_id").groupBy("task", "status").agg(F.count(F.lit(1)).alias("n"))


@R.query("select event_id, case when event_id % 5 = 0 then -1 when event_id % 7 = 0 then -1 else (props->>'k')::bigint end as k from events")
def json_safe(spark, sf_dir):
    text = F.when(F.col("event_id") % 5 == 0, "").when(F.col("event_id") % 7 == 0, "{oops").otherwise(F.col("props"))
    parsed = H.safe_json(text, "k long", F.struct(F.lit(-1).cast("long").alias("k")))
    return read(spark, sf_dir, "events").select("event_id", parsed["k"].alias("k"))


@R.query("""select event_id, case event_id % 4 when 0 then '' when 1 then '$.k: type integer expected' when 2 then '$: name missing' else 'invalid JSON' end as problems from events""")
def json_check(spark, sf_dir):
    schema = {"type": "object", "required": ["k", "name"], "properties": {"k": {"type": "integer"}, "name": {"type": "string", "enum": ["a", "b"]}}}
    k = F.regexp_extract("props", r"(\d+)", 1)
    kinds = [F.concat(F.lit('{"k": '), k, F.lit(', "name": "a"}')), F.concat(F.lit('{"k": "'), k, F.lit('", "name": "b", "more": 1}')), F.col("props"), F.lit("{")]
    text = F.element_at(F.array(*kinds), (F.col("event_id") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "events").select("event_id", json_problems(text, schema).alias("problems"))


@R.query("""select event_id, '{"type":"' || event_type || '","k":' || (props->>'k') || '}' as compact, '{"type": "' || event_type || '", "k": ' || (props->>'k') || '}' as spaced from events""")
def json_dumps(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    compact = F.to_json(F.struct(F.col("event_type").alias("type"), k.cast("long").alias("k")))
    spaced = F.concat(F.lit('{"type": '), H.quoted(F.col("event_type")), F.lit(', "k": '), k, F.lit("}"))
    return read(spark, sf_dir, "events").select("event_id", compact.alias("compact"), spaced.alias("spaced"))


@R.query("""select doc_id, case when chunk_id >= n then 'missing' else 'found' end as status, case when chunk_id < n then parts[chunk_id + 1] end as chunk from (select doc_id, string_split(text, chr(10)) as parts, len(string_split(text, chr(10))) as n, doc_id % 12 as chunk_id from documents)""")
def chunk_lookup(spark, sf_dir):
    """Asked chunks against a table of chunks (doc_id, chunk_id); a miss is a status, not a lost row."""
    docs = read(spark, sf_dir, "documents")
    chunks = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_id", "chunk"))
    asked = docs.select("doc_id", (F.col("doc_id") % 12).cast("int").alias("chunk_id"))
    joined = asked.join(chunks, ["doc_id", "chunk_id"], "left")
    return joined.select("doc_id", F.when(F.col("chunk").isNull(), "missing").otherwise("found").alias("status"), "chunk")


@R.query("""select doc_id, name, case when doc_id % 3 = 0 and name <> 'zoom' then 'own' when name in ('search', 'calculate') then 'global' else 'unknown' end as source
            from (select doc_id, ['search', 'calculate', 'light', 'zoom'][doc_id % 4 + 1] as name from documents)""")
def tool_lookup(spark, sf_dir):
    """A row's own tools first, then the global ones; both missing is an error status."""
    name = F.element_at(F.array(*map(F.lit, ["search", "calculate", "light", "zoom"])), (F.col("doc_id") % 4 + 1).cast("int"))
    calls = read(spark, sf_dir, "documents").select("doc_id", name.alias("name"))
    own = calls.where((F.col("doc_id") % 3 == 0) & (F.col("name") != "zoom")).withColumn("o", F.lit(True))
    everyone = spark.createDataFrame([("search", True), ("calculate", True)], "name string, g boolean")
    joined = calls.join(own, ["doc_id", "name"], "left").join(F.broadcast(everyone), "name", "left")  # two rows
    return joined.select("doc_id", "name", F.when(F.col("o"), "own").when(F.col("g"), "global").otherwise("unknown").alias("source"))


def doc_chunks(spark, sf_dir):
    text = F.regexp_replace("text", "\n", "\n\n")
    return read(spark, sf_dir, "documents").select("doc_id", chunk_text(text).alias("chunks"))


@R.query()
def chunk_docs(spark, sf_dir):
    return doc_chunks(spark, sf_dir).select("doc_id", F.posexplode("chunks").alias("chunk_id", "text"))


NFULL = f"len(list_filter(regexp_split_to_array(p, '{SPACE}+'), lambda w: w <> ''))"


@R.query(f"""with recursive p as (select doc_id, list_filter(list_transform(string_split({sql_strip('text')}, chr(10)), lambda x: {sql_strip('x')}), lambda x: x <> '') as ps from documents),
    s as (select doc_id, k, ps[k] as p from p, unnest(range(1, len(ps) + 1)) t(k)),
    w as (select doc_id, k, p, {NFULL} as n, regexp_split_to_array(regexp_replace(p, '([.!?]){SPACE}+', '\\1' || chr(1), 'g'), chr(1)) as ss from s),
    f as (select doc_id, k, 0 as j, n from w where n <= 180 union all
          select doc_id, k, j, least(180, n - j * 180) from (select *, unnest(range(0, (n - 1) // 180 + 1)) as j from w where n > 180 and len(ss) <= 1) union all
          select doc_id, k, j, n from (select doc_id, k, u as j, len(list_filter(regexp_split_to_array(ss[u], '{SPACE}+'), lambda w: w <> '')) as n from w, unnest(range(1, len(ss) + 1)) t(u) where w.n > 180 and len(ss) > 1)),
    big as (select doc_id, k, list(n order by j) as ns from (select f.* from f join w using (doc_id, k) where w.n > 180 and len(w.ss) > 1) group by doc_id, k),
    packed as (select doc_id, k, list_reduce(list_transform(ns, lambda x: [x]), lambda acc, x: case when acc[-1] + x[1] > 180 then list_append(acc, x[1]) else list_append(acc[1:len(acc)-1], acc[-1] + x[1]) end) as ns from big),
    flat as (select f.doc_id, f.k, f.j, f.n from f join w using (doc_id, k) where not (w.n > 180 and len(w.ss) > 1) union all select doc_id, k, j, ns[j] from packed, unnest(range(1, len(ns) + 1)) t(j)),
    lists as (select doc_id, list(n order by k, j) as ns from flat group by doc_id)
    select doc_id, len(list_reduce(list_transform(ns, lambda x: [x]), lambda acc, x: case when acc[-1] + x[1] > 180 then list_append(acc, x[1]) else list_append(acc[1:len(acc)-1], acc[-1] + x[1]) end)) as chunks from lists""")
def chunk_counts(spark, sf_dir):
    return doc_chunks(spark, sf_dir).select("doc_id", F.size("chunks").cast("long").alias("chunks")).where("chunks > 0")


@R.query()
def clean_text(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", clean(F.col("html")).alias("text"))


@R.query("select doc_id, coalesce('source. ' || source || ' lang. ' || lang, '') as told, array_to_string(string_split(text, chr(10)), ' ') as joined from documents")
def flatten_values(spark, sf_dir):
    """Mappings as 'key. value' and lists, as the text that is cleaned."""
    told = flat_map(F.map_from_arrays(F.array(F.lit("source"), F.lit("lang")), F.array("source", "lang")))
    return read(spark, sf_dir, "documents").select("doc_id", told.alias("told"), flat_list(F.split("text", "\n")).alias("joined"))


def spec(spark, sf_dir):
    """Task specs made of documents: every fifth line goes to one of the generated fields f0 to f4."""
    lines = F.split("text", "\n")
    field = lambda k: F.array_join(F.filter(lines, lambda _, i: i % 5 == k), "\n")
    return read(spark, sf_dir, "documents").select("doc_id", *[F.when(field(k) == "", "none").otherwise(field(k)).alias(f"f{k}") for k in range(5)], (F.col("doc_id") % 2 == 0).alias("flag"), lines.alias("lines"))


def rendered(spark, sf_dir, messages):
    made = spec(spark, sf_dir).select("doc_id", messages.alias("m"))
    return made.select("doc_id", F.forall("m", H.message_ok).alias("ok"), H.render(F.col("m")).alias("text"))


def said(role, content, name=None):
    """SQL of one rendered message."""
    if role == "tool":
        return f"chr(10) || '<tool_result>{name} ' || {content} || '</tool_result></s>' || chr(10) || chr(10)"
    return f"chr(10) || '<|{role}|>' || " + ("chr(10) || chr(10) || " if role == "assistant" else "") + f"{content} || '</s>' || chr(10) || chr(10)"


def called(name, arguments):
    return f"chr(10) || '<|assistant|>' || chr(10) || chr(10) || '<tool_call>{name}' || chr(10) || {arguments} || '</tool_call></s>'"


def spec_sql(*cases):
    """cases: (condition, messages) in SQL; every message of the specs has a text."""
    fields = ", ".join(f"coalesce(nullif(array_to_string(list_filter(lines, lambda x, k: (k - 1) % 5 = {k}), chr(10)), ''), 'none') as f{k}" for k in range(5))
    text = "case " + " ".join(f"when {c} then '<s>' || " + " || ".join(m) for c, m in cases) + " end"
    return f"with s as (select doc_id, doc_id % 2 = 0 as flag, lines, {fields} from (select doc_id, string_split(text, chr(10)) as lines from documents)) select doc_id, true as ok, {text} as text from s"


ASKED = [said("system", "f0"), said("user", "f1")]
NOT_FOUND = "'{\"chunk_id\":null,\"found\":false,\"text\":\"" + H.NO_PASSAGE + "\"}'"
SEARCH = called("search_document", "'{\"query\": ' || to_json(f2)::varchar || '}'")
FOUND = "'{\"chunk_id\":1,\"found\":true,\"text\":' || to_json(lines[2])::varchar || '}'"


@R.query(spec_sql(("doc_id % 4 = 0 and len(lines) > 1", [*ASKED, SEARCH, said("tool", FOUND, "search_document"), said("assistant", "f3")]), ("true", [*ASKED, SEARCH, said("tool", NOT_FOUND, "search_document"), said("assistant", "f3")])))
def render_rag(spark, sf_dir):
    turn = F.struct(F.col("f1").alias("user_message"), F.col("f2").alias("search_query"), F.col("flag").alias("answerable"), F.when(F.col("doc_id") % 4 == 0, 1).alias("relevant_chunk_id"), F.col("f3").alias("assistant_response"))
    return rendered(spark, sf_dir, H.render_rag(F.col("f0"), F.array(turn), F.col("lines")))


@R.query(spec_sql(("flag", [*ASKED, said("assistant", "f2"), said("user", "f3"), said("assistant", "f4")]), ("true", [*ASKED, said("assistant", "f2"), said("user", "f3"), said("assistant", "f4")])))
def render_summarization(spark, sf_dir):
    """Of a document, with a question after it, or of a chat."""
    prior = F.array(F.struct(F.col("f1").alias("user_message"), F.col("f2").alias("assistant_message")))
    doc, chat = (lambda d, c: F.when(F.col("flag"), d).otherwise(c)), F.col("f3")
    return rendered(spark, sf_dir, H.render_summarization(F.col("f0"), F.when(F.col("flag"), "doc").otherwise("chat"), doc(F.col("f1"), chat), doc(F.col("f2"), F.col("f4")), prior, F.col("flag"), F.col("f3"), F.col("f4")))


BLOCK = "'<reason>' || f2 || '</reason><task_plan>' || f3 || '</task_plan>'"
LIGHT = [said("assistant", BLOCK), called("set_volume", "'{\"level\": 5}'"), said("tool", "'{\"status\":\"success\"}'", "set_volume"), said("assistant", "f4")]


@R.query(spec_sql(("flag", [*ASKED, *LIGHT]), ("true", [*ASKED, said("assistant", BLOCK + " || f4")])))
def render_edge_action(spark, sf_dir):
    return rendered(spark, sf_dir, H.render_edge_action(F.col("f0"), F.col("f1"), F.col("f2"), F.col("f3"), F.col("flag"), F.lit("set_volume"), F.lit('{"level": 5}'), F.lit(None).cast("string"), F.col("f4")))


@R.query(spec_sql(("true", [said("system", "'Extract from: ' || f0"), said("user", "f1"), said("assistant", "'{\"x\": ' || to_json(f2)::varchar || '}'")])))
def render_structured_output(spark, sf_dir):
    return rendered(spark, sf_dir, H.render_structured_output(F.lit("Extract from: __SOURCE_TEXT_PLACEHOLDER__"), F.col("f0"), F.col("f1"), F.concat(F.lit('{"x": '), H.quoted(F.col("f2")), F.lit("}"))))


SUM = [said("assistant", "f2"), called("calculate", "'{\"expression\": \"1+1\"}'"), said("tool", "'{\"result\":\"2\"}'", "calculate"), said("assistant", "f3")]


@R.query(spec_sql(("flag", [*ASKED, *SUM]), ("true", [*ASKED, said("assistant", "trim(f2 || ' ' || f3)")])))
def render_math_stats(spark, sf_dir):
    return rendered(spark, sf_dir, H.render_math_stats(F.col("f0"), F.col("f1"), F.col("f2"), F.col("flag"), F.lit("1+1"), F.lit("2"), F.col("f3")))


@R.query(spec_sql(("flag", [*ASKED, said("assistant", "f2"), said("user", "f3"), said("assistant", "f4")]), ("true", [*ASKED, said("assistant", "f2")])))
def render_translation(spark, sf_dir):
    return rendered(spark, sf_dir, H.render_translation(F.col("f0"), F.col("f1"), F.col("f2"), F.col("flag"), F.col("f3"), F.col("f4")))
