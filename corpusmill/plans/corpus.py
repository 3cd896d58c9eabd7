"""Queries over ``documents``: corpus preparation, text functions and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions import text as X
from corpusmill.operators import corpus as C
from corpusmill.operators import languages
from corpusmill.operators.sequence import running_total
from corpusmill.plans.base import SPACE, WORD, Registry, read, sql_case, sql_hash01, sql_strip

R = Registry()
WORDS = f"regexp_extract_all(text, '{WORD}')"
SPLIT_SPACE = f"list_filter(regexp_split_to_array(text, '{SPACE}+'), lambda w: w <> '')"
TASK_SQL = sql_case([(f"contains({{0}}, '<{t}>')", f"'{t}'") for t in X.TASK_TAGS], "{1}")
#: Documents dressed as tagged samples: a tag by id, so that the tag functions have something to find.
TAGGED_SQL = "concat(case doc_id % 5 when 0 then '<translate>' when 1 then '<qa><yor>' when 2 then '<lang_ID> <eng>' when 3 then '<summarize><fuv>x<ibo>' else '<>' end, text)"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents")


def tagged() -> F.Column:
    tag = F.element_at(F.array(*map(F.lit, ["<translate>", "<qa><yor>", "<lang_ID> <eng>", "<summarize><fuv>x<ibo>", "<>"])), (F.col("doc_id") % 5 + 1).cast("int"))
    return F.concat(tag, F.col("text"))


@R.query("select doc_id, text from documents")
def corpus_scan(spark, sf_dir):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    return spark.read.schema(schema).parquet(f"{sf_dir}/documents.parquet")


@R.query("select 'documents' as part, doc_id as id, text from documents union all select 'benchmark', item_id, text from benchmark")
def corpus_concat(spark, sf_dir):
    a = docs(spark, sf_dir).select(F.lit("documents").alias("part"), F.col("doc_id").alias("id"), "text")
    return a.unionByName(read(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("part"), F.col("item_id").alias("id"), "text"))


@R.query("""with t as (select doc_id, trim(regexp_replace(split_part(text, chr(10), 1), '^[# ]+', '')) as line from documents)
            select doc_id, case when line <> '' then line else 'doc' || doc_id end as title from t""")
def doc_title(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.title(F.col("text"), F.concat(F.lit("doc"), F.col("doc_id").cast("string"))).alias("title"))


@R.query(f"""select doc_id, text_key from (select doc_id, md5({sql_strip('text')}) as text_key,
             row_number() over (partition by md5({sql_strip('text')}) order by doc_id) as rn from documents) where rn = 1""")
def dedup_exact(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", C.text_key(F.col("text")).alias("text_key"))
    return C.keep_first(rows, F.col("text_key"), "doc_id")


@R.query(f"""with k as (select doc_id, md5({sql_strip('text')}) as text_key from documents)
             select doc_id, text_key from k where text_key not in (select text_key from k where doc_id % 4 = 0)""")
def registry_anti(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", C.text_key(F.col("text")).alias("text_key"))
    registry = rows.where("doc_id % 4 = 0").select(F.col("text_key").alias("hash")).distinct()
    return C.not_registered(rows, registry, F.col("text_key"))


@R.query("select distinct source || '.parquet' as file from documents where source not in (select distinct source from documents where doc_id % 50 = 0)")
def ledger_anti(spark, sf_dir):
    files = docs(spark, sf_dir).select(F.concat("source", F.lit(".parquet")).alias("file"), "doc_id")
    done = files.where("doc_id % 50 = 0").select("file").distinct()
    return files.select("file").distinct().join(done, "file", "left_anti")


@R.query(f"select doc_id, len({WORDS}) as len from documents")
def token_len(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.size(X.words(F.col("text"))).cast("long").alias("len"))


@R.query(f"select sum(len({WORDS}))::bigint as tokens, count(*) as texts from documents")
def token_totals(spark, sf_dir):
    return docs(spark, sf_dir).agg(F.sum(F.size(X.words(F.col("text")))).alias("tokens"), F.count(F.lit(1)).alias("texts"))


@R.query("select doc_id from documents order by md5('42|' || doc_id), doc_id limit 200")
def sample_n(spark, sf_dir):
    return C.sample(docs(spark, sf_dir).select("doc_id"), "doc_id", 200)


SIZE_SQL = "(case when n <= 50 then 0 when n <= 80000 then (n * 0.10::double)::double when n <= 800000 then n * 0.01::double when n <= 3500000 then n * 0.0025::double else n * 0.0005::double end)"
SPLIT_SQL = f"""with s as (select doc_id, lang, count(*) over (partition by lang) as n,
    row_number() over (partition by lang order by {sql_hash01("'2357|' || doc_id")}, doc_id) as rn from documents)
    select doc_id, lang, case when rn <= floor({SIZE_SQL}) then 'val' else 'train' end as split from s"""


@R.query(SPLIT_SQL)
def split_assign(spark, sf_dir):
    return C.split(docs(spark, sf_dir).select("doc_id", "lang"), "lang", "doc_id")


@R.query("""with s as (select doc_id, source, count(*) over (partition by source) as n from documents)
             select doc_id, source, 'train' as split from s where n <= 50 union all select doc_id, source, 'val' from s where n <= 50""")
def split_tiny(spark, sf_dir):
    """Sets of 50 rows or fewer have no split of their own: validation is the training rows, flagged by appearing in both."""
    rows = docs(spark, sf_dir).select("doc_id", "source")
    tiny = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).where(C.test_size(F.col("n")) == 0).select("source")
    return rows.join(tiny, "source", "left_semi").select("doc_id", "source", F.explode(F.array(F.lit("train"), F.lit("val"))).alias("split"))


@R.query(f"select source, n, floor({SIZE_SQL})::bigint as val_rows from (select source, count(*) * 37 as n from documents group by source)")
def split_sizes(spark, sf_dir):
    n = docs(spark, sf_dir).groupBy("source").agg((F.count(F.lit(1)) * 37).alias("n"))
    return n.select("source", "n", C.test_size(F.col("n")).alias("val_rows"))


@R.query("""select doc_id, case when contains(name, 'english') or contains(name, 'eng') then 'eng_bin' when contains(name, 'african') or contains(name, 'afr') or contains(name, 'nigerian') then 'afr_bin' else 'train_bin' end as bin
            from (select doc_id, lower(case doc_id % 4 when 0 then 'Org/English-' when 1 then 'org/Afro_' when 2 then 'org/NIGERIAN_' else 'org/' end || source) as name from documents)""")
def route_source(spark, sf_dir):
    part = F.element_at(F.array(*map(F.lit, ["Org/English-", "org/Afro_", "org/NIGERIAN_", "org/"])), (F.col("doc_id") % 4 + 1).cast("int"))
    return docs(spark, sf_dir).select("doc_id", X.route(F.concat(part, "source"), F.lit("eng_bin"), F.lit("afr_bin"), F.lit("train_bin")).alias("bin"))


@R.query(f"select doc_id, array_to_string(case when len(w) > 1024 then list_concat(w[1:100], w[len(w)-9:len(w)]) else w end, ' ') as kept from (select doc_id, {WORDS} as w from documents)")
def trunc_head_tail(spark, sf_dir):
    w = X.words(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.array_join(F.when(F.size(w) > 1024, F.concat(F.slice(w, 1, 100), F.slice(w, -10, 10))).otherwise(w), " ").alias("kept"))


@R.query(f"select doc_id, array_to_string({SPLIT_SPACE}[1:128], ' ') as head from documents")
def first_words(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_join(F.slice(X.space_words(F.col("text")), 1, 128), " ").alias("head"))


AFTER_SQL = f"regexp_split_to_array({TAGGED_SQL}, '{X.LANGUAGE_TAG.replace('(', '(?:')}')[-1]"


@R.query(f"select doc_id, {sql_strip(f'''substr(regexp_replace({AFTER_SQL}, '{X.PROMPT_TAG}', '', 'g'), 1, 80)''')} as prompt from documents")
def lang_prompt(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.language_prompt(tagged()).alias("prompt"))


@R.query(f"select doc_id, {AFTER_SQL} as tail from documents")
def lang_tag_split(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.after_language_tag(tagged()).alias("tail"))


@R.query(f"select doc_id, {TASK_SQL.replace('{0}', TAGGED_SQL).replace('{1}', 'source')} as task from documents")
def task_detect(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.task_of(tagged(), F.col("source")).alias("task"))


FILE_SQL = "concat('Data_', case doc_id % 6 when 0 then 'Fulfulde' when 1 then 'yoruba_eng' when 2 then 'FULA' when 3 then 'efi' when 4 then 'hausa' else 'x' end, '_translate.bin')"


@R.query(f"select doc_id, {sql_case([(f'contains(lower({FILE_SQL}), $${k}$$)', f'$${v}$$') for k, v in X.FILE_LANGUAGES.items()], 'null')} as lang, {sql_case([(f'contains(lower({FILE_SQL}), lower($${t}$$))', f'$${t}$$') for t in X.TASK_TAGS], 'null')} as task from documents")
def file_info(spark, sf_dir):
    part = F.element_at(F.array(*map(F.lit, ["Fulfulde", "yoruba_eng", "FULA", "efi", "hausa", "x"])), (F.col("doc_id") % 6 + 1).cast("int"))
    name = F.concat(F.lit("Data_"), part, F.lit("_translate.bin"))
    task = X.first_match([(F.lower(name).contains(t.lower()), F.lit(t)) for t in X.TASK_TAGS], F.lit(None).cast("string"))
    return docs(spark, sf_dir).select("doc_id", X.file_language(name).alias("lang"), task.alias("task"))


TAGS = ["<eng>", "<yor>", "<ff>", "<urh>", "<none>"]


@R.query(f"select doc_id, {sql_case([(f'doc_id % 5 = {k}', repr(X.TAG_NAMES.get(t[1:-1])).replace('None', 'null')) for k, t in enumerate(TAGS)], 'null')} as name from documents")
def tag_name(spark, sf_dir):
    tag = F.element_at(F.array(*map(F.lit, TAGS)), (F.col("doc_id") % 5 + 1).cast("int"))
    return docs(spark, sf_dir).select("doc_id", X.tag_name(tag).alias("name"))


@R.query(f"select doc_id, {sql_strip('text')} as stripped, length({sql_strip('text')}) as n from (select doc_id, chr(160) || chr(9) || text || chr(8195) || chr(10) as text from documents)")
def strip_text(spark, sf_dir):
    padded = F.concat(F.lit(" \t"), F.col("text"), F.lit(" \n"))
    return docs(spark, sf_dir).select("doc_id", X.strip_spaces(padded).alias("stripped")).withColumn("n", F.length("stripped").cast("long"))


@R.query(f"select word, count(*) as n from (select unnest(regexp_extract_all(lower(text), '{WORD}')) as word from documents) group by word")
def word_counts(spark, sf_dir):
    return docs(spark, sf_dir).select(F.explode(X.words(F.lower("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@R.query(f"select word, count(*) as n from (select unnest({WORDS}) as word from documents) group by word order by n desc, word limit 1000")
def vocab_counts(spark, sf_dir):
    counts = docs(spark, sf_dir).select(F.explode(X.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "word").limit(1000)


@R.query(r"""select page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) as text from pages""")
def html_strip(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", X.html_text(F.col("html")).alias("text"))


@R.query("select doc_id, case when head <> '' then head else text end as answer from (select doc_id, text, regexp_extract(text, '(?s)^(.*?[a-z])[A-Z]', 1) as head from documents)")
def extract_answer(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.extract_answer(F.col("text")).alias("answer"))


TOPIC_TEXT = ["Business and music", "football in Africa", "health music", "about religion", "Technology of sports", "nothing"]


@R.query(f"select doc_id, {sql_case([(f'contains(t, $${k}$$)', f'$${v}$$') for k, v in [('business', 'business'), ('football', 'sports'), ('music', 'entertainment'), ('africa', 'politics'), ('afrikaan', 'politics')] + [(t, t) for t in X.TOPICS[1:]]], '$$unknown$$')} as topic from (select doc_id, lower([{', '.join(repr(t) for t in TOPIC_TEXT)}][doc_id % 6 + 1] || ' ' || text) as t from documents)")
def assign_topic(spark, sf_dir):
    said = F.concat(F.element_at(F.array(*map(F.lit, TOPIC_TEXT)), (F.col("doc_id") % 6 + 1).cast("int")), F.lit(" "), F.col("text"))
    return docs(spark, sf_dir).select("doc_id", X.assign_topic(said).alias("topic"))


@R.query(f"select doc_id, {SPLIT_SPACE}[-1] as word from documents")
def last_word(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.last_word(F.col("text")).alias("word"))


CODES = ["yor", "ibo", "hau", "eng"]
CLEAN_SQL = sql_strip(f"regexp_replace(case when doc_id % 7 = 0 then ' ' else text end, '{SPACE}+', ' ', 'g')")
MISSING_SQL = " or ".join(f"(code = '{k}' and length(clean) >= 40 and not regexp_matches(lower(clean), '[{''.join(dict.fromkeys(X.DISTINCTIVE[k]))}]'))" for k in CODES[:3])


@R.query(f"select doc_id, case when clean = '' then 'empty' when {MISSING_SQL} then 'no distinctive letters' end as warning from (select doc_id, {CLEAN_SQL} as clean, ['yor', 'ibo', 'hau', 'eng'][doc_id % 4 + 1] as code from documents)")
def lang_sanity(spark, sf_dir):
    code = F.element_at(F.array(*map(F.lit, CODES)), (F.col("doc_id") % 4 + 1).cast("int"))
    said = F.when(F.col("doc_id") % 7 == 0, " ").otherwise(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", X.language_warning(said, code).alias("warning"))


@R.query(f"select doc_id, length({sql_strip('text')}) < 2 as too_short from documents")
def min_length(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", (F.length(X.strip_spaces(F.col("text"))) < 2).alias("too_short"))


@R.query("""select doc_id, array_to_string(list_transform(c, lambda x, i: '[chunk ' || (i - 1) || ']' || chr(10) || x), chr(10) || chr(10)) as block
            from (select doc_id, string_split(text, chr(10)) as c from documents)""")
def numbered_block(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.numbered_block(F.split("text", "\n")).alias("block"))


@R.query("select format('{}__{}__{:05d}__{}', source, lang, doc_id, 'a') as custom_id from documents")
def custom_ids(spark, sf_dir):
    return docs(spark, sf_dir).select(F.format_string("%s__%s__%05d__%s", "source", "lang", "doc_id", F.lit("a")).alias("custom_id"))


@R.query(f"select doc_id, list_sum(list_transform(range(0, (greatest(length(text), 1) - 1) // 500 + 1), lambda i: len(regexp_extract_all(substr(text, (i * 500 + 1)::bigint, 500), '{WORD}'))))::bigint as tokens from documents")
def token_count_chunks(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.chunk_lengths(F.col("text"), 500).alias("tokens"))


@R.query("select sum(tokens)::bigint as tokens from (" + f"select doc_id, list_sum(list_transform(range(0, (greatest(length(text), 1) - 1) // 500 + 1), lambda i: len(regexp_extract_all(substr(text, (i * 500 + 1)::bigint, 500), '{WORD}'))))::bigint as tokens from documents" + ")")
def token_count_total(spark, sf_dir):
    """The same for all texts together."""
    return docs(spark, sf_dir).agg(F.sum(X.chunk_lengths(F.col("text"), 500)).alias("tokens"))


@R.query(f"select doc_id, len({WORDS}) as words, len({SPLIT_SPACE}) as space_words, len(regexp_extract_all(text, '[.!?]+')) as sentences from documents")
def doc_lengths(spark, sf_dir):
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", F.size(X.words(t)).cast("long").alias("words"), F.size(X.space_words(t)).cast("long").alias("space_words"), F.regexp_count(t, F.lit("[.!?]+")).cast("long").alias("sentences"))


@R.query("select doc_id, sha256(lower(text)) as fingerprint from documents")
def fingerprint(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.fingerprint(F.col("text")).alias("fingerprint"))


SHINGLE_SQL = f"""select doc_id, lang, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as sh
    from (select doc_id, lang, regexp_extract_all(lower(text), '{WORD}') as w from documents)"""


@R.query(f"select doc_id, unnest(sh) as shingle from ({SHINGLE_SQL})")
def shingles(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.explode(X.shingles(F.col("text"))).alias("shingle"))


@R.query("select doc_id, ntile(64) over (order by doc_id) as shard from documents")
def shard_assign(spark, sf_dir):
    """Contiguous shards of almost equal size: position by two-level counts, then its shard by arithmetic."""
    rows = docs(spark, sf_dir).select("doc_id", F.lit(0).alias("k"))
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    placed = running_total(rows, "k", "doc_id", F.lit(1), "at").crossJoin(F.broadcast(n))  # one row
    size, rest = F.floor(F.col("n") / 64), F.col("n") % 64
    in_large = F.floor(F.col("at") / (size + 1))
    return placed.select("doc_id", F.when(F.col("at") < rest * (size + 1), in_large).otherwise(rest + F.floor((F.col("at") - rest * (size + 1)) / F.greatest(size, F.lit(1)))).cast("long").alias("z")).select("doc_id", (F.col("z") + 1).alias("shard"))


@R.query("select key, count(*) as n from (select substr(md5(text), 1, 8) as key from documents) group by key having count(*) > 1")
def dup_keys(spark, sf_dir):
    return C.duplicate_keys(docs(spark, sf_dir).select(F.substring(F.md5("text"), 1, 8).alias("key")), "key")


@R.query("select source || '__' || lang as file, count(*) as requests from documents group by source, lang")
def req_counts(spark, sf_dir):
    return docs(spark, sf_dir).groupBy(F.concat_ws("__", "source", "lang").alias("file")).agg(F.count(F.lit(1)).alias("requests"))


@R.query("select doc_id, lang, case when n > 50 then lang || '__part' || ((rn - 1) // 50) else lang end as file from (select doc_id, lang, row_number() over (partition by lang order by doc_id) as rn, count(*) over (partition by lang) as n from documents)")
def batch_parts(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", "lang")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    placed = running_total(rows, "lang", "doc_id", F.lit(1), "at").join(sizes, "lang")
    return placed.select("doc_id", "lang", F.when(F.col("n") > 50, F.concat("lang", F.lit("__part"), F.floor(F.col("at") / 50).cast("string"))).otherwise(F.col("lang")).alias("file"))


@R.query("select doc_id, ('0x' || substr(sha256('42|' || source || '|' || lang || '|' || doc_id), 1, 8))::ubigint::bigint as draw from documents")
def keyed_hash(spark, sf_dir):
    key = F.concat_ws("|", F.lit("42"), "source", "lang", F.col("doc_id").cast("string"))
    return docs(spark, sf_dir).select("doc_id", F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long").alias("draw"))


LANG_VALUES = ", ".join(f"('{c}', '{n}', '{t}')" for c, n, _, t in languages.LANGUAGES)


@R.query(f"select d.doc_id, l.code, l.english_name, l.resource_tier from (select doc_id, ['yor', 'fuv', 'pcm', 'xxx'][doc_id % 4 + 1] as c from documents) d left join (values {LANG_VALUES}) l(code, english_name, resource_tier) on l.code = d.c")
def lang_dim(spark, sf_dir):
    code = F.element_at(F.array(*map(F.lit, ["yor", "fuv", "pcm", "xxx"])), (F.col("doc_id") % 4 + 1).cast("int"))
    dim = languages.dimension(spark).select("code", "english_name", "resource_tier")
    return docs(spark, sf_dir).select("doc_id", code.alias("c")).join(F.broadcast(dim), F.col("c") == F.col("code"), "left").select("doc_id", "code", "english_name", "resource_tier")


@R.query(f"select code, i::bigint as i, format('rag__{{}}__{{:05d}}__v', code, i) as custom_id from (values {LANG_VALUES}) l(code, n, t), range(0, 40) r(i)")
def gen_grid(spark, sf_dir):
    return languages.grid(spark, 40).select("code", "i", F.format_string("rag__%s__%05d__v", "code", "i").alias("custom_id"))


@R.query("""select doc_id, array_to_string(list_distinct(list_concat(a, b)).list_sort(), ',') as all_words, array_to_string(list_distinct(a).list_sort(), ',') as distinct_words,
            len(list_intersect(a, b)) as common, len(list_filter(a, lambda x: not list_contains(b, x))) = 0 as subset
            from (select doc_id, w[1:len(w) - len(w) // 3] as a, w[len(w) // 3 + 1:len(w)] as b from (select doc_id, regexp_extract_all(text, '[\\p{L}\\p{N}_]+') as w from documents))""".replace("\\\\", "\\"))
def array_sets(spark, sf_dir):
    """The first and the last two thirds of a document's words (of nine words: 1 to 6 and 4 to 9)."""
    rows = docs(spark, sf_dir).select("doc_id", X.words(F.col("text")).alias("w"))
    third = F.floor(F.size("w") / 3).cast("int")
    rows = rows.select("doc_id", F.slice("w", F.lit(1), F.size("w") - third).alias("a"), F.slice("w", third + 1, F.size("w")).alias("b"))
    sorted_join = lambda c: F.array_join(F.array_sort(c), ",")
    return rows.select(
        "doc_id", sorted_join(F.array_union("a", "b")).alias("all_words"), sorted_join(F.array_distinct("a")).alias("distinct_words"),
        F.size(F.array_intersect("a", "b")).cast("long").alias("common"), (F.size(F.array_except("a", "b")) == 0).alias("subset"),
    )


DIST_BASE = f"select lang, {TASK_SQL.replace('{0}', TAGGED_SQL).replace('{1}', 'source')} as task, len({WORDS}) as tokens from documents"


def facts(spark, sf_dir):
    return docs(spark, sf_dir).select("lang", X.task_of(tagged(), F.col("source")).alias("task"), F.size(X.words(F.col("text"))).alias("tokens"))


def grouped(spark, sf_dir, *keys):
    return facts(spark, sf_dir).groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"), F.sum("tokens").alias("tokens"))


@R.query(f"select lang, count(*) as samples, sum(tokens)::bigint as tokens from ({DIST_BASE}) group by lang")
def dist_lang(spark, sf_dir):
    return grouped(spark, sf_dir, "lang")


@R.query(f"select task, count(*) as samples, sum(tokens)::bigint as tokens from ({DIST_BASE}) group by task")
def dist_task(spark, sf_dir):
    return grouped(spark, sf_dir, "task")


@R.query(f"select lang, task, count(*) as samples, sum(tokens)::bigint as tokens from ({DIST_BASE}) group by lang, task")
def dist_lang_task(spark, sf_dir):
    return grouped(spark, sf_dir, "lang", "task")


@R.query(f"select lang, task, grouping(lang, task)::int as level, count(*) as samples, sum(tokens)::bigint as tokens from ({DIST_BASE}) group by grouping sets ((lang), (task), (lang, task))")
def dist_sets(spark, sf_dir):
    return C.distribution(facts(spark, sf_dir), "lang", "task", F.col("tokens"))


STATUS = ["ok", "parse_failed", "validation_failed", "dup_exact", "dup_near", "ok", "ok"]
CELL_SQL = "select source as task, lang as language, ['ok', 'parse_failed', 'validation_failed', 'dup_exact', 'dup_near', 'ok', 'ok'][doc_id % 7 + 1] as status from documents"
COUNTERS_SQL = """count(*) as generated, count(*) filter (status = 'parse_failed') as parse_failed, count(*) filter (status = 'validation_failed') as validation_failed,
    count(*) filter (status in ('dup_exact', 'dup_near')) as dedup_dropped, count(*) filter (status = 'ok') as kept"""


def statuses(spark, sf_dir):
    status = F.element_at(F.array(*map(F.lit, STATUS)), (F.col("doc_id") % 7 + 1).cast("int"))
    return docs(spark, sf_dir).select("source", "lang", status.alias("status"))


@R.query(f"select task, language, {COUNTERS_SQL} from ({CELL_SQL}) group by task, language")
def cell_report(spark, sf_dir):
    return C.cell_report(statuses(spark, sf_dir), "source", "lang", "status").orderBy("task", "language")


@R.query(f"select {COUNTERS_SQL}, (select count(*) from documents where n_chars < 300) as warnings from ({CELL_SQL})")
def cell_totals(spark, sf_dir):
    """Totals of all cells; here a short text is a warning."""
    return C.cell_totals(C.cell_report(statuses(spark, sf_dir), "source", "lang", "status"), docs(spark, sf_dir).where("n_chars < 300"))


@R.query(f"select doc_id, {sql_hash01("'7|' || doc_id")} < 0.75 as english from documents")
def mix_choose(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", (X.hash01(F.lit("7"), F.col("doc_id").cast("string")) < 0.75).alias("english"))
