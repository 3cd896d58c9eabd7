"""The queries of the training-data operators and, where SQL can say it, their oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import exact_dedup, language_id, lm_scoring, mixing, packing, quality_classifier, quality_rules, simhash, substring_dedup, warc
from corpusmill.llm.common import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"), keep="largest")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measure(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"), gibbs=True)


#: Target weights by source; a source that isn't named weighs 1.
MIX_WEIGHTS = {"src0": 4.0, "src1": 2.0, "src2": 2.0}


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS)
    return mixed.select("doc_id", "source", "text", "repetitions", "copy", "shuffle_key")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.with_digest(packing.pack(table(spark, sf_dir, "documents"), tokenizer_path()))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_language_id": op2_language_id,
        "op3_warc": op3_warc,
        "op4_mixing": op4_mixing,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_quality_rules": op6_quality_rules,
        "op7_quality_classifier": op7_quality_classifier,
        "op8_lm_scoring": op8_lm_scoring,
        "op9_simhash": op9_simhash,
        "op10_packing": op10_packing,
    }


MIX_CASE = "case source " + " ".join(f"when '{k}' then {v}" for k, v in MIX_WEIGHTS.items()) + " else 1.0 end"
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": f"""
            with t as (select doc_id, {LOWERED} as norm from documents)
            select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
                   doc_id = max(doc_id) over w as kept, sha256(norm) as text_sha256
            from t window w as (partition by norm)""",
        "op3_warc": """
            with p as (select page_id, url, coalesce(html, '') as html from pages),
            m as (select *, max(page_id) over (partition by html) as largest from p)
            select page_id, octet_length(encode(html)) as payload_bytes, sha1(html) as payload_digest,
                   case when octet_length(encode(html)) >= 1000 and page_id <> largest then 'revisit' else 'response' end as record_type,
                   case when octet_length(encode(html)) >= 1000 and page_id <> largest then largest end as refers_to, url
            from m""",
        "op4_mixing": f"""
            with sizes as (select source, sum(length(coalesce(text, '')))::double as size from documents group by source),
            weighed as (select *, {MIX_CASE} as weight from sizes where size > 0),
            rates as (select source, (select sum(size) from sizes) * weight / (select sum(weight) from weighed) / size as rate from weighed),
            terms as (select source, rate, k, -rate + case when k = 0 then 0 else
                        sum(case when k = 0 then 0 else ln(rate) - ln(k) end) over (partition by source order by k) end as log_p
                      from (select source, rate, unnest(range(0, (rate + 12 * sqrt(rate))::bigint + 30)) as k from rates)),
            cdf as (select source, k, sum(exp(log_p)) over (partition by source order by k) as c from terms),
            drawn as (select *, ('0x' || substr(md5('42:' || doc_id), 1, 13))::ubigint::double / 4503599627370496 as u from documents),
            times as (select d.doc_id, d.source, d.text, d.u,
                        (select count(*) from cdf where cdf.source is not distinct from d.source and cdf.c <= d.u)::int as repetitions from drawn d),
            copies as (select doc_id, source, text, repetitions, unnest(range(1, repetitions + 1))::int as copy from times)
            select *, substr(md5('42:' || doc_id || ':' || copy), 1, 16) as shuffle_key from copies""",
    }
