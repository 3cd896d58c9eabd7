"""Queries for near dedup inside language cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import neardup as N
from corpusmill.plans.base import WORD, Registry, read

R = Registry()
UNIQUE = f"""with recursive base as (select doc_id, lang, sha256(lower(text)) as fp, regexp_extract_all(lower(text), '{WORD}') as w from documents),
    uq as (select * from base qualify row_number() over (partition by lang, fp order by doc_id) = 1),
    sh as (select distinct doc_id, lang, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from uq),
    n as (select doc_id, count(*) as n from sh group by doc_id),
    c as (select a.lang, a.doc_id as a, b.doc_id as b, count(*) as c from sh a join sh b on a.lang = b.lang and a.s = b.s and a.doc_id < b.doc_id group by all),
    j as (select c.lang, c.a, c.b, c.c / (x.n + y.n - c.c)::double as jaccard from c join n x on x.doc_id = c.a join n y on y.doc_id = c.b)"""


def keep_sql(t: float) -> str:
    return (
        UNIQUE
        + f""", e as (select a, b from j where jaccard >= {t} - 1e-12), nb as (select b, list(a) as xs, row_number() over (order by b) as k from e group by b),
    walk as (select 0::bigint as k, []::bigint[] as dropped union all
             select nb.k, case when len(list_filter(nb.xs, lambda x: not list_contains(w.dropped, x))) > 0 then list_append(w.dropped, nb.b) else w.dropped end from walk w join nb on nb.k = w.k + 1),
    gone as (select unnest(dropped) as doc_id from (select dropped from walk order by k desc limit 1))"""
    )


def rows(spark, sf_dir):
    return N.prepared(read(spark, sf_dir, "documents"), F.col("lang"), "doc_id", F.col("text"))


@R.query(UNIQUE + " select lang, a, b, round(jaccard, 6) as jaccard from j where jaccard >= 0.5 - 1e-12")
def near_dup_pairs(spark, sf_dir):
    found = N.pairs(N.unique(rows(spark, sf_dir)), 0.5)
    return found.select(N.cell_value().alias("lang"), "a", "b", F.round("jaccard", 6).alias("jaccard"))


@R.query(keep_sql(0.5) + " select doc_id from uq where doc_id not in (select doc_id from gone)")
def near_dup_keep(spark, sf_dir):
    prepared = rows(spark, sf_dir)
    return N.status(prepared, N.pairs(N.unique(prepared), 0.5)).where("status = 'kept'").select(F.col("id").alias("doc_id"))


@R.query(keep_sql(0.8) + """ select b.doc_id, case when u.doc_id is null then 'dup_exact' when b.doc_id in (select doc_id from gone) then 'dup_near' else 'kept' end as status
    from base b left join uq u on u.doc_id = b.doc_id""")
def dedup_cell(spark, sf_dir):
    prepared = rows(spark, sf_dir)
    return N.status(prepared, N.pairs(N.unique(prepared), 0.8)).select(F.col("id").alias("doc_id"), "status")
