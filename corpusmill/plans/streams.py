"""Queries over token streams made of ``documents``: one file per source, one closing id per document."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import tokens as K
from corpusmill.plans.base import WORD, Registry, read

R = Registry()
KEEP = 2000
IDS_SQL = f"list_transform(regexp_extract_all(text, '{WORD}'), lambda w: 10 + (('0x' || substr(md5(w), 1, 8))::ubigint % 65000)::int)"
DOCS_SQL = f"d as (select doc_id, source as file, list_append({IDS_SQL}, 0) as ids from documents), o as (select *, (sum(len(ids)) over (partition by file order by doc_id) - len(ids))::bigint as start from d)"
TOK = f"with {DOCS_SQL}, u as (select file, doc_id, start, unnest(range(1, len(ids) + 1)) as i, ids from o), tok as (select file, doc_id, start + i - 1 as pos, ids[i] as token from u)"
TRANSLATE, MARKER, TAGS = [3], [5], [5, 7]
FLAGS = ", tag as (select *, token <> 0 and token % 53 = 3 as is_t, token <> 0 and token % 53 = 5 as is_m, token <> 0 and token % 53 in (5, 7) as is_g from tok)"
SEG = (
    TOK
    + FLAGS
    + """, w as (select *, min(case when token = 0 then pos end) over f as e, min(case when is_g then pos end) over f as g, count(*) filter (is_m) over p as m0, count(*) filter (is_t) over p as t0
        from tag where token = 0 or is_t or is_g
        window f as (partition by file order by pos rows between 1 following and unbounded following), p as (partition by file order by pos rows between unbounded preceding and 1 preceding)),
    seg as (select a.file, a.pos as t, a.e, b.m0 - a.m0 as markers, b.t0 - a.t0 - 1 as nested, case when a.g < a.e then a.g end as tag from w a left join w b on b.file = a.file and b.pos = a.e where a.is_t)"""
)
JUDGED = (
    SEG
    + f""", kinds as (select *, case when e is null then 'unterminated' when tag = t + 1 then 'empty_source' when e = tag + 1 then 'empty_target' when markers > 0 then 'qualifying' else 'untouched' end as kind from seg),
    judged as (select *, case when kind = 'qualifying' then rn end as rank, case when kind <> 'qualifying' then kind when rn <= {KEEP} then 'kept' else 'deleted' end as verdict
        from (select *, count(*) filter (kind = 'qualifying') over (order by file, t) as rn from kinds))"""
)
RANGES = (
    JUDGED
    + """, doomed as (select file, t as s, e as z from judged where verdict in ('empty_source', 'empty_target', 'deleted')),
    isl as (select *, sum(n) over (partition by file order by s, z rows unbounded preceding) as island from (select *, case when s > max(z) over (partition by file order by s, z rows between unbounded preceding and 1 preceding) + 1 then 1 when row_number() over (partition by file order by s, z) = 1 then 1 else 0 end as n from doomed)),
    ranges as (select file, min(s) as start, max(z) as "end", count(*) - 1 as merged from isl group by file, island)"""
)


def packed(spark, sf_dir, closing=1):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("file"), "text")
    return rows.select("doc_id", "file", K.token_ids(F.col("text"), closing).alias("ids"))


def placed(spark, sf_dir):
    return K.placed(packed(spark, sf_dir))


def stream(spark, sf_dir):
    return K.stream(placed(spark, sf_dir))



def coded(tokens):
    """The stream with tags coded as small ids, so that sets of tags stay short: 1 opening, 2 marker, 3 other tag."""
    t = F.col("token")
    return tokens.withColumn("token", F.when(t == 0, 0).when(t % 53 == 3, 1).when(t % 53 == 5, 2).when(t % 53 == 7, 3).otherwise(t))


def segs(spark, sf_dir, rows=None):
    return K.segments(coded(K.stream(rows or placed(spark, sf_dir))), [1], [2], tags=[2, 3])


def judged(spark, sf_dir, rows=None):
    return K.judged_segments(segs(spark, sf_dir, rows), KEEP)


def ranges(spark, sf_dir, rows=None):
    return K.delete_ranges(judged(spark, sf_dir, rows))


def lengths(rows):
    return rows.groupBy("file").agg(F.sum(F.size("ids").cast("long")).alias("length"))


def spans(spark, sf_dir, rows):
    return K.keep_spans(ranges(spark, sf_dir, rows), lengths(rows))


@R.query(f"select doc_id, array_to_string(list_concat({IDS_SQL}, [0, 0]), ' ') as ids, len({IDS_SQL}) + 2 as len from documents")
def tokenize_pack(spark, sf_dir):
    ids = K.check_ids(K.token_ids(F.col("text")))
    rows = read(spark, sf_dir, "documents").select("doc_id", ids.alias("ids"))
    return rows.select("doc_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"), F.size("ids").cast("long").alias("len"))


@R.query(f"with {DOCS_SQL} select file, doc_id, start, len(ids) as len from o")
def pack_offsets(spark, sf_dir):
    return placed(spark, sf_dir).select("file", "doc_id", "start", F.size("ids").cast("long").alias("len"))


@R.query(TOK + " select file, pos, token from tok")
def flatten_ids(spark, sf_dir):
    return stream(spark, sf_dir).select("file", "pos", "token")


@R.query(TOK + " select file, pos, token from tok where token % 53 in (3, 5, 7) and token <> 0")
def tag_positions(spark, sf_dir):
    return stream(spark, sf_dir).where(F.col("token") != 0).where((F.col("token") % 53).isin(3, 5, 7)).select("file", "pos", "token")


@R.query(TOK + " select file, count(*) as n from tok where token <> 0 and token % 53 = 3 group by file")
def tag_count(spark, sf_dir):
    return K.tag_positions(coded(stream(spark, sf_dir)), [1]).groupBy("file").agg(F.count(F.lit(1)).alias("n"))


SEQ = "with recursive " + TOK.removeprefix("with ") + """, r as (select file, pos, token % 3 as token from tok where token <> 0),
    hit as (select a.file, a.pos, row_number() over (partition by a.file order by a.pos) as rn from r a join r b on b.file = a.file and b.pos = a.pos + 1 and b.token = 1 join r c on c.file = a.file and c.pos = a.pos + 2 and c.token = 1 where a.token = 1),
    far as (select file, rn, pos, (select min(h.rn) from hit h where h.file = hit.file and h.rn > hit.rn and h.rn <= hit.rn + 3 and h.pos >= hit.pos + 3) as nxt from hit),
    walk as (select file, rn, nxt from far where rn = 1 union all select f.file, f.rn, f.nxt from walk w join far f on f.file = w.file and f.rn = w.nxt)
    select file, count(*) as n from walk group by file"""


@R.query(SEQ)
def tag_count_seq(spark, sf_dir):
    """Matches of (1, 1, 1) in ids mod 3, which overlap themselves."""
    thirds = stream(spark, sf_dir).where("token <> 0").withColumn("token", F.col("token") % 3)
    return K.count_sequence(thirds, [1, 1, 1])


@R.query(TOK + " select file, pos, (sum((token = 0)::int) over (partition by file order by pos) - (token = 0)::int)::bigint as doc_seq from tok")
def doc_seq(spark, sf_dir):
    return K.document_number(stream(spark, sf_dir)).select("file", "pos", "doc_seq")


@R.query(f"with {DOCS_SQL} select file, unnest(range(start, start + len(ids)))::bigint as i, start as first from o")
def doc_causal_pairs(spark, sf_dir):
    """Mask of all positions of all documents, as ranges: its pairs are quadratic."""
    return K.causal_ranges(placed(spark, sf_dir))


WINDOW_STARTS = ", n as (select file, max(pos) + 1 as n from tok group by file), starts as (select file, k, (('0x' || substr(md5('11|' || file || '|' || k), 1, 8))::ubigint % (n - 65))::bigint as start from n, range(0, 4) r(k) where n > 65)"


def sampled(tokens):
    """(file, k, start): four windows of each file that is long enough."""
    n = tokens.groupBy("file").agg((F.max("pos") + 1).alias("n")).where("n > 65")
    starts = n.select("file", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"), "n")
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("11"), "file", F.col("k").cast("string"))), 1, 8), 16, 10).cast("long")
    return starts.select("file", "k", (draw % (F.col("n") - 65)).alias("start"))


@R.query(TOK + WINDOW_STARTS + ", y as (select file, pos, token as x, lead(token) over (partition by file order by pos) as y from tok) select s.file, s.start, y.pos, y.x, y.y from starts s join y on y.file = s.file and y.pos >= s.start and y.pos < s.start + 64")
def block_windows(spark, sf_dir):
    tokens = stream(spark, sf_dir)
    return K.windows(tokens, sampled(tokens).select("file", "start"), 64)


@R.query(SEG + " select file, t, e from seg")
def seg_pair(spark, sf_dir):
    return segs(spark, sf_dir).select("file", "t", "e")


@R.query(SEG + " select file, t, markers from seg")
def seg_marker(spark, sf_dir):
    return segs(spark, sf_dir).select("file", "t", "markers")


@R.query(SEG + " select file, t, nested from seg")
def seg_nested(spark, sf_dir):
    return segs(spark, sf_dir).select("file", "t", "nested")


@R.query(SEG + " select file, t, tag from seg")
def seg_first_tag(spark, sf_dir):
    return segs(spark, sf_dir).select("file", "t", "tag")


@R.query(JUDGED + " select file, t, rank, verdict from judged")
def seg_thin(spark, sf_dir):
    return judged(spark, sf_dir).select("file", "t", "rank", "verdict")


@R.query(RANGES + ' select file, start, "end", merged from ranges')
def seg_ranges(spark, sf_dir):
    return ranges(spark, sf_dir)


SPANS = RANGES + """, ends as (select file, start, "end" from ranges union all select file, max(pos) + 1, max(pos) + 1 from tok group by file),
    spans as (select file, coalesce(lag("end") over (partition by file order by start) + 1, 0) as start, start as stop from ends)"""


@R.query(SPANS + " select * from spans where start < stop")
def seg_keep_spans(spark, sf_dir):
    return spans(spark, sf_dir, placed(spark, sf_dir)).select("file", "start", "stop")


@R.query(SPANS + " select t.file, row_number() over (partition by t.file order by t.pos) - 1 as new_pos, t.token from tok t join spans s on t.file = s.file and t.pos >= s.start and t.pos < s.stop")
def seg_rewrite(spark, sf_dir):
    rows = placed(spark, sf_dir)
    return K.rewrite(rows, spans(spark, sf_dir, rows))


@R.query(
    RANGES
    + """ select count(*) as segments, count(*) filter (verdict in ('kept', 'deleted')) as qualifying, count(*) filter (verdict = 'kept') as kept, count(*) filter (verdict = 'deleted') as deleted,
    count(*) filter (verdict = 'empty_source') as empty_source, count(*) filter (verdict = 'empty_target') as empty_target, count(*) filter (verdict = 'unterminated') as trailing_unterminated, count(*) filter (verdict = 'untouched') as untouched,
    (select count(*) from ranges) as ranges, (select sum(merged)::bigint from ranges) as merged, (select sum("end" - start + 1)::bigint from ranges) as deleted_tokens, (select count(*) from tok) as input_tokens, (select count(*) from tok) - (select sum("end" - start + 1)::bigint from ranges) as output_tokens from judged"""
)
def seg_stats(spark, sf_dir):
    rows = placed(spark, sf_dir)
    found = judged(spark, sf_dir, rows)
    return K.segment_stats(found, K.delete_ranges(found), lengths(rows))


@R.query(JUDGED + " select file, t, e, verdict from judged where verdict in ('empty_source', 'empty_target') order by file, t limit 20")
def seg_examples(spark, sf_dir):
    return judged(spark, sf_dir).where("verdict in ('empty_source', 'empty_target')").orderBy("file", "t").limit(20).select("file", "t", "e", "verdict")
