"""Queries for metrics, routing, losses and schedules, over ``embeddings``, ``labels`` and ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import schedules as S
from corpusmill.operators import metrics as M
from corpusmill.plans.base import Registry, read, sql_case

R = Registry()
V = "v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as l, list_transform(embedding[1:8], lambda x: x::double) as e from embeddings)"
LSE = "(list_max({0}) + ln(list_sum(list_transform({0}, lambda x: exp(x - list_max({0}))))))"
EXPERTS = f"with {V}, s as (select vec_id, e, {LSE.format('e')} as z from v), p as (select vec_id, i - 1 as expert, e[i] as x, exp(e[i] - z) as p from s, range(1, 9) r(i)), k as (select *, row_number() over (partition by vec_id order by x desc, expert) as rank from p)"
PROBS = f"with {V}, s as (select vec_id, l, {LSE.format('l')} as z from v), p as (select vec_id, i - 1 as token, exp(l[i] - z) as p from s, range(1, 65) r(i))"


def vectors(spark, sf_dir):
    x = F.col("embedding").cast("array<double>")
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", x.alias("l"), F.slice(x, 1, 8).alias("e"))


def r6(c):
    return F.round(c, 6)


LABELS = "l as (select doc_id, quality as t, case when doc_id % 3 = 0 then toxic else quality end as p from labels), c as (select unnest([0, 1]) as k), m as (select k, count(*) filter (t = k and p = k) as tp, count(*) filter (t <> k and p = k) as fp, count(*) filter (t = k and p <> k) as fn from l, c group by k)"


@R.query(f"""with {LABELS} select round(sum(tp) / sum(tp + fp), 6) as accuracy, round(avg(tp / (tp + fp)), 6) as macro_precision, round(avg(tp / (tp + fn)), 6) as macro_recall, round(avg(2 * tp / (2 * tp + fp + fn)), 6) as macro_f1,
    round(sum(tp) / sum(tp + fp), 6) as micro_precision, round(sum(tp) / sum(tp + fn), 6) as micro_recall, round(2 * sum(tp) / sum(2 * tp + fp + fn), 6) as micro_f1 from m""")
def cls_metrics(spark, sf_dir):
    rows = read(spark, sf_dir, "labels").select(F.col("quality").alias("t"), F.when(F.col("doc_id") % 3 == 0, F.col("toxic")).otherwise(F.col("quality")).alias("p"))
    found = M.classification(rows, "t", "p")
    return found.select(*[r6(c).alias(c) for c in found.columns])


@R.query("""with d as (select doc_id, list_distinct([doc_id % 3, doc_id % 5]) as t, list_distinct([doc_id % 3, doc_id % 7]) as p from documents),
    x as (select doc_id, unnest(t) as k, 1 as t from d), y as (select doc_id, unnest(p) as k, 1 as p from d),
    m as (select k, count(*) filter (t = 1 and p = 1) as tp, count(*) filter (t is null and p = 1) as fp, count(*) filter (t = 1 and p is null) as fn from x full join y using (doc_id, k) group by k),
    s as (select *, tp + fn as n from m where tp + fn > 0)
    select round(sum(n * (case when tp + fp > 0 then tp / (tp + fp) else 0 end)) / sum(n), 6) as precision, round(sum(n * tp / (tp + fn)) / sum(n), 6) as recall, round(sum(n * 2 * tp / (2 * tp + fp + fn)) / sum(n), 6) as f1 from s""")
def ml_metrics(spark, sf_dir):
    d = F.col("doc_id")
    found = M.multilabel(read(spark, sf_dir, "documents").select("doc_id", F.array(d % 3, d % 5).alias("t"), F.array(d % 3, d % 7).alias("p")), "doc_id", "t", "p")
    return found.select(*[r6(c).alias(c) for c in found.columns])


@R.query(f"with {V} select vec_id, round({LSE.format('l')}, 6) as lse from v")
def lse_rows(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", r6(M.log_sum_exp(F.col("l"))).alias("lse"))


@R.query(PROBS + " select vec_id, token, round(p, 6) as p from p")
def softmax_rows(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", F.posexplode(M.softmax(F.col("l"))).alias("token", "p")).select("vec_id", "token", r6("p").alias("p"))


@R.query(f"with {V} select vec_id, i - 1 as i, round(tanh(e[i] / 0.5) * 0.5, 6) as capped from v, range(1, 9) r(i)")
def softcap(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", F.posexplode("e").alias("i", "x")).select("vec_id", "i", r6(S.softcap(F.col("x"), 0.5)).alias("capped"))


XENT = f"with {V}, x as (select vec_id, case when vec_id % 10 = 0 then -100 else label end as target, {LSE.format('l')} - l[label + 1] as nll from v)"


def nll(spark, sf_dir):
    return M.cross_entropy(vectors(spark, sf_dir).withColumn("target", F.when(F.col("vec_id") % 10 == 0, -100).otherwise(F.col("label"))), "l", "target")


@R.query(XENT + " select vec_id, case when target <> -100 then round(nll, 6) end as nll from x")
def xent_rows(spark, sf_dir):
    return nll(spark, sf_dir).select("vec_id", r6("nll").alias("nll"))


@R.query(XENT + " select round(avg(nll), 6) as mean, round(sum(nll), 4) as total, count(*) as n from x where target <> -100")
def xent_mean(spark, sf_dir):
    return nll(spark, sf_dir).where("target <> -100").agg(r6(F.avg("nll")).alias("mean"), F.round(F.sum("nll"), 4).alias("total"), F.count("nll").alias("n"))


@R.query(f"with {V} select i - 1 as class, round(avg(l[i]), 6) as mean_logit from v, range(1, 65) r(i) group by i")
def logit_avg(spark, sf_dir):
    return vectors(spark, sf_dir).select(F.posexplode("l").alias("class", "x")).groupBy("class").agg(r6(F.avg("x")).alias("mean_logit")).orderBy("mean_logit", "class")


@R.query(f"with {V} select a.vec_id, c.vec_id as class, round(list_sum(list_transform(range(1, 65), lambda i: a.l[i] * c.l[i])), 6) as logit from v a, v c where c.vec_id < 20")
def logits_cross(spark, sf_dir):
    """Hidden states times 20 class vectors: the class side is bounded by the number of classes, hence broadcast."""
    v = vectors(spark, sf_dir)
    classes = v.where("vec_id < 20").select(F.col("vec_id").alias("class"), F.col("l").alias("w"))
    dot = F.aggregate(F.zip_with("l", "w", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    return v.crossJoin(F.broadcast(classes)).select("vec_id", "class", r6(dot).alias("logit"))


@R.query(EXPERTS + " select vec_id, expert, rank from k where rank <= 2")
def topk_router(spark, sf_dir):
    return M.top_k(vectors(spark, sf_dir), "vec_id", "e", 2).select("vec_id", "expert", "rank")


LOAD = EXPERTS + ", ld as (select expert, sum((rank <= 2)::int) / count(*) / 2.0 as load, avg(p) as prob from k group by expert)"


def load(spark, sf_dir):
    return M.expert_load(vectors(spark, sf_dir), "vec_id", "e", 2)


@R.query(LOAD + " select expert, round(load, 6) as load, round(prob, 6) as prob from ld")
def moe_load(spark, sf_dir):
    return load(spark, sf_dir).select("expert", r6("load").alias("load"), r6("prob").alias("prob"))


@R.query(LOAD + " select round(8 * sum(load * prob), 6) as aux from ld")
def moe_aux(spark, sf_dir):
    return load(spark, sf_dir).agg(r6(8 * F.sum(F.col("load") * F.col("prob"))).alias("aux"))


@R.query(EXPERTS + ", b as (select vec_id % 4 as layer, expert, sum((rank <= 2)::int) / count(*) / 2.0 as load, avg(p) as prob from k group by all), a as (select layer, 8 * sum(load * prob) as aux from b group by layer) select round(avg(aux), 6) as aux, count(*) as layers from a")
def moe_layers(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    by = M.expert_load(rows.withColumn("layer", F.col("vec_id") % 4), "vec_id", "e", 2, "layer")
    return by.groupBy("layer").agg((8 * F.sum(F.col("load") * F.col("prob"))).alias("aux")).agg(r6(F.avg("aux")).alias("aux"), F.count(F.lit(1)).alias("layers"))


@R.query(LOAD + " select round(-sum(greatest(load, 1e-12) * ln(greatest(load, 1e-12))) / ln(8), 4) as entropy, round(max(load), 4) as max_load from ld")
def router_entropy(spark, sf_dir):
    p = F.greatest("load", F.lit(1e-12))
    return load(spark, sf_dir).agg(F.round(-F.sum(p * F.log(p)) / F.log(F.lit(8.0)), 4).alias("entropy"), F.round(F.max("load"), 4).alias("max_load"))


@R.query(f"with {V} select vec_id, array_to_string(list_transform([5, 1, 7], lambda i: round(e[i + 1], 6)::decimal(12, 6)::varchar), ' ') as chosen from v")
def expert_select(spark, sf_dir):
    chosen = F.transform(F.array(F.lit(5), F.lit(1), F.lit(7)), lambda i: F.element_at("e", i + 1).cast("decimal(12,6)").cast("string"))
    return vectors(spark, sf_dir).select("vec_id", F.array_join(chosen, " ").alias("chosen"))


@R.query(PROBS + ", c as (select *, sum(p) over (partition by vec_id order by p desc, token rows unbounded preceding) as cum from p), n as (select vec_id, token, p from c where cum - p <= 0.6) select vec_id, token, round(p / sum(p) over (partition by vec_id), 6) as p from n")
def nucleus(spark, sf_dir):
    return M.nucleus(vectors(spark, sf_dir), "vec_id", "l", 0.6).select("vec_id", "token", r6("p").alias("p"))


@R.query(f"with {V} select vec_id, list_position(l, list_max(l)) - 1 as token from v")
def greedy_pick(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", (F.array_position("l", F.array_max("l")) - 1).alias("token"))


REL = f"with {V}, x as (select vec_id % 30 as layer, l[i] as r, l[i] * (1 + (vec_id % 5) * 0.3) as v from v, range(1, 65) q(i)), y as (select layer, sqrt(sum((v - r) * (v - r))) / sqrt(sum(r * r)) as rel from x group by grouping sets ((layer), ()))"


def relative(spark, sf_dir):
    rows = vectors(spark, sf_dir).select((F.col("vec_id") % 30).alias("layer"), "vec_id", F.explode("l").alias("r"))
    return M.relative_l2(rows, "layer", F.col("r") * (1 + (F.col("vec_id") % 5) * F.lit(0.3)), F.col("r"))


@R.query(REL + " select layer, round(rel, 6) as rel, rel > 0.5 as flagged from y where layer is null or layer in (select layer from y where layer is not null order by round(rel, 9) desc, layer limit 10)")
def rel_l2(spark, sf_dir):
    """The ten layers of 30 that deviate most, and all together."""
    found = relative(spark, sf_dir).withColumn("rel", F.round("rel", 9))
    return M.worst_layers(found).select("layer", r6("rel").alias("rel"), "flagged")


@R.query(XENT + ", s as (select vec_id % 4 as shard, avg(nll) as loss from x where target <> -100 group by shard) select round(avg(loss), 6) as loss, count(*) as shards from s")
def mean_of_means(spark, sf_dir):
    shards = nll(spark, sf_dir).where("target <> -100").groupBy(F.col("vec_id") % 4).agg(F.avg("nll").alias("loss"))
    return shards.agg(r6(F.avg("loss")).alias("loss"), F.count(F.lit(1)).alias("shards"))


@R.query("select i * 10 as step, round(0.8::double + (0.2::double - 0.8::double) * 0.5 * (1 - cos(pi() * least(1.0, i * 10 / 1000.0::double))), 6) as scheduled, 0.8::double as fixed, 0.5::double as even from range(0, 121) r(i)")
def sampling_schedule(spark, sf_dir):
    steps = spark.range(121).select((F.col("id") * 10).alias("step"))
    s = F.col("step")
    return steps.select("step", r6(S.sampling_weight(0.8, 0.2, s, 1000, True)).alias("scheduled"), S.sampling_weight(0.8, 0.2, s, 1000, False).alias("fixed"), S.sampling_weight(2.0, 2.0, s, 1000, True).cast("double").alias("even"))


@R.query("select i * 10 as step, round(case when i * 10 < 100 then 6e-4::double * (i * 10 + 1) / 101 when i * 10 > 1000 then 6e-5::double else 6e-5::double + 0.5 * (1 + cos(pi() * (i * 10 - 100) / 900.0::double)) * (6e-4::double - 6e-5::double) end, 9) as lr from range(0, 121) r(i)")
def lr_schedule(spark, sf_dir):
    s = F.col("step")
    return spark.range(121).select((F.col("id") * 10).alias("step")).select("step", F.round(S.learning_rate(s, 6e-4, 6e-5, 100, 1000), 9).alias("lr"))


NAMES = ["NVIDIA H100 80GB HBM3", "NVIDIA H100 PCIe", "Tesla T4", "NVIDIA A10G", "GeForce RTX 4090", "unknown card"]
KNOWN = sorted(S.PEAK_TFLOPS.items(), key=lambda kv: (-len(kv[0]), kv[0]))
PEAK_SQL = sql_case([(f"contains(upper(name), '{k}')", f"{v}::double") for k, v in KNOWN], "null")
NAMES_SQL = f"select i, [{', '.join(repr(n) for n in NAMES)}][i + 1] as name from range(0, 6) r(i)"


@R.query(f"select i, name, {PEAK_SQL} as tflops from ({NAMES_SQL})")
def gpu_peak(spark, sf_dir):
    names = spark.createDataFrame(list(enumerate(NAMES)), "i long, name string")
    return names.select("i", "name", S.gpu_peak(F.col("name")).alias("tflops"))


@R.query(f"""with g as (select i, {PEAK_SQL} as peak, 12 + i as layers, 768.0::double as width, 64000.0::double as vocab, 4096.0::double as block, (i % 2) * 4 as experts, 1024.0::double as moe, i * 0.5::double as s, 1048576.0::double as tok from ({NAMES_SQL})),
    f as (select *, 3.0 * (layers * (8.0 * width * width + 4.0 * width * block + case when experts > 0 then 4.0 * width * moe * experts else 16.0 * width * width end) + 2.0 * width * vocab) as flops from g)
    select i, round(flops / 1e6, 3) as mflops, round(case when s <= 0 then 0 else flops * tok / s / 4 / 1e12 end, 4) as tflops, round(case when s > 0 and peak > 0 then flops * tok / s / (peak * 1e12 * 4) end, 6) as mfu from f""")
def mfu(spark, sf_dir):
    i = F.col("i")
    rows = spark.createDataFrame(list(enumerate(NAMES)), "i long, name string").withColumn("peak", S.gpu_peak(F.col("name")))
    rows = rows.withColumn("flops", S.flops_per_token(12 + i, F.lit(768.0), F.lit(64000.0), F.lit(4096.0), i % 2 * 4, F.lit(1024.0)))
    args = (F.col("flops"), F.lit(1048576.0), i * 0.5, F.lit(4))
    return rows.select("i", F.round(F.col("flops") / 1e6, 3).alias("mflops"), F.round(S.achieved_tflops(*args), 4).alias("tflops"), r6(S.mfu(*args, F.col("peak"))).alias("mfu"))
