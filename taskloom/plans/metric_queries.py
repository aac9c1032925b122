"""Metrics (A1-A19) over predictions made from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskloom.operators import joins, metrics, qa
from taskloom.plans import base
from taskloom.plans.registry import query

_CCC = """select episode, case when vp < 1e-8 or vg < 1e-8 then 0 else 2 * c / (vp + vg + power(mp - mg, 2) + 1e-8) end as score from
    (select episode, count(*) as n, var_pop(p) as vp, var_pop(g) as vg, covar_pop(p, g) as c, avg(p) as mp, avg(g) as mg from pc group by episode) where n >= 2"""
_EPR = """select episode, log2(max(k)) as score from (select episode, k from (select episode, k, count(distinct floor(greatest(0, least(100, p)) / 100.0 / (1.0::double / k))) as u
    from pr, range(1, 1001) t(k) group by episode, k) where (1.0::double / k) * u >= 0.5) where episode in (select episode from pr group by episode having count(*) >= 2) group by episode"""
_KT = """select a.episode, 2 * sum(sign(a.g - b.g) * sign(a.p - b.p)) / (any_value(n) * (any_value(n) - 1)) as score from pr a join pr b on a.episode = b.episode and a.seq < b.seq
    join (select episode, count(*)::double as n from pr group by episode) c on c.episode = a.episode group by a.episode"""
_VOC = """select episode, case when vt = 0 or vr = 0 then 0 else c / sqrt(vt * vr) end as score from (select episode, count(*) as n, covar_pop(t, r) as c, var_pop(t) as vt, var_pop(r) as vr from
    (select episode, cast(row_number() over (partition by episode order by g, seq) as double) as t, rank() over (partition by episode order by p) + (count(*) over (partition by episode, p) - 1) / 2.0 as r from pr) group by episode) where n >= 2"""
_MCC = """select (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) + 1e-8) as mcc from (select cast(count(*) filter (p >= 95 and g >= 95) as double) as tp,
    cast(count(*) filter (p < 95 and g < 95) as double) as tn, cast(count(*) filter (p >= 95 and g < 95) as double) as fp, cast(count(*) filter (p < 95 and g >= 95) as double) as fn from pr)"""


def _scored(sql: str) -> str:
    return f"with {base.PREDICTIONS} select episode, round(score, 6) as score from ({sql})"


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(_scored(_CCC))
def a1_ccc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.episode_ccc(base.predictions(spark, sf_dir)), "score")


@query(f"with {base.PREDICTIONS} select episode, round(bp / bg, 6) as score from (select episode, count(*) as n, count(distinct round_even(p / 5.0, 0) * 5) as bp, count(distinct round_even(g / 5.0, 0) * 5) as bg from pc where g > 0 and g < 100 group by episode) where n >= 2")
def a2_ubr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.ubr(base.predictions(spark, sf_dir)), "score")


@query(_scored(_EPR))
def a3_epr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.episode_epr(base.predictions(spark, sf_dir)), "score")


@query(f"with {base.PREDICTIONS} select round(mcc, 6) as mcc from ({_MCC})")
def a4_mcc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.mcc(base.predictions(spark, sf_dir)), "mcc")


@query(_scored(_KT))
def a5_kendall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.episode_kendall(base.predictions(spark, sf_dir)), "score")


@query(_scored(_VOC))
def a6_voc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.episode_voc(base.predictions(spark, sf_dir)), "score")


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segmentation texts in tenths of frames: the runs of an episode's sub-tasks as truth; as prediction these without every fifth
    run and with each border moved by up to 3, or all borders, moved by 7 a border more than the one before.  Predictions have a
    model's slips by turns: cut off, single-quoted with an apostrophe, fenced, with a trailing comma."""
    from taskloom.operators.sequence import runs

    r = runs(base.frames(spark, sf_dir), ["episode"], "sub_task")
    one = F.struct(F.col("start").alias("a"), (F.col("end") - 1).alias("b"), F.col("island").alias("i"))
    rows = r.groupBy("episode").agg(F.sort_array(F.collect_list(one)).alias("all"))
    part = lambda a, b: F.format_string('{"d": "x", "start_frame": %d, "end_frame": %d}', a, b)
    near = lambda x: 10 * x + x % 7 - 3
    borders = F.array_sort(F.array_distinct(F.flatten(F.transform("all", lambda s: F.array(s["a"], s["b"])))))
    turn = F.pmod(F.col("episode"), F.lit(4))
    moved = F.transform(F.filter("all", lambda s: s["i"] % 5 != 4), lambda s: part(near(s["a"]), near(s["b"])))
    far = F.transform(borders, lambda x, k: part(10 * x + 7 * (k + 1), 10 * x + 7 * (k + 1)))
    gt = F.concat(F.lit("["), F.array_join(F.transform("all", lambda s: part(10 * s["a"], 10 * s["b"])), ", "), F.lit("]"))
    rows = rows.select("episode", gt.alias("gt_txt"), F.array_join(F.when(turn == 3, far).otherwise(moved), ", ").alias("p"), turn.alias("turn"))
    quoted = F.concat(F.lit("[{'d': 'the man's cup'}, "), F.translate("p", '"', "'"), F.lit("]"))
    cut_off = F.concat(F.lit("["), F.expr("left(p, length(p) - 1)"))
    fenced = F.concat(F.lit("So:\n```json\n["), F.col("p"), F.lit("]\n```"))
    pred = F.when(F.col("turn") == 0, cut_off).when(F.col("turn") == 1, quoted).when(F.col("turn") == 2, fenced).otherwise(F.concat(F.lit("["), F.col("p"), F.lit(",]")))
    return rows.select((-1 - F.col("episode")).alias("seq"), "episode", pred.alias("pred_txt"), "gt_txt")


_BOUNDARIES = f"""{base.FRAMES}, h as (select *, lag(sub_task) over (partition by episode order by frame_id) as before from fr), s as (select *, sum(case when frame_id > 0 and before = sub_task then 0 else 1 end) over (partition by episode order by frame_id) as run from h),
    r as (select episode, run, min(frame_id) as a, max(frame_id) as b from s group by episode, run), g as (select episode, a as x from r union select episode, b from r), n as (select episode, count(*) as n, max(x) - min(x) as span from g group by episode)"""
#: True borders are ten apart or more and the predicted ones of three turns at most three from theirs, so the cheapest matching pairs each with its
#: own; the fourth turn has as many borders as the truth, and of those the cheapest order-preserving matching pairs them by rank.
_SEGMENT_SCORES = f"""{_BOUNDARIES}, pb as (select episode, a as x from r where run % 5 <> 0 union select episode, b from r where run % 5 <> 0),
    e as (select episode, abs(x % 7 - 3)::double as err from pb where episode % 4 <> 3 union all select episode, (7 * row_number() over (partition by episode order by x))::double from g where episode % 4 = 3),
    j as (select n.episode, n, err, err <= 5.0::double / 100.0::double * (10 * span)::double as ok from n join e using (episode)),
    q as (select episode, n, count(*) as m, count(*) filter (ok) as tp, coalesce(sum(err) filter (ok), 0) as es from j group by episode, n)"""


@query(f"with {_BOUNDARIES} select episode, n as n_boundaries, 10 * span as span from n")
def a7_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boundaries that A7 takes from a text."""
    rows = _segments(spark, sf_dir)
    numbers = F.transform(F.from_json("gt_txt", "array<struct<start_frame:bigint,end_frame:bigint>>"), lambda s: F.array(s["start_frame"], s["end_frame"]))
    all_ = F.array_distinct(F.flatten(numbers))
    return rows.select("episode", F.size(all_).cast("long").alias("n_boundaries"), (F.array_max(all_) - F.array_min(all_)).alias("span"))


@query(f"with {_SEGMENT_SCORES} select -1 - episode as seq, episode, tp, m - tp as fp, n - tp as fn, tp as matched_count, es as err_sum, round(2 * tp / (m + n)::double, 9) as f1, case when tp > 0 then round(es / tp, 9) else 0.0 end as mae from q")
def a7_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.segmentation(_segments(spark, sf_dir)).drop("pred_txt", "gt_txt").withColumns({c: F.round(c, 9) for c in ("f1", "mae")})


_SEGMENT_TOTALS = "select 'BF1@5' as metric, 2 * sum(tp) / sum(m + n)::double as value from q union all select 'mMAE', case when sum(tp) > 0 then sum(es) / sum(tp) else 0.0 end from q"


@query(f"with {_SEGMENT_SCORES} select metric, round(value, 9) as value from ({_SEGMENT_TOTALS})")
def a8_segmentation_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.segmentation_totals(metrics.segmentation(_segments(spark, sf_dir))).withColumn("value", F.round("value", 9))


@query("""with e as (select vec_id, label, embedding::double[] as v from embeddings), f as (select label, min(vec_id) as head from e group by label)
    select e.vec_id, round(greatest(0, least(1, list_cosine_similarity(e.v, h.v))), 5) as similarity from e join f using (label) join e h on h.vec_id = f.head""")
def a10_label_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = base.table(spark, sf_dir, "embeddings")
    heads = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("head"))
    return e.join(joins.bounded(heads), "label").select("vec_id", F.round(metrics.cosine(F.col("embedding"), F.col("head")), 5).alias("similarity"))


@query()
def a9_soft_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SA over phrase lists that are embeddings of a label against those of the label after it, ten at most of each."""
    e = base.table(spark, sf_dir, "embeddings").withColumn("g", F.floor(F.col("vec_id") / 10))
    lists = e.groupBy("label", "g").agg(F.collect_list("embedding").alias("vs"))
    other = lists.select((F.col("label") - 1).alias("label"), "g", F.col("vs").alias("ws"))

    return metrics.phrase_scores(lists.join(other, ["label", "g"]), "vs", "ws")


#: Of a segmentation text the first number counts for the MCC, as for every row; here all are below the threshold on both sides.
_ALL_MCC = _MCC.replace("(p < 95 and g < 95) as double)", "(p < 95 and g < 95) + (select count(*) from q) as double)")


@query(f"""with {base.PREDICTIONS}, {_SEGMENT_SCORES[len(base.FRAMES) + 2 :]}, m as ({_SEGMENT_TOTALS} union all select 'MCC@95', mcc from ({_ALL_MCC}) union all select 'CCC', coalesce(avg(score), 0) from ({_CCC})
    union all select 'EPR@50', coalesce(avg(score), 0) from ({_EPR}) union all select 'VOC', coalesce(avg(score), 0) from ({_VOC}) union all select 'KT', coalesce(avg(score), 0) from ({_KT}))
    select metric, round(value, 6) as value from m union all select 'average', round(avg(value), 6) from m""")
def a11_overall_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress and segmentation rows of every episode, and a plan of each, which no metric but the MCC looks at (it states no number)."""
    segments = _segments(spark, sf_dir)
    plans = segments.select((F.col("seq") * 1000).alias("seq"), "episode", F.lit("pick it up").alias("pred_txt"), F.lit("pick it").alias("gt_txt"))
    return _rounded(metrics.overall(base.predictions(spark, sf_dir).unionByName(segments).unionByName(plans), average=True), "value")


@query("select count(distinct source) as datasets, count(distinct source || '/' || cast(doc_id // 10 as varchar)) as episodes, count(*) as frames from documents")
def a12_dataset_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = base.table(spark, sf_dir, "documents")
    per = d.groupBy("source", F.floor(F.col("doc_id") / 10).alias("e")).agg(F.count("*").alias("n"))
    return per.groupBy("source").agg(F.count("*").alias("e"), F.sum("n").alias("n")).agg(F.count("*").alias("datasets"), F.sum("e").alias("episodes"), F.sum("n").alias("frames"))


@query(f"""with {base.FRAMES}, h as (select *, lag(task) over (partition by episode order by frame_id) as before from fr), s as (select *, sum(case when frame_id > 0 and before = task then 0 else 1 end) over (partition by episode order by frame_id) as run from h),
    r as (select episode, count(*) as n from s group by episode, run)
    select episode, count(*) as n, round(avg(n), 6) as mean, min(n) as least, max(n) as most, list_sort(list(n))[len(list(n)) // 2 + 1] as upper_median, cast(sum(ceil(n / ceil(n / 8.0))) as bigint) as sampled from r group by episode""")
def a13_segment_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from taskloom.operators.sequence import bounded_samples, runs

    r = runs(base.frames(spark, sf_dir), ["episode"], "task").withColumn("n", F.col("end") - F.col("start"))
    ordered = F.sort_array(F.collect_list("n"))
    a = r.groupBy("episode").agg(F.count("*").alias("n"), F.round(F.avg("n"), 6).alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"), ordered.alias("_o"), F.sum(F.size(bounded_samples(F.col("start"), F.col("end"), 8))).alias("sampled"))
    return a.withColumn("upper_median", F.get("_o", F.floor(F.size("_o") / 2).cast("int"))).drop("_o")


@query("""select source, count(*) as total, count(distinct case when quality = 1 then l.doc_id end) as covered, round(count(distinct case when quality = 1 then l.doc_id end) / count(*)::double, 6) as ratio
    from documents d left join labels l using (doc_id) group by rollup (source)""")
def a14_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.table(spark, sf_dir, "documents").select("doc_id", "source").join(base.table(spark, sf_dir, "labels"), "doc_id", "left")
    a = rows.rollup("source").agg(F.count("*").alias("total"), F.count_distinct(F.when(F.col("quality") == 1, F.col("doc_id"))).alias("covered"))
    return a.withColumn("ratio", F.round(F.col("covered") / F.col("total"), 6))


@query("select cluster, dataset, count(*) as n_rows, sum(num_tokens) as tokens, count(*) filter (num_tokens > 4000) as long_rows from (select lang as cluster, source as dataset, n_chars as num_tokens from documents) group by rollup (cluster, dataset)")
def a16_token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.token_totals(base.qa(spark, sf_dir), 4000)


@query(f"""with {base.FRAMES}, n as (select episode, task, count(*) as n from fr group by episode, task)
    select episode, count(*) as n_tasks, count(*) > 1 as multi_task, bool_or(n < 10) as has_short from n group by episode""")
def a17_odd_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = base.frames(spark, sf_dir).groupBy("episode", "task").agg(F.count("*").alias("n"))
    return n.groupBy("episode").agg(F.count("*").alias("n_tasks"), (F.count("*") > 1).alias("multi_task"), F.bool_or(F.col("n") < 10).alias("has_short"))


@query("""select cust as o_custkey, o_orderkey from (select o_custkey as cust, o_orderkey, row_number() over (partition by o_custkey order by n desc, o_orderkey) as i from
    (select o_custkey, o_orderkey, (select count(*) from lineitem where l_orderkey = o_orderkey) as n from orders)) where i = 1""")
def a18_most_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = base.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("l_linenumber").alias("bboxes"))
    o = base.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").join(items, "o_orderkey", "left")
    o = o.withColumn("bboxes", F.coalesce("bboxes", F.array().cast("array<int>")))
    return joins.most_boxes(o, ["o_custkey"], seq="o_orderkey").select("o_custkey", "o_orderkey")


@query("with l as (select user_id % 8 as worker, count(*) as frames from events group by 1) select round((max(frames) - min(frames)) / min(frames)::double, 6) as skew from l")
def a19_balance_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    loads = base.table(spark, sf_dir, "events").groupBy((F.col("user_id") % 8).alias("worker")).agg(F.count("*").alias("frames"))
    return _rounded(qa.balance_skew(loads), "skew")


@query(f"""with {base.PREDICTIONS}, n as (select episode, avg(score) as value from ({_VOC}) group by episode) select episode, 'VOC' as metric, round(value, 6) as value, 0.0 as recorded from n where abs(value) > 1e-3""")
def j13_recovered_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = metrics.episode_voc(base.predictions(spark, sf_dir)).select("episode", F.lit("VOC").alias("metric"), F.col("score").alias("value"))
    old = new.select("episode", "metric", F.lit(0.0).alias("value"))
    return _rounded(metrics.compared(new, old, ["episode"]), "value")
