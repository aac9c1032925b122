"""Sequence operators (W1-W25) and frame access (S3, S4, S13) over frames made from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskloom.functions.hashing import uniform
from taskloom.operators import sequence as sq
from taskloom.plans import base
from taskloom.plans.base import FRAMES, REAL
from taskloom.plans.registry import query

EP = ["episode"]


def _islands(value: str, name: str = "run") -> str:
    """CTEs h_, s_: fr with the number of the run of equal values."""
    return f"""h_{name} as (select *, lag({value}) over (partition by episode order by frame_id) as _b from fr),
    s_{name} as (select * exclude (_b), cast(sum(case when frame_id > 0 and _b is not distinct from {value} then 0 else 1 end) over (partition by episode order by frame_id) - 1 as bigint) as {name} from h_{name})"""


_SIM = "(1 - abs(value - lag(value) over (partition by episode order by frame_id)) / 1000)"


def _with_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = base.frames(spark, sf_dir)
    return f.withColumn("similarity", 1 - F.abs(F.col("value") - F.lag("value").over(sq.ordered(EP))) / 1000)


@query("with n as (select user_id as episode, count(*) as n from events group by 1) select episode, n, cast(sum(n) over (order by episode) - n as bigint) as first_index, cast(sum(n) over (order by episode) as bigint) as end_index from n")
def w1_frame_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sq.frame_offsets(base.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("episode")).agg(F.count("*").alias("n")))


@query("with n as (select user_id as episode, count(*) as n from events group by 1), o as (select episode, cast(sum(n) over (order by episode) - n as bigint) as first_index, cast(sum(n) over (order by episode) as bigint) as end_index from n) select * from o")
def w2_episode_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = base.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("episode")).agg(F.count("*").alias("n"))
    return sq.frame_offsets(n).drop("n")


def _global(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = base.frames(spark, sf_dir)
    o = sq.frame_offsets(f.groupBy("episode").agg(F.count("*").alias("n")))
    return f.join(o.select("episode", "first_index"), "episode").withColumn("global_index", F.col("first_index") + F.col("frame_id"))


_GLOBAL = f"{FRAMES}, n as (select episode, count(*) as n from fr group by episode), o as (select episode, cast(sum(n) over (order by episode) - n as bigint) as first_index from n), gl as (select fr.*, first_index, first_index + frame_id as global_index from fr join o using (episode))"


@query(f"with {_GLOBAL}, h as (select *, lag(task) over (partition by episode order by global_index) as b from gl), s as (select *, sum(case when frame_id > 0 and b = task then 0 else 1 end) over (partition by episode order by global_index) as r from h) select episode, task, min(global_index) as start, max(global_index) + 1 as \"end\" from s group by episode, r, task")
def w3_task_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sq.borders(_global(spark, sf_dir), EP, "task", "global_index").drop("island")


@query(f"with {FRAMES}, {_islands('sub_task')} select episode, run as island, sub_task, min(frame_id) as start, max(frame_id) + 1 as \"end\" from s_run group by all")
def w4_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sq.runs(base.frames(spark, sf_dir), EP, "sub_task")


@query(f"""with {FRAMES}, {_islands('sub_task')}, r as (select episode, run, sub_task, min(frame_id) as a from s_run group by all), n as (select episode, count(*) as len, count(distinct task) as t, any_value(task) as task from fr group by episode),
    p as (select episode, array_to_string(list(sub_task order by a), '>') as plan, count(*) filter ({REAL.format('sub_task')}) as n_real from r group by episode)
    select episode, len, task, plan, n_real from n join p using (episode) where t = 1 and n_real > 0""")
def w4_episode_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sq.episode_stats(base.frames(spark, sf_dir), EP)
    return s.select("episode", "len", "task", F.array_join("plan", ">").alias("plan"), F.size("real_splits").cast("long").alias("n_real"))


@query(f"with {FRAMES.replace('user_id as episode', 'user_id as episode, event_id % 2 as camera').replace('partition by user_id', 'partition by user_id, event_id % 2')}, h as (select *, lag(task) over (partition by episode, camera order by frame_id) as b from fr) select episode, camera, frame_id, cast(sum(case when frame_id > 0 and b = task then 0 else 1 end) over (partition by episode, camera order by frame_id) - 1 as bigint) as split from h")
def w5_camera_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    from taskloom.operators.boxes import camera_splits

    e = base.table(spark, sf_dir, "events").select(F.col("user_id").alias("episode"), (F.col("event_id") % 2).alias("camera_key"), "ts", "event_id")
    f = e.withColumn("frame_id", (F.row_number().over(Window.partitionBy("episode", "camera_key").orderBy("ts", "event_id")) - 1).cast("long"))
    rows = camera_splits(f.withColumn("task_desc", F.concat(F.lit("task "), F.floor(F.col("frame_id") / 20).cast("string"))))
    return rows.select("episode", F.col("camera_key").alias("camera"), "frame_id", "split")


@query(f"""with {FRAMES}, {_islands('task')}, x as (select a.episode, a.frame_id, b.sub_task, max(b.frame_id) as l from s_run a join s_run b on a.episode = b.episode and a.run = b.run and b.frame_id >= a.frame_id and b.sub_task not in ('done', 'not done', '') group by all)
    select fr.episode, fr.frame_id, coalesce(string_agg(x.sub_task, '>' order by l), '') as plan from fr left join x using (episode, frame_id) group by all""")
def w6_planned_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sq.planned_actions(base.frames(spark, sf_dir), EP).select("episode", "frame_id", F.array_join("planned_actions", ">").alias("plan"))


@query(f"""with {FRAMES}, {_islands('task')}, a as (select *, case when sub_task <> '' and sub_task not in ('done', 'not done') then sub_task end as st from s_run),
    b as (select *, last_value(st ignore nulls) over (partition by episode, run order by frame_id rows between unbounded preceding and 1 preceding) as pv from a),
    x as (select *, sum(case when st is not null and st is distinct from pv then 1 else 0 end) over (partition by episode, run order by frame_id) as ix from b), r as (select episode, run, ix, st from x where st is not null and st is distinct from pv)
    select x.episode, x.frame_id, coalesce(string_agg(r.st, '>' order by r.ix), '') as remaining from x left join r on r.episode = x.episode and r.run = x.run and r.ix >= x.ix group by all""")
def w7_remaining_sub_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sq.remaining_sub_tasks(base.frames(spark, sf_dir), EP).select("episode", "frame_id", F.array_join("remaining", ">").alias("remaining"))


@query(f"""with {FRAMES}, v as (select episode, frame_id, case when event_id % 3 = 0 then cast(k as bigint) else -1 end as x from fr)
    select episode, frame_id, coalesce(last_value(nullif(x, -1) ignore nulls) over (partition by episode order by frame_id rows unbounded preceding), first_value(nullif(x, -1) ignore nulls) over (partition by episode order by frame_id rows between unbounded preceding and unbounded following), x) as x from v""")
def w8_forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = base.frames(spark, sf_dir).select("episode", "frame_id", F.when(F.col("event_id") % 3 == 0, F.col("k").cast("long")).otherwise(F.lit(-1).cast("long")).alias("x"))
    return sq.forward_fill(f, EP, "x")


def _parsed_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.frames(spark, sf_dir).select("episode", "frame_id", F.when(F.col("event_id") % 4 != 0, F.col("k")).alias("parsed_progress"))


@query(f"""with {FRAMES}, v as (select episode, frame_id, case when event_id % 4 <> 0 then k end as parsed_progress from fr)
    select *, coalesce(last_value(parsed_progress ignore nulls) over (partition by episode order by frame_id rows unbounded preceding), 0.0) as progress, case when parsed_progress is null then 'previous' else 'model' end as progress_source from v""")
def w9_carry_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sq.carry_progress(_parsed_progress(spark, sf_dir), EP)


@query(f"with {FRAMES} select episode, frame_id, array_to_string(list_transform(range(frame_id - 3, frame_id + 1), lambda i: greatest(i, 0)), ',') as win from fr")
def w10_clamped_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sq.clamped_window(base.frames(spark, sf_dir), EP, "frame_id", 4)
    return rows.select("episode", "frame_id", F.array_join(F.transform("window", lambda x: x.cast("string")), ",").alias("win"))


@query(f"""with {FRAMES}, n as (select episode, cast(count(*) as integer) as n from fr group by episode), s as (select episode, n, list_distinct(list_transform(range(0, 16), lambda i: cast(round_even(i * ((n - 1) / 15.0::double), 0) as integer))) as xs from n)
    select episode, array_to_string(case when n <= 16 then range(0, n)::integer[] else list_sort(xs) end, ',') as idx from s""")
def w11_uniform_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = base.frames(spark, sf_dir).groupBy("episode").agg(F.count("*").cast("int").alias("n"))
    return n.select("episode", F.array_join(F.transform(sq.uniform_indices(F.col("n"), F.lit(16)), lambda x: x.cast("string")), ",").alias("idx"))


_SEGMENTS = f"{FRAMES}, {_islands('task')}, sg as (select episode, run, min(frame_id) as a, max(frame_id) + 1 as b from s_run group by all)"


@query(f"with {_SEGMENTS} select episode, a, array_to_string(range(a, b, greatest(1, ceil((b - a) / 6.0))::bigint), ',') as idx from sg")
def w12_bounded_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = sq.runs(base.frames(spark, sf_dir), EP, "task")
    return r.select("episode", F.col("start").alias("a"), F.array_join(F.transform(sq.bounded_samples(F.col("start"), F.col("end"), 6), lambda x: x.cast("string")), ",").alias("idx"))


@query(f"""with {_SEGMENTS}, t as (select *, greatest(1, least((b - a) // 4, 3)) as st from sg), u as (select *, case when ceil((b - a) / st::double) > 5 then ceil((b - a) / 5.0)::bigint else st end as stp from t)
    select episode, a, array_to_string(range(a, b, stp), ',') as idx from u""")
def w13_stepped_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = sq.runs(base.frames(spark, sf_dir), EP, "task")
    return r.select("episode", F.col("start").alias("a"), F.array_join(F.transform(sq.stepped_samples(F.col("start"), F.col("end"), 3, 4, 5), lambda x: x.cast("string")), ",").alias("idx"))


@query(f"""with {FRAMES}, d as (select episode, frame_id, {base.uniform_sql('episode', 'frame_id')} as u from fr)
    select episode, frame_id, array_to_string(case when u < 0.3 then [frame_id] else range(greatest(frame_id - cast(4 + floor((u - 0.3) / 0.7 * 13) as bigint), 0), frame_id + 1) end, ',') as idx from d""")
def w14_previous_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = base.frames(spark, sf_dir)
    ids = sq.previous_frames(F.col("frame_id"), uniform(F.col("episode"), F.col("frame_id")))
    return f.select("episode", "frame_id", F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("idx"))


@query(f"with {FRAMES}, {_islands('sub_task')}, c as (select *, count(*) over (partition by episode, run) as n, row_number() over (partition by episode, run order by frame_id) - 1 as i from s_run) select episode, frame_id, sub_task from c where i >= n - greatest(1, floor(n * 0.25))")
def w15_run_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sq.run_tails(base.frames(spark, sf_dir), EP, "sub_task").select("episode", "frame_id", "sub_task")


@query(f"""with {FRAMES}, {_islands('sub_task')}, c as (select *, count(*) over (partition by episode, run) as n, row_number() over (partition by episode, run order by frame_id) - 1 as i from s_run),
    t as (select *, row_number() over (partition by episode, run order by {base.uniform_sql('episode', 'frame_id')}, frame_id) as place from c where i >= n - greatest(1, floor(n * 0.2))) select episode, frame_id, sub_task from t where place <= 5""")
def w15_sampled_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sq.run_tails(base.frames(spark, sf_dir), EP, "sub_task", share=0.2, most=5).select("episode", "frame_id", "sub_task")


@query(f"""with recursive {FRAMES}, f as (select episode, frame_id, sub_task as t, (event_id * 2654435761) % 4294967296 & 15 as h from fr),
    r as (select episode, frame_id, cast(null as bigint) as ref, frame_id as kf, t as kt, h as kh from f where frame_id = 0
    union all select f.episode, f.frame_id, case when f.t = kt and 1 - bit_count(xor(f.h, kh)) / 64.0 > 0.97 then kf end, case when f.t = kt and 1 - bit_count(xor(f.h, kh)) / 64.0 > 0.97 then kf else f.frame_id end,
        case when f.t = kt and 1 - bit_count(xor(f.h, kh)) / 64.0 > 0.97 then kt else f.t end, case when f.t = kt and 1 - bit_count(xor(f.h, kh)) / 64.0 > 0.97 then kh else f.h end
        from r join f on f.episode = r.episode and f.frame_id = r.frame_id + 1) select episode, frame_id, ref from r""")
def w16_keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = base.frames(spark, sf_dir).withColumn("phash", (F.pmod(F.col("event_id") * 2654435761, F.lit(4294967296))).bitwiseAND(15))
    return sq.keyframes(f.withColumnRenamed("sub_task", "task_description"), EP, similarity=0.97).select("episode", "frame_id", "ref")


_MOTION = f"{FRAMES}, d as (select *, case when frame_id = 0 then 0 else 1.5 - {_SIM} end as dd from fr)"


@query(f"with {_MOTION} select episode, frame_id, round(case when sum(dd) over (partition by episode) = 0 then 0 else dd / sum(dd) over (partition by episode) end, 9) as r from d")
def w17_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sq.motion(_with_similarity(spark, sf_dir), EP).select("episode", "frame_id", F.round("r", 9).alias("r"))


@query(f"""with {FRAMES}, {_islands('sub_task')}, d as (select *, {REAL.format('sub_task')} as ok, 1 - abs(value - lag(value) over (partition by episode order by frame_id)) / 1000 as sim, row_number() over (partition by episode, run order by frame_id) as i, count(*) over (partition by episode, run) as n from s_run),
    e as (select *, case when i = 1 then 0 else 1.5 - sim end as dd from d), g as (select *, case when sum(dd) over (partition by episode, run) = 0 then 0 else dd / sum(dd) over (partition by episode, run) end as r,
        sum(case when ok then 1 else 0 end) over (partition by episode) as t, sum(case when ok and i = 1 then 1 else 0 end) over (partition by episode) as kk from e),
    p as (select *, case when ok then greatest(0.75, least(1.25, kk * n / t)) * r else 0 end as dp from g)
    select episode, frame_id, round(case when sum(dp) over (partition by episode) = 0 then 0 else coalesce(sum(dp) over (partition by episode order by frame_id rows between unbounded preceding and 1 preceding), 0) / sum(dp) over (partition by episode) end, 6) as progress_frac from p""")
def w18_progress_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sq.progress_label(_with_similarity(spark, sf_dir), EP)
    return rows.select("episode", "frame_id", F.round("progress_frac", 6).alias("progress_frac"))


@query(f"""with {FRAMES}, {_islands('task')}, h as (select episode, run as seg, frame_id, sub_task, lag(sub_task) over (partition by episode, run order by frame_id) is distinct from sub_task as hd from s_run),
    s as (select *, sum(case when hd then 1 else 0 end) over (partition by episode, seg order by frame_id) - 1 as idx from h), r as (select episode, seg, idx, sub_task, min(frame_id) as st, max(frame_id) + 1 as ed from s group by all),
    v as (select episode, seg, greatest(1, count(*) filter (sub_task <> '' and sub_task <> 'done')) as valid from r group by all), l as (select *, row_number() over (partition by episode, seg, sub_task order by idx desc) as back from r)
    select s.episode, s.frame_id, cast(least(100, trunc((l.idx / valid::double + ((s.frame_id - st) / greatest(1, ed - st)::double) / valid::double) * 100)) as integer) as progress_pct
    from s join l on l.episode = s.episode and l.seg = s.seg and l.sub_task = s.sub_task and back = 1 join v on v.episode = s.episode and v.seg = s.seg""")
def w19_progress_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sq.progress_estimate(base.frames(spark, sf_dir), EP).select("episode", "frame_id", "progress_pct")


@query("""with u as (select o_orderkey as e, o_orderkey % 7 as s0, cast(20 + o_orderkey % 11 as bigint) as n from orders),
    l as (select l_orderkey as e, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as i, 'act ' || (l_partkey % 9) as name, case when l_partkey % 5 = 0 then null else s0 + cast(l_quantity as bigint) % 20 end as c, s0, n from lineitem join u on e = l_orderkey),
    v as (select *, least(s0 + n - 1, c) as z from l where c is not null), k as (select e, count(*) as m, count(c) as ok from l group by e),
    f as (select u.e, s0 + g.g as frame_id, s0, n, m, ok from u join k on k.e = u.e, lateral (select unnest(range(0, n)) as g) g),
    x as (select f.e, frame_id, m, ok, arg_min(name, c * 1000 + i) as own, max(v2.z) as any_z from f left join v on v.e = f.e and v.z > frame_id left join (select e, max(z) as z from v group by e) v2 on v2.e = f.e group by f.e, frame_id, m, ok),
    q as (select e, arg_max(name, c * 1000 + i) as last_name from v group by e)
    select x.e as episode, frame_id, case when own is not null then own when m - ok < m / 2.0 then 'done' else coalesce(last_name, 'not done') end as sub_task from x left join q on q.e = x.e""")
def w20_labelled_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = base.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("episode"), (F.col("o_orderkey") % 7).alias("task_start"), (F.col("o_orderkey") % 7 + 20 + F.col("o_orderkey") % 11).alias("task_end"), F.lit("t").alias("task"), F.lit("").alias("overall_notes"))
    l = base.table(spark, sf_dir, "lineitem")
    s0 = F.col("l_orderkey") % 7
    done = F.when(F.col("l_partkey") % 5 != 0, s0 + F.col("l_quantity").cast("long") % 20)
    one = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.concat(F.lit("act "), (F.col("l_partkey") % 9).cast("string")).alias("name"), s0.alias("start_frame"), done.alias("complete_frame"))
    subs = l.groupBy(F.col("l_orderkey").alias("episode")).agg(F.sort_array(F.collect_list(one)).alias("s"))
    bare = F.transform("s", lambda x: F.struct(x["name"].alias("name"), x["start_frame"].alias("start_frame"), x["complete_frame"].alias("complete_frame")))
    return sq.labelled_frames(o.join(subs.select("episode", bare.alias("subtasks")), "episode"), ["episode"]).drop("task")


@query(f"with {FRAMES} select episode, frame_id, round(k / 100 * greatest(0, least(1, value / 100)), 9) as progress_frac from fr")
def w23_rescaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = base.frames(spark, sf_dir)
    return f.select("episode", "frame_id", F.round(sq.rescaled(F.col("k") / 100, F.col("value") / 100), 9).alias("progress_frac"))


@query(f"with {FRAMES}, {_islands('sub_task')} select episode, frame_id, min(frame_id) over (partition by episode, run) as run_start, greatest(frame_id - 8, 0) as n_start, greatest(frame_id - 15, 0) as s_start from s_run")
def w24_range_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = sq.range_back(base.frames(spark, sf_dir), EP).withColumnRenamed("range_start", "run_start")
    f = sq.range_back(f, EP, n=8).withColumnRenamed("range_start", "n_start")
    return sq.range_back(f, EP, seconds=0.5).select("episode", "frame_id", "run_start", "n_start", F.col("range_start").alias("s_start"))


@query(f"""with {FRAMES}, n as (select episode, count(*) as n from fr group by episode) select episode, array_to_string(list_filter(list_transform(range(0, 8), lambda i: cast(floor(n / 8.0::double / 2 + n / 8.0::double * i) as integer)), lambda x: x < n), ',') as mid,
    array_to_string(list_transform(range(0, 8), lambda i: cast(floor(i * n / 8.0::double) as integer)), ',') as low from n""")
def w25_midpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = base.frames(spark, sf_dir).groupBy("episode").agg(F.count("*").alias("n"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return n.select("episode", text(sq.midpoint_indices(F.col("n"), 8)).alias("mid"), text(sq.floor_indices(F.col("n"), 8)).alias("low"))


@query(f"with {_GLOBAL} select global_index, episode, frame_id, value from gl where global_index >= 1000 and global_index < 9000 and (global_index - 1000) % 7 = 0")
def s4_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sq.slice_frames(_global(spark, sf_dir), 1000, 9000, 7).select("global_index", "episode", "frame_id", "value")
