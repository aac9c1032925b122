"""Joins (J), filters (P), boxes (G, A15), question-answer operators (T), sinks and set operators (R) over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taskloom.functions import boxes as g
from taskloom.operators import boxes as bx
from taskloom.operators import inference, joins, qa
from taskloom.plans import base
from taskloom.plans.base import BOXES, FRAMES, QA, uniform_sql
from taskloom.plans.registry import query
from taskloom.sources import sinks, tables


@query("select o_orderkey, c_name as task, n_name as sub_task, coalesce(nullif(n_name, ''), c_name) as task_description from orders join customer on o_custkey = c_custkey left join nation on o_orderkey % 30 = n_nationkey")
def j1_task_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = base.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("task_index"), (F.col("o_orderkey") % 30).alias("sub_task_index"))
    tasks = base.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task_index"), F.col("c_name").alias("task"))
    subs = base.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("sub_task_index"), F.col("n_name").alias("sub_task"))
    return joins.with_tasks(f, tasks, subs).select("o_orderkey", "task", "sub_task", "task_description")


_NOTES = """nt as (select l_orderkey as e, l_linenumber as f, arg_max(l_comment, s) as note from (select l_orderkey, l_linenumber, l_partkey * 100000 + l_suppkey * 100 + l_quantity as s, 'n' || l_partkey as l_comment from lineitem) group by all)"""


@query(f"with {_NOTES}, gr as (select o_orderkey as e, unnest(range(1, 5)) as f from orders) select gr.e, gr.f, note from gr left join nt on gr.e = nt.e and gr.f = nt.f")
def j2_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = base.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("e"), F.explode(F.array(*map(F.lit, range(1, 5)))).alias("f"))
    l = base.table(spark, sf_dir, "lineitem")
    notes = l.select(F.col("l_orderkey").alias("e"), F.col("l_linenumber").alias("f"), F.concat(F.lit("n"), F.col("l_partkey").cast("string")).alias("note"), (F.col("l_partkey") * 100000 + F.col("l_suppkey") * 100 + F.col("l_quantity")).alias("seq"))
    return joins.overlay(grid, {"note": (notes, ["e", "f"])}).select(F.col("e"), F.col("f").cast("long").alias("f"), "note")


@query(f"with {FRAMES} select episode, frame_id, case when sub_task = 'done' then true when k >= 20 then false end as finished, case when sub_task <> 'done' and k >= 20 then cast(k as varchar) end as cot from fr")
def j4_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = base.frames(spark, sf_dir).withColumns({"cot": F.when(F.col("k") >= 20, F.col("k").cast("string")), "bboxes": F.array(F.lit(1)), "plan": F.array("task")})
    return joins.composite(f).select("episode", "frame_id", "composite.finished", F.col("composite.cot").alias("cot"))


@query(f"""with recursive {FRAMES}, x as (select episode, frame_id, case when event_id % 3 <> 0 and frame_id > 0 then frame_id - 1 when frame_id = 0 and episode % 5 = 0 then 100000 end as ref, value from fr),
    r as (select episode, frame_id, value from x where ref is null union all select x.episode, x.frame_id, r.value from x join r on x.episode = r.episode and x.ref = r.frame_id)
    select x.episode, x.frame_id, r.value from x left join r on x.episode = r.episode and x.frame_id = r.frame_id""")
def j5_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = base.frames(spark, sf_dir)
    ref = F.when((F.col("event_id") % 3 != 0) & (F.col("frame_id") > 0), F.col("frame_id") - 1).when((F.col("frame_id") == 0) & (F.col("episode") % 5 == 0), F.lit(100000).cast("long"))
    return joins.resolve_refs(f.select("episode", "frame_id", ref.alias("ref"), "value"), ["episode"], payload=["value"])


@query(f"""with {FRAMES}, h as (select episode, frame_id, case when event_id % 2 = 0 then 'ego' else 'exo' end as camera_key, sub_task from fr where k < 50), n as (select episode, count(*) as n from fr group by episode),
    gr as (select episode, f as frame_id, c as camera_key from n, lateral (select unnest(range(0, n)) as f), (values ('ego'), ('exo')) t(c))
    select gr.episode, gr.frame_id, gr.camera_key, case when h.episode is null then 'none' else h.sub_task end as sub_task from gr left join h using (episode, frame_id, camera_key)""")
def j6_densified(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = base.frames(spark, sf_dir)
    have = f.where("k < 50").select("episode", "frame_id", F.when(F.col("event_id") % 2 == 0, "ego").otherwise("exo").alias("camera_key"), "sub_task")
    n = f.groupBy("episode").agg(F.count("*").alias("n_frames"))
    return joins.densified(have, n, ["episode"], cameras=["ego", "exo"], fill={"sub_task": F.lit("none")})


@query("select o_orderkey as episode, o_custkey % 7 + 100 as start, case when o_orderkey % 2 = 0 then o_totalprice end as price from orders")
def j7_border_sub_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = base.table(spark, sf_dir, "orders")
    seg = o.select(F.col("o_orderkey").alias("episode"), (F.col("o_custkey") % 7 + 100).alias("start"), F.lit(100).cast("long").alias("first_index"))
    raw = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("episode"), (F.col("o_custkey") % 7).alias("task_start"), F.col("o_totalprice").alias("price"))
    return joins.border_sub_tasks(seg, raw).drop("first_index")


@query("select doc_id, source from documents where doc_id in (select doc_id from labels where quality = 1) and doc_id not in (select doc_id from labels where toxic = 1)")
def j8_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = base.table(spark, sf_dir, "labels")
    return joins.selected(base.table(spark, sf_dir, "documents").select("doc_id", "source"), ["doc_id"], l.where("quality = 1"), l.where("toxic = 1"))


@query(f"""with {FRAMES}, dn as (select episode, frame_id from fr where frame_id <> 3 + episode % 4 and k > -1 and event_id % 11 <> 0), c as (select episode, frame_id, row_number() over (partition by episode order by frame_id) - 1 as i from dn),
    u as (select episode, max(frame_id) as m from c where i = frame_id group by episode) select fr.episode, frame_id from fr left join u using (episode) where frame_id > coalesce(m, -1)""")
def p4_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = base.frames(spark, sf_dir)
    done = f.where("frame_id <> 3 + episode % 4 and event_id % 11 <> 0")
    return joins.unfinished(f.select("episode", "frame_id"), done, ["episode"])


@query("""with p as (select l_orderkey as o, arg_min(case l_linenumber % 3 when 0 then 'pick>place' when 1 then 'pick>done' else 'pick' end, l_partkey * 100000.0 + l_suppkey + l_quantity / 100) as plan from lineitem group by 1)
    select o_orderkey, coalesce(plan, 'No plan is available.') as plan from orders left join p on o_orderkey = o""")
def j9_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = base.table(spark, sf_dir, "lineitem")
    plan = F.when(F.col("l_linenumber") % 3 == 0, F.array(*map(F.lit, ("pick", "place", "Done.")))).when(F.col("l_linenumber") % 3 == 1, F.array(*map(F.lit, ("pick", "done")))).otherwise(F.array(F.lit("pick")))
    plans = l.select(F.col("l_orderkey").alias("o_orderkey"), plan.alias("plan"), (F.col("l_partkey") * 100000.0 + F.col("l_suppkey") + F.col("l_quantity") / 100).alias("seq"))
    rows = joins.plans_for(base.table(spark, sf_dir, "orders").select("o_orderkey"), plans, ["o_orderkey"])
    return rows.select("o_orderkey", F.array_join("plan", ">").alias("plan"))


@query(f"""with {BOXES}, s as (select * from bx), p as (select a.episode, a.frame_id as f1, a.box_no as b1, b.frame_id as f2, b.box_no as b2,
    0.5 * sqrt(power((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2, 2) + power((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2, 2)) / sqrt(2) + 0.5 * (1 - (greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))) /
    greatest(1e-8, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)))) as d
    from s a join s b on a.episode = b.episode and b.frame_id > a.frame_id) select episode, f1, b1, f2, b2, round(d, 6) as dist from p where d < 0.1""")
def j11_matched_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = base.boxed_frames(spark, sf_dir)
    one = f.select("episode", "frame_id", F.posexplode("bboxes").alias("n", "b")).select("episode", "frame_id", F.col("n").cast("long").alias("box_no"), "b.bbox_2d")
    return joins.boxes_matched(one, ["episode"]).withColumn("dist", F.round("dist", 6))


@query("""with e as (select distinct source as dataset, doc_id // 10 as episode from documents), f as (select distinct d.source as dataset, d.doc_id // 10 as episode, 'q' as c from documents d join labels using (doc_id) union select distinct source, doc_id // 10, 't' from documents where n_chars > 10)
    select e.dataset, cast((case when bool_and(q.episode is not null) then 2 else 0 end) + (case when bool_and(t.episode is not null) then 4 else 0 end) as integer) as status from e left join (select * from f where c = 'q') q on q.dataset = e.dataset and q.episode = e.episode left join (select * from f where c = 't') t on t.dataset = e.dataset and t.episode = e.episode group by e.dataset""")
def j12_complete_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = base.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("dataset"), F.floor(F.col("doc_id") / 10).alias("episode"), "n_chars")
    l = base.table(spark, sf_dir, "labels")
    files = d.join(l, "doc_id", "left_semi").select("dataset", "episode", F.lit("q").alias("category")).unionByName(d.where("n_chars > 10").select("dataset", "episode", F.lit("t").alias("category")))
    return joins.complete_datasets(d.select("dataset", "episode").distinct(), files, {"q": 2, "t": 4})


@query("select event_id, case when event_type = 'view' then 'known' else 'n' || length(event_type) end as result from events")
def j14_memo(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = base.table(spark, sf_dir, "events").select("event_id", "event_type", F.md5("event_type").alias("content_hash"))
    memo = spark.range(1).select(F.md5(F.lit("view")).alias("content_hash"), F.lit("known").alias("result"))
    infer = lambda df: df.withColumn("result", F.concat(F.lit("n"), F.length("event_type").cast("string")))
    return joins.memo_inference(e, memo, infer).select("event_id", "result")


@query(f"with {FRAMES} select episode, frame_id, coalesce(nullif(case when event_id % 3 = 0 then '' when event_id % 3 = 1 then sub_task end, ''), 'no sub-task') as sub_task from fr")
def j15_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id") % 3
    f = base.frames(spark, sf_dir).withColumn("sub_task", F.when(i == 0, "").when(i == 1, F.col("sub_task")))
    return joins.displayed(f, {"sub_task": F.lit("no sub-task")}).select("episode", "frame_id", "sub_task")


@query("select doc_id from documents where doc_id in (select doc_id from labels) and doc_id in (select doc_id from labels where quality = 1)")
def j16_all_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = base.table(spark, sf_dir, "labels")
    return joins.with_all(base.table(spark, sf_dir, "documents").select("doc_id"), [l, l.where("quality = 1")], ["doc_id"])


@query("with n as (select user_id as episode, count(*) as n from events where user_id % 4 <> 1 group by 1) select episode, cast(sum(n) over (order by episode) - n as bigint) as first_index from n")
def p3_skip_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from taskloom.operators.sequence import frame_offsets

    n = base.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("episode")).agg(F.count("*").alias("n"))
    left = joins.selected(n, ["episode"], without=n.where("episode % 4 = 1"))
    return frame_offsets(left).select("episode", "first_index")


@query(f"with {FRAMES}, h as (select *, lag(task) over (partition by episode order by frame_id) as b from fr), s as (select *, sum(case when frame_id > 0 and b = task then 0 else 1 end) over (partition by episode order by frame_id) as r from h) select episode, min(frame_id) as start, max(frame_id) + 1 as \"end\" from s group by episode, r having max(frame_id) + 1 - min(frame_id) >= 10")
def p5_short_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from taskloom.operators.sequence import runs

    return runs(base.frames(spark, sf_dir), ["episode"], "task").where(F.col("end") - F.col("start") >= 10).select("episode", "start", "end")


_AREA = "(greatest(0, x2 - x1) * greatest(0, y2 - y1) >= 0.4 or score < 0.005)"


@query(f"with {BOXES} select episode, frame_id, count(*) filter (not {_AREA}) as kept, count(*) filter ({_AREA}) as invalid from bx group by all")
def p7_stage1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bx.stage1_clean(base.boxed_frames(spark, sf_dir))
    return rows.select("episode", "frame_id", F.size("bboxes").cast("long").alias("kept"), F.size("invalid_bboxes").cast("long").alias("invalid"))


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, case when l_partkey % 4 = 0 then l_orderkey % 2 = 0 when l_partkey % 4 = 1 then true else false end as useless from lineitem""")
def p8_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("l_partkey") % 4
    label = F.when(m == 0, "Red Chair").when(m == 1, "My LAPTOP").when(m == 2, "desk lamp").otherwise("cup")
    label = F.when(m == 0, "Chair").otherwise(label)
    task = F.when(F.col("l_orderkey") % 2 == 0, "pick the cup").otherwise("Move the CHAIR")
    return base.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", g.useless(label, task).alias("useless"))


@query(f"with {BOXES} select episode, frame_id, count(*) filter (box_no not in (0, 2)) as kept, count(*) filter (box_no in (0, 2)) as dropped from bx group by all")
def p9_named_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bx.without_indices(base.boxed_frames(spark, sf_dir).withColumn("idx", F.array(F.lit(0), F.lit(2))), "idx")
    return rows.select("episode", "frame_id", F.size("bboxes").cast("long").alias("kept"), F.size("deprecated_bboxes").cast("long").alias("dropped"))


@query(f"""with {BOXES}, f as (select *, x2 < 0.5 and y2 < 0.5 as u, greatest(x2 - x1, y2 - y1) < 0.05 as t from bx), c as (select *, count(*) over w as n, sum(u::int) over w as nu, sum((u and t)::int) over w as nut from f window w as (partition by episode, frame_id))
    select episode, frame_id, count(*) filter (case when n <= 2 then true when n >= 8 then not u and not t when n >= 5 then not u when nu = n then false when nut >= 2 then not (u and t) when nu >= 3 then not u else true end) as kept from c group by all""")
def p10_upper_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.boxed_frames(spark, sf_dir).select("episode", "frame_id", F.size(g.upper_left_kept(F.col("bboxes"))).cast("long").alias("kept"))


@query(f"with {BOXES} select episode, frame_id, count(*) filter (label <> 'obj 3') as kept from bx group by all")
def p11_label_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.boxed_frames(spark, sf_dir).select("episode", "frame_id", F.size(g.without_label(F.col("bboxes"), "obj 3")).cast("long").alias("kept"))


@query("select conv_id, turn from conversations where turn % 2 = 0")
def p16_deleted_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = base.table(spark, sf_dir, "conversations").withColumn("desc", F.when(F.col("turn") % 2 == 1, " /delete ").otherwise(F.col("role")))
    return qa.without_deleted(c).select("conv_id", "turn")


_NEAR = """(0.75 * sqrt(power((a.x1 + a.x2 - b.x1 - b.x2) / 2, 2) + power((a.y1 + a.y2 - b.y1 - b.y2) / 2, 2)) / sqrt(2) + 0.25 * (1 - (greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))) /
    greatest(1e-8, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)))))"""


@query(f"with {BOXES} select a.episode, a.frame_id, a.box_no, round(min({_NEAR}), 6) as d from bx a join bx b on a.episode = b.episode and b.frame_id = a.frame_id + 1 group by all")
def g1_nearest_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = base.boxed_frames(spark, sf_dir)
    after = f.select("episode", (F.col("frame_id") - 1).alias("frame_id"), F.transform("bboxes", lambda b: b["bbox_2d"]).alias("ys"))
    one = f.select("episode", "frame_id", F.posexplode("bboxes").alias("box_no", "b")).join(after, ["episode", "frame_id"])
    return one.select("episode", "frame_id", F.col("box_no").cast("long").alias("box_no"), F.round(g.nearest_distance(F.col("b.bbox_2d"), F.col("ys")), 6).alias("d"))


@query(f"""with {BOXES} select a.episode, a.frame_id, a.box_no, round(min(0.25 * sqrt(power((a.x1 + a.x2 - b.x1 - b.x2) / 2, 2) + power((a.y1 + a.y2 - b.y1 - b.y2) / 2, 2)) / greatest(1e-8, sqrt(power(greatest(a.x2, b.x2) - least(a.x1, b.x1), 2) + power(greatest(a.y2, b.y2) - least(a.y1, b.y1), 2)))
    + 3 * ({_NEAR} - 0.75 * sqrt(power((a.x1 + a.x2 - b.x1 - b.x2) / 2, 2) + power((a.y1 + a.y2 - b.y1 - b.y2) / 2, 2)) / sqrt(2))), 6) as d from bx a join bx b on a.episode = b.episode and b.frame_id = a.frame_id + 1 group by all""")
def g2_enclosing_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = base.boxed_frames(spark, sf_dir)
    after = f.select("episode", (F.col("frame_id") - 1).alias("frame_id"), F.col("bboxes").alias("ys"))
    one = f.select("episode", "frame_id", F.posexplode("bboxes").alias("box_no", "b")).join(after, ["episode", "frame_id"])
    d = F.array_min(F.transform("ys", lambda y: g.enclosing_distance(F.col("b.bbox_2d"), y["bbox_2d"])))
    return one.select("episode", "frame_id", F.col("box_no").cast("long").alias("box_no"), F.round(d, 6).alias("d"))


@query(f"with {BOXES}, p as (select a.episode, a.frame_id, a.box_no, b.frame_id as f2, min({_NEAR}) as d from bx a join bx b on a.episode = b.episode and a.frame_id <> b.frame_id group by all) select episode, frame_id, box_no, round(avg(d), 6) as velocity from p group by all")
def g3_g4_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = bx.velocities(base.boxed_frames(spark, sf_dir), ["episode"])
    return v.select("episode", "frame_id", F.col("box_no").cast("long").alias("box_no"), F.round("velocity", 6).alias("velocity"))


@query()
def g5_g7_temporal_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bx.temporal_clean(base.boxed_frames(spark, sf_dir), ["episode"])
    return rows.select("episode", "frame_id", F.size("bboxes").alias("kept"), F.size("outlier_bboxes").alias("outliers"))


@query()
def w21_w22_interpolated_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bx.interpolated(base.boxed_frames(spark, sf_dir), ["episode"])
    return rows.select("episode", "frame_id", "label", F.transform("bbox_2d", lambda x: F.round(x, 9)).alias("bbox_2d"))


@query("""with b as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity * 25 - 50 as x1, l_discount * 9000 as y1, l_quantity * 25 + 10 as x2, l_discount * 9000 + l_linenumber * 100 - 100 as y2 from lineitem),
    n as (select *, greatest(0, least(x1 / 1000, 1)) as a, greatest(0, least(y1 / 1000, 1)) as b, greatest(0, least(x2 / 1000, 1)) as c, greatest(0, least(y2 / 1000, 1)) as d from b)
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when a < c and b < d then round(a + b + c + d, 6) end as total, case when a < c and b < d then round(greatest(a - 0.025, 0) + greatest(b - 0.025, 0) + least(c + 0.025, 1) + least(d + 0.025, 1), 6) end as padded from n""")
def g8_g9_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, d, n = F.col("l_quantity"), F.col("l_discount"), F.col("l_linenumber")
    box = g.normalized(F.array(q * 25 - 50, d * 9000, q * 25 + 10, d * 9000 + n * 100 - 100))
    total = lambda b: F.round(F.aggregate(b, F.lit(0.0), lambda s, x: s + x), 6)
    return base.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", total(box).alias("total"), total(g.padded(box)).alias("padded"))


@query("select event_id, 1 - bit_count(xor(event_id * 7919, user_id * 104729)) / 64.0::double as sim from events")
def g10_hash_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.table(spark, sf_dir, "events").select("event_id", g.hash_similarity(F.col("event_id") * 7919, F.col("user_id") * 104729).alias("sim"))


@query("select p_partkey, 320 as width, cast(trunc((100 + p_partkey % 300) * 320 / (200 + p_size * 7)::double) as integer) as height from part")
def g14_resized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.table(spark, sf_dir, "part").select("p_partkey", g.resized((200 + F.col("p_size") * 7).cast("double"), (100 + F.col("p_partkey") % 300).cast("double"), 320).alias("s")).select("p_partkey", "s.*")


@query(f"with {BOXES} select episode, frame_id, string_agg(label, '>' order by greatest(0, x2 - x1) * greatest(0, y2 - y1), box_no) as labels from bx group by all")
def g15_by_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.boxed_frames(spark, sf_dir).select("episode", "frame_id", F.array_join(F.transform(g.by_area(F.col("bboxes")), lambda b: b["label"]), ">").alias("labels"))


@query("""with o as (select i, j, i * j as n from range(1, 13) a(i), range(1, 13) b(j) where i * j <= 12), p as (select p_partkey, cast(200 + p_size * 20 as double) as w, cast(150 + p_partkey % 900 as double) as h from part),
    d as (select p_partkey, i, j, n, abs(w / h - i / j::double) as d, w * h > 0.5 * 448 * 448 * n as big from p, o), m as (select *, min(d) over (partition by p_partkey) as md from d), c as (select *, row_number() over (partition by p_partkey order by n, i, j) as first from m where d = md),
    b as (select p_partkey, i, j, row_number() over (partition by p_partkey order by case when big or first = 1 then 0 else 1 end, n desc, i desc, j desc) as r from c) select p_partkey, i as cols, j as rows from b where r = 1""")
def g16_tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = g.tile_grid((200 + F.col("p_size") * 20).cast("double"), (150 + F.col("p_partkey") % 900).cast("double"))
    return base.table(spark, sf_dir, "part").select("p_partkey", t.alias("t")).select("p_partkey", F.col("t.cols").cast("long").alias("cols"), F.col("t.rows").cast("long").alias("rows"))


@query(f"""with {BOXES}, f as (select episode, frame_id, count(*) filter (not {_AREA}) as k, count(*) filter ({_AREA}) as i from bx group by all) select episode, count(*) as frames, cast(sum(k) as bigint) as kept, cast(sum(i) as bigint) as removed, round(sum(k) / nullif(sum(k) + sum(i), 0), 6) as retention, round(count(*) filter (k > 0) / count(*)::double, 6) as coverage from f group by episode""")
def a15_box_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bx.box_statistics(bx.stage1_clean(base.boxed_frames(spark, sf_dir)), ["episode"])
    return rows.select("episode", "frames", "kept", "removed", F.round("retention", 6).alias("retention"), F.round("coverage", 6).alias("coverage"))


@query(f"with {BOXES}, f as (select episode, frame_id, count(*) as n_boxes from bx group by all) select n_boxes, count(*) as frames from f group by n_boxes")
def a15_box_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bx.box_histogram(base.boxed_frames(spark, sf_dir), []).select(F.col("n_boxes").cast("long").alias("n_boxes"), "frames")


def _qa_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    from taskloom.operators.sequence import ordered, planned_actions

    f = base.frames(spark, sf_dir).withColumn("task", F.lit("sort it"))
    f = planned_actions(f, ["episode"]).withColumns({"cot": F.lit("Look. All is in place. End."), "progress_frac": F.col("frame_id") / F.count("*").over(Window.partitionBy("episode")).cast("double")})
    last = F.lead("frame_id").over(ordered(["episode"])).isNull()
    return f.withColumn("progress_frac", F.when(last, 1.0).otherwise(F.col("progress_frac")))


_U = lambda *k: uniform_sql(*k)


@query(f"""with {FRAMES}, n as (select episode, count(*) as n from fr group by episode), m as (select episode, n, 8 + cast(floor({_U('episode', chr(39) + 'a' + chr(39))} * 9) as bigint) as most from n), st as (select *, greatest(1, ceil(n / most::double))::bigint as st from m),
    p as (select fr.episode, frame_id // st as s, sub_task from fr join st using (episode) where frame_id % st = 0), h as (select *, lag(sub_task) over (partition by episode order by s) as b from p), r as (select *, sum(case when s > 0 and b = sub_task then 0 else 1 end) over (partition by episode order by s) as run from h),
    g as (select episode, sub_task, min(s) as a, max(s) as z from r where sub_task <> 'done' group by episode, run, sub_task), i as (select episode, count(*) as images from p group by episode)
    select episode, images, string_agg('{{"action_description":"' || sub_task || '","start_frame":' || a || ',"end_frame":' || z || '}}', ',' order by a) as answer from g join i using (episode) group by all""")
def t1_segment_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = qa.run_handler("a", _qa_frames(spark, sf_dir), ["episode"], low=8, high=16)
    answer = F.get("conversations", F.lit(1))["value"]
    return rows.select("episode", F.size("image").cast("long").alias("images"), F.substring(answer, F.lit(2), F.length(answer) - 2).alias("answer"))


@query(f"""with {FRAMES}, n as (select episode, count(*) as n, cast(floor({_U('episode', chr(39) + 'a2' + chr(39))} * 3) as integer) as k from fr group by episode), h as (select *, lag(sub_task) over (partition by episode order by frame_id) as b from fr),
    s as (select *, sum(case when frame_id > 0 and b = sub_task then 0 else 1 end) over (partition by episode order by frame_id) as run from h), r as (select episode, row_number() over (partition by episode order by min(frame_id)) - 1 as i, min(frame_id) as a, max(frame_id) + 1 as z, count(*) over (partition by episode) as m from s where sub_task <> 'done' group by episode, run),
    pr as (select x.episode, x.a, y.z, row_number() over (partition by x.episode order by {_U('x.episode', chr(39) + 'pair' + chr(39), 'x.i', 'y.i')}, x.i, y.i) - 1 as extra from r x join r y on x.episode = y.episode and x.i <= y.i where not (x.i = 0 and y.i = x.m - 1)),
    e as (select n.episode, 0 as extra, 0 as a, n as z, 8 as low, 16 as high from n where k = 1 and episode in (select episode from r) union all select episode, extra, a, z, 4, 9 from pr join n using (episode) where k = 2 and extra < 2),
    st as (select *, greatest(1, ceil((z - a) / (low + floor({_U('episode', 'extra', chr(39) + 'most' + chr(39))} * (high - low + 1)))::double))::bigint as st from e),
    p as (select st.episode, extra, a, z, (frame_id - a) // st as j, sub_task from st join fr on fr.episode = st.episode and frame_id >= a and frame_id < z and (frame_id - a) % st = 0), c as (select episode, extra, a, z, count(*) as images from p group by all),
    q as (select *, lag(sub_task) over (partition by episode, extra order by j) as b from p), g as (select *, sum(case when j > 0 and b = sub_task then 0 else 1 end) over (partition by episode, extra order by j) as run from q),
    o as (select episode, extra, sub_task, min(j) as f, max(j) as l from g where sub_task <> 'done' group by episode, extra, run, sub_task)
    select episode, cast(extra as integer) as extra, cast(a as bigint) as start, cast(z as bigint) as "end", images, string_agg('{{"action_description":"' || sub_task || '","start_frame":' || f || ',"end_frame":' || l || '}}', ',' order by f) as answer from c join o using (episode, extra) group by all""")
def t1_segment_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = qa.segment_extras(_qa_frames(spark, sf_dir), ["episode"], whole=(8, 16), part=(4, 9))
    answer = F.get("conversations", F.lit(1))["value"]
    return rows.select("episode", "extra", "start", "end", F.size("image").cast("long").alias("images"), F.substring(answer, F.lit(2), F.length(answer) - 2).alias("answer"))


_END = f"""{FRAMES}, en as (select *, count(*) over (partition by episode) as n, case when frame_id = count(*) over (partition by episode) - 1 then 1.0 else frame_id / (count(*) over (partition by episode))::double end as pf from fr)"""


@query(f"""with {_END}, x as (select *, lead(pf) over (partition by episode order by frame_id) as npf, lead(sub_task) over (partition by episode order by frame_id) as ns from en)
    select episode, frame_id, {_U('episode', 'frame_id', chr(39) + 'bkind' + chr(39))} < 0.5 as one, npf >= 1 as finished from x where npf is not null and {_U('episode', 'frame_id', chr(39) + 'b' + chr(39))} >= 0.4""")
def t2_next_action_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = qa.run_handler("b", _qa_frames(spark, sf_dir), ["episode"])
    q, a = F.get("conversations", F.lit(0))["value"], F.get("conversations", F.lit(1))["value"]
    return rows.select("episode", "frame_id", q.contains("next action").alias("one"), (a == "No action required. All is in place.").alias("finished"))


@query(f"""with {_END} select episode, frame_id, case when pf >= 1 then 'All is in place.' || chr(10) || 'Therefore, the estimated progress is <progress>100%</progress>.' else '<progress>' || printf('%.2f', pf * 100) || '%</progress>.' end as answer from en where {_U('episode', 'frame_id', chr(39) + 'c' + chr(39))} >= 0.2""")
def t3_progress_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = qa.run_handler("c", _qa_frames(spark, sf_dir), ["episode"])
    a = F.get("conversations", F.lit(1))["value"]
    return rows.select("episode", "frame_id", F.when(a.startswith("All"), a).otherwise(F.regexp_extract(a, r"<progress>[^<]*</progress>\.", 0)).alias("answer"))


@query(f"""with {_END}, c as (select episode, frame_id, case when frame_id = n - 1 then 1.0 else pf * greatest(0, least(1, k / 100)) end as p, frame_id = n - 1 as fin from en)
    select episode, frame_id, round(p, 9) as p, i as copy from c, (values (1), (2), (3)) t(i) where fin or i = 1""")
def t4_one_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _qa_frames(spark, sf_dir).withColumns({"finished": F.col("progress_frac") >= 1, "cutoff": F.col("k") / 100, "planned_actions": F.array(F.lit("a"))})
    return qa.one_shot_rows(f).select("episode", "frame_id", F.round("progress_frac", 9).alias("p"), "copy")


@query(f"with {QA}, r as (select *, count(*) over (partition by dataset) as n, row_number() over (partition by dataset order by {_U('doc_id')}, doc_id) as i from qa) select dataset, doc_id from r where i <= greatest(1, floor(n * 0.07))")
def t6_sample_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.sample_each(base.qa(spark, sf_dir), ["dataset"], ["doc_id"], 0.07).select("dataset", "doc_id")


@query(f"with {QA} select doc_id from qa where {uniform_sql('doc_id', seed=5)} < 0.3")
def t7_sample_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.sample_rate(base.qa(spark, sf_dir), ["doc_id"], 0.3, seed=5).select("doc_id")


@query(f"""with {QA}, r as (select *, {_U('dataset', 'episode')} as r, {_U('dataset', 'episode', chr(39) + 'rest' + chr(39))} as r2, dataset = 'src3' and episode in (select episode from qa where doc_id % 2 = 0) as listed from qa where cluster <> 'es')
    select doc_id, case when listed then case when r < 0.3 then 'test' when r2 < 0.75 / (0.75 + 0.125) then 'train' else 'valid' end when r < 0.75 then 'train' when r < 0.875 then 'test' else 'valid' end as split from r""")
def t8_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = base.qa(spark, sf_dir)
    listed = q.where("doc_id % 2 = 0").select(F.lit("src3").alias("dataset_name"), F.col("episode").alias("episode_name")).distinct()
    return qa.split_episodes(q, train=0.75, test=0.125, valid=0.125, selected_test=listed, disabled_clusters=["es"]).select("doc_id", "split")


@query(f"""with {QA}, p as (select *, doc_id % 5 / 2.0 as duration from qa) select doc_id, 'long' as part from p where duration >= 1 and num_tokens between 1000 and 6000 union all select doc_id, 'short' from p where duration >= 1 and num_tokens < 1000
    union all select doc_id, 'long' from p where duration >= 1 and num_tokens < 1000 and {_U('doc_id')} < 0.1""")
def t9_context_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = base.qa(spark, sf_dir).withColumn("duration", F.col("doc_id") % 5 / 2.0)
    return qa.context_split(q, least=1000, most=6000, both=0.1, keys=["doc_id"]).select("doc_id", "part")


@query()
def t10_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.packed(base.qa(spark, sf_dir), volume=8000, order="doc_id", batch=512).select("doc_id", "num_tokens", "pack_id")


@query("with r as (select doc_id, n_chars as num_tokens, row_number() over (order by doc_id) - 1 as i from documents) select doc_id, i // 4 as pack, cast(sum(num_tokens) over (partition by i // 4 order by doc_id) - num_tokens as bigint) as seq_start, cast(sum(num_tokens) over (partition by i // 4 order by doc_id) as bigint) as seq_end from r")
def t17_collated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = qa.numbered(base.qa(spark, sf_dir), groups=[], order="doc_id").withColumn("pack", F.floor(F.col("_row") / 4))
    return qa.collated(rows, "pack", order="doc_id").select("doc_id", "pack", "seq_start", "seq_end")


#: Datasets of one size go round the workers in turn.
@query(f"with {QA}, n as (select dataset, count(*) as n from qa group by dataset) select cast((row_number() over (order by n desc, dataset) - 1) % 6 as integer) as worker, dataset, 1 as parts, 0 as part from n")
def t14_worker_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = {r["dataset"]: r["n"] for r in base.qa(spark, sf_dir).groupBy("dataset").agg(F.count("*").alias("n")).collect()}  # a row a dataset
    return spark.createDataFrame(qa.worker_shares(sizes, 6), "worker int, dataset string, parts int, part int")


@query("""with recursive s as (select doc_id, doc_id // 64 as batch, n_chars::double as cost, row_number() over (partition by doc_id // 64 order by n_chars desc, doc_id) as i from documents),
    r as (select batch, doc_id, cost, i, 0 as chunk, cost as mx, 1 as n from s where i = 1 union all select s.batch, s.doc_id, s.cost, s.i, case when r.mx * (r.n + 1) <= 20000 then r.chunk else r.chunk + 1 end, case when r.mx * (r.n + 1) <= 20000 then r.mx else s.cost end,
        case when r.mx * (r.n + 1) <= 20000 then r.n + 1 else 1 end from r join s on s.batch = r.batch and s.i = r.i + 1) select doc_id, batch, cost, chunk from r""")
def t15_cost_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = base.qa(spark, sf_dir).select("doc_id", F.floor(F.col("doc_id") / 64).alias("batch"), F.col("num_tokens").cast("double").alias("cost"))
    return qa.with_chunks(q, ["batch"], cost="cost", budget=20000.0, key="doc_id")


@query("select doc_id, case doc_id % 4 when 0 then '-100,-100,-100,5,151645,9,-100' when 1 then '-100,-100' when 2 then '-100,-100,-100,-100' else '-100,-100,5,151645,8,-100,-100,6,151645' end as labels from documents")
def t18_answer_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer, none, one that never ends, two."""
    i, of = F.col("doc_id") % 4, lambda *xs: F.array(*map(F.lit, xs))
    ids = F.when(i == 0, of(7, 77091, 198, 5, 151645, 9, 9)).when(i == 1, of(1, 2)).when(i == 2, of(77091, 198, 5, 6)).otherwise(of(77091, 0, 5, 151645, 8, 77091, 0, 6, 151645))
    return base.table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(qa.answer_mask(ids), lambda x: x.cast("string")), ",").alias("labels"))


@query(f"with {QA} select doc_id, dataset from qa order by {uniform_sql('doc_id', seed=1)}, doc_id limit 3")
def t19_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.preview(base.qa(spark, sf_dir), ["doc_id"], seed=1, n=3).select("doc_id", "dataset")


@query(f"with {QA}, e as (select distinct dataset, episode from qa where doc_id in (select doc_id from labels)), r as (select *, count(*) over (partition by dataset) as n, row_number() over (partition by dataset order by {_U('dataset', 'episode')}, dataset, episode) as i from e) select dataset, episode from r where i <= greatest(2, floor(n * 0.1))")
def t20_check_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = base.qa(spark, sf_dir)
    files = q.join(base.table(spark, sf_dir, "labels"), "doc_id", "left_semi").select("dataset", "episode").distinct()
    return qa.check_episodes(q.select("dataset", "episode").distinct(), files, ["dataset", "episode"], ["dataset"], least=2, rate=0.1)


@query("select doc_id, '{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\"}' as value from documents")
def k2_validated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = base.table(spark, sf_dir, "documents")
    lines = d.select(F.format_string('{ "doc_id": %d, "lang": "%s", "more": 1}', "doc_id", "lang").alias("value"))
    return sinks.validated(lines, "doc_id long, lang string").select(F.get_json_object("value", "$.doc_id").cast("long").alias("doc_id"), "value")


@query("select s_name as name, 1.0 as rate from supplier where s_suppkey = 0 union all select s_name, 0.25 from supplier where s_suppkey = 1")
def s11_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = base.table(spark, sf_dir, "supplier").where("s_suppkey <= 5").select(F.col("s_name").alias("name"), F.lit("a").alias("annotation_path"), F.lit("d").alias("data_path"), "s_suppkey")
    names = [r["name"] for r in s.where("s_suppkey <= 1").orderBy("s_suppkey").collect()]  # a configuration table
    return tables.registry_rows(s, [names[0], names[1] + "%25"]).select("name", "rate")


@query("select event_id, 'echo ' || event_type as text from events")
def u1_batched_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = base.table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("echo "), F.col("event_type")).alias("prompt"))
    return e.select("event_id", inference.infer_column(inference.BACKENDS["echo"])("prompt").alias("text"))


@query("select event_id, 'first ' || event_type as answer1, 'second: first ' || event_type as answer2 from events")
def u5_two_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = base.table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("first "), F.col("event_type")).alias("q1"), F.lit("second: <list>").alias("q2"))
    return inference.two_turns(e, inference.BACKENDS["echo"], first="q1", second="q2").select("event_id", "answer1", "answer2")


@query("select l_returnflag as x, count(*) as n from (select l_returnflag from lineitem union all select o_orderstatus from orders) group by 1 order by n desc, x limit 3")
def r1_r4_top_of_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = base.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("x"))
    b = base.table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("x"))
    return a.unionByName(b).groupBy("x").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "x").limit(3)


@query(f"with {FRAMES}, a as (select episode, list(distinct sub_task) as xs from fr group by episode) select episode, array_to_string(list_sort(list_filter(xs, lambda x: x not in ('done', 'view'))), ',') as left_over from a")
def r5_r6_set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = base.frames(spark, sf_dir).groupBy("episode").agg(F.collect_list("sub_task").alias("xs"))
    return a.select("episode", F.array_join(F.array_sort(F.array_except(F.array_distinct("xs"), F.array(F.lit("done"), F.lit("view")))), ",").alias("left_over"))




@query(f"with {QA} select doc_id, num_tokens from qa where num_tokens > 4000")
def p12_token_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.qa(spark, sf_dir).where("num_tokens > 4000").select("doc_id", "num_tokens")


@query("select o_orderkey from orders where o_orderkey % 7 = 6 or o_orderkey % 7 - 1 >= 1")
def p13_video_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A video that could not be read has the duration -1 and goes; a row without a video has none and stays."""
    seconds = F.when(F.col("o_orderkey") % 7 < 6, (F.col("o_orderkey") % 7 - 1).cast("double"))
    o = base.table(spark, sf_dir, "orders").select("o_orderkey", seconds.alias("duration"), F.lit(1).alias("num_tokens"))
    return qa.context_split(o, least=0, most=10, keys=["o_orderkey"]).select("o_orderkey")


@query(f"with {FRAMES}, n as (select *, row_number() over (partition by episode order by frame_id desc) as i from fr) select episode, frame_id from n where sub_task = 'done' or i > 5")
def p17_unplanned_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = base.frames(spark, sf_dir)
    i = F.row_number().over(Window.partitionBy("episode").orderBy(F.desc("frame_id")))
    f = f.withColumn("planned_actions", F.when(i > 5, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>")))
    rows = f.withColumns({"finished": F.col("sub_task") == "done", "progress_frac": F.lit(0.5), "cutoff": F.lit(1.0)})
    return qa.one_shot_rows(rows, times=1).select("episode", "frame_id")


@query(f"with {FRAMES}, r as (select *, row_number() over (partition by episode order by frame_id) as i from fr where sub_task = 'done') select episode, frame_id from r where i <= 10")
def r2_first_finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("episode").orderBy("frame_id")
    f = base.frames(spark, sf_dir).where("sub_task = 'done'")
    return f.withColumn("i", F.row_number().over(w)).where("i <= 10").select("episode", "frame_id")


@query(f"with {BOXES} select episode, frame_id, round(sum(length(label) / 10.0 + x1), 6) as total from bx group by all")
def u6_scored_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inference.scored_boxes(base.boxed_frames(spark, sf_dir).withColumn("image", F.lit("x.jpg")), lambda: lambda items: [len(label) / 10.0 + b[0] for _, label, b in items])
    return rows.select("episode", "frame_id", F.round(F.aggregate("bboxes", F.lit(0.0), lambda s, b: s + b["score"]), 6).alias("total"))
