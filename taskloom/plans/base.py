"""The driver's tables in the shapes of the engine: frames from events, question-answer rows from conversations and
documents, boxes from lineitem.  Each shape has a Spark form and a SQL form with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """episode, frame_id, event_id, sub_task (error stands for done), task, value, k."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("episode"), "event_type", "value", "props")
    w = Window.partitionBy("episode").orderBy("ts", "event_id")
    rows = e.withColumn("frame_id", (F.row_number().over(w) - 1).cast("long"))
    sub = F.when(F.col("event_type") == "error", "done").otherwise(F.col("event_type"))
    task = F.concat(F.lit("task "), F.floor(F.col("frame_id") / 20).cast("string"))
    return rows.select("episode", "frame_id", "event_id", sub.alias("sub_task"), task.alias("task"), "value", F.get_json_object("props", "$.k").cast("double").alias("k"))


FRAMES = """fr as (select user_id as episode, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as frame_id, event_id,
    case when event_type = 'error' then 'done' else event_type end as sub_task,
    'task ' || cast(floor((row_number() over (partition by user_id order by ts, event_id) - 1) / 20) as integer) as task,
    value, cast(json_extract_string(props, '$.k') as double) as k from events)"""

REAL = "(length({0}) > 0 and lower({0}) not in ('done', 'done.', 'not done', 'not done.'))"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, episode, pred_txt, gt_txt: progress texts from the frames' two numbers; every seventh one has no tag."""
    f = frames(spark, sf_dir)
    pred = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("about "), F.col("value").cast("string"), F.lit("% done"))).otherwise(F.concat(F.lit("So it is <progress>"), F.col("value").cast("string"), F.lit("%</progress>.")))
    gt = F.concat(F.lit("<progress>"), F.col("k").cast("int").cast("string"), F.lit("%</progress>"))
    return f.select(F.col("event_id").alias("seq"), "episode", pred.alias("pred_txt"), gt.alias("gt_txt"))


#: The numbers that the texts of predictions() state: both sides parse to value and k.
PREDICTIONS = FRAMES + """,
    pr as (select event_id as seq, episode, value as p, k as g from fr),
    pc as (select seq, episode, greatest(0, least(100, p)) as p, greatest(0, least(100, g)) as g from pr)"""


def boxed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """episode (order div 50), frame_id (order mod 50), bboxes by line number: corners from quantity, discount and tax."""
    x1, y1 = F.col("l_discount") * 5, F.col("l_tax") * 5
    w, h = F.col("l_quantity") / 100, F.col("l_linenumber") / 10.0
    box = F.array(x1, y1, x1 + w, y1 + h)
    one = F.struct(F.col("l_linenumber").alias("n"), "l_partkey", "l_suppkey", "l_discount", "l_tax", "l_quantity", F.concat(F.lit("obj "), (F.col("l_partkey") % 5).cast("string")).alias("label"), box.alias("bbox_2d"), (F.col("l_partkey") % 200 / 1000).alias("score"), F.lit(False).alias("interpolated"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(one)).alias("b"))
    bare = F.transform("b", lambda b: F.struct(b["label"].alias("label"), b["bbox_2d"].alias("bbox_2d"), b["score"].alias("score"), b["interpolated"].alias("interpolated")))
    return rows.select(F.floor(F.col("l_orderkey") / 50).alias("episode"), (F.col("l_orderkey") % 50).alias("frame_id"), bare.alias("bboxes"))


BOXES = """bx as (select cast(floor(l_orderkey / 50) as bigint) as episode, l_orderkey % 50 as frame_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_discount, l_tax, l_quantity) - 1 as box_no, 'obj ' || (l_partkey % 5) as label,
    l_discount * 5 as x1, l_tax * 5 as y1, l_discount * 5 + l_quantity / 100 as x2, l_tax * 5 + l_linenumber / 10 as y2, l_partkey % 200 / 1000 as score from lineitem)"""


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cluster (language), dataset (source), episode (doc_id div 10), doc_id, num_tokens."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("lang").alias("cluster"), F.col("source").alias("dataset"), F.concat(F.lit("episode_"), F.floor(F.col("doc_id") / 10).cast("string")).alias("episode"), "doc_id", F.col("n_chars").alias("num_tokens"))


QA = "qa as (select lang as cluster, source as dataset, 'episode_' || cast(floor(doc_id / 10) as bigint) as episode, doc_id, n_chars as num_tokens from documents)"
#: taskloom.functions.hashing.uniform of the keys: the first 48 bits of an md5.
UNIFORM = "(cast('0x' || substr(md5('{seed}' || chr(31) || {keys}), 1, 12) as bigint) / 281474976710656.0)"


def uniform_sql(*keys: str, seed: int = 0) -> str:
    return UNIFORM.format(seed=seed, keys=" || chr(31) || ".join(f"cast({k} as varchar)" for k in keys))
