"""Sources and sinks (S, K) and streams (R7, R8): the driver's tables are written in the engine's file layouts to the shared folder
and read back through the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskloom.functions.text import printable
from taskloom.operators import inference
from taskloom.plans import base
from taskloom.plans.base import FRAMES
from taskloom.plans.registry import query
from taskloom.sources import sinks, tables
from taskloom.sources.shared import shared_dir


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("select p_partkey as task_index, p_name as task from part")
def s1_task_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _folder(spark, "dataset")
    p = base.table(spark, sf_dir, "part")
    first = p.select(F.col("p_partkey").alias("task_index"), F.lit("old").alias("task"))
    again = p.select(F.col("p_partkey").alias("task_index"), F.concat(F.lit("\x01"), F.col("p_name"), F.lit("\x7f")).alias("task"))
    sinks.write_jsonl(first.coalesce(1), f"{root}/meta/tasks.jsonl")
    sinks.write_jsonl(again.coalesce(1), f"{root}/meta/tasks.jsonl", append=True)
    rows = spark.read.schema("task_index long, task string").json(f"{root}/meta/tasks.jsonl")
    # files of one folder have no order between them, so "the last line" is only defined within a file: the dictionary of the second
    later = rows.where("task <> 'old'")
    return later.select("task_index", printable(F.col("task")).alias("task"))


def _dataset(spark: SparkSession, sf_dir: str) -> str:
    """Frames as data/chunk-NNN/episode_NNNNNN.parquet folders would be too many files; one folder a chunk of 50 episodes, all in one job."""
    root = _folder(spark, "dataset")
    f = base.frames(spark, sf_dir).select("episode", F.col("frame_id").alias("frame_index"), "value", "sub_task")
    chunk = F.format_string("chunk-%03d", F.floor(F.col("episode") / 50))
    f = f.withColumn("chunk_name", F.when(F.col("episode").isNotNull(), chunk))
    f.repartition("chunk_name").write.partitionBy("chunk_name").parquet(f"{root}/data")
    return root


@query(f"with {FRAMES} select episode, frame_id as frame_index, value, printf('chunk-%03d', (episode // 50)::integer) as chunk_name from fr")
def s2_s5_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    from taskloom.sources.tables import file_path

    root = _dataset(spark, sf_dir)
    # the layout has plain folder names, so the chunk is read off the path and not from the partitions
    rows = spark.read.option("recursiveFileLookup", True).parquet(f"{root}/data")
    chunk = F.regexp_extract(file_path(), r"/chunk_name=(chunk-\d+)/", 1)
    return rows.select("episode", "frame_index", "value", F.nullif(chunk, F.lit("")).alias("chunk_name"))


@query("with n as (select user_id as episode_index, count(*) as n_frames from events group by 1) select episode_index, n_frames, cast(sum(n_frames) over (order by episode_index) - n_frames as bigint) as first_index, cast(sum(n_frames) over (order by episode_index) as bigint) as end_index from n")
def s3_episode_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.episode_index_scan(base.table(spark, sf_dir, "events").select(F.col("user_id").alias("episode_index")))


@query(f"with {FRAMES} select frame_id, task, sub_task, episode from fr")
def s6_k1_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "annotations")
    f = base.frames(spark, sf_dir).select("episode", "frame_id", "task", "sub_task")
    sinks.write_jsonl(f.where("episode % 2 = 0"), path, by=["episode"])
    sinks.write_jsonl(f.where("episode % 2 = 1"), path, by=["episode"], append=True)
    return spark.read.schema(tables.jsonl_schema("sub_task").add("episode", "long")).json(path)


@query("select lang as cluster, source as dataset, count(*) as n_rows, cast(sum(n_chars) as bigint) as tokens from documents where lang in ('en', 'de') group by all")
def s7_qa_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _folder(spark, "qa")
    d = base.table(spark, sf_dir, "documents")
    rows = d.select(F.col("lang").alias("cluster"), F.col("source").alias("dataset"), F.concat(F.lit("x/"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("image"), F.col("n_chars").alias("num_tokens"))
    for lang in ("en", "de", "fr"):
        rows.where(F.col("cluster") == lang).drop("cluster").write.partitionBy("dataset").json(f"{root}/{lang}")
        # the layout has plain folder names, so the partition names are undone file by file
    return _renamed(spark, root).groupBy("cluster", "dataset").agg(F.count("*").alias("n_rows"), F.sum("num_tokens").alias("tokens"))


def _renamed(spark: SparkSession, root: str) -> DataFrame:
    raw = spark.read.schema(tables.SCHEMAS["qa"]).option("recursiveFileLookup", True).json(root)
    path = tables.file_path()
    rows = raw.select("*", F.regexp_extract(path, r"/(\w+)/dataset=[^/]+/", 1).alias("cluster"), F.regexp_extract(path, r"/dataset=([^/]+)/", 1).alias("dataset"))
    return rows.where(F.col("cluster").isin("en", "de")).withColumn("image", tables.as_list(F.col("image")))


@query("select event_id as seq, 'q ' || event_type as question, 'line one' || chr(10) || 'k' || event_id as gt_txt, '<progress>' || value || '</progress>' as pred_txt from events")
def s8_eval_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of 1000 events a file; the folder has the id of the first, from which the samples of a file count on."""
    path = _folder(spark, "logs")
    e = base.table(spark, sf_dir, "events")
    lines = F.concat(F.lit("----------\nResources: r\nQuestion: q "), F.col("event_type"), F.lit("\nGround Truth: line one\nk"), F.col("event_id").cast("string"), F.lit("\nPrediction: <progress>"), F.col("value").cast("string"), F.lit("</progress>"))
    logs = e.select("event_id", lines.alias("value"), (F.floor(F.col("event_id") / 1000) * 1000).alias("first"))
    logs.repartition("first").sortWithinPartitions("first", "event_id").select("first", "value").write.partitionBy("first").text(path)
    samples, _ = tables.eval_log(spark, path)
    first = F.regexp_extract("file", r"/first=(-?\d+)/", 1).cast("long")
    return samples.select((first + F.col("seq")).alias("seq"), "question", "gt_txt", "pred_txt")


@query(f"with {FRAMES} select episode, frame_id, sub_task from fr")
def s9_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs of rows as JSON arrays, read back as arrays."""
    path = _folder(spark, "packs")
    f = base.frames(spark, sf_dir).select("episode", "frame_id", "sub_task").withColumn("pack_id", F.col("episode"))
    sinks.write_packed(f, path)
    return tables.packed_rows(spark, path, "episode:bigint,frame_id:bigint,sub_task:string")


@query("select distinct source as dataset_name, 'episode_' || (doc_id // 10) as episode_name from documents where doc_id in (select doc_id from labels)")
def s12_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "selection")
    q = base.qa(spark, sf_dir).join(base.table(spark, sf_dir, "labels"), "doc_id", "left_semi")
    sinks.write_jsonl(q.select(F.col("dataset").alias("dataset_name"), F.col("episode").alias("episode_name")), path)
    return tables.selection(spark, path)


@query("select 'episode_' || o_custkey as episode_name, o_orderkey as frame_id, c_name as task, c_name as sub_task from orders join customer on c_custkey = o_custkey")
def s13_native_sub_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = base.table(spark, sf_dir, "orders")
    f = o.select(F.concat(F.lit("episode_"), F.col("o_custkey").cast("string")).alias("episode_name"), F.col("o_orderkey").alias("frame_index"), F.col("o_custkey").alias("task_index"))
    t = base.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task_index"), F.col("c_name").alias("task"))
    return tables.native_sub_tasks(f, t)


@query("select o_orderkey, o_totalprice * 2 as price from orders")
def k4_replaced_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "replaced")
    o = base.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"))
    sinks.replace_parquet(o, path)
    sinks.replace_parquet(spark.read.parquet(path).withColumn("price", F.col("price") * 2), path, backup=f"{path}-backup", backup_columns=["o_orderkey"])
    return spark.read.parquet(path)


@query("select 'base' as run, 3 as step, 'n' as metric, cast(count(*) as double) as value from events union all select 'new', 4, 'n', cast(count(*) as double) from events")
def k6_metric_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "metrics")
    m = base.table(spark, sf_dir, "events").agg(F.lit("n").alias("metric"), F.count("*").cast("double").alias("value"))
    sinks.append_metrics(m, path, "base", 3)
    sinks.append_metrics(m, path, "new", 4)
    return spark.read.parquet(path)


@query(f"""with {FRAMES}, v as (select episode, frame_id, case when event_id % 4 <> 0 then k end as parsed_progress from fr)
    select episode, frame_id, array_to_string(list_transform(range(frame_id - 3, frame_id + 1), lambda i: greatest(i, 0)), ',') as win, coalesce(last_value(parsed_progress ignore nulls) over (partition by episode order by frame_id rows unbounded preceding), 0.0) as progress,
    case when parsed_progress is null then 'previous' else 'model' end as progress_source from v""")
def r8_progress_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    from taskloom.streaming import progress

    source, out = _folder(spark, "frames"), _folder(spark, "progress")
    f = base.frames(spark, sf_dir).select("episode", "frame_id", F.when(F.col("event_id") % 4 != 0, F.col("k")).alias("parsed_progress"))
    f.repartition(4, F.xxhash64("episode", "frame_id")).write.parquet(source)
    stream = spark.readStream.schema(f.schema).option("maxFilesPerTrigger", 2).parquet(source)
    progress.run_available(progress.progress_stream(stream, window=4), out, _folder(spark, "checkpoint"))
    rows = spark.read.schema(progress.OUTPUT).parquet(out)
    return rows.select("episode", "frame_id", F.array_join(F.transform("window_frame_indices", lambda x: x.cast("string")), ",").alias("win"), "progress", "progress_source")


@query("select event_id, length(event_type) as n from events")
def r7_micro_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = base.table(spark, sf_dir, "events").select("event_id", "event_type")
    return inference.batched(e, lambda pdf: pdf.assign(n=pdf["event_type"].str.len())[["event_id", "n"]], "event_id long, n long")


@query("select event_id, 'ok ' || event_type as text, true as parsed from events")
def u4_retried(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = base.table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("ok "), F.col("event_type")).alias("prompt"))
    rows = inference.retried(e, inference.BACKENDS["echo"], lambda t: F.when(t.startswith("ok"), True))
    return rows.select("event_id", "text", "parsed")


@query("select r_name as name, length(r_name) + 1 as bytes from region")
def s10_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files read whole as bytes; here each holds a name and a line end."""
    path = _folder(spark, "images")
    base.table(spark, sf_dir, "region").select("r_name", F.col("r_name").alias("value")).repartition(5, "r_name").write.partitionBy("r_name").text(path)
    rows = tables.images(spark, path).where(F.col("path").contains("/part-"))
    return rows.select(F.url_decode(F.url_decode(F.regexp_extract("path", "r_name=([^/]+)/", 1))).alias("name"), F.octet_length("bytes").alias("bytes"))


@query("select 'archived' as state, 4 as n union all select 'left', 0")
def k5_archived_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "files")
    sinks.write_jsonl(spark.range(4).repartition(4, "id"), path)
    moved = sinks.move_matching(spark, f"{path}/part-*.json", f"{path}-archive")
    back = sinks.move_matching(spark, f"{path}-archive/part-*.json", path, copy=True)
    left = len(sinks.remove_matching(spark, f"{path}/part-*.json")) - len(back)
    return spark.createDataFrame([("archived", spark.read.json(f"{path}-archive").count() if moved else 0), ("left", left)], "state string, n int")


@query("select 'second' as version")
def j3_version_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "versions")
    base.table(spark, sf_dir, "region").write.parquet(f"{path}/second")
    found = tables.first_version(spark, [f"{path}/first", f"{path}/second", path])
    return spark.createDataFrame([(found.rsplit("/", 1)[1],)], "version string")
