"""Datasets of episodes as DataFrames: metadata, frames, annotations, registries and lists."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Dimension tables up to this size by Spark's own estimate are broadcast; larger ones are joined by shuffle.
MOST_BROADCAST = 32 << 20

INFO = "data_path string, video_path string, robot_type string, fps int, chunks_size int, total_episodes long, total_frames long, total_tasks long, total_chunks long, features map<string,struct<dtype:string,shape:array<int>,names:string>>"
SCHEMAS = {
    "plan": "frame_id long, task_index long, plan array<string>, task_start long, task_end long, task string",
    "sub_task_raw": "task_id long, task_start long, task_end long, results struct<task:string,subtasks:array<struct<id:int,name:string,start_frame:int,complete_frame:int,notes:string>>,overall_notes:string>, generated_text string",
    "sub_task": "frame_id long, task string, sub_task string",
    "bbox": "frame_id long, camera_key string, bboxes array<struct<label:string,bbox_2d:array<double>,score:string>>, task_desc string, generated_text string, ref long",
    "cot": "frame_id long, task string, sub_task string, cot string, generated_text string, ref long",
    "done": "start_frame_id long, frame_id long, finished boolean, sub_task string, cot string",
    "qa": "image string, video string, conversations array<struct<from:string,value:string>>, num_tokens long, meta struct<dataset:string,episode:string,frame_index:long,task:string,sub_task:string>",
    "progress": "video_path string, task string, sample_index long, frame_index long, timestamp_sec double, window_frame_indices array<long>, progress double, parsed_progress double, progress_source string, reasoning string, model_output string",
}
_EPISODE = r"(episode_\d+)[^/]*$"


def estimated_bytes(df: DataFrame) -> int:
    """Size by the optimizer's statistics, without running anything."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def bounded(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """df with a broadcast hint if its estimated size is within the bound, else as it is."""
    return F.broadcast(df) if estimated_bytes(df) <= most else df


def file_path() -> Column:
    return F.col("_metadata.file_path")


def episode_name(path: Column) -> Column:
    return F.regexp_extract(path, _EPISODE, 1)


def info(spark: SparkSession, root: str) -> DataFrame:
    """The one row of meta/info.json."""
    return spark.read.schema(INFO).json(f"{root}/meta/info.json", multiLine=True)


def tasks(spark: SparkSession, root: str, kind: str = "task") -> DataFrame:
    """The task (or sub_task) dictionary, texts without control characters; of a repeated index the last line counts."""
    rows = spark.read.schema(f"{kind}_index long, {kind} string").json(f"{root}/meta/{kind}s.jsonl")
    rows = rows.withColumn(kind, F.regexp_replace(kind, r"[\x00-\x1F\x7F]", "")).withColumn("_at", F.monotonically_increasing_id())
    return rows.groupBy(f"{kind}_index").agg(F.max_by(kind, "_at").alias(kind))


def episodes(spark: SparkSession, root: str, schema: str = "episode_index long, tasks array<string>, length long") -> DataFrame:
    """meta/episodes.jsonl; of a repeated index the last line counts."""
    rows = spark.read.schema(schema).json(f"{root}/meta/episodes.jsonl").withColumn("_at", F.monotonically_increasing_id())
    rest = [c for c in rows.columns if c not in ("episode_index", "_at")]
    return rows.groupBy("episode_index").agg(*(F.max_by(c, "_at").alias(c) for c in rest))


def frames(spark: SparkSession, root: str, columns: list[str] | None = None) -> DataFrame:
    """Episode parquet below data/chunk-*, only the columns named, <camera>.bytes renamed to <camera>;
    with episode_name and chunk_name from the path.  A dataset without chunks raises."""
    rows = spark.read.parquet(f"{root}/data/chunk-*/*.parquet")
    kept = []
    for c in columns or rows.columns:
        if c in rows.columns:
            kept.append(F.col(f"`{c}`").alias(c.removesuffix(".bytes")))
        elif "." in c and c.removesuffix(".bytes") in rows.columns:
            kept.append(F.col(f"`{c.removesuffix('.bytes')}`.bytes").alias(c.removesuffix(".bytes")))
        elif f"{c}.bytes" in rows.columns:
            kept.append(F.col(f"`{c}.bytes`").alias(c))
    chunk = F.regexp_extract(file_path(), r"/(chunk-\d+)/", 1)
    return rows.select(*kept, episode_name(file_path()).alias("episode_name"), chunk.alias("chunk_name"))


def episode_index_scan(frames_: DataFrame) -> DataFrame:
    """S3: rows of each episode and its place in the global index."""
    from taskloom.operators.sequence import frame_offsets

    counts = frames_.groupBy("episode_index").agg(F.count("*").alias("n_frames"))
    return frame_offsets(counts, by="episode_index", n="n_frames")


def annotations(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """<episode>.<kind>.jsonl files under an explicit schema, with the episode's name.  Scores of boxes are split into a number
    and whether they were interpolated."""
    suffix = kind.removesuffix("_raw")
    rows = spark.read.schema(SCHEMAS[kind]).json(f"{folder}/*.{suffix}.jsonl").withColumn("episode_name", episode_name(file_path()))
    if kind == "bbox":
        one = lambda b: F.struct(b["label"].alias("label"), b["bbox_2d"].alias("bbox_2d"), b["score"].try_cast("double").alias("score"), (b["score"] == "interpolated").alias("interpolated"))
        rows = rows.withColumn("bboxes", F.transform("bboxes", one))
    return rows


def first_version(spark: SparkSession, candidates: list[str]) -> str | None:
    """The first folder that exists, on any file system."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for c in candidates:
        path = jvm.org.apache.hadoop.fs.Path(c)
        if path.getFileSystem(conf).exists(path):
            return c
    return None


def as_list(text: Column) -> Column:
    """A field that is a path or a list of paths, as a list."""
    return F.when(text.startswith("["), F.from_json(text, "array<string>")).otherwise(F.when(text.isNotNull(), F.array(text)))


def qa_rows(spark: SparkSession, root: str, clusters: list[str] | None = None) -> DataFrame:
    """Question-answer rows of both layouts, root/cluster/dataset/episode_*.jsonl and root/cluster/dataset.jsonl, with
    cluster and dataset."""
    rows = spark.read.schema(SCHEMAS["qa"]).option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").json(root)
    base = re.escape(root.rstrip("/").split(":", 1)[-1].lstrip("/"))
    below = F.regexp_extract(F.url_decode(file_path()), rf"{base}/+(.*)$", 1)
    rows = rows.withColumns({"image": as_list(F.col("image")), "video": as_list(F.col("video")), "_p": below})
    rows = rows.withColumns({"cluster": F.regexp_extract("_p", r"^([^/]+)/", 1), "dataset": F.regexp_replace(F.regexp_extract("_p", r"^[^/]+/([^/]+)", 1), r"\.jsonl$", "")}).drop("_p")
    return rows.where(F.col("cluster").isin(clusters)) if clusters else rows


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that is one JSON array; JSON lines are read by spark.read.json and split by Spark itself."""
    return spark.read.schema(schema).json(path, multiLine=True)


def packed_rows(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """The rows of files that are each one JSON array of packs; a file is read by one task, so packs are written in many files."""
    packs = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"array<array<struct<{fields}>>>")).alias("pack"))
    return packs.select(F.explode("pack").alias("r")).select("r.*")


def images(spark: SparkSession, path: str) -> DataFrame:
    """Image files as path and bytes; decoding is up to an injected function, since no codec is part of the library."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("content").alias("bytes"))


def registry_rows(registry: DataFrame, names: list[str]) -> DataFrame:
    """Name, annotation_path, data_path, rate of datasets by name; `name%NN` takes NN percent, a first name `*` all; an unknown name
    raises."""
    known = {r["name"] for r in registry.select("name").collect()}  # a configuration table
    wanted = [(n, 1.0) for n in sorted(known)] if names[:1] == ["*"] else [(m[1], int(m[2]) / 100 if m[2] else 1.0) for n in names if (m := re.fullmatch(r"(.*?)(?:%(\d+))?", n))]
    if missing := sorted({n for n, _ in wanted} - known):
        raise ValueError(f"unknown datasets: {missing}")
    return registry.join(registry.sparkSession.createDataFrame(wanted, "name string, rate double"), "name")


def selection(spark: SparkSession, path: str) -> DataFrame:
    """Distinct (dataset_name, episode_name)."""
    return spark.read.schema("dataset_name string, episode_name string").json(path).distinct()


def native_sub_tasks(frames_: DataFrame, tasks_: DataFrame, sub_tasks: DataFrame | None = None) -> DataFrame:
    """frame_id, task, sub_task of the dataset itself; without a sub-task dictionary the task stands for both."""
    from taskloom.operators.joins import with_tasks

    rows = with_tasks(frames_, tasks_, sub_tasks)
    sub = F.col("sub_task") if sub_tasks is not None else F.col("task")
    return rows.select("episode_name", F.col("frame_index").alias("frame_id"), "task", sub.alias("sub_task"))


def episode_token(image: Column, video: Column) -> Column:
    """First episode_<n> in the first image, or in the first video if there is one."""
    path = F.coalesce(F.get(video, F.lit(0)), F.get(image, F.lit(0)))
    return F.nullif(F.regexp_extract(path, r"(episode_\d+)", 1), F.lit(""))


#: Field prefixes of an evaluation log's samples.
LOG_FIELDS = {"Resources:": "resources", "Question:": "question", "Ground Truth:": "gt_txt", "Prediction:": "pred_txt"}


def eval_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(samples, metrics) of evaluation logs, one task a file.

    A line of dashes starts a sample; a prefixed line starts a field, others continue it; `name: number` lines outside
    a sample are metrics.  A log is written by one process and is read by one task, line by line."""
    import pandas as pd

    def run(parts):
        for pdf in parts:
            out = []
            for name, text in zip(pdf["file"], pdf["value"]):
                sample, field, n = None, None, 0
                for line in [*text.splitlines(), "----------"]:
                    if line.startswith("----------"):
                        if sample and any(sample.values()):
                            out.append({"file": name, "seq": n, **{k: "\n".join(v) if v is not None else None for k, v in sample.items()}, "metric": None, "value": None})
                            n += 1
                        sample, field = dict.fromkeys(LOG_FIELDS.values()), None
                        continue
                    prefix = next((p for p in LOG_FIELDS if line.startswith(p)), None)
                    metric = re.fullmatch(r"\s*([\w@/%. -]+): ([-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)\s*", line)
                    if prefix and sample is not None:
                        field = LOG_FIELDS[prefix]
                        sample[field] = [line[len(prefix) :].lstrip()]
                    elif metric and field is None:
                        out.append({"file": name, "seq": None, **dict.fromkeys(LOG_FIELDS.values()), "metric": metric[1], "value": float(metric[2])})
                    elif field:
                        sample[field].append(line)
            yield pd.DataFrame(out, columns=["file", "seq", *LOG_FIELDS.values(), "metric", "value"])

    texts = spark.read.text(path, wholetext=True).select(file_path().alias("file"), "value")
    rows = texts.mapInPandas(run, "file string, seq long, resources string, question string, gt_txt string, pred_txt string, metric string, value double")
    return rows.where("metric is null").drop("metric", "value"), rows.where("metric is not null").select("file", "metric", "value")


def jsonl_schema(kind: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[kind])
