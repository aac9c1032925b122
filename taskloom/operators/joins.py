"""Annotation overlays, reference resolution, densification and completeness as joins.

Frames and annotations share (episode, frame[, camera]) keys; both sides shuffle on the episode columns once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taskloom.sources.shared import stored
from taskloom.sources.tables import bounded


def with_tasks(frames: DataFrame, tasks: DataFrame, sub_tasks: DataFrame | None = None) -> DataFrame:
    """Task text by task_index, sub-task text by sub_task_index (left), and the description that falls back on the task.
    A task_index without a task raises when the task is computed."""
    rows = frames.join(bounded(tasks.withColumn("_known", F.lit(True))), "task_index", "left")
    unknown = F.raise_error(F.concat(F.lit("no task of index "), F.coalesce(F.col("task_index").cast("string"), F.lit("null"))))
    rows = rows.withColumn("task", F.when(F.col("_known"), F.col("task")).otherwise(unknown.cast("string"))).drop("_known")
    rows = rows.join(bounded(sub_tasks), "sub_task_index", "left") if sub_tasks is not None else rows
    return rows.withColumn("task_description", F.coalesce(F.nullif("sub_task", F.lit("")), "task")) if "sub_task" in rows.columns else rows


def latest(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The last row of each key by order; a later duplicate wins."""
    w = Window.partitionBy(*keys).orderBy(*((F.col(c) if isinstance(c, str) else c).desc() for c in order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def most_boxes(rows: DataFrame, keys: list[str], boxes: str = "bboxes", seq: str = "seq") -> DataFrame:
    """Of each key the row with the most boxes, the first on a tie."""
    w = Window.partitionBy(*keys).orderBy(F.size(boxes).desc(), F.col(seq))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def overlay(frames: DataFrame, annotations: dict[str, tuple[DataFrame, list[str]]], order: str = "seq") -> DataFrame:
    """Frames with each annotation's columns by its keys; of duplicates the last by `order` counts."""
    for rows, keys in annotations.values():
        frames = frames.join(latest(rows, keys, [order]).drop(order), keys, "left")
    return frames


def composite(frames: DataFrame) -> DataFrame:
    """Adds composite: for finished frames the sub-task alone, else all of sub_task, cot, bboxes and plan, or null if one lacks."""
    done = F.col("sub_task") == "done"
    parts = [F.col(c) for c in ("sub_task", "cot", "bboxes", "plan")]
    whole = parts[0].isNotNull()
    for p in parts[1:]:
        whole = whole & p.isNotNull()
    none = [F.lit(None).cast(frames.schema[c].dataType).alias(c) for c in ("cot", "bboxes", "plan")]
    some = [F.col(c).alias(c) for c in ("cot", "bboxes", "plan")]
    return frames.withColumn("composite", F.when(done, F.struct(F.lit(True).alias("finished"), F.col("sub_task"), *none)).when(whole, F.struct(F.lit(False).alias("finished"), F.col("sub_task"), *some)))


def resolve_refs(rows: DataFrame, keys: list[str], *, frame: str = "frame_id", ref: str = "ref", payload: list[str]) -> DataFrame:
    """Rows that only refer to another frame of the same keys get the payload of where the chain of references ends.

    A frame that has a row without a reference keeps it.  A reference to a frame that doesn't exist, or round in a
    circle, gets a null payload.  Chains are followed by pointer jumping, so r rounds follow chains of 2**r links; the
    rounds end when the number of open references no longer falls, which only circles keep above 0."""
    own = rows.where(F.col(ref).isNull())
    edges = rows.where(F.col(ref).isNotNull()).join(own.select(*keys, frame), [*keys, frame], "left_anti").groupBy(*keys, frame).agg(F.max(ref).alias("to"))
    edges, left = stored(edges, "refs"), None
    while True:
        step = edges.select(*keys, F.col(frame).alias("to"), F.col("to").alias("further"))
        longer = stored(edges.join(step, [*keys, "to"], "left").select(*keys, frame, "to", "further"), "refs")
        still = longer.where("further is not null").count()
        if not still or still == left:
            break
        left, edges = still, longer.select(*keys, frame, F.coalesce("further", "to").alias("to"))
    ends = own.select(*keys, F.col(frame).alias("to"), *payload)
    found = edges.join(ends, [*keys, "to"], "left").select(*keys, frame, *payload)
    return own.select(*keys, frame, *payload).unionByName(found)


def densified(rows: DataFrame, episodes: DataFrame, keys: list[str], *, frame: str = "frame_id", n: str = "n_frames", cameras: list[str] | None = None, fill: dict[str, Column] | None = None) -> DataFrame:
    """Rows and, for each frame of an episode (of each camera) without one, a row of the fill values."""
    grid = episodes.where(F.col(n) > 0).select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias(frame))
    on = [*keys, frame]
    if cameras:
        grid, on = grid.withColumn("camera_key", F.explode(F.array(*map(F.lit, cameras)))), [*on, "camera_key"]
    missing = grid.join(rows.select(*on), on, "left_anti")
    for c in rows.columns:
        if c not in on:
            missing = missing.withColumn(c, (fill or {}).get(c, F.lit(None)).cast(rows.schema[c].dataType))
    return rows.unionByName(missing)


def border_sub_tasks(segments: DataFrame, raw: DataFrame, key: str = "episode") -> DataFrame:
    """Task segments (episode, start, end, first_index) with the raw sub-task row whose task_start is the segment's start in its episode.
    Two raw rows for one start raise an error when the result is computed."""
    once = raw.groupBy(key, "task_start").agg(F.count("*").alias("_n"), F.first(F.struct(*(c for c in raw.columns if c not in (key, "task_start")))).alias("_raw"))
    once = once.withColumn("_ok", F.assert_true(F.col("_n") == 1, F.lit("duplicate task_start")))
    rows = segments.withColumn("task_start", F.col("start") - F.col("first_index"))
    return rows.join(once.where("_ok is null"), [key, "task_start"], "left").select(*segments.columns, "_raw.*")


def selected(rows: DataFrame, keys: list[str], only: DataFrame | None = None, without: DataFrame | None = None) -> DataFrame:
    """Rows whose keys are listed in `only` and not in `without`."""
    if only is not None:
        rows = rows.join(only.select(*keys).distinct(), keys, "left_semi")
    return rows.join(without.select(*keys).distinct(), keys, "left_anti") if without is not None else rows


def unfinished(rows: DataFrame, done: DataFrame, keys: list[str], frame: str = "frame_id") -> DataFrame:
    """Rows after the contiguous frames from 0 that are finished already."""
    w = Window.partitionBy(*keys).orderBy(frame)
    contiguous = done.select(*keys, frame).distinct().withColumn("_i", F.row_number().over(w) - 1).where(F.col("_i") == F.col(frame)).groupBy(*keys).agg(F.max(frame).alias("_upto"))
    return rows.join(contiguous, keys, "left").where(F.col(frame) > F.coalesce("_upto", F.lit(-1))).drop("_upto")


def plans_for(sub: DataFrame, plans: DataFrame, keys: list[str], fallback: str = "No plan is available.") -> DataFrame:
    """Adds plan by task_index: the first one (by seq), without a closing `done.`, a fallback if there is none."""
    first = plans.groupBy(*keys).agg(F.min_by("plan", "seq").alias("plan"))
    rows = sub.join(first, keys, "left")
    last = F.lower(F.element_at("plan", -1)) == "done."
    cut = F.when((F.size("plan") > 0) & last, F.slice("plan", F.lit(1), F.greatest(F.size("plan") - 1, F.lit(0)))).otherwise(F.col("plan"))
    return rows.withColumn("plan", F.coalesce(cut, F.array(F.lit(fallback))))


def complete_datasets(episodes: DataFrame, files: DataFrame, categories: dict[str, int], *, every: bool = True) -> DataFrame:
    """Dataset, status: the bits of the categories of which all (or any) of its episodes have a file."""
    have = files.select("dataset", "episode", "category").distinct()
    rows = episodes.select("dataset", "episode").join(have.groupBy("dataset", "episode").agg(F.collect_set("category").alias("has")), ["dataset", "episode"], "left")
    fold = F.bool_and if every else F.bool_or
    has = lambda c: F.coalesce(F.array_contains("has", c), F.lit(False))
    flags = rows.groupBy("dataset").agg(*(fold(has(c)).alias(c) for c in categories))
    bits = F.lit(0)
    for c, b in categories.items():
        bits = bits.bitwiseOR(F.when(F.col(c), b).otherwise(0))
    return flags.select("dataset", bits.cast("int").alias("status"))


def memo_inference(rows: DataFrame, memo: DataFrame, infer, *, key: str = "content_hash", result: str = "result") -> DataFrame:
    """Rows with the result of their content; only contents that the memo (key, result) lacks are inferred, each once."""
    todo = rows.join(memo.select(key), key, "left_anti").dropDuplicates([key])
    return rows.join(memo.select(key, result).unionByName(infer(todo).select(key, result)), key, "left")


def displayed(frames: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Columns with a default where they are null, or empty texts."""
    for c, d in defaults.items():
        value = F.nullif(F.col(c), F.lit("")) if frames.schema[c].dataType.simpleString() == "string" else F.col(c)
        frames = frames.withColumn(c, F.coalesce(value, d))
    return frames


def with_all(episodes: DataFrame, tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Episodes that occur in every table."""
    for t in tables:
        episodes = episodes.join(t.select(*keys).distinct(), keys, "left_semi")
    return episodes


def boxes_matched(a: DataFrame, keys: list[str], *, most: float = 0.1, frame: str = "frame_id", ahead: int | None = None) -> DataFrame:
    """Pairs of boxes of one sequence, the second in a later frame (at most `ahead` later), nearer than `most`."""
    from taskloom.functions.boxes import distance

    left = a.select(*keys, F.col(frame).alias("f1"), F.col("box_no").alias("b1"), F.col("bbox_2d").alias("x"))
    right = a.select(*keys, F.col(frame).alias("f2"), F.col("box_no").alias("b2"), F.col("bbox_2d").alias("y"))
    near = F.col("f2") > F.col("f1")
    if ahead is not None:  # equi-join on blocks of frames, so the pairs stay near the diagonal
        left = left.withColumn("_block", F.explode(F.array(F.floor(F.col("f1") / ahead), F.floor(F.col("f1") / ahead) + 1)))
        right = right.withColumn("_block", F.floor(F.col("f2") / ahead))
        keys, near = [*keys, "_block"], near & (F.col("f2") - F.col("f1") <= ahead)
    pairs = left.join(right, keys).where(near).withColumn("dist", distance(F.col("x"), F.col("y"), 0.5, 0.5))
    return pairs.where(F.col("dist") < most).drop("_block", "x", "y")
