"""Operators over the ordered frames of episodes, as window functions and array functions.

`ep` is the list of columns that identify a sequence (dataset, episode, camera), `by` the frame column.  A window is
partitioned by the sequence, so its size is that of one episode.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taskloom.functions.hashing import uniform
from taskloom.functions.text import NOT_ACTIONS


_ALL_BITS = (1 << 64) - 1


def ordered(ep: list[str], by: str = "frame_id"):
    return Window.partitionBy(*ep).orderBy(by)


def is_real(sub_task: Column) -> Column:
    """A sub-task that is an action."""
    return F.coalesce((F.length(sub_task) > 0) & ~F.lower(sub_task).isin(*NOT_ACTIONS), F.lit(False))


def frame_offsets(episodes: DataFrame, *, by: str = "episode", n: str = "n") -> DataFrame:
    """(first, last) global frame index of each episode, end exclusive.

    Episodes are counted in buckets of 10,000 first, so the one window without a partition has a row a bucket."""
    bucket = F.floor(F.col(by) / 10_000)
    rows = episodes.withColumn("bucket", bucket)
    heads = rows.groupBy("bucket").agg(F.sum(n).alias("t"))
    heads = heads.select("bucket", (F.sum("t").over(Window.orderBy("bucket")) - F.col("t")).alias("before"))
    inner = F.sum(n).over(Window.partitionBy("bucket").orderBy(by))
    return rows.join(heads, "bucket").select(*episodes.columns, (F.col("before") + inner - F.col(n)).alias("first_index"), (F.col("before") + inner).alias("end_index"))


def islands(frames: DataFrame, ep: list[str], value: str, *, by: str = "frame_id", name: str = "island") -> DataFrame:
    """Adds the number of the run of equal values (nulls are a value) that a frame is in, from 0."""
    w = ordered(ep, by)
    before = F.lag(F.struct(value)).over(w)
    new = F.when(before.isNull() | ~before[value].eqNullSafe(F.col(value)), 1).otherwise(0)
    rows = frames.withColumn("_new", new)
    return rows.withColumn(name, (F.sum("_new").over(w) - 1).cast("long")).drop("_new")


def runs(frames: DataFrame, ep: list[str], value: str, *, by: str = "frame_id") -> DataFrame:
    """Ep, island, start, end (exclusive), value of each run of equal values."""
    return islands(frames, ep, value, by=by).groupBy(*ep, "island").agg(F.min(by).alias("start"), (F.max(by) + 1).alias("end"), F.first(value).alias(value))


def borders(frames: DataFrame, ep: list[str], task: str, index: str) -> DataFrame:
    """Start and end of each task segment by global index: a border where the episode or its task changes."""
    return runs(frames, ep, task, by=index)


def episode_stats(frames: DataFrame, ep: list[str], *, task: str = "task", sub_task: str = "sub_task", by: str = "frame_id") -> DataFrame:
    """Of episodes with one task run and a real action: length, task, the plan and the runs of sub-tasks."""
    base = frames.groupBy(*ep).agg(F.count("*").alias("len"))
    one = runs(frames, ep, task, by=by).groupBy(*ep).agg(F.count("*").alias("n_tasks"), F.first(task).alias("task"))
    run = runs(frames, ep, sub_task, by=by)
    split = F.struct("start", "end", F.col(sub_task).alias("sub_task"))
    splits = run.groupBy(*ep).agg(F.sort_array(F.collect_list(split)).alias("splits"))
    rows = base.join(one.where("n_tasks = 1").drop("n_tasks"), ep).join(splits, ep)
    rows = rows.withColumn("real_splits", F.filter("splits", lambda s: is_real(s["sub_task"])))
    return rows.where(F.size("real_splits") > 0).withColumn("plan", F.transform("splits", lambda s: s["sub_task"]))


def planned_actions(frames: DataFrame, ep: list[str], *, task: str = "task", sub_task: str = "sub_task", by: str = "frame_id") -> DataFrame:
    """Adds the distinct sub-tasks from a frame on within its task run, by last occurrence.  A null sub-task is not listed."""
    rows = islands(frames, ep, task, by=by, name="_task_run")
    w = Window.partitionBy(*ep, "_task_run").orderBy(by)
    kept = F.when((F.col(sub_task) != "") & ~F.col(sub_task).isin("done", "not done"), F.col(sub_task))
    # only the first frame of each later run is listed, so a frame's list has as many entries as runs are left, not frames
    rows = rows.withColumn("_head", F.when(~F.coalesce(F.lag(sub_task).over(w).eqNullSafe(F.col(sub_task)), F.lit(False)), kept))
    later = F.collect_list("_head").over(w.rowsBetween(1, Window.unboundedFollowing))
    own = F.when(kept.isNotNull(), F.array(kept)).otherwise(F.array().cast("array<string>"))
    plan = F.reverse(F.array_distinct(F.reverse(F.concat(own, later))))
    return rows.withColumn("planned_actions", plan).drop("_task_run", "_head")


def remaining_sub_tasks(frames: DataFrame, ep: list[str], *, task: str = "task", sub_task: str = "sub_task", by: str = "frame_id") -> DataFrame:
    """Adds the sub-tasks left at a frame within its task run: empty, done and not done ones are dropped first, then
    neighbours that are equal are folded, and those before the frame's latest sub-task are gone.  A frame without one keeps the list."""
    rows = islands(frames, ep, task, by=by, name="_task_run")
    w = Window.partitionBy(*ep, "_task_run").orderBy(by)
    kept = F.when((F.length(sub_task) > 0) & ~F.col(sub_task).isin("done", "not done"), F.col(sub_task))
    rows = rows.withColumn("_kept", kept)
    rows = rows.withColumn("_head", F.when(~F.last("_kept", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).eqNullSafe(F.col("_kept")), F.col("_kept")))
    own = F.last("_kept", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    later = F.collect_list("_head").over(w.rowsBetween(1, Window.unboundedFollowing))
    first = F.when(own.isNotNull(), F.array(own)).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("remaining", F.concat(first, later)).drop("_task_run", "_kept", "_head")


def forward_fill(frames: DataFrame, ep: list[str], value: str, *, by: str = "frame_id") -> DataFrame:
    """Values below 0 take the last valid one before, a leading gap the first valid one; without any they stay."""
    valid = F.when(F.col(value) >= 0, F.col(value))
    w = ordered(ep, by)
    filled = F.coalesce(F.last(valid, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(valid, True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.col(value))
    return frames.withColumn(value, filled)


def carry_progress(rows: DataFrame, ep: list[str], parsed: str = "parsed_progress", *, by: str = "frame_id") -> DataFrame:
    """Adds progress (the last parsed one, 0 before any) and where it comes from."""
    last = F.last(parsed, True).over(ordered(ep, by).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumns({"progress": F.coalesce(last, F.lit(0.0)), "progress_source": F.when(F.col(parsed).isNull(), "previous").otherwise("model")})


def clamped_window(rows: DataFrame, ep: list[str], value: str, size: int, *, by: str = "frame_id", name: str = "window") -> DataFrame:
    """Adds the last `size` values, the first one repeated where the sequence is shorter."""
    held = F.collect_list(value).over(ordered(ep, by).rowsBetween(1 - size, 0))
    return rows.withColumn("_held", held).withColumn(name, F.concat(F.array_repeat(F.get("_held", F.lit(0)), F.lit(size) - F.size("_held")), F.col("_held"))).drop("_held")


def uniform_indices(n: Column, k: Column) -> Column:
    """K indices spread evenly over 0..n-1, halves to even; gaps that rounding leaves are filled from below."""
    spread = F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(k, F.lit(2)) - 1), lambda i: F.bround(i * ((n - 1) / (k - 1).cast("double"))).cast("int")))
    every = F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)
    filled = F.concat(spread, F.slice(F.array_except(every, spread), F.lit(1), F.greatest(k - F.size(spread), F.lit(0))))
    return F.when((n <= 0) | (k <= 0), F.array().cast("array<int>")).when(k >= n, every).when(k == 1, F.array(F.lit(0))).otherwise(F.sort_array(filled))


def bounded_samples(start: Column, end: Column, most: int = 192) -> Column:
    """Every so many frames of start..end, at most `most`."""
    step = F.greatest(F.ceil((end - start) / F.lit(float(most))), F.lit(1)).cast("long")
    return F.when(end > start, F.sequence(start, end - 1, step))


def stepped_samples(start: Column, end: Column, step: int, least: int = 16, most: int = 128) -> Column:
    """The same by a preferred step, with at least `least` and at most `most` frames where there are so many."""
    n = end - start
    near = F.greatest(F.lit(1), F.least(F.floor(n / least), F.lit(step))).cast("long")
    far = F.ceil(n / F.lit(float(most))).cast("long")
    return F.when(end > start, F.sequence(start, end - 1, F.when(F.ceil(n / near.cast("double")) > most, far).otherwise(near)))


def previous_frames(current: Column, draw: Column, alone: float = 0.3, low: int = 4, high: int = 16) -> Column:
    """With probability `alone` the frame itself, else low..high frames before it, too; draw: uniform in [0, 1)."""
    n = (low + F.floor((draw - alone) / (1 - alone) * (high - low + 1))).cast("long")
    return F.when(draw < alone, F.array(current)).otherwise(F.sequence(F.greatest(current - n, F.lit(0)), current))


def run_tails(frames: DataFrame, ep: list[str], value: str, *, share: float = 0.25, most: int | None = None, seed: int = 0, by: str = "frame_id") -> DataFrame:
    """The last max(1, share of its length) frames of each run; with `most`, at most so many of them, by hash order."""
    rows = islands(frames, ep, value, by=by, name="_run")
    w = Window.partitionBy(*ep, "_run")
    kept = F.greatest(F.lit(1), F.floor(F.count("*").over(w) * share))
    rows = rows.withColumn("_from", F.count("*").over(w) - kept).withColumn("_at", F.row_number().over(w.orderBy(by)) - 1).where("_at >= _from")
    if most is not None:
        rows = rows.withColumn("_i", F.row_number().over(w.orderBy(uniform(*map(F.col, [*ep, by]), seed=seed), by))).where(F.col("_i") <= most).drop("_i")
    return rows.drop("_run", "_from", "_at")


def keyframes(frames: DataFrame, ep: list[str], *, text: str = "task_description", code: str = "phash", similarity: float = 0.99, by: str = "frame_id") -> DataFrame:
    """Adds `ref`: null for a kept frame, else the last kept frame, which has the same text and a perceptual hash
    (64-bit) more similar than the threshold.

    Whether a frame is kept depends on the last kept one, so it is a fold over the episode's ordered frames, in one pass of Arrow."""
    one = F.struct(F.col(by).cast("long").alias("f"), F.col(text).alias("t"), F.col(code).cast("long").alias("h"))
    lists = frames.groupBy(*ep).agg(F.sort_array(F.collect_list(one)).alias("_all"))
    kinds = {f.name: f.dataType.simpleString() for f in frames.schema}

    def run(batches):
        for batch in batches:
            refs = []
            for rows in batch.column(len(ep)).to_pylist():
                kept, out = None, []
                for x in rows:
                    same = kept is not None and kept["t"] == x["t"] and None not in (kept["h"], x["h"]) and 1 - ((kept["h"] ^ x["h"]) & _ALL_BITS).bit_count() / 64.0 > similarity
                    out.append({"f": x["f"], "ref": kept["f"] if same else None})
                    kept = kept if same else x
                refs.append(out)
            kind = pa.list_(pa.struct([("f", pa.int64()), ("ref", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(ep)], pa.array(refs, kind)], names=[*ep, "_refs"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ep) + ", _refs array<struct<f:bigint,ref:bigint>>"
    refs = lists.mapInArrow(run, schema).select(*ep, F.explode("_refs").alias("o")).select(*ep, F.col("o.f").cast(kinds[by]).alias(by), F.col("o.ref").alias("ref"))
    return frames.join(refs, [*ep, by])


def motion(frames: DataFrame, ep: list[str], *, similarity: str = "similarity", by: str = "frame_id") -> DataFrame:
    """Adds r, a frame's share of its sequence's motion: 1.5 - similarity to the frame before, 0 for the first."""
    w = ordered(ep, by)
    d = F.when(F.row_number().over(w) == 1, F.lit(0.0)).otherwise(1.5 - F.col(similarity))
    rows = frames.withColumn("_d", d)
    return rows.withColumn("r", F.coalesce(F.try_divide("_d", F.sum("_d").over(Window.partitionBy(*ep))), F.lit(0.0))).drop("_d")


def progress_label(frames: DataFrame, ep: list[str], *, sub_task: str = "sub_task", similarity: str = "similarity", by: str = "frame_id") -> DataFrame:
    """Adds progress_frac: the share of weighted motion in real runs before a frame.  A run's weight is its length by
    the mean one, held to 0.75..1.25; other runs have none."""
    rows = islands(frames, ep, sub_task, by=by, name="_run")
    rows = motion(rows, [*ep, "_run"], similarity=similarity, by=by)
    run, whole = Window.partitionBy(*ep, "_run"), Window.partitionBy(*ep)
    real = is_real(F.col(sub_task))
    rows = rows.withColumns({"_n": F.count("*").over(run), "_first": F.row_number().over(run.orderBy(by)) == 1})
    rows = rows.withColumns({"_t": F.sum(F.when(real, 1).otherwise(0)).over(whole), "_k": F.sum(F.when(real & F.col("_first"), 1).otherwise(0)).over(whole)})
    weight = F.greatest(F.lit(0.75), F.least(F.lit(1.25), F.try_divide(F.col("_k") * F.col("_n"), F.col("_t"))))
    rows = rows.withColumn("_dp", F.when(real, weight * F.col("r")).otherwise(0.0))
    before = F.coalesce(F.sum("_dp").over(whole.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return rows.withColumn("progress_frac", F.coalesce(F.try_divide(before, F.sum("_dp").over(whole)), F.lit(0.0))).drop("_run", "_n", "_first", "_t", "_k", "_dp", "r")


def progress_estimate(frames: DataFrame, ep: list[str], *, task: str = "task", sub_task: str = "sub_task", by: str = "frame_id") -> DataFrame:
    """Adds the whole percentage by the place of a frame's run among all runs of its task run, over the number of runs that are
    neither empty nor done, and its place within the run.  Of runs with one sub-task the last one stands for all."""
    rows = islands(islands(frames, ep, task, by=by, name="_task_run"), [*ep, "_task_run"], sub_task, by=by, name="_run")
    seg = [*ep, "_task_run"]
    run, whole, same = Window.partitionBy(*seg, "_run"), Window.partitionBy(*seg), Window.partitionBy(*seg, sub_task)
    counted = F.coalesce((F.length(sub_task) > 0) & (F.col(sub_task) != "done"), F.lit(False)) & (F.row_number().over(run.orderBy(by)) == 1)
    rows = rows.withColumns({"_counts": F.when(counted, 1).otherwise(0), "_last": F.max("_run").over(same)})
    own = F.when(F.col("_run") == F.col("_last"), F.col(by))
    rows = rows.withColumns({"_valid": F.greatest(F.lit(1), F.sum("_counts").over(whole)).cast("double"), "_st": F.min(own).over(same), "_ed": F.max(own).over(same) + 1})
    within = (F.col(by) - F.col("_st")) / F.greatest(F.lit(1), F.col("_ed") - F.col("_st")).cast("double")
    share = F.col("_last") / F.col("_valid") + within / F.col("_valid")
    return rows.withColumn("progress_pct", F.least((share * 100).cast("int"), F.lit(100))).drop("_task_run", "_run", "_counts", "_last", "_valid", "_st", "_ed")


def labelled_frames(raw: DataFrame, keys: list[str], *, delay: float = 0.0) -> DataFrame:
    """Raw sub-task rows (keys, task_start, task_end, task, subtasks: array<struct<name, start_frame, complete_frame>>,
    overall_notes) as one row a frame: frame_id, task, sub_task.

    Entries in order of their completion each label the frames from the last one's end; the rest is done, or, if the
    notes or half the entries say otherwise, the last label or not done."""
    subs = F.filter("subtasks", lambda s: s["name"].isNotNull())
    rows = raw.withColumn("_subs", subs)
    both = F.filter("_subs", lambda s: s["complete_frame"].isNotNull() & s["start_frame"].isNotNull())
    length = F.col("task_end") - F.col("task_start")
    late = F.floor(F.lit(delay) * length)
    ends = F.array_sort(F.transform(both, lambda s, i: F.struct(s["complete_frame"].cast("long").alias("c"), i.alias("i"), F.least(F.col("task_end") - 1, s["complete_frame"] + late).cast("long").alias("e"), s["name"].alias("name"))))
    rows = rows.withColumn("_ends", ends)
    failed = F.size("_subs") - F.size("_ends")
    unfinished = F.coalesce(F.lower("overall_notes").contains("not completed"), F.lit(False)) | (failed >= F.size("_subs") / 2.0)
    last_name = F.get("_ends", F.size("_ends") - 1)["name"]
    rest = F.when(~unfinished, F.lit("done")).otherwise(F.coalesce(last_name, F.lit("not done")))
    last_end = F.coalesce(F.get("_ends", F.size("_ends") - 1)["e"], F.col("task_start").cast("long"))
    rows = rows.withColumns({"_rest": rest, "_last": last_end})
    frames = rows.select(*keys, "task", "_ends", "_rest", "_last", F.explode(F.sequence(F.col("task_start").cast("long"), F.col("task_end").cast("long") - 1)).alias("frame_id"))
    # the first entry whose end is past the frame: ends ascend with completion
    own = F.get(F.filter("_ends", lambda s: s["e"] > F.col("frame_id")), F.lit(0))["name"]
    return frames.select(*keys, "frame_id", "task", F.when(F.col("frame_id") < F.col("_last"), own).otherwise(F.col("_rest")).alias("sub_task"))


def rescaled(progress: Column, cutoff: Column | None = None) -> Column:
    """Progress of an unfinished task, by the share that was done (0.75 if unknown)."""
    share = F.coalesce(cutoff, F.lit(0.75)) if cutoff is not None else F.lit(0.75)
    return progress * F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))


def range_back(frames: DataFrame, ep: list[str], *, n: int | None = None, seconds: float | None = None, fps: float = 30.0, sub_task: str = "sub_task", by: str = "frame_id") -> DataFrame:
    """Adds range_start: n frames or so many seconds back, else the start of the frame's run."""
    if n is None and seconds is None:
        rows = islands(frames, ep, sub_task, by=by, name="_run")
        return rows.withColumn("range_start", F.min(by).over(Window.partitionBy(*ep, "_run"))).drop("_run")
    back = n if n is not None else int(seconds * fps)
    return frames.withColumn("range_start", F.greatest(F.col(by) - back, F.lit(0)))


def midpoint_indices(n: Column, segments: int) -> Column:
    """The middle of each of so many equal segments, as far as they lie within n frames."""
    size = n / F.lit(float(segments))
    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(segments - 1)), lambda i: F.floor(size / 2 + size * i).cast("int")), lambda i: i < n)


def floor_indices(n: Column, count: int) -> Column:
    """floor(i * n / count)."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.floor(i * n / F.lit(float(count))).cast("int"))


def slice_frames(frames: DataFrame, start: int, stop: int, step: int = 1, *, index: str = "global_index") -> DataFrame:
    """Frames start, start + step, ... below stop of the global index."""
    i = F.col(index)
    return frames.where((i >= start) & (i < stop) & (F.pmod(i - start, F.lit(step)) == 0))
