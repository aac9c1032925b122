"""Question-answer rows: generation, sampling, splits, packing, token counts.

Random choices are functions of a seed and the row's keys (taskloom.functions.hashing.uniform), so a rerun, a retried
task or another partitioning gives the same rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taskloom.functions import text as tx
from taskloom.functions.hashing import uniform
from taskloom.operators import sequence as sq
from taskloom.sources.shared import stored
from taskloom.sources.tables import bounded

PROMPTS = {
    "a1": "The task is: {task}. Divide the frames above into the actions they show; answer with a JSON list of action_description, start_frame and end_frame.",
    "a2": "Divide the frames above into the actions they show; answer with a JSON list of action_description, start_frame and end_frame.",
    "b1": "The task is: {task}. What is the next action?",
    "b2": "The task is: {task}. List all actions that are still required.",
    "c": "The task is: {task}. Which actions are still required, and how far has the task come?",
}
HANDLERS: dict[str, Callable[..., DataFrame]] = {}

#: Hash buckets that sample_each counts for each group.
BUCKETS = 4096


def handler(name: str):
    """T5: registers a question-answer handler by its task id."""

    def add(f):
        HANDLERS[name] = f
        return f

    return add


def run_handler(name: str, *args, **kw) -> DataFrame:
    """T5: the handler of a task id; an unknown one raises."""
    if name not in HANDLERS:
        raise ValueError(f"no handler for task {name}")
    return HANDLERS[name](*args, **kw)


def conversation(question: Column, answer: Column) -> Column:
    one = lambda who, v: F.struct(F.lit(who).alias("from"), v.alias("value"))
    return F.array(one("human", question), one("gpt", answer))


@handler("a")
def segment_qa(frames: DataFrame, ep: list[str], *, low: int = 32, high: int = 96, seed: int = 0, prompt: str = PROMPTS["a1"], root: str = "images") -> DataFrame:
    """An episode's evenly stepped frames (low..high of them) and, as the answer, the actions they show by sample index.

    Only the sampled frames are kept before runs are formed, so the window sees at most `high` frames an episode."""
    n = frames.groupBy(*ep).agg(F.count("*").alias("n"), F.first("task").alias("task"))
    most = (low + F.floor(uniform(*map(F.col, ep), F.lit("a"), seed=seed) * (high - low + 1))).cast("long")
    n = n.withColumn("_step", F.greatest(F.ceil(F.col("n") / most.cast("double")), F.lit(1)).cast("long"))
    picked = frames.drop("task").join(n, ep).where(F.pmod("frame_id", "_step") == 0).withColumn("sample", F.floor(F.col("frame_id") / F.col("_step")))
    runs = sq.runs(picked, ep, "sub_task", by="sample").where(sq.is_real(F.col("sub_task")))
    part = F.struct(F.col("sub_task").alias("action_description"), F.col("start").alias("start_frame"), (F.col("end") - 1).alias("end_frame"))
    ordered = F.array_sort(F.collect_list(part), lambda a, b: F.signum(a["start_frame"] - b["start_frame"]).cast("int"))
    answers = runs.groupBy(*ep).agg(F.to_json(ordered).alias("answer"))
    images = picked.groupBy(*ep, "task").agg(F.sort_array(F.collect_list("frame_id")).alias("ids"))
    marks = F.array_join(F.transform("ids", lambda x, i: F.concat(F.lit("<frame "), i.cast("string"), F.lit(">\n<image>\n"))), "")
    rows = images.join(answers, ep)
    folder = F.concat_ws("/", F.lit(root), *(F.col(c).cast("string") for c in ep))
    return rows.select(*ep, F.transform("ids", lambda i: tx.image_path(folder, i)).alias("image"), conversation(F.concat(marks, tx.filled(prompt, task=F.col("task"))), F.col("answer")).alias("conversations"))


def segment_extras(frames: DataFrame, ep: list[str], *, whole: tuple[int, int] = (32, 96), part: tuple[int, int] = (16, 64), seed: int = 0, prompt: str = PROMPTS["a2"], root: str = "images") -> DataFrame:
    """By hash no extra question for an episode, one over all of it, or two over ranges of its real sub-task runs (i to j, without
    the range of all); each asks for the actions of evenly stepped frames, numbered by sample.  Adds the range: extra, start, end (exclusive)."""
    keys = [F.col(c) for c in ep]
    draw = F.floor(uniform(*keys, F.lit("a2"), seed=seed) * 3)
    real = sq.runs(frames, ep, "sub_task").where(sq.is_real(F.col("sub_task"))).groupBy(*ep).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("real"))
    episodes = frames.groupBy(*ep).agg(F.count("*").alias("n")).join(real, ep).withColumn("_k", draw)
    last = F.size("real") - 1
    ends = lambda i: F.transform(F.sequence(i, last), lambda j: F.struct(uniform(*keys, F.lit("pair"), i, j, seed=seed).alias("u"), i.alias("i"), j.alias("j")))
    pairs = F.filter(F.flatten(F.transform(F.sequence(F.lit(0), last), ends)), lambda p: ~((p["i"] == 0) & (p["j"] == last)))
    chosen = F.transform(F.slice(F.array_sort(pairs), 1, 2), lambda p: F.struct(F.get("real", p["i"])["start"].alias("start"), F.get("real", p["j"])["end"].alias("end"), F.lit(part[0]).alias("low"), F.lit(part[1]).alias("high")))
    all_ = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n").alias("end"), F.lit(whole[0]).alias("low"), F.lit(whole[1]).alias("high")))
    pieces = episodes.select(*ep, F.posexplode(F.when(F.col("_k") == 1, all_).when(F.col("_k") == 2, chosen)).alias("extra", "p")).select(*ep, "extra", "p.*")
    most = F.col("low") + F.floor(uniform(*keys, "extra", F.lit("most"), seed=seed) * (F.col("high") - F.col("low") + 1))
    pieces = pieces.withColumn("_step", F.greatest(F.ceil((F.col("end") - F.col("start")) / most.cast("double")), F.lit(1)).cast("long")).drop("low", "high")
    inside = (F.col("frame_id") >= F.col("start")) & (F.col("frame_id") < F.col("end")) & (F.pmod(F.col("frame_id") - F.col("start"), F.col("_step")) == 0)
    picked = frames.select(*ep, "frame_id", "sub_task").join(pieces, ep).where(inside).withColumn("sample", F.floor((F.col("frame_id") - F.col("start")) / F.col("_step")))
    of = [*ep, "extra"]
    runs = sq.runs(picked.select(*of, "sample", "sub_task"), of, "sub_task", by="sample").where(sq.is_real(F.col("sub_task")))
    answers = runs.groupBy(*of).agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("start", "end", "sub_task"))), lambda s: F.struct(s["sub_task"].alias("action_description"), s["start"].alias("start_frame"), (s["end"] - 1).alias("end_frame")))).alias("answer"))
    rows = picked.groupBy(*of, "start", "end").agg(F.sort_array(F.collect_list("frame_id")).alias("ids")).join(answers, of)
    marks = F.array_join(F.transform("ids", lambda x, i: F.concat(F.lit("<frame "), i.cast("string"), F.lit(">\n<image>\n"))), "")
    folder = F.concat_ws("/", F.lit(root), *(F.col(c).cast("string") for c in ep))
    return rows.select(*of, "start", "end", F.transform("ids", lambda i: tx.image_path(folder, i)).alias("image"), conversation(F.concat(marks, F.lit(prompt)), F.col("answer")).alias("conversations"))


def _sampled(frames: DataFrame, ep: list[str], progress: str, *, skip: float, finished_most: int, seed: int, salt: str) -> DataFrame:
    """Frames left by the skip ratio, with at most so many finished ones an episode (chosen by hash)."""
    key = [F.col(c) for c in [*ep, "frame_id"]]
    rows = frames.where(uniform(*key, F.lit(salt), seed=seed) >= skip).withColumn("finished", F.col(progress) >= 1)
    w = Window.partitionBy(*ep, "finished").orderBy(uniform(*key, F.lit(salt + "order"), seed=seed))
    return rows.withColumn("_n", F.row_number().over(w)).where(~F.col("finished") | (F.col("_n") <= finished_most)).drop("_n")


def _with_images(rows: DataFrame, ep: list[str], seed: int, salt: str, root: str) -> DataFrame:
    draw = uniform(*(F.col(c) for c in [*ep, "frame_id"]), F.lit(salt + "back"), seed=seed)
    folder = F.concat_ws("/", F.lit(root), *(F.col(c).cast("string") for c in ep))
    return rows.withColumn("image", F.transform(sq.previous_frames(F.col("frame_id"), draw), lambda i: tx.image_path(folder, i)))


@handler("b")
def next_action_qa(frames: DataFrame, ep: list[str], *, skip: float = 0.4, finished_most: int = 10, seed: int = 0, root: str = "images") -> DataFrame:
    """The next action or all planned ones (by chance), from the frame after; a finished frame answers with its reason, or is
    left out without one.  Input: frame_id, task, sub_task, cot, planned_actions, progress_frac."""
    w = sq.ordered(ep)
    after = {c: F.lead(c).over(w) for c in ("progress_frac", "sub_task", "planned_actions")}
    rows = frames.withColumns({f"_{c}": v for c, v in after.items()}).where("_progress_frac is not null")
    rows = _with_images(_sampled(rows, ep, "_progress_frac", skip=skip, finished_most=finished_most, seed=seed, salt="b"), ep, seed, "b", root)
    reason = tx.finish_reason(F.col("cot"))
    rows = rows.where(~F.col("finished") | reason.isNotNull())
    one = uniform(*(F.col(c) for c in [*ep, "frame_id"]), F.lit("bkind"), seed=seed) < 0.5
    prompt = F.when(one, tx.filled(PROMPTS["b1"], task=F.col("task"))).otherwise(tx.filled(PROMPTS["b2"], task=F.col("task")))
    answer = F.when(F.col("finished"), F.concat(F.lit("No action required. "), reason, F.lit("."))).when(one, F.col("_sub_task")).otherwise(tx.numbered(F.col("_planned_actions")))
    question = F.concat(F.repeat(F.lit("<image>\n"), F.size("image")), prompt)
    return rows.select(*ep, "frame_id", "image", conversation(question, answer).alias("conversations"))


@handler("c")
def progress_qa(frames: DataFrame, ep: list[str], *, skip: float = 0.2, finished_most: int = 10, seed: int = 0, root: str = "images") -> DataFrame:
    """What is still required and the progress, with two decimals, halves to even."""
    rows = _with_images(_sampled(frames, ep, "progress_frac", skip=skip, finished_most=finished_most, seed=seed, salt="c"), ep, seed, "c", root)
    reason = tx.finish_reason(F.col("cot"))
    rows = rows.where(~F.col("finished") | reason.isNotNull())
    done = F.concat(reason, F.lit(".\nTherefore, the estimated progress is <progress>100%</progress>."))
    steps = F.concat(F.lit("The following actions are required: \n"), tx.numbered(F.col("planned_actions")), F.lit("\nTherefore, the estimated progress is <progress>"), F.format_string("%.2f%%", F.bround(F.col("progress_frac") * 100, 2)), F.lit("</progress>."))
    question = F.concat(F.repeat(F.lit("<image>\n"), F.size("image")), tx.filled(PROMPTS["c"], task=F.col("task")))
    return rows.select(*ep, "frame_id", "image", conversation(question, F.when(F.col("finished"), done).otherwise(steps)).alias("conversations"))


def one_shot_rows(rows: DataFrame, *, times: int = 3, cutoff: str = "cutoff") -> DataFrame:
    """Finished rows three times; unfinished ones with planned actions once, their progress scaled to the share done."""
    scaled = F.when(F.col("finished"), F.col("progress_frac")).otherwise(sq.rescaled(F.col("progress_frac"), F.col(cutoff)))
    kept = rows.where(F.col("finished") | (F.size("planned_actions") > 0)).withColumn("progress_frac", scaled)
    return kept.withColumn("copy", F.explode(F.when(F.col("finished"), F.sequence(F.lit(1), F.lit(times))).otherwise(F.array(F.lit(1)))))


def sample_each(rows: DataFrame, groups: list[str], keys: list[str], rate: Column | float, *, at_least: int = 1, seed: int = 0) -> DataFrame:
    """int(n * rate) rows of each group, `at_least` at the least, without replacement, by hash order; a rate that is a column is one of the group.

    Hashes are counted in BUCKETS of each group first, on the map side.  That tells the bucket in which the last row taken lies, so
    only rows up to it are shuffled, and by group and bucket: a group of any size is spread over many tasks."""
    rate = F.lit(rate) if isinstance(rate, (int, float)) else rate
    u = uniform(*map(F.col, keys), seed=seed)
    own = [F.col(c).alias(f"_g{i}") for i, c in enumerate(groups)]
    names = [f"_g{i}" for i in range(len(groups))]
    counts = rows.select(*own, F.floor(u * BUCKETS).alias("_b"), rate.alias("_rate")).groupBy(*names, "_b").agg(F.count("*").alias("_c"), F.first("_rate").alias("_rate"))
    w = Window.partitionBy(*names)
    n = F.sum("_c").over(w)
    counts = counts.withColumns({"_upto": F.sum("_c").over(w.orderBy("_b")), "_want": F.least(n, F.greatest(F.lit(at_least), F.floor(n * F.first("_rate").over(w.orderBy("_b")))))})
    border = stored(counts.where("_upto - _c < _want and _want <= _upto").select(*names, F.col("_b").alias("_border"), (F.col("_want") - F.col("_upto") + F.col("_c")).alias("_rest")), "sample-borders")
    same = F.lit(True)
    for c, name in zip(groups, names):
        same = same & rows[c].eqNullSafe(border[name])
    kept = rows.join(bounded(border), same).withColumn("_b", F.floor(u * BUCKETS)).where("_b <= _border")
    place = F.row_number().over(Window.partitionBy(*names, "_b").orderBy(u, *keys))
    return kept.withColumn("_i", place).where("_b < _border or _i <= _rest").select(rows.columns)


def sample_rate(rows: DataFrame, keys: list[str], rate: float, *, seed: int = 0) -> DataFrame:
    """T7 over a whole corpus: a row is taken if its hash is below the rate; no shuffle, and the count is n * rate on average."""
    return rows.where(uniform(*map(F.col, keys), seed=seed) < rate)


def shuffled(rows: DataFrame, keys: list[str], *, seed: int = 0) -> DataFrame:
    """In hash order."""
    return rows.orderBy(uniform(*map(F.col, keys), seed=seed), *keys)


def split_episodes(rows: DataFrame, *, train: float, test: float, valid: float, selected_test: DataFrame | None = None, valid_datasets=(), disabled_clusters=(), datasets=None, seed: int = 0) -> DataFrame:
    """Adds split (train, test, valid) by (dataset, episode): all rows of an episode go together."""
    if valid_datasets and valid > 0:
        raise ValueError("valid must be 0 when valid_datasets are given")
    if train + test + valid != 1.0:
        raise ValueError("the ratios must sum to 1")
    if disabled_clusters:
        rows = rows.where(~F.col("cluster").isin(list(disabled_clusters)))
    if datasets is not None:
        rows = rows.where(F.col("dataset").isin(list(datasets)))
    r = uniform(F.col("dataset"), F.col("episode"), seed=seed)
    plain = F.when(r < train, "train").when(r < train + test, "test").otherwise("valid")
    if selected_test is not None:
        listed = selected_test.select(F.col("dataset_name").alias("dataset"), F.col("episode_name").alias("episode"), F.lit(True).alias("_listed")).distinct()
        rows = rows.join(listed, ["dataset", "episode"], "left")
        again = uniform(F.col("dataset"), F.col("episode"), F.lit("rest"), seed=seed)
        share = train / (train + valid) if train + valid else 0.0
        plain = F.when(F.col("_listed"), F.when(r < 0.3, "test").when(again < share, "train").otherwise("valid")).otherwise(plain)
    fixed = F.col("dataset").isin(list(valid_datasets)) if valid_datasets else F.lit(False)
    return rows.withColumn("split", F.when(fixed, "valid").otherwise(plain)).drop("_listed")


def context_split(rows: DataFrame, *, least: int, most: int, both: float = 0.01, least_duration: float = 1.0, keys: list[str], seed: int = 0) -> DataFrame:
    """Adds part: long for least..most tokens; shorter rows are short and a share of them long as well; longer ones and videos
    under a second go.  All files' rows are kept together, so none is overwritten."""
    n = F.col("num_tokens")
    ok = F.col("duration").isNull() | (F.col("duration") >= least_duration) if "duration" in rows.columns else F.lit(True)
    chance = uniform(*map(F.col, keys), seed=seed) < both
    parts = F.when((n >= least) & (n <= most), F.array(F.lit("long"))).when(n < least, F.when(chance, F.array(F.lit("short"), F.lit("long"))).otherwise(F.array(F.lit("short"))))
    return rows.where(ok & (n <= most)).withColumn("part", F.explode(parts))


def best_fit(sizes: list[int], volume: int) -> list[int]:
    """Bin of each item: from large to small into the fullest bin that still has room; an item above the volume alone."""
    bins: list[int] = []
    room: list[tuple[int, int]] = []  # (room left, bin), by room
    out = [0] * len(sizes)
    import bisect

    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect.bisect_left(room, (sizes[i], -1))
        if sizes[i] <= volume and at < len(room):
            left, b = room.pop(at)
        else:
            left, b = volume, len(bins)
            bins.append(b)
        out[i] = b
        if left - sizes[i] > 0:
            bisect.insort(room, (left - sizes[i], b))
    return out


def packed(rows: DataFrame, *, volume: int, order: str, size: str = "num_tokens", batch: int = 4096, groups: list[str] = ()) -> DataFrame:
    """Adds pack_id (group's batch and bin).  Batches of `batch` consecutive rows are packed apart, so a group's rows are dealt to
    as many tasks as it has batches.

    The running number within a group comes from counts of ranges of the order column, not from one window over the group."""
    rows = numbered(rows, groups=list(groups), order=order)
    rows = rows.withColumn("batch", F.floor(F.col("_row") / batch)).drop("_row")
    types = {f.name: f.dataType.simpleString() for f in rows.schema}

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order).reset_index(drop=True)
        pdf["bin"] = best_fit(pdf[size].fillna(0).astype(int).tolist(), volume)
        return pdf

    schema = ", ".join(f"`{c}` {t}" for c, t in types.items()) + ", bin int"
    out = rows.groupBy(*groups, "batch").applyInPandas(pack, schema)
    return out.withColumn("pack_id", F.concat_ws("-", *groups, "batch", "bin"))


def numbered(rows: DataFrame, *, groups: list[str], order: str, ranges: int | None = None, name: str = "_row") -> DataFrame:
    """Adds the number of a row in the order of its group, from 0, for groups of any size: rows are range-partitioned by
    (groups, order) and numbered within their partition after the counts of the ones before."""
    spark = rows.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *groups, order).withColumn("_part", F.spark_partition_id())
    from taskloom.sources.shared import stored

    dealt = stored(dealt, "numbered")
    counts = dealt.groupBy(*groups, "_part").agg(F.count("*").alias("_c"))
    before = counts.select(*groups, "_part", (F.sum("_c").over(Window.partitionBy(*groups).orderBy("_part")) - F.col("_c")).alias("_before"))
    inner = F.row_number().over(Window.partitionBy(*groups, "_part").orderBy(order)) - 1
    return dealt.withColumn("_in", inner).join(before, [*groups, "_part"]).withColumn(name, F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")


def token_total(turn_tokens: Column, image_grids: Column | None = None, video_grids: Column | None = None) -> Column:
    """21 + tokens of the turns + a quarter of the patches of images, or else of videos; grids: array<array<int>> of
    (t, h, w)."""
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda s, x: s + x)
    patches = lambda g: F.aggregate(g, F.lit(0).cast("long"), lambda s, x: s + F.aggregate(x, F.lit(1).cast("long"), lambda a, b: a * b))
    out = F.lit(21) + total(turn_tokens)
    quarter = lambda g: F.floor(patches(g) / 4)
    if image_grids is not None:
        video = F.when(video_grids.isNotNull(), quarter(video_grids)).otherwise(0) if video_grids is not None else F.lit(0)
        return out + F.when(image_grids.isNotNull(), quarter(image_grids)).otherwise(video)
    return out + (F.when(video_grids.isNotNull(), quarter(video_grids)).otherwise(0) if video_grids is not None else 0)


def video_frames(total: Column, fps: Column, *, interval: float, least: int, most: int) -> Column:
    """The distinct whole steps from the first to the last frame, one each `interval` seconds within least..most."""
    n = F.least(F.greatest(F.bround(total / fps / interval).cast("int"), F.lit(least)), F.lit(most))
    step = lambda i: F.floor(i * ((total - 1) / F.greatest(n - 1, F.lit(1)).cast("double")) + 1e-9).cast("int")
    return F.when(n == 1, F.array(F.lit(0))).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(0), n - 1), step)))


def word_length(conversations: Column, has_image: Column, image_tokens: int = 128) -> Column:
    """Words of all turns, and a constant for images."""
    words = F.aggregate(conversations, F.lit(0), lambda s, t: s + tx.word_count(t["value"]))
    return words + F.when(has_image, image_tokens).otherwise(0)


def modality_length(conversations: Column, has_media: Column) -> Column:
    """Words of all turns, negative for rows without media."""
    words = F.aggregate(conversations, F.lit(0), lambda s, t: s + tx.word_count(t["value"]))
    return F.when(has_media, words).otherwise(-words)


def worker_shares(sizes: dict[str, int], world: int) -> list[tuple[int, str, int, int]]:
    """(worker, dataset, parts, part): large datasets get whole workers by their share, the others go from large to small to the least
    loaded one left; a worker without data raises.  A table over datasets, not rows."""
    order = sorted(sizes.items(), key=lambda x: (-x[1], x[0]))
    mean = sum(sizes.values()) / world
    out, load, at = [], [0] * world, 0
    while order and at < world and order[0][1] >= mean:
        parts = round(order[0][1] / mean)
        if at + parts >= world and len(order) > 1:
            break
        name, n = order.pop(0)
        parts = min(parts, world - at)  # the last one: no part may be without a worker
        for k in range(parts):
            out.append((at, name, parts, k))
            load[at] = round(n / parts)
            at += 1
    free = [(load[w], w) for w in range(at, world)]
    heapq.heapify(free)
    if order and not free:
        raise ValueError("more workers than the datasets can fill")
    for name, n in order:
        have, w = heapq.heappop(free)
        out.append((w, name, 1, 0))
        heapq.heappush(free, (have + n, w))
        load[w] = have + n
    if len({o[0] for o in out}) < world:
        raise ValueError("more workers than the datasets can fill")
    return sorted(out)


def balance_skew(loads: DataFrame, load: str = "frames") -> DataFrame:
    """(largest - smallest) / smallest load."""
    return loads.agg(((F.max(load) - F.min(load)) / F.min(load)).alias("skew"))


def cost_chunks(costs: list[float], budget: float) -> list[list[int]]:
    """Item numbers by chunk, from dear to cheap: a chunk costs its dearest item times its size and stays within the budget."""
    out: list[list[int]] = []
    for i in sorted(range(len(costs)), key=lambda i: -costs[i]):
        if out and costs[out[-1][0]] * (len(out[-1]) + 1) <= budget:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def with_chunks(rows: DataFrame, groups: list[str], *, cost: str, budget: float, key: str) -> DataFrame:
    """Adds chunk, by group (a micro-batch)."""
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, kind="stable").reset_index(drop=True)
        pdf["chunk"] = 0
        for n, items in enumerate(cost_chunks(pdf[cost].tolist(), budget)):
            pdf.loc[items, "chunk"] = n
        return pdf

    return rows.groupBy(*groups).applyInPandas(run, types + ", chunk int")


def collated(rows: DataFrame, pack: str = "pack_id", *, order: str, size: str = "num_tokens") -> DataFrame:
    """Adds where a row starts and ends in its pack's concatenated sequence."""
    w = Window.partitionBy(pack).orderBy(order)
    return rows.withColumns({"seq_end": F.sum(size).over(w), "seq_start": F.sum(size).over(w) - F.col(size)})


def answer_mask(ids: Column, start: int = 77091, end: int = 151645, ignore: int = -100) -> Column:
    """Labels: the ids from the second after each start token to the end token and the one after that, the others ignored;
    an answer that never ends is ignored.  The fold keeps one span an answer, not a copy of the ids a token."""
    spans = "array<struct<a:int,b:int>>"
    state = F.struct(F.lit(-1).alias("open"), F.array().cast(spans).alias("spans"))
    placed = F.transform(ids, lambda x, i: F.struct(x.alias("x"), i.alias("i")))

    def step(a, p):
        ends = (a["open"] >= 0) & (p["i"] >= a["open"]) & (p["x"] == end)
        starts = (a["open"] < 0) & (p["x"] == start)
        open_ = F.when(ends, -1).when(starts, p["i"] + 2).otherwise(a["open"])
        return F.struct(open_.alias("open"), F.when(ends, F.concat(a["spans"], F.array(F.struct(a["open"].alias("a"), (p["i"] + 1).alias("b"))))).otherwise(a["spans"]).alias("spans"))

    found = F.aggregate(placed, state, step, lambda a: a["spans"])
    kept = lambda s: F.transform(ids, lambda x, i: F.when(F.exists(s, lambda p: (p["a"] <= i) & (i <= p["b"])), x).otherwise(F.lit(ignore)))
    return F.element_at(F.transform(F.array(found), kept), 1)


def preview(rows: DataFrame, keys: list[str], *, seed: int = 0, n: int = 1) -> DataFrame:
    """N rows by hash order (a top-n, no full sort)."""
    return rows.orderBy(uniform(*map(F.col, keys), seed=seed), *keys).limit(n)


def check_episodes(episodes: DataFrame, files: DataFrame, keys: list[str], groups: list[str], *, least: int, rate: float, seed: int = 0) -> DataFrame:
    """Of each group's episodes that have a file max(least, n * rate) by hash order."""
    return sample_each(episodes.join(files.select(*keys).distinct(), keys, "left_semi"), groups, keys, rate, at_least=least, seed=seed)


def token_totals(rows: DataFrame, threshold: int) -> DataFrame:
    """Rows, tokens and rows above the threshold by cluster and dataset, with totals (null keys)."""
    return rows.rollup("cluster", "dataset").agg(F.count("*").alias("n_rows"), F.sum("num_tokens").alias("tokens"), F.count_if(F.col("num_tokens") > threshold).alias("long_rows"))


def absolute_paths(paths: Column, root: str) -> Column:
    """Each path below the root; an absolute one stays."""
    return F.transform(paths, lambda p: F.when(p.startswith("/"), p).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), p)))


def messages(text: Column, media: Column, mark: str = "<image>") -> Column:
    """array<struct<type, value>> of a human text: its pieces and, at each mark, the next medium.  Null if there are
    more or fewer marks than media."""
    pieces = F.split(text, mark, -1)
    plain = lambda i: F.struct(F.lit("text").alias("type"), F.trim(F.get(pieces, i)).alias("value"))
    medium = lambda i: F.struct(F.lit("image").alias("type"), F.get(media, i).alias("value"))
    both = F.flatten(F.transform(F.sequence(F.lit(0), F.size(pieces) - 1), lambda i: F.array(plain(i), medium(i))))
    kept = F.filter(F.slice(both, F.lit(1), F.size(both) - 1), lambda m: (m["type"] != "text") | (m["value"] != ""))
    return F.when(F.size(pieces) - 1 == F.size(media), kept)


def chat_messages(conversations: Column, images: Column, videos: Column) -> Column:
    """array<struct<role, content: array<struct<type, value>>>> of turns (struct<from, value>): a human turn's text is parted at each
    <image> and <video>, which take the next image or video of the row; other turns are one text.  More or fewer marks than media raise."""
    parts = lambda t: F.split(F.regexp_replace(t, "(<image>|<video>)", "\u0000$1\u0000"), "\u0000", -1)
    human = lambda c: c["from"] == "human"
    asked = lambda turns: F.flatten(F.transform(F.filter(turns, human), lambda c: parts(c["value"])))
    count = lambda xs, mark: F.size(F.filter(xs, lambda s: s == mark))
    media = {"image": F.coalesce(images, F.array().cast("array<string>")), "video": F.coalesce(videos, F.array().cast("array<string>"))}
    one = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("value"))

    def content(c, i):
        before, own = asked(F.slice(conversations, F.lit(1), i)), parts(c["value"])
        nth = lambda kind, k: F.get(media[kind], count(before, f"<{kind}>") + count(F.slice(own, F.lit(1), k), f"<{kind}>"))
        pieces = F.transform(own, lambda s, k: F.when(s == "<image>", one("image", nth("image", k))).when(s == "<video>", one("video", nth("video", k))).otherwise(one("text", tx.stripped(s))))
        return F.filter(pieces, lambda p: (p["type"] != "text") | (p["value"] != ""))

    turn = lambda c, i: F.struct(F.when(human(c), "user").otherwise("assistant").alias("role"), F.when(human(c), content(c, i)).otherwise(F.array(one("text", c["value"]))).alias("content"))
    fits = (count(asked(conversations), "<image>") == F.size(media["image"])) & (count(asked(conversations), "<video>") == F.size(media["video"]))
    kind = "array<struct<role:string,content:array<struct<type:string,value:string>>>>"
    return F.when(fits, F.transform(conversations, turn)).otherwise(F.raise_error(F.lit("the marks and the media of a row differ in number")).cast(kind))


def without_deleted(segments: DataFrame, desc: str = "desc") -> DataFrame:
    """Segments that are not marked to be deleted."""
    return segments.where(F.trim(desc) != "/delete")


def halved(batch: list, run, *, too_large=MemoryError) -> list:
    """run(batch), by halves where it is too large; results in the batch's order."""
    try:
        return list(run(batch))
    except too_large:
        if len(batch) == 1:
            raise
        mid = math.ceil(len(batch) / 2)
        return halved(batch[:mid], run, too_large=too_large) + halved(batch[mid:], run, too_large=too_large)
