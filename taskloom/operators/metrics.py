"""Evaluation metrics over predictions: rows of seq, episode, pred_txt, gt_txt.

Per-episode metrics group with map-side partial aggregates where their formula allows it; rank metrics window over one
episode.  Averages are unweighted over episodes with two rows or more, 0 if there is none.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taskloom.functions.loose_json import loose_json
from taskloom.functions.text import is_segment_list, progress_value, states_progress


def parsed(rows: DataFrame, *, clamp: bool = False) -> DataFrame:
    """seq, episode, p, g: rows whose two texts state a number."""
    hold = (lambda c: F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))) if clamp else (lambda c: c)
    out = rows.select("seq", "episode", progress_value(F.col("pred_txt")).alias("p"), progress_value(F.col("gt_txt")).alias("g"))
    return out.where("p is not null and g is not null").select("seq", "episode", hold(F.col("p")).alias("p"), hold(F.col("g")).alias("g"))


def mean_score(scores: DataFrame, name: str) -> DataFrame:
    return scores.agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias(name))


def episode_ccc(rows: DataFrame) -> DataFrame:
    """A1: concordance of each episode; 0 where a side doesn't vary."""
    a = parsed(rows, clamp=True).groupBy("episode").agg(F.count("*").alias("n"), F.var_pop("p").alias("vp"), F.var_pop("g").alias("vg"), F.covar_pop("p", "g").alias("c"), F.avg("p").alias("mp"), F.avg("g").alias("mg"))
    ccc = 2 * F.col("c") / (F.col("vp") + F.col("vg") + F.pow(F.col("mp") - F.col("mg"), 2.0) + 1e-8)
    return a.where("n >= 2").select("episode", F.when((F.col("vp") < 1e-8) | (F.col("vg") < 1e-8), 0.0).otherwise(ccc).alias("score"))


def ubr(rows: DataFrame, width: float = 5.0) -> DataFrame:
    """A2: of each episode distinct predicted by distinct true bins, for true values strictly within 0..100."""
    kept = parsed(rows, clamp=True).where("g > 0 and g < 100")
    bins = lambda c: F.bround(F.col(c) / width) * width
    a = kept.groupBy("episode").agg(F.count("*").alias("n"), F.count_distinct(bins("p")).alias("bp"), F.count_distinct(bins("g")).alias("bg"))
    return a.where("n >= 2").select("episode", (F.col("bp") / F.col("bg")).alias("score"))


def episode_epr(rows: DataFrame, tau: float = 0.5, k_max: int = 1000) -> DataFrame:
    """A3: log2 of the finest resolution k at which at least tau of the bins are in use; predictions only."""
    p = rows.select("episode", progress_value(F.col("pred_txt")).alias("p")).where("p is not null")
    lists = p.groupBy("episode").agg(F.collect_list(F.struct(F.lit(0).cast("long").alias("seq"), "p", F.lit(None).cast("double").alias("g"))).alias("xs"))
    return scored_lists(lists, {"epr": lambda x: epr_of(x.p, tau, k_max)}).where("epr is not null").select("episode", F.col("epr").alias("score"))


def mcc(rows: DataFrame, threshold: float = 95.0) -> DataFrame:
    """A4: Matthews correlation of reaching the threshold, over all rows."""
    r = parsed(rows)
    done_p, done_g = F.col("p") >= threshold, F.col("g") >= threshold
    n = lambda c: F.count_if(c).cast("double")
    a = r.agg(n(done_p & done_g).alias("tp"), n(~done_p & ~done_g).alias("tn"), n(done_p & ~done_g).alias("fp"), n(~done_p & done_g).alias("fn"))
    return a.select(F.expr("(tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) + 1e-8)").alias("mcc"))


def episode_kendall(rows: DataFrame) -> DataFrame:
    """A5: Kendall tau-a of each episode: pairs with a tie count 0."""
    lists = parsed(rows).groupBy("episode").agg(F.collect_list(F.struct(F.lit(0).cast("long").alias("seq"), "p", "g")).alias("xs"))
    return scored_lists(lists, {"kt": kendall_of}).where("kt is not null").select("episode", F.col("kt").alias("score"))


def episode_voc(rows: DataFrame) -> DataFrame:
    """Spearman correlation of the order by truth (ties by seq) with the prediction; 0 if that is constant."""
    by_truth = Window.partitionBy("episode").orderBy("g", "seq")
    by_pred = Window.partitionBy("episode").orderBy("p")
    r = parsed(rows).select("episode", F.row_number().over(by_truth).cast("double").alias("t"), (F.rank().over(by_pred) + (F.count("*").over(Window.partitionBy("episode", "p")) - 1) / 2.0).alias("r"))
    a = r.groupBy("episode").agg(F.count("*").alias("n"), F.covar_pop("t", "r").alias("c"), F.var_pop("t").alias("vt"), F.var_pop("r").alias("vr")).where("n >= 2")
    s = F.coalesce(F.try_divide("c", F.sqrt(F.col("vt") * F.col("vr"))), F.lit(0.0))
    return a.select("episode", F.when(s.between(-1.0 - 1e-9, 1.0 + 1e-9), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s))).otherwise(0.0).alias("score"))


SEGMENT_RESULT = "struct<tp:long,fp:long,fn:long,matched_count:long,err_sum:double,f1:double,mae:double>"


def boundary_list(segments) -> list[float] | None:
    """Distinct least and greatest number of each object with two numbers or more; None if it is no list."""
    if not isinstance(segments, list):
        return None
    found = set()
    for s in segments:
        numbers = [float(v) for v in s.values() if isinstance(v, (int, float))] if isinstance(s, dict) else []
        if len(numbers) >= 2:
            found |= {min(numbers), max(numbers)}
    return sorted(found)


def matched_errors(a: list[float], b: list[float]) -> list[float]:
    """Distances of a cheapest matching of two sorted lists, by dynamic programming over order-preserving matchings
    (one of which is always cheapest).  Of equally cheap ones: pair as early as possible from the end."""
    if len(a) > len(b):
        a, b = b, a
    n, m = len(a), len(b)
    cost = [[0.0] * (m + 1)] + [[float("inf")] * (m + 1) for _ in range(n)]
    for i in range(1, n + 1):
        for j in range(i, m + 1):
            cost[i][j] = min(cost[i][j - 1], cost[i - 1][j - 1] + abs(a[i - 1] - b[j - 1]))
    out, i, j = [], n, m
    while i:
        if cost[i][j] == cost[i - 1][j - 1] + abs(a[i - 1] - b[j - 1]):
            out.append(abs(a[i - 1] - b[j - 1]))
            i -= 1
        j -= 1
    return out[::-1]


def segment_score(pred_txt: str | None, gt_txt: str | None, sigma: float = 5.0) -> dict:
    """Boundaries matched within sigma percent of the true span."""
    zero = {"tp": 0, "fp": 0, "fn": 0, "matched_count": 0, "err_sum": 0.0, "f1": 0.0, "mae": 0.0}
    pred, gt = boundary_list(loose_json(pred_txt)), boundary_list(loose_json(gt_txt))
    if pred is None or gt is None:
        return zero
    if not pred or not gt:
        return zero | {"fp": len(pred), "fn": len(gt), "f1": float(not pred and not gt)}
    span = gt[-1] - gt[0] or pred[-1] - pred[0]
    good = [e for e in matched_errors(gt, pred) if e <= sigma / 100.0 * span]
    tp = len(good)
    return {"tp": tp, "fp": len(pred) - tp, "fn": len(gt) - tp, "matched_count": tp, "err_sum": sum(good), "f1": 2 * tp / (len(pred) + len(gt)), "mae": sum(good) / tp if tp else 0.0}


def segmentation(rows: DataFrame) -> DataFrame:
    """Adds the fields of segment_score to rows with pred_txt and gt_txt."""

    @F.pandas_udf(SEGMENT_RESULT)
    def score(pred: pd.Series, gt: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([segment_score(p, g) for p, g in zip(pred, gt)], columns=["tp", "fp", "fn", "matched_count", "err_sum", "f1", "mae"])

    return rows.withColumn("_s", score("pred_txt", "gt_txt")).select(*rows.columns, "_s.*")


def segmentation_totals(scored: DataFrame) -> DataFrame:
    """Metric, value; a metric whose denominator is 0 is left out."""
    a = scored.agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "matched_count", "err_sum")))
    bf1 = F.struct(F.lit("BF1@5").alias("metric"), F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("value"))
    mae = F.struct(F.lit("mMAE").alias("metric"), F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0, F.coalesce(F.try_divide("err_sum", "matched_count"), F.lit(0.0))).alias("value"))
    return a.select(F.explode(F.array(bf1, mae)).alias("m")).select("m.*").where("value is not null")


def soft_f1(similarity: list[list[float]]) -> float:
    """Soft F1 of the best matching of two phrase lists by similarity; 0 if one is empty."""
    n, m = len(similarity), len(similarity[0]) if similarity else 0
    if not n or not m:
        return 0.0
    total = sum(similarity[i][j] for i, j in best_matching(similarity))
    p, r = total / n, total / m
    return 2 * p * r / (p + r) if p + r else 0.0


def phrase_scores(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Adds score: soft F1 of two lists of phrase vectors by their cosines held to 0..1."""
    import numpy as np

    def unit(m) -> np.ndarray:
        x = np.array([np.asarray(v, float) for v in m]) if len(m) else np.zeros((0, 1))
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

    def run(parts):
        for pdf in parts:
            pdf["score"] = [soft_f1(np.clip(unit(x) @ unit(y).T, 0, 1).tolist()) if len(x) and len(y) else 0.0 for x, y in zip(pdf[a], pdf[b])]
            yield pdf.drop(columns=[a, b])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in (a, b))
    return rows.mapInPandas(run, f"{kept}, score double")


def best_matching(weight: list[list[float]]) -> list[tuple[int, int]]:
    """Pairs of a matching of greatest weight (Kuhn-Munkres by shortest augmenting paths with potentials)."""
    flip = len(weight) > len(weight[0])
    w = [list(c) for c in zip(*weight)] if flip else weight
    n, m = len(w), len(w[0])
    u, v, owner, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        owner[0], at = i, 0
        slack, used = [float("inf")] * (m + 1), [False] * (m + 1)
        while owner[at]:
            used[at], row, delta, to = True, owner[at], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    c = -w[row - 1][j - 1] - u[row] - v[j]
                    if c < slack[j]:
                        slack[j], way[j] = c, at
                    if slack[j] < delta:
                        delta, to = slack[j], j
            for j in range(m + 1):
                if used[j]:
                    u[owner[j]] += delta
                    v[j] -= delta
                else:
                    slack[j] -= delta
            at = to
        while at:
            owner[at] = owner[way[at]]
            at = way[at]
    return sorted((j - 1, owner[j] - 1) if flip else (owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j])


def cosine(a: Column, b: Column) -> Column:
    """A10: cosine of two vectors held to 0..1; 0 for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
    c = F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def label_similarity(a: Column, b: Column, va: Column, vb: Column) -> Column:
    """A10: 1 for labels that are equal up to case and blanks around, else the cosine of their mean word vectors; 0 without one."""
    same = F.lower(F.trim(a)) == F.lower(F.trim(b))
    return F.when(same, 1.0).when(va.isNull() | vb.isNull(), 0.0).otherwise(cosine(va, vb))


class Points:
    """One episode's predictions p, truths g and order seq; `both` are those with a truth."""

    def __init__(self, seq: np.ndarray, p: np.ndarray, g: np.ndarray):
        self.seq, self.p, self.g = seq, p, g

    @property
    def both(self) -> Points:
        known = ~np.isnan(self.g)
        return self if known.all() else Points(self.seq[known], self.p[known], self.g[known])


def ccc_of(x: Points) -> float:
    p, g = np.clip(x.p, 0, 100), np.clip(x.g, 0, 100)
    vp, vg = p.var(), g.var()
    if vp < 1e-8 or vg < 1e-8:
        return 0.0
    return float(2 * ((p - p.mean()) * (g - g.mean())).mean() / (vp + vg + (p.mean() - g.mean()) ** 2 + 1e-8))


def epr_of(p: np.ndarray, tau: float = 0.5, k_max: int = 1000) -> float:
    """n distinct values fill at most n bins, so only k up to n / tau can pass; p / 100 / (1 / k) in this order, since it decides ties."""
    values = np.unique(np.clip(p, 0, 100))
    for top in range(min(k_max, math.ceil(len(values) / tau) + 1), 0, -64):
        k = np.arange(top, max(0, top - 64), -1)
        bins = np.floor(values / 100.0 / (1.0 / k[:, None]))
        used = 1 + (bins[:, 1:] != bins[:, :-1]).sum(axis=1)
        if len(good := np.flatnonzero((1.0 / k) * used >= tau)):
            return math.log2(k[good[0]])
    return 0.0


def inversions(a: np.ndarray) -> int:
    """Pairs i < j with a[i] > a[j], by halves."""
    if len(a) <= 128:
        return int(np.count_nonzero(np.triu(a[:, None] > a, 1)))
    left, right = a[: len(a) // 2], a[len(a) // 2 :]
    across = len(left) * len(right) - int(np.searchsorted(np.sort(left), right, side="right").sum())
    return inversions(left) + inversions(right) + across


def kendall_of(x: Points) -> float:
    """By sorting: pairs without a tie, less twice those in the other order."""
    n = len(x.p)
    tied = lambda *cols: sum(c * (c - 1) // 2 for c in np.unique(np.stack(cols), axis=1, return_counts=True)[1].tolist())
    pairs = n * (n - 1) // 2 - tied(x.g) - tied(x.p) + tied(x.g, x.p)
    return 2 * (pairs - 2 * inversions(x.p[np.lexsort((x.p, x.g))])) / (n * (n - 1))


def voc_of(x: Points) -> float:
    p = x.p[np.lexsort((x.seq, x.g))]
    _, place, count = np.unique(p, return_inverse=True, return_counts=True)
    last = np.cumsum(count)
    r, t = (last - (count - 1) / 2.0)[place], np.arange(1.0, len(p) + 1)
    scale = math.sqrt(t.var() * r.var())
    s = float(((t - t.mean()) * (r - r.mean())).mean() / scale) if scale else 0.0
    return max(-1.0, min(1.0, s))


def scored_lists(lists: DataFrame, scores: dict) -> DataFrame:
    """The columns of lists but xs (array of seq, p, g of one episode) and a double for each function of Points; null for fewer than two points."""
    kept = [f for f in lists.schema if f.name != "xs"]

    def run(batches):
        for batch in batches:
            xs = batch.column(batch.schema.get_field_index("xs"))
            at = xs.offsets.to_numpy()
            flat = xs.values
            seq, p, g = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("seq", "p", "g"))
            p, g = p.astype(float), g.astype(float)
            out: list[list] = [[] for _ in scores]
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                x = Points(seq[a:b], p[a:b], g[a:b])
                for col, (name, f) in zip(out, scores.items()):
                    own = x if name == "epr" else x.both
                    col.append(f(own) if len(own.p) >= 2 else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in kept), *(pa.array(c, pa.float64()) for c in out)], names=[*(f.name for f in kept), *scores])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{n} double" for n in scores)])
    return lists.select(*(f.name for f in kept), "xs").mapInArrow(run, fields)


def overall(rows: DataFrame, *, average: bool = False) -> DataFrame:
    """Metric, value over rows of seq, episode, pred_txt, gt_txt: boundary metrics of the segmentation rows, MCC of all rows
    and the per-episode metrics of the progress rows.

    The texts are read once; one shuffle brings an episode's numbers together (segmentation rows only as counts, summed on the
    map side), and the scores of an episode are computed in one Arrow step."""

    @F.pandas_udf(f"struct<listed:boolean,{SEGMENT_RESULT[7:]}")
    def segment(pred: pd.Series, gt: pd.Series) -> pd.DataFrame:
        none = {"listed": False} | segment_score(None, None)
        found = [{"listed": True} | segment_score(p, g) if g and is_segment_list(g) else none for p, g in zip(pred, gt)]
        return pd.DataFrame(found, columns=["listed", "tp", "fp", "fn", "matched_count", "err_sum", "f1", "mae"])

    gt, progress = F.col("gt_txt"), states_progress(F.col("gt_txt"))
    open_ = ~progress & F.coalesce(gt.contains("["), F.lit(False))
    typed = rows.select("seq", "episode", progress_value(F.col("pred_txt")).alias("p"), progress_value(gt).alias("g"), progress.alias("progress"), segment(F.when(open_, F.col("pred_txt")), F.when(open_, gt)).alias("s"))
    done_p, done_g, known = F.col("p") >= 95.0, F.col("g") >= 95.0, F.col("p").isNotNull() & F.col("g").isNotNull()
    counts = {"mtp": done_p & done_g, "mtn": ~done_p & ~done_g, "mfp": done_p & ~done_g, "mfn": ~done_p & done_g}
    sums = ("tp", "fp", "fn", "matched_count", "err_sum")
    point = F.struct(F.col("seq").cast("long").alias("seq"), "p", "g")
    per = typed.groupBy("episode").agg(
        *(F.sum(F.when(F.col("s.listed"), F.col(f"s.{c}"))).alias(c) for c in sums), *(F.count_if(known & c).alias(n) for n, c in counts.items()),
        F.collect_list(F.when(F.col("progress") & F.col("p").isNotNull(), point)).alias("xs"),
    )
    scores = {"ccc": ccc_of, "epr": lambda x: epr_of(x.p), "voc": voc_of, "kt": kendall_of}
    a = scored_lists(per, scores).agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(c) for c in (*sums, *counts)), *(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in scores))
    denominator = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    bf1 = F.when(denominator > 0, 2 * F.col("tp") / denominator)
    mae = F.when(denominator > 0, F.coalesce(F.try_divide("err_sum", "matched_count"), F.lit(0.0)))
    mcc_ = F.expr("(mtp * mtn - mfp * mfn) / sqrt((mtp + mfp) * (mtp + mfn) * (mtn + mfp) * (mtn + mfn) + 1e-8)")
    named = [("BF1@5", bf1), ("mMAE", mae), ("MCC@95", mcc_), ("CCC", F.col("ccc")), ("EPR@50", F.col("epr")), ("VOC", F.col("voc")), ("KT", F.col("kt"))]
    values = F.filter(F.array(*(F.struct(F.lit(n).alias("metric"), v.alias("value")) for n, v in named)), lambda m: m["value"].isNotNull())
    if average:
        mean = F.aggregate(values, F.lit(0.0), lambda s, m: s + m["value"]) / F.size(values)
        values = F.concat(values, F.array(F.struct(F.lit("average").alias("metric"), mean.alias("value"))))
    return a.select(F.explode(values).alias("m")).select("m.*")


def compared(new: DataFrame, old: DataFrame, keys: list[str], tolerance: float = 1e-3, metrics=("EPR@50", "VOC")) -> DataFrame:
    """Recomputed metrics that differ from the recorded ones."""
    rows = new.where(F.col("metric").isin(*metrics)).join(old.withColumnRenamed("value", "recorded"), [*keys, "metric"])
    return rows.where(F.abs(F.col("value") - F.col("recorded")) > tolerance)
