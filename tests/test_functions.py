"""Functions and operators on hand-built rows, against expectations written out or computed another way."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from taskloom.functions import boxes as g
from taskloom.functions import hashing, parse
from taskloom.functions import text as tx
from taskloom.operators import boxes as bx
from taskloom.operators import inference, joins, metrics, qa
from taskloom.operators import sequence as sq


def column(spark, values, kind, f):
    """f of each value."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_progress_value(spark):
    texts = ["<progress>0.5</progress>", "<progress>50%</progress>", "<progress>1</progress>", "no tag 7", "none", "<PROGRESS>a\n.25b</PROGRESS>", "<progress>x</progress> 3%", "-0.5", "<progress>0.5%</progress>", None, "1.5 and <progress>2", ""]
    assert column(spark, texts, "string", tx.progress_value) == [50.0, 50.0, 100.0, 7.0, None, 25.0, 3.0, -50.0, 0.5, None, 1.5, None]
    assert column(spark, ["<progress> 120 % </progress>", "<progress>-3</progress>", "<progress>a</progress>", "7"], "string", tx.strict_progress) == [100.0, 0.0, None, None]


def test_text_parts(spark):
    assert column(spark, ["One.\n\n Therefore x.\nso what\nsome. It is <progress>5%</progress>. End", None], "string", tx.reasoning_text)[0] == "One.\nsome. End"
    assert column(spark, ["1. Pick UP cup.\n2. Put; down\r\n"], "string", tx.split_actions) == [["pick up cup", "put", "down"]]
    assert column(spark, ["1. a\n\n x\n2.b"], "string", tx.plan_lines) == [["a", "x", "b"]]
    assert column(spark, ["a. b. c. d", "a."], "string", tx.first_sentences) == ["a. b. c.", "a."]
    assert column(spark, ["cot: x", "y"], "string", tx.after_marker) == ["x", "y"]
    assert column(spark, ["a. b ", "a"], "string", tx.finish_reason) == ["b", None]
    assert column(spark, ["[]", '[{"a": 1}]', "[1]", '{"a": 1}', "<progress>1</progress>", "1. x", "[broken"], "string", tx.task_type) == ["segmentation", "segmentation", "planning", "planning", "progress", "planning", "planning"]
    assert column(spark, ["The Cup, the cup"], "string", tx.content_words) == [["cup", "cup"]]
    assert column(spark, [0, 2], "int", tx.timestamp_marks) == [[], ["<0.0 seconds>", "<1.0 seconds>"]]


def test_folded_hash_is_exact(spark):
    import zlib

    def want(s):
        x = zlib.crc32(s.encode())
        x = ((x ^ x >> 16) * hashing.GOLDEN) % 2**64
        return x ^ x >> 32

    texts = ["", "a", "episode_000123", "Ünïcode 漢字", "x" * 1000]
    assert [int(v) for v in column(spark, texts, "string", hashing.folded_hash)] == [want(t) for t in texts]
    assert column(spark, ["a/episode_12.parquet", "episode_7", "x"], "string", hashing.episode_index) == [12, 7, None]


def test_uniform_indices(spark):
    for n, k in itertools.product(range(0, 14), range(0, 12)):
        if n <= 0 or k <= 0:
            want = []
        elif k >= n:
            want = list(range(n))
        elif k == 1:
            want = [0]
        else:
            got = list(dict.fromkeys(int(x) for x in np.round(np.linspace(0, n - 1, k))))
            want = sorted((got + [i for i in range(n) if i not in got])[:k])
        df = spark.range(1).select(sq.uniform_indices(F.lit(n), F.lit(k)).alias("y")) if (n, k) in ((13, 11), (5, 1), (0, 3), (9, 4), (3, 9), (8, 5)) else None
        assert df is None or df.first()["y"] == want


def frames(spark, rows):
    return spark.createDataFrame(rows, "episode string, frame_id long, sub_task string, task string, similarity double")


def test_null_is_a_run_of_its_own(spark):
    f = frames(spark, [("e", i, s, "t", 1.0) for i, s in enumerate([None, None, "a", None, "a", "a", "done"])])
    assert [(r["start"], r["end"], r["sub_task"]) for r in sq.runs(f, ["episode"], "sub_task").orderBy("start").collect()] == [(0, 2, None), (2, 3, "a"), (3, 4, None), (4, 6, "a"), (6, 7, "done")]
    assert [r["planned_actions"] for r in sq.planned_actions(f, ["episode"]).orderBy("frame_id").collect()] == [["a"]] * 6 + [[]]


def test_progress_label_against_loops(spark):
    r = random.Random(1)
    rows, want = [], {}
    for e in range(6):
        n = r.randrange(1, 25)
        subs = []
        while len(subs) < n:
            subs += [r.choice(["a", "b", "done", "", None])] * r.randrange(1, 5)
        subs = subs[:n]
        sims = [round(r.random(), 3) for _ in range(n)]
        rows += [(f"e{e}", i, s, "t", m) for i, (s, m) in enumerate(zip(subs, sims))]
        groups = [list(v) for _, v in itertools.groupby(range(n), key=lambda i: subs[i])]
        real = [bool(subs[v[0]]) and subs[v[0]] != "done" for v in groups]
        k, t = sum(real), sum(len(v) for v, ok in zip(groups, real) if ok)
        dp = []
        for v, ok in zip(groups, real):
            d = [0.0] + [1.5 - sims[i] for i in v[1:]]
            w = min(1.25, max(0.75, k * len(v) / t)) if ok else 0.0
            dp += [w * x / sum(d) if ok and sum(d) else 0.0 for x in d]
        want.update({(f"e{e}", i): sum(dp[:i]) / sum(dp) if i and sum(dp) else 0.0 for i in range(n)})
    got = {(x["episode"], x["frame_id"]): x["progress_frac"] for x in sq.progress_label(frames(spark, rows), ["episode"]).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_labelled_frames_edges(spark):
    kind = "episode string, task_start int, task_end int, task string, subtasks array<struct<name:string,start_frame:int,complete_frame:int>>, overall_notes string"
    rows = [
        ("all", 10, 16, "t", [("b", 12, 14), ("a", 10, 12)], "fine"), ("none", 0, 3, "t", [], ""), ("not", 0, 4, "t", [("a", 0, 2)], "NOT completed"),
        ("half", 0, 5, "t", [("a", 0, 2), ("b", None, None)], None), ("past", 0, 4, "t", [("a", 0, 99)], ""),
    ]
    got = {}
    for r in sq.labelled_frames(spark.createDataFrame(rows, kind), ["episode"]).orderBy("frame_id").collect():
        got.setdefault(r["episode"], []).append(r["sub_task"])
    assert got == {"all": ["a", "a", "b", "b", "done", "done"], "none": ["not done"] * 3, "not": ["a"] * 4, "half": ["a"] * 5, "past": ["a", "a", "a", "done"]}


def test_references_chains_and_circles(spark):
    rows = [("e", 0, None, "x")] + [("e", i, i - 1, None) for i in range(1, 70)] + [("e", 100, 101, None), ("e", 101, 100, None), ("e", 102, 100, None), ("e", 103, 999, None), ("e", 5, None, "own"), ("f", 7, 0, None)]
    got = {(r["k"], r["frame_id"]): r["v"] for r in joins.resolve_refs(spark.createDataFrame(rows, "k string, frame_id long, ref long, v string"), ["k"], payload=["v"]).collect()}
    want = {("e", i): "x" if i < 5 else "own" for i in range(70)} | {("e", i): None for i in (100, 101, 102, 103)} | {("f", 7): None}
    assert got == want


def test_duplicate_task_start_raises(spark):
    seg = spark.createDataFrame([("e", 5, 9, 0)], "episode string, start long, end long, first_index long")
    raw = spark.createDataFrame([("e", 5, "a"), ("e", 5, "b")], "episode string, task_start long, results string")
    with pytest.raises(Exception, match="duplicate task_start"):
        joins.border_sub_tasks(seg, raw).collect()


def brute_boundaries(a, b, limit):
    """Least cost of a matching of all of the shorter list, over all of them."""
    if len(a) > len(b):
        a, b = b, a
    return min(sum(abs(x - y) for x, y in zip(a, p)) for p in itertools.permutations(b, len(a)))


def test_boundary_matching_is_cheapest():
    r = random.Random(2)
    for _ in range(200):
        a, b = sorted(r.sample(range(30), r.randrange(1, 6))), sorted(r.sample(range(30), r.randrange(1, 6)))
        assert sum(metrics.matched_errors([*map(float, a)], [*map(float, b)])) == brute_boundaries(a, b, 0)


def test_best_matching_is_heaviest():
    r = random.Random(3)
    for _ in range(100):
        n, m = r.randrange(1, 6), r.randrange(1, 6)
        w = [[r.random() for _ in range(m)] for _ in range(n)]
        pairs = metrics.best_matching(w)
        assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == min(n, m)
        best = max(sum(w[i][j] for i, j in (zip(range(n), p) if n <= m else zip(p, range(m)))) for p in itertools.permutations(range(max(n, m)), min(n, m)))
        assert abs(sum(w[i][j] for i, j in pairs) - best) < 1e-9
    assert metrics.soft_f1([]) == 0.0 and metrics.soft_f1([[1.0]]) == 1.0


def test_segment_scores():
    gt = '[{"a": "x", "start_frame": 0, "end_frame": 100}]'
    assert metrics.segment_score(gt, gt)["f1"] == 1.0
    near = metrics.segment_score('[{"s": 3, "e": 120}]', gt)
    assert (near["tp"], near["fp"], near["fn"], near["err_sum"]) == (1, 1, 1, 3.0)
    assert metrics.segment_score("[]", "[]")["f1"] == 1.0
    assert metrics.segment_score("nothing", gt) == {"tp": 0, "fp": 0, "fn": 0, "matched_count": 0, "err_sum": 0.0, "f1": 0.0, "mae": 0.0}
    assert metrics.segment_score("[]", gt)["fn"] == 2
    assert metrics.segment_score("```json\n[{'s': 0, 'e': 100,}]\n```", gt)["tp"] == 2


def predictions(spark, rows):
    return spark.createDataFrame([(i, e, p, t) for i, (e, p, t) in enumerate(rows)], "seq long, episode string, pred_txt string, gt_txt string")


def test_metrics_of_constant_and_single_rows(spark):
    tag = lambda x: f"<progress>{x}%</progress>"
    rows = predictions(spark, [("a", tag(50), tag(10)), ("a", tag(50), tag(20)), ("b", tag(1), tag(2)), (None, tag(0), tag(0)), (None, tag(100), tag(100)), ("c", "none", tag(5))])
    got = {r["metric"]: r["value"] for r in metrics.overall(rows, average=True).collect()}
    assert got["VOC"] == 0.5 and got["KT"] == 0.5 and abs(got["CCC"] - 0.5) < 1e-6
    assert set(got) == {"MCC@95", "CCC", "EPR@50", "VOC", "KT", "average"}
    seg = predictions(spark, [("a", "[]", '[{"s": 1, "e": 2}]')])
    assert {r["metric"] for r in metrics.overall(seg).collect()} == {"BF1@5", "mMAE", "MCC@95", "CCC", "EPR@50", "VOC", "KT"}


def test_epr_against_loops(spark):
    r = random.Random(4)
    rows = [(f"e{e}", f"<progress>{r.randrange(0, 1000) / 10}%</progress>", "") for e in range(8) for _ in range(r.randrange(2, 40))]
    want = {}
    for e in {x[0] for x in rows}:
        ps = np.array([float(x[1][10:-12]) for x in rows if x[0] == e])
        k = next(k for k in range(1000, 0, -1) if (1.0 / k) * len(np.unique(np.floor(np.clip(ps, 0, 100) / 100 / (1.0 / k)))) >= 0.5)
        want[e] = math.log2(k)
    got = {r["episode"]: r["score"] for r in metrics.episode_epr(predictions(spark, rows)).collect()}
    assert got.keys() == want.keys() and all(abs(got[e] - want[e]) < 1e-9 for e in want)


def test_gamma_fit_and_tail():
    rng = np.random.default_rng(0)
    for a, s in ((0.7, 2.0), (3.0, 0.1), (40.0, 1.0)):
        fa, fs = bx.fit_gamma(rng.gamma(a, s, 20_000))
        assert abs(fa / a - 1) < 0.06 and abs(fs / s - 1) < 0.06
    for a, x in ((0.5, 0.3), (2.0, 5.0), (9.0, 3.0), (1.0, 2.5)):
        t = np.linspace(x, x + 80, 800_001)
        y = t ** (a - 1) * np.exp(-t)
        assert abs(bx.gamma_tail(a, x) - float(((y[1:] + y[:-1]) / 2).sum() * (t[1] - t[0])) / math.gamma(a)) < 1e-6
    assert bx.gamma_outliers([0.0, 0.0]) == [False, False] and bx.gamma_outliers([0.01] * 20 + [0.9])[-1]
    assert bx.lognormal_outliers([0.01, 0.011, 0.012] * 8 + [0.9])[-1]


def test_ransac_and_mask():
    assert bx.ransac_line([1, 2, 3, 4, 5], [1, 2, 3, 40, 5]) == [True, True, True, False, True]
    assert bx.ransac_line([1, 2], [5, 900]) == [True, True]
    mask = np.zeros((20, 40), bool)
    mask[2:6, 10:20], mask[15, 35] = True, True
    assert bx.mask_box(mask) == [0.25, 0.1, 0.5, 0.3]
    assert bx.mask_box(np.zeros((5, 5))) is None


def test_interpolation_fills_gaps(spark):
    box = lambda x, label="cup": {"label": label, "bbox_2d": [x, 0.1, x + 0.2, 0.3], "score": 1.0, "interpolated": False}
    rows = [("e", 0, [box(0.1)]), ("e", 1, []), ("e", 2, [box(0.9, "cup")]), ("e", 3, []), ("e", 4, [box(0.12)]), ("e", 5, [box(0.12), box(0.6, "hat")])]
    df = spark.createDataFrame(rows, f"episode string, frame_id long, bboxes array<{g.BOX}>")
    got = {(r["frame_id"], r["label"], round(r["bbox_2d"][0], 3)) for r in bx.interpolated(df, ["episode"]).collect()}
    assert got == {(1, "cup", 0.105), (3, "cup", 0.115)}  # frame 2 has a cup already
    assert bx.interpolated(df, ["episode"], similar=lambda *a: False).count() == 0


def test_temporal_clean_keeps_all_boxes(spark):
    box = lambda x: {"label": "a", "bbox_2d": [x, 0.1, x + 0.1, 0.2], "score": None, "interpolated": False}
    rows = [("e", i, [box(0.1 + i / 1000)]) for i in range(30)] + [("e", 30, [box(0.1), box(0.9)]), ("lone", 0, [box(0.2)])]
    out = bx.temporal_clean(spark.createDataFrame(rows, f"episode string, frame_id long, bboxes array<{g.BOX}>"), ["episode"])
    got = out.collect()
    assert len(got) == len(rows) and sum(len(r["bboxes"]) + len(r["outlier_bboxes"]) for r in got) == 33
    assert [(r["episode"], r["frame_id"], r["outlier_bboxes"][0]["bbox_2d"][0]) for r in got if r["outlier_bboxes"]] == [("e", 30, 0.9)]
    assert all(b["score"] == 1.0 for r in got for b in r["bboxes"])


def test_answer_parsers():
    assert parse.labelled_boxes('x ```json\n[{"bbox_2d": [1,2,3,4], "label": "a"}, 5, {"k": [1,2]}]\n``` y') == [{"label": "a", "bbox_2d": [1.0, 2.0, 3.0, 4.0]}]
    assert parse.labelled_boxes('[{"n": "b", "q": [0.1, 2, 3, 4]}] // see http://x') == [{"label": "b", "bbox_2d": [0.1, 2.0, 3.0, 4.0]}]
    assert parse.labelled_boxes("[]") is None and parse.labelled_boxes(None) is None
    assert parse.loose_boxes("a [1,2,3,4] b {{5,6,7,8}, {9,10,11,12}} c (1,2,3) d <1, 2, 3, 4.5>") == [[1, 2, 3, 4], [5, 6, 7, 8], [9, 10, 11, 12], [1, 2, 3, 4.5]]
    assert parse.loose_boxes(None) == []
    assert parse.index_list("[[0, 2]]", 3) == [0, 2] and parse.index_list("[0, 5, 'a', 1]", 3) == [0, 1] and parse.index_list("{}", 3) == [] and parse.index_list("no", 3) == []


def test_packing_invariants(spark):
    r = random.Random(5)
    sizes = [r.randrange(1, 400) for _ in range(500)] + [1500, 1000]
    bins = qa.best_fit(sizes, 1000)
    load = {}
    for b, s in zip(bins, sizes):
        load.setdefault(b, []).append(s)
    assert all(sum(v) <= 1000 or len(v) == 1 for v in load.values()) and sum(map(len, load.values())) == len(sizes)
    assert len(load) <= math.ceil(sum(sizes) / 1000) * 1.2
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "id long, num_tokens long")
    rows = qa.packed(df, volume=1000, order="id", batch=100).collect()
    assert sorted(x["id"] for x in rows) == list(range(len(sizes)))
    assert all(x["batch"] == x["id"] // 100 for x in rows)


def test_worker_shares_and_chunks():
    shares = qa.worker_shares({"big": 1000, "a": 100, "b": 90, "c": 80, "d": 30}, 4)
    assert {s[0] for s in shares} == {0, 1, 2, 3} and [s[1:] for s in shares if s[1] == "big"] == [("big", 3, 0), ("big", 3, 1), ("big", 3, 2)]
    with pytest.raises(ValueError):
        qa.worker_shares({"a": 1000, "b": 1, "c": 1}, 4)
    assert qa.worker_shares({"a": 1, "b": 1}, 3) == [(0, "a", 2, 0), (1, "a", 2, 1), (2, "b", 1, 0)]
    costs = [5.0, 1.0, 1.0, 9.0, 2.0, 30.0]
    chunks = qa.cost_chunks(costs, 10.0)
    assert sorted(i for c in chunks for i in c) == list(range(6))
    assert all(len(c) == 1 or max(costs[i] for i in c) * len(c) <= 10 for c in chunks)


def test_splits_keep_episodes_together(spark):
    df = spark.range(3000).selectExpr("id", "concat('ds', id % 3) as dataset", "concat('episode_', id div 10) as episode", "'c' as cluster")
    out = qa.split_episodes(df, train=0.75, test=0.25, valid=0.0, valid_datasets=["ds2"])
    assert out.groupBy("dataset", "episode").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    n = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert n["valid"] == 1000 and 0.15 < n["test"] / 2000 < 0.35
    with pytest.raises(ValueError):
        qa.split_episodes(df, train=0.5, test=0.1, valid=0.1)


def test_handlers_and_retries(spark):
    with pytest.raises(ValueError):
        qa.run_handler("zz")
    calls = []

    def run(batch):
        calls.append(len(batch))
        if len(batch) > 2:
            raise MemoryError
        return [x * 2 for x in batch]

    assert qa.halved([1, 2, 3, 4, 5], run) == [2, 4, 6, 8, 10] and calls[0] == 5

    def make():
        return lambda prompts: ["ok" if p != "bad" else "no" for p in prompts]

    df = spark.createDataFrame([(1, "x"), (2, "bad")], "id long, prompt string")
    got = {r["id"]: r["parsed"] for r in inference.retried(df, make, lambda t: F.when(t == "ok", t)).collect()}
    assert got == {1: "ok", 2: None}


def test_keyframes_compare_with_the_last_kept(spark):
    codes = [0, 1, 3, 7, 15, 0]
    df = spark.createDataFrame([("e", i, "t" if i < 5 else "u", c) for i, c in enumerate(codes)], "episode string, frame_id long, task_description string, phash long")
    got = [r["ref"] for r in sq.keyframes(df, ["episode"], similarity=1 - 2.5 / 64).orderBy("frame_id").collect()]
    assert got == [None, 0, 0, None, 3, None]
