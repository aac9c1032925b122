"""Operators held against loops that follow the definition frame by frame."""

import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from taskloom.functions import hashing
from taskloom.functions import text as tx
from taskloom.functions.loose_json import loose_json
from taskloom.operators import boxes as bx
from taskloom.operators import inference, joins, metrics, qa
from taskloom.operators import sequence as sq
from taskloom.sources import sinks, tables


@pytest.mark.parametrize(
    "text, want",
    [
        ('[{"s": 1, "e": 5}, {"s": 6, "e": 9}', [{"s": 1, "e": 5}, {"s": 6, "e": 9}]), ("[{'d': \"pick the man's cup\", 's': 1}]", [{"d": "pick the man's cup", "s": 1}]),
        ("[{'d': 'the man's cup', 's': 1}, {'d': 'it", [{"d": "the man's cup", "s": 1}, {"d": "it"}]), ('```json\n[{"a": 1}]\n```', [{"a": 1}]), ('[{"a": 1},]', [{"a": 1}]),
        ('So: [{"a": 1} {"b": 2.5}] done', [{"a": 1}, {"b": 2.5}]), ('{"a": [1, 2', {"a": [1, 2]}), ("1. open it", None), ("x [] y", []), ("[[1,2],[3]", [[1, 2], [3]]),
        ("[{s: 1, k: True, n: None}]", [{"s": 1, "k": True, "n": None}]), ('[{"a": "say "hi" now", "b": 2}]', [{"a": 'say "hi" now', "b": 2}]), ("", None), (None, None), ("[" * 5000, None), ("[1, 2}", [1, 2]),
    ],
)
def test_loose_json(text, want):
    assert loose_json(text) == want


def test_loose_json_reads_what_json_reads():
    r = random.Random(1)
    make = lambda d: r.choice([lambda: r.randrange(-9, 9), lambda: r.random(), lambda: r.choice(["a", "it's", 'q"x', "b, c", "é\n"]), lambda: None, lambda: [make(d - 1) for _ in range(r.randrange(3))] if d else 1, lambda: {k: make(d - 1) for k in "ab"} if d else True])()
    for _ in range(300):
        x = [make(3)]
        assert loose_json("Here it is:\n" + json.dumps(x) + "\nend") == x


def _episodes(spark, seed, names):
    r = random.Random(seed)
    rows = []
    for e in range(12):
        task, sub = "t0", names[0]
        for f in range(r.randrange(1, 40)):
            task = r.choice(["t0", "t1"]) if r.random() < 0.1 else task
            sub = r.choice(names) if r.random() < 0.4 else sub
            rows.append((e, f, task, sub))
    return rows, spark.createDataFrame(rows, "episode int, frame_id long, task string, sub_task string")


def _segments(rows, col):
    return [list(g) for _, g in itertools.groupby(rows, key=lambda r: (r[0], r[col]))]


def test_remaining_sub_tasks(spark):
    rows, df = _episodes(spark, 2, ["done", "a", "b", "", "not done", "Done", None, "c"])
    want = []
    for seg in _segments(rows, 2):
        rest = [k for k, _ in itertools.groupby(x[3] for x in seg if x[3] and x[3] not in ("done", "not done"))]
        for e, f, _, sub in seg:
            if sub in rest:
                while sub != rest[0]:
                    rest.pop(0)
            want.append((e, f, list(rest)))
    got = sq.remaining_sub_tasks(df, ["episode"]).orderBy("episode", "frame_id").collect()
    assert [(r["episode"], r["frame_id"], r["remaining"]) for r in got] == want


def test_progress_estimate(spark):
    rows, df = _episodes(spark, 3, ["a", "b", "done", "", "a", None])
    want = []
    for seg in _segments(rows, 2):
        runs = [list(g) for _, g in itertools.groupby(seg, key=lambda r: r[3])]
        valid = max(1, sum(1 for x in runs if x[0][3] and x[0][3] != "done"))
        at = {x[0][3]: (i / valid, x[0][1], x[-1][1] + 1) for i, x in enumerate(runs)}
        for e, f, _, sub in seg:
            first, a, b = at[sub]
            want.append((e, f, min(int((first + (f - a) / max(1, b - a) / valid) * 100), 100)))
    got = sq.progress_estimate(df, ["episode"]).orderBy("episode", "frame_id").collect()
    assert [(r["episode"], r["frame_id"], r["progress_pct"]) for r in got] == want


def test_answer_mask(spark):
    r, cases = random.Random(4), []
    for _ in range(200):
        cases.append([r.choice([7, 8, 9, 5, 5]) for _ in range(r.randrange(14))])
    got = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, ids array<int>").select("i", qa.answer_mask(F.col("ids"), 7, 8, -1).alias("m")).orderBy("i").collect()
    for ids, row in zip(cases, got):
        labels, pos = [-1] * len(ids), 0
        while pos < len(ids):
            if ids[pos] == 7 and 8 in ids[pos + 2 :]:
                a = pos + 2
                b = ids.index(8, a)
                labels[a : b + 2] = ids[a : b + 2]
                pos = b
            pos += 1
        assert row["m"] == labels


def test_scores_against_all_pairs():
    r = random.Random(5)
    for n in (2, 3, 50, 400):
        p, g = (np.array([float(r.randrange(0, 100, step)) for _ in range(n)]) for step in (3, 7))
        x = metrics.Points(np.arange(n), p, g)
        pairs = sum(np.sign(p[i] - p[j]) * np.sign(g[i] - g[j]) for i in range(n) for j in range(n))
        assert metrics.kendall_of(x) == pytest.approx(pairs / (n * (n - 1)))
        best = max(k for k in range(1, 1001) if len(np.unique(np.floor(p / 100.0 / (1.0 / k)))) / k >= 0.5)
        assert metrics.epr_of(p) == pytest.approx(np.log2(best))
        order = np.lexsort((x.seq, g))
        ranks = np.array([(p < v).sum() + ((p == v).sum() + 1) / 2 for v in p[order]])
        assert metrics.voc_of(x) == pytest.approx(np.corrcoef(np.arange(n), ranks)[0, 1] if ranks.std() else 0.0)


def test_overall_reads_every_kind_of_row(spark):
    rows = [(1, "e", "<progress>10%</progress>", "<progress>20%</progress>"), (2, "e", "<progress>96%</progress>", "<progress>97%</progress>"), (3, None, "[{'a': 0, 'b': 100}, {'a': 101", "[{\"a\": 0, \"b\": 100}]"), (4, None, "walk", "walk"), (5, "f", None, "<progress>5%</progress>")]
    got = {r["metric"]: r["value"] for r in metrics.overall(spark.createDataFrame(rows, "seq int, episode string, pred_txt string, gt_txt string"), average=True).collect()}
    assert got["BF1@5"] == 1.0 and got["mMAE"] == 0.0 and got["KT"] == 1.0 and got["VOC"] == pytest.approx(1.0) and got["MCC@95"] == pytest.approx(1.0)
    assert got["average"] == pytest.approx(sum(v for k, v in got.items() if k != "average") / 7)
    none = metrics.overall(spark.createDataFrame([], "seq int, episode string, pred_txt string, gt_txt string")).collect()
    assert {r["metric"] for r in none} == {"MCC@95", "CCC", "EPR@50", "VOC", "KT"}


def test_velocities(spark):
    r = random.Random(6)
    held = {(e, f): [[x, y, x + r.random(), y + r.random()] for x, y in [(r.random(), r.random()) for _ in range(r.randrange(4))]] for e in range(4) for f in range(7)}
    held[9, 0] = [[0.0, 0.0, 1.0, 1.0]]
    df = spark.createDataFrame([(e, f, [("a", b, 0.5, False) for b in bs]) for (e, f), bs in held.items()], "episode int, frame_id long, bboxes array<struct<label:string,bbox_2d:array<double>,score:double,interpolated:boolean>>")
    want = {}
    for (e, f), bs in held.items():
        others = [o for (e2, f2), o in held.items() if e2 == e and f2 != f and o]
        for i, b in enumerate(bs if others else []):
            want[e, f, i] = np.mean([min(bx._np_distance(b, o, 0.75, 0.25) for o in os) for os in others])
    got = {(r["episode"], r["frame_id"], r["box_no"]): r["velocity"] for r in bx.velocities(df, ["episode"]).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_sample_each_is_the_first_by_hash(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 < 2, F.lit("hot")).when(F.col("id") < 900, F.lit(None).cast("string")).otherwise(F.concat(F.lit("g"), (F.col("id") % 50).cast("string"))).alias("g"), "id")
    got = {(r["g"], r["id"]) for r in qa.sample_each(rows, ["g"], ["id"], 0.1, at_least=2, seed=3).collect()}
    want, groups = set(), {}
    for r in rows.select("g", "id", hashing.uniform(F.col("id"), seed=3).alias("u")).collect():
        groups.setdefault(r["g"], []).append((r["u"], r["id"]))
    for g, xs in groups.items():
        want |= {(g, i) for _, i in sorted(xs)[: max(2, int(len(xs) * 0.1))]}
    assert got == want


def test_an_unknown_task_raises(spark):
    f = spark.createDataFrame([(1,), (2,)], "task_index long")
    known = spark.createDataFrame([(1, None), (3, "c")], "task_index long, task string")
    assert [r["task"] for r in joins.with_tasks(f.where("task_index = 1"), known).collect()] == [None]
    with pytest.raises(Exception, match="no task of index 2"):
        joins.with_tasks(f, known).collect()


def test_thinking(spark):
    texts = ["<think>a\nb</think> ok ", "why</think>\n yes </think> z", " plain\n", "<think>a</think>", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tx.after_thinking(F.col("t")).alias("a"), tx.without_thinking(F.col("t")).alias("b")).orderBy("i").collect()
    assert [r["a"] for r in got] == ["ok", "yes", "plain", "", None]
    assert [r["b"] for r in got] == ["ok", "why</think>\n yes </think> z", "plain", "", None]


def test_packs_are_json_arrays(spark, tmp_path):
    rows = spark.range(20).select((F.col("id") % 6).alias("pack_id"), F.col("id").alias("x"))
    sinks.write_packed(rows, str(tmp_path / "packs"))
    found = [json.loads(f.read_text()) for f in (tmp_path / "packs").glob("part-*") if f.stat().st_size]
    assert sorted(r["x"] for packs in found for pack in packs for r in pack) == list(range(20)) and sum(map(len, found)) == 6
    assert sorted(r["x"] for r in tables.packed_rows(spark, str(tmp_path / "packs"), "x:bigint").collect()) == list(range(20))


def test_replaced_parquet(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (3, 5):
        sinks.replace_parquet(spark.range(n), path)
        assert spark.read.parquet(path).count() == n
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_engines_live_as_long_as_their_worker(spark):
    def make():
        import uuid

        own = uuid.uuid4().hex
        return lambda prompts: [own] * len(prompts)

    rows = spark.range(400).repartition(40).select(F.lit("p").alias("prompt"))
    made = rows.select(inference.infer_column(make)("prompt").alias("t")).distinct().count()
    assert made <= 8  # workers, not tasks


def test_repeated_and_late_frames_leave_no_state(spark, tmp_path):
    from taskloom.streaming.progress import progress_stream, run_available

    rows = [(1, f, float(f)) for f in (0, 1, 1, 3, 2, 0, 2, 4)]
    for k, part in enumerate([rows[:3], rows[3:5], rows[5:]]):
        spark.createDataFrame(part, "episode long, frame_id long, parsed_progress double").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema("episode long, frame_id long, parsed_progress double").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run_available(progress_stream(stream), str(tmp_path / "out"), str(tmp_path / "check"))
    assert [r["frame_id"] for r in spark.read.parquet(str(tmp_path / "out")).orderBy("frame_id").collect()] == [0, 1, 2, 3, 4]


def test_chat_messages(spark):
    kind = "conversations array<struct<from:string,value:string>>, image array<string>, video array<string>"
    talk = [("human", "<image>a <video>\n b"), ("gpt", "see <image> "), ("human", " <image> <image>")]
    row = spark.createDataFrame([(talk, ["i1", "i2", "i3"], ["v"])], kind).select(qa.chat_messages(F.col("conversations"), F.col("image"), F.col("video")).alias("m")).first()["m"]
    assert [(t["role"], [tuple(c) for c in t["content"]]) for t in row] == [
        ("user", [("image", "i1"), ("text", "a"), ("video", "v"), ("text", "b")]), ("assistant", [("text", "see <image> ")]), ("user", [("image", "i2"), ("image", "i3")]),
    ]
    none = spark.createDataFrame([([("human", "hello")], None, None)], kind).select(qa.chat_messages(F.col("conversations"), F.col("image"), F.col("video")).alias("m")).first()["m"]
    assert [tuple(c) for c in none[0]["content"]] == [("text", "hello")]
    for images, videos in ((["i"], ["v"]), (["a", "b", "c", "d"], ["v"]), (["a", "b", "c"], [])):
        with pytest.raises(Exception, match="marks and the media"):
            spark.createDataFrame([(talk, images, videos)], kind).select(qa.chat_messages(F.col("conversations"), F.col("image"), F.col("video"))).collect()
