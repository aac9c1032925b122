"""Sources and sinks on files in the layouts that the engine reads."""

import json

import pytest
from pyspark.sql import functions as F

from taskloom.operators import sequence as sq
from taskloom.sources import sinks, tables


@pytest.fixture()
def dataset(spark, tmp_path):
    root = tmp_path / "ds"
    (root / "meta").mkdir(parents=True)
    (root / "meta/info.json").write_text(json.dumps({"fps": 10, "chunks_size": 1000, "features": {"cam": {"dtype": "video", "shape": [3, 4]}}}, indent=1))
    (root / "meta/tasks.jsonl").write_text('{"task_index": 0, "task": "old"}\n{"task_index": 1, "task": "b\\u0007c"}\n{"task_index": 0, "task": "new"}\n')
    (root / "meta/episodes.jsonl").write_text('{"episode_index": 0, "length": 1}\n{"episode_index": 0, "length": 2}\n')
    import pandas as pd

    for c, e in ((0, 0), (0, 1), (1, 1000)):
        d = root / f"data/chunk-{c:03d}"
        d.mkdir(parents=True, exist_ok=True)
        pd.DataFrame({"frame_index": [0, 1, 2], "episode_index": [e] * 3, "task_index": [0, 0, 1], "cam.bytes": [b"a", b"b", b"c"], "extra": [1, 2, 3]}).to_parquet(d / f"episode_{e:06d}.parquet")
    return str(root)


def test_metadata(spark, dataset):
    assert tables.info(spark, dataset).first()["fps"] == 10
    assert {r["task_index"]: r["task"] for r in tables.tasks(spark, dataset).collect()} == {0: "new", 1: "bc"}
    assert [r["length"] for r in tables.episodes(spark, dataset).collect()] == [2]


def test_frames_project_and_rename(spark, dataset):
    f = tables.frames(spark, dataset, ["frame_index", "task_index", "cam"])
    assert f.columns == ["frame_index", "task_index", "cam", "episode_name", "chunk_name"]
    assert "extra:" not in f._jdf.queryExecution().executedPlan().toString()
    assert {(r["episode_name"], r["chunk_name"]) for r in f.collect()} == {("episode_000000", "chunk-000"), ("episode_000001", "chunk-000"), ("episode_001000", "chunk-001")}
    with pytest.raises(Exception):
        tables.frames(spark, dataset + "/meta")
    index = tables.episode_index_scan(tables.frames(spark, dataset, ["episode_index"])).orderBy("first_index").collect()
    assert [(r["episode_index"], r["first_index"], r["end_index"]) for r in index] == [(0, 0, 3), (1, 3, 6), (1000, 6, 9)]
    assert tables.native_sub_tasks(tables.frames(spark, dataset, ["frame_index", "task_index"]), tables.tasks(spark, dataset)).count() == 9


def test_annotations(spark, tmp_path):
    (tmp_path / "episode_000003.bbox.jsonl").write_text('{"frame_id": 0, "camera_key": "c", "bboxes": [{"label": "a", "bbox_2d": [0,0,1,1], "score": 0.5}, {"label": "b", "bbox_2d": [0,0,1,1], "score": "interpolated"}]}\n{"frame_id": 1, "ref": 0}\n')
    rows = tables.annotations(spark, str(tmp_path), "bbox").orderBy("frame_id").collect()
    assert [(b["score"], b["interpolated"]) for b in rows[0]["bboxes"]] == [(0.5, False), (None, True)]
    assert rows[1]["ref"] == 0 and rows[0]["episode_name"] == "episode_000003"
    assert tables.first_version(spark, [str(tmp_path / "no"), str(tmp_path)]) == str(tmp_path)
    assert tables.first_version(spark, [str(tmp_path / "no")]) is None


def test_qa_layouts(spark, tmp_path):
    (tmp_path / "c1/ds").mkdir(parents=True)
    (tmp_path / "c1/ds/episode_1.jsonl").write_text('{"image": ["a/episode_5/1.jpg", "b"], "conversations": [{"from": "human", "value": "q"}]}\n')
    (tmp_path / "c2").mkdir()
    (tmp_path / "c2/other.jsonl").write_text('{"image": "one", "video": "v/episode_9.mp4", "num_tokens": 3}\n')
    rows = sorted(tables.qa_rows(spark, str(tmp_path)).collect(), key=lambda r: r["cluster"])
    assert [(r["cluster"], r["dataset"], r["image"]) for r in rows] == [("c1", "ds", ["a/episode_5/1.jpg", "b"]), ("c2", "other", ["one"])]
    assert tables.qa_rows(spark, str(tmp_path), ["c2"]).count() == 1
    tokens = tables.qa_rows(spark, str(tmp_path)).orderBy("cluster").select(tables.episode_token(F.col("image"), F.col("video")).alias("t"))
    assert [r["t"] for r in tokens.collect()] == ["episode_5", "episode_9"]


def test_eval_log(spark, tmp_path):
    (tmp_path / "x.log").write_text("CCC: 0.5\n----------\nResources: a\nQuestion: q1\nmore\nGround Truth: 5: 1\nPrediction: p\n----------\nQuestion: q2\nPrediction:\nKT: 0.1\n----------\nVOC: -1e-3\n")
    samples, found = tables.eval_log(spark, str(tmp_path / "x.log"))
    rows = samples.orderBy("seq").collect()
    assert [(r["question"], r["gt_txt"], r["pred_txt"]) for r in rows] == [("q1\nmore", "5: 1", "p"), ("q2", None, "\nKT: 0.1")]
    assert {r["metric"]: r["value"] for r in found.collect()} == {"CCC": 0.5, "VOC": -0.001}


def test_registry(spark):
    reg = spark.createDataFrame([("a", "x", "y"), ("b", "x", "y")], "name string, annotation_path string, data_path string")
    assert {(r["name"], r["rate"]) for r in tables.registry_rows(reg, ["a%30", "b"]).collect()} == {("a", 0.3), ("b", 1.0)}
    assert tables.registry_rows(reg, ["*", "a%1"]).count() == 2
    with pytest.raises(ValueError):
        tables.registry_rows(reg, ["zz"])


def test_sinks(spark, tmp_path):
    df = spark.range(5).withColumnRenamed("id", "x")
    path = str(tmp_path / "out")
    sinks.write_jsonl(df, path)
    sinks.write_jsonl(df, path, append=True)
    assert spark.read.schema("x long").json(path).count() == 10
    with pytest.raises(Exception):
        sinks.validated(spark.createDataFrame([("{broken",)], "value string"), "x long").collect()
    sinks.replace_parquet(df, str(tmp_path / "p"))
    sinks.replace_parquet(df.where("x > 2"), str(tmp_path / "p"), backup=str(tmp_path / "bak"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2 and spark.read.json(str(tmp_path / "bak")).count() == 5
    (tmp_path / "f1.cot.jsonl").write_text("x")
    assert len(sinks.move_matching(spark, f"{tmp_path}/*.cot.jsonl", str(tmp_path / "archive"))) == 1 and not (tmp_path / "f1.cot.jsonl").exists()
    assert len(sinks.remove_matching(spark, f"{tmp_path}/archive/*.jsonl")) == 1


def test_filters_reach_the_scan(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "value", "props").where("user_id = 3").select("value")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,3)]" in plan and "ReadSchema: struct<user_id:bigint,value:double>" in plan


def test_small_sides_are_broadcast_behind_a_check(spark):
    small, large = spark.range(10), spark.range(10**9)
    assert tables.estimated_bytes(small) < tables.MOST_BROADCAST < tables.estimated_bytes(large)
    assert tables.bounded(large) is large
    assert sq.slice_frames(spark.range(20).withColumnRenamed("id", "global_index"), 3, 15, 4).count() == 3
