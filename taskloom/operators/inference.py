"""Injected model calls: batched inference, retries, two turns, registries."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskloom.operators.qa import halved

BACKENDS: dict[str, Callable[[], Callable[[list[str]], list[str]]]] = {}


def backend(name: str):
    """Registers a factory of infer(prompts) -> texts by model type."""

    def add(f):
        BACKENDS[name] = f
        return f

    return add


@backend("echo")
def _echo():
    return lambda prompts: [p or "" for p in prompts]


_engines: dict[str, Callable[[list[str]], list[str]]] = {}


def engine_of(token: str, make) -> Callable[[list[str]], list[str]]:
    """One engine a Python worker: it outlives the tasks, and gives way to that of the next column."""
    if token not in _engines:
        _engines.clear()
        _engines[token] = make()
    return _engines[token]


def infer_column(make: Callable[[], Callable[[list[str]], list[str]]], batch: int = 64):
    """A pandas UDF of prompts.  The engine is made once a Python worker, batches keep their order, a batch that
    is too large is halved, and one that fails otherwise gives empty texts."""
    token = uuid.uuid4().hex

    def texts(part: list[str]) -> list[str]:
        engine = engine_of(token, make)
        try:
            return halved(part, engine)
        except Exception:  # a failing call is an empty answer; retried() asks again
            return [""] * len(part)

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            out: list[str] = []
            values = s.tolist()
            for i in range(0, len(values), batch):
                out += texts(values[i : i + batch])
            yield pd.Series(out, dtype="object")

    return run


def retried(rows: DataFrame, make, parse, *, prompt: str = "prompt", tries: int = 3) -> DataFrame:
    """Adds text and parsed; rows whose text doesn't parse (null) are asked again, up to `tries` times."""
    from taskloom.sources.shared import stored

    left, done = rows, None
    for k in range(tries):
        asked = left.withColumn("text", infer_column(make)(prompt))
        asked = stored(asked.withColumn("parsed", parse(F.col("text"))), "asked")
        part = asked if k == tries - 1 else asked.where("parsed is not null")
        done = part if done is None else done.unionByName(part)
        left = asked.where("parsed is null").drop("text", "parsed")
        if k < tries - 1 and left.isEmpty():
            break
    return done


def two_turns(rows: DataFrame, make, *, first: str, second: str) -> DataFrame:
    """Adds answer1 and answer2; the second prompt's <list> stands for the first answer."""
    rows = rows.withColumn("answer1", infer_column(make)(first))
    return rows.withColumn("answer2", infer_column(make)(F.replace(F.col(second), F.lit("<list>"), F.col("answer1"))))


def batched(rows: DataFrame, run, schema: str, size: int = 64) -> DataFrame:
    """Producer to consumer in micro-batches: run(pdf) -> pdf for up to `size` rows at a time, the rest of a partition last."""

    def go(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for i in range(0, len(pdf), size):
                yield run(pdf.iloc[i : i + size])

    return rows.mapInPandas(go, schema)


def scored_boxes(frames: DataFrame, make: Callable[[], Callable[[list[tuple[str, str, list[float]]]], list[float]]], *, image: str = "image", boxes: str = "bboxes", most_chars: int = 100) -> DataFrame:
    """Boxes with the score that an injected scorer gives to (image, label cut to most_chars, box); one call a batch of frames."""
    held: dict[str, Callable] = {}

    @F.pandas_udf("array<double>")
    def run(images: pd.Series, labels: pd.Series, places: pd.Series) -> pd.Series:
        scorer = held.get("scorer") or held.setdefault("scorer", make())
        items = [(i, (label or "")[:most_chars], list(b)) for i, ls, bs in zip(images, labels, places) for label, b in zip(ls, bs)]
        scores = iter(scorer(items) if items else [])
        return pd.Series([[next(scores) for _ in ls] for ls in labels], dtype="object")

    rows = frames.withColumns({"_labels": F.transform(boxes, lambda b: b["label"]), "_places": F.transform(boxes, lambda b: b["bbox_2d"])})
    rows = rows.withColumn("_scores", run(image, "_labels", "_places"))
    return rows.withColumn(boxes, F.zip_with(boxes, "_scores", lambda b, s: b.withField("score", s))).drop("_labels", "_places", "_scores")
