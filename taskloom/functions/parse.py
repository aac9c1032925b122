"""Parsing of model answers that hold JSON or boxes.  Free-form answers need a real parser, so these run as Arrow-batched
pandas UDFs; what JSON functions of Spark can do stays with them (F15)."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from taskloom.functions.loose_json import loose_json

BOX_LIST = "array<struct<label:string,bbox_2d:array<double>>>"
_FENCE = re.compile(r"```(?:json)?\s*(.*?)\s*```", re.DOTALL)
_COMMENT = re.compile(r"(?<!http:)(?<!https:)//.*")
_NUMBERS = re.compile(r"[-+]?\d*\.?\d+")
#: Opening and closing marks of boxes in free text.
BRACKETS = ("[]", "{}", "<>", "()")


def _is_box(v) -> bool:
    return isinstance(v, list) and len(v) == 4 and all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in v)


def _candidates(text: str) -> Iterable[str]:
    """Where an answer's JSON may be, most trusted first."""
    text = text.strip()
    yield text
    if fence := _FENCE.search(text):
        yield _COMMENT.sub("", fence[1])
    for left, right in ("[]", "{}"):
        a, b = text.find(left), text.rfind(right)
        if 0 <= a < b:
            yield _COMMENT.sub("", text[a : b + 1])


def labelled_boxes(text: str | None) -> list[dict] | None:
    """label and bbox_2d of each object of an answer's JSON list; under other keys the last four-number list and the last
    string count.  None if there is no such list."""
    for part in _candidates(text or ""):
        try:
            items = json.loads(part)
        except ValueError:
            continue
        out = []
        for item in items if isinstance(items, list) else []:
            if not isinstance(item, dict):
                continue
            box, label = item.get("bbox_2d"), item.get("label")
            if not (_is_box(box) and isinstance(label, str)):
                box = next((v for v in reversed(item.values()) if _is_box(v)), None)
                label = next((v for v in reversed(item.values()) if isinstance(v, str)), None)
            if box is not None and label is not None:
                out.append({"label": label, "bbox_2d": [float(x) for x in box]})
        if out:
            return out
    return None


def loose_boxes(text: str | None) -> list[list[float]]:
    """four-number groups in brackets of any kind, in order; groups within an earlier found span (nested ones are
    looked for first) don't count again.  Numbers are read as such; nothing is evaluated."""
    text, taken, found = text or "", [], []
    for nested in (True, False):
        for left, right in BRACKETS:
            a, b = re.escape(left), re.escape(right)
            inner = rf"[\d.,\s{a}{b}]+" if nested else r"[\d.,\s]+"
            pattern = rf"{a}\s*{a}{inner}{b}\s*{b}" if nested else rf"{a}\s*{inner}\s*{b}"
            for m in re.finditer(pattern, text):
                if any(s <= m.start() and m.end() <= e for s, e in taken):
                    continue
                groups = re.findall(rf"{a}([\d.,\s]+){b}", m[0])
                boxes = [[float(x) for x in _NUMBERS.findall(g)] for g in groups]
                if boxes and all(len(x) == 4 for x in boxes):
                    taken.append(m.span())
                    found.append((m.start(), boxes))
    return [b for _, boxes in sorted(found, key=lambda f: f[0]) for b in boxes]


def answer_boxes(text: Column) -> Column:
    """F11 with F12 as the way out: struct(boxes, parsed): parsed tells whether the answer was JSON; boxes found loosely are
    labelled object."""

    @F.pandas_udf(f"struct<boxes:{BOX_LIST},parsed:boolean>")
    def parse(s: pd.Series) -> pd.DataFrame:
        out = []
        for t in s:
            boxes = labelled_boxes(t)
            loose = [{"label": "object", "bbox_2d": b} for b in loose_boxes(t)] if boxes is None else boxes
            out.append((loose, boxes is not None))
        return pd.DataFrame(out, columns=["boxes", "parsed"])

    return parse(text)


def index_list(text: str | None, n: int) -> list[int]:
    """F16: the whole numbers below n of an answer's list, a doubled bracket undone; [] for anything else."""
    items = loose_json(text)
    if isinstance(items, list) and items and isinstance(items[0], list):
        items = items[0]
    return [x for x in items if isinstance(x, int) and not isinstance(x, bool) and 0 <= x < n] if isinstance(items, list) else []


def answer_indices(text: Column, n: Column) -> Column:
    """F16 as a column."""

    @F.pandas_udf("array<int>")
    def parse(s: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([index_list(t, int(m)) for t, m in zip(s, k)], dtype="object")

    return parse(text, n)


SUB_TASKS = "struct<task:string,subtasks:array<struct<id:int,name:string,start_frame:int,complete_frame:int,notes:string>>,overall_notes:string>"


def mapped_sub_tasks(text: Column, frame_ids: Column, *, both: bool = True) -> Column:
    """struct(results, valid): an answer's sub-tasks with sample numbers replaced by frame ids, out of range ones by null;
    valid if one was mapped.  `both`: start and completion, else the completion only.  Answers that aren't the object wanted are null."""
    fenced = F.coalesce(F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit("")), text)
    raw = F.from_json(fenced, SUB_TASKS)
    at = lambda i: F.when(i >= 0, F.get(frame_ids, i)).cast("int")
    named = lambda s: s["name"].isNotNull()

    def one(s):
        start = F.when(named(s), at(s["start_frame"])).otherwise(s["start_frame"]) if both else s["start_frame"]
        return s.withField("complete_frame", F.when(named(s), at(s["complete_frame"])).otherwise(s["complete_frame"])).withField("start_frame", start)

    subs = F.transform(raw["subtasks"], one)
    hit = lambda s: named(s) & (s["complete_frame"].isNotNull() | (s["start_frame"].isNotNull() if both else F.lit(False)))
    results = F.when(raw["subtasks"].isNotNull(), F.struct(raw["task"].alias("task"), subs.alias("subtasks"), raw["overall_notes"].alias("overall_notes")))
    return F.struct(results.alias("results"), F.coalesce(F.exists(subs, hit), F.lit(False)).alias("valid"))
