"""Box geometry on array<double> columns [x1, y1, x2, y2]."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "struct<label:string,bbox_2d:array<double>,score:double,interpolated:boolean>"
#: Words that make a label useless wherever they stand in it, and labels that are useless as a whole.
USELESS_KEYWORDS = ("computer", "keyboard", "mouse", "monitor", "charger", "power outlet", "laptop", "person", "power strip", "powerbank", "powerstrip", "office", "sofa")
USELESS_LABELS = ("chair", "table", "desk", "desktop")


def side(b: Column, i: int) -> Column:
    return F.get(b, F.lit(i))


def area(b: Column) -> Column:
    return F.greatest(side(b, 2) - side(b, 0), F.lit(0.0)) * F.greatest(side(b, 3) - side(b, 1), F.lit(0.0))


def intersection(a: Column, b: Column) -> Column:
    w = F.least(side(a, 2), side(b, 2)) - F.greatest(side(a, 0), side(b, 0))
    h = F.least(side(a, 3), side(b, 3)) - F.greatest(side(a, 1), side(b, 1))
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    both = intersection(a, b)
    raw = lambda x: (side(x, 2) - side(x, 0)) * (side(x, 3) - side(x, 1))
    return both / F.greatest(raw(a) + raw(b) - both, F.lit(1e-8))


def center_distance(a: Column, b: Column) -> Column:
    mid = lambda x, i: (side(x, i) + side(x, i + 2)) / 2
    return F.sqrt(F.pow(mid(a, 0) - mid(b, 0), 2.0) + F.pow(mid(a, 1) - mid(b, 1), 2.0))


def distance(a: Column, b: Column, alpha: float = 0.75, beta: float = 0.25) -> Column:
    """Weighted sum of centre distance (by the unit square's diagonal) and 1 - IoU."""
    return alpha * center_distance(a, b) / math.sqrt(2) + beta * (1 - iou(a, b))


def nearest_distance(box: Column, others: Column, alpha: float = 0.75, beta: float = 0.25) -> Column:
    """G1: least distance to a box of another frame; null without one."""
    return F.array_min(F.transform(others, lambda o: distance(box, o, alpha, beta)))


def enclosing_distance(a: Column, b: Column, alpha: float = 0.25, beta: float = 0.75) -> Column:
    """The same with the centre distance by the diagonal of the box around both."""
    w = F.greatest(side(a, 2), side(b, 2)) - F.least(side(a, 0), side(b, 0))
    h = F.greatest(side(a, 3), side(b, 3)) - F.least(side(a, 1), side(b, 1))
    return alpha * center_distance(a, b) / F.greatest(F.sqrt(w * w + h * h), F.lit(1e-8)) + beta * (1 - iou(a, b))


def is_normalized(b: Column) -> Column:
    """Four sides within 0..1."""
    return (F.size(b) == 4) & F.forall(b, lambda x: (x >= 0) & (x <= 1))


def normalized(b: Column, grid: float = 1000.0) -> Column:
    """From a grid to 0..1, held to it; null for boxes that are no box then."""
    out = F.transform(b, lambda x: F.greatest(F.lit(0.0), F.least(x / grid, F.lit(1.0))))
    return F.when((F.size(b) == 4) & (side(out, 0) < side(out, 2)) & (side(out, 1) < side(out, 3)), out)


def denormalized(b: Column, grid: float = 1000.0) -> Column:
    """Whole grid steps, cut off."""
    return F.when(F.size(b) == 4, F.transform(b, lambda x: (x * grid).cast("int")))


def padded(b: Column, by: float = 0.025) -> Column:
    """Grown on all sides, held to 0..1."""
    grown = lambda x, i: F.when(i < 2, F.greatest(x - by, F.lit(0.0))).otherwise(F.least(x + by, F.lit(1.0)))
    return F.transform(b, grown)


def hash_similarity(a: Column, b: Column) -> Column:
    """Share of equal bits of two 64-bit perceptual hashes."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def resized(width: Column, height: Column, to_width: int = -1, to_height: int = -1) -> Column:
    """(width, height) with the side given as -1 following the aspect ratio."""
    w = F.lit(to_width) if to_width > 0 else F.when(F.lit(to_height > 0), (width * to_height / height).cast("int")).otherwise(width)
    h = F.lit(to_height) if to_height > 0 else F.when(F.lit(to_width > 0), (height * to_width / width).cast("int")).otherwise(height)
    return F.struct(w.cast("int").alias("width"), h.cast("int").alias("height"))


def by_area(boxes: Column) -> Column:
    """Boxes (structs with bbox_2d) from small to large."""
    keyed = F.transform(boxes, lambda x, i: F.struct(area(x["bbox_2d"]).alias("area"), i.alias("i"), x.alias("box")))
    return F.transform(F.array_sort(keyed, lambda x, y: F.when(x["area"] < y["area"], -1).when(x["area"] > y["area"], 1).otherwise(x["i"] - y["i"])), lambda x: x["box"])


def upper_left_kept(boxes: Column) -> Column:
    """P10: 0-based places of the boxes that the rules for upper-left and tiny boxes keep."""
    upper = lambda x: (side(x["bbox_2d"], 2) < 0.5) & (side(x["bbox_2d"], 3) < 0.5)
    tiny = lambda x: F.greatest(side(x["bbox_2d"], 2) - side(x["bbox_2d"], 0), side(x["bbox_2d"], 3) - side(x["bbox_2d"], 1)) < 0.05
    flags = F.transform(boxes, lambda x, i: F.struct(i.alias("i"), upper(x).alias("u"), tiny(x).alias("t")))
    kept = lambda cond: F.transform(F.filter(flags, cond), lambda x: x["i"])
    count = lambda cond: F.size(F.filter(flags, cond))
    n = F.size(boxes)
    return (
        F.when(n <= 2, kept(lambda x: F.lit(True)))
        .when(n >= 8, kept(lambda x: ~x["u"] & ~x["t"]))
        .when(n >= 5, kept(lambda x: ~x["u"]))
        .when(F.forall(flags, lambda x: x["u"]), kept(lambda x: F.lit(False)))
        .when(count(lambda x: x["u"] & x["t"]) >= 2, kept(lambda x: ~(x["u"] & x["t"])))
        .when(count(lambda x: x["u"]) >= 3, kept(lambda x: ~x["u"]))
        .otherwise(kept(lambda x: F.lit(True)))
    )


def without_label(boxes: Column, word: str = "gripper") -> Column:
    """Boxes whose label doesn't have the word."""
    return F.filter(boxes, lambda b: ~F.coalesce(F.lower(b["label"]).contains(word), F.lit(False)))


def useless(label: Column, task: Column, keywords=USELESS_KEYWORDS, labels=USELESS_LABELS) -> Column:
    """Whether a label has a useless keyword, or is a useless label, that the task doesn't name."""
    low, about = F.lower(label), F.lower(task)
    return F.exists(F.array(*map(F.lit, keywords)), lambda k: ~F.contains(about, k) & F.contains(low, k)) | F.exists(F.array(*map(F.lit, labels)), lambda k: ~F.contains(about, k) & (low == k))


def tile_grid(width: Column, height: Column, least: int = 1, most: int = 12, tile: int = 448) -> Column:
    """struct(cols, rows) of the tile grid with the closest aspect ratio; of equally close ones the larger, if the image
    has more than half its area."""
    pairs = sorted({(i, j) for i in range(1, most + 1) for j in range(1, most + 1) if least <= i * j <= most}, key=lambda p: (p[0] * p[1], p))
    ratio = width / height
    options = F.array(*(F.struct(F.lit(i).alias("cols"), F.lit(j).alias("rows")) for i, j in pairs))
    start = F.struct(F.lit(float("inf")).alias("d"), F.struct(F.lit(1).alias("cols"), F.lit(1).alias("rows")).alias("g"))

    def step(best, o):
        d = F.abs(ratio - o["cols"] / o["rows"])
        better = (d < best["d"]) | ((d == best["d"]) & (width * height > 0.5 * tile * tile * o["cols"] * o["rows"]))
        return F.struct(F.when(better, d).otherwise(best["d"]).alias("d"), F.when(better, o).otherwise(best["g"]).alias("g"))

    return F.aggregate(options, start, step, lambda b: b["g"])
