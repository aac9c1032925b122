"""Scalar text functions: progress values, reasoning, plans, actions, prompts.  All native column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from taskloom.functions.loose_json import loose_json

NUMBER = r"([-+]?(?:\d+\.\d+|\d+|\.\d+))(%?)"
TAG = r"(?is)<progress>(.*?)</progress>"
STRICT_TAG = r"(?i)<progress>\s*([+-]?\d+(?:\.\d+)?)\s*%?\s*</progress>"
#: Sub-task names that mark an end and are no actions.
NOT_ACTIONS = ("done", "done.", "not done", "not done.")
#: Words without weight in label similarity.
STOPWORDS = (
    "i", "you", "he", "she", "it", "we", "they", "me", "him", "her", "us", "them", "a", "an", "the", "is", "are", "was", "were",
    "be", "been", "and", "or", "but", "if", "then", "so",
)


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null where there is none or it is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def progress_value(text: Column) -> Column:
    """percentage that a text states: the first number in its first tag, else in the whole text.  A number followed
    by % stands as it is; else one of at most 1 is a fraction."""

    def parsed(part: Column) -> Column:
        value = found(part, NUMBER).try_cast("double")
        return F.when(F.regexp_extract(part, NUMBER, 2) == "%", value).when(value <= 1, value * 100).otherwise(value)

    return F.coalesce(parsed(F.regexp_extract(text, TAG, 1)), parsed(text))


def strict_progress(text: Column) -> Column:
    """the number of a well-formed tag, held to 0..100."""
    value = found(text, STRICT_TAG).try_cast("double")  # greatest and least pass over nulls
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), value)))


def training_progress(turns: Column) -> Column:
    """of turns (array<struct<from, value>>) the number in the first non-human turn that has a tag, else -1."""
    answers = F.filter(turns, lambda t: (F.lower(t["from"]) != "human") & t["value"].rlike(TAG))
    text = F.regexp_replace(F.regexp_extract(F.get(answers, F.lit(0))["value"], TAG, 1), "%", "")
    return F.coalesce(F.trim(text).try_cast("double"), F.lit(-1.0))


def reasoning_text(text: Column) -> Column:
    """without the sentence that states the progress, blank lines and lines that draw a conclusion."""
    cut = F.regexp_replace(F.trim(text), r"(?i)[^.\n]*<progress>\s*[+-]?\d+(?:\.\d+)?\s*%?\s*</progress>[^.\n]*\.?", "")
    lines = F.transform(F.split(F.coalesce(cut, F.lit("")), r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~x.rlike(r"(?i)^(therefore|thus|hence|so)\b")), "\n")


def split_actions(text: Column) -> Column:
    """actions of a free-form list, lower-cased and without numbering."""
    flat = F.regexp_replace(F.replace(F.lower(text), F.lit("\r"), F.lit("\n")), r"\b\d+\.\s*", "")
    return F.filter(F.transform(F.split(flat, r"[.\n;]+"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def plan_lines(text: Column) -> Column:
    """the lines of a numbered plan, without their numbers."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return F.transform(lines, lambda x: F.when(x.rlike(r"^\d"), F.regexp_replace(x, r"^[^.]*\.\s*", "")).otherwise(x))


def first_sentences(text: Column, n: int = 3) -> Column:
    """at most n sentences, closed by a full stop."""
    kept = F.array_join(F.slice(F.split(text, r"\. "), 1, n), ". ")
    return F.when(kept.endswith("."), kept).otherwise(F.concat(kept, F.lit(".")))


def after_marker(text: Column, marker: str = "cot:") -> Column:
    """F8: what follows the first marker up to the next one, else the whole text."""
    return F.trim(F.coalesce(F.get(F.split(text, marker), F.lit(1)), text))


def done_verdict(text: Column) -> Column:
    """whether an answer says yes; anything else is no."""
    return F.coalesce(F.lower(text).contains("yes"), F.lit(False))


def finish_reason(cot: Column) -> Column:
    """the second part between full stops, null where there is none."""
    return F.trim(F.get(F.split(cot, r"\."), F.lit(1)))


def boxed(text: Column) -> Column:
    """what stands between the box markers, else the text."""
    return F.coalesce(F.trim(found(text, r"(?s)<\|begin_of_box\|>(.*?)<\|end_of_box\|>")), text)


def stripped(text: Column) -> Column:
    """Without white space of any kind around."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def without_thinking(text: Column) -> Column:
    """without <think> sections and user marks."""
    return stripped(F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"<\|user\|>", ""))


def after_thinking(text: Column) -> Column:
    """what follows the first </think>, up to the next one; a text without one as a whole."""
    return stripped(F.coalesce(F.get(F.split(text, "</think>", -1), F.lit(1)), text))


def is_segment_list(text: str | None) -> bool:
    """Whether an answer holds a list of objects, an empty one too."""
    items = loose_json(text)
    return isinstance(items, list) and all(isinstance(x, dict) for x in items)


def states_progress(text: Column) -> Column:
    """Whether a text has a progress tag."""
    return F.coalesce(text.contains("<progress>") & text.contains("</progress>"), F.lit(False))


def task_type(text: Column) -> Column:
    """progress, segmentation (a JSON list of objects, the empty one and one with a model's slips too) or planning.  Only
    texts with a bracket and without a tag go through Python."""

    @F.pandas_udf("boolean")
    def listed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: is_segment_list(t) if t else False)

    open_ = F.when(~states_progress(text) & text.contains("["), text)
    return F.when(states_progress(text), "progress").when(listed(open_), "segmentation").otherwise("planning")


def printable(text: Column) -> Column:
    """without control characters."""
    return F.regexp_replace(text, r"[\x00-\x1F\x7F]", "")


def content_words(text: Column) -> Column:
    """lower-cased words without stopwords, repeats kept."""
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: ~F.array_contains(stop, w))


def numbered(items: Column) -> Column:
    """`1. a` lines of an array."""
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def filled(template: str, **columns: Column) -> Column:
    """the template with each {name} replaced by its column."""
    out = F.lit(template)
    for name, c in columns.items():
        out = F.replace(out, F.lit("{" + name + "}"), c.cast("string"))
    return out


def image_path(root: Column, frame: Column) -> Column:
    """path of a frame's image."""
    return F.format_string("%s/%06d.jpg", root, frame)


def clip_path(root: Column, first: Column, last: Column) -> Column:
    """path of a clip's video."""
    return F.format_string("%s/%06d_%06d.mp4", root, first, last)


def timestamp_marks(n: Column) -> Column:
    """<i.0 seconds> for i below n."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.concat(F.lit("<"), i.cast("string"), F.lit(".0 seconds>")))).otherwise(F.array().cast("array<string>"))


def safe_tag(text: Column, at: Column | None = None) -> Column:
    """blanks and other marks as _, with epoch milliseconds if a time is given."""
    tag = F.regexp_replace(F.regexp_replace(text, r"\s+", "_"), r"[^A-Za-z0-9_]", "_")
    return tag if at is None else F.concat_ws("_", tag, F.unix_millis(at).cast("string"))


def nice_step(span: Column, ticks: int) -> Column:
    """an axis step of 1, 2, 5 or 10 times a power of ten for about so many ticks."""
    raw = span / F.lit(float(ticks))
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    lead = raw / power
    return power * F.when(lead <= 1, 1.0).when(lead <= 2, 2.0).when(lead <= 5, 5.0).otherwise(10.0)


def axis_ticks(low: Column, high: Column, step: Column) -> Column:
    """the multiples of a step from low to high."""
    return F.transform(F.sequence(F.ceil(low / step).cast("int"), F.floor(high / step).cast("int")), lambda i: i * step)


def label_color(label: Column) -> Column:
    """a stable light colour of a label: 80 + half of each of the first three bytes of its md5."""
    digest = F.md5(F.lower(F.regexp_replace(label, r"[^A-Za-z0-9]", "")))
    byte = lambda i: F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("int")
    return F.array(*(80 + F.floor(byte(i) / 2).cast("int") for i in range(3)))


def grounding_prompt(task: Column, objects: Column) -> Column:
    """the prompt by what is known: objects, else the task, else neither."""
    named = F.filter(F.coalesce(objects, F.array().cast("array<string>")), lambda o: F.trim(o) != "")
    given = F.coalesce(F.trim(task), F.lit("")) != ""
    return (
        F.when(F.size(named) > 0, F.concat(F.lit("Locate these objects: "), F.array_join(named, ", "), F.lit(".")))
        .when(given, F.concat(F.lit("Locate all objects that matter for the task: "), F.trim(task), F.lit(".")))
        .otherwise(F.lit("Locate all objects that can be handled."))
    )


def word_count(text: Column) -> Column:
    """Words between white space."""
    return F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)))


def rewrite_progress(text: Column, logit: Column) -> Column:
    """The tag's number replaced by the value head's: 100 * sigmoid, two decimals."""
    value = F.format_string("%.2f", 100.0 / (1.0 + F.exp(-logit)))
    return F.regexp_replace(text, F.lit(r"(?is)<progress>.*?</progress>"), F.concat(F.lit("<progress>"), value, F.lit("%</progress>")))
