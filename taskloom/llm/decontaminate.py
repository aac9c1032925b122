"""Benchmark decontamination: BM25 index of test items with block-max WAND (operator 5).

The test items are the indexed side.  They are few beside the corpus; their index is built in shards of at most
`shard_bytes` of item text, and one shard at a time is collected and broadcast, so its size is bounded whatever the size
of the benchmark (an index takes about 60 times its items' text in a Python worker).  Every passage of every document is a query.
Passages are windows over the whole text, half overlapping; an item meets those of its own length class (the next power of two,
LEAST_WINDOW at least, twice that wide), so any copy of it lies within one, and neither other items nor the shards change
what is found.  An item's impacts are divided by the score the item has against itself, so a score
is the share of the item that the passage carries and one threshold serves short and long items.  Scores are rounded to six
digits before they are compared, so that the order of a sum decides nothing.

Lengths are weighed against the mean of all items.  Inverse frequencies are those of the training documents, counted in one pass over
all of them for the terms of all items (more passes if these terms have more than `vocabulary_bytes`); so
words that the corpus has everywhere weigh little.  A passage is scored by document-at-a-time WAND with the maximum of each block of postings; before that, the same kind of
bound over the whole shard rules most passages out: common terms that together can't bring any item to the threshold
are left out, and the best impacts of the others in the window, then those of each item, must make up the difference.  Neither drops an item that
reaches the threshold.  What is retrieved is verified on word triples: at least `overlap` of those of the item's question (the
first half of its words) and of its answer (the second half) must stand in the passage.  A half of one or two words is
verified as a whole, on the passage's words or word pairs; the empty answer of a one-word item asks for nothing.

Rows: a null or empty text has no passage, an item without words no posting; a null doc_id is reported as null;
repeated rows are one row of the result; items that repeat a text are all reported; empty tables give no rows;
only id and text columns are read.
"""

from __future__ import annotations

import functools
import math
from array import array
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored

THRESHOLD, OVERLAP, K1, B, BLOCK = 0.5, 0.5, 1.2, 0.75, 32
LEAST_WINDOW, SHARD_BYTES, VOCABULARY_BYTES, COMMON = 64, 2 << 20, 16 << 20, 0.3
SLACK = 6e-7  # of scores that are rounded to six digits
_PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words; ASCII marks and white space part them."""
    return text.lower().encode().translate(_PLAIN).split() if text else []


def triples(words: list[bytes], n: int = 3) -> set[tuple[bytes, ...]]:
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def length_class(n: int) -> int:
    """Half the width of the passages that an item of n words meets."""
    return max(LEAST_WINDOW, 1 << (n - 1).bit_length())


class Index:
    """BM25 postings of items of one length class, by term: item numbers and impacts in order, with the best impact of each
    block.  `mean` is the mean length of all items (None: of these)."""

    def __init__(self, items: list[tuple[int, str | None]], df: dict[bytes, int], n_docs: int, *, mean: float | None = None, k1: float = K1, b: float = B, block: int = BLOCK, threshold: float = THRESHOLD, common: float = COMMON):
        common = min(common, 0.6 * threshold)
        same: dict[bytes, bytes] = {}  # one object a word
        texts = [(i, [same.setdefault(w, w) for w in words_of(t)]) for i, t in items]
        texts = sorted((i, w) for i, w in texts if w)
        self.ids = [i for i, _ in texts]
        self.halves = [(triples(w[: (len(w) + 1) // 2]), triples(w[(len(w) + 1) // 2 :])) for _, w in texts]
        self.sizes = [tuple(len(next(iter(h), ())) for h in halves) for halves in self.halves]
        self.stride, self.block, self.threshold = length_class(max((len(w) for _, w in texts), default=1)), block, threshold
        mean = mean or sum(len(w) for _, w in texts) / max(1, len(texts))
        self.postings: dict[bytes, tuple[array, array, array]] = {}
        for n, (_, w) in enumerate(texts):
            own = {t: math.log(1 + (n_docs - df.get(t, 0) + 0.5) / (df.get(t, 0) + 0.5)) * c * (k1 + 1) / (c + k1 * (1 - b + b * len(w) / mean)) for t, c in Counter(w).items()}
            total = sum(own.values())
            for t, x in own.items():
                at = self.postings.setdefault(t, (array("i"), array("d"), array("d")))
                at[0].append(n)
                at[1].append(x / total)
        for nums, impacts, best in self.postings.values():
            best.extend(max(impacts[i : i + block]) for i in range(0, len(nums), block))
        self.best = {t: max(p[2]) for t, p in self.postings.items()}
        # the most frequent terms, as long as all of them together can't bring any item above `common`
        held, self.left_out = [0.0] * len(texts), 0.0
        self.rare = dict(self.best)
        for t in sorted(self.postings, key=lambda t: (-df.get(t, 0), t)):
            nums, impacts, _ = self.postings[t]
            if all(held[n] + x <= common for n, x in zip(nums, impacts)):
                for n, x in zip(nums, impacts):
                    held[n] += x
                del self.rare[t]
        self.held, self.left_out = held, max(held, default=0.0)

    def hopeful(self, terms: set[bytes]) -> bool:
        """Whether some item can reach the threshold: its impacts of the passage's rare terms and of all left-out ones."""
        postings, got = self.postings, {}
        for t in terms & self.rare.keys():
            for n, x in zip(*postings[t][:2]):
                got[n] = got.get(n, 0.0) + x
        held, need = self.held, self.threshold - SLACK
        return any(x + held[n] >= need for n, x in got.items())

    def search(self, terms: set[bytes]) -> list[tuple[int, float]]:
        """(item number, score) of all items that reach the threshold, by block-max WAND."""
        need, block, found = self.threshold - SLACK, self.block, []
        lists = [[p[0][0], 0, p, self.best[t]] for t in terms if (p := self.postings.get(t))]
        while lists:
            lists.sort(key=lambda x: x[0])
            bound, pivot = 0.0, -1
            for k, x in enumerate(lists):
                bound += x[3]
                if bound >= need:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            # the best of the blocks in which the item would stand
            at_most, upto = 0.0, 1 << 60
            for x in lists[: pivot + 1]:
                nums, _, best = x[2]
                k = bisect_left(nums, item, x[1]) // block
                if k < len(best):
                    at_most += best[k]
                    upto = min(upto, nums[min(len(nums), (k + 1) * block) - 1] + 1)
            if at_most >= need:
                score = 0.0
                for x in lists[: pivot + 1]:
                    nums, impacts, _ = x[2]
                    x[1] = bisect_left(nums, item, x[1])
                    if x[1] < len(nums) and nums[x[1]] == item:
                        score += impacts[x[1]]
                if score >= need:
                    found.append((item, score))
                goal = item + 1
            else:
                goal = max(item + 1, min(upto, lists[pivot + 1][0] if pivot + 1 < len(lists) else upto))
            for x in lists[: pivot + 1]:
                nums = x[2][0]
                x[1] = bisect_left(nums, goal, x[1])
                x[0] = nums[x[1]] if x[1] < len(nums) else -1
            lists = [x for x in lists if x[0] >= 0]
        return found

    def matches(self, words: list[bytes], overlap: float) -> dict[int, tuple[float, float, float, int]]:
        """item number -> best (score, question overlap, answer overlap, first word of the passage)."""
        if not words or not self.ids:
            return {}
        stride = self.stride
        get = self.rare.get
        best = np.fromiter((get(w, 0.0) for w in words), np.float64, len(words))
        need = self.threshold - self.left_out - SLACK
        if best.sum() < need:
            return {}
        total = np.r_[0.0, np.cumsum(best)]
        starts = np.arange(0, max(1, len(words) - stride), stride)
        bounds = total[np.minimum(starts + 2 * stride, len(words))] - total[starts]
        out: dict[int, tuple[float, float, float, int]] = {}
        for s in starts[bounds >= need].tolist():
            passage = words[s : s + 2 * stride]
            terms, there = set(passage), {}
            if not self.hopeful(terms):
                continue
            for n, score in self.search(terms):
                if (score := round(score, 6)) < self.threshold:
                    continue
                for size in self.sizes[n]:
                    if size and size not in there:
                        there[size] = triples(passage, size)
                q, a = (len(h & there[size]) / len(h) if h else 1.0 for h, size in zip(self.halves[n], self.sizes[n]))
                if q >= overlap and a >= overlap and (n not in out or score > out[n][0]):
                    out[n] = (score, q, a, s)
        return out


def indexes(items: list[tuple[int, str | None]], df: dict[bytes, int], n_docs: int, mean: float, threshold: float) -> list[Index]:
    """An index for each length class of the items."""
    classes: dict[int, list] = {}
    for i, t in items:
        if n := len(words_of(t)):
            classes.setdefault(length_class(n), []).append((i, t))
    return [Index(part, df, n_docs, mean=mean, threshold=threshold) for _, part in sorted(classes.items())]


def item_rows(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """i, t, n (words), terms (distinct words) of items with words."""

    def run(batches):
        for batch in batches:
            words = [words_of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(w) for w in words], pa.int64()), pa.array([sorted(set(w)) for w in words], pa.list_(pa.binary()))], names=["i", "t", "n", "terms"])

    rows = items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, "i long, t string, n long, terms array<binary>").where("n > 0")


def parts_of(rows: DataFrame, size: int, most: int, key: str) -> list[DataFrame]:
    """The rows in parts of about `most` of `size` bytes at most, by a hash of the key."""
    n = -(-3 * size // (2 * most)) if size > most else 1
    return [rows.where(F.pmod(F.xxhash64(key), F.lit(n)) == k) for k in range(n)] if n > 1 else [rows]


def document_counts(docs: DataFrame, vocabulary: DataFrame, vocabulary_bytes: int) -> DataFrame:
    """term, n: documents that have each term of the vocabulary; the row of the null term counts all documents."""

    def counted(terms: set[bytes]) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(terms)

        def run(batches):
            wanted, counts, n = sent.value, Counter(), 0
            for batch in batches:
                n += batch.num_rows
                for text in batch.column(1).to_pylist():
                    counts.update(wanted.intersection(words_of(text)))
            yield pa.RecordBatch.from_arrays([pa.array([None, *counts], pa.binary()), pa.array([n, *counts.values()], pa.int64())], names=["term", "n"])

        return docs.mapInArrow(run, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))

    size = vocabulary.agg(F.sum(F.octet_length("term") + 60)).first()[0] or 0
    parts = [counted({bytes(r["term"]) for r in part.collect()}) for part in parts_of(vocabulary, size, vocabulary_bytes, "term")]
    return stored(functools.reduce(DataFrame.unionByName, [parts[0], *(p.where("term is not null") for p in parts[1:])]), "term-counts")


def contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP, shard_bytes: int = SHARD_BYTES, vocabulary_bytes: int = VOCABULARY_BYTES, hash_col: str | None = None) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap, passage_start of each document and item found in it.

    With hash_col, documents are told apart by id and xxhash64 of the text, which that column then holds."""
    spark = docs.sparkSession
    small_batches(spark)
    text, keys = F.col(text_col).cast("string"), ["doc_id", *([hash_col] if hash_col else []), "item_id"]
    rows = docs.select(F.col(id_col).cast("long"), text, *([F.xxhash64(text)] if hash_col else []))
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, passage_start long" + (f", `{hash_col}` long" if hash_col else "")
    names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "passage_start", *([hash_col] if hash_col else [])]
    known = stored(item_rows(items, item_col, item_text_col), "items")
    size, mean = known.agg(F.sum(F.octet_length("t")), F.avg("n")).first()
    if mean is None:  # no items, no rows
        return spark.createDataFrame([], schema).select(*keys, "score", "question_overlap", "answer_overlap", "passage_start")
    counts = document_counts(rows, known.select(F.explode("terms").alias("term")).distinct(), vocabulary_bytes)
    n_docs = counts.where("term is null").agg(F.sum("n")).first()[0] or 0
    found = None
    for shard in parts_of(known, size, shard_bytes, "t"):
        of_shard = counts.join(shard.select(F.explode("terms").alias("term")).distinct(), "term", "left_semi")
        df = {bytes(r["term"]): r["n"] for r in of_shard.collect()}
        sent = spark.sparkContext.broadcast(indexes([(r["i"], r["t"]) for r in shard.select("i", "t").collect()], df, n_docs, mean, threshold))

        def run(batches, sent=sent):
            for batch in batches:
                out: list[list] = [[] for _ in names]
                for d, text, *th in zip(*(c.to_pylist() for c in batch.columns)):
                    words = words_of(text)
                    for index in sent.value:
                        for n, (score, q, a, s) in index.matches(words, overlap).items():
                            for col, x in zip(out, (d, index.ids[n], score, round(q, 6), round(a, 6), s, *th)):
                                col.append(x)
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names=names)

        part = rows.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    best = F.max(F.struct("score", "question_overlap", "answer_overlap", (-F.col("passage_start")).alias("p"))).alias("m")
    return found.groupBy(*keys).agg(best).select(*keys, "m.score", "m.question_overlap", "m.answer_overlap", (-F.col("m.p")).alias("passage_start"))
