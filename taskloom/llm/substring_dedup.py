"""Substring dedup by suffix automata over reference shards (operator 1).

A window of `window` consecutive words of a document is a repeat if the same word sequence also starts in a
document with a smaller id; every word that a repeated window covers is removed.

Sending an automaton of every reference shard to every document costs the square of the corpus.  Here the shards are
cut by content instead, so that a document meets only the shards that can hold its windows:

1. Of every window the smallest hash among its `gram`-word sequences is its anchor; equal windows have equal
   anchors.  A run of windows with one anchor is a segment (about one for 20 words).
2. Segments are grouped by anchor and content, with the smallest id, before anything is shuffled; anchors that one
   document alone has are dropped.  Texts are fetched once for each distinct segment of the anchors left.
3. Anchors are dealt to tasks; each task collects whole anchors up to `shard_words` into a reference shard, builds a
   suffix automaton of its segments, carries the smallest id of every state's occurrences up the suffix links, and streams
   the shard's segments through it: the matching statistic of a position leads, over suffix links, to the
   state of the last `window` words, whose smallest id says whether an earlier document has the window.
4. An anchor with more than `hot` distinct segments (a passage that a large part of all documents cites in different
   surroundings) would make one shard too large: its windows are split by the 128-bit hash of the whole window instead
   and summed to the smallest id on the map side; the smallest ids of very frequent windows go to their rows by broadcast.
5. Spans go back to their documents, and the words are cut out.

Segments are keyed by 128 bits of hash (anchor and content) over 64-bit word hashes: two segments of n are taken for one with a
probability of about n**2 / 2**129, and that two of the v distinct words of a corpus share a hash has v**2 / 2**65.  Rows: a null or empty text has no words; a null id is
neither reference nor trimmed; rows that repeat an id don't repeat each other (no id is smaller) but both count
against larger ids; of equal texts the smallest id stays whole; an empty table gives no row; extra columns
are not read.  A document of any length is cut into segments of at most 64 windows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, keyed, small_batches, stored, tasks_for, texts_of, with_facts

WINDOW, GRAM, HOT, SHARD_WORDS, MOST_RUN, FREQUENT = 50, 10, 400, 150_000, 64, 2_000
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sequence_hashes(a: np.ndarray, k: int, by: np.uint64) -> np.ndarray:
    """A hash of every k consecutive values."""
    n = len(a) - k + 1
    g = np.zeros(n, np.uint64)
    for i in range(k):
        g = g * by + a[i : i + n]
    return _spread(g)


def segments(a: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, number of windows) of the segments of a document's word hashes."""
    least = sliding_window_view(sequence_hashes(a, gram, _M1), window - gram + 1).min(axis=1)
    starts = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    sizes = np.diff(np.r_[starts, len(least)])
    if sizes.max() > MOST_RUN:  # periodic text
        cut = np.concatenate([np.arange(s, s + n, MOST_RUN) for s, n in zip(starts.tolist(), sizes.tolist())])
        starts, sizes = cut, np.diff(np.r_[cut, len(least)])
    return least[starts], starts, sizes


class SuffixAutomaton:
    """Of several word sequences, with the smallest id of each state's occurrences."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [1 << 62]

    def _new(self, edges: dict, link: int, length: int, first: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.link) - 1

    def _split(self, p: int, word, q: int) -> int:
        """A copy of q that stands for its strings of at most length[p] + 1 words."""
        nxt, link = self.next, self.link
        copy = self._new(dict(nxt[q]), link[q], self.length[p] + 1, self.first[q])
        while p >= 0 and nxt[p].get(word) == q:
            nxt[p][word] = copy
            p = link[p]
        link[q] = copy
        return copy

    def add(self, words, owner: int) -> None:
        nxt, link, length, first = self.next, self.link, self.length, self.first
        last = 0
        for word in words:
            q = nxt[last].get(word)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, word, q)
            else:
                new, p = self._new({}, 0, length[last] + 1, 1 << 62), last
                while p >= 0 and word not in nxt[p]:
                    nxt[p][word] = new
                    p = link[p]
                if p >= 0:
                    q = nxt[p][word]
                    link[new] = q if length[q] == length[p] + 1 else self._split(p, word, q)
                last = new
            if owner < first[last]:
                first[last] = owner

    def carry(self) -> None:
        """Makes `first` that of all occurrences: a state's link occurs wherever the state does."""
        first, link = self.first, self.link
        for v in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            if first[v] < first[link[v]]:
                first[link[v]] = first[v]

    def windows(self, words, window: int) -> list[int]:
        """For each window of the words, the smallest id that has it (1 << 62: none)."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        state, match, out = 0, 0, []
        for i, word in enumerate(words):
            while state and word not in nxt[state]:
                state = link[state]
                match = length[state]
            q = nxt[state].get(word)
            if q is None:
                state, match = 0, 0
            else:
                state, match = q, match + 1
            while state and length[link[state]] >= window:
                state = link[state]
                match = length[state]
            if i >= window - 1:
                out.append(first[state] if match >= window else 1 << 62)
        return out


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of each run of true values."""
    edge = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()))


def all_segments(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """h (anchor), c (content), doc_id, th, lo (first window), n (windows) of keyed rows."""
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for d, th, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), texts_of(batch.column(1))):
                words = text.split() if text else []
                if len(words) < window:
                    continue
                a = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
                h, lo, n = segments(a, window, gram)
                whole = a.tobytes()
                c = [xxhash.xxh3_64_intdigest(whole[8 * s : 8 * (s + k + window - 1)], 7) for s, k in zip(lo.tolist(), n.tolist())]
                for col, x in zip(cols, (h.view(np.int64), np.array(c, np.uint64).view(np.int64), np.full(len(h), d), np.full(len(h), th), lo.astype(np.int32), n.astype(np.int32))):
                    col.append(x)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["h", "c", "doc_id", "th", "lo", "n"])

    return rows.where("doc_id is not null").mapInArrow(run, "h long, c long, doc_id long, th long, lo int, n int")


def segment_words(rows: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """h, c, first, hot, words of the wanted segments (doc_id, th, segs), cut out of the texts."""
    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for d, text, segs in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), batch.column(2).to_pylist()):
                words = text.split()
                for s in segs:
                    for col, x in zip(out, (s["h"], s["c"], d, s["hot"], b" ".join(words[s["lo"] : s["lo"] + s["n"] + window - 1]))):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()))], names=["h", "c", "first", "hot", "words"])

    joined = rows.join(wanted, ["doc_id", "th"])
    return joined.select("doc_id", "text", "segs").mapInArrow(run, "h long, c long, first long, hot boolean, words binary")


def by_automata(words: DataFrame, window: int, shard_words: int) -> DataFrame:
    """h, c, again: the runs of windows of each segment that a smaller id than its own has."""
    def judged(shard):
        automaton = SuffixAutomaton()
        for _, _, first, w in shard:
            automaton.add(w, first)
        automaton.carry()
        h, c, again = [], [], []
        for a, b, first, w in shard:
            found = runs(np.array(automaton.windows(w, window), np.int64) < first)
            if found:
                h.append(a)
                c.append(b)
                again.append([{"a": x, "b": y} for x, y in found])
        return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(c, pa.int64()), pa.array(again, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))], names=["h", "c", "again"])

    def run(batches):
        shard, size, anchor = [], 0, None
        for batch in batches:
            for h, c, first, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if h != anchor and size >= shard_words:
                    yield judged(shard)
                    shard, size = [], 0
                anchor = h
                shard.append((h, c, first, text.split()))
                size += len(shard[-1][3])
        if shard:
            yield judged(shard)

    dealt = words.where("not hot").select("h", "c", "first", "words")
    return dealt.repartition(tasks_for(words), "h").sortWithinPartitions("h").mapInArrow(run, "h long, c long, again array<struct<a:int,b:int>>")


def by_windows(words: DataFrame, window: int, frequent: int = FREQUENT, stored=stored) -> DataFrame:
    """The same for the segments of hot anchors, by 128-bit hashes of whole windows; what is known of a window that more than
    `frequent` segments have goes to them by broadcast."""
    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for h, c, first, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                w = text.split()
                for i in range(len(w) - window + 1):
                    digest = hashlib.blake2b(b" ".join(w[i : i + window]), digest_size=16).digest()
                    for col, x in zip(out, (h, c, first, i, int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True))):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["h", "c", "first", "i", "w1", "w2"])

    rows = words.where("hot").select("h", "c", "first", "words").mapInArrow(run, "h long, c long, first long, i int, w1 long, w2 long")
    rows = stored(rows, "windows")
    # a window that one segment alone has is no repeat
    least = stored(rows.groupBy("w1", "w2").agg(F.min("first").alias("m"), F.max("first").alias("x"), F.count("*").alias("n")).where("m < x").drop("x"), "window-firsts")
    again = with_facts(rows, least, ["w1", "w2"], frequent).where("m < first")
    return again.groupBy("h", "c").agg(F.collect_list(F.struct(F.col("i").alias("a"), F.col("i").alias("b"))).alias("again"))


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT, shard_words: int = SHARD_WORDS, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, th (hash of the text), spans: array<struct<a, b>> of words to remove, end exclusive."""
    small_batches(docs.sparkSession)
    rows, passing = keyed(docs, id_col, text_col), []

    def kept(df: DataFrame, name: str) -> DataFrame:
        passing.append(stored(df, name))
        return passing[-1]

    found = kept(all_segments(rows, window, gram), "segments")
    distinct = found.groupBy("h", "c").agg(F.min(F.struct("doc_id", "th", "lo", "n")).alias("rep"), F.max("doc_id").alias("last"))
    anchors = distinct.groupBy("h").agg(F.min("rep.doc_id").alias("lo_id"), F.max("last").alias("hi_id"), F.count("*").alias("k")).where("lo_id < hi_id")
    live = kept(distinct.join(anchors.select("h", "k"), "h").select("h", "c", "k", "rep.*"), "live")
    wanted = live.where("k > 1").groupBy("doc_id", "th").agg(F.collect_list(F.struct("h", "c", "lo", "n", (F.col("k") > hot).alias("hot"))).alias("segs"))
    words = kept(segment_words(rows, kept(wanted, "wanted"), window), "segment-words")
    again = by_automata(words, window, shard_words).unionByName(by_windows(words, window, frequent, stored=kept))
    judged = kept(live.select("h", "c", F.col("doc_id").alias("first")).join(again, ["h", "c"], "left"), "judged")
    of = found.join(judged, ["h", "c"])
    whole = F.array(F.struct(F.lit(0).alias("a"), (F.col("n") - 1).alias("b")))
    cut = of.select("doc_id", "th", "lo", F.explode(F.when(F.col("doc_id") > F.col("first"), whole).otherwise(F.col("again"))).alias("w"))
    spans = cut.select("doc_id", "th", F.struct((F.col("lo") + F.col("w.a")).alias("a"), (F.col("lo") + F.col("w.b") + window).alias("b")).alias("s"))
    out = stored(spans.groupBy("doc_id", "th").agg(F.collect_set("s").alias("spans")), "spans")
    for t in passing:  # all that was read for the spans
        drop_stored(t)
    return out


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True, **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if wanted, kept_text (the words left, joined by one space)."""
    spans = repeated_spans(docs, id_col=id_col, text_col=text_col, **options)
    rows = keyed(docs, id_col, text_col).join(spans, ["doc_id", "th"], "left").select("doc_id", "text", "spans")

    def run(batches):
        for batch in batches:
            n, removed, digest, texts = [], [], [], []
            for text, cuts in zip(texts_of(batch.column(1)), batch.column(2).to_pylist()):
                words = text.split() if text else []
                keep = np.ones(len(words), bool)
                for s in cuts or ():
                    keep[s["a"] : s["b"]] = False
                left = b" ".join([w for w, k in zip(words, keep.tolist()) if k] if cuts else words)
                n.append(len(words))
                removed.append(len(words) - int(keep.sum()))
                digest.append(hashlib.sha256(left).hexdigest())
                texts.append(left.decode())
            out = {"doc_id": batch.column(0), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
            yield pa.RecordBatch.from_pydict(out | ({"kept_text": pa.array(texts, pa.string())} if keep_text else {}))

    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text)
