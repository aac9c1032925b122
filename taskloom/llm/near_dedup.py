"""MinHash near-duplicate detection with tensored banding (operator 6).

A document's set is that of its distinct 5-word shingles.  Documents with one and the same set are first folded into
the one with the smallest id.  Of each folded set two small collections of sub-keys are computed, `side` sub-keys of
`rows` min-hashes each; every pair (one of the first, one of the second) is a table key, so side**2 tables of
2 * rows min-hashes cost only 2 * side * rows min-hashes (with 10 and 2: 100 tables of 4 from 40 instead of 400).
A pair of similarity s shares no table with probability below 2 * (1 - s**rows)**side: 6e-6 at 0.85 and falling.

Within a table key every set is compared with one leader: the member that meets the most others over all its keys (in a
group of edited copies that is the text they were made from).  Members that this leaves in different components are then
compared with each other, but only if their parity bitmaps allow a link: each set is folded into PARITY bits, bit b
telling whether an odd number of its shingles hash to b, so two bitmaps differ in at most as many bits as the sets
differ in shingles, and a pair whose bitmaps differ in too many can't be alike.  That test stands in the join's condition, so
pairs that fail it are never rows; no pair that could be a link is left out.  Every link is confirmed on the full
shingle sets, and components come from an iterated minimum over links with pointer jumping.  Tables between the steps
are written to the shared folder.

Sets are of 64-bit hashes of shingles: two of a pair's s shingles share one with a probability of about s**2 / 2**65, which can
only matter to a pair on the border.

Rows: without text or words the set is empty and links with nothing; a null id links with nothing, has a null
component and is kept; rows that repeat an id are one node; ties go to the smallest id; an empty table gives no row;
extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, keyed, small_batches, stored, texts_of

SHINGLE = 5
NUM, DEN = 85, 100
SIDE, ROWS = 10, 2
PARITY = 512
_UPPER = bytes(range(65, 91))
_FOLD = bytes.maketrans(_UPPER, _UPPER.lower())
_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hash of a word, remembered up to a limit."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, hashes: WordHashes, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of fewer words, the whole sequence as one."""
    words = text.translate(_FOLD).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    a = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(a) - k + 1)
    width = min(k, len(a))
    g = np.full(n, width, np.uint64)
    for i in range(width):
        g = mixed(g * _MIX + a[i : i + n])
    return np.unique(g)


def seeds(side: int, rows: int) -> np.ndarray:
    return mixed(np.arange(1, 2 * side * rows + 1, dtype=np.uint64) * _MIX)


def sub_keys(s: np.ndarray, salt: np.ndarray, side: int, rows: int) -> np.ndarray:
    """2 * side sub-keys: of each `rows` min-hashes."""
    least = np.fromiter((((s ^ x) * (x | np.uint64(1))).min() for x in salt), np.uint64, len(salt)).reshape(2 * side, rows)
    key = np.zeros(2 * side, np.uint64)
    for r in range(rows):
        key = mixed(key * _MIX + least[:, r])
    return key


def parity(s: np.ndarray) -> np.ndarray:
    """PARITY bits as longs: bit b is set if an odd number of the hashes have b as their top bits."""
    odd = np.bincount((s >> np.uint64(64 - PARITY.bit_length() + 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def signatures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", side: int = SIDE, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, f1, f2 (128 bits that stand for the set), keys (the left and right sub-keys), bits (parity bitmap)."""
    small_batches(docs.sparkSession)

    def run(batches):
        hashes, salt = WordHashes(), seeds(side, rows)
        for batch in batches:
            n, f1, f2, keys, bits = [], [], [], [], []
            for t in texts_of(batch.column(1)):
                s = shingles(t, hashes)
                n.append(len(s))
                digest = xxhash.xxh128_intdigest(s.tobytes())
                f1.append(np.int64(np.uint64(digest >> 64)))
                f2.append(np.int64(np.uint64(digest & (1 << 64) - 1)))
                keys.append(sub_keys(s, salt, side, rows).view(np.int64) if len(s) else [])
                bits.append(parity(s))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_shingles": pa.array(n, pa.int64()), "f1": pa.array(f1, pa.int64()), "f2": pa.array(f2, pa.int64()), "keys": pa.array(keys, pa.list_(pa.int64())), "bits": pa.array(bits, pa.list_(pa.int64()))})

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, keys array<bigint>, bits array<bigint>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """id, shingles of (doc_id, text): what candidates are confirmed on."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            sets = [shingles(t, hashes).view(np.int64) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "shingles": pa.array(sets, pa.list_(pa.int64()))})

    return docs.select("doc_id", "text").mapInArrow(run, "id long, shingles array<bigint>")


def table_keys(folded: DataFrame, side: int) -> DataFrame:
    """key, id: one row for each of the side**2 pairs of sub-keys."""
    pairs = F.flatten(F.transform(F.slice("keys", 1, side), lambda a, i: F.transform(F.slice("keys", side + 1, side), lambda b, j: F.xxhash64(a, b, i, j))))
    return folded.select(F.explode(pairs).alias("key"), "id")


def confirm(pairs: DataFrame, sets: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    sized = sets.select("id", "shingles")
    rows = pairs.join(sized.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    rows = rows.join(sized.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    rows = rows.select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb")).alias("sum"))
    return rows.where(F.col("both") * den >= (F.col("sum") - F.col("both")) * num).select("a", "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """id, component (smallest id reachable) of every id in links (a, b)."""
    edges = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("c")).withColumnRenamed("a", "id"), "labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["id"]).groupBy("a").agg(F.min("c").alias("m"))
        new = labels.join(near, labels["id"] == near["a"]).select("id", F.least("c", "m").alias("c"))
        # pointer jumping: the label of one's label halves the way to the smallest id
        up = labels.select(F.col("id").alias("c"), F.col("c").alias("up"))
        new = new.join(up, "c", "left").select("id", F.least("c", "up").alias("c"))
        new = stored(new, "labels")
        moved = not new.exceptAll(labels).isEmpty()
        drop_stored(labels)
        labels = new
        if not moved:
            return labels.select("id", F.col("c").alias("component"))


def may_link(na, nb, bits_a, bits_b, num: int, den: int):
    """Whether sets of these sizes and bitmaps can reach the similarity: they may differ in (den - num) / (den + num) of
    both sizes, and differ in no fewer shingles than their bitmaps in bits."""
    differ = sum((F.bit_count(F.get(bits_a, F.lit(k)).bitwiseXOR(F.get(bits_b, F.lit(k)))) for k in range(1, PARITY // 64)), F.bit_count(F.get(bits_a, F.lit(0)).bitwiseXOR(F.get(bits_b, F.lit(0)))))
    sizes = F.least(na, nb) * den >= F.greatest(na, nb) * num
    return sizes & (differ * (den + num) <= (na + nb) * (den - num))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", num: int = NUM, den: int = DEN, side: int = SIDE, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    signed = stored(signatures(docs, id_col=id_col, text_col=text_col, side=side, rows=rows), "signatures")
    full = signed.where("doc_id is not null and n_shingles > 0")
    same = full.groupBy("f1", "f2").agg(F.min("doc_id").alias("id"), F.min("n_shingles").alias("n"), F.first("keys").alias("keys"), F.first("bits").alias("bits"))
    folded = stored(same, "folded")
    keys = table_keys(folded, side)
    shared = keys.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    members = stored(keys.join(shared, "key").select("key", "id", "m"), "members")
    # ids that repeat (rows of one id with different texts) are one node with several sets
    sketch = folded.select("id", "n", "bits")
    meets = stored(members.groupBy("id").agg(F.sum("m").alias("meets")), "meets")
    lead = members.join(meets, "id").groupBy("key").agg(F.max(F.struct("meets", (-F.col("id")).alias("minus"))).alias("l")).select("key", (-F.col("l.minus")).alias("a"))
    pairs = members.join(lead, "key").where("a <> id").select("a", F.col("id").alias("b")).distinct()
    one = lambda name, n, bits: sketch.select(F.col("id").alias(name), F.col("n").alias(n), F.col("bits").alias(bits))
    able = may_link(F.col("na"), F.col("nb"), F.col("ba"), F.col("bb"), num, den)
    pairs = pairs.join(one("a", "na", "ba"), "a").join(one("b", "nb", "bb"), "b").where(able).select("a", "b").distinct()
    pairs = stored(pairs, "pairs")
    texts = keyed(docs, id_col, text_col).select("doc_id", "text").where("doc_id is not null")

    def confirmed(found: DataFrame) -> DataFrame:
        ids = stored(found.select(F.col("a").alias("doc_id")).unionByName(found.select(F.col("b").alias("doc_id"))).distinct(), "ids")
        sets = stored(shingle_sets(texts.join(ids, "doc_id", "left_semi")), "sets")
        out = stored(confirm(found, sets, num, den), "links")
        drop_stored(sets)
        return out

    links = confirmed(pairs)
    of = components(links)
    # keys of three or more sets that the leaders leave in more than one component
    placed = members.where("m > 2").join(of, "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    apart = placed.groupBy("key").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 <> c2").select("key")
    left = placed.join(apart, "key").join(sketch, "id")
    left = stored(left, "apart")
    if not left.isEmpty():
        sides = [left.select("key", *(F.col(c).alias(n) for c, n in zip(("id", "c", "n", "bits"), names))) for names in (("a", "ca", "na", "ba"), ("b", "cb", "nb", "bb"))]
        alike = able & (F.col("ca") != F.col("cb")) & (F.col("a") < F.col("b"))
        more = sides[0].alias("x").join(sides[1].alias("y"), (F.col("x.key") == F.col("y.key")) & alike).select("a", "b").distinct()
        more = stored(more, "pairs")
        if not more.isEmpty():
            new = confirmed(more)
            if not new.isEmpty():
                of = components(links.unionByName(new))
    fold = folded.join(of, "id", "left").select("f1", "f2", F.coalesce("component", "id").alias("component"))
    rows_ = signed.drop("keys", "bits").join(fold, ["f1", "f2"], "left")
    own = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component"))
    rows_ = rows_.select("doc_id", "n_shingles", own.alias("component_id"))
    return rows_.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
