"""Token-id output: bit-plane shuffled, zstandard-compressed id files with a chunk index (operator 7).

File image (little-endian), one per row of the container table:

    magic b"TLBP1\\0\\0\\0" | u64 n_ids | u32 block | u32 n_chunks
    chunk index: per chunk u64 offset of its first plane, u32 n_ids, u32 n_planes, then u32 compressed size of each plane
    planes of all chunks, one zstandard frame each

A chunk is a block of `block` ids.  Its ids are transposed into bit planes (plane k holds bit k of
every id, eight ids a byte), high planes that are zero throughout are not stored, and each other
plane is compressed alone.  Low planes are close to noise, high planes compress very well, and a
reader can fetch one chunk from the index without touching the others.

Documents are range-partitioned by (doc_id, hash of the text), so each task writes one contiguous run of
ids.  An image closes at the first document end after `image_ids` ids; it is one row of a Parquet
container table in the shared folder, so Spark's commit protocol decides which attempt of a task
counts and any Hadoop file system will do.  `export_images` writes the images as plain files.

Rows: a null text is empty; a null doc_id sorts first; rows that repeat a doc_id follow each other by
the hash of their text and each counts; an empty table gives no row; columns other than id and text are not read.
"""

from __future__ import annotations

import gc
import os
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taskloom.sources.tables import bounded

from .common import keyed, small_batches, stored, tasks_for, texts_of

MAGIC = b"TLBP1\0\0\0"
BLOCK = 1 << 16
IMAGE_IDS = 1 << 20
#: Bytes that a Python worker's memo of words may take, and about what an entry takes beside its two strings.
MEMO_BYTES, ENTRY_BYTES = 176 << 20, 170
#: Bytes of text whose words are looked up at a time.
STEP_BYTES = 1 << 20


def to_planes(ids: np.ndarray) -> list[bytes]:
    """Bit planes of uint32 ids, lowest first, up to the highest bit in use."""
    n = int(ids.max(initial=0)).bit_length()
    return [np.packbits(((ids >> np.uint32(k)) & np.uint32(1)).astype(np.uint8)).tobytes() for k in range(n)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    ids = np.zeros(n, np.uint32)
    for k, plane in enumerate(planes):
        ids |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n).astype(np.uint32) << np.uint32(k)
    return ids


def encode_image(ids: np.ndarray, block: int = BLOCK, level: int = 3) -> bytes:
    """The file image of a run of ids."""
    press = zstandard.ZstdCompressor(level=level)
    chunks = [ids[i : i + block] for i in range(0, len(ids), block)]
    packed = [[press.compress(p) for p in to_planes(c)] for c in chunks]
    size = struct.calcsize("<QII") + len(MAGIC) + sum(16 + 4 * len(p) for p in packed)
    index, at = b"", size
    for c, planes in zip(chunks, packed):
        index += struct.pack(f"<QII{len(planes)}I", at, len(c), len(planes), *map(len, planes))
        at += sum(map(len, planes))
    return MAGIC + struct.pack("<QII", len(ids), block, len(chunks)) + index + b"".join(b"".join(p) for p in packed)


def chunk_index(image: bytes) -> list[tuple[int, int, tuple[int, ...]]]:
    """(offset, ids, plane sizes) of each chunk."""
    if image[:8] != MAGIC:
        raise ValueError("not a bit-plane id file")
    _, _, n = struct.unpack_from("<QII", image, 8)
    at, out = 24, []
    for _ in range(n):
        offset, ids, planes = struct.unpack_from("<QII", image, at)
        out.append((offset, ids, struct.unpack_from(f"<{planes}I", image, at + 16)))
        at += 16 + 4 * planes
    return out


def decode_chunk(image: bytes, chunk: tuple[int, int, tuple[int, ...]]) -> np.ndarray:
    at, n, sizes = chunk
    press, planes = zstandard.ZstdDecompressor(), []
    for s in sizes:
        planes.append(press.decompress(image[at : at + s]))
        at += s
    return from_planes(planes, n)


def decode_image(image: bytes) -> np.ndarray:
    parts = [decode_chunk(image, c) for c in chunk_index(image)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


class WordEncoder:
    """Ids of a text as uint32 bytes.  The tokenizer drops white space before it looks at anything, so a text's
    ids are its words' ids in turn; each word goes through the library once and is then remembered.  The memo takes `limit`
    bytes at most, in two generations: when the young one has half of them it becomes the old one, and words that are met
    again move from the old one to the new young one, so frequent words stay.

    A word that is letters and one closing mark is looked up by its letters: the tokenizer parts letters from marks, and
    lower-cases, before it merges."""

    def __init__(self, path: str, limit: int = MEMO_BYTES):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.memo: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.held = 0  # about the bytes of the young generation's words and ids
        self.marks = {ord(m): i for m, i in zip(".,;:!?", self._whole(list(".,;:!?")))}
        # the same merges without the steps that leave lower-cased letters as they are
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.parted = self.letters.encode("0", add_special_tokens=False).ids

    def _whole(self, texts: list[str]) -> list[bytes]:
        """Ids of any texts."""
        out = []
        for i in range(0, len(texts), 10_000):
            out += [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(texts[i : i + 10_000], add_special_tokens=False)]
        return out

    def _letters(self, cores: list[bytes]) -> list[bytes]:
        """Ids of lower-cased words of letters alone: many in one text, parted by a digit, whose one id no letter has."""
        out: list[bytes] = []
        for i in range(0, len(cores), 2_000):
            part = cores[i : i + 2_000]
            data = np.array(self.letters.encode_batch_fast([b" 0 ".join(part).decode()], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(data == self.parted[0])
            if len(self.parted) != 1 or len(cuts) != len(part) - 1:
                out += self._whole([c.decode() for c in part])
                continue
            flat = data.tobytes()
            starts, ends = [0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), len(flat)]
            out += [flat[x:y] for x, y in zip(starts, ends)]
        return out

    def _learn(self, words: set[bytes]) -> None:
        memo, old, marks = self.memo, self.old, self.marks
        new = list(words)
        if old:
            known = list(map(old.get, new))
            memo.update((w, ids) for w, ids in zip(new, known) if ids is not None)
            new = [w for w, ids in zip(new, known) if ids is None]
        letters: list[tuple[bytes, bytes, int]] = []
        others: list[bytes] = []
        for w in new:
            mark = w[-1]
            core = w[:-1] if mark in marks else w
            if core.isalpha():  # ASCII, lower-cased before
                letters.append((w, core, mark))
            elif (text := core.decode()).isalpha() and max(text) < "\u0130":  # there lower() agrees with the tokenizer's own, letter by letter
                letters.append((w, text.lower().encode(), mark))
            else:
                others.append(w)
        cores = list({c for _, c, _ in letters} - memo.keys())
        of_cores, of_others = self._letters(cores), self._whole([w.decode() for w in others])
        memo.update(zip(cores, of_cores))
        memo.update(zip(others, of_others))
        for w, core, mark in letters:
            memo[w] = memo[core] + marks[mark] if mark in marks else memo[core]
        self.held += sum(map(len, words)) + sum(map(len, cores)) + 2 * sum(map(len, of_cores)) + sum(map(len, of_others))

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        # the lists made here hold no circles; looking for some takes a tenth of the time
        collecting = gc.isenabled()
        gc.disable()
        try:
            out, first, size = [], 0, 0
            for i, t in enumerate(texts, 1):
                size += len(t or b"")
                if size >= STEP_BYTES or i == len(texts):
                    out += self._encode(texts[first:i])
                    first, size = i, 0
            return out
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: list[bytes | None]) -> list[bytes]:
        if 2 * (self.held + ENTRY_BYTES * len(self.memo)) > self.limit:
            self.old, self.memo, self.held = self.memo, {}, 0
        get = self.memo.get
        # the tokenizer lower-cases everything but the names of its special tokens
        words = [[w if b"<|" in w else w.lower() for w in t.split()] if b"<|" in t else t.lower().split() if t else [] for t in ((x or b"") for x in texts)]
        ids = [list(map(get, ws)) for ws in words]
        gaps = [[i for i, x in enumerate(row) if x is None] if None in row else () for row in ids]
        self._learn({ws[i] for ws, row in zip(words, gaps) for i in row})
        for ws, row, where in zip(words, ids, gaps):
            for i in where:
                row[i] = get(ws[i])
        return [b"".join(row) for row in ids]


_encoders: dict[tuple[str, int], WordEncoder] = {}


def encoder_of(path: str, limit: int = MEMO_BYTES) -> WordEncoder:
    """One encoder a Python worker, so that what a task has learnt serves the next one."""
    if (path, limit) not in _encoders:
        _encoders.clear()
        _encoders[path, limit] = WordEncoder(path, limit)
    return _encoders[path, limit]


def write_ids(docs: DataFrame, tokenizer_path: str, *, end_id: int, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None, block: int = BLOCK, image_ids: int = IMAGE_IDS) -> DataFrame:
    """Encodes all texts and writes their ids, in ascending id order; returns the container table:
    part, seq, n_ids, doc_ids, doc_lengths, image."""
    spark = docs.sparkSession
    small_batches(spark)
    n = partitions or tasks_for(docs)
    rows = keyed(docs, id_col, text_col).repartitionByRange(n, "doc_id", "th").sortWithinPartitions("doc_id", "th")
    rows = rows.select("doc_id", "text", F.spark_partition_id().alias("part"))
    schema = "part int, seq int, n_ids long, doc_ids array<long>, doc_lengths array<long>, image binary"
    end = struct.pack("<I", end_id)

    def run(batches):
        encoder, seq, held, ids, lengths, part = encoder_of(tokenizer_path), 0, bytearray(), array("q"), array("q"), 0
        named = array("b")  # 0 where the id is null

        def image():
            flat = np.frombuffer(held, "<u4")
            of = pa.array(np.frombuffer(ids, "<i8"), mask=np.frombuffer(named, np.int8) == 0)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_ids": pa.array([len(flat)], pa.int64()), "doc_ids": pa.ListArray.from_arrays([0, len(ids)], of), "doc_lengths": pa.ListArray.from_arrays([0, len(ids)], pa.array(np.frombuffer(lengths, "<i8"))), "image": pa.array([encode_image(flat, block)], pa.binary())})

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(2)[0].as_py()
            for d, e in zip(batch.column(0).to_pylist(), encoder.encode(texts_of(batch.column(1)))):
                held += e
                held += end
                ids.append(d or 0)
                named.append(d is not None)
                lengths.append(len(e) // 4 + 1)
                if len(held) >= 4 * image_ids:
                    yield image()
                    seq, held, ids, lengths, named = seq + 1, bytearray(), array("q"), array("q"), array("b")
        if ids:
            yield image()

    return stored(rows.mapInArrow(run, schema), "token-ids")


def read_ids(container: DataFrame, detail=None, fields: str = "ids_crc32 long") -> DataFrame:
    """Per document from the images: doc_id, start, n_tokens and what `detail` makes of its ids as
    little-endian uint32 bytes (default: their unsigned crc32)."""
    detail = detail or zlib.crc32
    # one row a part: the running sum is over as many rows as there were range partitions.  Stored, so that its size is known
    # and the images are not shuffled to meet a number: the offsets go to them, unless they are too many to be broadcast
    parts = container.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inner = Window.partitionBy("part").orderBy("seq")
    offsets = container.select("part", "seq", (F.sum("n_ids").over(inner) - F.col("n_ids")).alias("within")).join(parts, "part").select("part", "seq", (F.col("before") + F.col("within")).alias("first"))
    name, kind = fields.split()

    def run(batches):
        for batch in batches:
            for first, ids, lengths, image in zip(*(batch.column(i).to_pylist() for i in range(4))):
                data = decode_image(image).astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                starts = ends - lengths
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "start": pa.array(first + starts, pa.int64()), "n_tokens": pa.array(lengths, pa.int64()), name: pa.array([detail(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())], {"long": pa.int64(), "binary": pa.binary()}[kind])})

    rows = container.join(bounded(stored(offsets, "token-offsets")), ["part", "seq"]).select("first", "doc_ids", "doc_lengths", "image")
    return rows.mapInArrow(run, f"doc_id long, start long, n_tokens long, {fields}")


def export_images(container: DataFrame, folder: str) -> DataFrame:
    """Writes each image as <folder>/<part>-<seq>.tlbp; the folder must be mounted alike on all executors. Each
    file is written under a passing name and renamed, so a repeated task leaves the same files."""

    def run(batches):
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for part, seq, image in zip(*(batch.column(i).to_pylist() for i in range(3))):
                path = f"{folder}/{part:05d}-{seq:05d}.tlbp"
                with open(f"{path}.{os.getpid()}", "wb") as f:
                    f.write(image)
                os.replace(f"{path}.{os.getpid()}", path)
                yield pa.RecordBatch.from_pydict({"path": [path], "bytes": pa.array([len(image)], pa.int64())})

    return container.select("part", "seq", "image").mapInArrow(run, "path string, bytes long")
