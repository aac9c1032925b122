"""SentencePiece encoding and decoding by a streaming Viterbi (operator 4).

The public model is a BPE one, whose ids are those that merging gives, not the best sum of scores; a plain unigram
Viterbi over its scores would give other ids.  The lattice here therefore admits an edge only if the two pieces that
meet at its start stay apart when their concatenation is merged (and the piece itself is what merging makes of it).  A
sequence of pieces is the BPE result exactly if all its neighbours are compatible in this sense, because the first merge
across a boundary would also happen in the pair alone.  So each position has exactly one surviving edge, the
backpointers form a tree, and the streaming rule holds as named: only the last `longest` positions can be extended; when the
paths of all of them go through one boundary, the ids before it are final and are committed, and the lattice before
it is dropped.

Texts are cut where no piece can span (before a space mark that follows another character), which are boundaries where all
paths meet; the pieces of a chunk are remembered, up to a bound, since words repeat.  Characters outside the vocabulary
become byte pieces.  `memo` bounds what a Python worker remembers, about 250 bytes a chunk.

Rows: a null text is empty and has no ids; null ids and repeated rows are kept as they are; an empty table gives
no row; texts of any length are read through the window; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

SPACE = "▁"
MEMO, MOST_HELD = 600_000, 64
_CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class PieceCodec:
    def __init__(self, model_file: str, limit: int = MEMO):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = m.get_piece_size()
        plain = [i for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
        self.ids = {m.id_to_piece(i): i for i in plain}
        self.text = {i: m.id_to_piece(i) for i in plain}
        self.score = {m.id_to_piece(i): m.get_score(i) for i in plain}
        self.bytes = {int(m.id_to_piece(i)[3:5], 16): i for i in range(n) if m.is_byte(i)}
        self.unknown = m.unk_id()
        self.longest = max(map(len, self.ids))
        self.tails = {p[i:] for p in self.ids for i in range(len(p))}  # what stands at a piece's end: a longer look back is of no use
        #: chunks are independent if no piece goes on from another character into a space mark
        self.cuts = not any(SPACE in p.lstrip(SPACE) or p.startswith(SPACE * 2) and p.strip(SPACE) for p in self.ids)
        self.limit, self.memo, self.pairs = limit, {}, {}
        self.traces = {i: t for p, i in self.ids.items() if (t := self.trace(p))[3]}
        #: the pieces that merging makes of their own text; no other one can be in a result
        self.whole = {p: i for p, i in self.ids.items() if i in self.traces}
        self.marks = {m: self.ids[m] for m in ".,;:!?" if m in self.ids}
        self.packed_marks = {m: array("I", [i]).tobytes() for m, i in self.marks.items()}
        self.surface = [b""] * n
        for i, p in self.text.items():
            self.surface[i] = p.replace(SPACE, " ").encode()
        for b, i in self.bytes.items():
            self.surface[i] = bytes([b])
        if self.unknown >= 0:
            self.surface[self.unknown] = " ⁇ ".encode()

    def trace(self, text: str) -> tuple[list[float], list[str], list[str], bool]:
        """How a text alone is merged (best score first, then leftmost): the score of each merge, the last and the first part
        before each and at the end, and whether one part is left."""
        parts, score = list(text), self.score
        scores, lasts, firsts = [], [parts[-1]], [parts[0]]
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                return scores, lasts, firsts, len(parts) == 1
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            scores.append(best)
            lasts.append(parts[-1])
            firsts.append(parts[0])

    def compatible(self, before: int, piece: int) -> bool:
        """Whether two pieces stay as they are side by side.

        Side by side each is merged as it is alone until the first merge across; that happens if at some time its score is
        above what is next on the left and not below what is next on the right."""
        key = before << 20 | piece
        known = self.pairs.get(key)
        if known is None:
            known = self._apart(self.traces[before], self.traces[piece])
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def _apart(self, left, right) -> bool:
        (ls, lasts, _, _), (rs, _, firsts, _) = left, right
        score, i, j = self.score, 0, 0
        while True:
            a, b = ls[i] if i < len(ls) else None, rs[j] if j < len(rs) else None
            across = score.get(lasts[i] + firsts[j])
            if across is not None and (a is None or across > a) and (b is None or across >= b):
                return False
            if a is None and b is None:
                return True
            if b is None or a is not None and a >= b:
                i += 1
            else:
                j += 1

    def fallback(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]

    def stream(self, texts: Iterable[str], check_every: int = 256) -> Iterator[int]:
        """Ids of the concatenation of normalised texts; holds the lattice since the last commit only.

        A position is reached by a piece that ends there and stays apart from the piece before it; at most one does.  Every
        `check_every` positions the paths of the last `longest` positions are followed back to where they meet: the ids before it
        are final, and the lattice before it is dropped."""
        ids_of, tails, pairs, compatible, longest = self.whole, self.tails, self.pairs, self.compatible, self.longest
        tail = ""  # characters since the commit
        back, via = [0], [-1]  # of each position since the commit: where its edge starts, its piece (-2: a character without one); via[0]: the piece before

        def spelled(at: int) -> list[int]:
            out: list[int] = []
            while at:
                out += [via[at]] if via[at] >= 0 else self.fallback(tail[at - 1])[::-1]
                at = back[at]
            return out[::-1]

        for text in texts:
            for k in range(0, len(text), check_every):
                tail += text[k : k + check_every]
                for j in range(len(back), len(tail) + 1):
                    edge, own = j - 1, -2
                    for i in range(j - 1, -1, -1):
                        part = tail[i:j]
                        if part not in tails:
                            break
                        piece = ids_of.get(part)
                        if piece is None:
                            continue
                        before = via[i]
                        if before >= 0:
                            ok = pairs.get(before << 20 | piece)
                            if not (compatible(before, piece) if ok is None else ok):
                                continue
                        edge, own = i, piece
                        break
                    back.append(edge)
                    via.append(own)
                if len(tail) > longest and len(tail) >= check_every:
                    alive = set(range(len(tail) - longest + 1, len(tail) + 1))
                    while len(alive) > 1:  # follow the paths back to where they meet
                        most = max(alive)
                        alive.remove(most)
                        alive.add(back[most])
                    if meet := alive.pop():
                        yield from spelled(meet)
                        tail, via = tail[meet:], via[meet:]
                        back = [0, *(b - meet for b in back[meet + 1 :])]
        yield from spelled(len(tail))

    def chunk(self, text: str) -> bytes:
        """Ids of one chunk."""
        return array("I", self.stream([text])).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian uint32 bytes."""
        memo, marks, out = self.memo, self.marks, []
        for text in texts:
            norm = self.model.normalize(text) if text else ""
            if not self.cuts:
                out.append(array("I", self.stream([norm])).tobytes())
                continue
            chunks = _CHUNK.findall(norm)
            held = list(map(memo.get, chunks))
            if None in held:
                if len(memo) > self.limit:  # the newer half stays
                    memo = self.memo = dict(islice(memo.items(), len(memo) // 2, None))
                for k, ids in enumerate(held):
                    if ids is None:
                        c = chunks[k]
                        if len(c) > MOST_HELD:  # too long to be remembered
                            held[k] = self.chunk(c)
                        elif c[-1] in marks and len(c) > 1:
                            # a closing mark is a piece of its own if it stays apart from the last piece before it
                            core = memo.get(c[:-1])
                            if core is None:
                                core = memo[c[:-1]] = self.chunk(c[:-1])
                            last, piece = int.from_bytes(core[-4:], "little"), marks[c[-1]]
                            held[k] = memo[c] = core + self.packed_marks[c[-1]] if last in self.traces and piece in self.traces and self.compatible(last, piece) else self.chunk(c)
                        else:
                            held[k] = memo.get(c) or memo.setdefault(c, self.chunk(c))
            out.append(b"".join(held))
        return out

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.surface.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_codecs: dict[tuple[str, int], PieceCodec] = {}


def codec_of(model_file: str, memo: int = MEMO) -> PieceCodec:
    """One codec a Python worker, so that what a task has learnt serves the next one."""
    if (model_file, memo) not in _codecs:
        _codecs.clear()
        _codecs[model_file, memo] = PieceCodec(model_file, memo)
    return _codecs[model_file, memo]


def encode_documents(docs: DataFrame, model_file: str, *, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, memo: int = MEMO) -> DataFrame:
    """doc_id, n_ids, ids_crc32, decoded_sha256, exact (decoding gives the text back) and, if wanted, ids."""
    small_batches(docs.sparkSession)

    def run(batches):
        codec = codec_of(model_file, memo)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids = codec.encode(texts)
            decoded = [codec.decode(i) for i in ids]
            out = {
                "doc_id": batch.column(0), "n_ids": pa.array([len(i) // 4 for i in ids], pa.int64()), "ids_crc32": pa.array([zlib.crc32(i) for i in ids], pa.int64()),
                "decoded_sha256": pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string()), "exact": pa.array([d == (t or "") for d, t in zip(decoded, texts)], pa.bool_()),
            }
            if keep_ids:
                out["ids"] = pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i in ids], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(out)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, exact boolean" + ", ids array<int>" * keep_ids)


def decode_documents(encoded: DataFrame, model_file: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text from ids (array<int>)."""
    small_batches(encoded.sparkSession)

    def run(batches):
        codec = codec_of(model_file)
        for batch in batches:
            texts = [None if x is None else codec.decode(np.array(x, "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text": pa.array(texts, pa.string())})

    return encoded.select(F.col(id_col).cast("long"), F.col(ids_col).cast("array<int>")).mapInArrow(run, "doc_id long, text string")
