"""Cost-balanced packing of tokenised documents into sequences of bounded length.

A document longer than a sequence is cut into full sequences; what is left
(and every shorter document) is a tail.  Tails are packed window by window:
with as many sequences as the window's tokens need, tails in descending length
go to the sequence of lowest estimated attention cost that still has room.
The cost of a tail of n tokens is linear*n + quadratic*n*n (attention stays
within a document).  A tail that fits nowhere is cut into the largest rooms, so
a window wastes less than one sequence.  A window never leaves its task, so
nothing is shuffled, and memory is bounded by the window.
"""

from __future__ import annotations

import heapq
import sys
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

SEQUENCE = 1024
PIECES = ("doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "ids binary")


class Ids:
    """Token ids of whole texts, as little-endian uint32 bytes, by a tokenizer file of byte-level BPE.

    Texts go through a second encoder of the same vocabulary, several times as
    fast; those with a very long stretch without a space, where its time grows
    with the square, and those that hold the string of an added token go through
    the file's own tokenizer, as it is loaded.  Both give the ids of that tokenizer.
    """

    STRETCH = 1000

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.added = {t.content for t in self.own.get_added_tokens_decoder().values()}
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]     # bytes that stand for themselves
        moved = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in self.own.get_vocab().items() if t not in self.added}
        # a run of letters, of digits or of other signs, each with one space before it; else white space
        words = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("same", pat_str=words, mergeable_ranks=ranks, special_tokens={})

    def of(self, text: str) -> bytes:
        if any(t in text for t in self.added) or max(map(len, text.split()), default=0) > self.STRETCH:
            ids = self.own.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return array("I", ids).tobytes() if sys.byteorder == "little" else b"".join(i.to_bytes(4, "little") for i in ids)


_TOKENIZERS: dict[str, Ids] = {}                            # one per Python worker


def tokens_of(path: str) -> Ids:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Ids(path)
    return _TOKENIZERS[path]


def balanced(lengths: list[int], room: int, linear: float, quadratic: float) -> list[list[tuple[int, int, int]]]:
    """Sequences of (tail, start, length).  Every token of every tail lies in exactly one."""
    count = -(-sum(lengths) // room)
    free, sequences = [room] * count, [[] for _ in range(count)]
    cost = [(0.0, s) for s in range(count)]                # a heap; sequences without room leave it
    for tail in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need, aside = lengths[tail], []
        weight = linear * need + quadratic * need * need
        while cost and free[cost[0][1]] < need:
            aside.append(heapq.heappop(cost))
        if cost:
            c, s = heapq.heappop(cost)
            sequences[s].append((tail, 0, need))
            free[s] -= need
            if free[s]:
                heapq.heappush(cost, (c + weight, s))
        else:                                               # no room for all of it: cut it into the largest rooms
            start = 0
            aside.sort(key=lambda x: (free[x[1]], -x[1]))
            while start < need:
                c, s = aside.pop()
                part = min(free[s], need - start)
                sequences[s].append((tail, start, part))
                free[s] -= part
                start += part
                if free[s]:
                    aside.append((c + linear * part + quadratic * part * part, s))
        for x in aside:
            heapq.heappush(cost, x)
    return sequences


def packer(path: str, end_id: int, room: int, window: int, linear: float, quadratic: float, with_ids: bool,
           id_type: pa.DataType):
    end = end_id.to_bytes(4, "little")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens, sequence = tokens_of(path), TaskContext.get().partitionId() << 33
        out: list[tuple] = []
        waiting: list[tuple] = []                           # (doc_id, start, ids, doc_tokens)

        def piece(doc, start, ids, whole, seq, offset):
            out.append((doc, start, len(ids) // 4, zlib.crc32(ids), whole, seq, offset, ids if with_ids else None))

        def pack():
            nonlocal sequence
            for members in balanced([len(w[2]) // 4 for w in waiting], room, linear, quadratic):
                offset = 0
                for tail, start, n in members:
                    doc, at, ids, whole = waiting[tail]
                    piece(doc, at + start, ids[4 * start:4 * (start + n)], whole, sequence, offset)
                    offset += n
                sequence += 1
            waiting.clear()

        def ready():
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], id_type), *[pa.array(c, pa.int64()) for c in columns[1:7]],
                 pa.array(columns[7], pa.binary())],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc, text in zip(docs, texts, strict=True):
                ids = tokens.of(text) + end
                whole = len(ids) // 4
                full = whole // room * room
                for start in range(0, full, room):
                    piece(doc, start, ids[4 * start:4 * (start + room)], whole, sequence, 0)
                    sequence += 1
                if full < whole:
                    waiting.append((doc, full, ids[4 * full:], whole))
                if len(waiting) >= window:
                    pack()
                if len(out) >= 2048:
                    yield ready()
        pack()
        if out:
            yield ready()
    return pieces


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0,
         room: int = SEQUENCE, window: int = 2048, linear: float = 1.0, quadratic: float = 1.0 / 1024,
         with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    ``tokenizer``: file of a byte-level BPE, the same on all executors.  A null
    or empty text is its end id alone.  Ids of documents may be null or
    repeat: each row is packed for itself.  ``window`` tails are packed
    together; a partition's last window wastes less than one sequence too.
    """
    id_type = docs.schema[id_col].dataType
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))
    from pyspark.sql.pandas.types import to_arrow_type
    return slim.mapInArrow(packer(tokenizer, end_id, room, window, linear, quadratic, with_ids, to_arrow_type(id_type)),
                           PIECES.format(id=id_type.simpleString()))


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, tokens, ids): the ids of each sequence in order, unpadded, as little-endian uint32."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))     # at most ``room`` pieces
    return pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("tokens"),
        F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
