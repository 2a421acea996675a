"""Document fingerprints by order MinHash, sensitive to edit distance.

A text is the sequence of its k-mers of code points; equal ones are numbered
by their occurrence from the left, so that no two are the same.  Each of
``size`` hash functions selects the ``length`` numbered k-mers of the smallest
hashes; these keep their order in the text, and the tuple of them, without the
numbers, is hashed to one component.  Two texts agree in a component only if
they share the selected k-mers and hold them in the same order, so the share of
equal components falls with the edit distance, also where blocks only move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, materialise, text_of

#: A place past the end of a short text; no code point.
PAD = 0x110000
#: k-mers that all hash functions look at together: the table of their hashes stays in the cache.
CHUNK = 4096
#: Texts of so many bytes make one partition of ``against_next``.
PART_BYTES = 64 << 20
ODD, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * STEP
    x = (x ^ (x >> np.uint64(29))) * ODD
    return x ^ (x >> np.uint64(32))


@dataclass(frozen=True)
class OrderMinHash:
    """``size`` components, each of the ``length`` smallest of the k-mers of ``k`` code points."""
    k: int = 8
    length: int = 2
    size: int = 64
    seed: int = 11

    @cached_property
    def functions(self) -> tuple[np.ndarray, np.ndarray]:
        """The hash functions x -> a * x + b of 32-bit words, a odd: permutations."""
        rng = np.random.default_rng(self.seed)
        draw = lambda: rng.integers(0, 1 << 32, self.size, dtype=np.uint32)[:, None]
        return draw() | np.uint32(1), draw()

    def kmers(self, text: str) -> np.ndarray:
        """A 64-bit code of each k-mer; texts too short for ``length`` of them are padded."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        least = self.k + self.length - 1
        if len(points) < least:
            points = np.concatenate([points, np.full(least - len(points), PAD, np.uint64)])
        points = mixed(points + np.uint64(1))
        n = len(points) - self.k + 1
        code = points[:n].copy()
        for j in range(1, self.k):
            code *= ODD
            code += points[j:j + n]
        return mixed(code)

    @staticmethod
    def occurrences(codes: np.ndarray) -> np.ndarray:
        """How many equal codes (by their upper 40 bits) are to the left of each."""
        n, low = len(codes), np.uint64(24)
        if n <= 1 << 24:                                                     # the place fits below the code: one plain sort
            order = np.sort((codes >> low << low) | np.arange(n, dtype=np.uint64))
            place, key = (order & np.uint64((1 << 24) - 1)).astype(np.int64), order >> low
        else:
            key = codes >> low
            place = np.argsort(key, kind="stable")
            key = key[place]
        at = np.arange(n)
        first = np.maximum.accumulate(np.where(np.concatenate([[True], key[1:] != key[:-1]]), at, 0))
        out = np.empty(n, np.uint64)
        out[place] = at - first
        return out

    def signature(self, text: str) -> np.ndarray:
        """The 16-bit components of a text's fingerprint."""
        codes = self.kmers(text)
        drawn = (mixed(codes + self.occurrences(codes) * STEP) >> np.uint64(32)).astype(np.uint32)
        a, b = self.functions
        rows, best, n = np.arange(self.size), [], len(codes)
        for lo, hi in _chunks(n, max(CHUNK, 2 * self.length)):
            table = a * drawn[lo:hi]
            table += b
            for _ in range(self.length):
                at = table.argmin(axis=1)
                best.append((table[rows, at].astype(np.uint64) << np.uint64(32)) | (at + lo).astype(np.uint64))
                table[rows, at] = 0xFFFFFFFF
        best = np.sort(np.stack(best, axis=1), axis=1)[:, :self.length]
        places = np.sort(best & np.uint64(0xFFFFFFFF), axis=1).astype(np.int64)     # back in the order of the text
        out = mixed(rows.astype(np.uint64))
        for j in range(self.length):
            out = mixed(out * ODD + codes[places[:, j]])
        return (out >> np.uint64(48)).astype(np.uint16)


def _chunks(n: int, most: int) -> Iterator[tuple[int, int]]:
    """Near equal ranges of at most ``most`` places."""
    parts = -(-n // most)
    cuts = [n * i // parts for i in range(parts + 1)]
    return zip(cuts, cuts[1:], strict=False)


def as_text(signature: np.ndarray) -> str:
    """Four hexadecimal digits a component."""
    return signature.astype(">u2").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u2")


def likeness(one: str | Column, other: str | Column) -> Column:
    """The share of equal components of two fingerprints (null if one is)."""
    one, other = (F.col(c) if isinstance(c, str) else c for c in (one, other))
    n = F.length(one) / 4
    same = F.aggregate(F.sequence(F.lit(0), n.cast("int") - 1), F.lit(0), lambda total, i: total + F.when(
        one.substr(i * 4 + 1, F.lit(4)) == other.substr(i * 4 + 1, F.lit(4)), 1).otherwise(0))
    return same / n


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scheme: OrderMinHash = OrderMinHash()) -> DataFrame:
    """(id, n_chars, fingerprint) of every whole text, one row per row of ``docs``; nothing is shuffled.

    A null text counts as empty; a text shorter than k + length - 1 code points is padded with a
    mark that no text holds.  Equal texts have equal fingerprints.  Memory is bounded by a batch
    and some 60 bytes a code point of its longest text.  Other columns of ``docs`` take no part.
    """
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))

    def task(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([as_text(scheme.signature(t)) for t in texts], pa.string())], names=["id", "n_chars", "fingerprint"])
    return slim.mapInArrow(task, f"id {slim.schema['id'].dataType.simpleString()}, n_chars long, fingerprint string")


def edit(text: str, after: str) -> str:
    """``text`` with its last half (rounded down) replaced by as many code points from the start of ``after``, or all it has."""
    half = len(text) // 2
    return text[:len(text) - half] + after[:half]


FOUND = ("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _compared(scheme: OrderMinHash, text: str, own: np.ndarray, after: str, of_after: np.ndarray) -> tuple:
    edited = edit(text, after)
    other = own if edited == text else scheme.signature(edited)
    return (len(text), hashlib.sha256(edited.encode()).hexdigest(), as_text(own), as_text(other),
            float((own == other).mean()), float((own == of_after).mean()))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def against_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scheme: OrderMinHash = OrderMinHash()) -> DataFrame:
    """Each text's fingerprint, with that of its edited text and their likeness, and the likeness to the next text.

    (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row per row of
    ``docs``.  Texts are ordered by falling id, null ids last; rows of one id by a hash of their text.
    The first follows the last; a lone row follows itself.  ``edit`` says what the edited text is.  Nulls, short
    and long texts as in ``fingerprints``.  An empty table gives an empty result.

    The rows are shuffled once, by range of the id.  A task goes through its range in order and holds two texts;
    the last text of a range waits for the first of the next range: two rows a partition are matched at the end.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    part = free_name(docs, "part")
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    order = [F.col("id").desc_nulls_last(), F.xxhash64("text")]
    ranged = slim.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias(part), "id", "text")
    state = f"{part} int, at string, id {kind}, text string, {FOUND}"
    fields = pa.schema([(part, pa.int32()), ("at", pa.string()), ("id", pa.null()), ("text", pa.string()), ("n_chars", pa.int64()),
                        ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
                        ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def walk(batches):
        before, number, schema = None, None, None
        for batch in batches:
            if not len(batch):
                continue
            schema = fields.set(2, pa.field("id", batch.schema.field(1).type))
            out = []
            for number, i, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                own = scheme.signature(text)
                if before is None:
                    out.append((number, "first", None, text, None, None, as_text(own), None, None, None))
                else:
                    out.append((number, "done", before[0], None, *_compared(scheme, *before[1:], text, own)))
                before = i, text, own
            yield _batch(out, schema)
        if before is not None:
            yield _batch([(number, "last", before[0], before[1], None, None, as_text(before[2]), None, None, None)], schema)

    def close(batches):
        for batch in batches:
            if not len(batch):
                continue
            out = []
            for i, text, own, after, of_after in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                out.append((i, *_compared(scheme, text, from_text(own), after, from_text(of_after))))
            yield _batch(out, pa.schema([pa.field("id", batch.schema.field(0).type), *list(fields)[4:]]))
    walked = materialise(ranged.mapInArrow(walk, state), "walked")
    firsts = walked.filter("at = 'first'").select(F.col(part).alias("_to"), F.col("text").alias("after"), F.col("fingerprint").alias("of_after"))
    ends = Window.orderBy(part)                                               # one row per partition
    follows = walked.filter("at = 'first'").select(part, F.coalesce(F.lead(part).over(ends), F.first(part).over(
        ends.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_to"))
    lasts = walked.filter("at = 'last'").select(part, "id", "text", "fingerprint").join(follows, part).join(firsts, "_to")
    closed = lasts.select("id", "text", "fingerprint", "after", "of_after").mapInArrow(close, f"id {kind}, {FOUND}")
    return walked.filter("at = 'done'").select(*closed.columns).unionByName(closed)
