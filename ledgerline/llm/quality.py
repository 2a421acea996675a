"""Quality by importance resampling over hashed byte n-grams.

Two generative models are counts of hashed n-grams: the target model over
labelled good documents (a bounded sample), the raw model over all documents.
A document's log weight is the logarithm of the ratio of the probabilities that the
two give it: the sum over its n-grams of the log ratios.  Adding Gumbel noise and taking the k
largest keys draws k documents without replacement, each in proportion to its
weight.  k is the number of documents whose log weight reaches a cut that
separates good from bad best on labelled documents that the target model has not seen.

``Shaping`` is an option for small corpora, in which groups of copies shift the counts of
either model: it sets small log ratios to 0 and divides the sum by the square root
of the n-grams.  Shaped draws are no longer in proportion to the ratio of the models.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, free_name, materialise, summed_vectors, text_of

GRAM = 5
BUCKETS = 1 << 17
SMOOTHING = 0.5
#: At most so many labelled rows fit the target model and the cut.
MOST_LABELLED = 20_000
CHUNK = 4 << 20


@dataclass(frozen=True)
class Shaping:
    """Log ratios within ``dead_zone`` of 0 count as 0; sums are divided by the square root of the n-grams and multiplied by ``sharpness``."""
    dead_zone: float = 0.3
    sharpness: float = 8.0


def grams(texts: list[bytes], n: int = GRAM, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text number) of every n-gram of bytes within a text."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = np.zeros(len(data) - n + 1, np.uint64)
    for i in range(n):
        key = (key << np.uint64(8)) | data[i:len(data) - n + 1 + i]
    bucket = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - int(math.log2(buckets)))).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    inside = owner[:len(key)] == owner[n - 1:]
    return bucket[inside], owner[:len(key)][inside]


def chunks(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """(text numbers, pieces) of about CHUNK bytes together.  A longer text is cut into pieces
    that overlap so far that each n-gram lies in exactly one, so memory does not follow the longest text."""
    owners: list[int] = []
    parts: list[bytes] = []
    size = 0
    for i, t in enumerate(texts):
        for at in range(0, max(len(t) - GRAM + 1, 1), CHUNK):
            part = t[at:at + CHUNK + GRAM - 1]
            if size and size + len(part) > CHUNK:
                yield owners, parts
                owners, parts, size = [], [], 0
            owners.append(i)
            parts.append(part)
            size += len(part)
    if parts:
        yield owners, parts


def as_bytes(column) -> list[bytes]:
    return [(x or "").encode() for x in column.to_pylist()]


def gram_counts(texts: DataFrame) -> np.ndarray:
    """Counts of all n-grams of ``texts`` (text), by bucket."""

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, parts in chunks(as_bytes(batch.column(0))):
                total += np.bincount(grams(parts)[0], minlength=BUCKETS)
        return total
    return summed_vectors(texts, count, BUCKETS)


def log_ratio(target: np.ndarray, raw: np.ndarray, shaping: Shaping | None = None) -> np.ndarray:
    def model(counts):
        return np.log((counts + SMOOTHING) / (counts.sum() + SMOOTHING * len(counts)))
    ratio = model(target) - model(raw)
    return ratio if shaping is None else np.sign(ratio) * np.maximum(np.abs(ratio) - shaping.dead_zone, 0)


def log_weights(texts: list[bytes], ratio: np.ndarray, shaping: Shaping | None = None) -> np.ndarray:
    """The sum of the log ratios of each text's n-grams; a text without any has 0."""
    sums, n = np.zeros(len(texts)), np.zeros(len(texts))
    for owners, parts in chunks(texts):
        bucket, owner = grams(parts)
        text = np.array(owners)[owner]
        sums += np.bincount(text, weights=ratio[bucket], minlength=len(texts))
        n += np.bincount(text, minlength=len(texts))
    return sums if shaping is None else shaping.sharpness * sums / np.sqrt(np.maximum(n, 1))


def gumbel(ids: list, texts: list[bytes], seed: int) -> np.ndarray:
    """Standard Gumbel noise by a hash of seed, id and text."""
    h = [zlib.crc32(t, zlib.crc32(f"{seed}|{i}".encode())) << 32 | zlib.crc32(f"{i}|{seed}".encode(), zlib.crc32(t[:64]))
         for i, t in zip(ids, texts, strict=True)]
    h = np.array(h, np.uint64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    u = ((h >> np.uint64(12)).astype(float) + 0.5) / float(1 << 52)
    return -np.log(-np.log(u))


def best_cut(weights: np.ndarray, good: np.ndarray) -> float:
    """The log weight from which documents count as good, with the fewest errors; -inf where one kind is absent."""
    if good.all() or not good.any():
        return -math.inf
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    errors = np.concatenate([[0], np.cumsum(g)]) + np.concatenate([np.cumsum(~g[::-1])[::-1], [0]])
    errors[1:-1][w[1:] == w[:-1]] = len(w) + 1              # equal weights are on one side
    i = int(np.argmin(errors))
    return -math.inf if i == 0 else math.inf if i == len(w) else float((w[i - 1] + w[i]) / 2)


def kth_largest(scores: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """The k-th largest value, exactly: counts by bin narrow the range until one bin holds few values."""
    rows = scores.select(F.col(column).alias("v"))
    low, high = rows.agg(F.min("v"), F.max("v")).first()
    above = 0
    while True:
        inside = rows.filter((F.col("v") >= low) & (F.col("v") <= high))
        width = (high - low) / bins
        if not width > 0:
            return high
        place = F.least(F.floor((F.col("v") - low) / width), F.lit(bins - 1))
        counts = {r["b"]: r for r in inside.groupBy(place.alias("b")).agg(
            F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}     # at most ``bins`` rows
        for b in sorted(counts, reverse=True):
            if above + counts[b]["n"] >= k:
                break
            above += counts[b]["n"]
        low, high = counts[b]["lo"], counts[b]["hi"]


class Sampler:
    """A fitted model: ``ratio`` and the smallest key that is kept."""

    def __init__(self, ratio: np.ndarray, least: float, seed: int, shaping: Shaping | None = None):
        self.ratio, self.least, self.seed, self.shaping = ratio, least, seed, shaping

    def keys(self, ids: list, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        weights = log_weights(texts, self.ratio, self.shaping)
        return weights, weights + gumbel(ids, texts, self.seed)


def scored(docs: DataFrame, sampler: Sampler, id_col: str, text_col: str) -> DataFrame:
    """(id, log_weight, key): one row per document."""
    shared = docs.sparkSession.sparkContext.broadcast(sampler)      # BUCKETS numbers
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()

    def score(batches):
        for batch in batches:
            weights, keys = shared.value.keys(batch.column(0).to_pylist(), as_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weights), pa.array(keys)], names=["id", "log_weight", "key"])
    return slim.mapInArrow(score, f"id {kind}, log_weight double, key double")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        most_labelled: int = MOST_LABELLED, keep: int | None = None, seed: int = 7,
        shaping: Shaping | None = None) -> Sampler:
    """Fit both models, the cut, and the key of the last document that is kept.

    ``labels``: (id, label 1 good or 0 bad); rows with null are no labels, and
    an id with both counts as bad.  ``most_labelled`` rows with the smallest
    hashes are used, half of them for the target model, half for the cut.
    ``keep``: the number of documents to draw instead of the cut's.  ``shaping``: see ``Shaping``.  Without good
    labels every weight is 0 and all documents stay.
    """
    spark = docs.sparkSession
    known = (labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).alias("known_id")).agg(F.min(label_col).cast("int").alias("good"))
             .withColumn("pick", F.xxhash64(F.lit(seed), "known_id")).orderBy("pick", "known_id").limit(most_labelled))
    known = materialise(known, "labels")
    text = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))
    # the labelled sample is bounded by ``most_labelled`` rows of three numbers
    sample = text.join(F.broadcast(known), F.col("id") == F.col("known_id"))
    half = F.pmod(F.shiftright("pick", 7), F.lit(2))
    target = gram_counts(sample.filter((F.col("good") == 1) & (half == 0)).select("text"))
    if not target.sum():
        return Sampler(np.zeros(BUCKETS), -math.inf, seed, shaping)
    ratio = log_ratio(target, gram_counts(text.select("text")), shaping)
    sampler = Sampler(ratio, -math.inf, seed, shaping)
    scores = materialise(scored(docs, sampler, id_col, text_col), "scores")
    if keep is None:
        held = scores.join(F.broadcast(known), F.col("id") == F.col("known_id")).filter(half == 1)
        # rows that repeat an id count once, with the least weight
        rows = held.groupBy("id").agg(F.min("log_weight").alias("log_weight"), F.min("good").alias("good")).select("log_weight", "good").collect()           # at most ``most_labelled`` rows
        cut = best_cut(np.array([r[0] for r in rows]), np.array([r[1] == 1 for r in rows], bool)) if rows else -math.inf
        keep = scores.filter(F.col("log_weight") >= cut).count()
    if keep <= 0:
        sampler.least = math.inf
    elif keep < scores.count():
        sampler.least = kth_largest(scores, "key", keep)
    discard(scores, known)
    return sampler


def sample(docs: DataFrame, sampler: Sampler, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The drawn rows of ``docs``, all their columns as they were.

    Keys are recomputed in the tasks that read the rows, so no text is
    shuffled.  Rows with the last kept key are all kept; texts without an
    n-gram (null, empty, short) have log weight 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(sampler)
    ids, texts = free_name(docs, "sample_id"), free_name(docs, "sample_text")
    n = len(docs.columns)

    def kept(batches):
        for batch in batches:
            keys = shared.value.keys(batch.column(n).to_pylist(), as_bytes(batch.column(n + 1)))[1]
            yield batch.select(list(range(n))).filter(pa.array(keys >= shared.value.least))
    return docs.select("*", F.col(f"`{id_col}`").alias(ids), text_of(text_col).alias(texts)).mapInArrow(kept, docs.schema)
