"""Hard negatives by rotated one-bit codes with the alignment of code and vector.

Vectors are integers.  A block of them keeps its mean c; each vector v = c + r o
(o a unit vector) keeps its length r, the signs of the rotated o as bits, and the
alignment a = <o, s> of o with s, the unit vector of its signs.  Then o = a s + e
with e orthogonal to s and of length sqrt(1 - a^2), and for each anchor q

    <v, q> = <c, q> + r (a <s, q> + <e, q>),   |<e, q>| <= sqrt(1 - a^2) sqrt(|q|^2 - <s, q>^2)

by Cauchy and Schwarz: an interval that holds the score for certain.  The rest e has
a one-bit code with its alignment in turn, ``CODES`` in all, and only the last rest is
bounded.  <s, q> comes from popcounts of the code with bit planes of the rotated,
rounded anchor, whose rounding widens the interval by its known sum.  Only candidates
whose interval reaches what is asked for are scored, in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ann import rotation
from .common import discard, materialise

#: Rows of a block of vectors, of a block of anchors; bits of a rounded anchor's component; codes of a vector.
BLOCK, ANCHORS, BITS, CODES = 8192, 256, 6, 4
#: What floating point may add to an interval, as a share of the product of the lengths.
SLACK = 1e-9


def largest_component(dimensions: int) -> int:
    """Components stay within this size, so that a score fits a long and a component an int."""
    return min(int((2 ** 62 / dimensions) ** 0.5), 2 ** 31 - 1)


def integer_vectors(table: DataFrame, id_col: str, label_col: str, vector_col: str, scale: float) -> tuple[DataFrame, int]:
    """(vec_id, label, vector of longs) of the rows that take part, and their dimensions (the commonest length)."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("long").alias("label"),
                        v.alias("vector")).filter(
        "vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0 "
        "AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
    first = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = first["d"] if first else 0
    most = F.lit(float(largest_component(max(d, 1))))
    whole = F.transform("vector", lambda x: F.floor(F.least(F.greatest(x * F.lit(float(scale)), -most), most)))
    return rows.filter(F.size("vector") == d).select("vec_id", "label", whole.alias("vector")), d


def packed_signs(rotated: np.ndarray) -> np.ndarray:
    """The signs as bits, in 64-bit words, a row a vector."""
    bits = np.packbits(rotated >= 0, axis=1, bitorder="little")
    words = np.zeros((len(rotated), -(-rotated.shape[1] // 64) * 8), np.uint8)
    words[:, :bits.shape[1]] = bits
    return words.view(np.uint64)


class Codes:
    """The codes of a block: what estimates and bounds its scores."""

    def __init__(self, vectors: np.ndarray, turn: np.ndarray):
        d = vectors.shape[1]
        self.centre = vectors.mean(axis=0)
        rest = (vectors - self.centre) @ turn
        self.size = np.sqrt((rest * rest).sum(axis=1))
        self.levels = []                                                       # (bits, their number, r a) of each code
        for _ in range(CODES):
            words = packed_signs(rest)
            along = np.abs(rest).sum(axis=1) / np.sqrt(d)                      # length of the rest times its alignment
            self.levels.append((words, np.bitwise_count(words).sum(axis=1, dtype=np.int64), along))
            rest = rest - np.where(rest >= 0, 1, -1) * (along / np.sqrt(d))[:, None]
        self.left = np.sqrt((rest * rest).sum(axis=1))                         # length of the last rest


def bounds(codes: Codes, lo: int, hi: int, anchor: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score of ``anchor`` with each row lo..hi of the block."""
    d = len(anchor)
    q = anchor @ turn
    least = q.min()
    step = (q.max() - least) / ((1 << BITS) - 1) or 1.0
    level = np.rint((q - least) / step)
    unsure = np.abs(q - (least + step * level)).sum() / np.sqrt(d)             # of <s, q> by the rounding, at most
    level = level.astype(np.int64)
    planes = [packed_signs(np.where(level >> bit & 1, 1, -1)[None, :])[0] for bit in range(BITS)]
    size = np.sqrt((anchor * anchor).sum())
    middle, reach = np.full(hi - lo, codes.centre @ anchor), np.zeros(hi - lo)
    for words, ones, weight in codes.levels:
        total = np.zeros(hi - lo, np.int64)
        for bit, plane in enumerate(planes):
            total += np.bitwise_count(words[lo:hi] & plane).sum(axis=1, dtype=np.int64) << bit
        along = (least * (2 * ones[lo:hi] - d) + step * (2 * total - level.sum())) / np.sqrt(d)       # <s, q>, up to ``unsure``
        middle += weight[lo:hi] * along
        reach += weight[lo:hi] * unsure
    reach += codes.left[lo:hi] * np.sqrt(np.maximum(size ** 2 - np.maximum(np.abs(along) - unsure, 0) ** 2, 0))
    reach += SLACK * size * (codes.size[lo:hi] + np.sqrt((codes.centre ** 2).sum())) + 1
    return middle - reach, middle + reach


def kth_largest(values: np.ndarray, k: int) -> float:
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


class Block:
    """Rows of a block in the order of (label, vec_id), read back from its binary columns."""

    def __init__(self, ids: bytes, labels: bytes, vectors: bytes, dimensions: int):
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.vectors = np.frombuffer(vectors, np.int32).reshape(-1, dimensions)

    def slices(self, label: int, same: bool) -> Iterator[tuple[int, int]]:
        lo, hi = np.searchsorted(self.labels, label), np.searchsorted(self.labels, label, side="right")
        for a, b in ([(lo, hi)] if same else [(0, lo), (hi, len(self.ids))]):
            if a < b:
                yield int(a), int(b)

    def scores(self, places: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        return self.vectors[places].astype(np.int64) @ anchor


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def nearest_same(block: Block, codes: Codes, turn, anchor_id: int, label: int, anchor: np.ndarray, k: int):
    """(ids, scores) of the k best rows of the anchor's label in the block."""
    for lo, hi in block.slices(label, True):
        low, high = bounds(codes, lo, hi, anchor.astype(np.float64), turn)
        low[block.ids[lo:hi] == anchor_id], high[block.ids[lo:hi] == anchor_id] = -np.inf, -np.inf
        first = np.argpartition(-low, k - 1)[:k] if hi - lo > k else np.arange(hi - lo)
        first = lo + first[np.isfinite(low[first])]                            # scored first: their least score is a bar for all
        bar = block.scores(first, anchor).min() if len(first) == k else -np.inf
        places = lo + np.nonzero((high >= bar) & np.isfinite(high))[0]
        scores = block.scores(places, anchor)
        top = best(block.ids[places], scores, k)
        yield block.ids[places][top], scores[top]


def inside(block: Block, codes: Codes, turn, anchor_id: int, label: int, anchor: np.ndarray, windows: list[tuple[int, int, int]], k: int):
    """(place, ids, scores): for each window (place, least, most) the k best rows of other labels whose score lies in it."""
    found = []
    for lo, hi in block.slices(label, False):
        low, high = bounds(codes, lo, hi, anchor.astype(np.float64), turn)
        other = block.ids[lo:hi] != anchor_id
        wanted = np.zeros(hi - lo, bool)
        for _, least, most in windows:
            sure = low[(low >= least) & (high <= most) & other]                # these lie in the window whatever their score
            wanted |= (high >= max(least, kth_largest(sure, k))) & (low <= most)
        found.append(lo + np.nonzero(wanted & other)[0])
    places = np.concatenate(found) if found else np.zeros(0, np.int64)
    scores = block.scores(places, anchor)
    for place, least, most in windows:
        fit = np.nonzero((scores >= least) & (scores <= most))[0]
        top = fit[best(block.ids[places[fit]], scores[fit], k)]
        if len(top):
            yield place, block.ids[places[top]], scores[top]


def blocks_of(rows: DataFrame, count: int, most: int, extra: str | None = None) -> DataFrame:
    """Rows dealt evenly to blocks of about ``most``: (block, ids, labels, vectors), sorted by (label, vec_id) within.

    Dealing goes by turn, not by a key, so no label or id makes a block larger.  ``extra``: a column of
    arrays of longs of one length that goes along.
    """
    parts = max(1, -(-count // most))
    columns = ["vec_id", "label", "vector"] + ([extra] if extra else [])
    kinds = [("ids", np.int64), ("labels", np.int64), ("vectors", np.int32)] + ([(extra, np.int64)] if extra else [])

    def task(batches):
        held, number = [[] for _ in columns], None
        for batch in batches:
            if len(batch):
                number = batch.column(0)[0].as_py()
                for h, c in zip(held, batch.columns[1:], strict=True):
                    h.append((c.flatten() if pa.types.is_list(c.type) else c).to_numpy(zero_copy_only=False))
        if number is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int32())] + [pa.array([np.concatenate(h).astype(t).tobytes()], pa.binary()) for h, (_, t) in
                                                    zip(held, kinds, strict=True)], names=["block", *[n for n, _ in kinds]])
    dealt = rows.select(*columns).repartition(parts).sortWithinPartitions("label", "vec_id").select(F.spark_partition_id().alias("block"), *columns)
    return dealt.mapInArrow(task, "block int, " + ", ".join(f"{n} binary" for n, _ in kinds))


def pairs(held: DataFrame, asked: DataFrame, blocks: int) -> DataFrame:
    """Each block of vectors with each block of anchors, joined on the block's number."""
    asked = asked.select(*[F.col(c).alias(f"q_{c}") for c in asked.columns]).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return held.hint("merge").join(asked.drop("q_block"), "block")


def mine(table: DataFrame, anchors: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
         positives: int = 5, negatives: int = 5, least_percent: int = 80, most_percent: int = 100, scale: float = 256.0,
         seed: int = 13) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows of ``table`` that ``anchors`` marks.

    Components become floor(scale * x) and a score is the integer inner product with the anchor.  An anchor's
    positives are its ``positives`` best other rows of its label; for each, the ``negatives`` best rows of other
    labels are returned whose score is at least ``least_percent`` and at most ``most_percent`` of the positive's.
    Higher scores first, ties to the smaller id.  The result is exact: codes only rule candidates out.

    Ids and labels are integers.  Rows with a null id or label, a null or empty vector, null, NaN or infinite
    components, or another length than most take no part.  Components are held within ``largest_component``, so that
    scores fit a long.  Rows with the anchor's own id are neither positives nor negatives; an id that repeats
    is asked once, with its smallest (label, vector), and its rows are candidates each.  Anchors without
    positives or negatives give no rows, as do empty tables and positives of a score below zero.  Other columns take no part.
    """
    spark = table.sparkSession
    rows, d = integer_vectors(table, id_col, label_col, vector_col, scale)
    if not d:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    marked = integer_vectors(table.filter(anchors), id_col, label_col, vector_col, scale)[0].filter(F.size("vector") == d)
    asked = materialise(marked.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("own")).select("vec_id", "own.*"), "anchors")
    n, n_asked = rows.count(), asked.count()
    blocks = max(1, -(-n // BLOCK))
    turn = spark.sparkContext.broadcast(rotation(d, seed))                     # dimensions x dimensions numbers
    held = materialise(blocks_of(rows, n, BLOCK), "blocks")

    def scan(each, extra: bool, names: list[str]):
        """Goes through pairs of blocks and calls ``each`` for every anchor."""
        def task(batches):
            for batch in batches:
                for _, ids, labels, vectors, q_ids, q_labels, q_vectors, *more in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    block, queries = Block(ids, labels, vectors, d), Block(q_ids, q_labels, q_vectors, d)
                    codes = Codes(block.vectors.astype(np.float64), turn.value)
                    scored = np.frombuffer(more[0], np.int64).reshape(len(queries.ids), -1) if extra else queries.ids[:, None]
                    found = [[] for _ in names]
                    for i, (anchor_id, label) in enumerate(zip(queries.ids.tolist(), queries.labels.tolist(), strict=True)):
                        for part in each(block, codes, anchor_id, label, queries.vectors[i].astype(np.int64), scored[i].tolist()):
                            for f, x in zip(found, part, strict=True):
                                f.append(x)
                    if found[0]:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in found], names=names)
        return task

    def same(block, codes, anchor_id, label, anchor, _):
        for ids, scores in nearest_same(block, codes, turn.value, anchor_id, label, anchor, positives):
            yield np.full(len(ids), anchor_id), ids, scores

    def other(block, codes, anchor_id, label, anchor, scores):
        windows = [(place, -(-least_percent * s // 100), most_percent * s // 100) for place, s in enumerate(scores) if s >= 0]
        windows = [w for w in windows if w[1] <= w[2]]
        if windows:
            for place, ids, found in inside(block, codes, turn.value, anchor_id, label, anchor, windows, negatives):
                yield np.full(len(ids), anchor_id), np.full(len(ids), place), ids, found
    queries = blocks_of(asked, n_asked, ANCHORS)
    near = pairs(held, queries, blocks).mapInArrow(scan(same, False, ["anchor_id", "positive_id", "positive_score"]),
                                                   "anchor_id long, positive_id long, positive_score long")
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")) - 1
    chosen = materialise(near.withColumn("place", place).filter(F.col("place") < positives), "positives")
    # an anchor's positive scores in their order; -1, which asks for nothing, where it has fewer
    scores = chosen.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("s")).select(
        F.col("anchor_id").alias("vec_id"),
        F.slice(F.concat("s.positive_score", F.array_repeat(F.lit(-1).cast("long"), positives)), 1, positives).alias("scores"))
    queries = blocks_of(asked.join(scores, "vec_id"), n_asked, ANCHORS, "scores")
    far = pairs(held, queries, blocks).mapInArrow(scan(other, True, ["anchor_id", "place", "negative_id", "negative_score"]),
                                                  "anchor_id long, place long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id"))
    ranked = materialise(far.withColumn("rank", rank).filter(F.col("rank") <= negatives), "negatives")
    discard(held)
    return ranked.join(chosen.withColumn("place", F.col("place").cast("long")), ["anchor_id", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
