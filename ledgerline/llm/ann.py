"""Approximate nearest neighbours by cosine: inverted lists scanned dimension block by dimension block.

Unit vectors are rotated by a random orthogonal matrix, so that any prefix of
the dimensions is a fair sample of the distance (on unit vectors, order by
cosine is order by distance).  They are dealt to lists around centroids that
k-means fits on a bounded sample, and stored list by list in blocks, the
rotated dimensions in column blocks.  A query scans the blocks of its
nearest lists: after each column block, candidates whose partial distance,
scaled up, exceeds the distance of the k-th best by more than a hypothesis test
allows are abandoned.  What is left is scored exactly, in double precision, on
the original vectors.  Every vector is indexed; a long list is many blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise

#: Vectors that fit the centroids: those with the smallest hashes of their id.
MOST_SAMPLE = 20_000
MOST_LISTS = 1024
#: Vectors of one block, queries of one block, dimensions of one column block.
BLOCK, QUERIES, COLUMNS = 2048, 256, 16
#: How many standard errors a scaled partial distance may lie above the k-th best.
SLACK = 2.1


def valid_vectors(table: DataFrame, id_col: str, vector_col: str, dimensions: int | None = None) -> tuple[DataFrame, int]:
    """(vec_id, vector) of the vectors that take part, and their dimensions (the commonest length, unless given)."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = table.select(F.col(f"`{id_col}`").alias("vec_id"), v.alias("vector")).filter(
        "vec_id IS NOT NULL AND vector IS NOT NULL AND exists(vector, x -> x != 0) "
        "AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
    if dimensions is None:
        first = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
        dimensions = first["d"] if first else 0
    return rows.filter(F.size("vector") == dimensions), dimensions


def rotation(dimensions: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimensions, dimensions)))
    return q * np.sign(np.diag(r))


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)            # no overflow, no underflow
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def fit_centroids(sample: np.ndarray, lists: int, seed: int, rounds: int = 8) -> np.ndarray:
    """k-means on unit vectors; an empty list takes a sample vector."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(rounds):
        near = np.argmax(sample @ centroids.T - (centroids ** 2).sum(1) / 2, axis=1)
        sums, n = np.zeros_like(centroids), np.bincount(near, minlength=lists)
        np.add.at(sums, near, sample)
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], sample[rng.choice(len(sample), lists)])
    return centroids


def matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def binaries(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


class Index:
    def __init__(self, turn: np.ndarray, centroids: np.ndarray, probes: int, k: int):
        self.turn, self.centroids, self.probes, self.k = turn, centroids, probes, k
        self.sizes = np.zeros(len(centroids), np.int64)

    def scores(self, rotated: np.ndarray) -> np.ndarray:
        return rotated @ self.centroids.T - (self.centroids ** 2).sum(1) / 2


def probes_for(index: Index, sample: np.ndarray, recall: float, queries: int = 500) -> int:
    """The number of nearest lists that hold the share ``recall`` of the neighbours of some sample vectors."""
    asked = sample[:queries]
    near = asked @ sample.T
    near[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    k = min(index.k, len(sample) - 1)
    if k < 1:
        return 1
    neighbours = np.argpartition(-near, k - 1, axis=1)[:, :k]
    lists = np.argmax(index.scores(sample), axis=1)[neighbours]
    place = np.argsort(np.argsort(-index.scores(asked), axis=1, kind="stable"), axis=1)       # of each list for each query
    return int(np.quantile(np.take_along_axis(place, lists, axis=1), recall, method="higher")) + 1


def assign(index):
    def task(batches):
        for batch in batches:
            vectors = matrix(batch.column(1)) if len(batch) else np.zeros((0, len(index.value.turn)))
            if not len(vectors):
                continue
            rotated = unit(vectors) @ index.value.turn
            near = np.argmax(index.value.scores(rotated), axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(near), batch.column(0).cast(pa.int64()), binaries(vectors), binaries(rotated.astype(np.float32))],
                names=["list", "vec_id", "vector", "rotated"])
    return task


def probe(index):
    """(list, query_id, vector, rotated): each query with its nearest lists; more where these hold few vectors."""
    def task(batches):
        for batch in batches:
            if not len(batch):
                continue
            own = index.value
            vectors = matrix(batch.column(1))
            rotated = unit(vectors) @ own.turn
            order = np.argsort(-own.scores(rotated), axis=1, kind="stable")
            held = np.cumsum(own.sizes[order], axis=1)
            wide = np.maximum(own.probes, (held < 20 * own.k + 1).sum(axis=1) + 1)
            rank = np.arange(order.shape[1])[None, :]
            row, place = np.nonzero((rank < wide[:, None]) & (own.sizes[order] > 0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(order[row, place].astype(np.int32)), batch.column(0).cast(pa.int64()).take(pa.array(row)),
                 binaries(vectors[row]), binaries(rotated[row].astype(np.float32))], names=["list", "query_id", "vector", "rotated"])
    return task


def blocks_of(most: int, dimensions: int):
    """One row per block of (list, share): sorted rows in, (list, share, ids, vectors, columns) out."""
    def task(batches):
        key, ids, vectors, rotated = None, [], [], []

        def block():
            columns = np.frombuffer(b"".join(rotated), np.float32).reshape(-1, dimensions).T      # a dimension a row
            row = pa.RecordBatch.from_arrays(
                [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()),
                 pa.array([b"".join(vectors)], pa.binary()), pa.array([columns.tobytes()], pa.binary())],
                names=["list", "share", "ids", "vectors", "columns"])
            for x in (ids, vectors, rotated):
                x.clear()
            return row
        for batch in batches:
            for *at, i, v, r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if ids and (at != key or len(ids) == most):
                    yield block()
                key = at
                ids.append(i)
                vectors.append(v)
                rotated.append(r)
        if ids:
            yield block()
    return task


def scan(ids: np.ndarray, columns: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int):
    """For each query the places of the candidates that no test abandons and that may be among its k nearest.

    ``columns``: dimensions x vectors; ``queries``: rotated, one a row.
    """
    d, n = columns.shape
    step = min(COLUMNS, d)
    head = columns[:step]
    partial = (head ** 2).sum(0)[None, :] + (queries[:, :step] ** 2).sum(1)[:, None] - 2 * queries[:, :step] @ head
    partial[own[:, None] == ids[None, :]] = np.inf                            # a query is no candidate of its own
    some = min(n, max(4 * k, 16))
    first = np.argpartition(partial, some - 1, axis=1)[:, :some]
    for q in range(len(queries)):
        seen = first[q][np.isfinite(partial[q, first[q]])]
        if not len(seen):
            yield seen
            continue
        exact = ((columns[:, seen] - queries[q][:, None]) ** 2).sum(0)
        best = np.partition(exact, min(k, len(exact)) - 1)[min(k, len(exact)) - 1] if len(exact) >= k else np.inf
        alive, part, at = np.arange(n), partial[q], step
        while True:
            keep = part * (d / at) <= best * (1 + SLACK / math.sqrt(at)) ** 2 + 1e-5 if at < d else part <= best + 1e-5
            keep &= np.isfinite(part)
            alive, part = alive[keep], part[keep]
            if at >= d or not len(alive):
                break
            to = min(d, at + COLUMNS)
            part = part + ((columns[at:to, alive] - queries[q, at:to, None]) ** 2).sum(0)
            at = to
        if len(part) > k:
            part_k = np.partition(part, k - 1)[k - 1]
            alive = alive[part <= part_k + 1e-5]
        yield alive


def search(k: int, dimensions: int):
    """(query_id, vec_id, score): the k best of each query in each pair of blocks."""
    def task(batches):
        for batch in batches:
            for ids, vectors, columns, q_ids, q_vectors, q_columns in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                ids, q_ids = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
                vectors = np.frombuffer(vectors, np.float64).reshape(-1, dimensions)
                q_vectors = np.frombuffer(q_vectors, np.float64).reshape(-1, dimensions)
                columns = np.frombuffer(columns, np.float32).reshape(dimensions, -1)
                q_rotated = np.frombuffer(q_columns, np.float32).reshape(dimensions, -1).T
                found = [[], [], []]
                for q, places in enumerate(scan(ids, columns, np.ascontiguousarray(q_rotated), q_ids, k)):
                    if not len(places):
                        continue
                    score = cosine(vectors[places], q_vectors[q])
                    top = np.lexsort((ids[places], -score))[:k]
                    found[0].append(np.full(len(top), q_ids[q]))
                    found[1].append(ids[places][top])
                    found[2].append(score[top])
                if found[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in found], names=["query_id", "vec_id", "score"])
    return task


def cosine(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosines in double precision, each from its own row alone, so that equal vectors tie."""
    return (vectors * query).sum(axis=1) / (np.sqrt((vectors * vectors).sum(axis=1)) * np.sqrt((query * query).sum()))


def nearest(table: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5,
            recall: float = 0.97, seed: int = 7) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row of ``queries`` among the rows of ``table`` with another id.

    As many lists are probed as hold the share ``recall`` of the nearest
    neighbours of sample vectors within the sample.  Ties go to the smaller id.  Ids are integers.  Null and zero vectors, and those with null, NaN or infinite
    components, or of another length than most, take no part.  Rows that repeat an id are
    candidates each; a repeated query id is asked once.  Empty tables give an empty result.
    """
    spark = table.sparkSession
    rows, d = valid_vectors(table, id_col, vector_col)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not d:
        return empty
    asked = valid_vectors(queries, id_col, vector_col, d)[0].dropDuplicates(["vec_id"])
    n = rows.count()
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(MOST_SAMPLE, max(1000, (256 << 20) // (8 * d))))
    turn = rotation(d, seed)
    sample = unit(matrix(picked.select("vector").toArrow().column(0))) @ turn       # bounded: MOST_SAMPLE vectors, as one block of numbers
    lists = max(1, min(MOST_LISTS, round(math.sqrt(n)), len(sample) // 8))
    own = Index(turn, fit_centroids(sample, lists, seed), 1, k)
    own.probes = probes_for(own, sample, recall)
    index = spark.sparkContext.broadcast(own)                                 # lists x dimensions numbers
    listed = materialise(rows.mapInArrow(assign(index), "list int, vec_id long, vector binary, rotated binary"), "listed")
    sizes = listed.groupBy("list").count()
    for row in sizes.collect():                                               # one row per list
        own.sizes[row["list"]] = row["count"]
    index = spark.sparkContext.broadcast(own)
    asked = materialise(asked.mapInArrow(probe(index), "list int, query_id long, vector binary, rotated binary"), "asked")

    def blocks(rows: DataFrame, id_name: str, most: int, name: str) -> DataFrame:
        counts = rows.groupBy("list").agg(F.ceil(F.count("*") / most).alias("shares"))           # one row per list
        share = F.pmod(F.xxhash64(id_name, F.lit(seed)), F.col("shares")).cast("int")
        dealt = rows.join(F.broadcast(counts), "list").select("list", share.alias("share"), id_name, "vector", "rotated")
        return materialise(dealt.repartition("list", "share").sortWithinPartitions("list", "share").mapInArrow(
            blocks_of(most, d), "list int, share int, ids binary, vectors binary, columns binary"), name)
    held = blocks(listed, "vec_id", BLOCK, "blocks")
    probing = blocks(asked, "query_id", QUERIES, "queries").drop("share").withColumnsRenamed(
        {"ids": "q_ids", "vectors": "q_vectors", "columns": "q_columns"})
    # a block of queries meets each share of its list under a key of its own, so a list of any size spreads over tasks
    shares = F.broadcast(sizes.select("list", F.ceil(F.col("count") / BLOCK).cast("int").alias("shares")))           # one row per list
    probing = probing.join(shares, "list").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    pairs = held.hint("merge").join(probing, ["list", "share"]).select("ids", "vectors", "columns", "q_ids", "q_vectors", "q_columns")
    found = materialise(pairs.mapInArrow(search(k, d), "query_id long, vec_id long, score double"), "found")
    discard(listed, asked)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
