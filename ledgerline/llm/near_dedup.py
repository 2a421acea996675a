"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

A shingle is five words; its weight is its count in the text times its inverse
document frequency, which is kept by hashed bucket over all documents.  Each
of PERMUTATIONS permutations deals a text's shingles to BINS bins by hash, and
in each bin an improved consistent weighted sample (Ioffe) picks one shingle;
an empty bin borrows from the next.  BAND samples in a row make a band; texts
that share a band are candidates, and a pair is a link if its weighted Jaccard
similarity, computed from all shingles, reaches the threshold.  Classes are
the connected components of the links, over one representative of each exact text.

No bucket is joined into all its pairs.  In small ones every pair is checked; in
a large one every member is checked against its most central text, the one
whose other buckets are the fullest, which of edited copies is the one they were
copied from.  While members are left in other classes than that text's, the
most central of them is next, ROUNDS times.  Buckets that are then still split
(texts that share a passage, or copies without their source) are searched by an exact prefix filter: texts of
different classes meet at their rarest shingles only, where a link must have its first common shingle, and are
compared if the weights from there on allow the similarity.  So no size of bucket ends the search, and none is
gone through pair by pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialise, numbered, running_totals, summed_vectors

SHINGLE = 5
SIMILARITY = 0.8
PERMUTATIONS, BINS, BAND = 6, 8, 4
BANDS = PERMUTATIONS * BINS // BAND
#: Buckets of inverse document frequencies.
IDF_BUCKETS = 1 << 18
#: Buckets of up to so many texts are checked pair by pair.
SMALL = 6
ROUNDS = 1
#: Texts of one block of a shingle that many texts hold among their rarest.
BLOCK = 64
#: Sums of weights in two orders differ by less.
SLACK = 1e-6
#: Members that meet one copy of the text they are compared with.
SHARE = 128
CHUNK = 2 << 20
U = np.uint64
_RNG = np.random.default_rng(77_003)
BYTES = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
POWERS = np.cumprod(np.full(1 << 12, U(0x9E3779B97F4A7C15)), dtype=np.uint64)
PLACES = _RNG.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * U(2) + U(1)
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, 32-bit shingle, count), sorted by text and shingle.  Texts of fewer than five words are one shingle."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = SPACES[data]
    ends = np.cumsum([len(t) + 1 for t in texts])
    begin = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
    word = np.cumsum(np.bincount(begin, minlength=len(data))) - 1          # of each byte; -1 before the first word
    inside = np.flatnonzero(~space)
    place = inside - begin[word[inside]]
    hashed = BYTES[data[inside]] * POWERS[place & (len(POWERS) - 1)] + (place >> 12).astype(U)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(word[inside])) + 1])
    words = mixed(np.add.reduceat(hashed, starts))
    owner = np.searchsorted(ends, begin, side="right")
    n = len(words)
    many = np.bincount(owner, minlength=len(texts))
    # a shingle starts at each word that has four more of its text after it, or at the first word of a short text
    first = np.concatenate([[0], np.cumsum(many)[:-1]])
    left = first[owner] + many[owner] - np.arange(n)
    at = np.flatnonzero((left >= SHINGLE) | (np.arange(n) == first[owner]))
    h = np.zeros(len(at), U)
    for i in range(SHINGLE):
        there = i < left[at]
        h += np.where(there, words[np.minimum(at + i, n - 1)] * PLACES[i], U(i + 1))
    key = owner[at].astype(U) << U(32) | mixed(h) >> U(32)
    key, count = np.unique(key, return_counts=True)
    return (key >> U(32)).astype(np.int64), key.astype(np.uint32), count


def chunked(texts: list[bytes]):
    lo = 0
    while lo < len(texts):
        hi, size = lo + 1, len(texts[lo])
        while hi < len(texts) and size + len(texts[hi]) <= CHUNK:
            size += len(texts[hi])
            hi += 1
        yield lo, hi
        lo = hi


def lowered(column) -> list[bytes]:
    return [t.lower().encode() for t in column.to_pylist()]


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """1 + log((1 + documents) / (1 + document frequency)), by hashed bucket, over all of ``docs`` (text)."""

    def count(batches):
        total = np.zeros(IDF_BUCKETS + 256, np.int64)
        for batch in batches:
            texts = lowered(batch.column(0))
            total[IDF_BUCKETS] += len(texts)
            for lo, hi in chunked(texts):
                total[:IDF_BUCKETS] += np.bincount(shingles(texts[lo:hi])[1] & (IDF_BUCKETS - 1), minlength=IDF_BUCKETS)
        return total
    counts = summed_vectors(docs, count, IDF_BUCKETS + 256)
    return 1 + np.log((1 + counts[IDF_BUCKETS]) / (1 + np.minimum(counts[:IDF_BUCKETS], counts[IDF_BUCKETS])))


def samples(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int, seed: int) -> np.ndarray:
    """(texts, PERMUTATIONS * BINS) consistent weighted samples; texts without a shingle get none (0)."""
    out = np.zeros((texts, PERMUTATIONS * BINS), U)
    log_weight = np.log(weight)
    for p in range(PERMUTATIONS):
        h = mixed(shingle.astype(U) + U((seed * PERMUTATIONS + p + 1) << 32))
        cell = text * BINS + (h >> U(61)).astype(np.int64)                    # 3 bits: BINS is 8
        u = []
        for _ in range(5):
            h = mixed(h + U(0x9E3779B97F4A7C15))
            u.append(((h >> U(12)).astype(float) + 0.5) / float(1 << 52))
        r, log_c = -np.log(u[0] * u[1]), np.log(-np.log(u[2] * u[3]))
        t = np.floor(log_weight / r + u[4])
        log_a = log_c - r * (t - u[4] + 1)
        least = np.full(texts * BINS, np.inf)
        np.minimum.at(least, cell, log_a)
        won = log_a == least[cell]
        value = np.zeros(texts * BINS, U)
        value[cell[won]] = mixed(shingle[won].astype(U) * U(0x9E3779B97F4A7C15) + t[won].astype(np.int64).astype(U)) | U(1)
        value = value.reshape(texts, BINS)
        for _ in range(BINS - 1):                                             # empty bins borrow from the next
            value = np.where(value == 0, np.roll(value, -1, axis=1) * U(3), value)
        out[:, p * BINS:(p + 1) * BINS] = value
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(texts, BANDS): the hash of each band's samples and its number."""
    keys = np.zeros((len(signature), BANDS), U)
    for b in range(BANDS):
        h = np.full(len(signature), b + 1, U)
        for i in range(BAND):
            h = mixed(h * U(0x9E3779B97F4A7C15) + signature[:, b * BAND + i])
        keys[:, b] = h
    return keys.view(np.int64)


def key_rows(docs: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(docs, keys.shape[1]))], names=["key", "doc"])


def first_bands(idf):
    def task(batches):
        for batch in batches:
            docs, texts = batch.column(0).to_numpy(), lowered(batch.column(1))
            for lo, hi in chunked(texts):
                text, shingle, count = shingles(texts[lo:hi])
                weight = count * idf.value[shingle & (IDF_BUCKETS - 1)]
                signature = samples(text, shingle, weight, hi - lo, 0)
                some = signature[:, 0] != 0
                yield key_rows(docs[lo:hi][some], band_keys(signature[some]))
    return task


SET = np.dtype([("shingle", "<u4"), ("weight", "<f4")])


def shingle_sets(idf):
    """(doc, data, total) of (doc, text): the weighted shingles, sorted."""
    def task(batches):
        for batch in batches:
            texts = lowered(batch.column(1))
            data: list[bytes] = []
            for lo, hi in chunked(texts):
                text, shingle, count = shingles(texts[lo:hi])
                sets = np.zeros(len(text), SET)
                sets["shingle"], sets["weight"] = shingle, count * idf.value[shingle & (IDF_BUCKETS - 1)]
                cuts = np.searchsorted(text, np.arange(hi - lo + 1))
                data += [sets[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            total = [float(np.frombuffer(d, SET)["weight"].sum(dtype=float)) for d in data]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary()), pa.array(total)], names=["doc", "data", "total"])
    return task


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted sets."""
    at = np.searchsorted(a["shingle"], b["shingle"])
    at[at == len(a)] = 0
    same = a["shingle"][at] == b["shingle"] if len(a) else np.zeros(len(b), bool)
    common = float(np.minimum(a["weight"][at[same]], b["weight"][same]).sum(dtype=float))
    whole = float(a["weight"].sum(dtype=float)) + float(b["weight"].sum(dtype=float)) - common
    return common / whole if whole else 0.0


def check(threshold: float):
    """Links among rows (a, share, b, data), sorted so that the text a itself (b is null) comes before the texts it meets."""
    def task(batches):
        current, base = None, None
        for batch in batches:
            found: list[tuple] = []
            for a, b, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if b is None:
                    current, base = a, np.frombuffer(data, SET)
                elif a == current:
                    s = similarity(base, np.frombuffer(data, SET))
                    if s >= threshold:
                        found.append((a, b, s))
            a, b, s = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())],
                                             names=["a", "b", "similarity"])
    return task


def links_of(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that reach the threshold; a text that meets many is copied once for SHARE of them."""
    share = F.pmod(F.xxhash64("b"), F.greatest(F.lit(1), F.ceil(F.col("n") / SHARE)))
    pairs = pairs.join(materialise(pairs.groupBy("a").agg(F.count("*").alias("n")), "degrees"), "a").select(
        "a", share.cast("long").alias("share"), "b")
    pairs = materialise(pairs, "pairs")
    meets = pairs.join(sets, pairs["b"] == sets["doc"]).select("a", "share", "b", "data")
    bases = pairs.select("a", "share").distinct().join(sets, F.col("a") == F.col("doc")).select(
        "a", "share", F.lit(None).cast("long").alias("b"), "data")
    return materialise(meets.unionByName(bases).repartition("a", "share").sortWithinPartitions("a", "share", F.col("b").asc_nulls_first())
                       .mapInArrow(check(threshold), "a long, b long, similarity double"), "links")


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(doc, class): the smallest document of each connected component, for documents with a link.

    Classes that a link joins take the smallest neighbour's label, and labels
    are followed twice, until no link joins two classes.
    """
    ends = links.select(F.col("a").alias("doc")).union(links.select(F.col("b").alias("doc"))).distinct()
    if known is None:
        labels = materialise(ends.select("doc", F.col("doc").alias("class")), "labels")
    else:
        labels = materialise(known.unionByName(ends.join(known, "doc", "left_anti").select("doc", F.col("doc").alias("class"))), "labels")
    edges = links.select("a", "b")
    while True:
        left = edges.join(labels, F.col("a") == F.col("doc")).select(F.col("class").alias("a"), "b")
        both = left.join(labels, F.col("b") == F.col("doc")).select("a", F.col("class").alias("b")).filter("a != b")
        edges = materialise(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return labels
        ways = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = materialise(ways.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("from"), F.least("a", "b").alias("to")), "steps")
        far = to.select(F.col("from").alias("mid"), F.col("to").alias("far"))
        to = materialise(to.join(far, F.col("to") == F.col("mid"), "left").select("from", F.coalesce("far", "to").alias("to")), "steps")
        labels = materialise(labels.join(to, F.col("class") == F.col("from"), "left")
                             .select("doc", F.coalesce("to", "class").alias("class")), "labels")


def buckets_of(keys: DataFrame) -> DataFrame:
    """(key, doc, n, central, leader) of the texts that share a key with others.

    ``central``: how many texts are in the text's buckets; ``leader``: the most central of the bucket, then the smallest.
    """
    shared = materialise(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    members = materialise(keys.join(shared, "key"), "members")
    central = materialise(members.groupBy("doc").agg(F.sum("n").alias("central")), "central")
    members = materialise(members.join(central, "doc"), "members")
    leaders = members.groupBy("key").agg(F.min(F.struct((-F.col("central")).alias("less"), "doc"))["doc"].alias("leader"))
    return materialise(members.join(materialise(leaders, "leaders"), "key"), "members")


def ordered(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) once each; the first stays the text that meets the others."""
    return pairs.select("a", "b").filter("a != b").distinct()


def candidates(members: DataFrame) -> DataFrame:
    star = members.select(F.col("leader").alias("a"), F.col("doc").alias("b"))
    small = members.filter(f"n BETWEEN 3 AND {SMALL} AND doc != leader").select("key", "doc")
    pairs = small.alias("x").join(small.alias("y"), "key").filter("x.doc < y.doc").select(
        F.col("x.doc").alias("a"), F.col("y.doc").alias("b"))
    return ordered(star.unionByName(pairs))


def split_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, doc, n, central, leader, class) of the large buckets whose members are in several classes."""
    large = members.filter(f"n > {SMALL}").join(labels, "doc", "left").withColumn("class", F.coalesce("class", "doc"))
    large = materialise(large, "large")
    split = large.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo != hi").select("key")
    return materialise(large.join(materialise(split, "split"), "key"), "open")


def next_round(open_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members with their next leader, pairs with it): the most central member outside the class of the last leader."""
    last = open_.filter("doc = leader").select("key", F.col("class").alias("last_class"))
    rest = open_.join(materialise(last, "last"), "key").filter("class != last_class")
    nxt = rest.groupBy("key").agg(F.min(F.struct((-F.col("central")).alias("less"), "doc", "class")).alias("next"))
    nxt = materialise(nxt.select("key", F.col("next.doc").alias("next"), F.col("next.class").alias("next_class")), "next")
    members = materialise(open_.join(nxt, "key"), "members")
    pairs = members.filter("class != next_class").select(F.col("next").alias("a"), F.col("doc").alias("b"))
    return members.select("key", "doc", "n", "central", F.col("next").alias("leader")), ordered(pairs)


def rarest_shingles(idf, threshold: float):
    """(shingle, doc, class, total, rest) of (doc, class, data, total): a text's rarest shingles, the others weighing less than
    ``threshold`` of it.  ``rest`` is what the shingle and the commoner ones after it weigh."""
    def task(batches):
        for batch in batches:
            parts = []
            for doc, label, data, total in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                held = np.frombuffer(data, SET)
                order = np.lexsort((held["shingle"], -idf.value[held["shingle"] & (IDF_BUCKETS - 1)]))
                rest = np.cumsum(held["weight"][order][::-1].astype(float))[::-1]
                many = int((rest >= threshold * total * (1 - SLACK)).sum())
                parts.append((held["shingle"][order[:many]].astype(np.int64), np.full(many, doc, np.int64), np.full(many, label, np.int64),
                              np.full(many, total), rest[:many]))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)],
                                                 names=["shingle", "doc", "class", "total", "rest"])
    return task


def rare_pairs(open_: DataFrame, sets: DataFrame, idf, threshold: float) -> DataFrame:
    """Pairs (a, b) of texts in split buckets, of different classes, that may reach the threshold; no link among them is lost.

    With all shingles in one order, rarest first, the common weight of a link lies at and after its first common shingle.
    It is at least threshold / (1 + threshold) of both totals together, and threshold of either, so that shingle is among the
    rarest of both texts and both their rests there reach that weight.
    A shingle of many texts is dealt to cells of two blocks each, every cell under a key of its own.
    """
    texts = open_.select("doc", "class").distinct().join(sets, "doc").select("doc", "class", "data", "total")
    rare = materialise(texts.mapInArrow(rarest_shingles(idf, threshold), "shingle long, doc long, class long, total double, rest double"), "rare")
    shared = rare.groupBy("shingle").agg(F.count("*").alias("n"), F.min("class").alias("lo"), F.max("class").alias("hi"))
    rare = rare.join(materialise(shared.filter("lo != hi").select("shingle", F.ceil(F.col("n") / BLOCK).alias("blocks")), "shared"), "shingle")
    rare = materialise(rare.withColumn("block", F.pmod(F.xxhash64("doc"), "blocks")), "rare")
    one = rare.select("shingle", F.col("block").alias("x"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("y"),
                      F.struct("doc", "class", "total", "rest").alias("one"))
    two = rare.select("shingle", F.explode(F.sequence(F.lit(0).cast("long"), "block")).alias("x"), F.col("block").alias("y"),
                      F.struct("doc", "class", "total", "rest").alias("two"))
    least = F.greatest(F.greatest("one.total", "two.total") * threshold, (F.col("one.total") + F.col("two.total")) * (threshold / (1 + threshold)))
    return one.join(two, ["shingle", "x", "y"]).filter("(x != y OR one.doc < two.doc) AND one.class != two.class").filter(
        F.least("one.rest", "two.rest") >= least * (1 - SLACK)).select(
        F.least("one.doc", "two.doc").alias("a"), F.greatest("one.doc", "two.doc").alias("b"))


def representatives(docs: DataFrame) -> DataFrame:
    """(doc, rep): the first document of each exact text."""
    copies = materialise(docs.select("doc", F.unhex(F.sha2("text", 256)).alias("digest")), "digests")
    groups = materialise(copies.groupBy("digest").agg(F.min("doc").alias("rep"), F.count("*").alias("n")).filter("n > 1"), "copies")
    return materialise(copies.join(groups, "digest").select("doc", "rep"), "representatives")


def near_classes(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """(doc, class) for ``docs`` (doc, text).  The links found span each class; they are not all of its pairs, so none are counted."""
    spark = docs.sparkSession
    copies = representatives(docs)
    later = copies.filter("doc != rep").select("doc")
    idf = spark.sparkContext.broadcast(inverse_frequencies(docs.select("text")))          # IDF_BUCKETS numbers
    keys = docs.select("doc", "text").mapInArrow(first_bands(idf), "key long, doc long")
    members = buckets_of(materialise(keys, "bands").join(later, "doc", "left_anti"))
    # the wanted documents grow with the corpus: never a broadcast, also where they are still few
    wanted = members.select("doc").distinct()
    sets = materialise(docs.select("doc", "text").hint("merge").join(wanted, "doc").mapInArrow(
        shingle_sets(idf), "doc long, data binary, total double"), "sets")
    links = links_of(materialise(candidates(members), "candidates"), sets, threshold)
    labels = components(links)
    open_ = split_buckets(members, labels)
    for _ in range(ROUNDS):
        if open_.isEmpty():
            break
        members, pairs = next_round(open_)
        found = links_of(materialise(pairs, "candidates"), sets, threshold)
        labels = components(found, labels)
        open_ = split_buckets(members, labels)
    if not open_.isEmpty():
        found = links_of(materialise(ordered(rare_pairs(open_, sets, idf, threshold)), "candidates"), sets, threshold)
        labels = components(found, labels)
    reps = docs.select("doc").join(copies, "doc", "left").select("doc", F.coalesce("rep", "doc").alias("text_doc"))
    known = labels.withColumnRenamed("doc", "text_doc")
    return reps.join(known, "text_doc", "left").select("doc", F.coalesce("class", "text_doc").alias("class"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """One row per document: id, class_id (the smallest id of its class), kept (one row of each class).

    Words are what ASCII white space parts, in lower case.  Texts of fewer
    than five words are one shingle, so only those of the same words are near copies; texts without
    a word are in one class if they are equal.  Nulls are empty texts; null ids come first.
    """
    docs, plain = numbered(docs, id_col, text_col)
    found = materialise(near_classes(docs.select("doc", "text"), threshold), "near")
    kept = F.col("doc") == F.col("class")
    if plain:
        kind = docs.schema["id"].dataType
        return found.select(F.col("doc").cast(kind).alias("id"), F.col("class").cast(kind).alias("class_id"), kept.alias("kept"))
    names = docs.select(F.col("doc").alias("class"), F.col("id").alias("class_id"))
    return docs.select("doc", "id").join(found, "doc").join(names, "class").select("id", "class_id", kept.alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each class, the one of the smallest id, all columns as they were.

    Rows that share an id are rows of their own: of those in one class the first in input order stays.
    """
    gone_id = free_name(docs, "gone_id")
    if docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long") and \
            docs.groupBy(F.col(f"`{id_col}`").alias("id")).count().filter("count > 1 OR id IS NULL").isEmpty():
        gone = materialise(classes(docs, id_col, text_col, threshold).filter(~F.col("kept")).select(F.col("id").alias(gone_id)), "gone")
        return docs.join(gone, F.col(f"`{id_col}`") == F.col(gone_id), "left_anti")
    # rows are told apart by their place in the order of (id, input)
    place, rank = (free_name(docs, n) for n in ("place", "rank"))
    stored = materialise(docs.withColumn(place, F.monotonically_increasing_id()), "rows")
    ranks, _ = running_totals(stored.select(F.col(f"`{id_col}`").alias("id"), F.col(place).alias("at"), F.lit(1).alias("one")), ["id", "at"], {"rank": "one"})
    ranked = materialise(stored.join(ranks.select(F.col("at").alias(place), F.col("rank").alias(rank)), place), "ranked")
    gone = materialise(classes(ranked, rank, text_col, threshold).filter(~F.col("kept")).select(F.col("id").alias(gone_id)), "gone")
    return ranked.join(gone, F.col(rank) == F.col(gone_id), "left_anti").select(*docs.columns)
