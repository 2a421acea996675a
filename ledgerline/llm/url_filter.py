"""URL rules by a cascade of Bloom filters: exact membership over a known key universe, without joins.

Level 1 encodes the listed keys.  The keys of the corpus that pass it though
they are not listed are encoded by level 2, the listed keys that pass level 2
by level 3, and so on in turn until no false positive is left.  A key of the
universe is listed if the first level that it fails is an even one (or it
passes all levels and their number is odd).  Level 1 is sized so that about as
many unlisted keys pass it as there are listed ones: the levels together take
a few bits a listed key plus its share of log2(universe / listed), however
many documents there are.  Only bits are gathered and broadcast.

The universe is every key that a url of the corpus asks for: each suffix of
its host at a label boundary with each prefix of its path that has the length
of some rule's path.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, free_name, materialise

#: The cascades that tasks hold at a time may take about so many bytes; more listed keys are judged part by part.
MOST_BYTES = 256 << 20
#: Words of a level that the driver takes at a time.
FETCH_WORDS = 1 << 21
SALTS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://``, its A-Z in lower case; path after it.  Both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def candidate_keys(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """Keys that could hold a rule for (host, path), longest first; of one length, the longer host first."""
    labels = F.split(host, r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)),
                        lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    lengths = F.filter(F.array(*[F.lit(n) for n in sorted(path_lengths, reverse=True)]), lambda n: n <= F.length(path))
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(
        lengths, lambda n: F.struct((-F.length(h) - n).alias("less"), n.alias("path"),
                                    F.concat(h, F.substr(path, F.lit(1), n)).alias("key")))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.array_sort(F.filter(keys, lambda k: ~k["key"].startswith("/"))), lambda k: k["key"]))


def hashes(key: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes; together they stand for the key."""
    return F.xxhash64(key), F.xxhash64(F.concat(F.lit("second:"), key))


def positions(h1, h2, level: int, bits: int, probes: int) -> list[np.ndarray]:
    """Bit positions of keys at one level, by double hashing with the level's salt."""
    with np.errstate(over="ignore"):
        a = (np.asarray(h1).astype(np.uint64) + np.uint64(SALTS[0]) * np.uint64(level + 1)) * np.uint64(SALTS[1])
        a ^= a >> np.uint64(31)
        b = (np.asarray(h2).astype(np.uint64) ^ (a * np.uint64(SALTS[0]))) | np.uint64(1)
        b ^= (b >> np.uint64(29)) & ~np.uint64(1)
        return [(a + np.uint64(i) * b) % np.uint64(bits) for i in range(probes)]


class Level:
    def __init__(self, number: int, bits: int, probes: int):
        self.number, self.bits, self.probes = number, bits, probes
        self.words = np.zeros((bits + 63) // 64, np.uint64)

    @classmethod
    def sized(cls, number: int, keys: int, rate: float) -> Level:
        bits = max(64, math.ceil(max(keys, 1) * -math.log(rate) / math.log(2) ** 2))
        return cls(number, bits, max(1, round(bits / max(keys, 1) * math.log(2))) if keys else 1)

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        found = np.ones(len(h1), bool)
        for at in positions(h1, h2, self.number, self.bits, min(self.probes, 30)):
            found &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found

    def fill(self, keys: DataFrame) -> Level:
        """Set the bits of ``keys`` (h1, h2): tasks turn keys into words, words meet by number, and words are gathered."""
        number, bits, probes = self.number, self.bits, min(self.probes, 30)

        def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                at = np.concatenate(positions(pdf["h1"].to_numpy(), pdf["h2"].to_numpy(), number, bits, probes))
                bit = np.left_shift(np.uint64(1), at & np.uint64(63)).view(np.int64)
                yield pd.DataFrame({"word": (at >> np.uint64(6)).astype(np.int64), "bit": bit})
        rows = keys.mapInPandas(words, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits"))
        many = len(self.words) > FETCH_WORDS
        if many:
            rows = materialise(rows, "words")
        for lo in range(0, len(self.words), FETCH_WORDS):   # at most one row per word of the level, a bounded number at a time
            part = (rows.filter((F.col("word") >= lo) & (F.col("word") < lo + FETCH_WORDS)) if many else rows).toArrow()
            self.words[part["word"].to_numpy()] = part["bits"].to_numpy().view(np.uint64)
        if many:
            discard(rows)
        return self


def cascade_parts(listed: int, universe: int) -> int:
    """Parts of ``listed`` keys whose cascades over ``universe`` keys take about MOST_BYTES each: some log2(e) bits a key
    for each halving of the first level's rate, and as many again for the levels after it."""
    rate = min(0.5, max(1e-9, listed * math.sqrt(0.5) / max(universe, 1)))
    return max(1, math.ceil(listed * 1.5 * (-math.log2(rate) + 4) / 8 / MOST_BYTES))


def part_of(h1, parts: int):
    """The part of keys, by bits of their first hash."""
    return (np.asarray(h1).astype(np.uint64) >> np.uint64(17)) % np.uint64(parts)


def is_listed(levels: list[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether each key of the universe is listed."""
    out, open_ = np.zeros(len(h1), bool), np.arange(len(h1))
    for i, level in enumerate(levels):
        passed = level.has(h1[open_], h2[open_])
        out[open_[~passed]] = i % 2 == 1
        open_ = open_[passed]
        if not len(open_):
            return out
    out[open_] = len(levels) % 2 == 1
    return out


def build(listed: DataFrame, universe: DataFrame, later_rate: float = 0.5) -> list[Level]:
    """The cascade of ``listed`` (key) over ``universe`` (key, may repeat)."""
    spark = listed.sparkSession
    h1, h2 = hashes(F.col("key"))
    listed = materialise(listed.filter("key IS NOT NULL").select(h1.alias("h1"), h2.alias("h2")).distinct(), "listed")
    keys = universe.select(h1.alias("h1"), h2.alias("h2"))
    counts = listed.count(), keys.agg(F.approx_count_distinct("h1")).first()[0]      # one row each
    if not counts[0]:
        return []
    rate = min(0.5, max(1e-9, counts[0] * math.sqrt(0.5) / max(counts[1], 1)))
    levels = [Level.sized(0, counts[0], rate).fill(listed)]

    def passing(keys: DataFrame, level: Level) -> DataFrame:
        shared = spark.sparkContext.broadcast(level)

        def tested(batches):
            for pdf in batches:
                yield pdf[shared.value.has(pdf["h1"].to_numpy(), pdf["h2"].to_numpy())]
        return keys.mapInPandas(tested, "h1 long, h2 long")

    # the one pass over the corpus: about as many keys stay as are listed
    against = materialise(passing(keys, levels[0]).distinct().join(listed, ["h1", "h2"], "left_anti"), "passed")
    own, size = listed, against.count()
    while size:
        if len(levels) > 200:                                # keys are told apart by 128 bits of hash
            raise ValueError("the cascade does not end: a listed and another key share both hashes")
        levels.append(Level.sized(len(levels), size, later_rate).fill(against))
        nxt = materialise(passing(own, levels[-1]), "passed")
        if own is not listed:
            discard(own)
        own, against, size = against, nxt, nxt.count()
    return levels


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    ``rules``: (host, path, verdict).  A rule fits its host and all subdomains
    of it, if the url's path starts with the rule's.  The longest rule wins,
    then the one with the longer host; of rules listed with several verdicts the
    alphabetically first verdict.  Rules beyond what MOST_BYTES of cascades hold are split by hash, and the pages
    are gone through once for each part.  Urls without a rule (also null ones and those without ``://``)
    get ``default``.  Columns of these names are replaced.  Empty tables give empty results.
    """
    spark = pages.sparkSession
    rules = rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict")).filter("host != '' AND path IS NOT NULL")
    key = F.concat("host", "path")
    summary = rules.agg(F.collect_set(F.length("path")).alias("lengths"),        # bounded by the longest path
                        F.collect_set("verdict").alias("verdicts")).first()
    lengths, verdicts = sorted(summary["lengths"]), sorted(summary["verdicts"])
    host, path = host_and_path(F.col(f"`{url_col}`").cast("string"))
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    if not lengths:
        return pages.select(*[F.col(f"`{c}`") for c in kept], host.alias("host"), path.alias("path"),
                            F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    slim = pages.select(host.alias("host"), path.alias("path"))
    universe = slim.select(F.explode(candidate_keys(F.col("host"), F.col("path"), lengths)).alias("key"))
    # one more pass over the corpus, and only where the rules may need several parts
    parts = 1
    if cascade_parts(n_rules := rules.count(), 10 ** 12) > 1:
        parts = cascade_parts(n_rules, universe.agg(F.approx_count_distinct("key")).first()[0])

    def first_rule(cascades: list[list[Level]], part: int):
        shared = spark.sparkContext.broadcast(cascades)

        @F.pandas_udf("int")
        def found_in(h1: pd.Series, h2: pd.Series) -> pd.Series:
            """Of each url's keys in their order, the first that a cascade lists: place * cascades + cascade; -1: none."""
            sizes = h1.map(len).to_numpy()
            if not sizes.sum():
                return pd.Series(np.full(len(h1), -1, np.int32))
            a, b = np.concatenate(h1.to_numpy()).astype(np.int64), np.concatenate(h2.to_numpy()).astype(np.int64)
            best, mine = np.full(len(a), -1), np.flatnonzero(part_of(a, parts) == part)
            for i, levels in reversed(list(enumerate(shared.value))):
                best[mine[is_listed(levels, a[mine], b[mine])]] = i
            start = np.cumsum(sizes) - sizes
            place = np.arange(len(a)) - np.repeat(start, sizes)
            hit = np.flatnonzero(best >= 0)
            row = np.repeat(np.arange(len(sizes)), sizes)[hit]
            rows, at = np.unique(row, return_index=True)          # the first hit of each row
            out = np.full(len(sizes), -1, np.int32)
            out[rows] = place[hit[at]] * len(shared.value) + best[hit[at]]
            return pd.Series(out)
        return found_in

    keys, found = free_name(pages, "keys"), free_name(pages, "found")
    out = (pages.select(*[F.col(f"`{c}`") for c in kept], host.alias("host"), path.alias("path"))
           .withColumn(keys, candidate_keys(F.col("host"), F.col("path"), lengths)))
    both = F.transform(keys, lambda k: hashes(k)[0]), F.transform(keys, lambda k: hashes(k)[1])
    own = F.pmod(F.shiftrightunsigned(F.xxhash64("key"), 17), F.lit(parts))
    for part in range(parts):                               # tasks hold the cascades of one part at a time
        mine = [x.filter(own == part) if parts > 1 else x for x in (*[rules.filter(F.col("verdict") == v).select(key.alias("key")) for v in verdicts], universe)]
        cascades = [build(listed, mine[-1]) for listed in mine[:-1]]
        hit = first_rule(cascades, part)(*both)
        if part:
            hit = F.when((hit >= 0) & ((F.col(found) < 0) | (hit < F.col(found))), hit).otherwise(F.col(found))
        out = out.withColumn(found, hit)
        if parts > 1:
            out = materialise(out, "judged")
    n = len(verdicts)
    rule = F.when(F.col(found) >= 0, F.get(F.col(keys), F.floor(F.col(found) / n).cast("int")))
    verdict = F.when(F.col(found) >= 0, F.get(F.array(*[F.lit(v) for v in verdicts]), F.col(found) % n))
    return out.select(*[F.col(f"`{c}`") for c in kept], "host", "path", rule.alias("rule"),
                      F.coalesce(verdict, F.lit(default)).alias("verdict"))
