"""Repeated passages by two-stage suffix sorting, of the suffixes that may repeat.

A byte of a document is removed if a string of ``length`` bytes that covers it
also starts earlier in the corpus.  Strings are suffixes cut at ``length`` bytes:
equal ones are neighbours in sorted order, with a common prefix of ``length`` bytes.

1. Which suffixes may repeat.  Tasks find, for every string, its smallest gram of 32
   bytes by hash, its anchor; the strings that share one start in a run, and the
   bytes that they cover are the run's context.  Anchor, run and context make one entry.
2. Entries meet by anchor.  An anchor that occurs once ends there; entries of one anchor and
   context are equal strings throughout, so all but the first are repeats.  Left over
   are runs of anchors with several contexts, at the ends of repeats.
3. The suffixes of those runs are sorted in two stages.  Only those smaller than their
   successors (the suffix one byte on) are sorted directly, by bytes: they meet in buckets by
   their first bytes, and the common prefixes of neighbours are computed.  A suffix larger than
   its successor is induced: it consists of the bytes up to the next smaller suffix, and
   of that one.  A scan over each bucket's sorted suffixes gives two induced suffixes
   the same place if those bytes are the same and the common prefix of the
   suffixes they lead to fills the rest of ``length``.
4. Each document's spans are united and cut out.

Entries and strings that are equal within one task are reduced to the first before they travel, and an
anchor with many contexts in one task goes to step 3 at once, so a passage
that a third of the documents hold sends a few entries a task.  Steps 1 and 2 and that reduction compare hashes
(64 bits of anchor and context, 128 of a string), step 3 compares bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, numbered

GRAM = 32
BLOCK = 64
#: Text that is hashed at a time, and text whose entries make one bucket.
CHUNK = 2 << 20
BUCKET = 32 << 20
#: Entries that wait in a task before they are sorted and sent.
MOST_ENTRIES = 1 << 20
#: Text that waits with them.
MOST_TEXT = 32 << 20
#: Contexts of one anchor in one task from which they go to step 3 without being sent.
MANY = 8

U = np.uint64
ENTRY = np.dtype([("anchor", "<u8"), ("context", "<u8"), ("doc", "<i8"), ("lo", "<i4"), ("hi", "<i4"), ("many", "<i4")])
STRING = np.dtype([("a", "<u8"), ("b", "<u8"), ("doc", "<i8"), ("at", "<i4"), ("near", "<i8")])      # near: where its chunk holds it
#: A smaller suffix that is sorted: where it is, and a bit for each string that it stands for (itself, and those 1, 2, ... bytes before).
SMALLER = np.dtype([("doc", "<i8"), ("at", "<i4"), ("stands", "<u8")])
#: Most bytes from an induced suffix to the smaller one that it leads to; suffixes farther off are sorted directly.
LEAD = 32
RUN = np.dtype([("doc", "<i8"), ("lo", "<i4"), ("hi", "<i4"), ("open", "<i4")])      # open: step 3 decides
RUNS = "doc long, open boolean, data binary"
KIND = "bucket int, runs boolean, data binary"
SORTED = "bucket int, runs boolean, data binary, keys binary, leads binary, n int"

_RNG = np.random.default_rng(20_231)
BYTES = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
STEPS = [U(int(k) | 3) for k in _RNG.integers(1 << 60, 1 << 62, 6)]                   # 3 modulo 4


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0x9E3779B97F4A7C15)
    return h ^ (h >> U(29))


class Hashes:
    """Hashes of the 32 and 64 bytes from each position of ``data``, by doubling."""

    def __init__(self, data: np.ndarray, length: int):
        h, size = BYTES[data], 1
        for step in STEPS:
            if size == GRAM:
                self.gram = mixed(h)
            if len(h) <= size:
                h = h[:0]
                break
            h = h[:-size] * step + h[size:]
            size *= 2
        if len(data) < GRAM:
            self.gram = h[:0]
        self.block, self.length = h, length

    def strings(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of a string's first and last 64 bytes; those of one longer than both also hold its middle."""
        first, last = self.block[at], self.block[at + self.length - BLOCK]
        if self.length > 2 * BLOCK:                                                   # at most 3 * BLOCK
            first = mixed(first) * U(3) + mixed(self.block[at + BLOCK]) * U(5)
        return first, last

    def contexts(self, lo: np.ndarray, hi: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Of the bytes from lo to the end of the string at hi: blocks that cover them."""
        last = hi + self.length - BLOCK
        out = mixed(self.block[lo]) * U(3) + mixed(self.block[(lo + last) // 2]) * U(5) + mixed(self.block[last]) * U(7)
        # a run has at most length - GRAM + 1 strings; from some length on, three blocks leave gaps around the middle one
        if 2 * self.length - GRAM > 3 * BLOCK:
            for i, by in ((1, U(11)), (3, U(13))):
                out += mixed(self.block[lo + (last - lo) * i // 4]) * by
        return mixed(out + (hi - lo).astype(U) * U(257) + (anchor - lo).astype(U))


def anchors(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int):
    """(text, anchor hash, context, lo, hi) of the runs of strings with one anchor; lo and hi are relative to the text."""
    hashes = Hashes(data, length)
    none = tuple(np.zeros(0, k) for k in (np.int64, U, U, np.int64, np.int64))
    span = length - GRAM + 1
    if len(hashes.gram) < span:
        return none
    # smallest gram, leftmost first, of each ``span`` grams
    key = (hashes.gram >> U(32) << U(32)) | np.arange(len(hashes.gram), dtype=U)
    width, low = 1, key
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:len(low) - (span - width)], low[span - width:])
    owner = np.repeat(np.arange(len(sizes)), np.maximum(sizes - length + 1, 0))
    at = np.arange(len(owner)) + np.repeat(starts - np.cumsum(np.maximum(sizes - length + 1, 0)) + np.maximum(sizes - length + 1, 0),
                                           np.maximum(sizes - length + 1, 0))
    if not len(at):
        return none
    anchor = (low[at] & U(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    text, lo, hi, anchor = owner[first], at[first], at[last], anchor[first]
    return text, hashes.gram[anchor], hashes.contexts(lo, hi, anchor), lo - starts[text], hi - starts[text]


def chunks_of(texts: list[bytes]):
    """(first text, data, starts, sizes) of about CHUNK bytes each; a longer text is a chunk of its own."""
    lo = 0
    while lo < len(texts):
        hi, size = lo + 1, len(texts[lo])
        while hi < len(texts) and size + len(texts[hi]) <= CHUNK:
            size += len(texts[hi])
            hi += 1
        sizes = np.array([len(t) for t in texts[lo:hi]])
        yield lo, np.frombuffer(b"".join(texts[lo:hi]), np.uint8), np.cumsum(sizes) - sizes, sizes
        lo = hi


def united(runs: np.ndarray) -> np.ndarray:
    """Runs sorted by document, those that touch as one."""
    if len(runs) < 2:
        return runs
    runs = runs[np.lexsort((runs["lo"], runs["doc"], runs["open"]))]
    # hi is the largest so far within the document: runs of one kind and document overlap only if they repeat
    new = (runs["doc"][1:] != runs["doc"][:-1]) | (runs["open"][1:] != runs["open"][:-1]) | (runs["lo"][1:] > runs["hi"][:-1] + 1)
    first = np.flatnonzero(np.concatenate([[True], new]))
    out = runs[first]
    out["hi"] = np.maximum.reduceat(runs["hi"], first)
    return out


def runs_of(entries: np.ndarray, is_open: bool) -> np.ndarray:
    out = np.zeros(len(entries), RUN)
    for c in ("doc", "lo", "hi"):
        out[c] = entries[c]
    out["open"] = is_open
    return out


def sorted_entries(entries: np.ndarray):
    """Entries in order, and where an anchor and where a context begins."""
    entries = entries[np.lexsort((entries["lo"], entries["doc"], entries["context"], entries["anchor"]))]
    anchor = np.concatenate([[True], entries["anchor"][1:] != entries["anchor"][:-1]])
    context = anchor | np.concatenate([[True], entries["context"][1:] != entries["context"][:-1]])
    return entries, anchor, context


def reduced(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entries to send, runs that are known already) of one task."""
    entries, anchor, context = sorted_entries(entries)
    repeats, firsts = entries[~context], entries[context]
    group = np.cumsum(anchor[context]) - 1
    many = (np.bincount(group) > MANY)[group]
    send = firsts[~many | anchor[context]]                    # of an anchor with many contexts, one
    send["many"] = many[~many | anchor[context]]
    return send, np.concatenate([runs_of(repeats, False), runs_of(firsts[many], True)])


def decided(entries: np.ndarray) -> np.ndarray:
    """Runs of the entries of one bucket: repeats, and open ones of anchors with several contexts."""
    entries, anchor, context = sorted_entries(entries)
    group = np.cumsum(anchor) - 1
    several = (np.bincount(group, weights=context) > 1) | (np.bincount(group, weights=entries["many"]) > 0)
    return np.concatenate([runs_of(entries[~context], False), runs_of(entries[context & several[group]], True)])


def repeated_strings(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first of each kind, runs of the others)."""
    strings = strings[np.lexsort((strings["at"], strings["doc"], strings["b"], strings["a"]))]
    first = np.concatenate([[True], (strings["a"][1:] != strings["a"][:-1]) | (strings["b"][1:] != strings["b"][:-1])])
    rest = strings[~first]
    runs = np.zeros(len(rest), RUN)
    runs["doc"], runs["lo"], runs["hi"] = rest["doc"], rest["at"], rest["at"]
    return strings[first], united(runs)


def by_bucket(rows: np.ndarray, bucket: np.ndarray, runs: bool) -> pa.RecordBatch:
    """One row per bucket, with its share of ``rows``."""
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(rows) else np.zeros(0, int)
    ends = np.concatenate([first[1:], [len(rows)]]).astype(int) if len(rows) else first
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[first].astype(np.int32)), pa.array(np.full(len(first), runs)),
         pa.array([rows[i:j].tobytes() for i, j in zip(first, ends, strict=True)], pa.binary())], names=["bucket", "runs", "data"])


def run_rows(runs: np.ndarray) -> pa.RecordBatch:
    """(doc, open, data): one row per document, and whether it has open runs."""
    runs = runs[np.argsort(runs["doc"], kind="stable")]
    first = np.flatnonzero(np.concatenate([[True], runs["doc"][1:] != runs["doc"][:-1]])) if len(runs) else np.zeros(0, int)
    ends = np.concatenate([first[1:], [len(runs)]]).astype(int) if len(runs) else first
    return pa.RecordBatch.from_arrays(
        [pa.array(runs["doc"][first]), pa.array([bool(runs["open"][i:j].any()) for i, j in zip(first, ends, strict=True)], pa.bool_()),
         pa.array([runs[i:j].tobytes() for i, j in zip(first, ends, strict=True)], pa.binary())], names=["doc", "open", "data"])


def find_entries(length: int, buckets: int):
    """Step 1, over (doc, text)."""

    def task(batches):
        waiting, n = [], 0

        def send():
            entries, runs = reduced(np.concatenate(waiting))
            waiting.clear()
            yield by_bucket(entries, entries["anchor"] % U(buckets), False)
            runs = united(runs)
            yield by_bucket(runs, mixed(runs["doc"].astype(U)) % U(buckets), True)
        for batch in batches:
            docs = batch.column(0).to_numpy()
            texts = [t.encode() for t in batch.column(1).to_pylist()]
            for lo, data, starts, sizes in chunks_of(texts):
                text, anchor, context, first, last = anchors(data, starts, sizes, length)
                entries = np.zeros(len(text), ENTRY)
                entries["anchor"], entries["context"], entries["doc"] = anchor, context, docs[lo + text]
                entries["lo"], entries["hi"] = first, last
                waiting.append(entries)
                n += len(entries)
                if n >= MOST_ENTRIES:
                    yield from send()
                    n = 0
        if n:
            yield from send()
    return task


def decide(dtype: np.dtype, decision):
    """Step 2, over (bucket, runs, data): whole buckets in, (doc, data) of runs out."""

    def task(batches):
        buckets: dict[int, list[bytes]] = {}
        for batch in batches:
            known = []
            for bucket, runs, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if runs:
                    known.append(np.frombuffer(data, RUN))
                else:
                    buckets.setdefault(bucket, []).append(data)
            if known:
                yield run_rows(np.concatenate(known))
        while buckets:
            yield run_rows(united(decision(np.frombuffer(b"".join(buckets.popitem()[1]), dtype))))
    return task


def runs_in(column) -> list[np.ndarray]:
    """The runs of each document from its list of binaries."""
    return [np.frombuffer(b"".join(x), RUN) if x else np.zeros(0, RUN) for x in column.to_pylist()]


def next_smaller(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each position the next one, itself included, whose suffix is smaller than its successor's; -1 where none is left in the text.

    A text's end is smaller than any byte.
    """
    n = len(data)
    ends = np.zeros(n + 1, bool)
    ends[starts + sizes] = True
    after = np.concatenate([data[1:].astype(np.int16), [0]])
    after[ends[1:]] = -1                                                       # of the last byte of a text
    step = np.sign(after - data)                                              # 1: smaller by the first byte, 0: as its successor
    at = np.arange(n)
    decided = np.minimum.accumulate(np.where(step != 0, at, n)[::-1])[::-1]     # a text's last byte is decided, so this stays in the text
    smaller = step[decided] > 0
    nxt = np.minimum.accumulate(np.where(smaller, at, n)[::-1])[::-1]
    last = np.repeat(starts + sizes, sizes)
    return np.where(nxt < last, nxt, -1)


def smaller_suffixes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, text: np.ndarray, at: np.ndarray, length: int, nxt: np.ndarray):
    """(text, place, stands, keys, leads): the smaller suffixes that the strings at ``at`` (rising, in their texts) lead to.

    ``keys``: their first ``length`` bytes, ``leads``: the LEAD bytes before, a row a suffix, zeros past the text.
    """
    where = starts[text] + at
    to = nxt[where]
    far = (to < 0) | (to - where > LEAD)
    to = np.where(far, where, to)                                             # sorted directly
    order = np.argsort(to, kind="stable")
    text, where, to = text[order], where[order], to[order]
    first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
    stands = np.bitwise_or.reduceat(U(1) << (to - where).astype(U), first)
    text, to = text[first], to[first]
    keys = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(length, np.uint8)]), length)[to]
    leads = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(LEAD, np.uint8), data]), LEAD)[to]
    end, begin = (starts + sizes)[text], starts[text]
    for i in np.flatnonzero(to + length > end):
        keys[i, end[i] - to[i]:] = 0
    for i in np.flatnonzero(to - LEAD < begin):
        leads[i, :LEAD - (to[i] - begin[i])] = 0
    # bytes that no string stands for are zeros
    farthest = np.log2(stands.astype(np.float64)).astype(np.int64)            # the highest bit of at most LEAD + 1
    leads *= np.arange(LEAD, 0, -1) <= farthest[:, None]
    return text, to - starts[text], stands, keys, leads


def word(rows: np.ndarray, start: int = 0) -> np.ndarray:
    """Eight bytes of each row as a number that orders like them."""
    return np.ascontiguousarray(rows[:, start:start + 8]).view(">u8")[:, 0].astype(U)


def sorted_by_bucket(rows: np.ndarray, keys: np.ndarray, leads: np.ndarray, length: int, buckets: int) -> pa.RecordBatch:
    """One row per bucket, with its smaller suffixes.  A bucket holds all suffixes of the same first length - LEAD bytes,
    so strings that lead to them and are equal meet."""
    h = np.zeros(len(keys), U)
    for i in range(0, length - LEAD - 7, 8):
        h = mixed(h * U(3) + word(keys, i))
    bucket = (h % U(buckets)).astype(np.int64)
    order = np.lexsort((*[word(keys, i) for i in (24, 16, 8, 0)], bucket))           # neighbours pack well
    rows, keys, leads, bucket = rows[order], keys[order], leads[order], bucket[order]
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    cuts = list(zip(first, [*first[1:], len(rows)], strict=True))
    codec = pa.Codec("zstd", 3)
    packed = lambda x: pa.array([codec.compress(x[i:j].tobytes(), asbytes=True) for i, j in cuts], pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[first].astype(np.int32)), pa.array(np.full(len(first), False)), packed(rows), packed(keys), packed(leads),
         pa.array([int(j - i) for i, j in cuts], pa.int32())], names=["bucket", "runs", "data", "keys", "leads", "n"])


def find_strings(length: int, buckets: int):
    """Step 3, over (doc, text, data): the smaller suffixes that the strings of open runs lead to."""

    def task(batches):
        waiting, chunks, n, held = [], [], 0, 0

        def send():
            strings, runs = repeated_strings(np.concatenate(waiting))
            parts = []
            for c, (docs, data, starts, sizes) in enumerate(chunks):
                mine = strings[strings["near"] >> 32 == c]
                mine = mine[np.lexsort((mine["at"], mine["near"]))]
                if len(mine):
                    text = (mine["near"] & 0xFFFFFFFF).astype(np.int64)
                    text, at, stands, keys, leads = smaller_suffixes(data, starts, sizes, text, mine["at"].astype(np.int64), length,
                                                                    next_smaller(data, starts, sizes))
                    rows = np.zeros(len(text), SMALLER)
                    rows["doc"], rows["at"], rows["stands"] = docs[text], at, stands
                    parts.append((rows, keys, leads))
            waiting.clear()
            chunks.clear()
            if parts:
                yield sorted_by_bucket(*[np.concatenate(x) for x in zip(*parts, strict=True)], length, buckets)
            known = by_bucket(united(runs), mixed(united(runs)["doc"].astype(U)) % U(buckets), True)
            none = pa.nulls(len(known), pa.binary())
            yield pa.RecordBatch.from_arrays([*known.columns, none, none, pa.nulls(len(known), pa.int32())],
                                             names=["bucket", "runs", "data", "keys", "leads", "n"])
        for batch in batches:
            docs = batch.column(0).to_numpy()
            texts = [t.encode() for t in batch.column(1).to_pylist()]
            runs = runs_in(batch.column(2))
            for lo, data, starts, sizes in chunks_of(texts):
                spans = [united(r[r["open"] == 1]) for r in runs[lo:lo + len(sizes)]]
                text = np.repeat(np.arange(len(sizes)), [len(s) for s in spans])
                spans = np.concatenate(spans)
                if not len(spans):
                    continue
                count = (spans["hi"] - spans["lo"] + 1).astype(np.int64)
                text = np.repeat(text, count)
                at = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(spans["lo"].astype(np.int64), count)
                strings = np.zeros(len(at), STRING)
                strings["a"], strings["b"] = Hashes(data, length).strings(starts[text] + at)
                strings["doc"], strings["at"], strings["near"] = docs[lo + text], at, len(chunks) << 32 | text
                waiting.append(strings)
                chunks.append((docs[lo:lo + len(sizes)], data, starts, sizes))
                n, held = n + len(strings), held + len(data)
                if n >= MOST_ENTRIES or held >= MOST_TEXT:
                    yield from send()
                    n = held = 0
        if n:
            yield from send()
    return task


def common_prefixes(keys: np.ndarray) -> np.ndarray:
    """Of each row with the one before, in bytes; 0 for the first."""
    out = np.zeros(len(keys), np.int64)
    for i in range(1, len(keys), 1 << 18):                                     # a bounded table of comparisons
        j = min(len(keys), i + (1 << 18))
        other = keys[i:j] != keys[i - 1:j - 1]
        out[i:j] = np.where(other.any(axis=1), other.argmax(axis=1), keys.shape[1])
    return out


def induced(rows: np.ndarray, keys: np.ndarray, leads: np.ndarray, length: int) -> np.ndarray:
    """Runs of the strings of one bucket that start earlier, too: direct sort of the smaller suffixes, then a scan for those that lead to them."""
    order = np.argsort(np.ascontiguousarray(keys).view(f"S{length}")[:, 0], kind="stable")
    rows, keys, leads = rows[order], keys[order], leads[order]
    common = common_prefixes(keys)
    found = []
    for lead in range(LEAD + 1):
        mine = np.flatnonzero(rows["stands"] >> U(lead) & U(1))
        if not len(mine):
            continue
        place = np.cumsum(common < length - lead)[mine]                        # the same where the common prefix fills the rest
        doc, at = rows["doc"][mine], rows["at"][mine] - lead
        words = [word(np.where(np.arange(LEAD - 8 * i - 8, LEAD - 8 * i) >= LEAD - lead, leads[mine, LEAD - 8 * i - 8:LEAD - 8 * i], 0).astype(np.uint8))
                 for i in range(-(-lead // 8))]
        order = np.lexsort((at, doc, *words, place))
        new = np.concatenate([[True], place[order][1:] != place[order][:-1]])
        for w in words:
            new[1:] |= w[order][1:] != w[order][:-1]
        again = order[~new]
        runs = np.zeros(len(again), RUN)
        runs["doc"], runs["lo"], runs["hi"] = doc[again], at[again], at[again]
        found.append(runs)
    return united(np.concatenate(found)) if found else np.zeros(0, RUN)


def sort_buckets(length: int):
    """Step 3, over (bucket, runs, data, keys, leads, n): whole buckets in, (doc, data) of runs out."""

    def unpacked(parts: list[bytes], n: list[int], width: int) -> bytes:
        return b"".join(pa.decompress(p, k * width, "zstd", asbytes=True) for p, k in zip(parts, n, strict=True))

    def task(batches):
        buckets: dict[int, list[tuple]] = {}
        for batch in batches:
            known = []
            for bucket, runs, *data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if runs:
                    known.append(np.frombuffer(data[0], RUN))
                else:
                    buckets.setdefault(bucket, []).append(data)
            if known:
                yield run_rows(np.concatenate(known))
        while buckets:
            data, keys, leads, n = zip(*buckets.popitem()[1], strict=True)
            table = lambda parts, width: np.frombuffer(unpacked(parts, n, width), np.uint8).reshape(-1, width)
            yield run_rows(induced(np.frombuffer(unpacked(data, n, SMALLER.itemsize), SMALLER), table(keys, length), table(leads, LEAD), length))
    return task


def spans_of(runs: np.ndarray, length: int) -> list[tuple[int, int]]:
    """(start, end) of the bytes that the strings of the runs cover, those that touch as one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((lo, hi + length) for lo, hi in runs[["lo", "hi"]][runs["open"] == 0].tolist()):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        else:
            out.append((lo, hi))
    return out


def cut(length: int, with_text: bool):
    """Step 4, over (doc, id, text, data)."""

    def task(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for text, runs in zip(batch.column(2).to_pylist(), runs_in(batch.column(3)), strict=True):
                data = text.encode()
                spans, parts, at, removed = spans_of(runs, length), [], 0, 0
                for lo, hi in spans:
                    parts.append(data[at:lo])
                    removed += hi - lo
                    at = hi
                kept = b"".join([*parts, data[at:]])
                for values, x in zip(out, (len(data), removed, len(spans), hashlib.sha256(kept).hexdigest(),
                                           [x for s in spans for x in s], kept if with_text else None), strict=True):
                    values.append(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), *[pa.array(x, pa.int64()) for x in out[:3]], pa.array(out[3], pa.string()),
                 pa.array(out[4], pa.list_(pa.int64())), pa.array(out[5], pa.binary())],
                names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])
    return task


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100,
                   with_text: bool = True) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, end, ...), kept (bytes).

    Documents stand in the order of their ids (nulls first; rows that repeat an
    id in input order).  Null and empty texts, and those shorter than ``length`` bytes, stay
    whole.  ``length``: from 96 to 160 bytes.  Other columns play no part.
    """
    if not 96 <= length <= 160:
        raise ValueError("length must be from 96 to 160")
    docs, _ = numbered(docs, id_col, text_col)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0                     # one row
    buckets = max(64, -(-size // BUCKET))
    entries = docs.select("doc", "text").mapInArrow(find_entries(length, buckets), KIND)
    runs = materialise(entries.repartition(buckets, "bucket").mapInArrow(decide(ENTRY, decided), RUNS), "runs")
    # one row per document with what is known of it: bounded by the document
    own = lambda rows: rows.groupBy("doc").agg(F.collect_list("data").alias("data"))
    texts = docs.select("doc", "text").join(own(runs.filter("open")), "doc")
    strings = texts.select("doc", "text", "data").mapInArrow(find_strings(length, buckets), SORTED)
    more = strings.repartition(buckets, "bucket").mapInArrow(sort_buckets(length), RUNS)
    more = materialise(more, "runs")
    known = own(runs.unionByName(more))
    kind = docs.schema["id"].dataType.simpleString()
    return docs.join(known, "doc", "left").select("doc", "id", "text", "data").mapInArrow(
        cut(length, with_text),
        f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>, kept binary")
