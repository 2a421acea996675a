import hashlib
import random

import numpy as np
import pytest
from conftest import SF_SMALL
from ledgerline.llm import repeats as R

SCHEMA = "doc_id long, text string, doc string, data int, open boolean"


def plain(rows, length=100):
    seen, out = set(), []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            key = b[p:p + length]
            if key in seen:
                gone[p:p + length] = True
            seen.add(key)
        edge = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out.append((d, len(b), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def check(spark, rows, length=100):
    df = spark.createDataFrame([(d, t, "x", 1, True) for d, t in rows], SCHEMA).coalesce(1)
    got = [tuple(r)[:5] for r in R.remove_repeats(df.repartition(5, "doc_id"), length=length).collect()]
    order = lambda x: (x[0] is not None, x[0] or 0, x[1:])
    assert sorted(got, key=order) == sorted(plain(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), length), key=order)


def made(rng, n):
    base = ["".join(rng.choice("abcdefghij \n") for _ in range(400)) for _ in range(6)]
    rows = []
    for i in range(n):
        t = ""
        for _ in range(rng.randint(0, 5)):
            b, a = rng.choice(base), rng.randint(0, 350)
            t += b[a:a + rng.randint(50, 300)] + "".join(rng.choice("xyz ") for _ in range(rng.randint(0, 60)))
        if rng.random() < 0.1:
            t = rng.choice(["a", "ab", "é"]) * rng.randint(0, 400)
        rows.append((i * 7 % 1009 - 100, t))
    return rows


@pytest.mark.parametrize("many", [R.MANY, 0])
def test_against_plain_version(spark, many, monkeypatch):
    monkeypatch.setattr(R, "MANY", many)
    rows = made(random.Random(3), 300) + [(5000, None), (5001, ""), (5002, "a" * 99), (5003, "q" * 60_000)]
    check(spark, rows)


def test_common_line_in_different_surroundings(spark):
    rng = random.Random(8)
    line = "a line of boilerplate that is in every document of the corpus, and is about as long as it takes to matter here"
    rows = [(i, "".join(rng.choice("klmnop ") for _ in range(rng.randint(0, 150))) + line[rng.randint(0, 12):len(line) - rng.randint(0, 5)]
             + "".join(rng.choice("klmnop ") for _ in range(rng.randint(0, 150)))) for i in range(300)]
    check(spark, rows)
    check(spark, rows, 96)


def test_null_and_repeated_ids(spark):
    rng = random.Random(1)
    t = "".join(rng.choice("abcdef") for _ in range(300))
    df = spark.createDataFrame([(None, t, "x", 1, True), (None, t, "x", 1, True), (4, t, "x", 1, True), (4, t[:150], "x", 1, True), (9, "z" + t, "x", 1, True)], SCHEMA)
    got = sorted((r.n_removed, r.n_bytes) for r in R.remove_repeats(df).collect())
    assert got == [(0, 300), (150, 150), (300, 300), (300, 300), (300, 301)]
    assert R.remove_repeats(df.limit(0)).count() == 0


def test_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    check(spark, rows)


def covered(n, length, places_of):
    """Whether a change of any one of the first ``n`` bytes changes the hash."""
    data = np.frombuffer(random.Random(length).randbytes(n), np.uint8)
    was = places_of(R.Hashes(data, length))
    for i in range(n):
        other = data.copy()
        other[i] ^= 1
        if places_of(R.Hashes(other, length)) == was:
            return False
    return True


@pytest.mark.parametrize("length", [96, 100, 112, 113, 128, 129, 160])
def test_hashes_cover_every_byte(length):
    at = np.array([0])
    assert covered(length, length, lambda h: [int(x[0]) for x in h.strings(at)])
    for n in (1, 2, length // 2, length - R.GRAM, length - R.GRAM + 1):             # strings of a run
        assert covered(length + n - 1, length, lambda h: int(h.contexts(at, at + n - 1, at)[0])), n


@pytest.mark.parametrize("many", [8, 0])
@pytest.mark.parametrize("length", [113, 160])
def test_longest_strings_against_plain_version(spark, length, many, monkeypatch):
    monkeypatch.setattr(R, "MANY", many)
    rng = random.Random(length)
    rows = made(rng, 60)
    base = "".join(rng.choice("abcdefgh ") for _ in range(300))
    for i in range(60, 70):                                                         # copies that differ in one byte each
        at = rng.randrange(300)
        rows.append((2000 + i, base[:at] + "#" + base[at + 1:]))
    check(spark, rows, length)


def texts_of(rng, n):
    """Texts over few letters, with runs of one letter and of falling ones, NULs and ends in the middle of a repeat."""
    some = [rng.choice(["", "a", "b" * 50, "zyxwvutsrqponmlkjihgfedcba" * 4, "ab" * 30, "\0" * 40, "".join(rng.choice("ab") for _ in range(130))]) for _ in range(9)]
    return ["".join(rng.choice(some) for _ in range(rng.randint(0, 6))).encode() for _ in range(n)]


def test_next_smaller_suffix_against_the_suffixes_themselves():
    rng = random.Random(6)
    for _ in range(40):
        texts = texts_of(rng, 5) + [b"", b"ba", b"aab", b"aaa"]
        sizes = np.array([len(t) for t in texts])
        starts = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(texts), np.uint8)
        got = R.next_smaller(data, starts, sizes)
        for t, at in zip(texts, starts, strict=True):
            smaller = [p for p in range(len(t)) if t[p:] < t[p + 1:]]
            assert got[at:at + len(t)].tolist() == [min((at + s for s in smaller if s >= p), default=-1) for p in range(len(t))]


@pytest.mark.parametrize("length", [96, 100, 160])
def test_two_stages_find_what_a_plain_search_finds(length):
    rng = random.Random(length)
    for _ in range(25):
        texts = texts_of(rng, 12)
        sizes = np.array([len(t) for t in texts])
        starts = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(texts), np.uint8)
        strings = [(d, p) for d, t in enumerate(texts) for p in range(len(t) - length + 1)]
        if not strings:
            continue
        text, at = (np.array(x) for x in zip(*strings, strict=True))
        text, at, stands, keys, leads = R.smaller_suffixes(data, starts, sizes, text, at, length, R.next_smaller(data, starts, sizes))
        assert sum(int(s).bit_count() for s in stands) == len(strings) > len(stands) or len(stands) == len(strings)
        rows = np.zeros(len(text), R.SMALLER)
        rows["doc"], rows["at"], rows["stands"] = text, at, stands
        got = {(int(r["doc"]), p) for r in R.induced(rows, keys, leads, length) for p in range(r["lo"], r["hi"] + 1)}
        seen, want = set(), set()
        for d, p in strings:
            key = texts[d][p:p + length]
            want |= {(d, p)} if key in seen else set()
            seen.add(key)
        assert got == want


def test_the_query_on_the_given_table(spark):
    from ledgerline.llm import queries as Q
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect())
    got = sorted(tuple(r) for r in Q.queries()["op9_repeats"](spark, SF_SMALL).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == sorted(plain(rows))
