"""Order MinHash against a plain version of its definition, on made rows and on the given table."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from ledgerline.llm import fingerprints as FP
from ledgerline.llm import queries as Q

M32, M64 = (1 << 32) - 1, (1 << 64) - 1


def mix(x):
    x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & M64
    x = ((x ^ (x >> 29)) * 0x9E3779B97F4A7C15) & M64
    return x ^ (x >> 32)


def plain(scheme, text):
    """The definition, one k-mer at a time: numbered k-mers, the smallest of each function, back in order, hashed."""
    points = [ord(c) for c in text]
    points += [0x110000] * (scheme.k + scheme.length - 1 - len(points))
    codes, seen, drawn = [], {}, []
    for i in range(len(points) - scheme.k + 1):
        code = 0
        for p in points[i:i + scheme.k]:
            code = (code * 0x9E3779B97F4A7C15 + mix(p + 1)) & M64
        code = mix(code)
        n = seen[code >> 24] = seen.get(code >> 24, -1) + 1
        codes.append(code)
        drawn.append(mix((code + n * 0xD6E8FEB86659FD93) & M64) >> 32)
    a, b = ([int(x) for x in f[:, 0]] for f in scheme.functions)
    out = []
    for i in range(scheme.size):
        least = sorted((((a[i] * x + b[i]) & M32), p) for p, x in enumerate(drawn))[:scheme.length]
        t = mix(i)
        for p in sorted(p for _, p in least):
            t = mix((t * 0x9E3779B97F4A7C15 + codes[p]) & M64)
        out.append(t >> 48)
    return "".join(f"{x:04x}" for x in out)


def plain_rows(scheme, rows):
    """against_next over (id, text) rows with unique ids, in one list."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    share = lambda x, y: sum(x[j:j + 4] == y[j:j + 4] for j in range(0, len(x), 4)) / (len(x) // 4)
    out = {}
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(t) // 2
        edited = "".join(list(t)[:len(t) - half] + list(after)[:half])
        own, other, following = (plain(scheme, x) for x in (t, edited, after))
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), own, other, share(own, other), share(own, following))
    return out


def columns(r):
    return r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next


@pytest.mark.parametrize("scheme", [FP.OrderMinHash(), FP.OrderMinHash(k=3, length=4, size=16, seed=1), FP.OrderMinHash(1, 1, 8, 2)])
def test_signature_is_the_definition(scheme, monkeypatch):
    monkeypatch.setattr(FP, "CHUNK", 50)                              # texts of several chunks
    rng = random.Random(5)
    texts = ["", "a", "ab" * 3, "abcdefgh", "aaaaaaaaaaaaaaaaaaaaaaaa", "naïve \U0001f600 text 中文" * 20]
    texts += ["".join(rng.choice("ab c") for _ in range(rng.randrange(400))) for _ in range(20)]
    for t in texts:
        assert FP.as_text(scheme.signature(t)) == plain(scheme, t)


def test_order_of_blocks_counts_and_edits_lower_the_likeness():
    scheme, rng = FP.OrderMinHash(), random.Random(3)
    text = "".join(rng.choice("abcdefghij ") for _ in range(4000))
    likeness = lambda x, y: float((scheme.signature(x) == scheme.signature(y)).mean())
    edits = [text[:2000] + "#" * n + text[2000 + n:] for n in (0, 20, 400, 1500)]
    values = [likeness(text, e) for e in edits]
    assert values[0] == 1 and values[1] > 0.9 and values[0] > values[1] > values[2] > values[3] > 0
    moved = text[2000:] + text[:2000]                                  # the same k-mers but for the seam, in another order
    assert likeness(text, moved) < 0.75


def test_very_long_text_is_numbered_like_a_short_one(monkeypatch):
    import numpy as np
    codes = FP.OrderMinHash(k=2).kmers("abababab" * 50)
    n = FP.OrderMinHash.occurrences(codes)
    place = np.arange(len(codes))
    assert (n == place // 2).all()


def test_rows_against_the_plain_version(spark):
    rng = random.Random(9)
    rows = [(i, None if i % 7 == 0 else "".join(rng.choice("ab cd") for _ in range(rng.choice([0, 1, 5, 30, 300]))))
            for i in rng.sample(range(1000), 60)]
    rows += [(2000, "same text " * 9), (1999, "same text " * 9), (None, "an id that is null"), (3000, "x" * 70_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(1).alias(c) for c in ("id", "part", "at", "after", "_to")])
    scheme = FP.OrderMinHash(size=8)
    got = {r.id: columns(r) for r in FP.against_next(docs.repartition(5), scheme=scheme).collect()}
    assert got == plain_rows(scheme, rows)
    assert got[2000][5] == 1.0
    slim = {r.id: (r.n_chars, r.fingerprint) for r in FP.fingerprints(docs, scheme=scheme).collect()}
    assert slim == {k: (v[0], v[2]) for k, v in got.items()}


def test_likeness_column(spark):
    scheme = FP.OrderMinHash(size=16)
    texts = ["some words in a row, and more of them", "some words in a row, and less of them", ""]
    df = spark.createDataFrame([(FP.as_text(scheme.signature(a)), FP.as_text(scheme.signature(b))) for a in texts for b in texts], "a string, b string")
    want = [float((scheme.signature(a) == scheme.signature(b)).mean()) for a in texts for b in texts]
    assert [r[0] for r in df.select(FP.likeness("a", "b")).collect()] == want


def test_empty_lone_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert FP.against_next(spark.createDataFrame([], schema)).collect() == []
    assert FP.fingerprints(spark.createDataFrame([], schema)).collect() == []
    lone = FP.against_next(spark.createDataFrame([(4, "a lone text of a few words")], schema)).collect()
    assert [(r.id, r.near_next) for r in lone] == [(4, 1.0)]
    rows = [(1, "the very same row twice over"), (1, "the very same row twice over"), (1, None)]
    got = FP.against_next(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 3 and sorted(r.near_next for r in got)[-1] == 1.0 and {r.id for r in got} == {1}


def test_the_query_on_the_given_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = {r.doc_id: columns(r) for r in Q.queries()["op11_fingerprints"](spark, SF_SMALL).collect()}
    few = plain_rows(FP.OrderMinHash(), [r for r in sorted(rows, reverse=True)[:12]])
    assert len(got) == len(rows)
    for i in sorted(few, reverse=True)[:-1]:                            # the twelfth follows another here
        assert got[i] == few[i]
    ordered = sorted(rows, reverse=True)
    for (i, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        assert got[i][1] == hashlib.sha256(FP.edit(t or "", after or "").encode()).hexdigest()
