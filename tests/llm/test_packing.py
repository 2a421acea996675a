import random
import zlib
from array import array

import public_tokenizers
import pytest
from ledgerline.llm import packing as P

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def ids():
    return P.Ids(FILE)


def own(ids, text):
    return array("I", ids.own.encode(text, add_special_tokens=False).ids).tobytes()


def test_ids_equal_the_tokenizers(ids):
    rng = random.Random(5)
    texts = ["", " ", "<|endoftext|> x", "a" * 5000, "ab " * 500 + "y" * 3000, "it's 12 a's 'll\n\n x\t\ty"]
    for _ in range(4000):
        if rng.random() < 0.5:
            texts.append("".join(rng.choice("ab \n\t'1.é  \x85\x1c​!sl中文字١²½") for _ in range(rng.randint(0, 14))))
        else:
            texts.append("".join(chr(rng.choice([rng.randint(0, 0x2FF), rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x1FFFF), 32])) for _ in range(12)))
    assert [t for t in texts if ids.of(t) != own(ids, t)] == []


def test_balanced_places_every_token_and_wastes_little():
    rng = random.Random(2)
    for trial in range(60):
        lengths = [rng.randint(1, rng.choice([3, 100, 1023])) for _ in range(rng.randint(0, 400))]
        out = P.balanced(lengths, 1024, 1.0, 1 / 1024)
        assert len(out) == -(-sum(lengths) // 1024)
        got = [[] for _ in lengths]
        for s in out:
            assert 0 < sum(n for _, _, n in s) <= 1024
            for tail, start, n in s:
                assert n > 0
                got[tail].append((start, n))
        for parts, n in zip(got, lengths, strict=True):
            at = 0
            for start, k in sorted(parts):
                assert start == at
                at += k
            assert at == n


def test_cost_is_balanced():
    lengths = [900] * 10 + [100] * 110
    cost = [sum(n + n * n / 1024 for _, _, n in s) for s in P.balanced(lengths, 1024, 1.0, 1 / 1024)]
    assert len([c for c in cost if c > 850]) >= 10                             # no two long documents together


def test_pieces_are_gapless_and_match_the_texts(spark, ids):
    texts = [None, "", "a", "word " * 3000, "same text", "same text", "日本 " * 400, "x" * 20_000] * 4
    rows = [(None if i == 3 else i // 2, t, "c", 5) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string, offset int").repartition(3)
    pieces = P.pack(df, FILE, window=8)
    got = pieces.collect()
    for seq in {p.sequence_id for p in got}:
        at = 0
        for p in sorted((p for p in got if p.sequence_id == seq), key=lambda p: p.offset):
            assert p.offset == at and p.length > 0 and zlib.crc32(p.ids) == p.ids_crc32
            at += p.length
        assert at <= 1024
    want = {}
    for doc, t, *_ in rows:
        want.setdefault(doc, []).append(own(ids, t or "") + b"\0\0\0\0")
    for doc, whole in want.items():
        mine = [p for p in got if p.doc_id == doc]
        assert sum(p.length for p in mine) == sum(len(w) // 4 for w in whole)
        for p in mine:
            assert any(len(w) // 4 == p.doc_tokens and w[4 * p.start:4 * (p.start + p.length)] == p.ids for w in whole)
    whole = P.sequences(pieces).collect()
    assert sum(s.tokens for s in whole) == sum(p.length for p in got) and all(len(s.ids) == 4 * s.tokens for s in whole)
    waste = sum(1024 - s.tokens for s in whole)
    assert waste < 1024 * 8


def test_empty_table(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string"), FILE).count() == 0


def test_strings_of_added_tokens_give_the_ids_of_a_fresh_tokenizer(ids):
    from tokenizers import Tokenizer
    fresh, end = Tokenizer.from_file(FILE), "<|endoftext|>"
    texts = [end, f"hello {end} x", f"a{end}b", f" {end}  {end}{end}\n", "y" * 3000 + end, end[:-1], end[1:], "<| endoftext |>", f"{end[:5]}{end}{end[5:]}"]
    assert fresh.encode(texts[1], add_special_tokens=False).ids == [31373, 220, 50256, 2124]
    for t in texts:
        assert ids.of(t) == array("I", fresh.encode(t, add_special_tokens=False).ids).tobytes(), t
