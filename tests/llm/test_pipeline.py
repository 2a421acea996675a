import re
from collections import Counter

import corpus_pipeline as C
from conftest import SF_SMALL
from ledgerline.llm import quality
from test_mixing import plain_counts
from test_near_dedup import plain_classes


def test_stages_against_plain_versions(spark):
    docs = C.table(spark, SF_SMALL, "documents")
    columns, read = docs.columns, {r.doc_id: r for r in docs.collect()}
    assert [n for n, _ in C.STAGES] == ["quality classifier", "exact dedup", "MinHash near-dedup", "mixing sources", "packing"]
    kept = []
    for name, stage in C.STAGES:
        docs = C.materialise(stage(spark, docs, SF_SMALL), "stage")
        kept.append(docs)
        if name != "packing":
            assert docs.columns == columns
    ids = [[r[0] for r in k.select("doc_id").collect()] for k in kept]
    sampler = quality.fit(C.table(spark, SF_SMALL, "documents"), C.table(spark, SF_SMALL, "labels"))
    keys = sampler.keys(list(read), [r.text.encode() for r in read.values()])[1]
    assert sorted(ids[0]) == sorted(i for i, k in zip(read, keys, strict=True) if k >= sampler.least)
    best = {}
    for i in ids[0]:
        t = re.sub("[\x20\x09-\x0d]", "", read[i].text)
        best[t] = min(best.get(t, i), i, key=lambda d: (-len(read[d].text), d))
    assert sorted(ids[1]) == sorted(best.values())
    classes = plain_classes(spark, [(i, read[i].text) for i in sorted(ids[1])])
    assert sorted(ids[2]) == sorted(set(classes.values()))
    counts = plain_counts([(i, read[i].text, read[i].source) for i in ids[2]], None)
    assert Counter(ids[3]) == Counter({r[0]: n for r, n in counts.items()})
    pieces = Counter()
    for p in kept[4].collect():
        pieces[p.doc_id] += p.length
    tokens = {p.doc_id: p.doc_tokens for p in kept[4].collect()}
    assert all(pieces[i] == tokens[i] * n for i, n in Counter(ids[3]).items())


def test_run_gives_the_packed_pieces(spark):
    out = C.run(spark, SF_SMALL)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    assert out.count() > 100


ODD = "doc_id long, text string, lang string, source string, n_chars long, key string, rank int, id int, part int, copies int"


def odd_tables(spark, root, rows):
    spark.createDataFrame([(*r, "k", 1, 2, 3, 4) for r in rows], ODD).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] is not None and r[0] % 2)) for r in rows[:20]] + [(None, 1), (7, None)],
                          "doc_id long, quality int").write.parquet(f"{root}/labels.parquet")
    return root


def test_nulls_repeated_rows_and_extra_columns(spark, tmp_root):
    words = "the quiet river and a stone house were found by those who walked along the long road home"
    rows = [(i, f"{words} {i} {words[::-1]} {'x' * i}", "en", "web" if i % 3 else None, 5) for i in range(30)]
    rows += [rows[3]] * 3 + [(4, None, None, None, None), (None, "a text without an id, as long as the others " + words, "en", "web", None), (None, None, None, None, None),
             (50, "", "en", "", 0), (51, " \n", "en", "", 0), (52, words * 300, "en", "web", 1)]
    d = odd_tables(spark, f"{tmp_root}/odd", rows)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns, name
        kept = [tuple(r) for r in out.collect()]
        assert name == "mixing sources" or len(kept) <= docs.count()
        assert {r[:2] for r in kept} <= {(r[0], r[1]) for r in rows}
        docs = spark.createDataFrame(kept, out.schema)
    pieces = C.run(spark, d)
    assert pieces.count() > 0 and pieces.agg({"length": "max"}).first()[0] <= 1024


def test_empty_tables_go_through(spark, tmp_root):
    d = odd_tables(spark, f"{tmp_root}/none", [])
    assert C.run(spark, d).collect() == []
