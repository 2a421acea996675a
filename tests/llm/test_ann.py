import numpy as np
from ledgerline.llm import ann as A

SCHEMA = "vec_id long, embedding array<float>, rank int, list string"


def plain(ids, vectors, queries, k=5):
    out = {}
    for q in queries:
        i = ids.index(q)
        score = A.cosine(vectors, vectors[i])
        order = [j for j in np.lexsort((np.array(ids), -score)) if ids[j] != q][:k]
        out[q] = [(ids[j], score[j]) for j in order]
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {}
    for r in sorted(A.nearest(df, df.filter("vec_id % 50 = 0"), **options).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


def test_recall_scores_and_ties(spark):
    rng = np.random.default_rng(0)
    vectors = np.concatenate([rng.normal(size=(1500, 32)), np.tile(rng.normal(size=32), (700, 1)), rng.normal(size=(800, 32)) * 1e-20])
    vectors = vectors.astype(np.float32).astype(float)
    order = rng.permutation(len(vectors))
    ids = order.tolist()
    got = run(spark, [(i, v.tolist(), 0, "x") for i, v in zip(ids, vectors, strict=True)])
    want = plain(ids, vectors, [i for i in ids if i % 50 == 0])
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    hit = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 5 for q in want])
    assert hit >= 0.93
    scores = [dict(want_all) for want_all in plain(ids, vectors, list(want), k=len(ids)).values()]
    for (q, found), exact in zip(got.items(), [s for s in scores], strict=False):
        exact = dict(plain(ids, vectors, [q], k=len(ids))[q])
        assert all(exact[i] == s for i, s in found)
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
    hot = [q for q in want if ids.index(q) in range(1500, 2200)]
    assert hot and all(got[q] == want[q] for q in hot)                     # hundreds of equal vectors: the smallest ids


def test_odd_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [1.0, float(i), 2.0], 0, "x") for i in range(0, 4)]
    rows = good + [(50, None, 0, "x"), (51, [], 0, "x"), (52, [0.0, 0.0, 0.0], 0, "x"), (53, [1.0, None, 2.0], 0, "x"), (54, [nan, 1.0, 1.0], 0, "x"),
                   (55, [inf, 1.0, 1.0], 0, "x"), (56, [1.0, 1.0], 0, "x"), (None, [1.0, 1.0, 1.0], 0, "x"), (100, [1.0, 1.0, 2.0], 0, "x")]
    got = run(spark, rows)
    assert set(got) == {0, 100}
    assert [i for i, _ in got[100]] == [1, 0, 2, 3] or [i for i, _ in got[100]][0] == 1
    assert {i for i, _ in got[0]} == {1, 2, 3, 100}                        # all candidates, if fewer


def test_repeats_and_empty(spark):
    got = run(spark, [(0, [1.0, 0.0], 0, "x")] * 3 + [(7, [1.0, 0.1], 0, "x")] * 9)
    assert [i for i, _ in got[0]] == [7] * 5
    assert run(spark, [(0, [1.0, 0.0], 0, "x")]) == {}
    assert A.nearest(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], SCHEMA)).count() == 0


def test_recall_of_the_query_on_the_given_table(spark):
    """Cosines by matrix product, independent of the operator's."""
    from conftest import SF_SMALL
    from ledgerline.llm import queries as Q
    d = SF_SMALL.replace("0.001", "0.1")
    rows = sorted((r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").collect())
    ids = np.array([i for i, _ in rows])
    v = np.array([x for _, x in rows], np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    got = {}
    for r in Q.queries()["op7_nearest"](spark, d).collect():
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == set(ids[ids % 50 == 0].tolist())
    hit = 0
    for q, found in got.items():
        near = v @ v[ids == q][0]
        near[ids == q] = -2
        want = set(ids[np.lexsort((ids, -near))[:5]].tolist())
        assert sorted(r.rank for r in found) == [1, 2, 3, 4, 5]
        assert all(abs(near[ids == r.vec_id][0] - r.score) < 1e-12 for r in found)
        hit += len(want & {r.vec_id for r in found})
    assert hit / (5 * len(got)) >= 0.95
