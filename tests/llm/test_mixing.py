import hashlib
import math
from collections import Counter

from ledgerline.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, steps int, rate double"


def plain_counts(rows, weights, seed=7):
    n = Counter(r[2] for r in rows)
    w = {s: (float(round(math.sqrt(c) * 1000)) if weights is None else float(weights.get(s, 0))) for s, c in n.items()}
    out = Counter()
    for r in rows:
        rate = len(rows) * w[r[2]] / (sum(w.values()) * n[r[2]])
        parts = max(1, math.ceil(rate / 32))
        for j in range(1, parts + 1):
            u = int(hashlib.md5(f"{seed}|{'null' if r[0] is None else r[0]}|{j}".encode()).hexdigest()[:13], 16) / 2 ** 52
            p = c = math.exp(-rate / parts)
            k = 0
            while c <= u and k < rate / parts + 12 * math.sqrt(rate / parts) + 20:
                k += 1
                p *= rate / parts / k
                c += p
            out[r] += k
    return +out


def test_counts_against_plain_version(spark):
    rows = [(i, None if i % 7 == 0 else f"t{i}", [None, "a", "b", "b", "b", "b", "b"][i % 7], 1, 2.0) for i in range(700)]
    rows += [(5, "t5", "b", 1, 2.0)] * 3 + [(None, "", "c", 1, 2.0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for weights in (None, {"a": 1, "b": 1, None: 8}, {"c": 5}, {"x": 1}):
        out = M.mix(df, weights=weights)
        assert out.columns == [*df.columns, "copies", "copy"]
        got = Counter(tuple(r)[:5] for r in out.collect())
        want = Counter()
        if weights != {"x": 1}:
            for r, k in plain_counts(rows, weights).items():
                want[r] = k
        assert got == want


def test_rates_meet_the_weights(spark):
    rows = [(i, "t", "big" if i % 10 else "small", 1, 2.0) for i in range(20_000)]
    out = Counter(r.source for r in M.mix(spark.createDataFrame(rows, SCHEMA), weights={"big": 1, "small": 1}).collect())
    assert abs(out["big"] - 10_000) < 400 and abs(out["small"] - 10_000) < 400


def test_empty_table_and_plan(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert M.mix(df).count() == 0
    plan = M.mix(spark.createDataFrame([(1, "t", "a", 1, 2.0)], SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan
