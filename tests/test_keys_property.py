"""Property: dense keys are start + rank of the natural key, whatever the
input partitioning and key spread."""

from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.operators.keys import assign_dense_keys


@settings(max_examples=6, deadline=None)
@given(keys=st.sets(st.integers(min_value=-10**12, max_value=10**12), min_size=0, max_size=60),
       start=st.integers(min_value=0, max_value=10**6), parts=st.integers(min_value=1, max_value=7))
def test_dense_keys_property(spark, keys, start, parts):
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(parts)
    got = sorted((r.k, r.sk) for r in assign_dense_keys(df, ["k"], "sk", start=start).collect())
    assert got == [(k, start + i + 1) for i, k in enumerate(sorted(keys))]
