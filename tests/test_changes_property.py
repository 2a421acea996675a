"""Property: applying the change log between two versions to the old one
gives the new one; the state as of the last change equals the latest image."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.operators import changes as CH

rows = st.dictionaries(st.integers(min_value=1, max_value=12),
                       st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(0, 3))),
                       max_size=10)

SCHEMA = "id int, s string, n int"


@settings(max_examples=8, deadline=None)
@given(old=rows, new=rows)
def test_apply_diff_roundtrip(spark, old, new):
    a = spark.createDataFrame([(k, v[0], v[1]) for k, v in old.items()], SCHEMA)
    b = spark.createDataFrame([(k, v[0], v[1]) for k, v in new.items()], SCHEMA)
    log = CH.diff(a, b, "id", table_name="t")
    typed = (log.withColumn("log_id", F.monotonically_increasing_id())
             .withColumn("img", F.from_json("new_values", SCHEMA))
             .select(F.col("record_id").alias("id"), "operation", "log_id", "img.s", "img.n"))
    out = CH.apply_changes(a, typed, "id", ["s", "n"])
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(((k, v[0], v[1]) for k, v in new.items()), key=repr)
    # only real changes are logged
    changed = {k for k in set(old) | set(new) if old.get(k) != new.get(k)}
    assert {r.record_id for r in log.collect()} == changed
