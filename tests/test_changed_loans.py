"""The loans that change between the two snapshots of the incremental scenario."""

import re

from pyspark.sql import functions as F

from conftest import SF_SMALL
from ledgerline.plans import registry as R
from ledgerline.plans import warehouse as WH
from ledgerline.sources import testdata as TD


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_changed_loans_are_those_of_the_second_snapshot_that_the_first_lacks(spark):
    src = WH.operational(spark, SF_SMALL)
    undated = src["loans"].limit(1).withColumn("created_at", F.lit(None).cast("timestamp_ntz")).withColumn("loan_id", F.lit(None).cast("long"))
    for loans, compared in ((src["loans"].unionByName(undated), False), (src["loans"].unionByName(src["loans"].where("loan_id % 3 = 0")), True)):
        now = {**src, "loans": loans}
        got, two = R._changed_loans(now), TD.second_snapshot(now)["loans"]
        want = two.exceptAll(TD.first_snapshot(now)["loans"].select(*two.columns))
        assert got.columns == two.columns and got.count() == want.count() > 0 and got.exceptAll(want).isEmpty()
        # whole rows are keys of a shuffle only where loans repeat
        assert bool(re.search(r"hashpartitioning\([^)]*customer_id#", _plan(got))) == compared
