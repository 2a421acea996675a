"""Plan checks: pushdown, pruning, bounded broadcasts, no cartesian products."""

from pyspark.sql import functions as F

from ledgerline.plans import views as V
from ledgerline.plans import warehouse as WH
from ledgerline.plans.etl import stage
from ledgerline.sources import testdata

from conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_extract_pushes_filter_and_prunes_columns(spark):
    src = testdata.source_tables(spark, SF_SMALL)
    stg = stage(src, WH.FIXED_RUN_TS)
    p = _plan(stg["stg_payments"])
    assert "ReadSchema" in p and "l_comment" not in p
    c = _plan(stg["stg_customers"])
    assert "PushedFilters" in c and "c_acctbal" in c


def test_views_use_bounded_broadcasts_and_no_cartesian(spark):
    w = WH.tables(spark, SF_SMALL, "full")
    for fn in (V.monthly_revenue, V.top_customers, V.payment_by_method, V.branch_performance,
               V.loan_status_distribution):
        p = _plan(fn(w))
        assert "CartesianProduct" not in p
    assert "BroadcastHashJoin" in _plan(V.monthly_revenue(w)) or "BroadcastExchange" in _plan(V.monthly_revenue(w))


def test_payment_fact_is_year_partitioned_and_pruned(spark):
    w = WH.tables(spark, SF_SMALL, "full")
    assert "payment_year" in w["fact_payments"].columns
    p = _plan(V.revenue_month_branch(w))
    assert "PartitionFilters: [isnotnull(payment_year" in p and "payment_year" in p.split("PartitionFilters")[1][:200]


def test_payment_grain_shuffled_once(spark, tmp_root):
    from ledgerline.plans import etl
    w = WH.tables(spark, SF_SMALL, "full")
    stg = {k: w[k] for k in ("stg_customers", "stg_loans", "stg_payments")}
    etl.loan_context(stg, w["dim_customer"], w["dim_loan"]).write.parquet(tmp_root + "/ctx")
    ctx = spark.read.parquet(tmp_root + "/ctx")          # materialised once per run, as in the load
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        cand = etl.fact_payment_candidates(spark, stg, ctx, WH.FIXED_RUN_TS, w["dim_date"], w["dim_payment_method"])
        p = _plan(cand)
        # payments and the loan context each shuffle once on loan_id; calendar and methods are broadcast
        assert p.count("Exchange hashpartitioning(") == 2
        assert p.count("hashpartitioning(loan_id") == 2
        assert p.count("BroadcastExchange") == 2
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_known_payments_drop_out_before_the_star_join(spark, monkeypatch):
    from ledgerline.plans import etl
    w = WH.tables(spark, SF_SMALL, "full")
    stg = {k: w[k] for k in ("stg_customers", "stg_loans", "stg_payments")}
    ctx = etl.loan_context(stg, w["dim_customer"], w["dim_loan"])
    seen = []
    monkeypatch.setattr(etl, "assign_dense_keys", lambda df, *a: seen.append(df) or df.withColumn("payment_sk", F.lit(1)))
    etl.new_fact_payments(w["fact_payments"], spark, stg, ctx, WH.FIXED_RUN_TS, w["dim_date"], w["dim_payment_method"], 1)
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString().splitlines()
    anti = [i for i, x in enumerate(plan) if "Join LeftAnti" in x]
    star = [i for i, x in enumerate(plan) if "Join Inner" in x]
    assert len(anti) == 1 and star and min(star) < anti[0]                # the anti-join is below the joins with the context
    assert sum("Join LeftAnti" in x for x in plan) == 1


def test_no_cartesian_or_nested_loop_join_in_any_query(spark):
    import __spark_entry__ as E
    bad = {}
    for name, fn in E.queries().items():
        p = fn(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        hits = [t for t in ("CartesianProduct", "BroadcastNestedLoopJoin") if t in p]
        if hits:
            bad[name] = hits
    assert bad == {}
