from pyspark.sql import functions as F

from ledgerline.operators import quality as Q


def test_rule_kinds(spark):
    loans = spark.createDataFrame(
        [(1, 10, "active", 5.0), (2, 99, "bogus", -1.0), (3, None, None, None), (3, 10, "repaid", 1.0)],
        "loan_id int, customer_id int, status string, amount double")
    customers = spark.createDataFrame([(10,)], "customer_id int")
    t = {"loans": loans, "customers": customers}
    rules = [Q.Rule("nn", "not_null", "loans", ("customer_id",), key=("loan_id",)),
             Q.Rule("uq", "unique", "loans", ("loan_id",)),
             Q.Rule("dom", "domain", "loans", ("status",), ("active", "repaid"), ("loan_id",)),
             Q.Rule("fk", "foreign_key", "loans", ("customer_id",), ("customers", ("customer_id",)), ("loan_id",)),
             Q.Rule("rng", "range", "loans", ("amount",), (">", 0), ("loan_id",)),
             Q.Rule("pop", "populated", "loans", (), 10)]
    got = {r.rule_id: r.violations for r in Q.summary(rules, t).collect()}
    assert got == {"nn": 1, "uq": 1, "dom": 1, "fk": 1, "rng": 1, "pop": 1}
    good, rejects = Q.check(loans, [r for r in rules if r.kind in ("domain", "range", "foreign_key")],
                            ["loan_id"], t, "loans")
    assert sorted(r.loan_id for r in good.collect()) == [1, 3, 3]
    assert {r.loan_id: sorted(r.rules) for r in rejects.collect()} == {2: ["dom", "fk", "rng"]}


def test_batch_gate_rejects_whole_batch(spark):
    p = spark.createDataFrame([(1, "a", 5.0), (1, "b", -1.0), (2, "c", 3.0)], "batch int, id string, amount double")
    gate = Q.batch_gate(p, [Q.Rule("rng", "range", "p", ("amount",), (">", 0))], ["batch"])
    acc = {r.batch: r.accepted for r in gate.collect()}
    assert acc == {1: False, 2: True}
    assert [r.id for r in Q.accepted_rows(p, gate, ["batch"]).collect()] == ["c"]


def test_restrict(spark):
    dels = spark.createDataFrame([(1,), (2,)], "customer_id int")
    loans = spark.createDataFrame([(1,), (1,)], "customer_id int")
    assert [(r.customer_id, r.child_rows) for r in Q.restrict_deletes(dels, loans, "customer_id").collect()] == [(1, 2)]


def test_precision_rule(spark):
    df = spark.createDataFrame([(1, 12.5), (2, 1e15)], "id int, v double")
    r = Q.Rule("p", "precision", "t", ("v",), (14, 2), ("id",))
    assert [x.record_key for x in Q.violations(r, {"t": df}).collect()] == ["2"]


def test_set_rules_scan_each_table_once(spark):
    from conftest import SF_SMALL
    from ledgerline.plans import registry
    plan = registry.queries()["dq_fk"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    facts = [x for x in plan.splitlines() if "Relation" in x and "payment_year" in x]
    assert len(facts) == 1 and "Join" not in plan


def test_set_rules_on_empty_tables_and_several_columns(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (1, None), (2, "y"), (3, "z")], "k int, t string")
    p = spark.createDataFrame([(1, "x"), (3, "z")], "k long, t string")
    rules = [Q.Rule("uq", "unique", "a", ("k", "t")), Q.Rule("fk", "foreign_key", "a", ("k", "t"), ("p", ("k", "t"))),
             Q.Rule("none", "unique", "e", ("k",))]
    tables = {"a": a, "p": p, "e": a.limit(0)}
    assert {r.rule_id: r.violations for r in Q.summary(rules, tables).collect()} == {"uq": 1, "fk": 1, "none": 0}
    sound = {"p": a.select(F.col("k").cast("long"), "t")}
    assert {r.rule_id: r.violations for r in Q.summary(rules, tables, sound).collect()} == {"uq": 1, "fk": 0, "none": 0}
