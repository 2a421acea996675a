"""Declared constraints as distributed checks.

A rule is data (kind, table, columns, argument).  ``violations`` turns a
rule into a DataFrame of offending keys; ``summary`` counts violations per
rule; ``check`` splits a frame into (good rows, rejects).  Every rule is a
filter, a grouped count or an anti-join, so each runs as one Spark job
with partial aggregation before any shuffle; nothing is collected.

NULL handling follows SQL constraints: CHECK and FOREIGN KEY pass NULLs,
UNIQUE ignores NULL keys.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import schemas as S


@dataclass(frozen=True)
class Rule:
    rule_id: str
    kind: str          # not_null | unique | domain | foreign_key | range | length | populated
    table: str
    columns: tuple[str, ...]
    arg: object = None  # domain values / (parent, parent cols) / (op, value) / max len / min rows
    key: tuple[str, ...] = ()

    @property
    def column(self) -> str:
        return ",".join(self.columns)


_OPS = {">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "<": lambda c, v: c < v,
        "<=": lambda c, v: c <= v}


def _bad_condition(rule: Rule) -> Column:
    cols = [F.col(c) for c in rule.columns]
    if rule.kind == "not_null":
        return reduce(lambda a, b: a | b, [c.isNull() for c in cols])
    if rule.kind == "domain":
        return cols[0].isNotNull() & ~cols[0].isin(*rule.arg)
    if rule.kind == "range":
        op, v = rule.arg
        return cols[0].isNotNull() & ~_OPS[op](cols[0], F.lit(v))
    if rule.kind == "length":
        return cols[0].isNotNull() & (F.length(cols[0]) > rule.arg)
    if rule.kind == "precision":
        p, sc = rule.arg
        return cols[0].isNotNull() & cols[0].try_cast(f"decimal({p},{sc})").isNull()
    raise ValueError(rule.kind)


def violations(rule: Rule, tables: dict[str, DataFrame]) -> DataFrame:
    """Offending rows (key columns + rule id)."""
    df = tables[rule.table]
    key = list(rule.key or rule.columns)
    if rule.kind in ("not_null", "domain", "range", "length", "precision"):
        bad = df.where(_bad_condition(rule)).select(*key)
    elif rule.kind == "unique":
        present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in rule.columns])
        bad = (df.where(present).groupBy(*rule.columns).agg(F.count(F.lit(1)).alias("_n"))
               .where("_n > 1").select(*rule.columns))
        key = list(rule.columns)
    elif rule.kind == "foreign_key":
        parent, pcols = rule.arg
        present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in rule.columns])
        p = tables[parent].select(*[F.col(pc).alias(c) for pc, c in zip(pcols, rule.columns)])
        bad = df.where(present).join(p.distinct(), list(rule.columns), "left_anti").select(*key)
    elif rule.kind == "populated":
        n = df.agg(F.count(F.lit(1)).alias("_n"))
        bad = n.where(F.col("_n") < rule.arg).select(F.col("_n").cast("string").alias("row_count"))
        key = ["row_count"]
    else:
        raise ValueError(rule.kind)
    return bad.select(F.lit(rule.rule_id).alias("rule_id"),
                      F.concat_ws("|", *[F.col(k).cast("string") for k in key]).alias("record_key"))


ROW_KINDS = ("not_null", "domain", "range", "length", "precision")
SET_KINDS = ("unique", "foreign_key")


def _set_key(columns: tuple[str, ...]) -> tuple[Column, Column]:
    """The columns as one string key, the same for any integer width, and whether all are present."""
    cols = [F.col(c) for c in columns]
    present = reduce(lambda a, b: a & b, [c.isNotNull() for c in cols])
    text = [c.cast("string") for c in cols]
    return text[0] if len(text) == 1 else F.to_json(F.array(*text)), present


def _set_counts(rules: list[Rule], tables: dict[str, DataFrame], parents: dict[str, DataFrame]) -> DataFrame:
    """One row with the violations of each unique and foreign-key rule as column ``c<i>``, each table scanned once.

    A row yields one (rule, key) for every rule that it takes part in, as child or as parent.  They are counted
    by (rule, key) before the shuffle, so a key that a third of the rows hold travels once a task; one
    grouping of all tables then tells the keys held twice and the children without parent.
    """
    roles: dict[tuple[bool, str], list[tuple[int, tuple[str, ...], int]]] = {}
    for i, r in enumerate(rules):
        roles.setdefault((False, r.table), []).append((i, r.columns, 1))
        if r.kind == "foreign_key":
            parent, columns = r.arg
            roles.setdefault((tables is not parents, parent), []).append((i, columns, 0))
    keyed = []
    for (of_parents, t), entries in roles.items():
        found = []
        for i, columns, child in entries:
            key, present = _set_key(columns)
            found.append(F.when(present, F.struct(F.lit(i).alias("rule"), key.alias("key"), F.lit(child).cast("long").alias("rows"),
                                                  F.lit(1 - child).alias("parent"))))
        df = (parents if of_parents else tables)[t]
        keyed.append(df.select(F.explode(F.array_compact(F.array(*found))).alias("x")).select("x.*")
                     .groupBy("rule", "key").agg(F.sum("rows").alias("rows"), F.max("parent").alias("parent")))
    held = reduce(DataFrame.unionByName, keyed).groupBy("rule", "key").agg(F.sum("rows").alias("rows"), F.max("parent").alias("parent"))
    return held.agg(*[F.coalesce(F.sum(
        F.when((F.col("rule") == i) & (F.col("rows") > 1), 1) if r.kind == "unique"
        else F.when((F.col("rule") == i) & (F.col("parent") == 0), F.col("rows"))), F.lit(0)).cast("long").alias(f"c{i}")
        for i, r in enumerate(rules)])


def _by_rule(counts: DataFrame, rules: list[Rule]) -> DataFrame:
    """The columns ``c<i>`` of one row as one row a rule, with what the rule says of itself."""
    rows = F.explode(F.array(*[F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.kind).alias("kind"), F.lit(r.table).alias("table_name"),
                                        F.lit(r.column).alias("column_name"), F.col(f"c{i}").alias("violations"))
                               for i, r in enumerate(rules)])).alias("x")
    return counts.select(rows).select("x.*")


def summary(rules: list[Rule], tables: dict[str, DataFrame], parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """One row per rule: kind, table, column(s), number of violations.

    Row-level rules of one table are counted in a single aggregation pass
    over that table, unique and foreign-key rules of all tables in one pass a table and
    one grouping (``_set_counts``).  ``parents``: the tables in which foreign keys are looked up, if not ``tables``."""
    parts = []
    by_table: dict[str, list[Rule]] = {}
    for r in rules:
        if r.kind in ROW_KINDS:
            by_table.setdefault(r.table, []).append(r)
    for t, rs in by_table.items():
        counts = tables[t].agg(*[F.coalesce(F.sum(F.when(_bad_condition(r), 1).otherwise(0)), F.lit(0)).cast("long").alias(f"c{i}")
                                 for i, r in enumerate(rs)])
        parts.append(_by_rule(counts, rs))
    sets = [r for r in rules if r.kind in SET_KINDS]
    if sets:
        parts.append(_by_rule(_set_counts(sets, tables, tables if parents is None else parents), sets))
    for r in rules:
        if r.kind not in ROW_KINDS and r.kind not in SET_KINDS:
            parts.append(_by_rule(violations(r, tables).agg(F.count(F.lit(1)).alias("c0")), [r]))
    return reduce(DataFrame.unionByName, parts)


def flag(df: DataFrame, rules: list[Rule], tables: dict[str, DataFrame] | None = None,
         table: str = "batch") -> tuple[DataFrame, list[tuple[str, str]]]:
    """``df`` plus one boolean column per row-level rule (True = fails)
    and ``_bad`` (any rule fails).  Foreign keys join the distinct parent
    keys (a shuffle on the key; no broadcast of a table that grows)."""
    tables = dict(tables or {})
    tables[table] = df
    flagged = df
    names = []
    for r in rules:
        name = f"_bad_{r.rule_id}"
        if r.kind in ("not_null", "domain", "range", "length", "precision"):
            flagged = flagged.withColumn(name, _bad_condition(r))
        elif r.kind == "foreign_key":
            parent, pcols = r.arg
            p = tables[parent].select(*[F.col(pc).alias(c) for pc, c in zip(pcols, r.columns)]).distinct() \
                .withColumn(name, F.lit(False))
            present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in r.columns])
            flagged = flagged.join(p, list(r.columns), "left").withColumn(
                name, F.coalesce(F.col(name), present))
        else:
            continue
        names.append((r.rule_id, name))
    any_bad = reduce(lambda a, b: a | b, [F.col(n) for _, n in names], F.lit(False))
    return flagged.withColumn("_bad", any_bad), names


def check(df: DataFrame, rules: list[Rule], key: list[str],
          tables: dict[str, DataFrame] | None = None, table: str = "batch") -> tuple[DataFrame, DataFrame]:
    """(good rows, rejects with the ids of the failed rules)."""
    flagged, names = flag(df, rules, tables, table)
    good = flagged.where(~F.col("_bad")).drop("_bad", *[n for _, n in names])
    rejects = flagged.where("_bad").select(
        *key, F.array_compact(F.array(*[F.when(F.col(n), F.lit(rid)) for rid, n in names])).alias("rules"))
    return good, rejects


def batch_gate(df: DataFrame, rules: list[Rule], batch_cols: list[str],
               tables: dict[str, DataFrame] | None = None, table: str = "batch") -> DataFrame:
    """All-or-nothing acceptance per batch: a batch is accepted only when
    none of its rows fails a rule (one grouped pass, partial aggregation)."""
    flagged, _ = flag(df, rules, tables, table)
    return (flagged.groupBy(*batch_cols)
            .agg(F.count(F.lit(1)).alias("batch_rows"),
                 F.sum(F.col("_bad").cast("long")).alias("rejected_rows"))
            .withColumn("accepted", F.col("rejected_rows") == 0))


def accepted_rows(df: DataFrame, gate: DataFrame, batch_cols: list[str]) -> DataFrame:
    """Rows of accepted batches only (the gate has one row per batch)."""
    return df.join(gate.where("accepted").select(*batch_cols), batch_cols, "left_semi")


def restrict_deletes(deletes: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """ON DELETE RESTRICT: parent keys in ``deletes`` that still have
    children are refused (semi-join + child count per key)."""
    n = children.groupBy(key).agg(F.count(F.lit(1)).alias("child_rows"))
    return deletes.select(key).distinct().join(n, key, "inner")


# ---------------------------------------------------------------------------
# Declared rules of the model (fixed values: constraints of the schema).
# ---------------------------------------------------------------------------
def _nn(t, *cols, key=()):
    return [Rule(f"nn_{t}_{c}", "not_null", t, (c,), key=key) for c in cols]


NOT_NULL = (
    _nn("customers", "customer_id", "full_name", "email", key=("customer_id",))
    + _nn("loan_products", "product_id", "product_name", "min_amount", "max_amount", "min_tenure_months",
          "max_tenure_months", key=("product_id",))
    + _nn("loans", "loan_id", "customer_id", "amount", "interest_rate", "tenure_months", "status",
          key=("loan_id",))
    + _nn("payments", "payment_id", "loan_id", "amount", "payment_date", key=("payment_id",))
    + _nn("fact_payments", "payment_id", "customer_sk", "loan_sk", "date_sk", "payment_amount",
          key=("payment_sk",))
    + _nn("fact_loans", "loan_id", "customer_sk", "loan_sk", key=("loan_fact_sk",))
    + _nn("dim_customer", "customer_id", "full_name", "effective_date", "is_current", key=("customer_sk",))
    + _nn("dim_loan", "loan_id", "customer_id", "amount", "interest_rate", "tenure_months", "status", key=("loan_sk",))
    + _nn("dim_date", "full_date", "day", "month", "year", key=("date_sk",))
    + _nn("dim_payment_method", "method_code", "method_name", key=("method_sk",))
)
UNIQUE = [
    Rule("uq_customers_customer_id", "unique", "customers", ("customer_id",)),
    Rule("uq_customers_email", "unique", "customers", ("email",)),
    Rule("uq_customers_national_id", "unique", "customers", ("national_id",)),
    Rule("uq_loans_loan_id", "unique", "loans", ("loan_id",)),
    Rule("uq_payments_payment_id", "unique", "payments", ("payment_id",)),
    Rule("uq_dim_customer_customer_id", "unique", "dim_customer", ("customer_id",)),
    Rule("uq_dim_customer_customer_sk", "unique", "dim_customer", ("customer_sk",)),
    Rule("uq_dim_loan_loan_id", "unique", "dim_loan", ("loan_id",)),
    Rule("uq_dim_loan_loan_sk", "unique", "dim_loan", ("loan_sk",)),
    Rule("uq_fact_loans_loan_id", "unique", "fact_loans", ("loan_id",)),
    Rule("uq_dim_date_full_date", "unique", "dim_date", ("full_date",)),
    Rule("uq_dim_date_date_sk", "unique", "dim_date", ("date_sk",)),
    Rule("uq_loan_products_product_id", "unique", "loan_products", ("product_id",)),
    Rule("uq_dim_product_product_id", "unique", "dim_product", ("product_id",)),
    Rule("uq_dim_payment_method_code", "unique", "dim_payment_method", ("method_code",)),
    Rule("uq_fact_payments_payment_id", "unique", "fact_payments", ("payment_id",)),
    Rule("uq_audit_log_log_id", "unique", "audit_log", ("log_id",)),
]
DOMAIN = [
    Rule("dom_customers_segment", "domain", "customers", ("segment",), tuple(S.SEGMENTS), ("customer_id",)),
    Rule("dom_loan_products_type", "domain", "loan_products", ("product_type",), tuple(S.PRODUCT_TYPES),
         ("product_id",)),
    Rule("dom_loans_status", "domain", "loans", ("status",), tuple(S.LOAN_STATUSES), ("loan_id",)),
    Rule("dom_payments_method", "domain", "payments", ("payment_method",), tuple(S.PAYMENT_METHODS),
         ("payment_id",)),
    Rule("dom_audit_log_operation", "domain", "audit_log", ("operation",), ("INSERT", "UPDATE", "DELETE"), ("log_id",)),
]
FOREIGN_KEY = [
    Rule("fk_loans_customer", "foreign_key", "loans", ("customer_id",), ("customers", ("customer_id",)),
         ("loan_id",)),
    Rule("fk_loans_product", "foreign_key", "loans", ("product_id",), ("loan_products", ("product_id",)),
         ("loan_id",)),
    Rule("fk_payments_loan", "foreign_key", "payments", ("loan_id",), ("loans", ("loan_id",)),
         ("payment_id",)),
    Rule("fk_fact_payments_customer", "foreign_key", "fact_payments", ("customer_sk",),
         ("dim_customer", ("customer_sk",)), ("payment_sk",)),
    Rule("fk_fact_payments_loan", "foreign_key", "fact_payments", ("loan_sk",), ("dim_loan", ("loan_sk",)),
         ("payment_sk",)),
    Rule("fk_fact_payments_date", "foreign_key", "fact_payments", ("date_sk",), ("dim_date", ("date_sk",)),
         ("payment_sk",)),
    Rule("fk_fact_payments_method", "foreign_key", "fact_payments", ("method_sk",),
         ("dim_payment_method", ("method_sk",)), ("payment_sk",)),
    Rule("fk_fact_loans_customer", "foreign_key", "fact_loans", ("customer_sk",), ("dim_customer", ("customer_sk",)),
         ("loan_fact_sk",)),
    Rule("fk_fact_loans_loan", "foreign_key", "fact_loans", ("loan_sk",), ("dim_loan", ("loan_sk",)), ("loan_fact_sk",)),
    Rule("fk_fact_loans_disbursement", "foreign_key", "fact_loans", ("disbursement_date_sk",),
         ("dim_date", ("date_sk",)), ("loan_fact_sk",)),
    Rule("fk_fact_loans_maturity", "foreign_key", "fact_loans", ("maturity_date_sk",),
         ("dim_date", ("date_sk",)), ("loan_fact_sk",)),
]
RANGE = [
    Rule("chk_loans_amount", "range", "loans", ("amount",), (">", 0), ("loan_id",)),
    Rule("chk_loans_rate", "range", "loans", ("interest_rate",), (">=", 0), ("loan_id",)),
    Rule("chk_loans_tenure", "range", "loans", ("tenure_months",), (">", 0), ("loan_id",)),
    Rule("chk_payments_amount", "range", "payments", ("amount",), (">", 0), ("payment_id",)),
]
LENGTH = (
    [Rule(f"len_customers_{c}", "length", "customers", (c,), n, ("customer_id",))
     for c, n in S.CUSTOMER_LENGTHS.items()]
    + [Rule(f"len_loans_{c}", "length", "loans", (c,), n, ("loan_id",)) for c, n in S.LOAN_LENGTHS.items()]
    + [Rule(f"len_payments_{c}", "length", "payments", (c,), n, ("payment_id",))
       for c, n in S.PAYMENT_LENGTHS.items()]
)
# DECIMAL(p,s) limits, checked on the raw source columns before the cast.
PRECISION = [
    Rule("prec_orders_totalprice", "precision", "orders", ("o_totalprice",), (14, 2), ("o_orderkey",)),
    Rule("prec_lineitem_extendedprice", "precision", "lineitem", ("l_extendedprice",), (14, 2), ("l_orderkey",)),
    Rule("prec_lineitem_tax", "precision", "lineitem", ("l_tax",), (4, 2), ("l_orderkey",)),
]
POPULATED = (
    [Rule(f"pop_{t}", "populated", t, (), 1) for t in
     ("customers", "loans", "payments", "dim_customer", "dim_loan", "fact_payments", "fact_loans")]
    + [Rule("pop_dim_date", "populated", "dim_date", (), 10_000)]
)
# ---------------------------------------------------------------------------


def populated_report(rules: list[Rule], tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table against its threshold, with pass/fail."""
    parts = [tables[r.table].agg(F.count(F.lit(1)).alias("row_count"))
             .select(F.lit(r.table).alias("table_name"), "row_count",
                     F.lit(int(r.arg)).cast("long").alias("min_rows"))
             for r in rules]
    return reduce(DataFrame.unionByName, parts).withColumn("passed", F.col("row_count") >= F.col("min_rows"))
