"""Tables with known faults: what every declared rule is held against.

``spoil`` changes the column of each rule in the rows whose key has the rule's
residue, and repeats some rows for the unique rules (where the column may be null, equal
values are put there besides), so that each rule finds violations in tables that are otherwise sound.  ``spoil_sql`` states the same
in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.quality import Rule

#: Key of each table, and the modulus of its keys (a catalogue of five rows needs a small one).
KEYS = {"customers": "customer_id", "loan_products": "product_id", "loans": "loan_id", "payments": "payment_id",
        "dim_customer": "customer_sk", "dim_loan": "loan_sk", "dim_product": "product_sk", "dim_payment_method": "method_sk",
        "dim_date": "date_sk", "fact_payments": "payment_sk", "fact_loans": "loan_fact_sk", "orders": "o_orderkey",
        "lineitem": "l_orderkey", "audit_log": "log_id"}
#: Unique columns that may be null: the value that rows of residue 0 share.
SHARED = {("customers", "national_id"): "'shared'"}
SMALL = {"loan_products": 5, "dim_product": 5, "dim_payment_method": 5}
MODULUS = 41


def _faults(table: str, rules: list[Rule]) -> dict[str, list[tuple[int, str]]]:
    """column -> (residue, faulty value in SQL)."""
    out: dict[str, list[tuple[int, str]]] = {}
    rows = [r for r in rules if r.table == table and r.kind not in ("unique", "populated")]
    for i, r in enumerate(rows):
        if r.kind == "not_null":
            value = "NULL"
        elif r.kind == "domain":
            value = "'no such value'"
        elif r.kind == "length":
            value = "'" + "x" * (r.arg + 1) + "'"
        elif r.kind == "precision":
            value = "1e15"
        elif r.kind == "range":
            value = str(r.arg[1] - 1)
        else:
            value = "-7"
        out.setdefault(r.columns[0], []).append((i % SMALL.get(table, MODULUS), value))
    for r in rules:
        if r.kind == "unique" and (table, r.columns[0]) in SHARED and r.table == table:
            out.setdefault(r.columns[0], []).append((0, SHARED[table, r.columns[0]]))
    return out


def spoil(table: str, df: DataFrame, rules: list[Rule]) -> DataFrame:
    key, m = KEYS[table], SMALL.get(table, MODULUS)
    cols = []
    faults = _faults(table, rules)
    for c in df.columns:
        v = F.col(c)
        for residue, value in reversed(faults.get(c, [])):
            v = F.when(F.col(key) % m == residue, F.expr(value).cast(df.schema[c].dataType)).otherwise(v)
        cols.append(v.alias(c))
    out = df.select(*cols)
    if any(r.table == table and r.kind == "unique" for r in rules):
        out = out.unionByName(df.where(F.col(key) % m == m - 1))
    return out


def spoil_sql(table: str, source: str, rules: list[Rule]) -> str:
    """A SELECT over ``source`` with the same faults."""
    key, m = KEYS[table], SMALL.get(table, MODULUS)
    changed = []
    for c, faults in _faults(table, rules).items():
        whens = " ".join(f"WHEN {key} % {m} = {residue} THEN {value}" for residue, value in faults)
        changed.append(f"CASE {whens} ELSE {c} END AS {c}")
    sql = f"SELECT * REPLACE ({', '.join(changed)}) FROM {source}" if changed else f"SELECT * FROM {source}"
    if any(r.table == table and r.kind == "unique" for r in rules):
        sql += f" UNION ALL SELECT * FROM {source} WHERE {key} % {m} = {m - 1}"
    return sql
