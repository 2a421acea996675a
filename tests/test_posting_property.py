"""Posting: closed form over the skew-safe scan == sequential application."""

from decimal import Decimal

from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.operators.posting import post_payments

amounts = st.integers(min_value=1, max_value=5000).map(lambda c: Decimal(c) / 100)


@settings(max_examples=8, deadline=None)
@given(balances=st.lists(st.integers(min_value=0, max_value=20000), min_size=1, max_size=3),
       pays=st.lists(st.tuples(st.integers(min_value=0, max_value=2), amounts,
                               st.integers(min_value=1, max_value=28)), min_size=1, max_size=25))
def test_posting_matches_sequential(spark, balances, pays):
    loans = spark.createDataFrame([(i, Decimal(b) / 100, "active") for i, b in enumerate(balances)],
                                  "loan_id long, outstanding_balance decimal(14,2), status string")
    batch = spark.createDataFrame([(n, lo, f"2024-01-{d:02d}", a) for n, (lo, a, d) in enumerate(pays)],
                                  "payment_id long, loan_id long, payment_date string, amount decimal(14,2)")
    ok, new_loans, rejects = post_payments(loans, batch)
    got = {r.payment_id: r.applied for r in ok.collect()}
    # sequential reference: per loan in (date, id) order, cap at remaining balance
    want = {}
    remaining = {i: Decimal(b) / 100 for i, b in enumerate(balances)}
    for n, (lo, a, d) in sorted(enumerate(pays), key=lambda x: (x[1][2], x[0])):
        if lo not in remaining:
            continue
        applied = min(a, max(remaining[lo], Decimal(0)))
        remaining[lo] -= applied
        if applied > 0:
            want[n] = applied
    assert got == want
    for r in new_loans.collect():
        assert r.outstanding_balance >= 0                     # never below zero: sum applied <= balance
        assert r.outstanding_balance == remaining[r.loan_id]
    assert ok.count() + rejects.count() == sum(1 for lo, _, _ in pays)
