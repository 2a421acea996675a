"""Seed-sized fixture: the source system's demo rows (5 products come from
``schemas.LOAN_PRODUCT_ROWS``), used for golden results.

Fixed values: rows of the source system's seed data, in their order.
Ids are assigned 1..n in row order, as the source's serial keys do.
"""

from decimal import Decimal as D

# customer: full_name, email, city, segment
CUSTOMERS = [
    ("Alice Njoroge", "alice.njoroge@mail.co.ke", "Nairobi", "retail"),
    ("Brian Otieno", "brian.otieno@mail.co.ke", "Mombasa", "retail"),
    ("Catherine Wanjiru", "catherine.w@mail.co.ke", "Kisumu", "retail"),
    ("David Kamau", "david.kamau@mail.co.ke", "Nakuru", "sme"),
    ("Esther Achieng", "esther.a@mail.co.ke", "Nairobi", "retail"),
    ("Francis Mwangi", "francis.mwangi@mail.co.ke", "Eldoret", "sme"),
    ("Grace Mutua", "grace.mutua@mail.co.ke", "Thika", "retail"),
    ("Hassan Abdi", "hassan.abdi@mail.co.ke", "Mombasa", "corporate"),
    ("Ivy Chebet", "ivy.chebet@mail.co.ke", "Nairobi", "retail"),
    ("James Omondi", "james.omondi@mail.co.ke", "Kisumu", "sme"),
    ("Karen Adhiambo", "karen.adhiambo@mail.co.ke", "Nairobi", "retail"),
    ("Leon Mutuku", "leon.mutuku@mail.co.ke", "Machakos", "sme"),
    ("Mary Wambui", "mary.wambui@mail.co.ke", "Nairobi", "corporate"),
    ("Nelson Karanja", "nelson.karanja@mail.co.ke", "Nyeri", "retail"),
    ("Olivia Auma", "olivia.auma@mail.co.ke", "Kisumu", "retail"),
]

# loan: customer_id, product_id, amount, interest_rate, tenure_months, status,
#       disbursed_at (with offset), maturity_date, outstanding_balance, branch_code
LOANS = [
    (1, 1, "150000.00", "14.50", 24, "active", "2024-01-15 08:00:00+03", "2026-01-15", "95000.00", "NBI-001"),
    (2, 1, "80000.00", "15.00", 12, "repaid", "2023-06-01 09:00:00+03", "2024-06-01", "0.00", "MBA-001"),
    (3, 2, "500000.00", "12.00", 36, "active", "2024-03-20 10:00:00+03", "2027-03-20", "380000.00", "KSM-001"),
    (4, 2, "2000000.00", "11.50", 60, "active", "2023-11-01 08:30:00+03", "2028-11-01", "1650000.00", "NKR-001"),
    (5, 1, "50000.00", "16.00", 6, "repaid", "2023-09-01 08:00:00+03", "2024-03-01", "0.00", "NBI-001"),
    (6, 2, "750000.00", "12.50", 48, "active", "2024-02-01 09:00:00+03", "2028-02-01", "620000.00", "ELD-001"),
    (7, 1, "30000.00", "17.00", 3, "defaulted", "2023-04-01 08:00:00+03", "2023-07-01", "15000.00", "THK-001"),
    (8, 3, "8000000.00", "10.00", 240, "active", "2022-06-15 08:00:00+03", "2042-06-15", "7500000.00", "MBA-001"),
    (9, 4, "1200000.00", "13.00", 60, "active", "2024-04-10 09:00:00+03", "2029-04-10", "1100000.00", "NBI-002"),
    (10, 2, "900000.00", "12.00", 48, "active", "2024-01-05 08:00:00+03", "2028-01-05", "810000.00", "KSM-001"),
    (11, 5, "200000.00", "13.50", 36, "active", "2024-05-01 10:00:00+03", "2027-05-01", "185000.00", "NBI-002"),
    (12, 2, "1500000.00", "11.00", 60, "active", "2023-07-01 08:00:00+03", "2028-07-01", "1200000.00", "MCH-001"),
    (13, 3, "15000000.00", "9.50", 300, "active", "2020-01-01 08:00:00+03", "2045-01-01", "13500000.00", "NBI-001"),
    (14, 1, "100000.00", "14.00", 18, "repaid", "2022-10-01 09:00:00+03", "2024-04-01", "0.00", "NYR-001"),
    (15, 1, "60000.00", "16.50", 12, "active", "2024-06-01 08:00:00+03", "2025-06-01", "45000.00", "KSM-002"),
]

# payment: loan_id, amount, principal_portion, interest_portion, payment_method, payment_date
PAYMENTS = [
    (1, "7200.00", "5500.00", "1700.00", "mpesa", "2024-02-15"),
    (1, "7200.00", "5600.00", "1600.00", "mpesa", "2024-03-15"),
    (1, "7200.00", "5700.00", "1500.00", "bank_transfer", "2024-04-15"),
    (1, "7200.00", "5800.00", "1400.00", "mpesa", "2024-05-15"),
    (1, "7200.00", "5900.00", "1300.00", "mpesa", "2024-06-15"),
    (2, "7200.00", "6000.00", "1200.00", "mpesa", "2023-07-01"),
    (2, "7200.00", "6100.00", "1100.00", "mpesa", "2023-08-01"),
    (2, "7200.00", "6200.00", "1000.00", "mpesa", "2023-09-01"),
    (2, "7200.00", "6300.00", "900.00", "mpesa", "2023-10-01"),
    (2, "7200.00", "6400.00", "800.00", "mpesa", "2023-11-01"),
    (2, "7200.00", "6500.00", "700.00", "mpesa", "2023-12-01"),
    (2, "7200.00", "6600.00", "600.00", "mpesa", "2024-01-01"),
    (2, "7200.00", "6700.00", "500.00", "mpesa", "2024-02-01"),
    (2, "7200.00", "6800.00", "400.00", "mpesa", "2024-03-01"),
    (2, "7200.00", "6900.00", "300.00", "mpesa", "2024-04-01"),
    (2, "7200.00", "7000.00", "200.00", "mpesa", "2024-05-01"),
    (2, "7000.00", "6900.00", "100.00", "mpesa", "2024-06-01"),
    (3, "17000.00", "12000.00", "5000.00", "bank_transfer", "2024-04-20"),
    (3, "17000.00", "12200.00", "4800.00", "bank_transfer", "2024-05-20"),
    (3, "17000.00", "12400.00", "4600.00", "bank_transfer", "2024-06-20"),
    (4, "44000.00", "32000.00", "12000.00", "bank_transfer", "2023-12-01"),
    (4, "44000.00", "32500.00", "11500.00", "bank_transfer", "2024-01-01"),
    (4, "44000.00", "33000.00", "11000.00", "bank_transfer", "2024-02-01"),
    (4, "44000.00", "33500.00", "10500.00", "bank_transfer", "2024-03-01"),
    (4, "44000.00", "34000.00", "10000.00", "bank_transfer", "2024-04-01"),
    (4, "44000.00", "34500.00", "9500.00", "bank_transfer", "2024-05-01"),
    (8, "72000.00", "5000.00", "67000.00", "bank_transfer", "2022-07-15"),
    (8, "72000.00", "5100.00", "66900.00", "bank_transfer", "2022-08-15"),
    (8, "72000.00", "5200.00", "66800.00", "bank_transfer", "2022-09-15"),
    (8, "72000.00", "5300.00", "66700.00", "bank_transfer", "2022-10-15"),
    (12, "33000.00", "24000.00", "9000.00", "online", "2023-08-01"),
    (12, "33000.00", "24200.00", "8800.00", "online", "2023-09-01"),
    (12, "33000.00", "24400.00", "8600.00", "online", "2023-10-01"),
    (12, "33000.00", "24600.00", "8400.00", "online", "2023-11-01"),
    (12, "33000.00", "24800.00", "8200.00", "online", "2023-12-01"),
    (13, "135000.00", "10000.00", "125000.00", "bank_transfer", "2020-02-01"),
    (13, "135000.00", "10100.00", "124900.00", "bank_transfer", "2020-03-01"),
    (13, "135000.00", "10200.00", "124800.00", "bank_transfer", "2020-04-01"),
    (14, "6400.00", "5000.00", "1400.00", "mpesa", "2022-11-01"),
    (14, "6400.00", "5100.00", "1300.00", "mpesa", "2022-12-01"),
    (14, "6400.00", "5200.00", "1200.00", "mpesa", "2023-01-01"),
    (14, "6400.00", "5300.00", "1100.00", "mpesa", "2023-02-01"),
    (14, "6400.00", "5400.00", "1000.00", "mpesa", "2023-03-01"),
    (14, "6400.00", "5500.00", "900.00", "mpesa", "2023-04-01"),
    (14, "6400.00", "5600.00", "800.00", "mpesa", "2023-05-01"),
    (14, "6400.00", "5700.00", "700.00", "mpesa", "2023-06-01"),
    (14, "6400.00", "5800.00", "600.00", "mpesa", "2023-07-01"),
    (14, "6300.00", "5900.00", "400.00", "mpesa", "2023-08-01"),
    (15, "5500.00", "4500.00", "1000.00", "mpesa", "2024-07-01"),
    (15, "5500.00", "4600.00", "900.00", "mpesa", "2024-08-01"),
]


def source_tables(spark):
    """Seed rows as typed source DataFrames (defaults applied as the source does)."""
    import datetime as dt

    from pyspark.sql import functions as F

    from ledgerline.functions.exprs import utc_from_offset_text
    from ledgerline.sources import schemas as S
    from ledgerline.sources import testdata

    cust = spark.createDataFrame(
        [(i + 1, n, e, None, None, None, c, "Kenya", s, True, None, None)
         for i, (n, e, c, s) in enumerate(CUSTOMERS)], S.CUSTOMERS)
    raw_loans = spark.createDataFrame(
        [(i + 1, c, p, D(a), D(r), t, st, ts, dt.date.fromisoformat(m), D(o), br)
         for i, (c, p, a, r, t, st, ts, m, o, br) in enumerate(LOANS)],
        "loan_id long, customer_id long, product_id int, amount decimal(14,2), interest_rate decimal(7,4), "
        "tenure_months int, status string, disbursed_text string, maturity_date date, "
        "outstanding_balance decimal(14,2), branch_code string")
    loans = raw_loans.select(
        "loan_id", "customer_id", "product_id", "amount", "interest_rate", "tenure_months", "status",
        utc_from_offset_text("disbursed_text").alias("disbursed_at"), "maturity_date", "outstanding_balance",
        F.lit(None).cast("string").alias("loan_officer"), "branch_code",
        F.lit(None).cast(S.TS).alias("created_at"), F.lit(None).cast(S.TS).alias("updated_at"))
    pays = spark.createDataFrame(
        [(i + 1, lo, D(a), D(p), D(it), None, m, None, dt.date.fromisoformat(d), None, None, None)
         for i, (lo, a, p, it, m, d) in enumerate(PAYMENTS)], S.PAYMENTS)
    return {"customers": cust, "loans": loans, "payments": pays, "loan_products": testdata.loan_products(spark)}
