"""Declared row types, domains and defaults of the lending model.

Every source is read with an explicit schema; nothing is inferred.
Natural keys are ``long`` so ids keep growing past 2**31 at scale.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(14, 2)
RATE = T.DecimalType(7, 4)

# ---------------------------------------------------------------------------
# Fixed values of the model (must equal the source system's declarations).
# ---------------------------------------------------------------------------
SEGMENTS = ["retail", "sme", "corporate"]
PRODUCT_TYPES = ["personal", "mortgage", "business", "auto", "education"]
LOAN_STATUSES = ["pending", "active", "repaid", "defaulted", "written_off"]
PAYMENT_METHODS = ["mpesa", "bank_transfer", "cash", "cheque", "online"]
AUDIT_OPERATIONS = ["INSERT", "UPDATE", "DELETE"]
RUN_STATUSES = ["running", "success", "failed"]

# dim_payment_method rows, in key order (method_sk = position, 1-based).
PAYMENT_METHOD_ROWS = [
    ("mpesa", "M-Pesa Mobile Money"),
    ("bank_transfer", "Bank Transfer"),
    ("cash", "Cash"),
    ("cheque", "Cheque"),
    ("online", "Online Payment"),
]

# loan_products reference rows (product_id = position, 1-based):
# name, type, min_amount, max_amount, min_tenure_months, max_tenure_months.
LOAN_PRODUCT_ROWS = [
    ("Personal Express Loan", "personal", "5000.00", "500000.00", 3, 60),
    ("SME Business Loan", "business", "50000.00", "5000000.00", 6, 84),
    ("Home Mortgage", "mortgage", "500000.00", "50000000.00", 60, 360),
    ("Auto Financing", "auto", "50000.00", "3000000.00", 12, 72),
    ("Education Loan", "education", "10000.00", "800000.00", 6, 48),
]

# Column defaults applied at ingest (column -> value).
CUSTOMER_DEFAULTS = {"country": "Kenya", "segment": "retail", "is_active": True}
LOAN_DEFAULTS = {"status": "pending"}
PAYMENT_DEFAULTS = {"penalty_portion": 0}
PRODUCT_DEFAULTS = {"is_active": True}

# Calendar range of dim_date.
CALENDAR_START = "2018-01-01"
CALENDAR_END = "2050-12-31"

# Declared lengths (VARCHAR(n)) used by the length rule.
CUSTOMER_LENGTHS = {"full_name": 100, "email": 100, "phone": 20, "national_id": 30,
                    "city": 60, "country": 60, "segment": 20}
LOAN_LENGTHS = {"status": 20, "loan_officer": 100, "branch_code": 20}
PAYMENT_LENGTHS = {"payment_method": 30, "reference_number": 50, "recorded_by": 100}
# ---------------------------------------------------------------------------


def _s(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


TS = T.TimestampNTZType()

CUSTOMERS = _s(
    ("customer_id", T.LongType(), False),
    ("full_name", T.StringType(), False),
    ("email", T.StringType(), False),
    ("phone", T.StringType(), True),
    ("national_id", T.StringType(), True),
    ("date_of_birth", T.DateType(), True),
    ("city", T.StringType(), True),
    ("country", T.StringType(), True),
    ("segment", T.StringType(), True),
    ("is_active", T.BooleanType(), True),
    ("created_at", TS, True),
    ("updated_at", TS, True),
)

LOAN_PRODUCTS = _s(
    ("product_id", T.IntegerType(), False),
    ("product_name", T.StringType(), False),
    ("product_type", T.StringType(), True),
    ("min_amount", MONEY, False),
    ("max_amount", MONEY, False),
    ("min_tenure_months", T.IntegerType(), False),
    ("max_tenure_months", T.IntegerType(), False),
    ("is_active", T.BooleanType(), True),
    ("created_at", TS, True),
)

LOANS = _s(
    ("loan_id", T.LongType(), False),
    ("customer_id", T.LongType(), False),
    ("product_id", T.IntegerType(), True),
    ("amount", MONEY, False),
    ("interest_rate", RATE, False),
    ("tenure_months", T.IntegerType(), False),
    ("status", T.StringType(), False),
    ("disbursed_at", TS, True),
    ("maturity_date", T.DateType(), True),
    ("outstanding_balance", MONEY, True),
    ("loan_officer", T.StringType(), True),
    ("branch_code", T.StringType(), True),
    ("created_at", TS, True),
    ("updated_at", TS, True),
)

PAYMENTS = _s(
    ("payment_id", T.LongType(), False),
    ("loan_id", T.LongType(), False),
    ("amount", MONEY, False),
    ("principal_portion", MONEY, True),
    ("interest_portion", MONEY, True),
    ("penalty_portion", MONEY, True),
    ("payment_method", T.StringType(), True),
    ("reference_number", T.StringType(), True),
    ("payment_date", T.DateType(), False),
    ("recorded_by", T.StringType(), True),
    ("notes", T.StringType(), True),
    ("created_at", TS, True),
)

AUDIT_LOG = _s(
    ("log_id", T.LongType(), False),
    ("table_name", T.StringType(), True),
    ("operation", T.StringType(), True),
    ("record_id", T.LongType(), True),
    ("changed_by", T.StringType(), True),
    ("change_time", TS, True),
    ("old_values", T.StringType(), True),
    ("new_values", T.StringType(), True),
)

ETL_RUNS = _s(
    ("run_id", T.LongType(), False),
    ("run_started_at", TS, True),
    ("run_finished_at", TS, True),
    ("rows_inserted", T.LongType(), True),
    ("rows_updated", T.LongType(), True),
    ("status", T.StringType(), True),
    ("error_message", T.StringType(), True),
    ("batch_id", T.LongType(), True),
    ("payments_inserted", T.LongType(), True),
    ("loans_inserted", T.LongType(), True),
    ("loans_updated", T.LongType(), True),
)

# Staging column lists (what the extract keeps from each source).
STG_CUSTOMER_COLS = ["customer_id", "full_name", "email", "phone", "city", "country",
                     "segment", "created_at"]
STG_LOAN_COLS = ["loan_id", "customer_id", "product_id", "amount", "interest_rate",
                 "tenure_months", "status", "disbursed_at", "maturity_date", "branch_code",
                 "created_at"]
STG_PAYMENT_COLS = ["payment_id", "loan_id", "amount", "principal_portion", "interest_portion",
                    "penalty_portion", "payment_method", "payment_date", "created_at"]
