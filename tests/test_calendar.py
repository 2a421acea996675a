import datetime as dt

from pyspark.sql import functions as F

from ledgerline.functions.calendar import calendar_size, dim_date


def test_calendar_rows_and_columns(spark):
    dd = dim_date(spark)
    assert calendar_size() == 12053
    assert dd.count() == 12053
    r = dd.where(F.col("full_date") == dt.date(2024, 2, 29)).first()
    assert r.date_sk == 20240229
    assert r.month_name == "February "          # blank-padded to 9
    assert r.day_name == "Thursday "
    assert r.day_of_week == 4                    # 0 = Sunday
    assert r.is_month_end and not r.is_weekend
    assert r.quarter == 1 and r.week_of_year == 9
    s = dd.where(F.col("full_date") == dt.date(2018, 12, 31)).first()
    assert s.week_of_year == 1                   # ISO week
    sun = dd.where(F.col("full_date") == dt.date(2024, 6, 16)).first()
    assert sun.day_of_week == 0 and sun.is_weekend
